"""The two daily boards: opt-out board and lifecycle board."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.timeutil import day_epoch_ms, day_from_int, month_name
from daybook.operators import cohort, engagement, history, transitions
from daybook.operators.spine import spine_join
from daybook.operators.state import StateStore
from daybook.params import DEFAULT, Params
from daybook.session import checkpointed
from daybook.sources.snapshots import snapshot_range


@dataclass
class Inputs:
    """The tables the boards read (any object with these attributes works).

    The ``flat_*`` tables are clean event tables without partitions, read by
    the opt-out attribution and the topic blocks; where one is not given, the
    partitioned log of that event stands in.  ``messages`` names accounts by campaign (account_id, campaign_id)
    for the campaign opt-outs; without it the opt-out events do.
    """

    pref_current: DataFrame
    pref_history: DataFrame
    pref_latest: DataFrame
    devices: DataFrame
    sent: DataFrame
    opened: DataFrame
    clicked: DataFrame
    opted_out: DataFrame
    first_mail: DataFrame
    flat_sent: DataFrame | None = None
    flat_opened: DataFrame | None = None
    flat_clicked: DataFrame | None = None
    flat_opted_out: DataFrame | None = None
    messages: DataFrame | None = None


def _flat(src, name: str) -> DataFrame | None:
    return getattr(src, f"flat_{name}", None)


def _flat_or_log(src, name: str) -> DataFrame:
    flat = _flat(src, name)
    return getattr(src, name) if flat is None else flat


class History:
    """The day grain of the snapshot history and the current links, built once per board.

    Several blocks read them, so both are checkpointed to the shared folder: the history is
    scanned and unnested once, a lost executor loses nothing, and no cache
    outlives the board (a later board reads its inputs again).  The size is one
    row per (account, snapshot day) and per (account, device).
    """

    #: of a range: the stock of the last listed day before it, and its first and last day
    stock_before: DataFrame | None = None
    within: tuple[Column, Column] | None = None

    def __init__(self, src, params: Params = DEFAULT, keep: bool = True):
        days = history.history_days(history.history_normalise(src.pref_history, src.devices, params), params)
        links = history.explode_links(src.pref_current, src.devices, params, keep=("account_id", "pref_flag"))
        links = links.select("account_id", "pref_flag", "device_id", "linked_ms")
        self.days, self.links = (checkpointed(days), checkpointed(links)) if keep else (days, links)


class RangeHistory(History):
    """The day grain of the snapshot days ``first_day`` to ``last_day`` (yyyymmdd), and the current links.

    ``states`` holds what the days before come to, stored under ``since``; only the range's partitions are read.
    """

    def __init__(self, src, params: Params, first_day: int, last_day: int, states: StateStore, since: int, keep: bool = True):
        norm = history.history_normalise(snapshot_range(src.pref_history, first_day, last_day), src.devices, params)
        days = history.history_days(norm, params, states.read("history", since))
        links = history.explode_links(src.pref_current, src.devices, params, keep=("account_id", "pref_flag"))
        links = links.select("account_id", "pref_flag", "device_id", "linked_ms")
        self.days, self.links = (checkpointed(days), checkpointed(links)) if keep else (days, links)
        self.stock_before = states.read("stock", since)
        self.within = (day_from_int(F.lit(first_day)), day_from_int(F.lit(last_day)))


def optout_board(src, params: Params = DEFAULT, calendar: DataFrame | None = None, hist: History | None = None) -> DataFrame:
    """Calendar with strict opt-outs (all / attributed / campaign) and net subscribers.

    With a ``RangeHistory`` it has the calendar days of that range, as the board over all days shows them.
    """
    h = hist or History(src, params)
    cal = calendar if calendar is not None else history.calendar_of(h.links, params)
    if h.within is not None:
        cal = cal.filter(F.col("cal_date").between(*h.within))
    counts = transitions.optout_counts_daily(
        h.days, src.pref_latest, _flat_or_log(src, "opted_out"), _flat_or_log(src, "sent"), params, getattr(src, "messages", None)
    )
    return spine_join(cal, [(counts, "partition_date"), (transitions.subscribers_net_daily(h.days, params, h.stock_before), "stock_day")])


#: event -> (day, first events only, total column, type suffix, topic suffix, total block, type block, topic block)
EVENTS = {
    "sent": ("send_day", False, "emails_sent", "send", "send", engagement.sends_daily, engagement.sends_by_type, engagement.sends_by_topic),
    "opened": ("open_day", True, "emails_opened", "open", "open", engagement.opens_first_daily, engagement.opens_by_type, engagement.opens_by_topic),
    "clicked": ("click_day", True, None, "click", "click", None, engagement.clicks_by_type, engagement.clicks_by_topic),
    "opted_out": ("optout_day", False, None, "optout", "opt_out", None, engagement.optouts_by_type, engagement.optouts_by_topic),
}


def event_blocks(src, params: Params) -> list[tuple[DataFrame, str]]:
    """Per log one block from one scan, or its separate blocks where a flat table serves the topics."""
    out = []
    for name, (day, first, total, type_suffix, topic_suffix, in_all, by_type, by_topic) in EVENTS.items():
        log, flat = getattr(src, name), _flat(src, name)
        if flat is None:
            out.append((engagement.log_block(log, params, day, first, total, type_suffix, topic_suffix), day))
            continue
        if in_all is not None:
            out.append((in_all(log, params), day))
        out += [(by_type(log, params), day), (by_topic(flat, params), day)]
    return out


def lifecycle_blocks(src, params: Params, h: History) -> list[tuple[DataFrame, str]]:
    links = h.links
    cal = history.calendar_of(links, params)
    after = cohort.cohort_vs_optout(h.days, src.pref_latest, src.first_mail, params)
    return [
        (engagement.activations_daily(links, params), "activation_date"),
        (transitions.subscribers_net_daily(h.days, params), "stock_day"),
        (engagement.linked_accounts_daily(links, params), "link_date"),
        *event_blocks(src, params),
        (transitions.pref_ledger_daily(h.days, params), "preference_change_date"),
        (transitions.delink_daily(cal, h.days, params), "delink_date"),
        (after, "partition_date2"),
    ]


def lifecycle_board(src, params: Params = DEFAULT, hist: History | None = None) -> DataFrame:
    """Calendar of link days with 16 metric blocks, epoch-ms and month name, before ``as_of``."""
    h = hist or History(src, params)
    cal = history.calendar_of(h.links, params).filter(F.col("cal_date") < F.lit(params.as_of))
    board = spine_join(cal, lifecycle_blocks(src, params, h))
    return board.withColumn("cal_epoch_ms", day_epoch_ms(F.col("cal_date"), 8)).withColumn(
        "month", month_name(F.col("cal_date"))
    )
