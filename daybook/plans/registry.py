"""Registered queries: key -> callable(spark, sf_dir) -> DataFrame, plus oracle SQL.

Each query builds the fixture views (``daybook.sources.fixtures``) over the
tables in ``sf_dir`` and runs one operator on them, over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.functions.timeutil import local_day_ms
from daybook.operators import audience, cohort, distinct_days, engagement, history, presence, revenue, transitions
from daybook.operators.first_state import FirstEvents
from daybook.operators.state import StateStore
from daybook.params import DEFAULT
from daybook.plans import boards
from daybook.plans.oracle import Oracle
from daybook.session import new_path
from daybook.sources.fixtures import Fixtures
from daybook.sources.snapshots import snapshot_range
from daybook.sources.stored import StoredFixtures

P = DEFAULT
O = Oracle(P)
#: A range of snapshot days.
RANGE = (date(2024, 1, 10), date(2024, 1, 19))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return deco


def fixtures(spark: SparkSession, sf_dir: str) -> Fixtures:
    return Fixtures(spark, sf_dir, P)


def _days(fx: Fixtures) -> DataFrame:
    return history.history_days(history.history_normalise(fx.pref_history, fx.devices, P), P)


def _links(fx: Fixtures) -> DataFrame:
    return history.explode_links(fx.pref_current, fx.devices, P, keep=("account_id", "pref_flag"))


# -- 2.12 user-level operators ---------------------------------------------------------


@register("revenue_91d", O.revenue_91d())
def q_revenue_91d(spark, d):
    fx = fixtures(spark, d)
    return revenue.revenue_91d(fx.revenue_facts, fx.acquisitions, fx.geo, P)


@register("revenue_tier", O.revenue_tier())
def q_revenue_tier(spark, d):
    fx = fixtures(spark, d)
    return revenue.revenue_tier(fx.revenue_facts, fx.acquisitions, fx.geo, P)


@register("audience_select", O.audience_select())
def q_audience_select(spark, d):
    fx = fixtures(spark, d)
    return audience.audience_select(fx.pref_current, fx.contacts, fx.devices, P)


@register("calendar_from_links", O.calendar_from_links())
def q_calendar_from_links(spark, d):
    fx = fixtures(spark, d)
    return history.calendar_from_links(fx.pref_current, fx.devices, P)


@register("history_normalise", O.history_normalise())
def q_history_normalise(spark, d):
    fx = fixtures(spark, d)
    return history.history_normalise(fx.pref_history, fx.devices, P)


@register("optout_strict", O.optout_strict())
def q_optout_strict(spark, d):
    return transitions.optout_strict(_days(fixtures(spark, d)))


@register("optout_total_daily", O.optout_total_daily())
def q_optout_total_daily(spark, d):
    fx = fixtures(spark, d)
    return transitions.optout_total_daily(_days(fx), fx.pref_latest)


@register("optout_attributed_daily", O.optout_attributed_daily())
def q_optout_attributed_daily(spark, d):
    fx = fixtures(spark, d)
    return transitions.optout_attributed_daily(_days(fx), fx.pref_latest, fx.opted_out, fx.sent)


@register("optout_campaign_daily", O.optout_campaign_daily())
def q_optout_campaign_daily(spark, d):
    fx = fixtures(spark, d)
    return transitions.optout_campaign_daily(_days(fx), fx.pref_latest, fx.opted_out, fx.sent, P)


@register("subscribers_net_daily", O.subscribers_net_daily())
def q_subscribers_net_daily(spark, d):
    return transitions.subscribers_net_daily(_days(fixtures(spark, d)), P)


@register("activations_daily", O.activations_daily())
def q_activations_daily(spark, d):
    return engagement.activations_daily(_links(fixtures(spark, d)), P)


@register("activations_bitmaps", O.activations_daily())
def q_activations_bitmaps(spark, d):
    """The counts of activations_daily from bitmaps that are kept per day: the early days', then the later days' merged in."""
    links = _links(fixtures(spark, d)).select("device_id", local_day_ms("linked_ms", P.local_tz).alias("activation_date"))
    early = F.col("activation_date") < F.lit(RANGE[0])
    kept, path = [], new_path(spark, "bitmaps")
    for k, rows in enumerate((links.where(early), links.where(~early))):
        distinct_days.daily_bitmaps(rows, "activation_date", "device_id").write.parquet(f"{path}/{k}")
        kept.append(spark.read.parquet(f"{path}/{k}"))
    return distinct_days.distinct_daily(
        distinct_days.merge_bitmaps(*kept, "activation_date"), "activation_date", "device_activations"
    )


@register("opens_first_state", O.opens_first_daily())
def q_opens_first_state(spark, d):
    """The counts of opens_first_daily from stored first events: the later days first, then the earlier ones as late rows."""
    log = engagement.log_since(fixtures(spark, d).opened, P).select("campaign_id", "message_id", "t_us", "partition_day")
    late = F.col("partition_day") < int(RANGE[0].strftime("%Y%m%d"))
    first = FirstEvents(spark, new_path(spark, "first_events"))
    first.create(log.where(~late))
    first.arrive(log.where(late))
    return first.opens_daily(P)


@register("presence_runs", O.presence_runs())
def q_presence_runs(spark, d):
    """Runs of kept days: those of the range's days merged into those of the days before and after."""
    fx = fixtures(spark, d)
    cal = history.calendar_from_links(fx.pref_current, fx.devices, P)
    kept, days = transitions.kept_days(cal, P).select("cal_date"), _days(fx)
    inside = F.col("partition_date").between(F.lit(RANGE[0]), F.lit(RANGE[1]))
    runs = presence.merge_runs(presence.presence_runs(days.where(~inside), kept), presence.presence_runs(days.where(inside), kept))
    places = presence.numbered(kept)
    first = places.select(F.col("place").alias("first_place"), F.col("day").alias("first_day"))
    last = places.select(F.col("place").alias("last_place"), F.col("day").alias("last_day"))
    return runs.join(F.broadcast(first), "first_place").join(F.broadcast(last), "last_place").select("account_id", "first_day", "last_day")


@register("linked_accounts_daily", O.linked_accounts_daily())
def q_linked_accounts_daily(spark, d):
    return engagement.linked_accounts_daily(_links(fixtures(spark, d)), P)


@register("sends_daily", O.sends_daily())
def q_sends_daily(spark, d):
    return engagement.sends_daily(fixtures(spark, d).sent, P)


@register("opens_first_daily", O.opens_first_daily())
def q_opens_first_daily(spark, d):
    return engagement.opens_first_daily(fixtures(spark, d).opened, P)


def _pivot_query(key: str, fn, table: str):
    def q(spark, d):
        return fn(getattr(fixtures(spark, d), table), P)

    q.__name__ = f"q_{key}"
    return q


for _key, _fn, _tab in [
    ("sends_by_type", engagement.sends_by_type, "sent"),
    ("opens_by_type", engagement.opens_by_type, "opened"),
    ("clicks_by_type", engagement.clicks_by_type, "clicked"),
    ("optouts_by_type", engagement.optouts_by_type, "opted_out"),
]:
    register(_key, O.pivot(_key))(_pivot_query(_key, _fn, _tab))

for _key, _fn, _tab in [
    ("sends_by_topic", engagement.sends_by_topic, "sent"),
    ("clicks_by_topic", engagement.clicks_by_topic, "clicked"),
    ("opens_by_topic", engagement.opens_by_topic, "opened"),
    ("optouts_by_topic", engagement.optouts_by_topic, "opted_out"),
]:
    register(_key, O.topic(_key))(_pivot_query(_key, _fn, _tab))


@register("pref_ledger_daily", O.pref_ledger_daily())
def q_pref_ledger_daily(spark, d):
    return transitions.pref_ledger_daily(_days(fixtures(spark, d)), P)


@register("pref_day_remap", O.pref_day_remap())
def q_pref_day_remap(spark, d):
    fx = fixtures(spark, d)
    norm = history.history_normalise(fx.pref_history, fx.devices, P)
    booked = transitions.remap_day(F.col("link_date"), F.col("partition_date"), P)
    return norm.groupBy(booked.alias("booked_date")).agg(F.count(F.lit(1)).alias("n_rows"))


@register("optin_flag", O.optin_optout_flags())
def q_optin_flag(spark, d):
    ch = transitions.pref_changes(_days(fixtures(spark, d)), P)
    return ch.groupBy("partition_date").agg(F.sum("optin").alias("optins"), F.sum("optout").alias("optouts"))


@register("optout_loose", O.optout_loose_rows())
def q_optout_loose(spark, d):
    days = _days(fixtures(spark, d))
    return days.filter(transitions.optout_loose(F.col("prev_flag"), F.col("pref_flag")) == 1).select(
        "account_id", "partition_date", "prev_flag", "pref_flag"
    )


@register("setup_flags", O.setup_flags())
def q_setup_flags(spark, d):
    ch = transitions.pref_changes(_days(fixtures(spark, d)), P)
    return ch.groupBy("partition_date").agg(
        F.sum("setup_optin").alias("setup_optin"), F.sum("setup_optout").alias("setup_optout")
    )


@register("delink_daily", O.delink_daily())
def q_delink_daily(spark, d):
    fx = fixtures(spark, d)
    cal = history.calendar_from_links(fx.pref_current, fx.devices, P)
    return transitions.delink_daily(cal, _days(fx), P)


@register("account_last_seen", O.account_last_seen())
def q_account_last_seen(spark, d):
    fx = fixtures(spark, d)
    return history.account_last_seen(fx.pref_history, fx.devices, P)


@register("first_mail_cohort_daily", O.first_mail_cohort_daily())
def q_first_mail_cohort_daily(spark, d):
    return cohort.first_mail_cohort_daily(fixtures(spark, d).first_mail)


@register("optout_after_mail_raw", O.optout_after_mail_raw())
def q_optout_after_mail_raw(spark, d):
    fx = fixtures(spark, d)
    return cohort.optout_after_mail_raw(fx.pref_history, fx.first_mail)


@register("optout_after_mail_daily", O.optout_after_mail_daily())
def q_optout_after_mail_daily(spark, d):
    fx = fixtures(spark, d)
    return cohort.optout_after_mail_daily(_days(fx), fx.pref_latest, fx.first_mail, P)


@register("cohort_vs_optout", O.cohort_vs_optout())
def q_cohort_vs_optout(spark, d):
    fx = fixtures(spark, d)
    return cohort.cohort_vs_optout(_days(fx), fx.pref_latest, fx.first_mail, P)


@register("optout_board", O.optout_board())
def q_optout_board(spark, d):
    return boards.optout_board(fixtures(spark, d), P)


def _range_inputs(spark, d) -> tuple[StoredFixtures, StateStore, tuple[int, int, int]]:
    """Stored snapshots, and the states of the days before the range, stored in turn."""
    fx = StoredFixtures(spark, d, P)
    first, last = (int(x.strftime("%Y%m%d")) for x in RANGE)
    since = int((RANGE[0] - timedelta(days=1)).strftime("%Y%m%d"))
    states = StateStore(spark, new_path(spark, "history_states"))
    old = snapshot_range(fx.pref_history, 0, since)
    states.save(since, history.history_days(history.history_normalise(old, fx.devices, P), P))
    return fx, states, (first, last, since)


@register("history_range", O.history_range(*RANGE))
def q_history_range(spark, d):
    fx, states, (first, last, since) = _range_inputs(spark, d)
    norm = history.history_normalise(snapshot_range(fx.pref_history, first, last), fx.devices, P)
    days = history.history_days(norm, P, states.read("history", since))
    return days.select("account_id", "partition_date", "prev_flag", "pref_flag", "n_rows")


@register("optout_board_range", O.optout_board_range(*RANGE))
def q_optout_board_range(spark, d):
    fx, states, days = _range_inputs(spark, d)
    return boards.optout_board(fx, P, hist=boards.RangeHistory(fx, P, days[0], days[1], states, days[2]))


@register("lifecycle_board", O.lifecycle_board())
def q_lifecycle_board(spark, d):
    return boards.lifecycle_board(fixtures(spark, d), P)


@register("limit_preview", O.limit_preview())
def q_limit_preview(spark, d):
    fx = fixtures(spark, d)
    return audience.preview(audience.audience_select(fx.pref_current, fx.contacts, fx.devices, P), 1)


# -- 2.1-2.8 expression-level keys ------------------------------------------------------

from daybook.plans import primitives as _prim  # noqa: E402

for _k, _f in _prim.SPARK.items():
    register(_k, _prim.SQL.get(_k))(_f)
