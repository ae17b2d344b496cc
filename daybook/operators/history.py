"""Snapshot history: calendar, normalised link rows and the per-day flag sequence.

``history_normalise`` is the 4-column de-duplicated unnest of the snapshot
family.  ``history_days`` collapses it: a day on which an account has one flag
becomes one row, since every row of the day after its first (in link-day order) has the
day's own flag as predecessor; a day with several flags keeps its rows.  The
row-level ``lag`` ordered by (day, link day, flag) is fully described by that, and
the window spans one row per ordinary snapshot day of an account, however many
devices a hot account links.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.functions.timeutil import day_from_int, local_day_ms
from daybook.params import DEFAULT, Params

#: Devices that a join of links sends to every task (about 50 bytes each).
BROADCAST_DEVICES = 2_000_000


def _met(devices: DataFrame, links: DataFrame) -> DataFrame:
    """``devices``, sent to every task where a count proves them few, else without those that no link names.

    Links repeat on every snapshot day, so a shuffle of them by device gathers a common device's links in one task.
    """
    if devices.limit(BROADCAST_DEVICES + 1).count() <= BROADCAST_DEVICES:
        return F.broadcast(devices)
    named = devices.join(links.select("device_id").distinct(), "device_id", "left_semi")
    return F.broadcast(named) if named.limit(BROADCAST_DEVICES + 1).count() <= BROADCAST_DEVICES else named


def explode_links(prefs: DataFrame, devices: DataFrame, params: Params = DEFAULT, keep=("*",)) -> DataFrame:
    """One row per (preference row, device link) whose device passes the base filter.

    Output columns: ``keep`` from ``prefs`` plus ``device_id``, ``linked_ms`` and
    the device columns.  An empty ``device_data`` drops the row (inner unnest).
    """
    own = [c for c in prefs.columns if c != "device_data"]
    x = prefs.select(*own, F.explode("device_data").alias("lnk")).select(
        *own,
        F.col("lnk.device_id").alias("device_id"),
        F.col("lnk.time_linked_with_user_ms").alias("linked_ms"),
    )
    # the base filter may name any account, link or device column, so columns go after it ran
    rows = x.join(_met(devices, x), "device_id").filter(params.base_predicate())
    return rows if keep == ("*",) else rows.drop(*[c for c in own if c not in keep])


def calendar_from_links(pref_current: DataFrame, devices: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Local days with at least one device link (``cal_date``)."""
    return calendar_of(explode_links(pref_current, devices, params, keep=("account_id",)), params)


def calendar_of(links: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Calendar from already unnested, filtered links (``linked_ms``)."""
    return links.select(local_day_ms("linked_ms", params.local_tz).alias("cal_date")).distinct()


def history_normalise(history: DataFrame, devices: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Unique (account_id, pref_flag, partition_date, link_date) of the snapshot family."""
    x = explode_links(history, devices, params, keep=("account_id", "pref_flag", "partition_day"))
    return x.select(
        "account_id",
        "pref_flag",
        day_from_int("partition_day").alias("partition_date"),
        local_day_ms("linked_ms", params.local_tz).alias("link_date"),
    ).distinct()


def first_link(link: Column) -> Column:
    """Link day of the first row of a group in ascending order (nulls first)."""
    return F.when(F.count(F.when(link.isNull(), 1)) > 0, F.lit(None).cast("date")).otherwise(F.min(link))


def in_outage(link: Column, params: Params = DEFAULT) -> Column:
    cond = F.lit(False)
    for lo, hi in params.outages:
        cond = cond | link.between(F.lit(lo), F.lit(hi))
    return F.coalesce(cond, F.lit(False))


def row_order(link: Column, flag: Column) -> Column:
    """(link day, flag) ascending with nulls first, as one bigint."""
    day = F.when(link.isNull(), F.lit(-(2**40))).otherwise(F.unix_date(link).cast("bigint"))
    code = F.when(flag.isNull(), F.lit(0)).when(~flag, F.lit(1)).otherwise(F.lit(2))
    return day * F.lit(3) + code


def outage_days(params: Params = DEFAULT) -> list[date]:
    """The days of the outage ranges, in order: as many bits of the ``outage_*`` masks."""
    days = {lo + timedelta(days=i) for lo, hi in params.outages for i in range((hi - lo).days + 1)}
    return sorted(days)


def _outage_masks(link: Column, params: Params) -> list[Column]:
    """One bigint per 60 outage days, with the bit of the link day's place set."""
    days = outage_days(params)
    out = []
    for k in range(0, len(days), 60):
        mask = F.lit(0).cast("bigint")
        for i, d in enumerate(days[k : k + 60]):
            mask = F.when(link == F.lit(d), F.lit(1 << i).cast("bigint")).otherwise(mask)
        out.append(mask.alias(f"outage_{k // 60}"))
    return out


def outage_links(params: Params = DEFAULT) -> Column:
    """The outage days whose bits are set, as an array of dates."""
    days = outage_days(params)
    each = [
        F.when(F.col(f"outage_{i // 60}").bitwiseAND(F.lit(1 << i % 60)) != 0, F.lit(d)) for i, d in enumerate(days)
    ]
    return F.array_compact(F.array(*each)) if each else F.array().cast("array<date>")


def history_days(norm: DataFrame, params: Params = DEFAULT, state: DataFrame | None = None) -> DataFrame:
    """Normalised rows, with each one-flag (account_id, partition_date) collapsed to one row.

    Columns: ``pref_flag``, ``first_link`` (link day of the day's first row in
    (link day, flag) order, nulls first), ``n_rows`` and ``n_true`` (rows, and
    rows opted in), ``has_regular`` (some row's link day is outside the outage
    ranges), ``outage_*`` (bit masks of the link days inside them),
    ``row_key`` (order within the day) and ``prev_flag`` (flag of the account's
    previous row, null on its first).  On a day with several flags every
    row stays, so changes inside the day are seen.

    ``norm`` may hold the days of a range only; ``state`` (see ``state.history_state``) then names each
    account's last row before it, from which ``prev_flag`` goes on.
    """
    link, flag = F.col("link_date"), F.col("pref_flag")
    out = in_outage(link, params)
    masks = [f"outage_{k}" for k in range(-(-len(outage_days(params)) // 60))]
    marked = norm.select("*", out.alias("out"), *_outage_masks(link, params))
    days = marked.groupBy("account_id", "partition_date").agg(
        F.max(flag).alias("pref_flag"),
        F.min(flag).alias("low"),
        F.count(flag).alias("n_flags"),
        first_link(link).alias("first_link"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(flag, 1)).alias("n_true"),
        F.max(~F.col("out")).alias("has_regular"),
        *[F.bit_or(m).alias(m) for m in masks],
    )
    one_flag = (F.col("n_flags") == 0) | ((F.col("n_flags") == F.col("n_rows")) & (F.col("low") == flag))
    single = days.filter(one_flag).withColumn("row_key", F.lit(0).cast("bigint")).drop("low", "n_flags")
    mixed = days.filter(~one_flag).select(F.col("account_id").alias("a"), F.col("partition_date").alias("d"))
    rows = marked.join(
        mixed, F.col("account_id").eqNullSafe(F.col("a")) & F.col("partition_date").eqNullSafe(F.col("d")), "left_semi"
    ).select(
        "account_id",
        "partition_date",
        "pref_flag",
        link.alias("first_link"),
        F.lit(1).cast("bigint").alias("n_rows"),
        F.when(flag, 1).otherwise(0).cast("bigint").alias("n_true"),
        (~F.col("out")).alias("has_regular"),
        *masks,
        row_order(link, flag).alias("row_key"),
    )
    return with_previous(single.unionByName(rows), state)


def with_previous(days: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Add ``prev_flag``; the rows of ``state`` come before all others and are left out again."""
    w = Window.partitionBy("account_id").orderBy("partition_date", "row_key")
    prev = F.lag("pref_flag").over(w)
    if state is None:
        return days.withColumn("prev_flag", prev)
    carried = state.select("account_id", "partition_date", "pref_flag", F.lit(0).cast("bigint").alias("row_key"), F.lit(True).alias("carried"))
    both = days.withColumn("carried", F.lit(False)).unionByName(carried, allowMissingColumns=True)
    return both.withColumn("prev_flag", prev).filter(~F.col("carried")).drop("carried")


def account_last_seen(history: DataFrame, devices: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Last snapshot day per account among rows passing the base filter."""
    x = explode_links(history, devices, params, keep=("account_id", "partition_day"))
    return x.groupBy("account_id").agg(day_from_int(F.max("partition_day")).alias("end_date"))
