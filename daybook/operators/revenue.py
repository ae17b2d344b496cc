"""Revenue in the first days of an acquisition interval, and spend tiers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.functions.timeutil import period_quarter
from daybook.operators.sweep import cover
from daybook.params import DEFAULT, TIER_LABELS, Params


def interval_join(facts: DataFrame, acquisitions: DataFrame, params: Params = DEFAULT, one_a_day: bool = False) -> DataFrame:
    """Facts (alias ``f``) inside [activation, next event - 1] of an acquisition (alias ``a``) of the same account.

    A sweep over each account's days (``sweep.cover``) finds the interval of every day, and equi-joins
    attach the rows: no range condition is left to a join, and a hot account is spread over blocks of its days.
    ``one_a_day`` says that ``facts`` has at most one row per (account, day), which saves the join back to them.
    """
    begin, end = F.col("activation_date_id"), F.coalesce(F.col("next_event_date_id") - 1, F.lit(params.open_end_sentinel))
    a = acquisitions.withColumns({"__start": begin, "__end": end}).alias("a")
    points = facts if one_a_day else facts.select("account_id", "date_id").distinct()
    hits = cover(points, a, "account_id", "date_id", "__start", "__end").alias("f")
    same = [F.col(f"f.{c}") == F.col(f"a.{c}") for c in ("account_id", "__start", "__end")]
    found = hits.join(a, same)
    if one_a_day:
        return found
    owned = found.select("f.account_id", "f.date_id", *[F.col(f"a.{c}").alias(f"__a_{c}") for c in acquisitions.columns]).alias("h")
    joined = facts.alias("f").join(owned, (F.col("f.account_id") == F.col("h.account_id")) & (F.col("f.date_id") == F.col("h.date_id")))
    left = joined.select(*[F.col(f"f.{c}").alias(f"__f_{c}") for c in facts.columns], *[f"__a_{c}" for c in acquisitions.columns])
    # the callers' names f.x and a.x, as two structs
    return left.select(
        F.struct(*[F.col(f"__f_{c}").alias(c) for c in facts.columns]).alias("f"),
        F.struct(*[F.col(f"__a_{c}").alias(c) for c in acquisitions.columns]).alias("a"),
    )


def daily_amounts(facts: DataFrame) -> DataFrame:
    """Facts summed per (account, day) before the interval join.

    Exact for the window sums (sums are decomposable, and a day row exists iff
    a fact does), and it bounds what one account sends through the join to one
    row per day, however many facts a hot account has.  The shuffle key is
    (account, day), so a hot account is spread over its days, and the partial
    aggregate runs before that shuffle.
    """
    return facts.groupBy("account_id", "date_id").agg(F.sum("amount").alias("amount"))


def tier(s: Column, params: Params = DEFAULT) -> Column:
    top, mid, bottom = params.tier_floors
    return (
        F.when(s >= top, F.lit(TIER_LABELS[0]))
        .when(s >= mid, F.lit(TIER_LABELS[1]))
        .when(s >= bottom, F.lit(TIER_LABELS[2]))
        .otherwise(F.lit(TIER_LABELS[3]))
    )


def prorate(s: Column, activation: Column, params: Params = DEFAULT) -> Column:
    """``S * (window / (cutoff - A))``, real division, null when the divisor is 0."""
    divisor = F.lit(params.cutoff_date_id) - activation
    factor = F.lit(float(params.window_days)) / F.when(divisor != 0, divisor.cast("double"))
    return s.cast("double") * factor


def revenue_91d(facts: DataFrame, acquisitions: DataFrame, geo: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per acquisition (account, channel, activation day, subchannel, region, quarter):
    gross revenue of the first ``window_days`` (prorated when the window reaches
    past the cutoff), the ``adjusted`` flag and the spend tier of the raw sum.
    """
    epoch: date = params.date_epoch
    # an id range, so that the filter reaches a scan of acquisitions
    year_start, year_end = (F.lit((date(params.activation_year, *d) - epoch).days) for d in ((1, 1), (12, 31)))
    acq = acquisitions.filter(
        (F.col("billing_category") == params.billing_category)
        & (F.col("service_country") != params.excluded_service_country)
        & (F.col("is_fraud") == False)  # noqa: E712
        & F.col("activation_date_id").between(year_start, year_end)
    )
    # Facts before the selected year's first activation day cannot join an interval.
    f = facts.select("account_id", "date_id", "amount").filter(F.col("date_id") >= year_start)
    j = interval_join(daily_amounts(f), acq, params, one_a_day=True)
    g = geo.select("country_code", "region")
    j = j.join(g, F.col("a.country_code") == g.country_code, "left")
    a_day = F.col("a.activation_date_id")
    in_window = F.when(F.col("f.date_id") < a_day + params.window_days, F.col("f.amount")).otherwise(F.lit(0))
    agg = j.groupBy(
        F.col("f.account_id").alias("account_id"),
        F.col("a.channel").alias("channel"),
        a_day.alias("activation_date_id"),
        F.col("a.subchannel").alias("subchannel"),
        F.col("region"),
        period_quarter(a_day, epoch).alias("activation_quarter"),
    ).agg(F.sum(in_window).alias("s"))
    a = F.col("activation_date_id")
    open_window = a + params.window_days < params.cutoff_date_id
    return agg.select(
        "account_id",
        "channel",
        "activation_date_id",
        "subchannel",
        "region",
        "activation_quarter",
        F.when(open_window, F.col("s").cast("double")).otherwise(prorate(F.col("s"), a, params)).alias("gross_revenue_91d"),
        F.when(open_window, F.lit(0)).otherwise(F.lit(1)).alias("adjusted"),
        tier(F.col("s"), params).alias("tier"),
    )


def revenue_tier(facts: DataFrame, acquisitions: DataFrame, geo: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Spend tier per acquisition, from the unprorated sum."""
    return revenue_91d(facts, acquisitions, geo, params).select(
        "account_id", "channel", "activation_date_id", "subchannel", "region", "activation_quarter", "tier"
    )
