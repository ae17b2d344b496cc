"""Preference transitions over the day-grain history (see ``history_days``).

Each flag below is evaluated once per row of the day grain, with
``first_link`` as that row's link day: on a one-flag day only the first row can carry a
transition, and a day with several flags keeps its rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.operators.history import outage_links
from daybook.operators.presence import presence_runs, run_ends_daily
from daybook.params import DEFAULT, Params


def is_true(c: Column) -> Column:
    return c.eqNullSafe(F.lit(True))


def is_false(c: Column) -> Column:
    return c.eqNullSafe(F.lit(False))


def _flag(cond: Column) -> Column:
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def remap_day(link: Column, day: Column, params: Params = DEFAULT) -> Column:
    """Booking day: the link day if it falls in an outage range, else the day before the snapshot."""
    expr = None
    for lo, hi in params.outages:
        cond = link.between(F.lit(lo), F.lit(hi))
        expr = F.when(cond, link) if expr is None else expr.when(cond, link)
    fallback = F.date_add(day, -1)
    return fallback if expr is None else expr.otherwise(fallback)


def strict_optout(prev: Column, cur: Column) -> Column:
    """1 iff previous flag IS TRUE and current IS FALSE."""
    return _flag(is_true(prev) & is_false(cur))


def optin_flag(prev: Column, cur: Column) -> Column:
    """Null-to-true or false-to-true (a first sighting counts)."""
    return _flag((prev.isNull() & (cur == True)) | ((prev == False) & (cur == True)))  # noqa: E712


def optout_loose(prev: Column, cur: Column) -> Column:
    """Null-to-false or true-to-false (a first sighting counts)."""
    return _flag((prev.isNull() & (cur == False)) | (is_true(prev) & (cur == False)))  # noqa: E712


def setup_cond(prev: Column, link: Column, day: Column, params: Params = DEFAULT) -> Column:
    """First sighting linked the day before, or a backlog link seen on its resume day."""
    cond = link == F.date_add(day, -1)
    for lo, hi, resume in params.backlogs:
        cond = cond | (link.between(F.lit(lo), F.lit(hi)) & (day == F.lit(resume)))
    return prev.isNull() & cond


def setup_flags(prev: Column, cur: Column, link: Column, day: Column, params: Params = DEFAULT):
    """(opt-in at set-up, opt-out at set-up) flags."""
    s = setup_cond(prev, link, day, params)
    return _flag(s & (cur == True)), _flag(s & (cur == False))  # noqa: E712


# -- strict opt-outs ------------------------------------------


def optout_strict(days: DataFrame) -> DataFrame:
    """Rows whose flag went from true to false: (account_id, pref_flag, partition_date, prev_flag)."""
    return days.filter(strict_optout(F.col("prev_flag"), F.col("pref_flag")) == 1).select(
        "account_id", "pref_flag", "partition_date", "prev_flag"
    )


def opted_out_latest(latest: DataFrame) -> DataFrame:
    """Accounts whose newest snapshot says opted out (semi-join side)."""
    return latest.filter(F.col("pref_flag") == False).select("account_id")  # noqa: E712


def attributed_accounts(opted_out: DataFrame, sent: DataFrame) -> DataFrame:
    """Accounts with an opt-out event for a message that was sent.

    Written as a semi join on message ids, not an inner join: an inner join of
    two logs on a hot message id would emit every pair of their rows.
    """
    sent_ids = sent.select("message_id").distinct()
    pairs = opted_out.select("account_id", "message_id").distinct()
    return pairs.join(sent_ids, "message_id", "left_semi").select("account_id").distinct()


def campaign_accounts(opted_out: DataFrame, campaigns) -> DataFrame:
    return opted_out.filter(F.col("campaign_id").isin(list(campaigns))).select("account_id").distinct()


def _count_daily(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("partition_date").agg(F.count("account_id").alias(name))


def optout_total_daily(days: DataFrame, latest: DataFrame) -> DataFrame:
    rows = optout_strict(days).join(opted_out_latest(latest), "account_id", "left_semi")
    return _count_daily(rows, "total_opt_out")


def optout_attributed_daily(days: DataFrame, latest: DataFrame, opted_out: DataFrame, sent: DataFrame) -> DataFrame:
    rows = (
        optout_strict(days)
        .join(opted_out_latest(latest), "account_id", "left_semi")
        .join(attributed_accounts(opted_out, sent), "account_id", "left_semi")
    )
    return _count_daily(rows, "email_opt_out")


def optout_campaign_daily(
    days: DataFrame,
    latest: DataFrame,
    opted_out: DataFrame,
    sent: DataFrame,
    params: Params = DEFAULT,
    messages: DataFrame | None = None,
) -> DataFrame:
    """``messages`` names accounts by campaign (account_id, campaign_id); by default the opt-out events do."""
    rows = (
        optout_strict(days)
        .join(opted_out_latest(latest), "account_id", "left_semi")
        .join(attributed_accounts(opted_out, sent), "account_id", "left_semi")
        .join(campaign_accounts(opted_out if messages is None else messages, params.attributed_campaigns), "account_id", "left_semi")
    )
    return _count_daily(rows, "onboarding_opt_out")


def optout_counts_daily(
    days: DataFrame,
    latest: DataFrame,
    opted_out: DataFrame,
    sent: DataFrame,
    params: Params = DEFAULT,
    messages: DataFrame | None = None,
) -> DataFrame:
    """The three counts above per day in one pass; a count of no rows is null."""
    rows = optout_strict(days).join(opted_out_latest(latest), "account_id", "left_semi")
    told = attributed_accounts(opted_out, sent).withColumn("told", F.lit(True))
    group = campaign_accounts(opted_out if messages is None else messages, params.attributed_campaigns)
    rows = rows.join(told, "account_id", "left").join(group.withColumn("grouped", F.lit(True)), "account_id", "left")

    def count(cond: Column) -> Column:
        n = F.count(F.when(cond, 1))
        return F.when(n > 0, n)

    return rows.groupBy("partition_date").agg(
        F.count(F.lit(1)).alias("total_opt_out"),
        count(F.col("told")).alias("email_opt_out"),
        count(F.col("told") & F.col("grouped")).alias("onboarding_opt_out"),
    )


def stock_daily(days: DataFrame) -> DataFrame:
    """Opted-in rows per day (``stock_day``, ``stock``); days without one are not listed."""
    return (
        days.filter(F.col("n_true") > 0)
        .groupBy(F.col("partition_date").alias("stock_day"))
        .agg(F.coalesce(F.sum(F.when(F.col("account_id").isNotNull(), F.col("n_true"))), F.lit(0)).alias("stock"))
    )


def subscribers_net_daily(days: DataFrame, params: Params = DEFAULT, before: DataFrame | None = None) -> DataFrame:
    """Opted-in rows per day and the change from the previous listed day.

    The global ``lag`` runs after aggregation, on one row per day.  Where ``days`` starts within the history, ``before``
    is the last listed day before it, as ``stock_daily`` gives it.
    """
    stock = stock_daily(days).withColumn("carried", F.lit(False))
    if before is not None:
        stock = stock.unionByName(before.select("stock_day", "stock").withColumn("carried", F.lit(True)))
    prev = F.lag("stock").over(Window.orderBy("stock_day"))
    return stock.withColumn("prev", prev).filter(~F.col("carried")).select(
        "stock_day",
        F.when(F.col("stock_day") == F.lit(params.seed_day), F.col("stock"))
        .otherwise(F.col("stock") - F.col("prev"))
        .alias("subscribers"),
    )


# -- loose ledger (dashboard) -----------------------------------------------------


def pref_changes(days: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per (account, day): booked day and the four ledger flags of its first row."""
    prev, cur, link, day = F.col("prev_flag"), F.col("pref_flag"), F.col("first_link"), F.col("partition_date")
    s_in, s_out = setup_flags(prev, cur, link, day, params)
    return days.select(
        "account_id",
        "partition_date",
        remap_day(link, day, params).alias("booked_date"),
        optout_loose(prev, cur).alias("optout"),
        optin_flag(prev, cur).alias("optin"),
        s_in.alias("setup_optin"),
        s_out.alias("setup_optout"),
    )


def booked_days(days: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Every day some normalised row is booked on: its link day when inside an
    outage range, else the day before its snapshot."""
    regular = F.when(F.col("has_regular"), F.array(F.date_add("partition_date", -1))).otherwise(
        F.array().cast("array<date>")
    )
    return days.select(F.explode(F.array_union(regular, outage_links(params))).alias("booked_date")).distinct()


def pref_ledger_daily(days: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Per booked day: opt-outs, opt-ins, set-up opt-ins and opt-outs, and their sum.

    A booked day exists when any normalised row maps to it, even if no first
    row does (its sums are then 0); ``booked_days`` supplies that day set.
    """
    sums = (
        pref_changes(days, params)
        .groupBy("booked_date")
        .agg(
            F.sum("optout").alias("optouts"),
            F.sum("optin").alias("optins"),
            F.sum("setup_optin").alias("setup_optin"),
            F.sum("setup_optout").alias("setup_optout"),
        )
    )
    booked = booked_days(days, params)
    z = F.lit(0).cast("bigint")
    out = booked.join(sums, "booked_date", "left").select(
        F.col("booked_date").alias("preference_change_date"),
        F.coalesce("optouts", z).alias("optouts"),
        F.coalesce("optins", z).alias("optins"),
        F.coalesce("setup_optin", z).alias("setup_optin"),
        F.coalesce("setup_optout", z).alias("setup_optout"),
    )
    return out.withColumn("setup_linked", F.col("setup_optin") + F.col("setup_optout"))


# -- delinks ------------------------------------------------------------------------


def kept_days(calendar: DataFrame, params: Params = DEFAULT) -> DataFrame:
    cond = reduce(
        lambda a, b: a & b,
        [~F.col("cal_date").between(F.lit(lo), F.lit(hi)) for lo, hi in params.outages],
        F.lit(True),
    )
    return calendar.filter(cond)


def delink_daily(calendar: DataFrame, days: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Accounts present on a kept calendar day and absent on the next kept day.

    Equivalent to the calendar x accounts expansion with a ``lag``, but costs one pass over the presence rows: they
    become runs of consecutive kept days (``presence``), and a delink is the day after a run's end.
    """
    kept = kept_days(calendar, params).select("cal_date")
    return run_ends_daily(presence_runs(days, kept), kept)
