"""First-mail cohorts and the opt-outs that follow a first mail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.functions.timeutil import day_from_int
from daybook.operators.history import with_previous
from daybook.operators.transitions import opted_out_latest, optout_loose, remap_day
from daybook.params import DEFAULT, Params


def first_mail_day(first_mail: DataFrame) -> DataFrame:
    """Earliest mail partition per account (the min-first form of 'some mail on or before')."""
    return first_mail.groupBy("account_id").agg(F.min("partition_day").alias("first_day"))


def mail_calendar(first_mail: DataFrame) -> DataFrame:
    """Days with any first-mail row: ``cal_date`` (yyyymmdd) and ``partition_date2`` (date)."""
    return first_mail.select(
        F.col("partition_day").cast("bigint").alias("cal_date"),
        day_from_int("partition_day").alias("partition_date2"),
    ).distinct()


def first_mail_cohort_daily(first_mail: DataFrame) -> DataFrame:
    """Accounts by the day of their first mail, on the mail-day calendar (null where none)."""
    cohort = (
        first_mail_day(first_mail)
        .groupBy(F.col("first_day").alias("opt_date"))
        .agg(F.count("account_id").alias("total_email"))
    )
    cal = mail_calendar(first_mail)
    return cal.join(F.broadcast(cohort), cal.cal_date == cohort.opt_date, "left").select(
        "cal_date", "partition_date2", "total_email"
    )


def optout_after_mail_raw(history: DataFrame, first_mail: DataFrame) -> DataFrame:
    """Distinct opted-out accounts per snapshot day among accounts ever mailed."""
    mailed = first_mail.select("account_id")
    rows = history.filter(F.col("pref_flag") == False).join(mailed, "account_id", "left_semi")  # noqa: E712
    return rows.groupBy(F.col("partition_day").cast("bigint").alias("partition_date")).agg(
        F.countDistinct("account_id").alias("mailed_optout")
    )


def optout_after_mail_daily(days: DataFrame, latest: DataFrame, first_mail: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Loose opt-outs seen on or after an account's first mail, still opted out now.

    The previous flag is taken over the post-mail days only, so the first
    post-mail day has none.  Counted as distinct accounts per booked day.
    """
    fm = first_mail_day(first_mail)
    after = (
        days.drop("prev_flag")
        .join(fm, "account_id")
        .filter(F.col("partition_date") >= day_from_int("first_day"))
        .drop("first_day")
        .join(opted_out_latest(latest), "account_id", "left_semi")
    )
    after = with_previous(after)
    flagged = after.filter(optout_loose(F.col("prev_flag"), F.col("pref_flag")) == 1)
    return flagged.groupBy(
        remap_day(F.col("first_link"), F.col("partition_date"), params).alias("partition_date")
    ).agg(F.countDistinct("account_id").alias("c_opt_outs"))


def cohort_vs_optout(days: DataFrame, latest: DataFrame, first_mail: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Mail-cohort size beside later opt-outs, per mail day."""
    cohort = first_mail_cohort_daily(first_mail)
    outs = optout_after_mail_daily(days, latest, first_mail, params)
    return cohort.join(F.broadcast(outs), cohort.partition_date2 == outs.partition_date, "left").select(
        "partition_date2", "total_email", F.col("c_opt_outs").alias("total_opt_out")
    )
