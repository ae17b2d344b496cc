"""Presence of accounts as runs of consecutive kept days.

A run is (account, first day, last day): an account that stays is one row, however many days it stays.  An account
delinks on the kept day after a run's last day.  Runs of neighbouring ranges of days merge where one ends on the day before
the other begins, so stored runs grow by the new days' runs and old days are not read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(kept: DataFrame) -> DataFrame:
    """(day, place): the kept calendar days numbered from 0 (one row per day).

    Joins send it to every task: days are few, and as keys of a shuffle they would gather each day's accounts in one task.
    """
    return kept.select(F.col("cal_date").alias("day"), (F.row_number().over(Window.orderBy("cal_date")) - 1).alias("place"))


def presence_runs(days: DataFrame, kept: DataFrame) -> DataFrame:
    """(account_id, first_place, last_place) of the rows of ``days`` (account_id, partition_date) on kept days.

    A null account is never the same account on another day and has no runs.  An account's days, one row
    each, are numbered in order; within a run their distance to the calendar's numbers stays the same.
    """
    seen = days.filter(F.col("account_id").isNotNull()).select("account_id", F.col("partition_date").alias("day")).distinct()
    own = Window.partitionBy("account_id").orderBy("place")
    placed = seen.join(F.broadcast(numbered(kept)), "day").select("account_id", "place")
    return (
        placed.withColumn("run", F.col("place") - F.row_number().over(own))
        .groupBy("account_id", "run")
        .agg(F.min("place").alias("first_place"), F.max("place").alias("last_place"))
        .drop("run")
    )


def merge_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Runs of two sets of days as the runs of their union; runs that meet or overlap become one."""
    own = Window.partitionBy("account_id").orderBy("first_place", "last_place")
    earlier = own.rowsBetween(Window.unboundedPreceding, -1)
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = old.unionByName(new).withColumn("reach", F.max("last_place").over(earlier))
    starts = F.when(F.col("reach").isNull() | (F.col("reach") + 1 < F.col("first_place")), 1).otherwise(0)
    return (
        both.withColumn("starts", starts)
        .withColumn("run", F.sum("starts").over(so_far))
        .groupBy("account_id", "run")
        .agg(F.min("first_place").alias("first_place"), F.max("last_place").alias("last_place"))
        .drop("run")
    )


def run_ends_daily(runs: DataFrame, kept: DataFrame) -> DataFrame:
    """Per kept day the accounts whose run ended on the kept day before (``delinks``, null if none)."""
    calendar = numbered(kept)
    ends = runs.groupBy((F.col("last_place") + 1).alias("place")).agg(F.count(F.lit(1)).alias("delinks"))
    return calendar.join(ends, "place", "left").select(F.col("day").alias("delink_date"), "delinks")
