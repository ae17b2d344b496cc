"""State carried from one range of snapshot days to the next.

A run over a range of days needs, of all days before it, only each account's last row (its flag is the predecessor
of the account's first row in the range) and the stock of the last listed day.  Both are kept per day up to which they
hold, as Parquet partitioned by ``as_of``, and advance by the rows of a range alone: old days are not read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators.transitions import stock_daily


def history_state(days: DataFrame) -> DataFrame:
    """(account_id, partition_date, pref_flag): each account's last row of a day grain (``history.history_days``)."""
    last = F.max(F.struct("partition_date", "row_key", F.struct("pref_flag").alias("f"))).alias("s")
    return days.groupBy("account_id").agg(last).select("account_id", "s.partition_date", F.col("s.f.pref_flag").alias("pref_flag"))


def advance_state(state: DataFrame, days: DataFrame) -> DataFrame:
    """The state after the rows of the next range; accounts without a row there keep theirs."""
    both = state.withColumn("row_key", F.lit(0).cast("bigint")).unionByName(
        days.select("account_id", "partition_date", "pref_flag", "row_key")
    )
    return history_state(both)


def stock_state(days: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The last listed day and its stock (one row, or none), of ``days`` or else of ``before``."""
    stock = stock_daily(days)
    if before is not None:
        stock = stock.unionByName(before.select("stock_day", "stock"))
    return stock.agg(F.max(F.struct("stock_day", "stock")).alias("s")).where("s IS NOT NULL").select("s.*")


class StateStore:
    """States below one path, a folder per kind and day up to which they hold (yyyymmdd)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, kind: str, as_of: int, rows: DataFrame) -> None:
        """Store a state; written again, it is replaced, and the states of other days stay."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{kind}/as_of={int(as_of)}")

    def read(self, kind: str, as_of: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{kind}/as_of={int(as_of)}")

    def save(self, as_of: int, days: DataFrame, since: int | None = None) -> None:
        """Store the states after ``days``; ``since`` names the stored states from which they go on."""
        if since is None:
            self.write("history", as_of, history_state(days))
            self.write("stock", as_of, stock_state(days))
        else:
            self.write("history", as_of, advance_state(self.read("history", since), days))
            self.write("stock", as_of, stock_state(days, self.read("stock", since)))
