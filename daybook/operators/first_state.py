"""Stored first events: per (campaign, message) its earliest time, kept up to date as days arrive.

The table is partitioned by the UTC day of the first event.  An arriving day's rows are reduced to one per message and
compared with the stored ones; only messages that are new or now earlier change, and only the partitions that they enter or
leave are written again, by dynamic partition overwrite.  A message that a late row makes earlier moves to its
new day.  A partition that loses its last message keeps a marker row, so that it too is overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.operators.engagement import daily_distinct_messages, first_events
from daybook.params import DEFAULT, Params
from daybook.session import checkpointed

SCHEMA = "campaign_id bigint, message_id bigint, t_us bigint, marker boolean, first_day int"
_DAY_US = 86_400_000_000


def _dated(events: DataFrame) -> DataFrame:
    return events.withColumns({"marker": F.lit(False), "first_day": F.floor(F.col("t_us") / F.lit(_DAY_US)).cast("int")})


class FirstEvents:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(self.path)

    def read(self) -> DataFrame:
        """(campaign_id, message_id, t_us), one row per message of a campaign."""
        return self._stored().where("NOT marker").select("campaign_id", "message_id", "t_us")

    def create(self, log: DataFrame) -> None:
        """Start with the first events of ``log`` (campaign_id, message_id, t_us)."""
        first = _dated(first_events(log.where("t_us IS NOT NULL")))
        first.hint("rebalance", "first_day").write.partitionBy("first_day").mode("overwrite").parquet(self.path)

    def arrive(self, log: DataFrame) -> None:
        """Take in more rows of the log, of any days, late or repeated ones included."""
        new = _dated(first_events(log.where("t_us IS NOT NULL")))
        old = self._stored().where("NOT marker")
        names = ["campaign_id", "message_id"]
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in names]
        met = new.alias("n").join(old.alias("o"), same, "left")
        earlier = F.col("o.t_us").isNull() | (F.col("n.t_us") < F.col("o.t_us"))
        changes = checkpointed(met.where(earlier).select("n.*", F.col("o.first_day").alias("left_day")))
        days = changes.select("first_day").union(changes.select("left_day")).where("first_day IS NOT NULL").distinct()
        days = checkpointed(days)  # one row per day
        if days.isEmpty():
            return
        gone = changes.where("left_day IS NOT NULL").select(*names, F.col("left_day").alias("first_day"))
        stay = old.join(days, "first_day", "left_semi").alias("o").join(
            gone.alias("g"), [F.col(f"o.{c}").eqNullSafe(F.col(f"g.{c}")) for c in [*names, "first_day"]], "left_anti"
        )
        none = F.lit(None).cast("bigint")
        marks = days.select(none.alias("campaign_id"), none.alias("message_id"), none.alias("t_us"), F.lit(True).alias("marker"), "first_day")
        cols = [*names, "t_us", "marker", "first_day"]
        # cut from the files that are about to be replaced
        whole = checkpointed(stay.select(*cols).unionByName(changes.select(*cols)).unionByName(marks))
        out = whole.hint("rebalance", "first_day").write.partitionBy("first_day").mode("overwrite")
        out.option("partitionOverwriteMode", "dynamic").parquet(self.path)

    def opens_daily(self, params: Params = DEFAULT) -> DataFrame:
        """As ``engagement.opens_first_daily`` over all rows taken in."""
        return daily_distinct_messages(self.read(), params, "open_day", "emails_opened")
