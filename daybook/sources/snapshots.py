"""Readers for day-partitioned snapshot tables and event logs.

A snapshot family is stored as Parquet partitioned by an integer
``partition_day`` (yyyymmdd).  Filtering on the typed partition column (never
on a cast of it) lets Spark prune partitions at planning time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A snapshot family as it is stored.
SNAPSHOT_SCHEMA = (
    "account_id bigint, pref_flag boolean, "
    "device_data array<struct<device_id:bigint,time_linked_with_user_ms:bigint>>, partition_day bigint"
)
#: An event log as it is stored.
LOG_SCHEMA = "message_id bigint, campaign_id bigint, account_id bigint, t_us bigint, partition_day bigint"


def read_snapshots(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All daily partitions; ``partition_day`` is exposed as a column.  With a ``schema`` no file is opened to plan."""
    reader = spark.read.option("basePath", path)
    return (reader.schema(schema) if schema else reader).parquet(path)


def snapshot_devices(snapshots: DataFrame) -> DataFrame:
    """(account_id, partition_day, device_id), one row per link; of the nested records only ``device_id`` is read."""
    return snapshots.select("account_id", "partition_day", F.explode("device_data.device_id").alias("device_id"))


def link_counts(snapshots: DataFrame) -> DataFrame:
    """Snapshot rows with their number of links, counted on one field of the nested records."""
    return snapshots.select("account_id", "pref_flag", "partition_day", F.size("device_data.device_id").alias("n_links"))


def latest_snapshot(snapshots: DataFrame, latest_day: int) -> DataFrame:
    """The newest partition, named explicitly (pruned to one directory)."""
    return snapshots.filter(F.col("partition_day") == F.lit(int(latest_day)))


def snapshot_range(snapshots: DataFrame, first_day: int, last_day: int | None = None) -> DataFrame:
    """Partitions ``first_day <= partition_day [<= last_day]``."""
    cond = F.col("partition_day") >= F.lit(int(first_day))
    if last_day is not None:
        cond = cond & (F.col("partition_day") <= F.lit(int(last_day)))
    return snapshots.filter(cond)


def write_snapshots(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a snapshot family partitioned by ``partition_day``.

    Rows are rebalanced by day: a small day becomes one file, and a day above the advisory size is split over tasks.
    """
    df.hint("rebalance", "partition_day").write.mode(mode).partitionBy("partition_day").parquet(path)


def replace_days(df: DataFrame, path: str) -> None:
    """Write the days that ``df`` holds and leave the others; a day that is delivered again replaces its old rows."""
    out = df.hint("rebalance", "partition_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("partition_day").parquet(path)
