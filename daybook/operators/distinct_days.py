"""Exact distinct counts per day that can be kept, appended and merged.

A day's ids are bitmaps: one row per (day, bucket of 32,768 consecutive ids).  Bitmaps of the same day and bucket merge by
``or``, so counts over new days, late rows or several days together (a week, a month) come from the stored bitmaps
alone.  Ids are bigints from dense ranges, as keys are; an id alone in its bucket costs a whole bitmap of 4 KB, so spread ids
(hashes) belong in ``count(DISTINCT)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_bitmaps(rows: DataFrame, day: str, id_col: str) -> DataFrame:
    """(day, bucket, bits) of the ids of each day; rows with a null id are left out."""
    ids = rows.where(F.col(id_col).isNotNull()).select(day, F.col(id_col).cast("bigint").alias("id"))
    return ids.groupBy(day, F.bitmap_bucket_number("id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits")
    )


def merge_bitmaps(old: DataFrame, new: DataFrame, day: str) -> DataFrame:
    """Bitmaps of both, one per (day, bucket)."""
    return old.unionByName(new).groupBy(day, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_daily(bitmaps: DataFrame, day: str, name: str) -> DataFrame:
    """Distinct ids per day; buckets hold different ids, so their counts add up."""
    return bitmaps.groupBy(day).agg(F.sum(F.bitmap_count("bits")).alias(name))
