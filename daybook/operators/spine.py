"""Left-join daily metric blocks onto a calendar spine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spine_join(calendar: DataFrame, blocks: list[tuple[DataFrame, str]], key: str = "cal_date") -> DataFrame:
    """Fold of left joins ``calendar.key = block.day``; each block's day column is dropped.

    Every block is aggregated to one row per day, so its size is bounded by the
    number of calendar days, whatever the size of the data behind it: each is
    broadcast and the spine itself is never shuffled.
    """
    out = calendar
    for block, day in blocks:
        b = block.withColumnRenamed(day, "__day")
        out = out.join(F.broadcast(b), out[key] == b["__day"], "left").drop("__day")
    return out
