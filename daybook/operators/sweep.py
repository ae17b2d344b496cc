"""Which intervals cover which points, as a sweep over each key's days instead of a range join.

The starts of a key's intervals and its points stand in one order by day; a point belongs to the last start before it, if that
interval has not ended.  Days are cut into blocks, so that the sweep's window holds one (key, block): the last start
of earlier blocks is carried in as a row at the block's begin, found over one row per (key, block).  Nothing is
compared by a range condition of a join, and a hot key is spread over its blocks.

That holds for intervals that no earlier interval of their key reaches into, which is every one where the next event
ends an interval.  The others (overlaps, copies with another end) go into the lists of the blocks they touch, and a
point picks from its block's list; where there are none, that branch is empty and adaptive execution drops it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Days in a block.
WIDTH = 64


def cover(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, end: str, width: int = WIDTH) -> DataFrame:
    """The rows of ``points``, one per interval that covers them, with that interval's ``start`` and ``end``.

    ``points`` has at most one row per (key, at); ``at``, ``start`` and ``end`` are integer days, both ends inclusive.
    Intervals are told apart by (key, start, end) alone; null keys, starts and points, and intervals that
    end before they start, cover nothing.
    """
    clean = intervals.where(F.col(key).isNotNull() & (F.col(start) <= F.col(end))).select(key, start, end).distinct()
    earlier = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    marked = clean.withColumn("__far", F.max(end).over(earlier))
    apart = marked.where(F.col("__far").isNull() | (F.col("__far") < F.col(start))).drop("__far")
    others = marked.where(F.col("__far") >= F.col(start)).drop("__far")
    own = points.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    return _sweep(own, apart, key, at, start, end, width).unionByName(_lists(own, others, key, at, start, end, width))


def _block(day, width: int):
    return F.floor(day / F.lit(width)).cast("long")


def _sweep(points: DataFrame, apart: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    opened = F.struct(F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    nothing = F.lit(None).cast("struct<s:bigint,e:bigint>")
    rest = F.struct(*[F.col(c) for c in points.columns])
    seen = points.select(key, F.col(at).cast("long").alias("__at"), F.lit(2).alias("__kind"), nothing.alias("__open"), rest.alias("__row"))
    begun = apart.select(
        key, F.col(start).cast("long").alias("__at"), F.lit(1).alias("__kind"), opened.alias("__open"),
        F.lit(None).cast(seen.schema["__row"].dataType).alias("__row"),
    )
    by_day = seen.unionByName(begun).withColumn("__block", _block(F.col("__at"), width))
    # one row per (key, block): its last start, and whether it has points
    blocks = by_day.groupBy(key, "__block").agg(F.max("__open").alias("__last"), F.max("__kind").alias("__has"))
    before = Window.partitionBy(key).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocks.withColumn("__open", F.last("__last", ignorenulls=True).over(before))
        .where("__open IS NOT NULL AND __has = 2")
        .select(
            key, (F.col("__block") * width).alias("__at"), F.lit(0).alias("__kind"), "__open",
            F.lit(None).cast(seen.schema["__row"].dataType).alias("__row"), "__block",
        )
    )
    along = Window.partitionBy(key, "__block").orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = by_day.unionByName(carried).withColumn("__now", F.last("__open", ignorenulls=True).over(along))
    return swept.where("__kind = 2 AND __now.e >= __at").select(
        "__row.*", *[F.col(f"__now.{f}").cast(apart.schema[c].dataType).alias(c) for f, c in (("s", start), ("e", end))]
    )


def _lists(points: DataFrame, others: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    reach = points.groupBy(key).agg(F.min(at).alias("__first"), F.max(at).alias("__final"))
    low, high = F.greatest(start, "__first"), F.least(end, "__final")
    touched = F.when(low <= high, F.sequence(_block(low, width), _block(high, width)))
    lists = (
        others.join(reach, key)
        .select(key, start, end, F.explode(touched).alias("__block"))
        .groupBy(key, "__block")
        .agg(F.collect_list(F.struct(start, end)).alias("__all"))
    )
    covers = F.filter("__all", lambda x: (x[start] <= F.col(at)) & (x[end] >= F.col(at)))
    met = points.withColumn("__block", _block(F.col(at), width)).join(lists, [key, "__block"])
    return met.select(*points.columns, F.explode(covers).alias("__one")).select(*points.columns, f"__one.{start}", f"__one.{end}")
