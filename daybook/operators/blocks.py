"""``lag`` in blocks of the order, so that no task holds a whole hot key.

A plain window gathers every row of its key in one task.  Here the order is cut into blocks by expressions that never
decrease along it: ``lag`` runs inside (key, block), and only the first row of a block takes its value from the
last row of the key's block before.  The blocks' last rows are one row per (key, block); they are chained the same way over
the next, coarser blocks, and at last per key.

Rows with a null key are a key of their own, as in a window.  The order must not leave ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lag_in_blocks(rows: DataFrame, key: list[str], order: list[str], value: str, out: str, blocks: list[list[Column]]) -> DataFrame:
    """``rows`` with ``out``: ``value`` on the key's previous row in ``order``, null on its first.

    ``blocks`` go from fine to coarse: each is a list of expressions over ``rows`` that is monotone in ``order``
    and constant within the finer block before it.
    """
    names = [f"__block{k}" for k in range(len(blocks))]
    # structs are never null themselves, so keys with nulls meet by plain equality, in the window's own partitioning
    cut = rows.withColumn("__key", F.struct(*key)).withColumns(
        {n: F.struct(*[c.alias(f"c{i}") for i, c in enumerate(b)]) for n, b in zip(names, blocks)}
    )
    boxed = cut.withColumn("__box", F.struct(F.col(value).alias("v")))  # a box is null only where there is no row
    return _lag(boxed, order, names).withColumn(out, F.col("__lag.v")).drop("__key", "__box", "__lag", *names)


def _lag(rows: DataFrame, order: list[str], blocks: list[str]) -> DataFrame:
    if not blocks:
        return rows.withColumn("__lag", F.lag("__box").over(Window.partitionBy("__key").orderBy(*order)))
    fine, *coarse = blocks
    w = Window.partitionBy("__key", fine).orderBy(*order)
    inner = rows.withColumn("__lag", F.lag("__box").over(w))
    ends = rows.withColumn("__next", F.lead("__box").over(w)).where("__next IS NULL").select("__key", *blocks, "__box")
    before = _lag(ends, [fine], coarse).select("__key", fine, F.col("__lag").alias("__before"))
    return inner.join(before, ["__key", fine], "left").withColumn("__lag", F.coalesce("__lag", "__before")).drop("__before")
