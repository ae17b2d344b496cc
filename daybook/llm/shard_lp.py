"""Sharding by balanced label propagation.

Links: equal texts.  Every row starts in a shard by hash.  In each round a
group of linked rows tells its members the shard where most of them are (the
group is the hub of its links, so no pairs are made), members ask to move
there, and a shard accepts movers up to its quota.  Movers are accepted in
whole buckets of groups, so groups move together; a group larger than half a
quota takes part as several groups.  A shard that had to
refuse movers is not asked again.  Linked rows move first; then counts are made
exact: shards above their share give up unlinked rows first, shards below it
take them, so sizes end at most one row apart and few links are cut.

Scale: rows are ranked inside (shard, bucket) and buckets are ranked by their
counts, so no task sees a whole shard and only per-bucket counts are gathered
in a window.  Work is on a checkpointed table without the texts.

Results for odd input: a null text has size 8, crc32 0 and is linked with nothing; empty texts are linked with
each other; null ids and repeated rows are placed row by row; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.common import cut

ROWS_PER_BUCKET = 4000


def _ranked(df: DataFrame, by: str, first: Column, buckets: int, out: str) -> DataFrame:
    """Adds ``out``: the place of the row among rows of its ``by``, gapless from 0; rows with smaller ``first`` (an int) lead."""
    b = df.withColumn("_f", first).withColumn("_b", F.pmod(F.xxhash64("rid"), F.lit(buckets)))
    sizes = b.groupBy(by, "_f", "_b").agg(F.count("*").alias("_n"))
    lead = Window.partitionBy(by).orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(by, "_f", "_b", F.coalesce(F.sum("_n").over(lead), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(by, "_f", "_b").orderBy("rid")
    numbered = b.withColumn("_r", F.row_number().over(inside) - 1)
    return numbered.join(offsets, [by, "_f", "_b"]).withColumn(out, F.col("_o") + F.col("_r")).drop("_f", "_b", "_o", "_r")


def _round(rows: DataFrame, shards: int, quota: int, buckets: int, closed: set[int]) -> DataFrame:
    """One round of propagation: the rows after the accepted moves.  ``closed`` gets the shards that had to refuse some."""
    linked = rows.where("links > 0")
    votes = linked.groupBy("gid", "shard").agg(F.count("*").alias("n"), F.first("links").alias("links"))
    # groups that are together hold their places; a shard that has refused movers is not asked again
    open_ = [s for s in range(shards) if s not in closed] or list(range(shards))
    together = F.col("n") == F.col("links") + 1
    rank = F.struct(F.col("shard").isin(open_) | together, "n", F.xxhash64("gid", "shard").alias("tie"))
    some = F.get(F.array(*[F.lit(s) for s in open_]), F.pmod(F.xxhash64("gid"), F.lit(len(open_))).cast("int"))
    wish = (
        votes.groupBy("gid")
        .agg(F.max_by("shard", rank).alias("best"), F.max(rank)["col1"].alias("fits"))
        .select("gid", F.when(F.col("fits"), F.col("best")).otherwise(some).alias("to"))
    )
    asked = rows.join(wish, "gid", "left").withColumn("bucket", F.pmod(F.xxhash64("gid"), F.lit(buckets)))
    moves = asked.where("to IS NOT NULL AND to <> shard")
    # unlinked rows make room later, so only linked rows at the place they wish for take up quota
    settled = asked.where("to = shard").groupBy("shard").agg(F.count("*").alias("settled"))
    demand = moves.groupBy("to", "bucket").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("to").orderBy("bucket")
    # one row per shard and bucket
    judged = cut(
        demand.withColumn("upto", F.sum("n").over(upto))
        .join(settled.withColumnRenamed("shard", "to"), "to", "left")
        .select("to", "bucket", (F.col("upto") + F.coalesce("settled", F.lit(0)) <= quota).alias("ok"))
    )
    closed.update(r[0] for r in judged.where("NOT ok").select("to").distinct().collect())
    accepted = judged.where("ok")
    return (
        asked.join(accepted, ["to", "bucket"], "left")
        .withColumn("shard", F.when(F.col("ok") & F.col("to").isNotNull(), F.col("to")).otherwise(F.col("shard")))
        .drop("to", "bucket", "ok")
    )


def assign_shards(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", rounds: int = 4
) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot), one row per row; shard counts are at most one apart."""
    t = F.col(text_col).cast("string")
    base = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 8).alias("size"),
        F.coalesce(F.crc32(t), F.lit(0)).cast("long").alias("crc"),
        F.md5(t).alias("text_key"),
    ).withColumn("gid", F.coalesce("text_key", F.concat(F.lit("null"), F.col("rid").cast("string"))))
    rows = cut(base.drop("text_key").withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")))
    total = rows.count()
    buckets = max(1, -(-total // (shards * ROWS_PER_BUCKET)))
    wide = max(64, buckets * 8)
    quota = -(-total // shards)
    sizes = rows.groupBy("gid").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, "gid", "left")
    # a group larger than half a quota takes part as several groups, by hash of the row
    parts = F.ceil(F.col("n") * 2 / quota)
    part = F.concat_ws("-", "gid", F.pmod(F.xxhash64("rid"), parts).cast("string"))
    rows = rows.withColumn("gid", F.when(parts > 1, part).otherwise(F.col("gid"))).drop("n")
    linked = rows.groupBy("gid").agg((F.count("*") - 1).alias("links")).where("links > 0")
    rows = rows.join(linked, "gid", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    closed: set[int] = set()
    for _ in range(rounds):
        rows = cut(_round(rows, shards, quota, wide, closed))
    # exact counts: shard s gets one row more while s < total mod shards
    share = lambda s: F.lit(total // shards) + (s < total % shards).cast("long")
    placed = _ranked(rows, "shard", F.when(F.col("links") > 0, 0).otherwise(1), buckets, "place")
    over = F.col("place") >= share(F.col("shard"))
    placed = cut(placed.withColumn("over", over))
    spare = _ranked(placed.where("over").withColumn("all", F.lit(0)), "all", F.lit(0), buckets * shards, "turn").drop("all")
    counts = dict(placed.where(~F.col("over")).groupBy("shard").count().collect())  # one row per shard
    ends, at = [], 0
    for s in range(shards):
        at += total // shards + (s < total % shards) - counts.get(s, 0)
        ends.append(at)
    # the spare row with turn i goes to the first shard whose free places end after i
    taker = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e <= F.col("turn"))).cast("int")
    moved = spare.withColumn("shard", taker)
    cols = ["rid", "id", "size", "crc", "gid", "links", "shard"]
    final = cut(placed.where(~F.col("over")).select(cols).unionByName(moved.select(cols)))
    out = _ranked(final, "shard", F.lit(0), buckets, "slot")
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("long").alias("slot")
    )
