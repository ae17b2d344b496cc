"""Merkle dataset manifest with octopus multiproofs.

Tree.  A leaf is the SHA-256 (lower-case hex, as is every digest) of a row's fields: ``-`` for null, else the byte count, a colon and
the value.  Per group the leaves ascend by id; every ``FAN`` consecutive nodes of a level, the last run fewer, are hashed together
until one is left, the group's subroot.  The subroots, ordered by group, give the root the same way.

Manifest.  Leaves get their place in the group by a range partitioning and the counts before each partition.  Aligned
blocks of ``FAN ** BLOCK_LEVELS`` leaves are the leaf partitions: each yields the one node that stands for it, and the levels above are
built from these, level by level.

Octopus multiproof.  A leaf partition knows its own leaves.  From the shape of the tree alone it computes the minimal union of the
coordinates (tree, level, place) that the proofs of all its leaves need and that it cannot derive itself; these are fetched
once, in one join for all partitions; the interiors that its leaves share are derived once, from below; and
each leaf's own proof is expanded from them locally.  Verification folds a leaf's hash with its proof up to the root.

Scale: texts never move, only digests do.  A block has at most 512 leaves, whatever the size of its group; a node
that many blocks ask for is joined by ``hot_join``; a run has at most 8 nodes.  The number of rounds is the height of the tree.

Results for odd input: a null field is ``-`` in the leaf; rows with a null group are a group of their own and come first;
a null id comes first in its group; equal ids are ordered by their leaf, and equal rows keep a leaf each; a group of one
leaf has that leaf as its subroot, and one group's subroot is the root; an empty table has no root and gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from daybook.llm.common import cut, hot_join

FAN = 8
BLOCK_LEVELS = 3
BLOCK = FAN**BLOCK_LEVELS
#: The tree over the subroots; trees of groups are called "" (null) and "+" and the group.
TOP = "^"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_hash(fields: list[Column]) -> Column:
    """The hash of a row's fields, each self-delimiting."""
    each = [
        F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields
    ]
    return F.sha2(F.concat(*each), 256)


def digest(raw: bytes) -> bytes:
    return hashlib.sha256(raw).hexdigest().encode()


def runs_above(nodes: list[bytes]) -> list[bytes]:
    """The level above a list of consecutive nodes that starts at a run's start."""
    return [digest(b"".join(nodes[k : k + FAN])) for k in range(0, len(nodes), FAN)]


def missing_coordinates(low: int, high: int, size: int) -> list[tuple[int, int]]:
    """(level, place) of the nodes that proofs of the leaves low to high - 1 of ``size`` need and these leaves do not give."""
    out, level = [], 0
    while size > 1:
        first, last = low // FAN * FAN, min(-(-high // FAN) * FAN, size)
        out += [(level, k) for k in (*range(first, low), *range(high, last))]
        low, high, size, level = low // FAN, -(-high // FAN), -(-size // FAN), level + 1
    return out


def climb(low: int, known: list[bytes], size: int, fetched: dict[tuple[int, int], bytes]) -> tuple[list[tuple[int, list[bytes]]], bytes]:
    """([(first place, nodes)] per level below the top, as far as the proofs reach, and the top node)."""
    levels, level = [], 0
    while size > 1:
        high = low + len(known)
        first, last = low // FAN * FAN, min(-(-high // FAN) * FAN, size)
        nodes = [fetched[(level, k)] for k in range(first, low)] + known + [fetched[(level, k)] for k in range(high, last)]
        levels.append((first, nodes))
        low, known, size, level = first // FAN, runs_above(nodes), -(-size // FAN), level + 1
    return levels, known[0]


def sides(levels: list[tuple[int, list[bytes]]], place: int) -> list[tuple[bytes, bytes]]:
    """(siblings to the left, siblings to the right), level by level from the leaf at ``place``."""
    out = []
    for first, nodes in levels:
        run = place // FAN * FAN - first
        own = place - first
        out.append((b"".join(nodes[run:own]), b"".join(nodes[own + 1 : run + FAN])))
        place //= FAN
    return out


def fold(leaf: bytes, proof: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf has with these siblings."""
    for left, right in proof:
        leaf = digest(left + leaf + right)
    return leaf


@dataclass
class Manifest:
    """``leaves``: tree, place, size (leaves of the tree), and the rows' own columns; ``nodes``: tree, level, place, digest from the blocks' level
    up; ``trees``: tree, rank, size, subroot; ``root`` (None for an empty table) and the number of groups."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: str | None
    groups: int


def ranked(rows: DataFrame, group: str, order: list[str], place: str, size: str | None = None) -> DataFrame:
    """Add each row's place within its group, from 0, and the group's size, without gathering a group."""
    # the row number deals equal rows to several partitions
    tied = cut(rows.withColumn("_tie", F.monotonically_increasing_id()))
    by = [group, *order, "_tie"]
    laid = cut(tied.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    laid = laid.withColumn("_p", F.shiftright("_at", 33))
    counts = laid.groupBy(group, "_p").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # one row per group and partition
    own = Window.partitionBy(group)
    before = F.sum("_n").over(own.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(
        group, "_p", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("_size")
    )
    out = laid.join(cut(starts), [group, "_p"]).withColumn(place, F.col("_at") + F.col("_shift"))
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_tie", "_at", "_p", "_shift", "_size")


def _levels(nodes: DataFrame, level: int, largest: int) -> tuple[DataFrame, DataFrame]:
    """(all nodes from ``level`` up as tree, level, place, digest; the top node of each tree): input tree, place, width, digest."""
    all_nodes, tops, now = None, None, cut(nodes)
    while True:
        shown = now.select("tree", F.lit(level).alias("level"), "place", "digest")
        top = now.where("width <= 1").select("tree", "digest")
        all_nodes = shown if all_nodes is None else all_nodes.unionByName(shown)
        tops = top if tops is None else tops.unionByName(top)
        if largest <= 1:
            return all_nodes, tops
        run = F.sort_array(F.collect_list(F.struct("place", "digest")))  # FAN nodes at most
        above = now.where("width > 1").groupBy("tree", F.expr(f"place div {FAN}").alias("place")).agg(
            F.max("width").alias("width"), run.alias("run")
        )
        now = cut(
            above.select(
                "tree", "place", F.ceil(F.col("width") / FAN).cast("long").alias("width"),
                F.sha2(F.array_join(F.col("run.digest"), ""), 256).alias("digest"),
            )
        )
        level, largest = level + 1, -(-largest // FAN)


def _block_node(table: pa.Table) -> pa.Table:
    """The node that stands for a block: its leaves hashed up to the block's level, or to the top of a smaller tree."""
    table = table.sort_by("place")
    size = table.column("size")[0].as_py()
    nodes, width = [x.encode() for x in table.column("leaf").to_pylist()], size
    for _ in range(BLOCK_LEVELS):
        if width > 1:
            nodes, width = runs_above(nodes), -(-width // FAN)
    block = table.column("block")[0].as_py()
    return pa.table({"tree": [table.column("tree")[0].as_py()], "place": [block], "width": [width], "digest": [nodes[0].decode()]})


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: list[str] = FIELDS, more: dict[str, Column] | None = None) -> Manifest:
    """The tree over all rows.  ``more``: columns to carry beside the leaf, from the columns of ``docs``."""
    src = docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit("")).alias("tree"),
        F.col(id_col).alias("id"),
        leaf_hash([F.col(c) for c in fields]).alias("leaf"),
        *[c.alias(name) for name, c in (more or {}).items()],
    )
    leaves = cut(ranked(src, "tree", ["id", "leaf"], "place", "size").withColumn("block", F.expr(f"place div {BLOCK}")))
    largest = leaves.agg(F.max("size")).first()[0]
    blocks = leaves.select("tree", "place", "size", "block", "leaf").groupBy("tree", "block").applyInArrow(
        _block_node, "tree string, place long, width long, digest string"
    )
    nodes, tops = _levels(blocks, BLOCK_LEVELS, -(-(largest or 0) // BLOCK))
    sizes = leaves.groupBy("tree").agg(F.max("size").alias("size"))
    one = tops.withColumnRenamed("digest", "subroot").withColumn("all", F.lit(TOP))
    subroots = cut(ranked(one, "all", ["tree"], "rank", "groups"))
    groups = subroots.count()
    upper, top = _levels(
        subroots.select(F.lit(TOP).alias("tree"), F.col("rank").alias("place"), F.col("groups").alias("width"), F.col("subroot").alias("digest")),
        0,
        groups,
    )
    root = top.first()
    trees = subroots.join(sizes, "tree").select("tree", "rank", "size", "subroot")
    return Manifest(leaves, nodes.unionByName(upper), trees, root["digest"] if root else None, groups)


def prove(m: Manifest, changed: str = "leaf") -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf.

    ``changed`` names a column of the leaves with the hash that is folded with the leaf's own proof.
    """
    groups, root = m.groups, m.root
    id_type = m.leaves.schema["id"].dataType
    asks = m.leaves.select("tree", "block", "size").distinct().join(m.trees.select("tree", "rank"), "tree")

    def coordinates(batches):
        for b in batches:
            rows = []
            for tree, block, size, rank in zip(*(b.column(c).to_pylist() for c in ("tree", "block", "size", "rank"))):
                high = min(size, (block + 1) * BLOCK)
                rows += [(tree, block, tree, *at) for at in missing_coordinates(block * BLOCK, high, size)]
                rows += [(tree, block, TOP, *at) for at in missing_coordinates(rank, rank + 1, groups)]
                rows.append((tree, block, None, -1, rank))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64()]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)], names=["by", "block", "tree", "level", "place"]
            )

    wanted = cut(asks.mapInArrow(coordinates, "by string, block long, tree string, level int, place long"))
    fetched = hot_join(wanted.where("tree IS NOT NULL"), cut(m.nodes), ["tree", "level", "place"])
    # the block's own line names the rank of its group
    own = wanted.where("tree IS NULL").withColumn("digest", F.lit(None).cast("string"))
    fetched = fetched.select("by", "block", "tree", "level", "place", "digest").unionByName(own)

    from pyspark.sql.pandas.types import to_arrow_type

    id_kind = to_arrow_type(id_type)
    out_names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def expand(leaves: pa.Table, nodes: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("place")
        rank, below, above = 0, {}, {}
        for tree, level, place, x in zip(*(nodes.column(c).to_pylist() for c in ("tree", "level", "place", "digest"))):
            if tree is None:
                rank = place
            else:
                (above if tree == TOP else below)[(level, place)] = x.encode()
        places, hashes, folded = (leaves.column(c).to_pylist() for c in ("place", "leaf", "changed"))
        levels, subroot = climb(places[0], [h.encode() for h in hashes], leaves.column("size")[0].as_py(), below)
        upper, _ = climb(rank, [subroot], groups, above)
        ends = sides(upper, rank)
        # all leaves of a run share their proof from the next level on
        shared: dict[int, tuple[list, bytes]] = {}
        proofs, roots = [], []
        for place, h in zip(places, folded):
            run = place // FAN
            if run not in shared:
                rest = sides([(first, nodes_) for first, nodes_ in levels[1:]], run) + ends
                shared[run] = rest, b"".join(a + z for a, z in rest)
            rest, tail = shared[run]
            start = sides(levels[:1], place)
            proofs.append(hashlib.sha256(b"".join(a + z for a, z in start) + tail).hexdigest())
            roots.append(fold(h.encode(), start + rest).decode())
        n = len(places)
        cols = [
            leaves.column("id").cast(id_kind),
            pa.array(hashes, pa.string()),
            pa.array([subroot.decode()] * n, pa.string()),
            pa.array([root] * n, pa.string()),
            pa.array(proofs, pa.string()),
            pa.array(roots, pa.string()),
            pa.array([r == root for r in roots], pa.bool_()),
        ]
        return pa.Table.from_arrays(cols, names=out_names)

    left = m.leaves.select("tree", "block", "place", "size", "id", "leaf", F.col(changed).alias("changed"))
    return (
        left.groupBy("tree", "block")
        .cogroup(fetched.groupBy("by", "block"))
        .applyInArrow(
            expand,
            f"id {id_type.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
        )
    )


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audit_tampering(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", modulus: int = 3) -> DataFrame:
    """Proofs of all rows, folded with the hash of the row as it would be after tampering: where ``modulus`` divides the crc32 of
    the id as text (a null id: of the empty text), the text's A-Z are lowered."""
    fields = [F.col({"text": text_col, "doc_id": id_col, "lang": group_col}.get(c, c)) for c in FIELDS]
    hit = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus == 0
    after = [lower_ascii(c) if name == "text" else c for name, c in zip(FIELDS, fields)]
    names = [{"text": text_col, "doc_id": id_col, "lang": group_col}.get(c, c) for c in FIELDS]
    tampered = F.when(hit, leaf_hash(after)).otherwise(leaf_hash(fields))
    m = manifest(docs, id_col, group_col, names, {"tampered": tampered})
    return prove(m, "tampered").withColumnRenamed("id", id_col)
