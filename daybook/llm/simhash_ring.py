"""SimHash near-duplicates by pigeonring filtering.

Fingerprints: lower-case A-Z, words, shingles of ``shingle`` words, XXH64
(seed 42) of each shingle, and per bit a strict majority vote.

Links: the 64 bits form a ring of ``max_bits + 1`` segments.  If two
fingerprints differ in at most ``max_bits`` bits, some segment starts a chain
whose first l segments differ in at most l * max_bits / segments bits, for
every l.  The chain's first link is a join key: the starting segment must be
equal and one half of the next must be equal too (its budget is one bit).
Pairs that meet under a key must then keep every longer chain within its
budget before the full Hamming check.

Skew: equal fingerprints are one row.  A key that holds more than
``block_rows`` fingerprints is dealt into blocks, and each pair of blocks is a
key of its own, so no task gets the whole key.  Inside a key pairs are only
compared, in vector form; what leaves the task is a forest of links (each
fingerprint to the smallest one linked with it there), never all pairs.

Results for odd input: a null or empty text, or one without words, has the
fingerprint zero and links like any other; repeated rows and equal texts share
their component; a null id never becomes a component id unless the whole
component has null ids only; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import cut
from daybook.llm.components import connected_components

SEED = 42


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit fingerprint of one whole text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:n].tolist()
    stops = (ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]).tolist()
    h64 = xxhash.xxh64_intdigest
    h = np.fromiter((h64(joined[a:b], SEED) for a, b in zip(starts, stops)), dtype="<u8", count=n)
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 1 << 16):
        bits = np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id in its own type, fp as signed long), one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, fp long")


def ring_segments(max_bits: int) -> list[tuple[int, int]]:
    """(first bit, width) of the max_bits + 1 segments of the 64 bits."""
    m = max_bits + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _ring_keys(max_bits: int) -> list[list[tuple[int, int]]]:
    """Per key the bit ranges that must be equal."""
    seg = ring_segments(max_bits)
    m = len(seg)
    keys = []
    for i in range(m):
        first, (at, width) = seg[i], seg[(i + 1) % m]
        half = width // 2
        keys += [[first, (at, half)], [first, (at + half, width - half)]]
    return keys


def _chain_ok(x: np.ndarray, max_bits: int) -> np.ndarray:
    """Whether some start has every chain of the differences x within its budget."""
    seg = ring_segments(max_bits)
    m = len(seg)
    d = [np.bitwise_count((x >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in seg]
    ok = np.zeros(len(x), dtype=bool)
    for i in range(m):
        total, fits = np.zeros(len(x), dtype=np.int64), np.ones(len(x), dtype=bool)
        for n in range(1, m + 1):
            total = total + d[(i + n - 1) % m]
            fits &= total * m <= n * max_bits
        ok |= fits
    return ok


def _forest(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that connect what the pairs connect, at most one per node."""
    u, v = (np.concatenate(x) for x in zip(*pairs))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all() and (root[a] == root[b]).all():
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _link_sorted(max_bits: int, flush_pairs: int = 1_000_000):
    def links(key: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows are sorted by key; rows d apart with one key are compared for d = 1, 2, ..."""
        at, d, found, held = np.arange(len(fp)), 1, [], 0
        while True:
            at = at[at + d < len(fp)]
            at = at[key[at] == key[at + d]]
            if not len(at):
                break
            x = fp[at] ^ fp[at + d]
            hit = at[_chain_ok(x, max_bits) & (np.bitwise_count(x) <= max_bits) & (x != 0)]
            if len(hit):
                found.append((fp[hit], fp[hit + d]))
                held += len(hit)
            if held > flush_pairs:
                found, held = [_forest(found)], 0
            d += 1
        if found:
            yield _forest(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_f = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)

        def out(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            for u, v in links(k, f):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for b in batches:
            k = np.concatenate([rest_k, b.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([rest_f, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            done = int(np.searchsorted(k, k[-1])) if len(k) else 0
            if done:
                yield from out(k[:done], f[:done])
            rest_k, rest_f = k[done:], f[done:]
        yield from out(rest_k, rest_f)

    return run


def fingerprint_links(fps: DataFrame, max_bits: int = 4, block_rows: int = 1024) -> DataFrame:
    """Links (u, v) of distinct fingerprints (column fp) that span the exact components at <= max_bits bits."""
    bits = lambda c, a, w: F.shiftrightunsigned(c, a).bitwiseAND(F.lit((1 << w) - 1))
    keys = []
    for i, ranges in enumerate(_ring_keys(max_bits)):
        part = F.lit(i).cast("long")
        for a, w in ranges:
            part = F.shiftleft(part, w).bitwiseOR(bits(F.col("fp"), a, w))
        keys.append(part)
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = rows.groupBy("key").count().where("count > 1")
    held = rows.join(sizes, "key").withColumn("nb", F.ceil(F.col("count") / block_rows).cast("int"))
    mine = F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")
    # one block: the key itself; else the key of each pair of blocks this row's block is in
    meets = held.select(
        "key", "fp", "nb", mine.alias("b"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other")
    ).select(
        F.when(F.col("nb") == 1, F.col("key"))
        .otherwise(F.xxhash64("key", F.least("b", "other"), F.greatest("b", "other")))
        .alias("key"),
        "fp",
    )
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = meets.repartition(n, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_link_sorted(max_bits), "u long, v long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4
) -> DataFrame:
    """(id_col, fingerprint, component_id), one row per row of ``docs``."""
    if not 1 <= max_bits <= 15:
        raise ValueError("max_bits must be 1 to 15")
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("low")))
    comp = connected_components(fingerprint_links(nodes.select("fp"), max_bits))
    named = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("c")
    )
    lowest = named.groupBy("c").agg(F.min("low").alias("component_id"))
    of_fp = named.join(lowest, "c").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
