"""Token ids in binary shard files with a minimal perfect hash index.

File format: a file holds one shard or several, each followed by a newline; integers are little-endian:

    8 bytes   magic ``DBTOKEN2``
    8 x u64   shard number, documents, distinct keys, ids, displacement buckets, seed, bytes of an id, 1 if without keys
    u32 each  displacement per bucket
    u64 each  key fingerprint per slot
    u32 each  first document per slot
    u64 each  offset in ids of each document, and the end
    u16/u32   the raw ids (16 bits where the vocabulary allows it)

The index is a hash-and-displace minimal perfect hash over the shard's
distinct document keys: a key's bucket gives a displacement, both give its
slot, and the slot's fingerprint tells a stored key from any other.  A lookup
reads one displacement, one slot and two offsets, whatever the shard's size.
Rows with the same key stand together, so the slot names the first of them.

Shards are ranges of the sorted keys, so ids stand in ascending key order
across shards.  A shard closes after ``SHARD_IDS`` ids or when its keys begin, so its bytes are bounded; equal rows are
dealt over several.  Files are written by Spark's text writer (a binary column cast
to string keeps its bytes) and read by its binary-file reader, so any store
that Spark reaches will do.

Directory.  ``shard_directory`` has one row per shard: its file, place in it, and first and last key.  ``lookup`` sends
each asked key to the shards whose range holds it, reads only their files, and finds the key through
the index there; the documents of a key that spans shards are numbered through.

Results for odd input: rows with a null key sort first, stand in shards without keys and read back as null; a null or empty text
is the end id alone; repeated keys keep all their rows, ordered by text within a shard; a key column that is not an integer type is refused;
an empty table writes no shard and reads back empty; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daybook.llm.bpe import WordEncoder, as_u4
from daybook.llm.common import cut
from daybook.session import new_path

MAGIC = b"DBTOKEN2"
FIELDS = 8
HEADER = len(MAGIC) + FIELDS * 8
PER_BUCKET = 4
#: Ids after which a shard closes.
SHARD_IDS = 1 << 25
#: Shards that one pass of a lookup holds in every task (about 40 bytes each).
DIRECTORY_AT_A_TIME = 1 << 20
#: Asked keys that one task looks up in a shard.
ASKED_AT_A_TIME = 1 << 16


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser; x is uint64."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(keys: np.ndarray, displacement: np.ndarray, buckets: int, n: int, seed: int) -> np.ndarray:
    b = (_mix(keys, seed) % np.uint64(buckets)).astype(np.int64)
    shifted = _mix(keys ^ _mix(displacement[b].astype(np.uint64), seed + 1), seed + 2)
    return (shifted % np.uint64(n)).astype(np.int64)


def build_index(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """(displacement per bucket, seed) under which the distinct uint64 keys fill n slots one each."""
    n = len(keys)
    buckets = max(1, -(-n // PER_BUCKET))
    for seed in range(100):
        b = (_mix(keys, seed) % np.uint64(buckets)).astype(np.int64)
        size = np.bincount(b, minlength=buckets)
        order = np.argsort(b, kind="stable")
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        displacement = np.zeros(buckets, dtype=np.uint32)
        free = np.ones(n, dtype=bool)
        tries = np.arange(256, dtype=np.uint64)
        for k in np.argsort(-size, kind="stable"):
            if not size[k]:
                break
            own = keys[order[start[k] : start[k] + size[k]]]
            base = 0
            while base < max(100_000, 64 * n):
                d = tries + np.uint64(base)
                at = (_mix(own[None, :] ^ _mix(d, seed + 1)[:, None], seed + 2) % np.uint64(n)).astype(np.int64)
                good = free[at].all(axis=1)
                for c in np.flatnonzero(good):
                    if len(set(at[c].tolist())) == len(own):
                        free[at[c]] = False
                        displacement[k] = base + c
                        base = -1
                        break
                if base < 0:
                    break
                base += len(tries)
            else:
                break
        else:
            return displacement, seed
        if not free.any():
            return displacement, seed
    raise RuntimeError("no perfect hash found; are the keys distinct?")


def encode_shard(number: int, keys: list[int | None], ids: list[bytes], width: int) -> bytes:
    """One shard's bytes; keys ascend, equal keys stand together, and either all are null or none is."""
    keyless = keys[0] is None
    key = np.zeros(len(keys), dtype=np.uint64) if keyless else np.array(keys, dtype=np.int64).view(np.uint64)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.flatnonzero(new)
    distinct = key[first]
    displacement, seed = build_index(distinct)
    slot = _slots(distinct, displacement, len(displacement), len(distinct), seed)
    prints, firsts = np.zeros(len(distinct), dtype="<u8"), np.zeros(len(distinct), dtype="<u4")
    prints[slot] = distinct
    firsts[slot] = first
    sizes = np.fromiter((len(x) // width for x in ids), dtype=np.int64, count=len(ids))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
    head = np.array([number, len(ids), len(distinct), offsets[-1], len(displacement), seed, width, keyless], dtype="<u8")
    return b"".join(
        [MAGIC, head.tobytes(), displacement.astype("<u4").tobytes(), prints.tobytes(), firsts.tobytes(), offsets.tobytes(), *ids]
    )


class Shard:
    """Keyed access to one shard, which begins at a place of the given bytes."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        if data[at : at + len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        head = np.frombuffer(data, "<u8", FIELDS, at + len(MAGIC))
        self.number, self.docs, self.n, self.n_ids, self.buckets, self.seed, width, keyless = (int(x) for x in head)
        self.keyless = bool(keyless)
        at += HEADER
        parts = []
        for kind, n in (("<u4", self.buckets), ("<u8", self.n), ("<u4", self.n), ("<u8", self.docs + 1), (f"<u{width}", self.n_ids)):
            if len(data) < at + n * np.dtype(kind).itemsize:
                raise ValueError("a token shard shorter than its header says")
            parts.append(np.frombuffer(data, kind, n, at))
            at += parts[-1].nbytes
        self.stop = at
        self.displacement, self.prints, self.firsts, self.offsets, self.ids = parts
        self.starts: np.ndarray | None = None

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Per int64 key its first document in the shard, or -1."""
        k = np.asarray(keys, dtype=np.int64).view(np.uint64)
        if not self.n or self.keyless:
            return np.full(len(k), -1)
        s = _slots(k, self.displacement, self.buckets, self.n, self.seed)
        return np.where(self.prints[s] == k, self.firsts[s].astype(np.int64), -1)

    def in_order(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys, first document, documents), ascending."""
        keys = np.sort(self.prints.view(np.int64))
        first = np.zeros(1, dtype=np.int64) if self.keyless else self.find(keys)
        return keys, first, np.diff(np.concatenate([first, [self.docs]]))

    def stored(self, key: int) -> range:
        """The shard's documents under the key: from its index to where the next key's begin."""
        d = int(self.find(np.array([key]))[0])
        if d < 0:
            return range(0)
        if self.starts is None:
            self.starts = np.sort(self.firsts)
        later = int(np.searchsorted(self.starts, d, "right"))
        return range(d, int(self.starts[later]) if later < self.n else self.docs)

    def ids_of(self, document: int) -> np.ndarray:
        return self.ids[int(self.offsets[document]) : int(self.offsets[document + 1])]

    def get(self, key: int, nth: int = 0) -> np.ndarray | None:
        """The ids of the nth document stored here under the key, None beyond them."""
        own = self.stored(key)
        return self.ids_of(own[nth]) if 0 <= nth < len(own) else None


def shards_of(data: bytes) -> Iterator[tuple[int, Shard]]:
    """(place, shard) of a file's shards."""
    at = 0
    while at < len(data):
        s = Shard(data, at)
        yield at, s
        at = s.stop + 1


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2
) -> None:
    """Write shard files of ranges of keys below ``path``."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"keys are integers; {id_col} is {kind.simpleString()}")
    src = docs.select(
        F.col(id_col).cast("long").alias("key"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"),
        F.monotonically_increasing_id().alias("row"),
    )
    most = SHARD_IDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, keys, ids, held, made = WordEncoder.of(tokenizer), [], [], 0, 0
        end, width = enc.end(end_id), enc.kind.itemsize

        def out() -> pa.RecordBatch:
            number = (TaskContext.get().partitionId() << 24) + made
            return pa.RecordBatch.from_arrays([pa.array([encode_shard(number, keys, ids, width)], pa.binary())], names=["value"])

        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                for key, x in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                    if keys and (held >= most * width or (keys[-1] is None) != (key is None)):
                        yield out()
                        keys, ids, held, made = [], [], 0, made + 1
                    keys.append(key)
                    ids.append(x + end)
                    held += len(x) + width
        if keys:
            yield out()

    # a hot key is spread by its rows; the ranges are found without reading the texts
    ranged = src.repartitionByRange("key", "row").sortWithinPartitions("key", "t").select("key", "t")
    whole = ranged.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    whole.write.option("lineSep", "\n").text(path)


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


def shard_directory(spark: SparkSession, path: str) -> DataFrame:
    """One row per shard: (shard, path, at, docs, n_ids, keyless, first_key, last_key, first_docs, last_docs)."""
    names = ["shard", "path", "at", "docs", "n_ids", "keyless", "first_key", "last_key", "first_docs", "last_docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(*(b.column(c) for c in ("path", "content"))):
                rows = []
                for at, s in shards_of(content.as_py()):
                    keys, _, count = s.in_order()
                    ends = int(keys[0]), int(keys[-1]), int(count[0]), int(count[-1])
                    rows.append((s.number, file.as_py(), at, s.docs, s.n_ids, s.keyless, *ends))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    kinds = "shard long, path string, at long, docs long, n_ids long, keyless boolean, first_key long, last_key long, first_docs long, last_docs long"
    return _files(spark, path).select("path", "content").mapInArrow(run, kinds)


def _begins(sizes: DataFrame) -> DataFrame:
    """(shard, begin): ids before a shard, from one row (shard, n_ids) per shard."""
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("shard", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("begin"))


def _spanning(edges: DataFrame) -> DataFrame:
    """(shard, key, before): a key's documents in earlier shards, from (shard, keyless, key, n) of the keys at shards' edges."""
    same = Window.partitionBy("keyless", "key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return edges.select("shard", "key", F.coalesce(F.sum("n").over(same), F.lit(0)).alias("before")).where("before > 0")


def _edges(directory: DataFrame) -> DataFrame:
    first = F.struct(F.col("first_key").alias("key"), F.col("first_docs").alias("n"))
    last = F.struct(F.col("last_key").alias("key"), F.col("last_docs").alias("n"))
    # only keys at a shard's edge can stand in several
    return directory.select("shard", "keyless", F.explode(F.array_distinct(F.array(first, last))).alias("e")).select("shard", "keyless", "e.*")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32, nth) of every stored document, each found through its shard's index."""
    names = ["shard", "keyless", "key", "local", "n_tokens", "ids_crc32", "here"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column(0):
                for _, s in shards_of(c.as_py()):
                    keys, first, count = s.in_order()
                    each = np.repeat(keys, count)
                    here = np.arange(s.docs) - np.repeat(first, count)
                    at = s.offsets.astype(np.int64)
                    crc = [zlib.crc32(as_u4(s.ids[a:z].tobytes(), s.ids.dtype)) for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
                    cols = [each, at[:-1], np.diff(at), np.array(crc, dtype=np.int64), here]
                    marks = [pa.array(np.full(s.docs, s.number)), pa.array(np.full(s.docs, s.keyless))]
                    yield pa.RecordBatch.from_arrays([*marks, *[pa.array(x.astype(np.int64)) for x in cols]], names=names)

    kinds = "shard long, keyless boolean, key long, local long, n_tokens long, ids_crc32 long, here long"
    # the files are read once; their shards' sizes and edges come from what was read
    docs = cut(_files(spark, path).select("content").mapInArrow(rows, kinds))
    begins = _begins(docs.groupBy("shard").agg(F.sum("n_tokens").alias("n_ids")))
    held = docs.groupBy("shard", "keyless").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    low, high = (held.select("shard", F.col(c).alias("key")) for c in ("low", "high"))
    at_edge = docs.join(low.unionByName(high).distinct(), ["shard", "key"], "left_semi")
    edges = _spanning(at_edge.groupBy("shard", "keyless", "key").agg(F.count("*").alias("n")))
    return docs.join(begins, "shard").join(edges, ["shard", "key"], "left").select(
        F.when(~F.col("keyless"), F.col("key")).alias("key"),
        (F.col("begin") + F.col("local")).alias("start"),
        "n_tokens",
        "ids_crc32",
        (F.col("here") + F.coalesce("before", F.lit(0))).alias("nth"),
    )


def lookup(spark: SparkSession, path: str, asked: DataFrame, key_col: str = "key") -> DataFrame:
    """(key, nth, ids) of every stored document under the distinct asked keys; keys that are not stored give no row.

    The directory goes to the tasks in slices of ``DIRECTORY_AT_A_TIME`` shards, one slice for most tables.
    """
    directory = cut(shard_directory(spark, path).where("NOT keyless"))
    edges = _spanning(_edges(directory))
    keys = asked.select(F.col(key_col).cast("long").alias("key")).where("key IS NOT NULL").distinct()
    edge = directory.select("shard").orderBy("shard")
    most, sent = DIRECTORY_AT_A_TIME, None
    low = -1
    while True:
        part = [r[0] for r in edge.where(F.col("shard") > low).limit(most).collect()]
        if not part:
            break
        rows = directory.where(F.col("shard").between(part[0], part[-1])).select("shard", "first_key", "last_key", "path", "at")
        held = rows.orderBy("shard").toPandas()
        shared = spark.sparkContext.broadcast(held)

        def route(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            d = shared.value
            firsts, lasts = d["first_key"].to_numpy(), d["last_key"].to_numpy()
            for b in batches:
                k = b.column(0).to_numpy()
                # shards whose range holds the key stand together
                start, stop = np.searchsorted(lasts, k, "left"), np.searchsorted(firsts, k, "right")
                n = np.maximum(stop - start, 0)
                at = np.repeat(start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                cols = [np.repeat(k, n), d["shard"].to_numpy()[at], d["at"].to_numpy()[at]]
                paths = pa.array(d["path"].to_numpy()[at], pa.string())
                yield pa.RecordBatch.from_arrays([*[pa.array(c.astype(np.int64)) for c in cols], paths], names=["key", "shard", "at", "path"])

        one = keys.mapInArrow(route, "key long, shard long, at long, path string")
        sent = one if sent is None else sent.unionByName(one)
        low = part[-1]
    if sent is None:
        sent = keys.select("key", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("at"), F.lit("").alias("path")).limit(0)
    sent = cut(sent)
    asks = sent.groupBy("path", "shard", "at").count()
    blocks = cut(sent.join(asks, ["path", "shard", "at"]).withColumn(
        "block", F.pmod(F.xxhash64("key"), F.ceil(F.col("count") / ASKED_AT_A_TIME)).cast("int")
    ).groupBy("path", "shard", "at", "block").agg(F.collect_list("key").alias("keys")))
    paths = [r[0] for r in blocks.select("path").distinct().limit(DIRECTORY_AT_A_TIME).collect()]
    if not paths:
        return blocks.select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("nth"), F.array().cast("array<long>").alias("ids")).limit(0)
    files = _files(spark, paths if len(paths) < DIRECTORY_AT_A_TIME else path).select("path", "content")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, at, wanted, content in zip(*(b.column(c) for c in ("shard", "at", "keys", "content"))):
                s = Shard(content.as_py(), at.as_py())
                got = [(key, k, s.ids_of(d)) for key in wanted.as_py() for k, d in enumerate(s.stored(key))]
                cols = [pa.array([number.as_py()] * len(got), pa.int64()), pa.array([g[0] for g in got], pa.int64())]
                ids = pa.array([g[2].astype(np.int64) for g in got], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*cols, pa.array([g[1] for g in got], pa.int64()), ids], names=["shard", "key", "here", "ids"])

    met = blocks.join(files, "path").mapInArrow(find, "shard long, key long, here long, ids array<long>")
    return met.join(edges, ["shard", "key"], "left").select("key", (F.col("here") + F.coalesce("before", F.lit(0))).alias("nth"), "ids")


def token_files(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, path: str | None = None
) -> DataFrame:
    """Write the files (below ``path``, or a new folder in the shared checkpoint folder) and return what they hold."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-files")
    write_token_files(docs, path, tokenizer, id_col, text_col, end_id)
    return read_token_files(spark, path).withColumnRenamed("key", id_col)
