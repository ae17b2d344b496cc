"""Filter interactions, audited on a sparse document-term matrix.

Matrix.  One pass over the texts makes blocks of documents: each block has a vocabulary of its own and its documents
as rows of a CSR matrix over it.  The blocks' vocabularies meet in one global dictionary, partitioned by word, that gives
each word its id, and each block gets the ids of its words back, so only a block's distinct words are shuffled, never
its tokens.  ``Matrix.shards`` are the CSR shards over the global ids.

Flags.  A and B come from the matrix: a row's sum is its number of words, its stored entries are its distinct words.
C and D come from the same pass over the text; E meets the lowest id of the row's text by its SHA-256.

Audit.  A document is known by its five flags, its part and its labels, so documents are summed into one
line per (part, flags) of at most 32, and every order is worked out from these.

Scale: a block closes after ``BLOCK_TOKENS`` tokens (a longer document is a block alone).  Common words are one row per
block.  Texts and ids held by many rows are joined by ``hot_join``.  One line per part leaves Spark's sums.

Results for odd input: a null text is empty; a null part is the empty string, and its rows join those of that name; a
row with a null id is never a copy of a smaller id, nor is it one for others, and has no labels; equal rows with one id are no
copies of each other; a label that is null, or an id without labels, counts as 0, and of repeated labels the
largest holds; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import cut, hot_join

FILTERS = "ABCDE"
#: Tokens after which a block of documents closes.
BLOCK_TOKENS = 2_200_000
#: Low bits of a word id: the word's rank in its partition of the dictionary.
RANK_BITS = 40
#: Bytes of texts whose words are counted at a time.
PIECE_BYTES = 1 << 20
_SYMBOLS = [b"#", b"$", b"%", b"&", b"*", b"|"]
_CAPITALS, _INNER = bytes(range(65, 91)), bytes(range(0x80, 0xC0))


@dataclass
class Matrix:
    """``dictionary``: (word binary, word_id long), ids unique, with the word's partition in the high bits.

    ``shards``: one row per block: shard, ids, parts, digests, marks (per document), and the CSR arrays as little-endian bytes:
    indptr (int64), indices (int64 word ids, ascending in a row), data (int32 counts).
    """

    dictionary: DataFrame
    shards: DataFrame


def _packed(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def capitals(raw: bytes) -> tuple[int, int]:
    """(A-Z characters, code points) of a UTF-8 text."""
    return len(raw) - len(raw.translate(None, _CAPITALS)), len(raw.translate(None, _INNER))


def _pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of the rows (id, part, text), each of ``PIECE_BYTES`` of text or one row."""
    ends = np.cumsum(pc.binary_length(b.column(2)).to_numpy().astype(np.int64))
    start = 0
    while start < b.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(int(np.searchsorted(ends, before + PIECE_BYTES, "right")), start + 1)
        yield b.slice(start, stop - start)
        start = stop


def _counted(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, row, code, times, tokens): the distinct words of some texts; per text and word of it, in the texts' order, the
    text's place, the word's place in ``words`` and how often it stands there; the number of words of each text.
    """
    split = pc.ascii_split_whitespace(texts)
    flat, rows = split.flatten(), np.repeat(np.arange(len(split)), split.value_lengths().to_numpy())
    # white space at a text's ends leaves empty words
    there = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(there, min_count=0).as_py():
        flat, rows = flat.filter(there), rows[there.to_numpy(zero_copy_only=False)]
    flat = flat.dictionary_encode()
    words = flat.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    n = max(1, len(words))
    key = np.sort(rows * n + flat.indices.to_numpy())
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    row = key[first] // n
    return words, row, key[first] - row * n, np.diff(first, append=len(key)), np.bincount(rows, minlength=len(split))


def _blocks(id_type: pa.DataType):
    """Documents (id, part, text) to blocks with a vocabulary of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def empty() -> tuple:
            vocab: defaultdict[bytes, int] = defaultdict()
            vocab.default_factory = vocab.__len__  # a new word gets the next number
            return vocab, [], [], [], [], [], [], [0], 0

        vocab, ids, parts, digests, marks, columns, counts, ends, held = empty()

        def out() -> pa.RecordBatch:
            local, data = (np.concatenate([np.zeros(0, dtype="<u4"), *x]) for x in (columns, counts))
            blobs = [_packed(x) for x in (np.array(ends, dtype="<i8").tobytes(), local.tobytes(), data.tobytes())]
            words = b"\n".join(vocab)
            row = [
                pa.array([ids], pa.list_(id_type)),
                pa.array([parts], pa.list_(pa.string())),
                pa.array([digests], pa.list_(pa.binary())),
                pa.array([marks], pa.list_(pa.int32())),
                *[pa.array([n], pa.int64()) for n in (len(local), len(vocab), len(words))],
                *[pa.array([x], pa.binary()) for x in (*blobs, _packed(words))],
            ]
            return pa.RecordBatch.from_arrays(
                row, names=["ids", "parts", "digests", "marks", "nnz", "n_vocab", "vocab_bytes", "ends", "local", "data", "vocab"]
            )

        for b in batches:
            for part in _pieces(b):
                own_ids, own_parts = (part.column(c).to_pylist() for c in range(2))
                raws = part.column(2).cast(pa.binary()).to_pylist()
                words, row, code, times, tokens = _counted(part.column(2))
                total, start = np.cumsum(tokens), 0
                while start < len(raws):
                    before = total[start - 1] if start else 0
                    stop = min(int(np.searchsorted(total, before + BLOCK_TOKENS - held)) + 1, len(raws))
                    here = slice(*np.searchsorted(row, [start, stop]))
                    if stop - start == len(raws):
                        place = np.fromiter(map(vocab.__getitem__, words), dtype="<u4", count=len(words))[code]
                    else:
                        used, at = np.unique(code[here], return_inverse=True)
                        place = np.fromiter((vocab[words[u]] for u in used.tolist()), dtype="<u4", count=len(used))[at]
                    columns.append(place)
                    counts.append(times[here].astype("<u4"))
                    ends.extend((ends[-1] + np.cumsum(np.bincount(row[here] - start, minlength=stop - start))).tolist())
                    ids.extend(own_ids[start:stop])
                    parts.extend(own_parts[start:stop])
                    for raw in raws[start:stop]:
                        big, points = capitals(raw)
                        digests.append(hashlib.sha256(raw).digest())
                        marks.append((100 * big > 10 * points) + 2 * any(c in raw for c in _SYMBOLS))
                    held += int(total[stop - 1] - before)
                    start = stop
                    if held >= BLOCK_TOKENS:
                        yield out()
                        vocab, ids, parts, digests, marks, columns, counts, ends, held = empty()
        if ids:
            yield out()

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, pos, word) of the blocks' vocabularies; words hold no white space, so a line break parts them."""
    for b in batches:
        for shard, n, size, raw in zip(*(b.column(c).to_pylist() for c in ("shard", "n_vocab", "vocab_bytes", "vocab"))):
            words = pa.array(pa.decompress(raw, size, codec="zstd", asbytes=True).split(b"\n"), pa.binary()) if n else ()
            for k in range(0, n, 100_000):
                part = words.slice(k, 100_000)
                pos = pa.array(np.arange(k, k + len(part)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), shard)), pos, part], names=["shard", "pos", "word"])


def _numbered(with_words: bool):
    """Sorted words of one partition to ids: the partition in the high bits, the word's rank in the low ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        high, rank, last = TaskContext.get().partitionId() << RANK_BITS, -1, None
        for b in batches:
            if not b.num_rows:
                continue
            word = b.column("word")
            new = np.ones(b.num_rows, dtype=bool)
            new[1:] = pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False)
            new[0] = word[0].as_py() != last
            at = rank + np.cumsum(new)
            rank, last = int(at[-1]), word[-1].as_py()
            ids = pa.array(high + at)
            if with_words:
                keep = pa.array(new)
                yield pa.RecordBatch.from_arrays([word.filter(keep), ids.filter(keep)], names=["word", "word_id"])
            else:
                yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("pos"), ids], names=["shard", "pos", "word_id"])

    return run


def _to_global(block: pa.Table, words: pa.Table) -> pa.Table:
    """A block's columns become global word ids, ascending in each row."""
    nnz, local, data, ends = (block.column(c)[0].as_py() for c in ("nnz", "local", "data", "ends"))
    rows = len(block.column("ids")[0])
    indptr, local, data = (_unpacked(*x) for x in ((ends, rows + 1, "<i8"), (local, nnz, "<u4"), (data, nnz, "<u4")))
    ids = np.zeros(len(words), dtype="<i8")
    ids[words.column("pos").to_numpy()] = words.column("word_id").to_numpy()
    # one word's place among the block's words in id order, and the row, in one number
    place = np.empty(len(ids), dtype=np.int64)
    place[np.argsort(ids)] = np.arange(len(ids))
    order = np.argsort(np.repeat(np.arange(rows), np.diff(indptr)) * (len(ids) + 1) + place[local])
    csr = (indptr.tobytes(), ids[local][order].tobytes(), data[order].astype("<i4").tobytes())
    cols = [block.column(c) for c in ("shard", "ids", "parts", "digests", "marks")]
    return pa.Table.from_arrays(
        [*cols, *[pa.array([x], pa.binary()) for x in csr]],
        names=["shard", "ids", "parts", "digests", "marks", "indptr", "indices", "data"],
    )


def term_matrix(docs: DataFrame, id_col: str = "doc_id", part_col: str = "lang", text_col: str = "text") -> Matrix:
    """The global dictionary and the CSR shards of all rows."""
    src = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    kind = src.schema["id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    each = f"ids array<{kind}>, parts array<string>, digests array<binary>, marks array<int>"
    packed = "nnz long, n_vocab long, vocab_bytes long, ends binary, local binary, data binary, vocab binary"
    blocks = cut(
        src.mapInArrow(_blocks(to_arrow_type(src.schema["id"].dataType)), f"{each}, {packed}").withColumn(
            "shard", F.monotonically_increasing_id()
        )
    )
    listed = blocks.select("shard", "n_vocab", "vocab_bytes", "vocab").mapInArrow(_listed, "shard long, pos int, word binary")
    # a stated number of partitions is not changed at run time, and words are sorted, so an id is the same in every run
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_word = listed.repartition(parts, "word").sortWithinPartitions("word")
    dictionary = by_word.mapInArrow(_numbered(True), "word binary, word_id long")
    # a block meets the ids of its words, as many as its vocabulary has
    named = by_word.mapInArrow(_numbered(False), "shard long, pos int, word_id long")
    shards = (
        blocks.drop("vocab", "n_vocab", "vocab_bytes")
        .groupBy("shard")
        .cogroup(named.groupBy("shard"))
        .applyInArrow(_to_global, f"shard long, {each}, indptr binary, indices binary, data binary")
    )
    return Matrix(dictionary, shards)


def row_statistics(shards: DataFrame) -> DataFrame:
    """(id, part, digest, mark, n_words, n_distinct), one row per document of the shards."""
    kind = shards.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                indptr = np.frombuffer(one.column("indptr")[0].as_py(), "<i8")
                data = np.frombuffer(one.column("data")[0].as_py(), "<i4").astype(np.int64)
                sums = np.diff(np.concatenate([[0], np.cumsum(data)])[indptr])
                cols = [one.column(c).flatten() for c in ("ids", "parts", "digests", "marks")]
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(sums), pa.array(np.diff(indptr))], names=["id", "part", "digest", "mark", "n_words", "n_distinct"]
                )

    return shards.mapInArrow(run, f"id {kind}, part string, digest binary, mark int, n_words long, n_distinct long")


def flags(
    docs: DataFrame,
    id_col: str = "doc_id",
    part_col: str = "lang",
    text_col: str = "text",
    min_words: int = 100,
    min_distinct_percent: int = 80,
) -> DataFrame:
    """(id, part, fails): bit k of ``fails`` is set where the document fails filter k of ABCDE."""
    rows = cut(row_statistics(term_matrix(docs, id_col, part_col, text_col).shards))
    first = rows.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    copied = cut(first.where("first < last").select("digest", "first"))
    met = hot_join(rows, copied, ["digest"], "left")
    bits = [
        F.col("n_words") < min_words,
        100 * F.col("n_distinct") < min_distinct_percent * F.col("n_words"),
        F.col("mark").bitwiseAND(F.lit(1)) > 0,
        F.col("mark").bitwiseAND(F.lit(2)) > 0,
        F.coalesce(F.col("first") < F.col("id"), F.lit(False)),
    ]
    fails = sum((F.when(b, 1 << k).otherwise(0) for k, b in enumerate(bits)), F.lit(0))
    return met.select("id", "part", fails.alias("fails"))


def interactions(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> list[tuple]:
    """All orders and steps, from the documents, the good and the toxic ones by flags (32 each)."""
    masks = np.arange(32)
    out = []
    alone = {f: int(n[1 << k]) for k, f in enumerate(FILTERS)}
    for order in permutations(FILTERS):
        earlier = 0
        for step, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            fails, gone = (masks & bit) > 0, (masks & earlier) > 0
            here = fails & ~gone
            earlier |= bit
            sums = [n[(masks & earlier) == 0], n[here], n[fails & gone], good[here], toxic[here]]
            kept, removed, redundant, good_lost, toxic_lost = (int(x.sum()) for x in sums)
            out.append(("".join(order), step, f, kept, removed, redundant, alone[f], good_lost, toxic_lost))
    return out


def audit_filters(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    part_col: str = "lang",
    text_col: str = "text",
    good_col: str = "quality",
    toxic_col: str = "toxic",
    **limits: int,
) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    known = cut(flags(docs, id_col, part_col, text_col, **limits))
    marks = (
        labels.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.col(good_col) == 1, F.lit(False)).cast("int").alias("good"),
            F.coalesce(F.col(toxic_col) == 1, F.lit(False)).cast("int").alias("toxic"),
        )
        .where("id IS NOT NULL AND good + toxic > 0")
        .groupBy("id")
        .agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    )
    none = F.lit(None).cast("int")
    nameless = known.where("id IS NULL").withColumns({"good": none, "toxic": none})
    met = hot_join(known.where("id IS NOT NULL"), cut(marks), ["id"], "left").unionByName(nameless)
    sums = met.groupBy("part", "fails").agg(
        F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")
    )
    lines = sums.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("s"))  # 32 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
        for b in batches:
            for line in b.to_pylist():
                x = np.zeros((3, 32), dtype=np.int64)
                for s in line["s"]:
                    x[:, s["fails"]] = s["n"], s["good"], s["toxic"]
                rows = interactions(*x)
                shapley = dict.fromkeys(FILTERS, 0)
                for r in rows:
                    shapley[r[2]] += r[4]
                cols = zip(*[(line["part"], r[0], r[1], *r[3:], shapley[r[2]]) for r in rows])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    longs = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return lines.mapInArrow(run, f"part string, filter_order string, step int, {longs}")
