"""Quality rules with cross-document line frequency.

Base rules look at one text: words, symbols, repeated lines, words in repeated windows (``WINDOW`` words found
twice or more).  The cross-document rule looks at lines: a line is normalised (A-Z lowered, digits
to 0, its words joined by one space) and hashed, and per host the distinct documents with that line are counted.  Lines in more
than ``max_docs`` documents of their host are removed from every document there, and a document that is depleted by that,
with under ``min_words`` words left or more than ``max_removed_percent`` of its words removed, is rejected.

Distinct documents are distinct texts: a copy of a whole document adds nothing to its lines' counts, so exact copies are
left to de-duplication, and repeated or null ids change nothing.  The limit is one number at every size.

Windows are compared exactly, by ranks of doubling width (2, 4, 8 words), not by a hash.  Lines are told
apart by 128-bit hashes of their own.

Scale: one pass over the texts; a line leaves it as a hash and a word count, once per text.  Texts that are equal
within a host are one row before their lines are counted, with partial sums before the shuffle.  Lines and texts that many rows hold
are joined by ``hot_join``.

Results for odd input: a null or empty text has no words and fails the base rules; rows with a null host are a host of
their own; repeated rows get the same verdict; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import cut, hot_join

WINDOW = 8
_SPACE, _INNER, _SIGN = 1, 2, 3
#: Per byte: white space, inner byte of a character, one of the counted symbols, or 0.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[0x80:0xC0] = _INNER
_KIND[[ord(c) for c in "#*$%&|<>"]] = _SIGN
_DIGITS = bytes.maketrans(b"0123456789", b"0000000000")


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of 8 words that occur twice or more in the text, the first occurrence included."""
    if len(words) <= WINDOW:
        return 0
    index: dict[bytes, int] = {}
    code = np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=len(words))
    width, kinds = 1, len(index)
    while width < WINDOW:
        pair = code[:-width] * kinds + code[width:]
        values, code = np.unique(pair, return_inverse=True)
        width, kinds = 2 * width, len(values)
        if kinds == len(pair):
            return 0
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(np.bincount(code)[code] > 1)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def describe(text: str) -> tuple[list[int], dict[bytes, int]]:
    """([words, code points in words, symbols, repeated lines, words in repeated windows], {line hash: words})."""
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(_KIND[np.frombuffer(raw, dtype=np.uint8)], minlength=4)
    words: list[bytes] = []
    lines: dict[bytes, int] = {}
    seen: set[bytes] = set()
    repeated = 0
    for line in raw.split(b"\n"):
        own = line.split()
        if own:
            repeated += line in seen
            seen.add(line)
            words += own
            key = hashlib.md5(b" ".join(own).lower().translate(_DIGITS), usedforsecurity=False).digest()
            lines[key] = lines.get(key, 0) + len(own)
    return [len(words), int(kinds[0] + kinds[_SIGN]), int(kinds[_SIGN]), repeated, repeat_words(words)], lines


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    line = pa.struct([("h", pa.binary()), ("words", pa.int64())])
    names = ["id", "host", "digest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"]
    for b in batches:
        for k in range(0, b.num_rows, 500):
            part = b.slice(k, 500)
            numbers, lines, digests = [], [], []
            for t in part.column(2).to_pylist():
                n, own = describe(t)
                numbers.append(n)
                lines.append([{"h": h, "words": w} for h, w in own.items()])
                digests.append(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(digests, pa.binary()),
                    *[pa.array(c, pa.int64()) for c in zip(*numbers)],
                    pa.array(lines, pa.list_(line)),
                ],
                names=names,
            )


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    host_col: str = "source",
    text_col: str = "text",
    min_words: int = 20,
    max_repeat_percent: int = 30,
    max_docs: int = 6,
    max_removed_percent: int = 50,
) -> DataFrame:
    """(id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, base_failed, kept), one row per row."""
    src = docs.select(
        F.col(id_col).alias("id"),
        # a name of its own for rows without a host
        F.coalesce(F.concat(F.lit("+"), F.col(host_col).cast("string")), F.lit("-")).alias("host"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    numbers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kind = src.schema["id"].dataType.simpleString()
    rows = cut(
        src.mapInArrow(
            _describe,
            f"id {kind}, host string, digest binary, {', '.join(f'{c} long' for c in numbers)}, lines array<struct<h: binary, words: bigint>>",
        )
    )
    texts = rows.groupBy("host", "digest").agg(F.first("lines").alias("lines"))
    lines = cut(texts.select("host", "digest", F.explode("lines").alias("l")).select("host", "digest", "l.h", "l.words"))
    over = cut(lines.groupBy("host", "h").agg(F.count("*").alias("docs")).where(F.col("docs") > max_docs).select("host", "h"))
    removed = hot_join(lines, over, ["host", "h"]).groupBy("host", "digest").agg(F.sum("words").alias("removed_words"))
    plain = rows.drop("lines")
    out = hot_join(plain, cut(removed), ["host", "digest"], "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("removed_words") < min_words) | (
        100 * F.col("removed_words") > max_removed_percent * F.col("n_words")
    )
    return out.select(
        F.col("id").alias(id_col), *numbers, "removed_words", failed.alias("base_failed"), (~failed & ~depleted).alias("kept")
    )
