"""Vector bin packing of token sequences.

Every example has a demand vector: tokens, one segment, loss-bearing tokens.
A sequence has a capacity in each.  Sequences are filled one at a time: of the
examples in a bounded window, the one whose demand (in shares of capacity) has
the largest dot product with what is left of the sequence goes in next, if it
fits in every dimension.  When none fits, the best one is cut to what is left.
A sequence that cannot be filled is trimmed to a power of two, at which it
needs no padding, and what was trimmed goes back to the window.

Each task packs the rows it reads, in a stream: its memory is bounded by the
window, and no row is shuffled.  Sequence ids carry the task number above the
number within the task, so they are unique without a count over all tasks.

Results for odd input: a null or empty text is the end id alone; a null id is
kept; repeated rows are packed one by one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.bpe import WordEncoder, as_u4

SEQ_BITS = 33


class _Item:
    """An example, or what is left of one from ``start`` on; ids from ``loss_from`` on bear loss."""

    __slots__ = ("key", "ids", "start", "size", "loss_from", "at")

    def __init__(self, key, ids: bytes, loss_from: int) -> None:
        self.key, self.ids, self.start, self.size, self.loss_from = key, ids, 0, len(ids) // 4, loss_from
        self.at = -1  # place in the window

    def loss(self, n: int) -> int:
        """Loss-bearing ids among the next n."""
        return max(0, self.start + n - max(self.start, self.loss_from))


class Packer:
    """Packs a stream of examples; ``add`` and ``close`` yield finished sequences as lists of (item, start, length)."""

    def __init__(self, max_tokens: int = 2048, max_segments: int = 128, max_loss: int = 2048, window: int = 256) -> None:
        if max_tokens & (max_tokens - 1) or min(max_segments, max_loss, window) < 1:
            raise ValueError("max_tokens must be a power of two and the other limits positive")
        self.cap = (max_tokens, max_segments, max_loss)
        self.window, self.items = window, []
        #: per place of the window: tokens left, loss-bearing ones among them, tokens before the first of those
        self.left, self.loss, self.free = (np.zeros(window + 1, dtype=np.int64) for _ in range(3))

    def add(self, item: _Item) -> Iterator[list]:
        self._put(item)
        while len(self.items) >= self.window:
            yield from self._sequence()

    def close(self) -> Iterator[list]:
        while self.items:
            yield from self._sequence()

    def _put(self, x: _Item) -> None:
        x.at = len(self.items)
        self.items.append(x)
        self._note(x)

    def _note(self, x: _Item) -> None:
        left = x.size - x.start
        self.left[x.at], self.loss[x.at], self.free[x.at] = left, x.loss(left), max(0, x.loss_from - x.start)

    def _drop(self, x: _Item) -> None:
        last = self.items.pop()
        if last is not x:
            self.items[x.at] = last
            for v in (self.left, self.loss, self.free):
                v[x.at] = v[last.at]
            last.at = x.at
        x.at = -1

    def _choose(self, left: list[int]) -> tuple[int, int]:
        """(index, length) of the best whole example that fits, else of the best cut."""
        cap_t, cap_s, cap_l = self.cap
        n = len(self.items)
        size, loss = self.left[:n], self.loss[:n]
        dot = size * (left[0] / cap_t / cap_t) + loss * (left[2] / cap_l / cap_l) + left[1] / cap_s / cap_s
        fits = (size <= left[0]) & (loss <= left[2])
        k = int(np.argmax(np.where(fits, dot, -1.0)))
        if fits[k]:
            return k, int(size[k])
        piece = np.minimum(np.minimum(size, left[0]), self.free[:n] + left[2])
        k = int(np.argmax(np.where(piece == piece.max(), dot, -1.0)))
        return k, int(piece[k])

    def _sequence(self) -> Iterator[list]:
        left, out = list(self.cap), []
        while left[0] and left[1] and self.items:
            k, n = self._choose(left)
            if n == 0:
                break
            x = self.items[k]
            out.append((x, x.start, n))
            left = [left[0] - n, left[1] - 1, left[2] - x.loss(n)]
            x.start += n
            if x.start == x.size:
                self._drop(x)
            else:
                self._note(x)
        fill = self.cap[0] - left[0]
        over = fill - (1 << (fill.bit_length() - 1)) if fill else 0
        while over:
            x, start, n = out.pop()
            cut = min(over, n)
            x.start -= cut
            if x.at < 0:
                self._put(x)
            else:
                self._note(x)
            over -= cut
            if cut < n:
                out.append((x, start, n - cut))
        yield out


def _pieces(sequence: list, number: int) -> list[tuple]:
    rows, at = [], 0
    for x, start, n in sequence:
        crc = zlib.crc32(memoryview(x.ids)[4 * start : 4 * (start + n)])
        rows.append((x.key, start, n, crc, x.size, number, at, max(0, start + n - max(start, x.loss_from))))
        at += n
    return rows


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    loss_from_col: str | None = None,
    max_tokens: int = 2048,
    max_segments: int = 128,
    max_loss: int = 2048,
    window: int = 256,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    ``loss_from_col`` names a column with the number of leading ids that bear
    no loss (a prompt); without it, or where it is null, all ids bear loss.
    ``with_ids`` adds the piece's ids as little-endian unsigned 32-bit bytes.
    """
    loss_from = F.lit(0) if loss_from_col is None else F.coalesce(F.col(loss_from_col).cast("int"), F.lit(0))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), loss_from.alias("lf"))
    kind = src.schema["id"].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
    schema = f"id {kind}, " + ", ".join(f"{n} long" for n in names[1:]) + (", ids binary" if with_ids else "")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, enc = TaskContext.get().partitionId() << SEQ_BITS, WordEncoder.of(tokenizer)
        end = enc.end(end_id)
        packer = Packer(max_tokens, max_segments, max_loss, window)
        done: list[tuple] = []
        id_type = None

        def out() -> pa.RecordBatch:
            cols = [list(c) for c in zip(*done)]
            arrays = [pa.array(cols[0], id_type)] + [pa.array(c, pa.int64()) for c in cols[1:8]]
            return pa.RecordBatch.from_arrays(
                arrays + ([pa.array(cols[8], pa.binary())] if with_ids else []), names=names + ["ids"] * with_ids
            )

        def take(sequences: Iterator[list]) -> None:
            nonlocal number
            for s in sequences:
                rows = _pieces(s, number)
                done.extend(
                    [(*r, x.ids[4 * a : 4 * (a + n)]) for r, (x, a, n) in zip(rows, s)] if with_ids else rows
                )
                number += 1

        for b in batches:
            id_type = b.schema.field(0).type
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                encoded = enc.encode([t or "" for t in part.column(1).to_pylist()])
                for key, ids, start in zip(part.column(0).to_pylist(), encoded, part.column(2).to_pylist()):
                    take(packer.add(_Item(key, as_u4(ids + end, enc.kind), max(0, start))))
                if len(done) > 5000:
                    yield out()
                    done.clear()
        take(packer.close())
        if done:
            yield out()

    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)
