"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.
Learned filters (byte embedding, then a convolution of ``WIDTH`` bytes and a
rectifier) run over every chunk and are max-pooled per chunk.  The text's
chunks are combined by maximum and by mean, and a logistic layer turns both
into one probability.  All weights, embedding included, are learned together.

Fit: on a bounded sample of labelled rows on the driver, at most
``max_per_class`` rows of each class with texts of at most ``max_bytes``
bytes, in the order of a hash of the id.  Scoring is one pass over all whole
texts in Arrow batches, without a shuffle.

Results for odd input: a null or empty text is one chunk of padding and gets a
score like any other; a null id hashes as the empty string; rows whose label
is null or not 0 or 1 are not learned from; with one class only, or no labelled row, every
score is the share of class 1 (0.5 without rows); repeated rows are scored one
by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import crc_mod

WIDTH, FILTERS, EMBED = 5, 16, 6
CHUNK, OVERLAP = 256, 16


def chunks(data: bytes) -> np.ndarray:
    """(number of chunks, CHUNK) bytes; the last chunk ends with zeros."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(data) - OVERLAP) // step))
    buf = np.zeros(n * step + OVERLAP, dtype=np.uint8)
    buf[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.as_strided(buf, (n, CHUNK), (step, 1))


@dataclass
class Model:
    embed: np.ndarray  # 256 x EMBED
    conv: np.ndarray  # WIDTH x EMBED x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2 * FILTERS
    out_bias: float
    trained: bool = True

    def tables(self) -> list[np.ndarray]:
        """Per filter offset, what each byte adds to each filter."""
        return [(self.embed @ self.conv[k]).astype(np.float32) for k in range(WIDTH)]

    def pooled(self, rows: np.ndarray, tables: list[np.ndarray], where: bool = False):
        """Max over the positions of each chunk (before the rectifier, which keeps order), and where it was."""
        n = CHUNK - WIDTH + 1
        z = tables[0][rows[:, :n]]
        for k in range(1, WIDTH):
            z += tables[k][rows[:, k : k + n]]
        if where:
            at = z.argmax(axis=1)
            return np.take_along_axis(z, at[:, None], axis=1)[:, 0] + self.bias, at
        return z.max(axis=1) + self.bias, None

    def scores(self, texts: list[str | None], rows_at_a_time: int = 256) -> np.ndarray:
        if not self.trained:
            return np.full(len(texts), self.out_bias)
        tables = self.tables()
        best = np.zeros((len(texts), FILTERS), dtype=np.float32)
        total = np.zeros((len(texts), FILTERS), dtype=np.float64)
        count = np.zeros(len(texts))
        held, owner, size = [], [], 0

        def flush() -> None:
            rows, of = np.concatenate(held), np.concatenate(owner)
            h = np.maximum(self.pooled(rows, tables)[0], 0)
            np.maximum.at(best, of, h)
            np.add.at(total, of, h)
            held.clear(), owner.clear()

        for i, t in enumerate(texts):
            c = chunks((t or "").encode("utf-8", "surrogatepass"))
            count[i] = len(c)
            for k in range(0, len(c), rows_at_a_time):
                held.append(c[k : k + rows_at_a_time])
                owner.append(np.full(len(held[-1]), i))
                size += len(held[-1])
                if size >= rows_at_a_time:
                    flush()
                    size = 0
        if held:
            flush()
        mean = total / np.maximum(count, 1)[:, None]
        z = best @ self.out[:FILTERS] + mean @ self.out[FILTERS:] + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _start(rng: np.random.Generator) -> Model:
    return Model(
        rng.normal(0, 0.5, (256, EMBED)),
        rng.normal(0, 1 / np.sqrt(WIDTH * EMBED), (WIDTH, EMBED, FILTERS)),
        np.zeros(FILTERS),
        rng.normal(0, 0.3, 2 * FILTERS),
        0.0,
    )


def _gradients(m: Model, docs: list[np.ndarray], y: np.ndarray) -> list[np.ndarray]:
    """Of the mean logistic loss, by (embed, conv, bias, out, out_bias)."""
    sizes = np.array([len(d) for d in docs])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    rows = np.concatenate(docs)
    z, at = m.pooled(rows, m.tables(), where=True)
    h = np.maximum(z, 0)
    best, mean = np.maximum.reduceat(h, starts), np.add.reduceat(h, starts) / sizes[:, None]
    feats = np.concatenate([best, mean], axis=1)
    p = 1 / (1 + np.exp(-np.clip(feats @ m.out + m.out_bias, -30, 30)))
    g = (p - y) / len(y)
    owner = np.repeat(np.arange(len(docs)), sizes)
    top = h == best[owner]
    top = top / np.maximum(np.add.reduceat(top, starts)[owner], 1)
    gh = g[owner, None] * (top * m.out[:FILTERS] + m.out[FILTERS:] / sizes[owner, None])
    gz = gh * (z > 0)
    # only the position of each maximum takes part
    bytes_at = rows[np.arange(len(rows))[:, None, None], at[:, :, None] + np.arange(WIDTH)]  # chunk, filter, offset
    seen = m.embed[bytes_at]  # chunk, filter, offset, embed
    g_conv = np.einsum("cf,cfke->kef", gz, seen, optimize=True)
    g_seen = np.einsum("cf,kef->cfke", gz, m.conv, optimize=True)
    g_embed = np.zeros_like(m.embed)
    np.add.at(g_embed, bytes_at.reshape(-1), g_seen.reshape(-1, EMBED))
    return [g_embed, g_conv, gz.sum(axis=0), feats.T @ g, np.array(g.sum())]


def fit(rows: list[tuple[str | None, int]], prior: float, epochs: int = 6, batch: int = 64, rate: float = 0.01) -> Model:
    """Adam on (text, label) rows; ``prior`` is the share of class 1 among all rows learned from."""
    y = np.array([r[1] for r in rows], dtype=float)
    rng = np.random.default_rng(7)
    m = _start(rng)
    if not len(y) or y.min() == y.max():
        m.trained, m.out_bias = False, prior
        return m
    docs = [chunks((t or "").encode("utf-8", "surrogatepass")) for t, _ in rows]
    params = [m.embed, m.conv, m.bias, m.out, np.array(0.0)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    steps = epochs * -(-len(docs) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for k in range(0, len(docs), batch):
            take = order[k : k + batch]
            step += 1
            lr = rate * (1 - step / (steps + 1))
            for i, g in enumerate(_gradients(m, [docs[j] for j in take], y[take])):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                move = lr * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
                params[i] -= move
            m.out_bias = float(params[4])
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    prior = float(np.clip(prior, 1e-6, 1 - 1e-6))
    m.out_bias += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return m


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, max_per_class: int, max_bytes: int
) -> tuple[list[tuple[str | None, int]], float]:
    """At most max_per_class rows of each class, by hash of the id, and the share of class 1 among all labelled rows."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1) AND id IS NOT NULL")
    n = dict(marks.groupBy("y").count().collect())
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where(
        f"t IS NULL OR octet_length(t) <= {int(max_bytes)}"
    )
    # the ids to take are chosen before any text is read: a bounded number of them
    rows: list[tuple[str | None, int]] = []
    with_text = marks.join(src.select("id"), "id").distinct()
    for label in (0, 1):
        ids = with_text.where(F.col("y") == label).orderBy(F.xxhash64("id"), "id").limit(max_per_class)
        rows += [(r[0], label) for r in src.join(F.broadcast(ids), "id").select("t").limit(2 * max_per_class).collect()]
    return rows, n.get(1, 0) / max(1, sum(n.values())) if n else 0.5


def score_rows(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(id_col, score), one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                s = shared.value.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], names=["id", "score"])

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    modulus: int = 3,
    held_remainder: int = 1,
    max_per_class: int = 2500,
    max_bytes: int = 16384,
) -> DataFrame:
    """(id_col, held_out, score, predicted); rows held out by crc32 of the id are not learned from."""
    held = crc_mod(id_col, modulus) == held_remainder
    rows, prior = labelled_sample(docs, labels.where(~held), label_col, id_col, text_col, max_per_class, max_bytes)
    out = score_rows(docs, fit(rows, prior), id_col, text_col)
    return out.select(
        id_col, held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted")
    )
