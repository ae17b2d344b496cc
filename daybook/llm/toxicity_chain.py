"""Toxicity by a classifier chain of linear models.

Features: which of the selected byte 5-grams of the text (A-Z lowered, ASCII
punctuation and white space as one space) occur in it.  Per category the
5-grams that speak most for it are selected by chi-square, among those in at least ``LEAST_ROWS`` of its rows.

Categories: one per family of the sample's toxic rows (their language, say) with at least ``FAMILY_ROWS`` rows, however many there
are; the toxic rows of smaller families and of none are one category together; the last is the label as a whole.

Chain: categories are predicted in a fixed order.  Each category's linear
model sees the 5-gram features and the probabilities of the earlier
categories.  In training those probabilities are out-of-fold: the rows of a
fold get them from models that did not see the fold, so a later model learns
from what an earlier one can really tell.  Scoring applies the full models in
order.

Fit: on the driver, on a bounded sample (``max_per_class`` rows with and
without the last category, texts of at most ``max_bytes`` bytes, by hash of the
id).  Scoring is one pass over all whole texts in Arrow batches, no shuffle.

Results for odd input: a null or empty text has no features and gets the
intercepts' probability; rows without a label are not learned from; a category
with no positive or no negative row in the sample has probability 0 for all (1 if
all are positive); repeated rows are scored one by one; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N_GRAM = 5
#: Rows of a category that hold a 5-gram, for it to be selected.
LEAST_ROWS = 3
#: Rows of a category in the sample, for it to be one of its own; smaller ones make up one category together.
FAMILY_ROWS = 5
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[i for i in range(1, 128) if not chr(i).isalnum()]] = 32
_BITS = 22


def grams(data: np.ndarray) -> np.ndarray:
    """The 5-gram that starts at each byte, as 40-bit numbers."""
    n = max(0, len(data) - N_GRAM + 1)
    out = data[:n].astype(np.uint64)
    for k in range(1, N_GRAM):
        out = (out << np.uint64(8)) | data[k : n + k]
    return out


def folded(text: str | None) -> np.ndarray:
    raw = b" " + (text or "").encode("utf-8", "surrogatepass") + b" "
    return _FOLD[np.frombuffer(raw, dtype=np.uint8)]


def _slot(g: np.ndarray) -> np.ndarray:
    return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)


@dataclass
class Chain:
    categories: list[str]
    grams: np.ndarray  # the selected 5-grams, sorted
    weights: list[np.ndarray]  # per category: one per 5-gram, then one per earlier category
    bias: list[float]

    def features(self, texts: list[str | None]) -> np.ndarray:
        """0/1 matrix, texts by selected 5-grams."""
        out = np.zeros((len(texts), len(self.grams)), dtype=np.float32)
        if not len(self.grams):
            return out
        if not hasattr(self, "_seen"):
            self._seen = np.zeros(1 << _BITS, dtype=bool)
            self._seen[_slot(self.grams)] = True
        for i, t in enumerate(texts):
            g = grams(folded(t))
            g = g[self._seen[_slot(g)]]
            at = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
            out[i, at[self.grams[at] == g]] = 1
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Texts by categories, each fed with the ones before it."""
        p = np.zeros((len(x), len(self.categories)))
        n = len(self.grams)
        for j, (w, b) in enumerate(zip(self.weights, self.bias)):
            p[:, j] = _sigmoid(x @ w[:n] + p[:, :j] @ w[n:] + b)
        return p


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 150, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by accelerated gradient descent."""
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1]), 30.0 if len(y) and y[0] == 1 else -30.0
    # Lipschitz constant by power iteration
    v = np.ones(x.shape[1], dtype=np.float32)
    top = 1.0
    for _ in range(8):
        v = x.T @ (x @ v)
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    rate = 1 / (0.25 * (top / len(y) + 1) + ridge)
    w, b = np.zeros(x.shape[1]), 0.0
    pw, pb = w, b
    for k in range(steps):
        m = k / (k + 3)
        lw, lb = w + m * (w - pw), b + m * (b - pb)
        g = (_sigmoid(x @ lw.astype(np.float32) + lb) - y) / len(y)
        pw, pb = w, b
        w, b = lw - rate * (x.T @ g.astype(np.float32) + ridge * lw), lb - rate * g.sum()
    return w, float(b)


def _select(uniq: list[np.ndarray], y: np.ndarray, top: int) -> np.ndarray:
    """The 5-grams with the largest chi-square among those that speak for y = 1."""
    pos, neg = int(y.sum()), int((1 - y).sum())
    if not pos or not neg:
        return np.zeros(0, dtype=np.uint64)
    cand, a = np.unique(np.concatenate([u for u, t in zip(uniq, y) if t]), return_counts=True)
    cand, a = cand[a >= LEAST_ROWS], a[a >= LEAST_ROWS].astype(float)
    if not len(cand):
        return cand
    c = np.zeros(len(cand))
    for u, t in zip(uniq, y):
        if not t:
            at = np.minimum(np.searchsorted(cand, u), len(cand) - 1)
            c[at[cand[at] == u]] += 1
    b, d, n = pos - a, neg - c, pos + neg
    chi = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)
    chi[a * neg <= c * pos] = 0
    best = np.argsort(-chi, kind="stable")[:top]
    return cand[best[chi[best] > 0]]


def fit_chain(
    rows: list[tuple[str | None, list[int]]], categories: list[str], folds: int = 3, grams_per_category: int = 400
) -> Chain:
    """Rows are (text, 0/1 per category, in the order of ``categories``)."""
    y = np.array([r[1] for r in rows], dtype=float).reshape(len(rows), len(categories))
    uniq = [np.unique(grams(folded(t))) for t, _ in rows]
    picked = [_select(uniq, y[:, j], grams_per_category) for j in range(len(categories))]
    chain = Chain(list(categories), np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *picked])), [], [])
    x = chain.features([r[0] for r in rows])
    fold = np.arange(len(rows)) % folds
    earlier = np.zeros((len(rows), 0), dtype=np.float32)
    for j in range(len(categories)):
        full = np.concatenate([x, earlier], axis=1)
        out_of_fold = np.zeros(len(rows), dtype=np.float32)
        for f in range(folds):
            w, b = _logistic(full[fold != f], y[fold != f, j])
            out_of_fold[fold == f] = _sigmoid(full[fold == f] @ w + b)
        w, b = _logistic(full, y[:, j])
        chain.weights.append(w)
        chain.bias.append(b)
        earlier = np.concatenate([earlier, out_of_fold[:, None]], axis=1)
    return chain


def training_rows(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    family_col: str | None,
    id_col: str,
    text_col: str,
    max_per_class: int,
    max_bytes: int,
) -> tuple[list[tuple[str | None, list[int]]], list[str]]:
    """A bounded labelled sample with one category per family of toxic rows (commonest first), then the label itself."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1) AND id IS NOT NULL")
    family = F.coalesce(F.col(family_col).cast("string"), F.lit("")) if family_col else F.lit("")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), family.alias("fam")).where(
        f"t IS NULL OR octet_length(t) <= {int(max_bytes)}"
    )
    keys = src.select("id").join(marks, "id").distinct()
    chosen = None
    for label in (0, 1):
        part = keys.where(F.col("y") == label).orderBy(F.xxhash64("id"), "id").limit(max_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    got = src.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id")).limit(4 * max_per_class).collect()
    count: dict[str, int] = {}
    for r in got:
        if r["y"] == 1:
            count[r["fam"]] = count.get(r["fam"], 0) + 1
    families = sorted((f for f in count if f and count[f] >= FAMILY_ROWS), key=lambda f: (-count[f], f))
    names = [f"{label_col}_{f}" for f in families]
    place = {f: k for k, f in enumerate(families)}
    if len(place) < len(count):  # rows of no family or of a small one
        names.append(f"{label_col} other")
    rows = []
    for r in got:
        y = [0] * len(names)
        if r["y"] == 1:
            y[place.get(r["fam"], len(names) - 1)] = 1
        rows.append((r["t"], [*y, int(r["y"])]))
    return rows, [*names, label_col]


def score_toxicity(
    docs: DataFrame,
    labelled_docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    family_col: str | None = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
    max_per_class: int = 2500,
    max_bytes: int = 32768,
) -> DataFrame:
    """(id_col, category_scores, score, rejected), one row per row of ``docs``.

    Categories are the toxic rows of one family each (``family_col``; used for
    labels only, never as an input) and last the label as a whole, whose
    probability is the score.
    """
    rows, categories = training_rows(
        labelled_docs, labels, label_col, family_col, id_col, text_col, max_per_class, max_bytes
    )
    shared = docs.sparkSession.sparkContext.broadcast(fit_chain(rows, categories))
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                p = chain.probabilities(chain.features(part.column(1).to_pylist()))
                each = pa.array(p.tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), each, pa.array(p[:, -1])], names=["id", "cat", "score"])

    out = src.mapInArrow(run, f"id {kind}, cat array<double>, score double")
    named = F.map_from_arrays(F.array(*[F.lit(c) for c in categories]), F.col("cat"))
    return out.select(
        F.col("id").alias(id_col), named.alias("category_scores"), "score", (F.col("score") >= threshold).alias("rejected")
    )
