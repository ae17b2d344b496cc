"""Benchmark decontamination by winnowing, in DataFrame functions only.

Fingerprints: of the hashes of all ``k`` consecutive words, the smallest in
every run of ``window - k + 1``.  Two texts that share ``window`` words share
such a run and so its smallest hash: no shared span of that length is missed.
Benchmark items give one row per distinct window of words, with the place of
its fingerprint; items of fewer words are one window, fingerprinted whole.

1. Distinct fingerprints of every text meet the benchmark's: candidate texts.
2. In candidate texts each place of a met fingerprint is extended to the whole
   window and compared word by word.  Hit words are counted once each.

Hashes are taken of words lowered by ``lower``, which never tells apart what
lowering A-Z alone makes equal; the final comparison lowers A-Z alone.
Results are computed per distinct text (by a 256-bit hash), so copies cost one
join row each, and no hot fingerprint is ever expanded into pairs of texts.

Results for odd input: a null or empty text has no words and is clean; items
without words match nothing; repeated items or windows count once per item id;
rows with a null item id match but cannot be named; an empty table on either
side gives zeros or an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import broadcast_if_small, cut

#: What stands between words: ASCII other than digits and letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words as they stand (case kept)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), NOT_WORD), lambda w: w != "")


def _hashes(w: str, n: int) -> Column:
    """Hash of the n words from each place on, of an array column of lowered words."""
    col = F.col(w)
    places = F.when(F.size(col) >= n, F.sequence(F.lit(1), F.size(col) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(*[F.get(col, i + (j - 1)) for j in range(n)]))


def _run_minima(h: str, run: int) -> Column:
    col = F.col(h)
    if run == 1:
        return col
    places = F.when(F.size(col) >= run, F.sequence(F.lit(0), F.size(col) - run)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.least(*[F.get(col, i + j) for j in range(run)]))


def _lowered(c: Column) -> Column:
    return F.transform(c, F.lower)


def benchmark_windows(items: DataFrame, item_col: str, text_col: str, window: int, k: int) -> DataFrame:
    """(item, w: window of A-Z-lowered words, n, fp, at: place of the fingerprint in the window)."""
    w = F.col("w")
    base = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col).cast("string")).alias("w"))
    cuts = F.when(F.size(w) >= window, F.sequence(F.lit(1), F.size(w) - window + 1)).otherwise(
        F.when(F.size(w) > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    )
    each = base.select("item", F.explode(F.transform(cuts, lambda i: F.slice(w, i, window))).alias("w"))
    each = each.select("item", F.transform("w", lambda x: F.translate(x, UPPER, LOWER)).alias("w")).distinct()
    h = each.withColumn("low", _lowered(F.col("w"))).withColumn("n", F.size("w")).withColumn("h", _hashes("low", k))
    whole = F.xxhash64(F.lit(0), F.col("n"), F.array_join("low", " "))
    fp = F.when(F.col("n") == window, F.array_min("h")).otherwise(whole)
    at = F.when(F.col("n") == window, F.array_position("h", F.array_min("h")) - 1).otherwise(0)
    return h.select("item", "w", "n", fp.alias("fp"), at.cast("int").alias("at"))


def _short_hashes(n: int) -> Column:
    low = F.col("low")
    places = F.when(F.size(low) >= n, F.sequence(F.lit(1), F.size(low) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.lit(0), F.lit(n), F.array_join(F.slice(low, i, n), " ")))


def _short_places(n: int) -> Column:
    return F.transform(_short_hashes(n), lambda x, i: F.struct(x.alias("fp"), i.alias("p"), F.lit(n).alias("n")))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    k: int = 5,
    broadcast_rows: int = 2_000_000,
) -> DataFrame:
    """(id_col, n_words, n_hit, items: sorted distinct item ids, contaminated), one row per row of ``docs``."""
    if not 1 <= k <= window:
        raise ValueError("k must be between 1 and window")
    bench = cut(benchmark_windows(items, item_col, item_text_col, window, k))
    # at most window - 1 different lengths
    short = sorted(r[0] for r in bench.where(F.col("n") < window).select("n").distinct().collect())
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).withColumn(
        "tid", F.sha2(F.coalesce("t", F.lit("")), 256)
    )
    run = window - k + 1

    def arrays(df: DataFrame, *keep: str) -> DataFrame:
        low = df.select(*keep, _lowered(words(F.col("t"))).alias("low"))
        return low.withColumn("h", _hashes("low", k))

    fps = F.array_distinct(F.concat(F.array_distinct(_run_minima("h", run)), *[_short_hashes(n) for n in short]))
    marks = arrays(src, "tid").select("tid", F.explode(fps).alias("fp"))
    known = broadcast_if_small(bench.select("fp").distinct(), broadcast_rows)
    met = cut(marks.join(known, "fp", "left_semi").distinct().groupBy("tid").agg(F.collect_list("fp").alias("fps")))

    # candidate texts once each, with their places of met fingerprints and the words around them
    small = broadcast_if_small(met, broadcast_rows // 10)
    cand = src.join(small, "tid").groupBy("tid").agg(F.first("t").alias("t"), F.first("fps").alias("fps"))
    exact = cand.select("tid", "fps", words(F.col("t")).alias("raw")).withColumn("low", _lowered(F.col("raw")))
    exact = exact.withColumn("h", _hashes("low", k))
    found = [F.transform(F.col("h"), lambda x, i: F.struct(x.alias("fp"), i.alias("p"), F.lit(window).alias("n")))]
    found += [_short_places(n) for n in short]
    places = F.filter(F.concat(*found), lambda s: F.array_contains("fps", s["fp"]))
    around = exact.select("tid", "raw", F.explode(places).alias("s")).select(
        "tid",
        F.col("s.fp").alias("fp"),
        F.col("s.n").alias("n"),
        F.col("s.p").alias("p"),
        F.least(F.col("s.p"), F.lit(window - 1)).alias("before"),
        F.transform(
            F.slice("raw", F.greatest(F.col("s.p") - window + 2, F.lit(1)), F.lit(2 * window - 1)),
            lambda x: F.translate(x, UPPER, LOWER),
        ).alias("near"),
    )
    spans = around.join(broadcast_if_small(bench, broadcast_rows // 10), ["fp", "n"])
    first = F.col("before") - F.col("at")
    same = (first >= 0) & (F.slice("near", F.greatest(first, F.lit(0)) + 1, F.col("n")) == F.col("w"))
    hits = cut(spans.where(same).select("tid", "item", (F.col("p") - F.col("at")).alias("begin"), "n").distinct())
    n_hit = (
        hits.select("tid", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("n") - 1)).alias("p"))
        .distinct()
        .groupBy("tid")
        .agg(F.count("*").alias("n_hit"))
    )
    named = hits.select("tid", "item").distinct().groupBy("tid").agg(F.sort_array(F.collect_list("item")).alias("items"))
    found_in = broadcast_if_small(cut(n_hit.join(named, "tid", "left")), broadcast_rows // 10)
    sizes = src.select("id", "tid", F.size(words(F.col("t"))).cast("long").alias("n_words"))
    return sizes.join(found_in, "tid", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
