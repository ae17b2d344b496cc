"""The pipeline's stages, judged each on its own input."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import TEXTS

SF = "/root/testdata/sf0.001"


def test_run_follows_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {(r["doc_id"], r["text"]) for r in docs.collect()}
    df = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        df = stage(spark, df, SF)
        assert df.columns == docs.columns
        now = [(r["doc_id"], r["text"]) for r in df.collect()]
        assert len(set(now)) == len(now) and set(now) <= kept
        if name.startswith("SimHash"):
            want = {k for k, _, c in brute.simhash_groups(sorted(kept)) if k == c}
            assert {k for k, _ in now} == want
        if name.startswith("benchmark"):
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert {k for k, _ in now} == {r[0] for r in brute.contamination(sorted(kept), items) if not r[-1]}
        kept = set(now)
    packed = corpus_pipeline.run(spark, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == {k for k, _ in kept}


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_awkward_rows(spark, stage):
    rows = [(k, t, None, None, None) for k, t in TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert stage(spark, df, SF).count() > 0
    assert stage(spark, df.where("false"), SF).count() == 0


def test_simhash_keeps_one_row_of_each_group(spark):
    fox = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    rows = [
        (None, "a first clean text that has no id and nothing like it"),
        (None, "another clean text, also without an id, about something else"),
        (None, "zebras graze on the wide plain while lions sleep under the old trees"),
        (None, "zebras graze on the wide plain while lions sleep under the old trees"),
        (None, "ZEBRAS graze on the wide plain while lions sleep under the old trees"),
        (3, fox),
        (7, fox.upper()),
        (None, fox),
        (7, "seven again with quite a different text that is alone in its own group"),
        (9, "nine says one thing about the harbour in the early morning light"),
        (9, "nine also says that taxes were raised twice before the war began"),
    ]
    df = spark.createDataFrame([(k, t, None, None, i) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    now = [(r["doc_id"], r["text"]) for r in corpus_pipeline.simhash(spark, df, SF).collect()]
    want = [rows[k] for k in (0, 1, 4, 5, 8, 9, 10)]
    assert sorted(now, key=str) == sorted(want, key=str)
