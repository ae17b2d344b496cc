"""Training-data pipeline over ``documents``.

Each stage calls one operator of ``daybook.llm``, takes (spark, docs, sf_dir)
and is judged on all that its predecessor kept.  All but the last return the
columns of documents; other columns are dropped at the first stage.  ``run`` writes each stage's result as Parquet into the
shared checkpoint folder and reads it back as the next stage's input.

Filtering stages keep every row that their operator does not reject; rows with
a null id are kept by the first two stages and by decontamination only on their own text's score.  Of each
near-duplicate group exactly one row stays: the one with the lowest id, null ids last, then the first in
text order and in that of the other columns.  Groups are never merged by an id: rows with a null id, or with one id
and different texts, belong each to the group of their own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import bpe, packing, quality_cnn, simhash_ring, toxicity_chain, winnow
from daybook.llm.common import ship_package, table
from daybook.session import new_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[c for c in COLUMNS if c in docs.columns])


def _keyed(docs: DataFrame) -> DataFrame:
    """Operators score per row; equal (id, text) rows get equal scores, so the 128-bit hash of both names a row's decision."""
    shown = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit("")))
    return docs.withColumn("_key", F.md5(shown))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier chain rejects."""
    ship_package(spark)
    keyed = _keyed(_documents(docs))
    scored = toxicity_chain.score_toxicity(
        keyed.drop("doc_id").withColumnRenamed("_key", "doc_id"),
        docs,
        table(spark, sf_dir, "labels"),
        family_col="lang" if "lang" in docs.columns else None,
    )
    out = scored.where("rejected").select(F.col("doc_id").alias("_key")).distinct()
    return keyed.join(out, "_key", "left_anti").drop("_key")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose quality score is below a half."""
    ship_package(spark)
    keyed = _keyed(_documents(docs))
    rows, prior = quality_cnn.labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", "doc_id", "text", 2500, 16384)
    scored = quality_cnn.score_rows(keyed, quality_cnn.fit(rows, prior), "_key", "text")
    out = scored.where("score < 0.5").select("_key").distinct()
    return keyed.join(out, "_key", "left_anti").drop("_key")


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group."""
    ship_package(spark)
    keyed = _keyed(_documents(docs))
    # rows are told apart by _key, so the smallest key of a component names that component alone
    groups = simhash_ring.near_duplicates(keyed, "_key", shingle=4, max_bits=4).select("_key", "component_id").distinct()
    columns = [c for c in keyed.columns if c not in ("_key", "doc_id")]
    # a minimum, so a large group leaves each task as one row
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_no_id"), "doc_id", "text", *[c for c in columns if c != "text"]))
    one = keyed.join(groups, "_key").groupBy("component_id").agg(first.alias("_row"))
    return one.select(*[F.col("_row")[c].alias(c) for c in keyed.columns if c != "_key"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    ship_package(spark)
    keyed = _keyed(_documents(docs))
    marked = winnow.contamination(keyed, table(spark, sf_dir, "benchmark"), id_col="_key")
    out = marked.where("contaminated").select("_key").distinct()
    return keyed.join(out, "_key", "left_anti").drop("_key")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of all documents that are left."""
    ship_package(spark)
    return packing.pack(docs, bpe.tokenizer_path())


STAGES = [
    ("toxicity", toxicity),
    ("quality classifier", quality),
    ("SimHash near-dedup", simhash),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

#: SQL cannot express the classifiers or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = new_path(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
