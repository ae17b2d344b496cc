"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daybook.llm import (
    bpe,
    chat,
    embed_graph,
    line_rules,
    lm_automaton,
    merkle,
    packing,
    quality_cnn,
    shard_lp,
    simhash_ring,
    term_matrix,
    token_files,
    toxicity_chain,
    winnow,
)
from daybook.llm.common import ship_package, table
from daybook.llm.oracle_sql import OP11_SQL, OP12_SQL, OP13_SQL


def op1_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_graph.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))[0]


def op2_lm_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_automaton.score_documents(table(spark, sf_dir, "documents"))


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), bpe.tokenizer_path())


def op4_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.digests(chat.format_conversations(rows.unionByName(more)))


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity_chain.score_toxicity(docs, docs, table(spark, sf_dir, "labels"))
    return out.withColumn("category_scores", F.to_json("category_scores"))


def op7_simhash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_ring.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_lp.assign_shards(table(spark, sf_dir, "documents"), shards=24)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_files.token_files(table(spark, sf_dir, "documents"), bpe.tokenizer_path())
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_term_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_matrix.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.quality_rules(table(spark, sf_dir, "documents"))


def op13_octopus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit_tampering(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _shipped(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    run.__name__ = query.__name__
    return run


QUERIES = {
    f.__name__: _shipped(f)
    for f in (
        op1_embedding_graph,
        op2_lm_automaton,
        op3_vector_packing,
        op4_chat_round_trip,
        op5_quality_cnn,
        op6_toxicity_chain,
        op7_simhash_ring,
        op8_winnowing,
        op9_label_propagation,
        op10_token_files,
        op11_term_matrix,
        op12_line_rules,
        op13_octopus_manifest,
        pipeline,
    )
}

OP4_SQL = r"""
WITH rows_ AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), shown AS (
    SELECT *,
        contains(text, '\') OR contains(text, '</turn>') OR contains(text, '### ')
            OR contains(role, '\') OR contains(role, '</turn>') OR contains(role, '### ') OR contains(role, ':') AS clash
    FROM rows_
), sized AS (
    SELECT *,
        CASE WHEN clash
             THEN replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '\#\#\# ') ELSE text END AS x,
        CASE WHEN clash
             THEN replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '\#\#\# '), ':', '\:')
             ELSE role END AS r
    FROM shown
)
SELECT conv_id,
    count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(length(r) + length(x) + 14)::BIGINT AS formatted_chars,
    true AS round_trip
FROM sized GROUP BY conv_id
"""

OP8_SQL = r"""
WITH bench AS (
    SELECT item_id::VARCHAR AS item, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w : w <> '') AS w
    FROM benchmark
), cuts AS (
    SELECT DISTINCT item, w[i : i + least(10, len(w)) - 1] AS win, least(10, len(w)) AS n
    FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bench WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM cuts),
texts AS (
    SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
        lambda w : w <> '') AS w
    FROM documents
), spots AS (
    SELECT rid, p, n, w[p : p + n - 1] AS win
    FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM texts, lens WHERE len(w) >= n)
), hits AS (SELECT rid, p, spots.n, item FROM spots JOIN cuts USING (win)),
covered AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM hits) GROUP BY rid),
named AS (
    SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""

ORACLE = {
    "op4_chat_round_trip": OP4_SQL,
    "op8_winnowing": OP8_SQL,
    "op11_term_matrix": OP11_SQL,
    "op12_line_rules": OP12_SQL,
    "op13_octopus_manifest": OP13_SQL,
}
