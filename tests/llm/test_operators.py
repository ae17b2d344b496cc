"""Each operator against a plain form, on awkward rows and on the test tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from daybook.llm import bpe, chat, embed_graph, lm_automaton, packing, quality_cnn, shard_lp, simhash_ring, token_files, toxicity_chain, winnow
from daybook.llm.common import cut
from tests.llm import brute
from tests.llm.conftest import TEXTS

SF = "/root/testdata/sf0.001"


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 1 embeddings


def vector_rows():
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1, None):
        for _ in range(60):
            v = rng.normal(size=8)
            rows.append([v.tolist(), label])
            for _ in range(rng.integers(0, 3)):
                rows.append([(v * rng.uniform(0.5, 2) + rng.normal(size=8) * 0.1).tolist(), label])
    middle = rng.normal(size=8)
    rows += [[(middle + rng.normal(size=8) * 0.1).tolist(), 0] for _ in range(300)]
    rows += [[[1.0] * 8, 1]] * 5 + [[[0.0] * 8, 0]] * 2 + [[None, 0], [[], 0], [[1.0, None] + [0.0] * 6, 0]]
    rows += [[[float("nan")] * 8, 0], [[float("inf")] * 8, 1], [[1e300] * 8, 1], [[1.0, 2.0], 1], [[2.0, 4.0], 1]]
    return [(i, v, label) for i, (v, label) in enumerate(rows)]


def test_vectors_against_all_pairs(spark):
    rows = vector_rows() + [(0, [1.0] * 8, 1), (None, [3.0, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rid", F.lit(1))
    out, audit = embed_graph.near_duplicate_vectors(df, shard_rows=64, sample_rows=200)
    got = rows_of(out, "vec_id", "n_links", "component_id")
    want = sorted(brute.vector_links(rows, 0.93), key=repr)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert np.mean([g == w for g, w in zip(got, want)]) > 0.99
    a = audit.first()
    assert a["found"] >= 0.99 * a["audited"] > 0


def test_vectors_with_many_cells(spark, monkeypatch):
    monkeypatch.setattr(embed_graph, "FLAT_CELLS", 4)
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out, _ = embed_graph.near_duplicate_vectors(df, shard_rows=16)
    got, want = rows_of(out, "vec_id", "n_links", "component_id"), sorted(brute.vector_links(rows, 0.93), key=repr)
    assert all(g[0] == w[0] and g[1] <= w[1] for g, w in zip(got, want))
    assert np.mean([g == w for g, w in zip(got, want)]) > 0.97


def test_links_come_through_the_graph(spark):
    """Without edges the search reaches little beyond its starts, and nothing else finds links."""
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    total = sum(w[1] for w in brute.vector_links(rows, 0.93))
    linked = embed_graph.near_duplicate_vectors(df, shard_rows=512)[0].agg(F.sum("n_links")).first()[0]
    empty = embed_graph.near_duplicate_vectors(df, shard_rows=512, degree=0)[0].agg(F.sum("n_links")).first()[0]
    assert linked >= 0.99 * total and empty < 0.9 * total


def test_range_search_needs_the_edges():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 16)).repeat(8, axis=0) + rng.normal(size=(480, 16)) * 0.08
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    f, starts = x.astype(np.float32), embed_graph._medoids(x)
    g = embed_graph.robust_prune(x, 20, 1.2)
    a, b = np.nonzero(g >= 0)
    both = embed_graph._both_ways(g, a, g[a, b])
    truth = {tuple(p) for p in np.argwhere(f @ f.T >= 0.93)}
    got = {tuple(p) for p in zip(*(v.tolist() for v in embed_graph.range_search(f, both, f, starts, 24, 0.93, 0.05)))}
    none = {tuple(p) for p in zip(*(v.tolist() for v in embed_graph.range_search(f, np.full_like(g, -1), f, starts, 24, 0.93, 0.05)))}
    assert len(got & truth) >= 0.99 * len(truth) and len(none & truth) < 0.1 * len(truth)


def test_nearest_centroids_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    x, c = (embed_graph.unit_rows(__import__("pandas").Series(list(rng.normal(size=(n, 8))))) for n in (500, 60))
    monkeypatch.setattr(embed_graph, "CELLS_AT_A_TIME", 60 * 7)
    want = np.argsort(-(x @ c.T), axis=1, kind="stable")
    for many in (1, 5, 60, 90):
        pieces = list(embed_graph.by_nearness(x, c, many))
        assert [p[0] for p in pieces] == list(range(0, 500, 7))
        assert (np.concatenate([p[2] for p in pieces]) == want[:, :many]).all()
    assert (embed_graph._nearest(x, c) == want[:, 0]).all()
    monkeypatch.setattr(embed_graph, "FLAT_CELLS", 8)
    assert 40 <= len(embed_graph._k_means(x, 60, 3)) <= 60


def scattered_pairs():
    """Pairs of near vectors that lie anywhere, so routes by the nearest cell alone part many of them."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8))
    y = x + rng.normal(size=x.shape) * 0.12
    return [(100 * i, v.tolist(), 0) for i, v in enumerate(np.concatenate([x, y]))]


def test_probes_rise_until_stated_queries_find_their_links(spark):
    rows = scattered_pairs()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out, audit = embed_graph.near_duplicate_vectors(df, shard_rows=8, overlap=1, probes=1)
    truth = sum(w[1] for w in brute.vector_links(rows, 0.93))
    audited, found = audit.first()
    assert audited == pytest.approx(truth * min(1, 1024 / len(rows)), rel=0.1)
    assert found >= 0.99 * audited
    assert sum(r["n_links"] for r in out.collect()) >= 0.97 * truth


def test_links_count_on_both_sides(spark):
    rows = scattered_pairs()
    # a tight group, whose members look no farther than their own cell, and vectors around it
    rng = np.random.default_rng(6)
    middle = rng.normal(size=8)
    rows += [(70_000 + i, (middle + rng.normal(size=8) * s).tolist(), 0) for i, s in enumerate(np.linspace(0.01, 0.5, 150))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out, _ = embed_graph.near_duplicate_vectors(df, shard_rows=8, overlap=1, probes=1, min_recall=0.0)
    got = rows_of(out, "vec_id", "n_links", "component_id")
    sizes = Counter(g[2] for g in got)
    assert not [g for g in got if (g[1] == 0) != (sizes[g[2]] == 1)]
    assert sum(g[1] for g in got) % 2 == 0
    pairs = {g[2]: [] for g in got if sizes[g[2]] == 2}
    for g in got:
        if g[2] in pairs:
            pairs[g[2]].append(g[1])
    assert len(pairs) > 50 and all(p == [1, 1] for p in pairs.values())


def test_vectors_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    out, audit = embed_graph.near_duplicate_vectors(df)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"] and out.count() == 0
    assert tuple(audit.first()) == (0, 0)


def test_range_search_reaches_all_in_range():
    rng = np.random.default_rng(0)
    x = embed_graph.unit_rows(__import__("pandas").Series(list(rng.normal(size=(200, 16))))).astype(np.float32)
    g = embed_graph.robust_prune(x, 12, 1.2)
    assert ((g >= -1) & (g < 200)).all() and all(i not in g[i] for i in range(200))
    a, b = embed_graph.range_search(x, g, x[:50], embed_graph._medoids(x), 200, 0.3, 0.1)
    want = {(i, j) for i, j in zip(*np.nonzero(x[:50] @ x.T >= 0.3))}
    found = set(zip(a.tolist(), b.tolist()))
    assert len(found & want) >= 0.95 * len(want)


# 2 language model


@pytest.mark.parametrize("block_bytes", [8, 50_000, 1 << 21])
def test_language_model_scores(spark, docs, block_bytes):
    """Against plain counts, with texts cut into pieces of any size."""
    texts = [t for t in TEXTS if block_bytes > 8 or len(t[1] or "") < 1000]
    chosen = docs if block_bytes > 8 else docs.where("coalesce(length(text), 0) < 1000")
    out = cut(lm_automaton.score_documents(chosen, block_bytes=block_bytes))
    got = rows_of(out, "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    want = sorted(brute.base_scores(texts), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    scores, plain_scores = rows_of(out, "doc_id", "score"), sorted(brute.model_scores(texts), key=repr)
    assert [s[0] for s in scores] == [s[0] for s in plain_scores]
    assert np.allclose([s[1] for s in scores], [s[1] for s in plain_scores], rtol=1e-9)


def test_language_model_on_documents_equals_plain_counts_and_beats_the_base(spark):
    df = documents(spark)
    out = cut(lm_automaton.score_documents(df, block_bytes=40_000))
    got = {r["doc_id"]: r["score"] for r in out.collect()}
    want = dict(brute.model_scores(plain(df)))
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    held = out.where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]


def block_of(texts, learn=True):
    rows = [(i, learn, b"", t.encode(), True, i) for i, t in enumerate(texts)]
    schema = lm_automaton.PIECE.append(pa.field("id", pa.int64()))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def test_language_model_states_are_distributions():
    g = lm_automaton.grams_of(block_of(["a b a b c", "b a c a b", "c c a b d"]))
    n, v = len(g.x), g.size
    auto = lm_automaton.build(g, g.counts, n, v, (5.0, 2.0))
    unseen = 1 / (n + v + 1)
    root = [10**w for w in auto.arc_weight[: g.size]]
    assert sum(root) + unseen == pytest.approx(1)
    pair_arcs = {(1 + k // g.size, k % g.size): g.size + i for i, k in enumerate(g.pairs.tolist())}
    triple_arcs = {(1 + g.size + k // g.size, k % g.size): g.size + len(g.pairs) + i for i, k in enumerate(g.triples.tolist())}
    arcs = pair_arcs | triple_arcs
    assert np.isfinite(auto.arc_weight).all()

    def step(s, w):
        """(probability, next state), one arc at a time."""
        lost = 0.0
        while s:
            if (a := arcs.get((s, w))) is not None:
                return lost + auto.arc_weight[a], auto.arc_to[a]
            lost, s = lost + auto.fail_weight[s], auto.fail[s]
        return lost + auto.arc_weight[w], auto.arc_to[w]

    for s in range(len(auto.fail)):
        if s and not any(k[0] == s for k in arcs):
            continue  # a state that ends with the end token has no followers
        fall, t = 0.0, s
        while t:
            fall, t = fall + auto.fail_weight[t], auto.fail[t]
        assert sum(10 ** step(s, w)[0] for w in range(g.size)) + 10**fall * unseen == pytest.approx(1), s
    # the traversal in arrays takes the steps of a plain one, also where words and pairs are unknown
    for hide in (None, 3, 2):
        totals = g.counts if hide is None else np.where(g.hashes % np.uint64(hide) == 0, 0, g.counts)
        c = np.empty(len(totals), dtype=np.int64)
        c[g.order] = totals
        c1, c2, c3 = c[: g.size], c[g.size : g.size + len(g.pairs)], c[g.size + len(g.pairs) :]
        c2[(c1[g.pairs // g.size] == 0) | (c1[g.pairs % g.size] == 0)] = 0
        low = np.searchsorted(g.pairs, g.pairs[g.triples // g.size] % g.size * g.size + g.triples % g.size)
        c3[(c2[g.triples // g.size] == 0) | (c2[low] == 0)] = 0
        auto = lm_automaton.build(g, c[g.order], n, v, (5.0, 2.0))
        every = pair_arcs | triple_arcs
        arcs = {k: a for k, a in every.items() if np.isfinite(auto.arc_weight[a])}
        want = []
        for i, j in zip(g.starts, g.starts[1:]):
            state = 0
            for w in g.x[i:j].tolist():
                weight, state = step(state, w)
                want.append(weight)
        assert np.allclose(auto.walk(g), want)


def test_language_model_keeps_a_phrase_at_every_size(spark):
    """After its first word a phrase is as likely in a much larger corpus: its arcs do not go."""
    after = []
    for size in (50, 5000):
        rows = [(7 * k, " ".join(f"w{(k * 31 + j * j) % 997}" for j in range(8))) for k in range(size)]
        rows += [(-k, "seldom heard phrase") for k in range(1, 40)] + [(-100, "seldom"), (-101, "")]
        out = lm_automaton.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), strength=(1.0, 1.0))
        by_id = {r["doc_id"]: r for r in out.where("doc_id < 0").collect()}
        first = by_id[-100]["base_score"] - by_id[-101]["base_score"]
        after.append(by_id[-1]["score"] - first)
    assert min(after) > -0.2 and abs(after[0] - after[1]) < 0.05


def test_language_model_hashes_meet_over_blocks_and_hot_copies(spark):
    rows = [(k, "the same words again" if k % 3 else f"own {k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = dict(rows_of(lm_automaton.score_documents(df, block_bytes=5000), "doc_id", "score"))
    want = dict(brute.model_scores(rows))
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_language_model_empty(spark, no_docs):
    assert lm_automaton.score_documents(no_docs).count() == 0
    held = spark.createDataFrame([(k, "a b") for k in range(40)], "doc_id long, text string")
    held = held.where(F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    r = lm_automaton.score_documents(held).first()
    assert (r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)


# 3 packing


def token_ids(text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.tokenizer_path())
    return t.encode(text or "", add_special_tokens=False).ids + [end]


def check_packing(rows, texts, cap=2048, segments=128, end=1):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append(r)
        by_doc[r["doc_id"]].append(r)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for p in pieces:
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= cap and at & (at - 1) == 0 and len(pieces) <= segments
    want = Counter()
    for key, text in texts:
        ids = token_ids(text, end)
        want[key] += len(ids)
    assert {k: sum(r["length"] for r in v) for k, v in by_doc.items()} == dict(want)
    for key, text in texts:
        if sum(k == key for k, _ in texts) == 1:
            ids, at = token_ids(text, end), 0
            for r in sorted(by_doc[key], key=lambda r: r["start"]):
                part = ids[r["start"] : r["start"] + r["length"]]
                assert r["start"] == at and r["doc_tokens"] == len(ids)
                assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
                at += r["length"]


def test_packing_awkward(spark, docs):
    check_packing(packing.pack(docs, bpe.tokenizer_path()).collect(), TEXTS)


def test_packing_documents(spark):
    df = documents(spark)
    check_packing(packing.pack(df, bpe.tokenizer_path(), max_segments=4).collect(), plain(df), segments=4)


def test_packing_limits(spark):
    df = spark.createDataFrame([(i, "word " * (i % 37 + 1), i % 11) for i in range(300)], "doc_id long, text string, lf int")
    out = packing.pack(df, bpe.tokenizer_path(), loss_from_col="lf", max_tokens=64, max_segments=5, max_loss=40, window=16)
    for seq in out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sum("loss_tokens").alias("l"), F.count("*").alias("s")).collect():
        assert seq["n"] <= 64 and seq["l"] <= 40 and seq["s"] <= 5 and seq["n"] & (seq["n"] - 1) == 0
    assert out.agg(F.sum("length")).first()[0] == sum(len(token_ids("word " * (i % 37 + 1), 1)) for i in range(300))


def test_packing_empty(no_docs):
    assert packing.pack(no_docs, bpe.tokenizer_path()).count() == 0


@pytest.mark.parametrize("text", [t or "" for _, t in TEXTS[:8]] + [TEXTS[11][1], TEXTS[12][1], " a", "a ", "a  b", "x \x1c y", "it's we'll 12 34"])
def test_word_cache_gives_the_tokenizers_ids(text):
    enc = bpe.WordEncoder.of(bpe.tokenizer_path())
    got = bpe.as_u4(enc.encode([text])[0], enc.kind)
    assert np.frombuffer(got, "<u4").tolist() == token_ids(text, 1)[:-1]


# 4 chat


CONVERSATIONS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi"), (1, 1, "assistant", "hi"),
    (2, 0, "user", r"\### Assistant: </turn> ok"), (2, 1, "assistant", "</turn>\n### User: x"),
    (3, 0, None, None), (3, None, "assistant", ""), (3, 2, "a: b\\</turn>", "tail\\"),
    (None, 0, "assistant", "\\\\# <\\/turn> \\#\\#\\# ### "), (4, 0, "assistant", "é 日本\n\n"),
    (5, 0, "### ", ": x"), (5, 1, "assistant", "### User: a</turn>\n"), (6, 0, "assistant", "<" + "/turn" + ">" * 3 + "\\"),
]


def test_chat_very_long_roles_and_texts(spark):
    role, text = "r\\:" * 33_000, "</turn> ### x: \\" * 20_000
    df = spark.createDataFrame([(1, 0, role, text), (1, 1, "assistant", text), (2, 0, "x" * 100_000, "y")], "conv_id long, turn int, role string, text string")
    made = chat.format_conversations(df)
    assert all(r["round_trip"] for r in made.collect())
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(f"{role}\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert got[1]["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and got[2]["loss_chars"] == 0


def test_chat_digest_reads_the_mask(spark):
    """The loss digest is what the mask cuts out, so a mask that is off by one character changes it."""
    df = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "general reply")], "conv_id long, turn int, role string, text string")
    made = chat.format_conversations(df)
    moved = made.withColumn("loss_spans", F.transform("loss_spans", lambda p: F.struct((p["start"] + 1).alias("start"), p["length"].alias("length"))))
    right, wrong = chat.digests(made).first(), chat.digests(moved).first()
    assert right["loss_sha256"] == hashlib.sha256(b"general reply").hexdigest() != wrong["loss_sha256"]
    assert wrong["loss_sha256"] == hashlib.sha256(b"eneral reply<").hexdigest()


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CONVERSATIONS, "conv_id long, turn int, role string, text string").withColumn("same", F.lit(1))
    made = chat.format_conversations(df)
    groups = defaultdict(list)
    for c, t, r, x in CONVERSATIONS:
        groups[c].append(((t is not None, t or 0, r or "", x or ""), r or "", x or ""))
    for row in made.collect():
        turns = [g[1:] for g in sorted(groups[row["conv_id"]])]
        said = [x for r, x in turns if r == "assistant"]
        masked = [row["formatted"][s["start"] : s["start"] + s["length"]] for s in row["loss_spans"]]
        assert row["round_trip"] and row["formatted"].count("</turn>") == len(turns) == row["formatted"].count("### ")
        assert [m.replace("\\", "") for m in masked] == [x.replace("\\", "") for x in said]
    for row in chat.digests(made).collect():
        turns = [g[1:] for g in sorted(groups[row["conv_id"]])]
        loss = "".join(x for r, x in turns if r == "assistant")
        assert row["n_turns"] == len(turns) and row["loss_chars"] == len(loss)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.format_conversations(df.where("false"))).count() == 0


# 5 quality


def test_quality_learns_and_is_whole(spark):
    good, bad = "the rain in spain falls mainly on the plain ", "THE!! RAIN$$$ IN%%% "
    rows = [(i, (bad if i % 4 == 0 else good)[i % 5 :] * (i % 7 + 1)) for i in range(1200)]
    rows += [(5000, good * 3000 + bad * 30), (5001, None), (5002, ""), (None, good), (1, good)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    marks = [(i, int(i % 4 != 0)) for i in range(1200)] + [(5000, None), (None, 0), (7000, 1), (3, 7)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality_cnn.score_quality(df, labels).collect()}
    held = [i for i in range(1200) if brute.crc_mod(i, 3) == 1]
    assert all(out[i]["held_out"] for i in held)
    assert np.mean([out[i]["predicted"] == (i % 4 != 0) for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out.values()) and len(out) == 1204


def test_quality_without_labels(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_cnn.score_quality(docs, none).collect()} == {0.5}
    assert quality_cnn.score_quality(no_docs, none).count() == 0


def test_chunks_cover_everything():
    for n in (0, 1, 16, 17, 240, 256, 257, 496, 497, 5000):
        data = bytes(np.random.default_rng(n).integers(1, 255, n, dtype=np.uint8))
        c = quality_cnn.chunks(data)
        step = quality_cnn.CHUNK - quality_cnn.OVERLAP
        back = b"".join(bytes(x[:step]) for x in c) + bytes(c[-1][step:])
        assert back.rstrip(b"\0") == data


def test_cnn_gradients():
    rng = np.random.default_rng(1)
    m = quality_cnn._start(rng)
    docs = [quality_cnn.chunks(bytes(rng.integers(97, 110, n, dtype=np.uint8))) for n in (30, 600, 900)]
    y = np.array([1.0, 0.0, 1.0])
    m.tables = lambda: [m.embed @ m.conv[k] for k in range(quality_cnn.WIDTH)]

    def loss():
        t, out = m.tables(), 0.0
        for d, v in zip(docs, y):
            h = np.maximum(m.pooled(d, t)[0], 0)
            p = 1 / (1 + np.exp(-(h.max(0) @ m.out[: quality_cnn.FILTERS] + h.mean(0) @ m.out[quality_cnn.FILTERS :] + m.out_bias)))
            out -= np.log(p if v else 1 - p) / 3
        return out

    g = quality_cnn._gradients(m, docs, y)
    for array, grad, at in ((m.conv, g[1], (2, 1, 3)), (m.embed, g[0], (100, 2)), (m.out, g[3], (5,)), (m.bias, g[2], (4,))):
        old, eps = array[at], 1e-5
        array[at] = old + eps
        up = loss()
        array[at] = old - eps
        down = loss()
        array[at] = old
        assert grad[at] == pytest.approx((up - down) / 2 / eps, rel=1e-3, abs=1e-7)


# 6 toxicity


def test_toxicity_chain(spark, no_docs):
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abdeghilmnorstu"), 6)) for _ in range(400)]
    rows, marks = [], []
    for i in range(1600):
        lang = "en" if i % 2 else "de"
        words = list(rng.choice(vocab, rng.integers(5, 300)))
        if toxic := i % 8 < 2:
            words.insert(int(rng.integers(0, len(words))), "zidiot" if lang == "en" else "Zlowei" + "".join(rng.choice(list("abc"), 3)))
        rows.append((i, " ".join(words), lang))
        if i < 1200:
            marks.append((i, int(toxic)))
    rows += [(9000, None, "en"), (9001, "", None), (None, "plain", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(0))
    labels = spark.createDataFrame(marks + [(None, 1), (3, None), (7, 5)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity_chain.score_toxicity(df, df, labels).collect()}
    assert set(out[5]["category_scores"]) == {"toxic_de", "toxic_en", "toxic"}
    assert all(out[i]["rejected"] == (i % 8 < 2) for i in range(1200, 1600))
    assert not any(out[k]["rejected"] for k in (9000, 9001, None))
    assert out[1201]["category_scores"]["toxic_en"] > 0.5 > out[1201]["category_scores"]["toxic_de"]
    assert toxicity_chain.score_toxicity(no_docs.withColumn("lang", F.lit("x")), df, labels).count() == 0
    assert not toxicity_chain.score_toxicity(df, df, labels.where("false")).where("rejected").count()


def chain_rows(n=120):
    """Words of a row's own, so that a model can learn its training rows by heart and nothing about others."""
    rng = np.random.default_rng(4)
    out = []
    for k in range(n):
        y = int(rng.integers(2))
        own = " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(6))
        out.append((f"{own} {'mostly' if y and rng.random() < 0.6 else 'seldom'}", [y, int(rng.random() < 0.9) if y else int(rng.random() < 0.1)]))
    return out


def test_chain_uses_out_of_fold_probabilities():
    rows = chain_rows()
    chain = toxicity_chain.fit_chain(rows, ["a", "b"], folds=3)
    x = chain.features([t for t, _ in rows])
    y = np.array([r for _, r in rows], dtype=float)
    outside, fold = np.zeros(len(rows)), np.arange(len(rows)) % 3
    for f in range(3):
        w, bias = toxicity_chain._logistic(x[fold != f], y[fold != f, 0])
        outside[fold == f] = toxicity_chain._sigmoid(x[fold == f] @ w + bias)
    inside = chain.probabilities(x)[:, 0]
    learned = lambda p: toxicity_chain._logistic(np.concatenate([x, p[:, None].astype(np.float32)], axis=1), y[:, 1])[0]
    assert np.allclose(chain.weights[1], learned(outside), atol=1e-6)
    assert not np.allclose(chain.weights[1], learned(inside), atol=1e-3)


def test_chain_scores_equal_a_plain_form():
    rows = chain_rows()
    chain = toxicity_chain.fit_chain(rows, ["a", "b"])
    known = [int(g).to_bytes(5, "big") for g in chain.grams]
    texts = [t for t, _ in rows[:10]] + ["", None, "MOSTLY! " * 500, "é" * 9]
    for t, got in zip(texts, chain.probabilities(chain.features(texts))):
        raw = b" " + (t or "").encode() + b" "
        low = bytes(c + 32 if 65 <= c <= 90 else c if c == 0 or c > 127 or chr(c).isalnum() else 32 for c in raw)
        p = []
        for w, bias in zip(chain.weights, chain.bias):
            z = bias + sum(v for g, v in zip(known, w) if g in low) + sum(a * b for a, b in zip(w[len(known) :], p))
            p.append(1 / (1 + np.exp(-z)))
        assert np.allclose(got, p, atol=1e-5)


def test_every_family_has_a_category(spark):
    rows = [(k, f"bad word{k % 9} text {k}" if k % 2 else f"fine text {k}", f"l{k % 9}" if k < 180 else ("rare" if k < 184 else None), k) for k in range(190)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, extra int")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    out = toxicity_chain.score_toxicity(docs, docs, labels)
    names = set(out.first()["category_scores"])
    assert names == {f"toxic_l{k}" for k in range(9)} | {"toxic other", "toxic"}
    alone = toxicity_chain.score_toxicity(docs.drop("lang"), docs.drop("lang"), labels, family_col=None)
    assert set(alone.first()["category_scores"]) == {"toxic other", "toxic"}


def test_simhash_awkward(docs):
    out = simhash_ring.near_duplicates(docs)
    assert rows_of(out, "doc_id", "fingerprint", "component_id") == sorted(brute.simhash_groups(TEXTS), key=repr)


def test_simhash_documents(spark):
    df = documents(spark)
    out = simhash_ring.near_duplicates(df)
    assert rows_of(out, "doc_id", "fingerprint", "component_id") == sorted(brute.simhash_groups(plain(df)), key=repr)


@pytest.mark.parametrize("bits,block", [(1, 1024), (3, 8), (4, 8), (4, 1024), (7, 16)])
def test_simhash_links_are_exact(spark, bits, block):
    rng = np.random.default_rng(bits)
    fps = set()
    for _ in range(40):
        f = int(rng.integers(0, 2**63)) * 2 + 1
        for _ in range(25):
            g = f
            for b in rng.choice(64, rng.integers(0, bits + 2), replace=False):
                g ^= 1 << int(b)
            fps.add(g)
            f = g if rng.random() < 0.3 else f
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = [(r["u"], r["v"]) for r in simhash_ring.fingerprint_links(df, bits, block).collect()]
    at = {f: i for i, f in enumerate(signed)}
    want = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= bits]
    assert brute.components(len(fps), [(at[a], at[b]) for a, b in got]) == brute.components(len(fps), want)


def test_simhash_empty(no_docs):
    assert simhash_ring.near_duplicates(no_docs).count() == 0


# 8 winnowing


ITEMS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"), (2, "Short item HERE"), (2, "Short item HERE"),
    (3, ""), (4, None), (5, "!!! ..."), (None, "beta gamma delta epsilon zeta eta theta iota kappa lambda"), (10, "a a a a a a a a a a a a"),
    (6, "Σας Éa İstanbul K one two three four five six seven"),
]
BENCH_DOCS = [
    (1, "x ALPHA, beta; gamma delta epsilon zeta eta theta iota kappa lambda mu y"), (2, "alpha beta gamma delta epsilon zeta eta theta iota"),
    (3, "a short item here and a short, item. here"), (4, None), (5, ""), (None, "short item here"), (6, "a " * 500), (7, "a " * 9),
    (8, "Σας Éa İstanbul K one two three four five six seven"), (9, "Σας éa İstanbul K one two three four five six seven"),
    (1, "x ALPHA, beta; gamma delta epsilon zeta eta theta iota kappa lambda mu y"), (12, "w " * 3000 + "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3),
]


def contaminated(out):
    out = out.withColumn("n_items", F.size("items")).withColumn("sha", F.sha2(F.array_join("items", ","), 256))
    return rows_of(out, "doc_id", "n_words", "n_hit", "n_items", "sha", "contaminated")


@pytest.mark.parametrize("k", [1, 3, 5, 10])
def test_winnowing_awkward(spark, k):
    docs = spark.createDataFrame(BENCH_DOCS, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("tid", F.lit(2))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("w", F.lit(1))
    named = [(i, t) for i, t in ITEMS if i is not None]
    got = {r[0]: r for r in contaminated(winnow.contamination(docs, items, k=k))}
    want = {r[0]: r for r in brute.contamination(BENCH_DOCS, named)}
    assert got == want


def test_winnowing_documents(spark):
    df, items = documents(spark), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute.contamination(plain(df), [(r["item_id"], r["text"]) for r in items.collect()])
    assert any(w[-1] for w in want)
    assert contaminated(winnow.contamination(df, items)) == sorted(want, key=repr)
    assert contaminated(winnow.contamination(df, items, broadcast_rows=10)) == sorted(want, key=repr)


def test_winnowing_empty(spark, docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert winnow.contamination(no_docs, items).count() == 0
    assert not winnow.contamination(docs, items.where("false")).where("contaminated").count()


# 9 sharding


def check_shards(rows, n, shards):
    counts = Counter(r["shard"] for r in rows)
    assert len(rows) == n and max(counts.values()) - min([*counts.values()] if len(counts) == shards else [0]) <= 1
    for s, c in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(c))


def test_sharding_awkward(spark, docs, no_docs):
    rows = shard_lp.assign_shards(docs, 4).collect()
    check_shards(rows, len(TEXTS), 4)
    want = Counter((k, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for k, t in TEXTS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert shard_lp.assign_shards(no_docs).count() == 0


def test_sharding_keeps_links(spark):
    rng = np.random.default_rng(1)
    texts = [f"group {g}" for g in range(150) for _ in range(int(rng.integers(2, 7)))] + ["hot"] * 700 + [f"single {i}" for i in range(900)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = shard_lp.assign_shards(df, 8).collect()
    check_shards(rows, len(texts), 8)
    where = defaultdict(set)
    for r in rows:
        where[texts[r["doc_id"]]].add(r["shard"])
    assert np.mean([len(where[f"group {g}"]) == 1 for g in range(150)]) > 0.9


# 10 token files


def test_token_files_awkward(spark, docs, no_docs, tmp_path):
    path = f"{tmp_path}/files"
    out = token_files.token_files(docs, bpe.tokenizer_path(), path=path)
    got = sorted(out.collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((k for k, _ in TEXTS), key=lambda k: (k is not None, k))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    want = Counter()
    for k, t in TEXTS:
        ids = token_ids(t, 2)
        want[(k, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    # keyed access over the raw files
    import glob

    shards = [s for f in glob.glob(f"{path}/part-*") for _, s in token_files.shards_of(open(f, "rb").read())]
    hits = [x for s in shards if (x := s.get(3)) is not None]
    assert len(hits) == 1 and hits[0].tolist() == token_ids(TEXTS[2][1], 2)
    assert all(s.get(123456789) is None for s in shards)
    assert token_files.token_files(no_docs, bpe.tokenizer_path(), path=f"{tmp_path}/none").count() == 0


def test_get_stays_within_the_keys_rows():
    ids = [np.array([k], dtype="<u2").tobytes() for k in range(5)]
    s = token_files.Shard(token_files.encode_shard(0, [1, 2, 2, 2, 9], ids, 2))
    assert s.get(1).tolist() == [0] and s.get(1, 1) is None and s.get(2, 2).tolist() == [3] and s.get(2, 3) is None
    assert s.get(9).tolist() == [4] and s.get(9, 1) is None and s.get(3) is None and s.get(2, -1) is None


def test_lookup_over_several_shards_with_a_hot_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_IDS", 700)
    rows = [(7, f"hot text {k % 90}") for k in range(400)] + [(k, f"own text {k}") for k in range(-60, 60)]
    rows += [(-(2**63), "the lowest id"), (None, "no id"), (None, "no id either")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path = f"{tmp_path}/files"
    out = token_files.token_files(df, bpe.tokenizer_path(), path=path).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in out) == sorted((r[0] is not None, r[0] or 0) for r in rows)
    assert sorted(r["nth"] for r in out if r["doc_id"] == 7) == list(range(401))
    assert sorted(r["nth"] for r in out if r["doc_id"] is None) == [0, 1]
    directory = token_files.shard_directory(spark, path)
    assert directory.where("first_key <= 7 AND last_key >= 7").count() > 2
    asked = spark.createDataFrame([(7,), (7,), (-60,), (59,), (12345,), (-(2**63),), (None,)], "key long")
    for slice_ in (1 << 20, 4):
        monkeypatch.setattr(token_files, "DIRECTORY_AT_A_TIME", slice_)
        got = token_files.lookup(spark, path, asked).collect()
        want = Counter((k, tuple(token_ids(t, 2))) for k, t in rows if k in (7, -60, 59, -(2**63)))
        assert Counter((r["key"], tuple(r["ids"])) for r in got) == want
        assert sorted(r["nth"] for r in got if r["key"] == 7) == list(range(401))
    assert token_files.lookup(spark, path, asked.where("key = 12345")).count() == 0
    with pytest.raises(ValueError):
        token_files.token_files(df.withColumn("doc_id", F.col("doc_id").cast("string")), bpe.tokenizer_path())


@pytest.mark.parametrize("seed", range(3))
def test_encoder_gives_the_plain_calls_ids(seed):
    from tokenizers import Tokenizer

    enc, plain_call = bpe.WordEncoder.of(bpe.tokenizer_path()), Tokenizer.from_file(bpe.tokenizer_path())
    rng = np.random.default_rng(seed)
    parts = ["a", "bc", " ", " ", ".", ",", "\n", "\n\n", "'s", "1", "é", "ñandú", "Ω", "漢", "\t", "\x85", "<|endoftext|>", "%$", "\u200b", "e\u0301"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 15))) for _ in range(5000)]
    texts += ["a <|endoftext|> b", "x.\nY, z.\n\nW", "one, two.\nThree"]
    got = [np.frombuffer(bpe.as_u4(x, enc.kind), "<u4").tolist() for x in enc.encode(texts)]
    assert got == [e.ids for e in plain_call.encode_batch(texts, add_special_tokens=False)]
    assert got[5000] == [64, 220, 50256, 275]


@pytest.mark.parametrize("n", [1, 2, 3, 100, 5000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(2**40, n, replace=False).astype(np.uint64)
    d, seed = token_files.build_index(keys)
    assert sorted(token_files._slots(keys, d, len(d), n, seed).tolist()) == list(range(n))
