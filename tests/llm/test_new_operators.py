"""Filter audit, line rules and Merkle manifest against direct forms, on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from daybook.llm import common, line_rules, merkle, term_matrix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows() -> list[tuple]:
    long_text = " ".join(f"w{i % 9000}" for i in range(40_000))
    rows = [
        (1, "", "en", "a", 0),
        (2, None, "en", "a", None),
        (None, "no id here " * 20, None, None, 5),
        (None, "no id here " * 20, None, None, 5),
        (5, "SHOUT " * 120, "", "a", 1),
        (5, "SHOUT " * 120, "", "a", 1),
        (6, "SHOUT " * 120, "é", "b", 1),
        (7, "a#b", "é", "b", 3),
        (8, long_text, "en", "b", len(long_text)),
        (9, "tabs\tand\x0bfeeds\x0c\r\n\n  wide space", "z", "b", 9),
        (-3, "line one here\nline one here\n\nLine  ONE here\nx", "z", None, 2),
    ]
    for i in range(10, 40):
        own = " ".join(f"own{'abcdefghij'[i % 10]}{'klm'[i // 10 - 1]}{j}" for j in range(30))
        rows.append((i, f"Shared boiler plate 20{i:02d}\n{own}", "en", "hot", i))
    for i in range(40, 52):
        rows.append((i, " ".join(f"plate{j}" for j in range(40)) + f"\nown {i} " * 2, "fr", "hot", i))
    rows += [(i, "the very same copied text " * 30, "fr", "hot", i) for i in range(60, 90)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = odd_rows()
    return spark.createDataFrame(rows, DOCS).withColumns(
        {"word": F.lit("clash"), "tree": F.lit(1), "shard": F.lit(2), "id": F.lit("x"), "lines": F.lit(0), "place": F.lit(3), "part": F.lit("q")}
    )


def brute_fails(rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, lang, *_ in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = [
            len(words) < 100,
            100 * len(set(words)) < 80 * len(words),
            100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            bool(re.search(r"[#$%&*|]", t)),
            i is not None and first[t] < i,
        ]
        yield i, lang or "", {f for f, x in zip("ABCDE", fails) if x}


def brute_audit(rows, labels):
    marks = {}
    for i, q, x in labels:
        if i is not None:
            g, t = marks.get(i, (0, 0))
            marks[i] = (max(g, int(q == 1)), max(t, int(x == 1)))
    known = list(brute_fails(rows))
    out, shapley = {}, {}
    for part in {p for _, p, _ in known}:
        mine = [(i, f) for i, p, f in known if p == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                here = [x for x in left if f in x[1]]
                gone = [x for x in mine if x not in left]
                failing = sum(f in x[1] for x in mine)
                left = [x for x in left if f not in x[1]]
                out[(part, "".join(order), step)] = (
                    len(left), len(here), failing - len(here), sum(x[1] == {f} for x in mine),
                    sum(marks.get(x[0], (0, 0))[0] for x in here), sum(marks.get(x[0], (0, 0))[1] for x in here),
                )
                shapley[(part, f)] = shapley.get((part, f), 0) + len(here)
    return {k: (*v, shapley[(k[0], k[1][k[2] - 1])]) for k, v in out.items()}


def test_filter_audit_equals_direct_form(spark, docs):
    labels = [(1, 1, 0), (5, 0, 1), (5, 1, None), (6, None, 1), (None, 1, 1), (60, 1, 1), (61, 1, 0), (999, 1, 1)]
    got = term_matrix.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute_audit(odd_rows(), labels)
    assert len(got) == len(want) == 600 * 5
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == want


def test_matrix_is_csr_over_one_dictionary(spark, docs, monkeypatch):
    monkeypatch.setattr(term_matrix, "BLOCK_TOKENS", 500)
    m = term_matrix.term_matrix(docs)
    words = {r["word_id"]: bytes(r["word"]).decode() for r in m.dictionary.collect()}
    assert len(set(words.values())) == len(words) == m.dictionary.count()
    got = []
    shards = m.shards.collect()
    for s in shards:
        indptr, indices = np.frombuffer(s["indptr"], "<i8"), np.frombuffer(s["indices"], "<i8")
        data = np.frombuffer(s["data"], "<i4")
        for k, i in enumerate(s["ids"]):
            own = indices[indptr[k] : indptr[k + 1]]
            assert (np.diff(own) > 0).all()
            got.append((i, {words[w]: int(c) for w, c in zip(own, data[indptr[k] : indptr[k + 1]])}))
    want = [(i, {w: WORD.findall(t or "").count(w) for w in set(WORD.findall(t or ""))}) for i, t, *_ in odd_rows() if i != 8]
    order = lambda x: (str(x[0]), sorted(x[1].items()))
    assert sorted((g for g in got if g[0] != 8), key=order) == sorted(want, key=order)
    assert sum(next(g[1] for g in got if g[0] == 8).values()) == 40_000


def test_filter_audit_of_an_empty_table(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert term_matrix.audit_filters(docs.limit(0), labels).count() == 0


def brute_rules(rows, max_docs):
    norm = lambda line: re.sub("[0-9]", "0", " ".join(WORD.findall(line)).translate({c: c + 32 for c in range(65, 91)}))
    texts = {}
    for _, t, _, host, _ in rows:
        for line in {norm(x) for x in (t or "").split("\n")} - {""}:
            texts.setdefault((host, line), set()).add(t)
    for i, t, _, host, _ in rows:
        t = t or ""
        words = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        wins = [tuple(words[p : p + 8]) for p in range(len(words) - 7)]
        count = {}
        for x in wins:
            count[x] = count.get(x, 0) + 1
        inside = {p + k for p, x in enumerate(wins) if count[x] > 1 for k in range(8)}
        gone = sum(len(WORD.findall(x)) for x in lines if len(texts[(host, norm(x))]) > max_docs)
        n = len(words)
        failed = n < 20 or 100 * len(inside) > 30 * n
        depleted = n - gone < 20 or 100 * gone > 50 * n
        yield (
            i, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), gone, failed,
            not failed and not depleted,
        )


def test_line_rules_equal_direct_form(docs):
    got = line_rules.quality_rules(docs).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = list(brute_rules(odd_rows(), 6))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    kept = {r[0]: r[-1] for r in want}
    assert all(kept[i] for i in range(10, 40))  # a shared line alone does not deplete a document
    assert not any(kept[i] for i in range(40, 52))  # a document that is mostly shared lines is depleted


def test_copies_of_a_whole_document_do_not_remove_its_lines(spark):
    text = "\n".join(" ".join(f"w{k}x{j}" for j in range(10)) for k in range(5))
    rows = [(i, text, "en", "h", 0) for i in range(50)]
    got = line_rules.quality_rules(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 50 and all(r["kept"] for r in got)


@pytest.mark.parametrize("seed", range(6))
def test_repeated_windows_are_exact(seed):
    rng = np.random.default_rng(seed)
    words = [b"%d" % x for x in rng.integers(0, 2 + seed, 60 + 7 * seed)]
    words = words + words[5:20]
    wins = [tuple(words[p : p + 8]) for p in range(len(words) - 7)]
    inside = {p + k for p, x in enumerate(wins) if wins.count(x) > 1 for k in range(8)}
    assert line_rules.repeat_words(words) == len(inside)


def test_line_rules_of_an_empty_table(docs):
    assert line_rules.quality_rules(docs.limit(0)).count() == 0


def h(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def brute_leaf(i, text, lang, source, n):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)))


def brute_tree(leaves):
    """(top, per leaf the (left, right) siblings by level)."""
    proofs, owners = [[] for _ in leaves], [[k] for k in range(len(leaves))]
    while len(leaves) > 1:
        above, above_owners = [], []
        for k in range(0, len(leaves), 8):
            run = leaves[k : k + 8]
            for j in range(len(run)):
                for o in owners[k + j]:
                    proofs[o].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(h("".join(run)))
            above_owners.append([o for own in owners[k : k + 8] for o in own])
        leaves, owners = above, above_owners
    return leaves[0], proofs


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(*r)))
        trees[g] = own, *brute_tree([brute_leaf(*r) for r in own])
    root, tops = brute_tree([trees[g][1] for g in order])
    for g, above in zip(order, tops):
        own, subroot, proofs = trees[g]
        for r, below in zip(own, proofs):
            path = below + above
            hit = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0
            low = r[1] if r[1] is None else r[1].translate({c: c + 32 for c in range(65, 91)})
            x = brute_leaf(r[0], low, *r[2:]) if hit else brute_leaf(*r)
            for left, right in path:
                x = h(left + x + right)
            yield r[0], brute_leaf(*r), subroot, root, h("".join(a + z for a, z in path)), x, x == root


def as_set(rows):
    return sorted(map(tuple, rows), key=repr)


def test_manifest_equals_direct_form(docs):
    assert as_set(merkle.audit_tampering(docs).collect()) == as_set(brute_manifest(odd_rows()))


@pytest.mark.parametrize("size", [1, 8, 9, 64, 65, 513, 1500])
def test_manifest_of_many_heights(spark, size):
    rows = [(i, f"Text {i % 700}", "hot" if i % 3 else f"l{i % 5}", "s", i) for i in range(size)] + [(7, "Tie", "hot", "s", 1)] * 2
    got = merkle.audit_tampering(spark.createDataFrame(rows, DOCS).repartition(7)).collect()
    assert as_set(got) == as_set(brute_manifest(rows))


def test_manifest_of_many_groups(spark):
    rows = [(i, "T", f"g{i % 130}", None, i) for i in range(400)] + [(1000, "T", None, None, None), (1001, "T", "", None, None)]
    assert as_set(merkle.audit_tampering(spark.createDataFrame(rows, DOCS)).collect()) == as_set(brute_manifest(rows))


def test_manifest_of_an_empty_table(docs):
    assert merkle.audit_tampering(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size,low,high", [(1, 0, 1), (9, 8, 9), (700, 512, 700), (5000, 1024, 1536), (600, 13, 171)])
def test_missing_coordinates_are_minimal_and_suffice(size, low, high):
    leaves = [b"%d" % i for i in range(size)]
    levels, now = [], leaves
    while len(now) > 1:
        levels.append(now)
        now = merkle.runs_above(now)
    asked = merkle.missing_coordinates(low, high, size)
    fetched = {(level, k): levels[level][k] for level, k in asked}
    shown, top = merkle.climb(low, leaves[low:high], size, fetched)
    assert top == now[0]
    proof = merkle.sides(shown, high - 1)
    assert merkle.fold(leaves[high - 1], proof) == top
    # what is asked for is no interior of the leaves at hand, and every part of it is used by some proof
    for level, k in asked:
        assert not (low // 8**level <= k <= (high - 1) // 8**level)
        assert k // 8 in range(low // 8 ** (level + 1), (high - 1) // 8 ** (level + 1) + 1)


def test_hot_join_equals_plain_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_SHARE", 8)
    many = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id") % 50).alias("k")).checkpoint()
    one = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 7).alias("v"))
    for how in ("inner", "left", "left_anti"):
        want = as_set(many.join(one, ["k"], how).collect())
        assert as_set(common.hot_join(many, one, ["k"], how).collect()) == want
