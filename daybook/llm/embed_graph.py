"""Embedding near-duplicates on a robust-pruned flat graph.

1. Equal vectors of a label become one node with a weight.
2. Centroids come from a bounded hash sample (``sample_rows``), one for every
   ``shard_rows`` nodes up to ``max_cells`` (4 million nodes); every node goes
   to its ``overlap`` nearest cells of its label, and a cell larger than a
   shard, by skew or beyond that many nodes, is dealt into sub-shards by hash.
3. Build: per shard each node keeps at most ``degree`` neighbours by robust
   pruning: a candidate is dropped when a kept neighbour is closer to it, by
   the factor ``alpha``, than the node is.  The lists of a node from all its shards are united.
4. Search: each node queries its nearest ``probes`` cells and every cell whose
   core, the nodes within the threshold of the centroid, the triangle inequality cannot rule out.  From a shard's medoids a greedy search
   with a beam finds the query's surroundings; then the range
   expands: every node within reach of the threshold is expanded until no new one is in reach.
5. Audit of the routes: the nodes with an id divisible by 100 (of more than ``audit_queries``
   those with the lowest hashes) are compared with all nodes of their label, and ``probes`` is
   raised until ``min_recall`` of their links, themselves left out, meet in a cell.  The table
   ``audit`` gives these links and how many of them meet.
   Audit of the search: a hash share of the queries is compared with the whole shard; a shard whose recall,
   without self hits, is below ``min_recall`` searches again with a doubled beam.  What one side of a pair finds
   holds for the other side too; nothing but the search finds pairs.
6. Verify: links are those with cosine >= threshold in double precision.

A pair is counted for the query in one shard only (the first of the found node's cells that the
query visits), and there for the found node too if that one's own routes cannot lead it to the query, so both
sides count a pair that either finds and counts need no list of pairs; out of a shard come, per node, a
weighted count and a link to the smallest node it is connected with there.
Queries are dealt in blocks, each with a copy of the shard, so a large cell is
split over tasks and no task holds more than a shard and a block of queries.

Results for odd input: a vector that is null or empty, has null or non-finite
components or is zero, and any row with a null label, links with nothing; vectors of different length never link;
repeated rows are rows like others (equal vectors of a label link with each other); a null id takes part in
links but never names a component unless all ids in it are null; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import cut
from daybook.llm.components import connected_components

BLOCK_QUERIES = 4096
#: Centroids found at once; above it they are found in two levels.
FLAT_CELLS = 256
#: Similarities to centroids that a task holds at a time.
CELLS_AT_A_TIME = 1 << 22


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Rows scaled to length 1 in double precision; the largest component goes first, against overflow."""
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(1, CELLS_AT_A_TIME // len(c))
    return np.concatenate([np.argmax(x[k : k + step] @ c.T, axis=1) for k in range(0, len(x), step)])


def _k_means(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """About k centroids of the unit rows x; many are found in two levels."""
    if k > FLAT_CELLS:
        near = _nearest(x, _k_means(x, int(k**0.5), rounds))
        parts = [x[near == j] for j in np.unique(near)]
        return np.concatenate([_k_means(p, max(1, round(k * len(p) / len(x))), rounds) for p in parts])[:k]
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds if k > 1 else 1):
        near = _nearest(x, c)
        for j in range(k):
            own = x[near == j]
            if len(own) and (norm := np.linalg.norm(s := own.sum(axis=0))) > 1e-9:
                c[j] = s / norm
    return c


def centroids(sample: pd.DataFrame, share: float, shard_rows: int, max_cells: int, rounds: int = 6) -> dict:
    """Per (label, length) the centroids of a spherical k-means on the sample; share: sample rows per row."""
    out = {}
    cells_left = max_cells
    for key, part in sorted(sample.groupby(["label", "dim"]), key=lambda kv: -len(kv[1])):
        x = unit_rows(part["vec"])
        k = int(min(max(1, round(len(x) / share / shard_rows)), max(1, len(x) // 4), max(1, cells_left)))
        c = out[(key[0], int(key[1]))] = _k_means(x, k, rounds)
        cells_left -= len(c)
    return out


def by_nearness(x: np.ndarray, c: np.ndarray, many: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """In bounded pieces of x: (first row, similarity to every centroid, the ``many`` nearest centroids in order)."""
    step = max(1, CELLS_AT_A_TIME // len(c))
    for k in range(0, len(x), step):
        sim = x[k : k + step] @ c.T
        if many < len(c):
            top = np.sort(np.argpartition(-sim, many - 1, axis=1)[:, :many], axis=1)
        else:
            top = np.broadcast_to(np.arange(len(c)), sim.shape)
        order = np.argsort(-np.take_along_axis(sim, top, axis=1), axis=1, kind="stable")
        yield k, sim, np.take_along_axis(top, order, axis=1)


def robust_prune(x: np.ndarray, degree: int, alpha: float, near: int = 48, far: int = 16) -> np.ndarray:
    """(n, degree) neighbour numbers, -1 where fewer; candidates are the nearest and some spread over the shard."""
    n = len(x)
    if n < 2:
        return np.full((n, degree), -1, dtype=np.int64)
    f = x.astype(np.float32)
    sim = f @ f.T
    np.fill_diagonal(sim, -2)
    near = min(near, n - 1)
    cand = np.argpartition(-sim, near - 1, axis=1)[:, :near] if near < n - 1 else np.argsort(-sim, axis=1)[:, : n - 1]
    if n - 1 > near:
        step = np.arange(1, far + 1) * max(1, n // (far + 1))
        cand = np.concatenate([cand, (np.arange(n)[:, None] + step) % n], axis=1)
    own = np.arange(n)[:, None]
    dist = np.sqrt(np.maximum(2 - 2 * sim[own, cand], 0))
    dist[cand == own] = np.inf
    out = np.full((n, degree), -1, dtype=np.int64)
    alive = np.isfinite(dist)
    rows = np.arange(n)
    for r in range(degree):
        d = np.where(alive, dist, np.inf)
        pick = d.argmin(axis=1)
        ok = np.isfinite(d[rows, pick])
        if not ok.any():
            break
        chosen = cand[rows, pick]
        out[ok, r] = chosen[ok]
        between = np.sqrt(np.maximum(2 - 2 * sim[chosen[:, None], cand], 0))
        between[cand == chosen[:, None]] = 0
        alive &= ~((alpha * between <= dist) & ok[:, None])
        alive[rows, pick] = False
    return out


def _medoids(x: np.ndarray, many: int = 8) -> np.ndarray:
    """The node nearest the middle, then nodes farthest from those taken."""
    first = int(np.argmax(x @ x.mean(axis=0)))
    taken, best = [first], x @ x[first]
    while len(taken) < min(many, len(x)):
        taken.append(int(np.argmin(best)))
        best = np.maximum(best, x @ x[taken[-1]])
    return np.unique(np.array(taken))


def range_search(
    x: np.ndarray, graph: np.ndarray, q: np.ndarray, starts: np.ndarray, beam: int, threshold: float, slack: float, widen: int = 4
) -> tuple[np.ndarray, np.ndarray]:
    """(query number, node number) of the nodes found at or above the threshold, by float similarity."""
    m, n = len(q), len(x)
    seen = np.zeros((m, n), dtype=bool)
    reach = threshold - slack
    hits_q, hits_n = [], []
    rows = np.arange(m)[:, None]

    def visit(qs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        """Similarity of new (query, node) pairs; keeps those at the threshold."""
        s = np.empty(len(qs), dtype=np.float32)
        for k in range(0, len(qs), 1 << 17):
            s[k : k + (1 << 17)] = np.einsum("ij,ij->i", q[qs[k : k + (1 << 17)]], x[ns[k : k + (1 << 17)]])
        hit = s >= threshold - 1e-4
        hits_q.append(qs[hit])
        hits_n.append(ns[hit])
        return s

    beam = min(beam, n)
    nodes = np.broadcast_to(starts, (m, len(starts))).copy()
    seen[rows, nodes] = True
    sims = visit(np.repeat(np.arange(m), len(starts)), nodes.reshape(-1)).reshape(m, -1)
    done = np.zeros(nodes.shape, dtype=bool)
    in_reach: list[tuple[np.ndarray, np.ndarray]] = []
    open_sims = np.where(sims >= reach)
    in_reach.append((open_sims[0], nodes[open_sims]))
    active = np.arange(m)
    while len(active):
        todo = np.where(done[active], -np.inf, sims[active])
        order = np.argsort(-todo, axis=1)[:, :widen]
        best = np.take_along_axis(todo, order, axis=1)
        active = active[np.isfinite(best[:, 0])]
        if not len(active):
            break
        keep = np.isfinite(best[:, 0])
        order, best = order[keep], best[keep]
        done[active[:, None], order] |= np.isfinite(best)
        picked = np.where(np.isfinite(best), nodes[active[:, None], order], -1)
        near = np.where(picked[:, :, None] >= 0, graph[picked], -1).reshape(len(active), -1)
        a, b = np.nonzero(near >= 0)
        qs, ns = active[a], near[a, b]
        new = ~seen[qs, ns]
        pair = np.unique(qs[new] * n + ns[new])
        qs, ns = pair // n, pair % n
        seen[qs, ns] = True
        s = visit(qs, ns)
        r = s >= reach
        in_reach.append((qs[r], ns[r]))
        # merge what is new into the beams
        width = np.bincount(qs, minlength=m)
        cols = np.arange(len(qs)) - np.repeat(np.cumsum(width) - width, width)
        extra_s = np.full((m, int(width.max(initial=0))), -np.inf, dtype=np.float32)
        extra_n = np.zeros(extra_s.shape, dtype=np.int64)
        extra_s[qs, cols], extra_n[qs, cols] = s, ns
        sims = np.concatenate([sims, extra_s], axis=1)
        nodes = np.concatenate([nodes, extra_n], axis=1)
        done = np.concatenate([done, np.isinf(extra_s)], axis=1)
        if sims.shape[1] > beam:
            top = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
            sims, nodes, done = (np.take_along_axis(v, top, axis=1) for v in (sims, nodes, done))
    # the range expands over everything in reach, whether or not the beam kept it
    expanded = np.zeros((m, n), dtype=bool)
    front_q, front_n = (np.concatenate(v) for v in zip(*in_reach))
    while len(front_q):
        fresh = ~expanded[front_q, front_n]
        front_q, front_n = front_q[fresh], front_n[fresh]
        expanded[front_q, front_n] = True
        next_q, next_n = [], []
        for k in range(0, len(front_q), 1 << 16):
            near = graph[front_n[k : k + (1 << 16)]]
            a, b = np.nonzero(near >= 0)
            qs, ns = front_q[k : k + (1 << 16)][a], near[a, b]
            new = ~seen[qs, ns]
            pair = np.unique(qs[new] * n + ns[new])
            qs, ns = pair // n, pair % n
            seen[qs, ns] = True
            r = visit(qs, ns) >= reach
            next_q.append(qs[r])
            next_n.append(ns[r])
        front_q = np.concatenate(next_q) if next_q else np.zeros(0, dtype=np.int64)
        front_n = np.concatenate(next_n) if next_n else np.zeros(0, dtype=np.int64)
    return np.concatenate(hits_q), np.concatenate(hits_n)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def cell_places(x: np.ndarray, c: np.ndarray, within: np.ndarray) -> np.ndarray:
    """(rows, centroids) place of each cell among a row's nearest, 0 where the cell is within the angle ``within``."""
    sim = x @ c.T
    out = np.empty(sim.shape, dtype=np.int32)
    np.put_along_axis(out, np.argsort(-sim, axis=1, kind="stable"), np.arange(len(c), dtype=np.int32)[None, :], axis=1)
    out[np.arccos(np.clip(sim, -1, 1)) <= within] = 0
    return out


def near_duplicate_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    shard_rows: int = 512,
    overlap: int = 2,
    probes: int = 4,
    degree: int = 20,
    alpha: float = 1.2,
    beam: int = 24,
    slack: float = 0.05,
    audit_share: int = 16,
    min_recall: float = 0.99,
    sample_rows: int = 32_768,
    max_cells: int = 8192,
    audit_queries: int = 1024,
) -> tuple[DataFrame, DataFrame]:
    """(rows, audit): rows has id_col, n_links, component_id, kept; audit has the stated queries' links and those found."""
    spark = df.sparkSession
    vec = F.col("vec")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    src = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    usable = F.col("label").isNotNull() & vec.isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0)
    good = src.where(usable).withColumn("dim", F.size("vec"))
    nodes = cut(
        good.groupBy("label", "dim", "vec")
        .agg(
            F.count("*").alias("copies"),
            F.min("id").alias("low"),
            F.max(F.coalesce(F.col("id") % 100 == 0, F.lit(False))).alias("stated"),
        )
        .withColumn("rid", F.monotonically_increasing_id())
    )
    total = nodes.count()
    # a hash share of the rows, near sample_rows of them; the limit only proves the bound
    drawn = nodes.withColumn("h", F.xxhash64("rid")).where(F.pmod("h", F.lit(1 << 30)) < (sample_rows << 30) // max(total, 1))
    sample = drawn.select("h", "label", "dim", "vec").limit(2 * sample_rows).toPandas().sort_values("h")
    cells = spark.sparkContext.broadcast(
        centroids(sample, max(len(sample), 1) / max(total, 1), shard_rows, max_cells)
    )
    label_type = nodes.schema["label"].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (label, dim), part in b.groupby(["label", "dim"]):
                x = unit_rows(part["vec"])
                c = cells.value.get((label, int(dim)))
                order, away = np.zeros((len(x), 1), dtype=int), np.zeros(len(x))
                if c is not None:
                    order = np.zeros((len(x), min(overlap, len(c))), dtype=int)
                    for k, sim, near in by_nearness(x, c, overlap):
                        order[k : k + len(near)] = near
                        own = np.take_along_axis(sim, near[:, :1], axis=1)[:, 0]
                        away[k : k + len(near)] = np.arccos(np.clip(own, -1, 1))
                yield pd.DataFrame(
                    {"label": label, "dim": dim, "rid": part["rid"], "copies": part["copies"], "vec": part["vec"],
                     "cells": list(order), "away": away, "sampled": c is not None}
                )

    fields = f"label {label_type}, dim int, rid long, copies long, vec array<double>"
    nodes_in = cut(nodes.drop("low", "stated").mapInPandas(assign, f"{fields}, cells array<int>, away double, sampled boolean"))
    # at most max_cells cells have a centroid; labels outside the sample are one cell each and stay in Spark
    cell_sizes = nodes_in.select("label", "dim", F.explode("cells").alias("cell")).groupBy("label", "dim", "cell").count()
    sub_of = cell_sizes.select("label", "dim", "cell", F.ceil(F.col("count") / (2 * shard_rows * overlap)).cast("int").alias("subs"))
    angle = float(np.arccos(threshold))
    # of a cell's core, the nodes of its own within the threshold of the centroid: far ones must not hide the core
    radius = {
        (r["label"], r["dim"], r["cell"]): r["r"]
        for r in nodes_in.where(F.col("sampled") & (F.col("away") <= angle))
        .groupBy("label", "dim", F.col("cells")[0].alias("cell"))
        .agg(F.max("away").alias("r"))
        .collect()
    }
    radii = spark.sparkContext.broadcast(radius)

    def cores(label: object, dim: int, many: int) -> np.ndarray:
        return np.array([radii.value.get((label, dim, j), -np.inf) for j in range(many)])

    stated = nodes.where("stated").select("label", "dim", "rid", "vec").orderBy(F.xxhash64("rid"), "rid").limit(audit_queries)
    audited = spark.sparkContext.broadcast({(k[0], int(k[1])): v for k, v in stated.toPandas().groupby(["label", "dim"])})

    def missing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """(place, links): how far down the nearest cells a pair's better side must go until the two meet."""
        known: dict = {}
        for b in batches:
            for (label, dim), part in b.groupby(["label", "dim"]):
                key = (label, int(dim))
                if key not in audited.value:
                    continue
                c = cells.value.get(key)
                if key not in known:
                    xq, within = unit_rows(audited.value[key]["vec"]), None
                    if c is not None:
                        within = angle + cores(label, int(dim), len(c)) + 1e-6
                        homes = np.concatenate([near for _, _, near in by_nearness(xq, c, overlap)])[:, :overlap]
                        known[key] = xq, within, homes, cell_places(xq, c, within)
                    else:
                        known[key] = xq, None, None, None
                xq, within, homes, places = known[key]
                x, rid, copies = unit_rows(part["vec"]), part["rid"].to_numpy(), part["copies"].to_numpy()
                qid, own = audited.value[key]["rid"].to_numpy(), np.stack(part["cells"].to_numpy())
                step = max(1, CELLS_AT_A_TIME // max(len(xq), 1 if c is None else len(c)))
                for k in range(0, len(x), step):
                    i, j = np.nonzero((xq @ x[k : k + step].T >= threshold) & (qid[:, None] != rid[None, k : k + step]))
                    if not len(i):
                        continue
                    place = np.zeros(len(i), dtype=np.int64)
                    if c is not None:
                        used, at = np.unique(j, return_inverse=True)
                        back = cell_places(x[k + used], c, within)
                        place[:] = len(c)
                        for o in range(homes.shape[1]):
                            place = np.minimum(place, np.minimum(places[i, own[k + j, o]], back[at, homes[i, o]]))
                    links = np.bincount(place, weights=copies[k + j]).astype(np.int64)
                    yield pd.DataFrame({"place": np.flatnonzero(links), "links": links[links > 0]})

    # at most max_cells rows
    needed = (
        nodes_in.mapInPandas(missing, "place long, links long").groupBy("place").agg(F.sum("links").alias("links")).orderBy("place").collect()
    )
    all_links = sum(r["links"] for r in needed)
    met = lambda many: sum(r["links"] for r in needed if r["place"] < many)
    for r in needed:
        if met(probes) >= min_recall * all_links:
            break
        probes = max(probes, r["place"] + 1)
    audit = spark.createDataFrame([(all_links, met(max(probes, overlap)))], "audited long, found long")

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (label, dim), part in b.groupby(["label", "dim"]):
                c = cells.value.get((label, int(dim)))
                if c is None:
                    to = [np.zeros(1, dtype=int)] * len(part)
                else:
                    r = cores(label, int(dim), len(c))
                    to = []
                    for _, sim, near in by_nearness(unit_rows(part["vec"]), c, max(probes, overlap)):
                        go = np.arccos(np.clip(sim, -1, 1)) <= angle + r + 1e-6
                        np.put_along_axis(go, near, True, axis=1)
                        to += [np.flatnonzero(g) for g in go]
                yield pd.DataFrame(
                    {"label": label, "dim": dim, "rid": part["rid"], "copies": part["copies"], "vec": part["vec"],
                     "cells": part["cells"], "routes": to}
                )

    sub = F.pmod(F.xxhash64("rid"), F.col("subs")).cast("int")
    routed = cut(nodes_in.drop("away", "sampled").mapInPandas(route, f"{fields}, cells array<int>, routes array<int>"))
    members = (
        routed.select("*", F.explode("cells").alias("cell")).join(sub_of, ["label", "dim", "cell"]).withColumn("sub", sub)
    )

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rid = part["rid"].to_numpy()
        g = robust_prune(unit_rows(part["vec"]), degree, alpha)
        return pd.DataFrame({"rid": rid, "nbrs": [rid[r[r >= 0]] for r in g]})

    lists = (
        members.select("label", "dim", "cell", "sub", "rid", "vec")
        .groupBy("label", "dim", "cell", "sub")
        .applyInPandas(build, "rid long, nbrs array<long>")
    )
    graph = lists.groupBy("rid").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs"))

    # columns of its own: members, the other side of the cogroup, come from the same table
    asked = routed.select(*[F.col(c).alias(c) for c in routed.columns], F.explode("routes").alias("cell"))
    blocks = asked.groupBy("label", "dim", "cell").count().select(
        "label", "dim", "cell", F.ceil(F.col("count") / BLOCK_QUERIES).cast("int").alias("blocks")
    )
    plan = sub_of.join(blocks, ["label", "dim", "cell"])
    block = F.pmod(F.xxhash64("rid", F.lit(1)), F.col("blocks")).cast("int")
    left = (
        asked.join(plan, ["label", "dim", "cell"])
        .withColumn("block", block)
        .select(
            "label", "dim", "cell", "block", "rid", "copies", "vec", "cells", "routes",
            F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"),
        )
    )
    right = (
        members.join(graph, "rid")
        .join(blocks, ["label", "dim", "cell"])
        .select(
            "label", "dim", "cell", "sub", "rid", "copies", "vec", "cells", "routes", "nbrs",
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        )
    )

    def search(key: tuple, asks: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"rid": [], "links": [], "root": []}).astype("int64")
        if not len(asks) or not len(own):
            return none
        own, asks = own.sort_values("rid"), asks.sort_values("rid")
        rid, qid = own["rid"].to_numpy(), asks["rid"].to_numpy()
        x, q = unit_rows(own["vec"]), unit_rows(asks["vec"])
        xf, qf = x.astype(np.float32), q.astype(np.float32)
        width = max(1, int(own["nbrs"].map(len).max()))
        g = np.full((len(rid), width), -1, dtype=np.int64)
        for i, nb in enumerate(own["nbrs"]):
            at = np.minimum(np.searchsorted(rid, nb), len(rid) - 1)
            at = at[rid[at] == nb]
            g[i, : len(at)] = at
        # links go both ways
        src_n, col = np.nonzero(g >= 0)
        g = _both_ways(g, src_n, g[src_n, col])
        starts, cell = _medoids(xf), int(key[2])
        check = np.flatnonzero(qid % audit_share == 0)
        truth = (qf[check] @ xf.T >= threshold) & (qid[check][:, None] != rid)
        width = beam
        while True:
            a, b = [], []
            for k in range(0, len(qid), 512):
                qa, qb = range_search(xf, g, qf[k : k + 512], starts, width, threshold, slack)
                a.append(qa + k)
                b.append(qb)
            a, b = np.concatenate(a), np.concatenate(b)
            got = np.zeros((len(qid), len(rid)), dtype=bool)
            got[a, b] = True
            found = int((got[check] & truth).sum())
            if found >= min_recall * truth.sum() or width >= len(rid):
                break
            width *= 2
        a, b = _either_side(got, qid, rid)
        exact = np.zeros(len(a), dtype=bool)
        for k in range(0, len(a), 1 << 16):
            exact[k : k + (1 << 16)] = np.einsum("ij,ij->i", q[a[k : k + (1 << 16)]], x[b[k : k + (1 << 16)]]) >= threshold
        a, b = a[exact], b[exact]
        differ = qid[a] != rid[b]
        a, b = a[differ], b[differ]
        # a pair counts in the first of the found node's cells that the query visits
        firsts = np.array([c[0] for c in own["cells"]])
        at_home = firsts[b] == cell
        visited = _visits(asks["routes"], a, firsts[b])
        counts_here = at_home | ~visited
        a_here, b_here = a[counts_here], b[counts_here]
        homes, back = np.stack(asks["cells"].to_numpy()), np.zeros(len(a_here), dtype=bool)
        for o in range(homes.shape[1]):
            back |= _visits(own["routes"], b_here, homes[a_here, o])
        names, inv = np.unique(np.concatenate([qid, rid]), return_inverse=True)
        root = names[_forest(len(names), inv[a], inv[len(qid) + b])]
        per_node = np.zeros(len(names), dtype=np.int64)
        np.add.at(per_node, inv[a_here], own["copies"].to_numpy()[b_here])
        # a found node that never visits a cell of the query counts the pair here
        np.add.at(per_node, inv[len(qid) + b_here[~back]], asks["copies"].to_numpy()[a_here[~back]])
        keep = (root != names) | (per_node > 0)
        return pd.DataFrame({"rid": names[keep], "links": per_node[keep], "root": root[keep]}).astype("int64")

    keys = ["label", "dim", "cell", "sub", "block"]
    real = cut(
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(search, "rid long, links long, root long")
    )
    comp = connected_components(real.select(F.col("rid").alias("u"), F.col("root").alias("v")))
    links = real.groupBy("rid").agg(F.sum("links").alias("links"))
    named = (
        nodes.join(links, "rid", "left")
        .join(comp.select(F.col("node").alias("rid"), "component"), "rid", "left")
        .withColumn("component", F.coalesce("component", "rid"))
        .withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    )
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    per_vec = named.join(lowest, "component").select("label", "dim", "vec", "n_links", "component_id")
    linked = good.join(per_vec, ["label", "dim", "vec"]).select("id", "n_links", "component_id")
    alone = src.where(~F.coalesce(usable, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n_links").cast("long"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
    return out, audit


def _either_side(got: np.ndarray, qid: np.ndarray, rid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of the found pairs, a pair also the other way round where its node asks here and its query is a node here."""
    for k in range(0, len(got), 256):
        a, b = np.nonzero(got[k : k + 256])
        as_node, as_query = _place(rid, qid[a + k]), _place(qid, rid[b])
        both = (as_node >= 0) & (as_query >= 0)
        got[as_query[both], as_node[both]] = True
    return np.nonzero(got)


def _place(ascending: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted number stands, -1 where it does not."""
    at = np.minimum(np.searchsorted(ascending, wanted), len(ascending) - 1)
    return np.where(ascending[at] == wanted, at, -1)


def _visits(routes: pd.Series, row: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether the routes of each given row hold the given cell."""
    span = max(int(cell.max(initial=0)), int(max(r.max() for r in routes))) + 1
    held = np.concatenate([i * span + np.sort(r).astype(np.int64) for i, r in enumerate(routes)])
    asked = row * span + cell
    return held[np.minimum(np.searchsorted(held, asked), len(held) - 1)] == asked


def _both_ways(g: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The graph with every edge in both directions, lists padded with -1."""
    n = len(g)
    code = np.unique(np.concatenate([a * n + b, b * n + a]))
    a, b = code // n, code % n
    width = np.bincount(a, minlength=n)
    out = np.full((n, int(width.max(initial=1))), -1, dtype=np.int64)
    out[a, np.arange(len(a)) - np.repeat(np.cumsum(width) - width, width)] = b
    return out
