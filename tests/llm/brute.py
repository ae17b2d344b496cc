"""Plain Python forms of what the operators compute, for comparison."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def components(n: int, links) -> list[int]:
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def crc_mod(key, m: int) -> int:
    return zlib.crc32(b"" if key is None else str(key).encode()) % m


def lower(text) -> bytes:
    return (text or "").encode().lower()


def vector_links(rows, threshold: float):
    """rows: (id, vector, label); n_links and component per row."""
    ok = [
        i
        for i, (_, v, lab) in enumerate(rows)
        if lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    links = []
    for a in range(len(ok)):
        for b in range(a):
            (_, x, p), (_, y, q) = rows[ok[a]], rows[ok[b]]
            if p == q and len(x) == len(y):
                x, y = (np.array(v, float) / max(map(abs, v)) for v in (x, y))
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= threshold:
                    links.append((ok[a], ok[b]))
    deg = Counter(i for pair in links for i in pair)
    comp = components(len(rows), links)
    low = defaultdict(list)
    for i, c in enumerate(comp):
        if rows[i][0] is not None:
            low[c].append(rows[i][0])
    return [(rows[i][0], deg[i], min(low[comp[i]]) if low[comp[i]] else None) for i in range(len(rows))]


def base_scores(rows, modulus=7, held=2):
    count = Counter()
    for key, text in rows:
        if crc_mod(key, modulus) != held:
            count.update([*lower(text).split(), None])
    n, v = sum(count.values()), len(count)
    out = []
    for key, text in rows:
        ts = [*lower(text).split(), None]
        out.append(
            (key, crc_mod(key, modulus) == held, len(ts), sum(count[t] > 0 for t in ts), n,
             sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts))
        )
    return out


def model_scores(rows, strength=(500.0, 20.0), modulus=7, held=2):
    """log10 p of each text, by plain counts of its words' histories of up to two tokens."""
    count = Counter()
    for key, text in rows:
        if crc_mod(key, modulus) != held:
            ts = [*lower(text).split(), None]
            count.update(tuple(ts[i : i + k]) for k in (1, 2, 3) for i in range(len(ts) - k + 1))
    ones = {g: c for g, c in count.items() if len(g) == 1}
    mass = sum(ones.values()) + len(ones) + 1

    def p(history, w):
        if not history:
            return (count[(w,)] + 1) / mass
        m = strength[len(history) - 1]
        return (count[(*history, w)] + m * p(history[1:], w)) / (count[history] + m)

    out = []
    for key, text in rows:
        ts = [*lower(text).split(), None]
        out.append((key, sum(math.log10(p(tuple(ts[max(0, i - 2) : i]), w)) for i, w in enumerate(ts))))
    return out


def simhash(text, shingle=4) -> int:
    import xxhash

    w = lower(text).split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def simhash_groups(rows, shingle=4, bits=4):
    fp = [simhash(t, shingle) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= bits]
    comp = components(len(rows), links)
    low = defaultdict(list)
    for i, c in enumerate(comp):
        if rows[i][0] is not None:
            low[c].append(rows[i][0])
    return [(rows[i][0], f"{fp[i]:016x}", min(low[comp[i]], default=None)) for i in range(len(rows))]


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text).decode())


def contamination(docs, items, window=10):
    wins = defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[i : i + window])].add(str(item))
    out = []
    for key, text in docs:
        w = bench_words(text)
        hit, names = set(), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if (found := wins.get(tuple(w[p : p + n]))) is not None:
                    hit.update(range(p, p + n))
                    names |= found
        out.append((key, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return out
