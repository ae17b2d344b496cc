"""Language-model scoring with weighted backoff automata, one per block of texts.

Model.  Every n-gram of one to three tokens that a training text holds counts, from one occurrence on, at
every size of the corpus.  The lowest order is the add-one distribution over all training words (the base score).  An
n-gram h is a state; its arcs carry Dirichlet-smoothed probabilities
p(w | h) = (c(h w) + m * p(w | h')) / (c(h) + m), where h' is h without its first token, and its failure
arc carries m / (c(h) + m).  Each state's distribution sums to one: what its arcs leave is exactly the failure weight
times what the arcs' words leave in h'.

Spark.  Texts are gathered into blocks of ``block_bytes`` (a longer text is cut at white space into pieces that
know the two tokens before them), stored once as compressed rows in the shared folder.  Each block counts its distinct
n-grams and sends them, as sorted 64-bit hashes, to ranges of the hash; a range adds up the blocks' counts and answers
every block with the totals of its own n-grams, in its order.  So no task holds more than a block or a range,
nothing but N and V reaches the driver, nothing is broadcast, and a frequent n-gram is one entry per block.
A block then builds the part of the automaton that its texts can reach and scores them: one left-to-right traversal
per text carries the state, takes arcs or falls along failure arcs, and adds up log10 weights.  The state after a token is the
longest known end of the last two tokens, so the traversal of all of a block's tokens runs in arrays.
Ranges and blocks both grow with the corpus, so an answer holds fewer entries as it does: in the limit the messages are one n-gram
each, never more than the distinct n-grams of the blocks.  Words are told apart by 63 bits, longer n-grams by 20 bits more than the
corpus has bits of length (at most 63): at any size to 8 TB about one n-gram in a million shares its hash, and so its count, with another.

Results for odd input: a null or empty text is the end token alone; a null id is kept and hashes as the empty string;
repeated rows are scored one by one; without any training row N and V are 0 and every base probability is 1; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.common import crc_mod, cut

#: The end token.  It holds a space, so no word of a text equals it.
END = b" end"

SPACE = re.compile(rb"[\x20\x09-\x0D]")


def tokens(text: str | None) -> list[bytes]:
    """Lower-case A-Z, split at ASCII white space, then the end token."""
    return [*words_of((text or "").encode("utf-8", "surrogatepass")), END]


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


# Blocks of texts


def pieces(text: bytes, most: int) -> Iterator[tuple[bytes, bytes, bool]]:
    """(the two tokens before, text, is last): a text cut at white space after every ``most`` bytes."""
    at, before = 0, []
    while len(text) - at > most and (gap := SPACE.search(text, at + most)):
        piece = text[at : gap.start()]
        yield b" ".join(before), piece, False
        before = [*before, *words_of(piece)][-2:]
        at = gap.start()
    yield b" ".join(before), text[at:], True


PIECE = pa.schema([("row", pa.int64()), ("learn", pa.bool_()), ("before", pa.binary()), ("text", pa.binary()), ("last", pa.bool_())])


def _gather(block_bytes: int):
    """Rows (row, id, learn, t) to blocks (block, payload): compressed Arrow streams of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, made, first, kind = 0, 0, None, None

        def out() -> pa.RecordBatch:
            schema = PIECE.append(pa.field("id", kind))
            table = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=12))) as w:
                w.write_batch(table)
            # the first row's number is the partition's alone; blocks of one partition count on from it
            return pa.RecordBatch.from_arrays(
                [pa.array([first + made], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"]
            )

        for b in batches:
            kind = b.schema.field(1).type
            for k in range(0, b.num_rows, 500):
                for row, id_, learn, t in zip(*(c.to_pylist() for c in b.slice(k, 500).columns)):
                    first = row if first is None else first
                    for before, text, last in pieces((t or "").encode("utf-8", "surrogatepass").lower(), block_bytes):
                        held.append((row, learn, before, text, last, id_))
                        size += len(text) + 16
                        if size >= block_bytes:
                            yield out()
                            held, size, made = [], 0, made + 1
        if held:
            yield out()

    return run


def read_block(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


@dataclass
class Grams:
    """The distinct n-grams of a block; words, pairs and triples are numbered, a pair is a * W + b, a triple pair * W + c."""

    x: np.ndarray  # word number per position
    starts: list[int]  # first position of each piece, and the end
    skip: list[int]  # leading positions of each piece that are context only
    counted: np.ndarray  # per position: learned from
    pairs: np.ndarray
    triples: np.ndarray
    pair_at: np.ndarray  # per position: the pair that ends there, or -1
    triple_at: np.ndarray  # per position: the triple that ends there, or -1
    counts: np.ndarray  # training occurrences here, in the order of ``hashes``
    hashes: np.ndarray  # sorted
    order: np.ndarray  # places of the sorted hashes among words, pairs, triples
    size: int  # W


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of a sequence's hash and one more word."""
    h = (a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)) ^ b
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: The highest bit of a word's hash; longer n-grams have it clear.
WORD = np.uint64(2**63)


def grams_of(block: pa.Table, width: int = 63) -> Grams:
    """All n-grams of the block's pieces.  Hashes of pairs and triples keep ``width`` bits below the highest."""
    index: dict[bytes, int] = {}
    parts, starts, skip, learn, at = [], [0], [], [], 0
    cols = (block.column(c).to_pylist() for c in ("learn", "before", "text", "last"))
    for learned, before, text, last in zip(*cols):
        ahead = before.split()
        ws = chain(ahead, words_of(text), (END,) if last else ())
        ids = np.array([index.setdefault(w, len(index)) for w in ws], dtype=np.int64)
        parts.append(ids)
        at += len(ids)
        starts.append(at), skip.append(len(ahead)), learn.append(bool(learned))
    x, size = np.concatenate(parts), max(1, len(index))
    piece = np.repeat(np.arange(len(parts)), np.diff(starts))
    place = np.arange(len(x)) - np.array(starts)[piece]
    counted = np.array(learn)[piece] & (place >= np.array(skip)[piece])
    two, three = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)
    pair_at, triple_at = np.full((2, len(x)), -1, dtype=np.int64)
    pairs, pair_at[two] = np.unique(x[two - 1] * size + x[two], return_inverse=True)
    triples, triple_at[three] = np.unique(pair_at[three - 1] * size + x[three], return_inverse=True)
    c = [
        np.bincount(x[counted], minlength=size),
        np.bincount(pair_at[counted & (place >= 1)], minlength=len(pairs)),
        np.bincount(triple_at[counted & (place >= 2)], minlength=len(triples)),
    ]
    h1 = np.fromiter((xxhash.xxh64_intdigest(w) for w in index), dtype=np.uint64, count=len(index))
    if not len(index):
        h1 = np.zeros(1, dtype=np.uint64)
    h2 = _mix(h1[pairs // size], h1[pairs % size])
    h3 = _mix(h2[triples // size], h1[triples % size])
    kept = np.uint64(2**63 - 2 ** (63 - width))
    hashes = np.concatenate([h1 | WORD, h2 & kept, h3 & kept])
    order = np.argsort(hashes)
    return Grams(x, starts, skip, counted, pairs, triples, pair_at, triple_at, np.concatenate(c)[order], hashes[order], order, size)


# Counts of the whole corpus


def _pack(values: np.ndarray) -> bytes:
    """64-bit integers by byte planes, each compressed for itself: a plane's bytes are alike, planes differ."""
    planes = values.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T
    packed = [pa.compress(np.ascontiguousarray(p).tobytes(), codec="zstd", asbytes=True) for p in planes]
    return np.array([len(p) for p in packed], dtype="<u4").tobytes() + b"".join(packed)


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes, at = np.empty((n, 8), dtype=np.uint8), 32
    for k, size in enumerate(np.frombuffer(data, dtype="<u4", count=8).tolist()):
        planes[:, k] = np.frombuffer(pa.decompress(data[at : at + size], n, codec="zstd", asbytes=True), dtype=np.uint8)
        at += size
    return planes.view("<u8").reshape(-1)


def _send(bits: int, width: int):
    """Each block's n-grams, cut into ``2 ** bits`` ranges of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, payload in zip(b.column(0).to_pylist(), b.column(1)):
                g = grams_of(read_block(payload.as_py()), width)
                edges = np.searchsorted(g.hashes >> np.uint64(64 - bits), np.arange(2**bits + 1, dtype=np.uint64))
                used = np.flatnonzero(np.diff(edges))
                for some in np.array_split(used, len(used) // 1024 + 1):
                    cuts = [(edges[k], edges[k + 1]) for k in some]
                    steps = [np.diff(g.hashes[i:j], prepend=np.uint64(0)) for i, j in cuts]
                    arrays = [
                        pa.array(some, pa.int64()),
                        pa.array([block] * len(cuts), pa.int64()),
                        pa.array([j - i for i, j in cuts], pa.int64()),
                        pa.array([_pack(s) for s in steps], pa.binary()),
                        pa.array([_pack(g.counts[i:j]) for i, j in cuts], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(arrays, names=["range", "block", "n", "hashes", "counts"])

    return run


def _total(table: pa.Table) -> pa.Table:
    """What the other blocks hold of each n-gram of a block, sent back to it; ``tokens`` and ``words`` of the range stand in its first row."""
    n = table.column("n").to_pylist()
    hashes = np.concatenate([np.cumsum(_unpack(h.as_py(), k), dtype=np.uint64) for h, k in zip(table.column("hashes"), n)])
    counts = np.concatenate([_unpack(c.as_py(), k) for c, k in zip(table.column("counts"), n)]).astype(np.int64)
    order = np.argsort(hashes)
    new = np.diff(hashes[order], prepend=~hashes[order[:1]]) != 0
    group = np.cumsum(new) - 1
    total = np.add.reduceat(counts[order], np.flatnonzero(new))
    is_word = hashes[order][new] >= WORD
    words = int((is_word & (total > 0)).sum())
    spoken = int(total[is_word].sum())
    back = np.empty(len(hashes), dtype=np.int64)
    back[order] = total[group]
    back -= counts  # what others hold is mostly nothing, so it packs better than the total
    ends = np.cumsum(n)
    rest = [0] * (len(n) - 1)
    return pa.table(
        {
            "range": table.column("range"),
            "block": table.column("block"),
            "n": table.column("n"),
            "others": pa.array([_pack(back[e - k : e]) for e, k in zip(ends, n)], pa.binary()),
            "tokens": pa.array([spoken, *rest], pa.int64()),
            "words": pa.array([words, *rest], pa.int64()),
        }
    )


# The automaton of a block


@dataclass
class Automaton:
    """State 0 is the root, 1 + w the word w, 1 + W + k the pair k.

    Arc k < W leaves the root, W + k (for a pair k) its first word's state, W + len(pairs) + k (for a triple k)
    its first two words' state; an arc of weight -inf does not exist.
    """

    size: int
    arc_weight: np.ndarray
    arc_to: np.ndarray
    fail: np.ndarray
    fail_weight: np.ndarray

    def walk(self, g: Grams) -> np.ndarray:
        """Log10 weight of each position's step: failure arcs down to a state that has the token's arc, and that arc."""
        no_arc = -np.ones_like(g.x)
        # the arc of a position's token out of a state of two words, of one word, and out of the root
        arcs = (
            np.where(g.triple_at >= 0, self.size + len(g.pairs) + g.triple_at, no_arc),
            np.where(g.pair_at >= 0, self.size + g.pair_at, no_arc),
            g.x,
        )
        # the state carried to a position is where the token before it led: its longest known end
        after = np.where(self.known(arcs[1]), self.arc_to[arcs[1]], self.arc_to[g.x])
        state = np.concatenate([[0], after[:-1]])
        state[np.array(g.starts[:-1], dtype=np.int64)[np.diff(g.starts) > 0]] = 0
        step = np.zeros(len(g.x))
        at = np.arange(len(g.x))  # positions that still look for an arc
        for order, arc in enumerate(arcs):
            here = (state[at] > self.size) if order == 0 else (state[at] > 0) if order == 1 else np.ones(len(at), dtype=bool)
            takes = here & self.known(arc[at])
            step[at[takes]] += self.arc_weight[arc[at[takes]]]
            falls = at[here & ~takes]
            step[falls] += self.fail_weight[state[falls]]
            state[falls] = self.fail[state[falls]]
            at = at[~takes]
        return step

    def known(self, arc: np.ndarray) -> np.ndarray:
        return (arc >= 0) & (self.arc_weight[arc] > -np.inf)


def build(g: Grams, totals: np.ndarray, n: int, v: int, strength: tuple[float, float]) -> Automaton:
    """``totals`` are the corpus counts in the order of ``g.hashes``."""
    c = np.empty(len(totals), dtype=np.int64)
    c[g.order] = totals
    size, pairs, triples = g.size, g.pairs, g.triples
    c1, c2, c3 = c[:size], c[size : size + len(pairs)], c[size + len(pairs) :]
    m2, m3 = strength
    p1 = (c1 + 1) / (n + v + 1)
    a, b = pairs // size, pairs % size
    p2 = (c2 + m2 * p1[b]) / (c1[a] + m2)
    head, w = triples // size, triples % size
    low = np.searchsorted(pairs, b[head] * size + w)
    p3 = (c3 + m3 * p2[low]) / (c2[head] + m3)
    none = -np.inf
    weights = [np.log10(p1), np.where(c2 > 0, np.log10(p2), none), np.where(c3 > 0, np.log10(p3), none)]
    word_state = np.where(c1 > 0, np.arange(1, size + 1), 0)
    lead = [word_state, 1 + size + np.arange(len(pairs)), 1 + size + low]
    fail = [np.zeros(1 + size, dtype=np.int64), word_state[b]]
    lost = [np.zeros(1), np.log10(m2 / (c1 + m2)), np.log10(m3 / (c2 + m3))]
    return Automaton(size, np.concatenate(weights), np.concatenate(lead), np.concatenate(fail), np.concatenate(lost))


def _score(n: int, v: int, strength: tuple[float, float], width: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        block = read_block(blocks.column("payload")[0].as_py())
        g = grams_of(block, width)
        answers = answers.sort_by("range")
        sent = zip(answers.column("others"), answers.column("n").to_pylist())
        others = np.concatenate([_unpack(t.as_py(), k) for t, k in sent]).astype(np.int64)
        if len(others) != len(g.hashes):
            raise ValueError("a block's answers are not whole")
        totals = g.counts + others
        auto = build(g, totals, n, v, strength)
        c1 = np.empty(len(totals), dtype=np.int64)
        c1[g.order] = totals
        own = np.ones(len(g.x), dtype=bool)  # without the tokens that only lead to a piece's first state
        for i, k in zip(g.starts, g.skip):
            own[i : i + k] = False
        values = (own, own & (c1[g.x] > 0), np.where(own, auto.arc_weight[g.x], 0.0), np.where(own, auto.walk(g), 0.0))
        # a sum of its own per piece, so no piece's rounding meets another's
        n_tokens, n_known, low, path = ([x[i:j].sum().item() for i, j in zip(g.starts, g.starts[1:])] for x in values)
        return pa.table(
            {
                "row": block.column("row"),
                "id": block.column("id"),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "n_known": pa.array(n_known, pa.int64()),
                "base_score": pa.array(low, pa.float64()),
                "score": pa.array(path, pa.float64()),
            }
        )

    return run


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    modulus: int = 7,
    held_remainder: int = 2,
    strength: tuple[float, float] = (500.0, 20.0),
    block_bytes: int = 6 << 20,
) -> DataFrame:
    """Score all rows; rows whose crc32 of the id has ``held_remainder`` modulo ``modulus`` are not learned from.

    ``strength`` is m of the pairs' and of the triples' distributions; the block size changes no score.
    """
    held = crc_mod(id_col, modulus) == held_remainder
    src = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("id"),
        (~held).alias("learn"),
        F.col(text_col).cast("string").alias("t"),
    )
    kind = src.schema["id"].dataType.simpleString()
    blocks = cut(src.mapInArrow(_gather(block_bytes), "block long, payload binary"))
    # two to four ranges for each block, half of them for the words, so a range is of a bounded number of n-grams
    n_blocks = max(2, blocks.count())
    bits, width = (n_blocks - 1).bit_length() + 1, min(63, max(48, 20 + (n_blocks * block_bytes).bit_length()))
    sent = blocks.mapInArrow(_send(bits, width), "range long, block long, n long, hashes binary, counts binary")
    shape = "range long, block long, n long, others binary, tokens long, words long"
    answers = cut(sent.groupBy("range").applyInArrow(_total, shape))
    n, v = (int(x or 0) for x in answers.agg(F.sum("tokens"), F.sum("words")).first())
    scored = (
        blocks.groupBy("block")
        .cogroup(answers.select("block", "range", "n", "others").groupBy("block"))
        .applyInArrow(
            _score(n, v, strength, width), f"row long, id {kind}, n_tokens long, n_known long, base_score double, score double"
        )
    )
    # a long text's pieces meet again; all others are one row each
    sums = scored.groupBy("row").agg(
        F.max("id").alias(id_col), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    )
    return sums.select(
        id_col,
        (crc_mod(id_col, modulus) == held_remainder).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
