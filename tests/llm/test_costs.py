"""What the operators' inner steps ask for, on rows of their own."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa

from daybook.llm import bpe, term_matrix


def test_a_word_with_punctuation_is_encoded_without_it(monkeypatch):
    enc = bpe.WordEncoder(bpe.tokenizer_path())
    texts = ["of thornd,%%% thornd?! thornd--", "a b's c'' d't! e,x. f_g_ h2, i'll.", "été... ß) «x» (y)", "x.\ny!!\n\nz;: w"]
    want, asked = enc.whole(texts), []
    whole = enc.whole
    monkeypatch.setattr(enc, "whole", lambda t: asked.extend(t) or whole(t))
    assert enc.encode(texts) == want
    assert " thornd,%%%" not in asked and " thornd?!" not in asked and ",%%%" in asked
    monkeypatch.setattr(bpe, "CACHE_ENDS", 2)
    assert bpe.WordEncoder(bpe.tokenizer_path()).encode(texts) == want


def test_a_known_word_is_not_encoded_again_for_its_end():
    enc = bpe.WordEncoder(bpe.tokenizer_path())
    pieces, piece = [], enc._piece
    enc._piece = lambda shown: pieces.append(shown) or piece(shown)
    assert enc.encode(["x thornd thornd, thornd."]) == enc.whole(["x thornd thornd, thornd."])
    assert len(pieces) == 1


def test_texts_are_counted_in_pieces_of_bounded_bytes(monkeypatch):
    texts = ["a b a", "", " \t", "ß\x0bA  b\x1cc ", "x" * 50, "a b " * 30, "b"]
    monkeypatch.setattr(term_matrix, "PIECE_BYTES", 20)
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["p"] * 7), pa.array(texts)], names=["id", "part", "text"])
    pieces = list(term_matrix._pieces(batch))
    assert [p.column(0).to_pylist() for p in pieces] == [[0, 1, 2, 3], [4], [5], [6]]
    got = []
    for p in pieces:
        words, row, code, times, tokens = term_matrix._counted(p.column(2))
        own = [Counter() for _ in range(p.num_rows)]
        for r, c, n in zip(row.tolist(), code.tolist(), times.tolist()):
            own[r][words[c]] = n
        assert [c.total() for c in own] == tokens.tolist()
        got += own
    assert got == [Counter(t.encode().split()) for t in texts]
    assert term_matrix.capitals("AZaéÉ日[@".encode()) == (2, 8)
