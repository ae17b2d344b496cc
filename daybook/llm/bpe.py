"""Token ids of whole texts with the ``tokenizers`` library, cached by word.

The byte-level pre-tokenizer cuts a text into pieces that the model encodes one by one.  A space, or a line break, between
two characters that are not white space starts a piece of its own or is the first character of the next one, and
no piece reaches across it.  So the ids of a text are those of its words one after another, where a word after a space stands
with that space and a word after a line break with that break; a bounded cache keeps them.  A word of
letters, with ASCII punctuation after it or none, is one piece (the word) and at most one more (its end), and goes to the
library's model as such; all other words go through the whole tokenizer.  Texts where white space stands otherwise,
texts that hold an added token of the tokenizer, and all texts of other kinds of tokenizers are encoded as they are.
"""

from __future__ import annotations

import os
from itertools import islice
from string import punctuation

import numpy as np

#: Words a worker keeps (about 200 bytes each); beyond it the later half goes, as common words come early.
CACHE_WORDS = 600_000
#: Ends of words that a worker keeps.
CACHE_ENDS = 10_000
WHOLE_AT_A_TIME = 4000
DEFAULT_FILE = "byte_bpe_50k.json"
#: Letters below this are the same in every version of Unicode's tables.
_SAFE = "\u0250"


def tokenizer_path(name: str = DEFAULT_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words(dict):
    """Word (or line break and word) -> id bytes, made when first asked for."""

    def __init__(self, enc: "WordEncoder") -> None:
        super().__init__()
        self.enc = enc

    def __missing__(self, word: str) -> bytes:
        out = self[word] = self.enc.word(word)
        return out


class WordEncoder:
    """ids as little-endian unsigned bytes of type ``kind``, 16 bits where the vocabulary allows it; one per Python worker."""

    _made: dict[str, "WordEncoder"] = {}

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        pre, self.model = self.tok.pre_tokenizer, self.tok.model
        self.by_word = (
            isinstance(pre, pre_tokenizers.ByteLevel)
            and pre.use_regex
            and not pre.add_prefix_space
            and self.tok.normalizer is None
            and isinstance(self.model, models.BPE)
        )
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.space = self._shown(" ")
        self.bytes_of = [k.to_bytes(self.kind.itemsize, "little") for k in range(max(self.tok.get_vocab().values(), default=-1) + 1)]
        # the model's character of each byte, as far as safe letters have it
        self.shown = {b: self._shown(c)[k] for c in map(chr, range(0x80, ord(_SAFE))) for k, b in enumerate(c.encode())}
        self.line = self.whole(["\n"])[0]
        self.ends: dict[str, bytes] = {}
        self.words = _Words(self)

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _shown(self, text: str) -> str:
        """A text's bytes as the model's characters."""
        return self.as_bytes.pre_tokenize_str(text)[0][0]

    def whole(self, texts: list[str]) -> list[bytes]:
        # a few thousand at a time: the library's result objects are far larger than the ids
        return [
            np.array(e.ids, dtype=self.kind).tobytes()
            for k in range(0, len(texts), WHOLE_AT_A_TIME)
            for e in self.tok.encode_batch_fast(texts[k : k + WHOLE_AT_A_TIME], add_special_tokens=False)
        ]

    def word(self, word: str) -> bytes:
        """The ids of a word after a space, or of a line break and the word after it."""
        if word.isalpha() and word.isascii():
            return self._piece(self.space + word)
        after_line = word[:1] == "\n"
        body = word[1:] if after_line else word
        core = body.rstrip(punctuation)
        if not core.isalpha() or not core.isascii() and max(core) >= _SAFE:
            return self.whole([word if after_line else f" {word}"])[0]
        # the word without its end may be known
        out = None if after_line or core == body else self.words.get(core)
        if out is None:
            shown = core if core.isascii() else core.encode().decode("latin-1").translate(self.shown)
            out = self._piece(shown if after_line else self.space + shown)
        if len(core) < len(body):
            end = body[len(core) :]
            if end not in self.ends:
                if len(self.ends) >= CACHE_ENDS:
                    self.ends.clear()
                self.ends[end] = self.whole([end])[0]
            out += self.ends[end]
        return self.line + out if after_line else out

    def _piece(self, shown: str) -> bytes:
        return b"".join([self.bytes_of[t.id] for t in self.model.tokenize(shown)])

    def end(self, token: int) -> bytes:
        return np.array([token], dtype=self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The id bytes of each text, in order."""
        if len(self.words) > CACHE_WORDS:
            early = list(islice(self.words.items(), CACHE_WORDS // 2))
            self.words = _Words(self)
            self.words.update(early)
        get = self.words.__getitem__
        split = [t.replace("\n", " \n").split(" ") if self._apart(t) else None for t in texts]
        first = self.whole([words[0] if words is not None else t for words, t in zip(split, texts)])
        return [f if words is None else f + b"".join(map(get, islice(words, 1, None))) for f, words in zip(first, split)]

    def _apart(self, t: str) -> bool:
        """Whether every space, and every line break or two, stands between characters that are not white space."""
        if not self.by_word or any(a in t for a in self.added):
            return False
        if "  " in t or " \n" in t or "\n " in t or "\n\n\n" in t or t[:1].isspace() or t[-1:].isspace():
            return False
        # white space other than a space or a line break is not printable
        if t.replace("\n", "").isprintable():
            return True
        return not any(w[:1].isspace() or w[-1:].isspace() for line in t.split("\n") for w in line.split(" ") if w)


def as_u4(ids: bytes, kind: np.dtype) -> bytes:
    """The same ids as little-endian unsigned 32-bit integers."""
    return ids if kind.itemsize == 4 else np.frombuffer(ids, kind).astype("<u4").tobytes()
