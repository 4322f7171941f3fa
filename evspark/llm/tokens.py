"""Token ids and counts of whole texts with the tokenizer file word_bpe_49k.json, by cached pre-tokens.

Its pre-tokens never span white space, so the ids of a text are those of its pieces one after another. A piece is
encoded by the library once and then looked up. Texts for which cutting into pieces isn't known to be safe (they
hold strings that look like special tokens, or control characters on whose class the two regular-expression
dialects differ) are given to the library whole.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

#: Longest piece that is kept in a cache; longer ones are encoded again each time.
LONGEST = 64
#: Entries that a generation of a worker's cache holds; the one before it is kept too, and what is used moves on.
CACHE_ENTRIES = 120_000

_LETTERS = "a-zªµºß-öø-ɏ"
_WIDE = re.compile("[^\x00-ɏ]")
_RUNS = re.compile(f"[{_LETTERS}]+|[^{_LETTERS}\\s]+")
_WORD = re.compile(f"[{_LETTERS}]+")


def _byte_letters() -> dict[int, str]:
    """Byte-level spelling of each character below U+0250: printable Latin-1 bytes stand for themselves, the others for U+0100 and up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    of = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}
    return {c: "".join(of[b] for b in chr(c).encode()) for c in range(0x250)}


_SPELT = _byte_letters()


def pieces(text: str) -> list[str] | None:
    """The text cut at white space, where no pre-token can span, or None if it has to be encoded whole."""
    if "<|" in text or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return None
    return text.split()


class Encoder:
    """Token ids of pieces, as little-endian unsigned 32-bit bytes, behind a bounded cache."""

    _by_path: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.words_before: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One for each worker process, which keeps its cache from task to task."""
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def word(self, run: str) -> bytes:
        """A lower-case run of letters is one pre-token, which the model takes as it is once its bytes are spelt out."""
        got = self.words.get(run)
        if got is None:
            got = self.words_before.get(run)
            if got is None:
                if _WORD.fullmatch(run):
                    ids = [t.id for t in self.model.tokenize(run if run.isascii() else run.translate(_SPELT))]
                    got = struct.pack(f"<{len(ids)}I", *ids)
                else:
                    got = self.whole(run)
            if len(run) <= LONGEST:
                if len(self.words) >= CACHE_ENTRIES:
                    self.words_before, self.words = self.words, {}
                self.words[run] = got
        return got

    def piece(self, piece: str) -> bytes:
        """Lower-casing first is safe as the tokenizer lower-cases each character itself; below U+0250 nothing composes,
        so runs of letters can be split from the rest unless an apostrophe joins them."""
        low = piece.lower()
        if "'" in low or not piece.isascii() and (_WIDE.search(low) or _WIDE.search(piece)):
            return self.whole(piece)
        runs = _RUNS.findall(low)
        return self.word(runs[0]) if len(runs) == 1 else b"".join([self.word(x) for x in runs])

    def learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of pieces that aren't in the cache; short ones enter it."""
        before = self.before.get
        got = {x: before(x) or self.piece(x) for x in new}
        if len(self.cache) + len(got) > CACHE_ENTRIES:
            self.before, self.cache = self.cache, {}
        self.cache.update((x, v) for x, v in got.items() if len(x) <= LONGEST)
        return got

    def ids(self, text: str) -> bytes:
        parts = pieces(text)
        if parts is None:
            return self.whole(text)
        got = list(map(self.cache.get, parts))
        if None in got:
            new = self.learn({x for x, v in zip(parts, got) if v is None})
            got = [new[x] if v is None else v for x, v in zip(parts, got)]
        return b"".join(got)
