"""Hashes of word shingles of UTF-8 texts, for many texts of an Arrow column at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time.
BLOCK = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes between words: white space.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
#: Bytes between words: all of ASCII but letters and digits.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        p = np.full(max(n, 2 * BLOCK), base, np.uint64)
        p[0] = 1
        _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers[name]


def span_hashes(low: np.ndarray):
    """A function of (starts, ends) that gives the hashes of those ranges of bytes.

    A range's hash is that of its bytes as digits of a number in a fixed odd base modulo 2^64, mixed: differences of
    running sums give it for all ranges at once.
    """
    n = len(low)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power(_BASE, "base", n + 1)[:n], out=total[1:])
    inverse = _power(_INVERSE, "inverse", n + 1)
    return lambda starts, ends: mix((total[ends] - total[starts]) * inverse[starts])


def word_spans(low: np.ndarray, cuts: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of the texts low[cuts[i]:cuts[i+1]]; a word ends with its text."""
    n = len(low)
    inside = ~between[low]
    edge = np.empty(n, bool)
    edge[:1] = True
    edge[1:] = ~inside[:-1]
    edge[cuts[:-1][cuts[:-1] < n]] = True
    last = np.empty(n, bool)
    last[-1:] = True
    last[:-1] = ~inside[1:]
    last[cuts[1:][cuts[1:] > 0] - 1] = True
    return np.flatnonzero(inside & edge), np.flatnonzero(inside & last) + 1


def runs_of_words(data: np.ndarray, cuts: np.ndarray, between: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(place in data, lower-cased bytes, starts, ends of words) of runs of about BLOCK bytes that end between words, so
    that a long text needs little more memory than its words. starts and ends are places in the run."""
    if len(cuts) != 2:
        low = LOWER[data]
        yield 0, low, *word_spans(low, cuts, between)
        return
    at = 0
    while at < len(data):
        to = min(at + BLOCK, len(data))
        while to < len(data):
            gap = np.flatnonzero(between[LOWER[data[to : to + BLOCK]]])
            to = to + int(gap[0]) if len(gap) else min(to + BLOCK, len(data))
            if len(gap):
                break
        low = LOWER[data[at:to]]
        yield at, low, *word_spans(low, np.array([0, to - at]), between)
        at = to


def word_hashes(data: np.ndarray, cuts: np.ndarray, between: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, start, end) of each word, A-Z lower-cased. start and end are places in data."""
    found = [(span_hashes(low)(a, b), a + at, b + at) for at, low, a, b in runs_of_words(data, cuts, between)]
    if not found:
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    words, starts, ends = found[0] if len(found) == 1 else (np.concatenate(x) for x in zip(*found))
    return words, np.searchsorted(cuts, starts, "right") - 1, starts, ends


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and cuts of a string column; null is empty."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, values = column.buffers()
    cuts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8)[cuts[0] : cuts[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, cuts - cuts[0]


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, cuts) of runs of texts of about `size` bytes; a longer text is a run of its own."""
    data, cuts = texts_of(column)
    at = 0
    while at < len(cuts) - 1:
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + size, "right")) - 1)
        yield at, data[cuts[at] : cuts[to]], cuts[at : to + 1] - cuts[at]
        at = to


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words, in order; of the whole sequence if there are fewer words, but some."""
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    out = np.full(n, np.uint64(min(width, len(words))))
    for k in range(min(width, len(words))):
        out = mix(out * np.uint64(0xA24BAED4963EE407) + words[k : k + n])
    return out
