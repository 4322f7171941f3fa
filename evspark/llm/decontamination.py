"""Benchmark decontamination by a prefix-filtered set join of shingles over item-sized windows.

An item's windows are runs of `window` of its words (all its words if it has fewer). A window's tokens are its shingles
of `width` words, ordered by how rarely they occur in all documents. A document that holds at least `share` of a
window's tokens has one of its |S| - ceil(share |S|) + 1 rarest, so only those are indexed. A document's occurrence of an
indexed token is joined with the windows that have it; length and position bound where such a window can lie in the
document, and there its tokens are counted exactly. With share = 1 (the default here) the tokens must all be there in
order, which is then checked word by word.

The index is held in blocks of at most INDEX_BLOCK windows, each broadcast alone and searched in its own pass, so its
size is bounded whatever the benchmark's. Documents never leave their task, so one passage that many share is no hot key.

A null text has no words; texts of any length are searched whole; an empty table of documents gives no rows; other columns
than those asked for aren't read. Documents without words and items without words match nothing. Items without id are
left out: what holds only their windows has n_hit 0 and isn't contaminated. Rows that repeat an id are
judged each; windows that several items share count for each. An empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import named, table, tidy, with_made, written
from evspark.llm.shingles import PUNCTUATION, blocks, shingle_hashes, word_hashes

#: Windows of one index block; with windows of 10 words, about 200 bytes each.
INDEX_BLOCK = 200_000


def item_windows(items: DataFrame, window: int, key: str, text: str) -> DataFrame:
    """item (as a string) and the word hashes of each distinct window of its text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, found = [], []
            names = batch.column(0).to_pylist()
            for first, data, cuts in blocks(batch.column(1)):
                words, of, _, _ = word_hashes(data, cuts, PUNCTUATION)
                at = np.searchsorted(of, np.arange(len(cuts)))
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    for k in range(a, max(a + 1, b - window + 1) if b > a else a):
                        item.append(names[first + i])
                        found.append(words[k : min(k + window, b)].view(np.int64))
            sizes = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))], ["item", "words"])

    return items.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("item"), text).mapInArrow(cut, "item string, words array<long>").distinct()


def document_frequency(docs: DataFrame, tokens: np.ndarray, width: int, text: str) -> dict[int, int]:
    """How often each of tokens occurs in all documents; each task sends a row for a token at most."""
    wanted = docs.sparkSession.sparkContext.broadcast(tokens)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value
        n = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, data, cuts in blocks(batch.column(0)):
                found = document_shingles(data, cuts, width)[0]
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                n += np.bincount(at[known[at] == found], minlength=len(known))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(n[some])], ["token", "n"])
        tidy()

    rows = docs.select(text).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {int(tokens[r.token]): r.n for r in rows}


def document_shingles(data: np.ndarray, cuts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, place of its first word, words, cuts of the words by text): shingles of `width` words or, in shorter texts, of all of them."""
    words, of, _, _ = word_hashes(data, cuts, PUNCTUATION)
    at = np.searchsorted(of, np.arange(len(cuts)))
    if not len(words):
        return words, np.zeros(0, np.int64), words, at
    every = shingle_hashes(words, width)[: max(0, len(words) - width + 1)] if len(words) >= width else words[:0]
    place = np.flatnonzero(of[: len(every)] == of[width - 1 : width - 1 + len(every)]) if len(every) else np.zeros(0, np.int64)
    short = np.flatnonzero((np.diff(at) < width) & (np.diff(at) > 0))
    extra = [(shingle_hashes(words[at[i] : at[i + 1]], w), at[i], w) for i in short.tolist() for w in (int(at[i + 1] - at[i]),)]
    token = np.concatenate([every[place], *(x for x, _, _ in extra)])
    return token, np.concatenate([place, np.array([p for _, p, _ in extra], np.int64)]), words, at


class Index:
    """Windows of a block by their rarest tokens."""

    def __init__(self, rows: list[tuple[str, np.ndarray]], width: int, share: float, frequency: dict[int, int]):
        self.share, self.width = share, width
        self.items = [item for item, _ in rows]
        self.words = [w for _, w in rows]
        self.tokens = [shingle_hashes(w, width) for w in self.words]
        #: tokens of fewer words than width come from windows that short; documents have them at any place
        self.short = sorted({len(w) for w in self.words if len(w) < width})
        entries: list[tuple[int, int, int]] = []
        for n, tokens in enumerate(self.tokens):
            own: dict[int, int] = {}
            for at, t in enumerate(tokens.tolist()):
                own.setdefault(t, at)
            rare = sorted(own, key=lambda t: (frequency.get(t, 0), t))
            for t in rare[: len(rare) - math.ceil(share * len(rare) - 1e-9) + 1]:
                entries += [(t, n, at) for at, x in enumerate(tokens.tolist()) if x == t] if share < 1 else [(t, n, own[t])]
        entries.sort()
        self.keys, first = np.unique(np.array([e[0] for e in entries], np.uint64), return_index=True)
        self.first = np.append(first, len(entries))
        self.window = np.array([e[1] for e in entries], np.int64)
        self.place = np.array([e[2] for e in entries], np.int64)

    def hits(self, data: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, window, first word, past the last word) of each occurrence, words counted from the text's first."""
        if not len(self.keys):
            return
        token, place, words, at = document_shingles(data, cuts, self.width)
        if self.short and len(words):
            for w in self.short:
                every = shingle_hashes(words, w)[: max(0, len(words) - w + 1)]
                token, place = np.concatenate([token, every]), np.concatenate([place, np.arange(len(every))])
        k = np.minimum(np.searchsorted(self.keys, token), len(self.keys) - 1)
        some = np.flatnonzero(self.keys[k] == token)
        text = np.searchsorted(at, place[some], "right") - 1
        for i, key, begin in zip(text.tolist(), k[some].tolist(), place[some].tolist()):
            low, high = int(at[i]), int(at[i + 1])
            for e in range(self.first[key], self.first[key + 1]):
                n = int(self.window[e])
                size, start = len(self.words[n]), begin - int(self.place[e])
                if self.share >= 1:  # an occurrence lies exactly there
                    if start >= low and start + size <= high and (words[start : start + size] == self.words[n]).all():
                        yield i, n, start - low, start + size - low
                    continue
                for s in range(max(low, begin - size + self.width), min(begin, max(low, high - size)) + 1):
                    t = min(s + size, high)
                    wanted = np.unique(self.tokens[n])
                    if len(np.intersect1d(wanted, shingle_hashes(words[s:t], self.width))) >= self.share * len(wanted) - 1e-9:
                        yield i, n, s - low, t - low


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, width: int = 3, share: float = 1.0, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` (key, as a rule) of each document, n_words, n_hit (words inside occurrences), n_items, items_sha256, contaminated."""
    spark, keep = docs.sparkSession, keep or [key]
    windows = written(item_windows(items, window, item_key, item_text), "windows")
    n_blocks = max(1, -(-windows.count() // INDEX_BLOCK))
    blocks_of = windows.withColumn("_block", F.pmod(F.xxhash64("item", "words"), F.lit(n_blocks)))

    out = keep
    if n_blocks > 1:
        docs, keep = docs.withColumn("_text_hash", F.xxhash64(text)), [*keep, "_text_hash"]

    made = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    sent = list(dict.fromkeys([*keep, text]))  # a text that is kept travels once
    at = sent.index(text)

    def union_length(kept: list[pa.Array], spans_of: list[list[int]], items_of: list[list[str]]) -> pa.RecordBatch:
        """`kept` (keep and n_words) with what the spans cover together and the items' digest."""
        hit, digest, count = [], [], []
        for spans, own in zip(spans_of, items_of):
            total, reach = 0, 0
            for a, b in sorted(zip(spans[::2], spans[1::2])):
                total += max(0, b - max(a, reach))
                reach = max(reach, b)
            hit.append(total)
            count.append(len(own))
            digest.append(hashlib.sha256(",".join(own).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([*kept, pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())], [*keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    found = None
    names = [*keep, "n_words", "spans", "items"]
    kinds = with_made(docs, keep, made if n_blocks == 1 else "n_words long, spans array<long>, items array<string>")
    for n in range(n_blocks):
        rows = [(r.item, np.array(r.words, np.int64).view(np.uint64)) for r in blocks_of.filter(F.col("_block") == n).collect()]
        tokens = np.unique(np.concatenate([shingle_hashes(w, width) for _, w in rows])) if rows else np.zeros(0, np.uint64)
        index = spark.sparkContext.broadcast(Index(rows, width, share, document_frequency(docs, tokens, width, text) if len(tokens) else {}))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in batches:
                n_words, spans, names_of = np.zeros(len(batch), np.int64), [[] for _ in range(len(batch))], [set() for _ in range(len(batch))]
                for first, data, cuts in blocks(batch.column(at)):
                    of = word_hashes(data, cuts, PUNCTUATION)[1]
                    n_words[first : first + len(cuts) - 1] = np.bincount(of, minlength=len(cuts) - 1)
                    for i, w, a, b in own.hits(data, cuts):
                        spans[first + i] += [a, b]
                        names_of[first + i].add(own.items[w])
                kept, items_of = [*batch.columns[: len(keep)], pa.array(n_words)], [sorted(x) for x in names_of]
                if n_blocks == 1:  # no other spans to wait for, so no second worker beside this one
                    yield union_length(kept, spans, items_of)
                else:
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(spans, pa.list_(pa.int64())), pa.array(items_of, pa.list_(pa.string()))], names)
            tidy()

        part = docs.select(*map(named, sent)).mapInArrow(search, kinds)
        found = part if found is None else found.unionByName(part)
    if n_blocks > 1:  # a document's spans of all blocks meet; rows that are equal stay as many as they are
        joined = found.groupBy(*map(named, keep), "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count("*") / n_blocks).cast("int").alias("_copies"))
        found = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copies", "_copy")

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield union_length(batch.columns[: len(keep) + 1], batch.column(len(keep) + 1).to_pylist(), batch.column(len(keep) + 2).to_pylist())
            tidy()

        found = found.mapInArrow(measure, with_made(docs, keep, made))
    return found.select(*map(named, out), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
