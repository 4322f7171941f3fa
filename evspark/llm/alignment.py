"""Alignment of two tokenizers' tokens over whole texts, with corpus-wide counts of the id pairs that it links.

Both token sequences spell the same bytes, so each is an array of ends. Where the arrays agree at the present shift of
indices, tokens are one to one; such stretches are jumped by probes of doubling length, each one comparison of memory, and
end at the lowest bit in which the last probe differs. An irregular group, whose tokens' ends differ until both meet again, is walked token by token and changes the
shift. An A and a B token are linked where their bytes overlap.

Texts are encoded once; each row's distinct pairs are written with it. Tasks add pairs up before they are shuffled. The
pairs' counts then come back in two tiers: the most frequent FREQUENT pairs at most are broadcast and summed where the rows
are; the others, none of which can hold many of all links, are joined. The highest count of each A id is a table of A's
vocabulary at most.

Null and empty texts, and those that either tokenizer doesn't spell byte by byte, have no tokens: zeros and an empty digest.
Texts of any length are encoded whole, and rows that repeat are counted as documents each. Of pairs that tie for the
highest count of an A id all are best. An empty table gives no rows. Columns to keep may have any names; a null key is one.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import named, table, tidy, with_made, written

#: Pairs whose counts are broadcast at most: 16 bytes each, 4 MB.
FREQUENT = 1 << 18
#: Distinct pairs that a task adds up before it hands them on.
TOGETHER = 1 << 21

#: Characters on which both libraries of the byte-level tokenizer are known to agree; other texts go to the one of the .json.
_PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")


class Bytewise:
    """Token ids of byte-level BPE, and each id's bytes."""

    _by_path: dict[str, Bytewise] = {}

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            entries = json.load(f)["model"]["vocab"]
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
        self.spelt = [b""] * self.library.get_vocab_size()
        ranks = {}
        for entry, i in entries.items():
            if all(c in byte_of for c in entry):
                self.spelt[i] = bytes(byte_of[c] for c in entry)
                ranks[self.spelt[i]] = i
        self.lengths = np.array([len(x) for x in self.spelt], np.int64)
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        ranks = {b: i for b, i in ranks.items() if b.decode("utf-8", "replace") not in special}
        self.quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def of(cls, path: str) -> Bytewise:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def ids(self, text: str) -> list[int]:
        if _PLAIN.fullmatch(text):
            return self.quick.encode_ordinary(text)
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def spells(self, text: str, ids: list[int], tokens: np.ndarray, want: bytes) -> bool:
        """Whether a text's ids, which are also given as numbers, spell its bytes `want`. The quick library's tokens are the
        text's own bytes in order, so there the lengths tell whether any are missing."""
        if _PLAIN.fullmatch(text):
            return int(self.lengths[tokens].sum()) == len(want)
        return b"".join(map(self.spelt.__getitem__, ids)) == want


class Pieces:
    """Token ids of sentence pieces, and each id's bytes."""

    _by_path: dict[str, Pieces] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        self.spelt = [bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.library.id_to_piece(i)) for i in range(n))]
        self.lengths = np.array([len(x) for x in self.spelt], np.int64)

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text, num_threads=1)


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of two rising arrays of ends with one last end: the linked tokens' indices in either, in no order, and where the
    groups end in either, as the number of tokens up to there."""
    pa_, pb, ea, eb = a.tobytes(), b.tobytes(), array("q", a.tobytes()), array("q", b.tobytes())
    ri, rj, rk, xa, xb, i, j, n = [], [], [], [], [], 0, 0, len(ea)  # runs of ends that agree; links where they don't
    while i < n:
        k, step = 0, 8
        while i + k < n:
            x, y = pa_[8 * (i + k) : 8 * (i + k + step)], pb[8 * (j + k) : 8 * (j + k + step)]
            if x != y:  # the lowest bit that differs tells the first end that does
                differ = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
                k += (differ & -differ).bit_length() - 1 >> 6
                break
            k, step = k + (len(x) >> 3), step << 1
        if k:
            ri.append(i)
            rj.append(j)
            rk.append(k)
            i, j = i + k, j + k
        while i < n:  # up to where ends agree again: the last link of an irregular group begins a run
            y, z = ea[i], eb[j]
            if y == z:
                break
            xa.append(i)
            xb.append(j)
            if y < z:
                i += 1
            else:
                j += 1
    k = np.array(rk, np.int64)
    along = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
    ia, ib = np.repeat(np.array(ri, np.int64), k) + along, np.repeat(np.array(rj, np.int64), k) + along
    return np.concatenate([ia, np.array(xa, np.int64)]), np.concatenate([ib, np.array(xb, np.int64)]), ia + 1, ib + 1


class Spelling:
    """The text `a1,a2|b1;a3|b2,b3` of groups, from one table of ids with the mark that follows each."""

    def __init__(self, n: int):
        self.n = n
        self.table = np.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(n)])

    def __call__(self, a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray) -> bytes:
        out = np.empty(len(a) + len(b), np.int64)
        before_a, before_b = np.concatenate([[0], ga[:-1]]), np.concatenate([[0], gb[:-1]])
        a, b = a.copy(), b.copy()
        a[ga - 1] += self.n
        b[gb - 1] += 2 * self.n
        out[np.arange(len(a)) + np.repeat(before_b, ga - before_a)] = a
        out[np.arange(len(b)) + np.repeat(ga, gb - before_b)] = b
        shown = self.table[out].view(np.uint8)
        return shown[shown > 0].tobytes()[:-1]


def _sliced(x: np.ndarray) -> bytes:
    """64-bit numbers with all first bytes first, and so on, so that small ones compress well."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _whole(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


def _pairs(keys: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_whole(keys)), _whole(times)


def links(docs: DataFrame, a_path: str, b_path: str, key: str, text: str, keep: tuple[str, ...]) -> tuple[DataFrame, int]:
    """A written table of rows with their numbers of tokens, groups and links, the groups' digest, and the distinct pairs
    (A id times the size of B's vocabulary plus B id, as differences) with how often each is linked; and that size."""
    wide, kept = len(Pieces.of(b_path).spelt), len(keep)
    rows = docs.select(*(named(c).alias(f"_keep{i}") for i, c in enumerate(keep)), named(key).alias("_key"), named(text).alias("_text"))
    schema = with_made(rows, [f"_keep{i}" for i in range(kept)] + ["_key"], "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, _row long, _pairs binary, _times binary")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        one, other = Bytewise.of(a_path), Pieces.of(b_path)
        spelling = Spelling(max(len(one.spelt), len(other.spelt)))
        at = TaskContext.get().partitionId() << 40
        nothing = (0, 0, 0, 0, "")
        for batch in batches:
            made = []
            for value in batch.column(kept + 1):
                text_, row, at = value.as_py(), at, at + 1
                if text_:
                    spaced = " " + text_
                    ia, ib, want = one.ids(spaced), other.ids(text_), spaced.encode()
                    xa, xb = np.fromiter(ia, np.int64, len(ia)), np.fromiter(ib, np.int64, len(ib))
                    if one.spells(spaced, ia, xa, want) and b"".join(map(other.spelt.__getitem__, ib)) == want:
                        la, lb, ga, gb = aligned(np.cumsum(one.lengths[xa]), np.cumsum(other.lengths[xb]))
                        pairs, times = np.unique(xa[la] * wide + xb[lb], return_counts=True)
                        digest = sha256(spelling(xa, xb, ga, gb)).hexdigest()
                        made.append((len(ia), len(ib), len(ga), len(la), digest, row, _sliced(np.diff(pairs, prepend=0)), _sliced(times)))
                        continue
                made.append((*nothing, row, b"", b""))
            columns = [pa.array(x, type=t) for x, t in zip(zip(*made) if made else [()] * 8, [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.binary(), pa.binary()])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: kept + 1], *columns], schema.names)
        tidy()

    return written(rows.mapInArrow(align, schema), "links"), wide


def pair_counts(linked: DataFrame) -> DataFrame:
    """pair, n: how many rows link it. A written table."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([pairs, *waiting])
            own, back = np.unique(every, return_inverse=True)
            return own, np.bincount(back, np.concatenate([counts, np.ones(len(every) - len(pairs))]), len(own)).astype(np.int64)

        for batch in batches:
            for x in batch.column(0):
                found = np.cumsum(_whole(x.as_py()))
                waiting.append(found)
                size += len(found)
                if size >= TOGETHER:
                    pairs, counts = merged()
                    waiting, size = [], 0
                    if len(pairs) >= TOGETHER:
                        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])
                        pairs, counts = pairs[:0], counts[:0]
        pairs, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])
        tidy()

    return written(linked.select("_pairs").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")


def most_frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """pairs, in order, and counts of all pairs from some count on, `most` pairs at most."""
    level = F.floor(4 * F.log2("n"))
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()  # 253 levels at most
    held, least = 0, None
    for r in sorted(sizes, key=lambda r: -r["level"]):
        held += r["k"]
        if held > most:
            break
        least = r["level"]
    found = counts.filter(F.lit(False) if least is None else level >= least).toArrow()
    order = np.argsort(found.column("pair").to_numpy())
    return found.column("pair").to_numpy()[order], found.column("n").to_numpy()[order]


def token_alignment(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), frequent: int = FREQUENT) -> DataFrame:
    """key, the columns `keep`, n_a, n_b, n_groups, n_links, n_best (links whose pair's count is the highest of its A id),
    count_sum (of the counts of all links' pairs) and groups_sha256 of each row. A pair's count is the number of rows that link it."""
    linked, wide = links(docs, a_path, b_path, key, text, keep)
    counts = pair_counts(linked)
    highest = counts.groupBy(F.floor(F.col("pair") / wide).alias("a")).agg(F.max("n").alias("top"))  # A's vocabulary at most
    tops = highest.toArrow()
    best = np.zeros(int(tops.column("a").to_numpy().max(initial=0)) + 1, np.int64)
    best[tops.column("a").to_numpy()] = tops.column("top").to_numpy()
    tier = docs.sparkSession.sparkContext.broadcast((*most_frequent(counts, frequent), best))

    def looked_up(keys: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The pairs, how often each is linked, its count (where it is in the first tier) and whether it is."""
        known, n, _ = tier.value
        pairs, often = _pairs(keys, times)
        at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
        hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
        return pairs, often, n[at] if len(known) else np.zeros(len(pairs), np.int64), hit

    def first_tier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = tier.value[2]
        for batch in batches:
            sums = []
            for keys, times in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
                pairs, often, n, hit = looked_up(keys.as_py(), times.as_py())
                often = often * hit
                sums.append((int(often[n == top[pairs // wide]].sum()), int((often * n).sum())))
            made = [pa.array([s[c] for s in sums], pa.int64()) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *made], [*batch.schema.names[:-2], "_best", "_sum"])

    def second_tier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, keys, times in zip(batch.column(0), batch.column(1), batch.column(2)):
                pairs, often, _, hit = looked_up(keys.as_py(), times.as_py())
                rest = np.flatnonzero(~hit)
                if len(rest):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rest), row.as_py())), pa.array(pairs[rest]), pa.array(often[rest])], ["_row", "pair", "often"])

    own = [c for c in linked.columns if c not in ("_pairs", "_times")]
    summed = linked.select(*own, "_pairs", "_times").mapInArrow(first_tier, with_made(linked, own, "_best long, _sum long"))
    rare = linked.select("_row", "_pairs", "_times").mapInArrow(second_tier, "_row long, pair long, often long").join(counts, "pair")
    rare = rare.join(F.broadcast(highest), F.floor(F.col("pair") / wide) == F.col("a"))
    more = rare.groupBy("_row").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("often")).otherwise(0)).alias("_best2"), F.sum(F.col("n") * F.col("often")).alias("_sum2"))
    out = summed.join(more, "_row", "left")
    total = [(F.col(a) + F.coalesce(b, F.lit(0))).alias(c) for a, b, c in (("_best", "_best2", "n_best"), ("_sum", "_sum2", "count_sum"))]
    return out.select(F.col("_key").alias(key), *(F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)), "n_a", "n_b", "n_groups", "n_links", *total, "groups_sha256")


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
