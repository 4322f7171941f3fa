"""Token counts of whole texts by a map-side lookup in two tiers.

The first tier is a compact table of frequent pieces and their token counts, broadcast to all tasks; the second is
each worker's own bounded cache, filled by encoding what the table lacks. No piece is shuffled: to find the frequent
ones, each task hands on a summary of at most `per_task` heavy hitters.

Nulls and empty texts have 0 tokens; a text of any length is counted whole; repeated rows are counted each;
other columns don't matter. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import table
from evspark.llm.tokens import CACHE_ENTRIES, LONGEST, Encoder, pieces

#: Entries of the broadcast table: with LONGEST characters each, below 17 MB whatever the input; 1 MB as a rule.
TABLE_ENTRIES = 65_536


def frequent_pieces(docs: DataFrame, text: str, per_task: int = 2048, top: int = TABLE_ENTRIES) -> list[str]:
    """The pieces that occur most in all texts, by summaries of heavy hitters: counts are those of the survivors of pruning."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen.update(pieces(value or "") or ())
                if len(seen) > 100 * per_task:
                    seen = Counter(dict(seen.most_common(25 * per_task)))
        best = [(x, n) for x, n in seen.most_common(per_task) if len(x) <= LONGEST]
        yield pa.RecordBatch.from_pydict({"piece": pa.array([x for x, _ in best], pa.string()), "n": pa.array([n for _, n in best], pa.int64())})

    found = docs.select(text).mapInArrow(summary, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return [r.piece for r in found.orderBy(F.desc("n"), "piece").limit(top).collect()]


class Lengths:
    """Token counts by the broadcast table, then by this worker's cache, then by the library."""

    _by_key: dict[tuple[str, int], Lengths] = {}

    def __init__(self, path: str, pieces_: str, counts: bytes):
        self.encoder = Encoder.of(path)
        self.table = dict(zip(pieces_.split(" "), counts)) if pieces_ else {}
        self.cache: dict[str, int] = {}
        self.before: dict[str, int] = {}

    @classmethod
    def of(cls, path: str, packed: tuple[str, bytes]) -> Lengths:
        key = (path, hash(packed))
        if key not in cls._by_key:
            cls._by_key.clear()
            cls._by_key[key] = cls(path, *packed)
        return cls._by_key[key]

    def miss(self, piece: str) -> int:
        n = self.before.get(piece)
        if n is None:
            n = len(self.encoder.piece(piece)) // 4
        if len(piece) <= LONGEST:
            if len(self.cache) >= CACHE_ENTRIES:
                self.before, self.cache = self.cache, {}
            self.cache[piece] = n
        return n

    def count(self, text: str) -> int:
        parts = pieces(text)
        if parts is None:
            return len(self.encoder.whole(text)) // 4
        got = list(map(self.table.get, parts))
        rest = [x for x, n in zip(parts, got) if n is None]
        if not rest:
            return sum(got)
        cached = list(map(self.cache.get, rest))
        return sum(filter(None, got)) + sum(self.miss(x) if n is None else n for x, n in zip(rest, cached))


def token_counts(docs: DataFrame, path: str, keys: list[str], text: str = "text", limit: int = 2048) -> DataFrame:
    """`keys` of each row of docs with n_bytes, n_tokens and over_limit (n_tokens > limit) of its whole `text`."""
    frequent = frequent_pieces(docs, text)
    encoder = Encoder.of(path)
    lengths = [len(encoder.piece(x)) // 4 for x in frequent]
    kept = [(x, n) for x, n in zip(frequent, lengths) if n < 256]
    packed = docs.sparkSession.sparkContext.broadcast((" ".join(x for x, _ in kept), bytes(n for _, n in kept)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lengths.of(path, packed.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(len(keys)).to_pylist()]
            n = [lookup.count(x) for x in texts]
            done = {"n_bytes": pa.array([len(x.encode()) for x in texts], pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())}
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *done.values()], [*keys, *done])

    rows = docs.select(*keys, text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(count, f"{schema}, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), ["doc_id"])
