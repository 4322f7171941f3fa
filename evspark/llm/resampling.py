"""Importance resampling of documents towards a target's distribution, with weights by bit-sliced aggregation.

Features are all runs of up to `longest` words, hashed to BUCKETS buckets. What a bucket's features tell of the target, its
gain, is a whole number. A document's counts are cut into bitplanes: plane j has a bit for each bucket whose count has the
j-th bit. Gains are cut alike, in two's complement, so their highest plane is the sign. The sum of all features' gains is
then a sum over pairs of planes of the bits they share, counted after an AND and shifted by the planes' places, with the
sign plane's taken off: whole numbers throughout, so weights are exact.

Scores add Gumbel noise that depends on the key alone; drawing the highest scores is sampling by the weights without
replacement. Texts are read twice, for the corpus's counts and for the weights, and never shuffled: what tasks hand on are
BUCKETS sums. Ranks are counted range by range.

Null and empty texts have no features and weight 0; they aren't drawn unless least_words is 0. Rows without key count in the
corpus, but have no score and aren't drawn. Texts of any length count whole, run by run. Rows that repeat are drawn each;
those that tie in score and key come in any order of theirs. An empty target or an empty table is allowed. Columns to keep
may have any names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import named, table, with_made, written
from evspark.llm.numbering import numbered
from evspark.llm.shingles import PUNCTUATION, LOWER, texts_of

BUCKETS = 10_000
#: Bytes of text that are cut into words at a time.
RUN = 1 << 20

_WORDS = bytes(32 if PUNCTUATION[LOWER[b]] else LOWER[b] for b in range(256))
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_BYTES = -(-BUCKETS // 64) * 8


def bucket_counts(data: bytes, longest: int) -> tuple[int, np.ndarray]:
    """The number of words, and how many runs of 1 to `longest` of them fall into each bucket."""
    counts, n_words, tail, at = np.zeros(BUCKETS, np.int64), 0, [], 0
    while at < len(data):
        gap = _GAP.search(data, at + RUN)
        to = gap.start() if gap else len(data)
        new = data[at:to].translate(_WORDS).split()
        n_words += len(new)
        words = tail + new
        spaced, runs = [b" " + w for w in words], list(map(crc32, words))
        for n in range(1, longest + 1):
            if n > 1:
                runs = list(map(crc32, spaced[n - 1 :], runs))
            own = runs[max(0, len(tail) - n + 1) :]  # those that end in new words
            counts += np.bincount(np.array(own, np.int64) % BUCKETS, minlength=BUCKETS)
        tail, at = words[len(words) - longest + 1 :] if longest > 1 else [], to
    return n_words, counts


def planes(values: np.ndarray, n: int) -> np.ndarray:
    """The n lowest bits of whole numbers, two's complement, as n rows of 64-bit words with a bit for each number."""
    bits = (values[None, :] >> np.arange(n)[:, None] & 1).astype(np.uint8)
    packed = np.zeros((n, _BYTES), np.uint8)
    packed[:, : -(-len(values) // 8)] = np.packbits(bits, axis=1, bitorder="little")
    return packed.view(np.uint64)


def sliced_sum(counts: np.ndarray, gain_planes: np.ndarray) -> int:
    """The sum of counts times gains, exactly."""
    n = int(counts.max()).bit_length()
    if not n:
        return 0
    shared = np.bitwise_count(planes(counts, n)[:, None, :] & gain_planes[None, :, :]).sum(axis=2, dtype=np.int64).tolist()
    top = len(gain_planes) - 1
    return sum((bits << j + k) * (-1 if k == top else 1) for j, row in enumerate(shared) for k, bits in enumerate(row))


def corpus_counts(rows: DataFrame, text: str, longest: int) -> np.ndarray:
    """How many features of all rows fall into each bucket: tasks hand on a row for each bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, cuts = texts_of(batch.column(0))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                total += bucket_counts(data[a:b].tobytes(), longest)[1]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    found = rows.select(named(text)).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # BUCKETS rows at most
    out = np.zeros(BUCKETS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier each bucket is in the target, one count added, rounded down."""
    a, b = float(own.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * a / ((s + 1.0) * b))) for s, t in zip(own.tolist(), target.tolist())], np.int64)


def noise(seed: int, key: str) -> int:
    """Thousandths of a Gumbel number that depends on the key alone, rounded down."""
    h = int(sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", keep: tuple[str, ...] = (), share: int = 25, least_words: int = 20, longest: int = 2, seed: int = 7) -> DataFrame:
    """key, the columns `keep`, n_words, n_features, weight, score and rank of each row of docs. Of those with least_words
    words or more, the `share` hundredths of highest score are drawn, ties to the smaller key; rank counts them from 1 and is
    null for others."""
    own = gains(corpus_counts(docs, text, longest), corpus_counts(target, target_text, longest))
    n_planes = int(np.abs(own).max()).bit_length() + 1
    gain_planes = planes(own, n_planes)
    kept = len(keep)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            data, cuts = texts_of(batch.column(kept + 2))
            words, features, weights = [], [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                n_words, counts = bucket_counts(data[a:b].tobytes(), longest)
                n = int(counts.sum())
                words.append(n_words)
                features.append(n)
                weights.append(sliced_sum(counts, gain_planes) // n if n else 0)
            scores = [None if k is None else w + noise(seed, k) for k, w in zip(batch.column(kept + 1).to_pylist(), weights)]
            place = range(at, at + len(words))  # tells rows that repeat apart
            at += len(words)
            made = [pa.array(x, pa.int64()) for x in (words, features, weights, scores, place)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: kept + 1], *made], schema.names)

    rows = docs.select(*(named(c).alias(f"_keep{i}") for i, c in enumerate(keep)), named(key).alias("_key"), named(key).cast("string").alias("_name"), named(text).alias("_text"))
    schema = with_made(rows, [f"_keep{i}" for i in range(kept)] + ["_key"], "n_words long, n_features long, weight long, score long, _place long")
    scored = written(rows.mapInArrow(weigh, schema), "scored")
    takes_part = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    n_drawn = share * scored.filter(takes_part).count() // 100
    ranked = numbered(scored.filter(takes_part).withColumn("_down", -F.col("score")), ["_down", "_key", "_place"])
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= n_drawn, F.col("rank"))).drop("_down")
    others = scored.filter(~takes_part).withColumn("rank", F.lit(None).cast("long"))
    out = ranked.unionByName(others)
    return out.select(F.col("_key").alias(key), *(F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)), "n_words", "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark, sf_dir: str) -> DataFrame:
    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def _words_sql(rows: str, key: str) -> str:
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"(SELECT {key} AS id, regexp_extract_all(translate(coalesce(text, ''), {letters}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM {rows})"


def _features_sql(words: str) -> str:
    return f"SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM {words}"


#: CRC-32 of each distinct feature byte by byte, by the table that eight shifts of each byte make.
OP11_SQL = f"""
WITH RECURSIVE tab(i, c, r) AS (
  SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, r + 1 FROM tab WHERE r < 8
), t AS (SELECT list(c ORDER BY i) AS t FROM tab WHERE r = 8),
dw AS (SELECT row_number() OVER () AS n, id, w FROM {_words_sql('documents', 'doc_id')}),
df AS (SELECT n, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM dw),
bf AS ({_features_sql(_words_sql('benchmark', 'item_id'))}),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM bf)),
b AS (SELECT f, list_reduce(list_transform(range(0, length(x) // 2), lambda k: CAST('0x' || substring(x, 2 * k + 1, 2) AS BIGINT)), lambda c, v: xor(c >> 8, t[CAST(xor(c & 255, v) AS BIGINT) + 1]), 4294967295) AS c FROM h, t),
k AS (SELECT f, xor(c, 4294967295) % {BUCKETS} AS bucket FROM b),
s AS (SELECT bucket, count(*) AS s FROM df JOIN k USING (f) GROUP BY 1), g AS (SELECT bucket, count(*) AS t FROM bf JOIN k USING (f) GROUP BY 1),
z AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS} AS s, (SELECT coalesce(sum(t), 0) FROM g) + {BUCKETS} AS t),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(g.t, 0) + 1)::DOUBLE * z.s::DOUBLE / ((coalesce(s.s, 0) + 1)::DOUBLE * z.t::DOUBLE))) AS BIGINT) AS gain FROM s FULL JOIN g USING (bucket), z),
w AS (SELECT n, count(*) AS m, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM df JOIN k USING (f) JOIN gain USING (bucket) GROUP BY n),
o AS (SELECT id AS doc_id, len(w) AS n_words, coalesce(m, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substring(sha256('7:' || id), 1, 8) AS BIGINT) AS h FROM dw LEFT JOIN w USING (n)),
p AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM p)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 25 * n // 100 THEN CAST(r AS BIGINT) END AS rank FROM r
"""
