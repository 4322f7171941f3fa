"""Exact top-k search by inner product with multi-resolution segment statistics.

The squared distance of two vectors is at least the sum over segments of n((mean - mean')^2 + (dev - dev')^2), n being
a segment's width; in terms of the inner product, it is at most the sum of n(mean mean' + dev dev'). Candidates whose
bound over coarse segments can't reach a query's k-th best score so far go first, then those by finer segments; what
survives gets its exact score.

Turning all vectors alike changes no inner product, so the bounds are taken in the principal axes of a bounded sample, the
strongest first, and segments grow from axis to axis: where the vectors differ most, the bounds are nearly exact.

Queries are a stated set. They are written in blocks of bounded size beside their exact k-th best score among the sample,
which is where their threshold begins. Each task reads its candidates once, holds a bounded run of them against block
after block, and hands on at most k rows for a query, none below its threshold. Nothing but the sample reaches the driver.

Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without an id; vectors
are compared with those of their own width only, of any width. Rows that repeat a vec_id are candidates each, of repeated
queries the one of the smallest vector counts, and no row of a query's own id is its candidate. An empty table gives no
rows. Other columns aren't read. Scores are exact while they stay below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.llm.common import Chunks, named, new_path, table, tidy, written

#: Queries of a block, and candidates that are compared with it at a time.
QUERY_BLOCK, CANDIDATES = 2048, 2048
#: Vectors of the sample that sets axes and first thresholds.
SAMPLE = 1024
#: Bytes of candidates that a task holds against all blocks.
HELD_BYTES = 32 << 20


def boundaries(width: int, segments: int) -> list[int]:
    """Where segments end whose widths grow evenly from 1 on, about `segments` of them."""
    return sorted({max(1, round(width ** (i / segments))) for i in range(1, segments + 1)})


def segment_features(x: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose inner products bound those of x from above: root-width times means and deviations of the segments."""
    parts = np.split(x, boundaries(x.shape[1], segments)[:-1], axis=1)
    return np.concatenate([np.stack([np.sqrt(p.shape[1]) * f(p, axis=1) for p in parts], 1) for f in (np.mean, np.std)], 1)


def axes(sample: np.ndarray) -> np.ndarray:
    """The principal axes of vectors, as columns, the strongest first."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1] if len(sample) else np.eye(sample.shape[1])


class Best:
    """The k best (score, id) of each query so far, at least `floor`; ties go to the smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, levels: tuple[int, ...], turn: np.ndarray | None = None, floor: np.ndarray | None = None):
        self.ids, self.queries, self.k, self.levels = ids, queries, k, levels
        self.turn = np.eye(queries.shape[1]) if turn is None else turn
        self.features = [segment_features(queries @ self.turn, s) for s in levels]
        n = len(ids)
        self.floor = np.full(n, -np.inf) if floor is None else floor
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        #: pairs there were, and those left after each level
        self.pairs, self.left = 0, [0] * len(levels)

    def add(self, ids: np.ndarray, x: np.ndarray, turned: np.ndarray | None = None) -> None:
        least = np.maximum(self.floor, self.score[:, -1])
        slack = 0.5 + 1e-9 * np.abs(least, where=np.isfinite(least), out=np.zeros(len(least)))
        turned = x @ self.turn if turned is None else turned
        alive, columns, rows = np.ones((len(self.ids), len(ids)), bool), np.arange(len(ids)), np.arange(len(self.ids))
        self.pairs += alive.size
        for n, (segments, own) in enumerate(zip(self.levels, self.features)):
            if not np.isneginf(least).all():
                bound = own[rows] @ segment_features(turned[columns], segments).T
                alive &= bound >= (least - slack)[rows][:, None]
                some, kept = alive.any(0), alive.any(1)
                alive, columns, rows = alive[kept][:, some], columns[some], rows[kept]
            self.left[n] += int(alive.sum())
        if not len(columns):
            return
        ids, x = ids[columns], x[columns]
        score = np.where(alive, self.queries[rows] @ x.T, -np.inf)
        score[self.ids[rows][:, None] == ids[None, :]] = -np.inf
        if len(ids) > self.k:
            score[score < -np.partition(-score, self.k - 1, 1)[:, self.k - 1][:, None]] = -np.inf
        score[score < least[rows][:, None]] = -np.inf
        r, c = np.nonzero(np.isfinite(score))
        if not len(r):
            return
        touched = np.unique(r)
        q = np.concatenate([r, np.repeat(touched, self.k)])
        s = np.concatenate([score[r, c], self.score[rows[touched]].ravel()])
        i = np.concatenate([ids[c], self.id[rows[touched]].ravel()])
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, touched)
        at = (first[:, None] + np.arange(self.k)[None, :]).ravel()
        self.score[rows[touched]], self.id[rows[touched]] = s[at].reshape(-1, self.k), i[at].reshape(-1, self.k)


def by_width(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """width -> ids and a matrix of the vectors of that width."""
    ids = ids.to_numpy(zero_copy_only=False)
    flat, cuts = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
    width, out = np.diff(cuts), {}
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        out[w] = ids[own], flat[cuts[own][:, None] + np.arange(w)[None, :]]
    return out


def floors(ids: np.ndarray, x: np.ndarray, sample: tuple[np.ndarray, np.ndarray] | None, k: int) -> np.ndarray:
    """The k-th best score of each query among the sample, which its k-th best among all can't be below."""
    if sample is None or len(sample[0]) < k:
        return np.full(len(ids), -np.inf)
    score = x @ sample[1].T
    score[ids[:, None] == sample[0][None, :]] = -np.inf
    return -np.partition(-score, k - 1, 1)[:, k - 1]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, levels: tuple[int, ...] = (4, 16)) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of the largest inner products of floor(scale * x), for each query."""
    spark = vectors.sparkSession
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    usable = vectors.filter(named(key).isNotNull() & (F.size(vector) > 0) & finite)
    rows = usable.select(named(key).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("x"), is_query.alias("q"))
    some = rows.select("id", "x").orderBy(F.xxhash64("id", "x"), "id").limit(SAMPLE).toArrow()  # the same rows whenever it is computed
    sample = by_width(some.column("id").combine_chunks(), some.column("x").combine_chunks()) if len(some) else {}
    known = spark.sparkContext.broadcast({w: (i, x, axes(x)) for w, (i, x) in sample.items()})
    folder = new_path(spark, "queries")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        for batch in batches:
            for w, (ids, x) in by_width(batch.column(0), batch.column(1)).items():
                least = floors(ids, x, known.value.get(w, (None, None))[:2] if w in known.value else None, k)
                for at in range(0, len(ids), QUERY_BLOCK):
                    own = slice(at, at + QUERY_BLOCK)
                    block = pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(list(x[own]), pa.list_(pa.float64())), pa.array(least[own])], ["id", "x", "least"])
                    done.append(Chunks(folder).write([block], block.schema))
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], ["block"])

    queries = rows.filter("q").groupBy("id").agg(F.min("x").alias("x"))
    blocks = spark.sparkContext.broadcast([r.block for r in written(queries.mapInArrow(store, "block long"), "blocks").collect()])  # names only

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def found() -> Iterator[pa.RecordBatch]:
            for name in blocks.value:
                block = Chunks(folder).read(name)
                (w, (ids, x)), = by_width(block.column("id").combine_chunks(), block.column("x").combine_chunks()).items()
                if w not in held:
                    continue
                turn = known.value[w][2] if w in known.value else np.eye(w)
                best = Best(ids, x, k, levels, turn, block.column("least").to_numpy())
                for i, v, turned in held[w]:
                    for at in range(0, len(i), CANDIDATES):
                        own = slice(at, at + CANDIDATES)
                        best.add(i[own], v[own], turned[own])
                got = np.isfinite(best.score)
                q = np.repeat(best.ids, k).reshape(got.shape)[got]
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best.id[got]), pa.array(best.score[got].astype(np.int64))], ["query_id", "vec_id", "score"])

        for batch in batches:
            for w, (i, v) in by_width(batch.column(0), batch.column(1)).items():
                held.setdefault(w, []).append((i, v, v @ (known.value[w][2] if w in known.value else np.eye(w))))
                size += 2 * v.nbytes
            if size >= HELD_BYTES:
                yield from found()
                held, size = {}, 0
        if held:
            yield from found()
        tidy()

    best = rows.select("id", "x").mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
