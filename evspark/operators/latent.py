"""Latent semantic projection: the leading singular vectors of tf-idf weighted postings, and cosines among them.

A randomised subspace iteration: a table of random term vectors is multiplied by the postings and by their transpose a few
times, by blocks of documents and parts of the vocabulary (see blocks.py). Only Gram matrices, of as many rows as the subspace
has columns, come to the driver, so neither the vocabulary nor the number of documents is bounded by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evspark.operators import blocks as B
from evspark.operators.retrieval import postings
from evspark.sources.stored import dropped, stored

#: Query vectors that tasks compare with documents at a time, and documents in a step.
BLOCK, STEP = 4096, 1024
#: Bytes that a product may send to blocks or parts at once, or three for four characters of text if that is more; it takes
#: as many of the subspace's columns at a time, and four at least.
SENT = 128_000_000


class Latent(NamedTuple):
    """idf: term, idf. terms and docs: term or doc with v0, v1, ... singular: singular values, largest first."""

    idf: DataFrame
    terms: DataFrame
    docs: DataFrame
    singular: list[float]


def columns_of(n: int) -> list[str]:
    return [f"v{j}" for j in range(n)]


def unit_weights(posting: DataFrame, idf: DataFrame) -> DataFrame:
    """doc, term, w: (1 + ln tf) idf over the length of the document's vector; terms without idf are dropped."""
    weighed = posting.join(idf, "term").select("doc", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    norm = weighed.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighed.join(norm, "doc").select("doc", "term", (F.col("w") / F.col("norm")).alias("w"))


def product(weights: DataFrame, vectors: DataFrame, by: str, to: str) -> DataFrame:
    """`to` with the sum of weight times vector over what shares `by`."""
    own = [c for c in vectors.columns if c != by]
    if not own:
        return weights.join(vectors, by).select(to).distinct()
    return weights.join(vectors, by).groupBy(to).agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in own))


def gram(vectors: DataFrame, own: list[str]) -> np.ndarray:
    """Inner products of the columns over all rows, summed in the tasks."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(own), len(own)))
        for batch in batches:
            x = batch.to_numpy(float)
            total += x.T @ x
        yield pd.DataFrame(total, columns=own).assign(i=np.arange(len(own)))

    parts = vectors.select(*own).mapInPandas(part, ", ".join(f"{c} double" for c in own) + ", i long")
    rows = parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in own)).collect()
    return np.array([[r[c] for c in own] for r in sorted(rows, key=lambda r: r["i"])]).reshape(len(rows), len(own))


def turned(vectors: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
    """Each row's vector times the matrix."""
    own, new = [c for c in vectors.columns if c != key], columns_of(matrix.shape[1])

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame(batch[own].to_numpy(float) @ matrix, columns=new)
            out.insert(0, key, batch[key].to_numpy())
            yield out

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, *own).mapInPandas(part, f"{key} {kind}, " + ", ".join(f"{c} double" for c in new))


def latent(docs: DataFrame, key: str, text: str, components: int = 24, more: int = 8, rounds: int = 3, least_df: int = 1, index: DataFrame | None = None) -> Latent:
    """The projection of docs: weights are (1 + ln tf) (ln((1 + N) / (1 + df)) + 1) of unit length, of terms in least_df
    documents at least. Documents without terms have no vector. Without any terms there are no components."""
    own = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    n_docs, chars = own.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()  # one row
    n, width = max(B.FEWEST, -(-chars // B.CHARS)), components + more
    # repartitioned by document first, a task counts its documents' terms without a further exchange
    posting = postings(own.filter("doc IS NOT NULL").repartition(n, "doc"), "doc", "text") if index is None else index.filter("doc IS NOT NULL")
    blocks = B.packed(posting, n_docs, least_df, n, index is None)
    idf = stored(B.terms_of(blocks), "idf")
    if idf.isEmpty():
        return Latent(idf, idf.select("term"), posting.select("doc").limit(0), [])

    def random(j: int) -> DataFrame:
        return B.vectors(blocks, lambda term: F.array(*[F.xxhash64(term, F.lit(i)) / float(2**63) for i in range(j, min(j + step, width))]))

    def of_documents(terms: list[DataFrame], widths: list[int]) -> list[DataFrame]:
        return [stored(B.to_documents(blocks, x, w), "projected") for x, w in zip(terms, widths)]

    step = max(4, max(SENT, 3 * chars // 4) // (8 * blocks.pairs))
    widths, turn = [min(step, width - j) for j in range(0, width, step)], np.eye(width)
    terms = [random(j) for j in range(0, width, step)]
    seen = of_documents(terms, widths)
    for k in range(rounds + 1):
        if k:
            for old in terms:
                dropped(old)
        new = [min(step, turn.shape[1] - j) for j in range(0, turn.shape[1], step)]
        terms = [stored(B.to_terms(blocks, seen, widths, turn[:, j * step : j * step + w]), "subspace") for j, w in enumerate(new)]
        before, seen = seen, of_documents(terms, new)
        # the vectors' inner products: those of what they were made of with what is made of them
        square = B.inner(before, widths, turn, seen, new)
        for old in before:
            dropped(old)
        size, axes = np.linalg.eigh((square + square.T) / 2)
        wide = size > 1e-12 * size.max()
        widths, turn = new, axes[:, wide] / np.sqrt(size[wide])
    docs = stored(B.of_documents(blocks, seen, widths, turn, columns_of(turn.shape[1])), "projected")
    size, axes = np.linalg.eigh(gram(docs, docs.columns[1:]))
    best = np.argsort(-size)[:components]
    best = best[size[best] > 1e-12 * size.max()]
    found = B.of_terms(blocks, terms, widths, turn @ axes[:, best], columns_of(len(best)))
    return Latent(idf, found, stored(turned(docs, "doc", axes[:, best]), "docs"), np.sqrt(size[best]).tolist())


def folded(model: Latent, queries: DataFrame, key: str, text: str) -> DataFrame:
    """doc (the query's key) with the projection of its unit vector; queries without known terms have none."""
    return product(unit_weights(postings(queries, key, text), model.idf), model.terms, "term", "doc")


def nearest(queries: DataFrame, docs: DataFrame, k: int, within: float = 1e-12) -> DataFrame:
    """query, doc, score, rank: the k documents of largest cosine, over all documents; ties go to the smaller doc. Vectors
    shorter than `within` have cosine 0. Queries are a stated set: they are compared in blocks with each batch of documents."""
    own = [c for c in docs.columns if c != "doc"]
    queries = stored(queries.select(F.col("doc").alias("query"), *own), "queries")
    n_blocks = max(1, -(-queries.count() // BLOCK))
    kinds = f"query {queries.schema['query'].dataType.simpleString()}, doc {docs.schema['doc'].dataType.simpleString()}, score double"
    spark, found = docs.sparkSession, None

    def unit(x: np.ndarray) -> np.ndarray:
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.where(size > within, x / np.maximum(size, within), 0.0)

    for b in range(n_blocks):
        block = queries.filter(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == b).toPandas()  # about BLOCK rows of `components` numbers
        shared = spark.sparkContext.broadcast((block["query"].to_numpy(), unit(block[own].to_numpy(float))))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, wanted = shared.value
            for batch in batches:
                if not len(batch) or not len(names):
                    continue
                x, docs = batch[own].to_numpy(float), batch["doc"].to_numpy()
                for at in range(0, len(x), STEP):
                    score = np.round(np.clip(wanted @ unit(x[at : at + STEP]).T, -1, 1), 9)
                    least = np.partition(score, max(0, score.shape[1] - k), 1)[:, max(0, score.shape[1] - k)]
                    q, d = np.nonzero(score >= least[:, None])
                    out = pd.DataFrame({"query": names[q], "doc": docs[at + d], "score": score[q, d]})
                    yield out.sort_values(["query", "score", "doc"], ascending=[True, False, True]).groupby("query").head(k)

        part = docs.select("doc", *own).mapInPandas(best, kinds)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def diversified(pool: DataFrame, vectors: DataFrame, k: int, relevance: float = 0.72, kinds: DataFrame | None = None, apart: float = 0.55) -> DataFrame:
    """query, doc, pick: k documents of each query's pool (query, doc, score; a bounded number for each query), one by one by
    the largest relevance times score, scaled to 0..1 in the pool, less (1 - relevance) times the largest cosine with
    those picked before, 0 at least; ties go to the smaller doc. Documents without vector resemble none. Where kinds (doc,
    kind) are given, documents of different known kinds resemble each other less, by the factor `apart`."""
    own = [c for c in vectors.columns if c != "doc"]

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc").reset_index(drop=True)
        score, x = rows["score"].to_numpy(float), rows[own].fillna(0.0).to_numpy(float)
        span = score.max() - score.min()
        scaled = (score - score.min()) / span if span > 1e-12 else np.ones(len(rows))
        size = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.where(size > 1e-12, x / np.maximum(size, 1e-12), 0.0)
        met, chosen = np.zeros(len(rows)), []
        for _ in range(min(k, len(rows))):
            value = np.round(relevance * scaled - (1 - relevance) * met, 9)
            value[chosen] = -np.inf
            chosen.append(int(value.argmax()))
            like = x @ x[chosen[-1]]
            if "kind" in rows:
                kind = rows["kind"]
                like = np.where(kind.notna() & (kind != kind[chosen[-1]]) & pd.notna(kind[chosen[-1]]), apart * like, like)
            met = np.maximum(met, like)
        return rows.loc[chosen, ["query", "doc"]].assign(pick=np.arange(1, len(chosen) + 1, dtype=np.int32))

    schema = f"query {pool.schema['query'].dataType.simpleString()}, doc {pool.schema['doc'].dataType.simpleString()}, pick int"
    rows = pool.select("query", "doc", "score").join(vectors, "doc", "left")
    return (rows if kinds is None else rows.join(kinds.select("doc", "kind"), "doc", "left")).groupBy("query").applyInPandas(pick, schema)


def cosines(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs (query, doc) with `cosine` of their vectors; 0 where either has none."""
    own = [c for c in docs.columns if c != "doc"]
    theirs = queries.select(F.col("doc").alias("query"), F.array(*own).alias("_q"))
    both = pairs.join(theirs, "query", "left").join(docs.select("doc", F.array(*own).alias("_d")), "doc", "left")

    def dot(a: str, b: str):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot("_q", "_q") * dot("_d", "_d"))
    value = F.when(size > 1e-12, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot("_q", "_d") / size))).otherwise(0.0)
    return both.withColumn("cosine", value).drop("_q", "_d")
