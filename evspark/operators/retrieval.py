"""Retrieval: BM25, tf-idf cosine, reciprocal rank fusion, query expansion, unknown vocabulary, evidence within a budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.functions.text import exploded_terms
from evspark.operators.statistics import with_sum_before
from evspark.sources.stored import stored


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, term, tf, of every term of every document."""
    return exploded_terms(docs.select(F.col(key).alias("doc"), F.col(text).alias("text")), "text").groupBy("doc", "term").agg(F.count("*").alias("tf"))


def indexed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """postings as a written table, so that several rankings read the texts once."""
    return stored(postings(docs, key, text), "postings")


def bm25_idf(posting: DataFrame, n_docs: DataFrame) -> DataFrame:
    """term, df, idf = ln(1 + (N - df + .5) / (df + .5)). n_docs: a row with n."""
    df = posting.groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n_docs.select("n")), how="cross").select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def top_ranked(scored: DataFrame, k: int, group: str = "query", item: str = "doc", score: str = "score") -> DataFrame:
    """The k best of each group by the score to 9 decimals, then the smaller item, with their rank."""
    order = Window.partitionBy(group).orderBy(F.desc(F.round(score, 9)), item)
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bm25(queries: DataFrame, docs: DataFrame, query_key: str, query_text: str, doc_key: str, doc_text: str, k1: float = 1.35, b: float = 0.72, index: DataFrame | None = None) -> DataFrame:
    """query, doc, score of documents that share a term with the query; a term that a query repeats counts once.

    Only postings of query terms are weighed; document lengths are sums over the same written postings (index).
    """
    index = indexed(docs, doc_key, doc_text) if index is None else index
    wanted = exploded_terms(queries.select(F.col(query_key).alias("query"), F.col(query_text).alias("text")), "text").distinct()
    return bm25_terms(wanted, index, docs.agg(F.count("*").alias("n")), k1, b)


def bm25_terms(wanted: DataFrame, index: DataFrame, n_docs: DataFrame, k1: float = 1.35, b: float = 0.72) -> DataFrame:
    """query, doc, score of documents (index: doc, term, tf) that share one of a query's distinct terms (wanted: query, term)."""
    known = index.join(wanted.select("term").distinct(), "term", "left_semi")
    sized = index.groupBy("doc").agg(F.sum("tf").alias("dl"))
    terms = index.agg(F.sum("tf").alias("terms"))  # one row, as n_docs
    total = n_docs.join(terms, how="cross").select("n", (F.col("terms") / F.col("n")).alias("avgdl"))
    weighed = known.join(bm25_idf(known, total), "term").join(sized, "doc").join(F.broadcast(total), how="cross")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return weighed.select("term", "doc", part.alias("part")).join(wanted, "term").groupBy("query", "doc").agg(F.sum("part").alias("score"))


def tfidf_cosine(queries: DataFrame, docs: DataFrame, query_key: str, query_text: str, doc_key: str, doc_text: str, index: DataFrame | None = None) -> DataFrame:
    """query, doc, score: cosine of (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1) vectors; query terms no document has are dropped."""
    known = indexed(docs, doc_key, doc_text) if index is None else index
    n = docs.agg(F.count("*").alias("n"))  # one row
    idf = known.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n), how="cross").select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))

    def vectors(posting: DataFrame) -> DataFrame:
        return posting.join(idf, "term").select("doc", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))

    own, theirs = vectors(postings(queries, query_key, query_text)), vectors(known)
    norm = theirs.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    query_norm = own.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("query_norm"))
    dots = theirs.join(own.select(F.col("doc").alias("query"), "term", F.col("w").alias("qw")), "term").groupBy("query", "doc").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    scored = dots.join(norm, "doc").join(query_norm.withColumnRenamed("doc", "query"), "query")
    return scored.select("query", "doc", (F.col("dot") / (F.col("norm") * F.col("query_norm"))).alias("score"))


def reciprocal_rank_fusion(rankings: list[tuple[DataFrame, float]], k: int = 12) -> DataFrame:
    """query, doc, score = sum of weight / (k + rank) over rankings (query, doc, rank)."""
    if not rankings:
        raise ValueError("no rankings")
    every = None
    for ranking, weight in rankings:
        part = ranking.select("query", "doc", (F.lit(weight) / (k + F.col("rank"))).alias("part"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("query", "doc").agg(F.sum("part").alias("score"))


def trigram_codes(terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each term the distinct trigrams of $term$, as numbers: (term's place, number) of all of them."""
    sizes, rows, codes = np.array([len(t) for t in terms]), [], []
    for size in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == size)
        letters = np.array([f"${terms[i]}$" for i in at], f"<U{size + 2}").view(np.uint32).reshape(len(at), -1).astype(np.int64)
        grams = np.sort(letters[:, :-2] << 42 | letters[:, 1:-1] << 21 | letters[:, 2:], 1)
        first = np.ones(grams.shape, bool)
        first[:, 1:] = grams[:, 1:] != grams[:, :-1]
        rows.append(np.repeat(at, first.sum(1)))
        codes.append(grams[first])
    return (np.concatenate(rows), np.concatenate(codes)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def most_similar(asked: list[str], vocabulary: list[str], least: float, best: int) -> Iterator[tuple[str, str, float]]:
    """term, candidate, similarity: of each asked term the `best` of the vocabulary by Jaccard similarity of trigrams, `least` at
    least, ties to the smaller one. Trigrams that both have are counted for the whole vocabulary at once, term by term."""
    rows, codes = trigram_codes(vocabulary)
    order = np.argsort(codes, kind="stable")
    rows, (names, starts) = rows[order], np.unique(codes[order], return_index=True)
    ends = np.append(starts[1:], len(rows))
    size = np.bincount(rows, minlength=len(vocabulary))
    own, wanted = trigram_codes(asked)
    order = np.argsort(own, kind="stable")
    own, wanted = own[order], wanted[order]
    at = np.minimum(np.searchsorted(names, wanted), max(0, len(names) - 1))
    known = names[at] == wanted if len(names) else np.zeros(len(wanted), bool)
    n = np.bincount(own, minlength=len(asked))
    bounds = np.searchsorted(own, np.arange(len(asked) + 1))
    shared = np.zeros(len(vocabulary), np.uint16)
    for i, term in enumerate(asked):
        place = slice(bounds[i], bounds[i + 1])
        for g in at[place][known[place]]:
            shared[rows[starts[g] : ends[g]]] += 1
        met = np.flatnonzero(shared >= max(1, int(n[i] * least - 1e-9)))  # at least that share of the term's own
        both = shared[met].astype(np.int64)
        shared.fill(0)
        similarity = both / (n[i] + size[met] - both)
        enough = similarity >= least
        met, similarity = met[enough], similarity[enough]
        if len(met) > best:
            enough = similarity >= np.partition(similarity, len(met) - best)[len(met) - best]
            met, similarity = met[enough], similarity[enough]
        for value, candidate in sorted((-s, vocabulary[m]) for s, m in zip(similarity.tolist(), met))[:best]:
            yield term, candidate, -value


#: Terms of the vocabulary, and asked terms, that a task compares.
KNOWN, ASKED = 250_000, 10_000


def expanded(terms: DataFrame, vocabulary: DataFrame, least: float = 0.45, best: int = 2, shortest: int = 5) -> DataFrame:
    """query, term, candidate, similarity, rank: for each term (query, term) of `shortest` letters or more that vocabulary
    (term, distinct) lacks, the `best` terms there by Jaccard similarity of padded trigrams, `least` at least.

    Both are dealt to places by hash, and each of the one meets each of the other in a task, which keeps its best.
    """
    unknown = stored(terms.filter(F.length("term") >= shortest).join(vocabulary, "term", "left_anti").select("query", "term").distinct(), "unknown")
    asked, known = stored(unknown.select("term").distinct(), "asked"), stored(vocabulary.select("term").filter("term IS NOT NULL"), "vocabulary")
    n, m = (max(1, -(-df.count() // size)) for df, size in ((asked, ASKED), (known, KNOWN)))

    def dealt(df: DataFrame, kind: str, own: int, other: int) -> DataFrame:
        places = F.sequence(F.lit(0), F.lit(other - 1))
        return df.select(F.lit(kind).alias("kind"), "term", F.pmod(F.xxhash64("term"), F.lit(own)).cast("int").alias("own"), F.explode(places).alias("other"))

    def compare(table: pa.Table) -> pa.Table:
        words, kinds = table.column("term").to_pylist(), table.column("kind").to_pylist()
        own = {kind: [w for w, k in zip(words, kinds) if k == kind] for kind in "ak"}
        found = list(most_similar(own["a"], own["k"], least, best))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found) if found else ([], [], []), (pa.string(), pa.string(), pa.float64()))], names=["term", "candidate", "similarity"])

    left = dealt(asked, "a", n, m).withColumn("place", F.col("own") * m + F.col("other"))
    right = dealt(known, "k", m, n).withColumn("place", F.col("other") * m + F.col("own"))
    both = left.unionByName(right).select("place", "kind", "term").repartition(n * m, "place")
    similar = both.groupBy("place").applyInArrow(compare, "term string, candidate string, similarity double")
    order = Window.partitionBy("term").orderBy(F.desc("similarity"), "candidate")
    chosen = stored(similar.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best), "similar")
    return unknown.join(chosen, "term").select("query", "term", "candidate", "similarity", "rank")


def unknown_vocabulary(terms: DataFrame, index: DataFrame, n_docs: DataFrame) -> DataFrame:
    """query, ratio: the share of a query's weight that terms no document has carry. Terms (query, term) are distinct and
    weigh their idf; unknown ones weigh the most, ln(1 + (N + .5) / .5)."""
    idf = bm25_idf(index.join(terms.select("term").distinct(), "term", "left_semi"), n_docs)
    most = F.log(1 + (F.col("n") + 0.5) / 0.5)
    weighed = terms.join(idf, "term", "left").join(F.broadcast(n_docs.select("n")), how="cross").withColumn("w", F.coalesce("idf", most))
    return weighed.groupBy("query").agg((F.sum(F.when(F.col("idf").isNull(), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("ratio"))


def within_budget(ranked: DataFrame, group: str, rank: str, size: Column, budget: int) -> DataFrame:
    """Each group's rows in order of rank as long as their sizes together (used) stay within budget. Sums run within ranges,
    so no task holds a whole group. Rows of one rank stay or go together, null sizes are 0, nulls are a group and a rank."""
    keyed = ranked.withColumns({"_group": F.struct(group), "_rank": F.struct(rank)})  # of structs nulls are equal
    sizes = keyed.groupBy("_group", "_rank").agg(F.coalesce(F.sum(size), F.lit(0)).alias("_size"))
    kept = with_sum_before(sizes, ["_group"], "_rank", "_size").withColumn("used", F.col("before") + F.col("_size")).filter(F.col("used") <= budget)
    return keyed.join(kept.select("_group", "_rank", "used"), ["_group", "_rank"]).select(*ranked.columns, "used")


def lexical_support(claims: DataFrame, cards: DataFrame, index: DataFrame, n_docs: DataFrame) -> DataFrame:
    """query, doc, overlap of cards (query, doc): the share of a claim's weight that terms of the card carry. A claim's
    terms (query, term) are distinct and weigh their idf; those that no document has weigh the most."""
    idf = bm25_idf(index.join(claims.select("term").distinct(), "term", "left_semi"), n_docs)
    most = F.log(1 + (F.col("n") + 0.5) / 0.5)
    weighed = claims.join(idf, "term", "left").join(F.broadcast(n_docs.select("n")), how="cross").select("query", "term", F.coalesce("idf", most).alias("w"))
    total = weighed.groupBy("query").agg(F.sum("w").alias("total"))
    shared = cards.join(weighed, "query").join(index.select("doc", "term"), ["doc", "term"]).groupBy("query", "doc").agg(F.sum("w").alias("shared"))
    return cards.join(total, "query").join(shared, ["query", "doc"], "left").select("query", "doc", (F.coalesce("shared", F.lit(0.0)) / F.col("total")).alias("overlap"))
