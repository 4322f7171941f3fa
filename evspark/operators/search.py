"""Search by several ranked lists: terms with expansion, concepts in first-seen order; plans of typed sub-queries, fused twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.functions.text import exploded_terms
from evspark.operators.retrieval import bm25_terms, expanded, reciprocal_rank_fusion, top_ranked
from evspark.sources.stored import stored


def concept_index(cards: DataFrame, doc: str, concepts: Column, pool: int) -> DataFrame:
    """concept, doc, place of the first `pool` documents of each concept, in order of doc. Each task keeps `pool` rows of a
    concept before any are shuffled. Null concepts and repeats don't count."""
    rows = cards.select(F.col(doc).alias("doc"), F.explode(concepts).alias("concept")).filter("concept IS NOT NULL AND doc IS NOT NULL").distinct()
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("concept").orderBy("doc"))).filter(F.col("place") <= pool)


def by_concepts(wanted: DataFrame, index: DataFrame, pool: int) -> DataFrame:
    """query, doc, rank: the documents of a query's concepts (wanted: query, concept, pos), concept by concept, each once,
    `pool` at most."""
    met = wanted.join(index, "concept").groupBy("query", "doc").agg(F.min(F.struct("pos", "place")).alias("first"))
    order = Window.partitionBy("query").orderBy("first", "doc")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= pool).select("query", "doc", "rank")


def expanded_terms(queries: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """query, term of the distinct terms of each query, and of the vocabulary's terms most like those that it lacks."""
    own = stored(exploded_terms(queries.select(F.col(key).alias("query"), F.col(text).alias("text")), "text").distinct(), "terms")
    return stored(own.unionByName(expanded(own, vocabulary).select("query", F.col("candidate").alias("term"))).distinct(), "terms")


def searched(terms: DataFrame, wanted: DataFrame, index: DataFrame, n_docs: DataFrame, concepts: DataFrame, pool: int = 24, k: int = 12, others: tuple = ()) -> DataFrame:
    """query, doc, score: the fused lists of terms (query, term; weight 1) and of concepts (weight 1.1), and of `others`,
    (ranking, weight) each, of `pool` documents each."""
    lexical = top_ranked(bm25_terms(terms, index, n_docs), pool)
    return reciprocal_rank_fusion([(lexical, 1.0), (by_concepts(wanted, concepts, pool), 1.1), *others], k)


#: What a plan's kinds of sub-queries weigh, and how many of a kind it takes.
KINDS = {"misconception": (1.2, 2), "divergence": (1.0, 1), "complexity": (0.9, 1), "prerequisite": (1.1, 1), "problem": (0.6, 1), "fallback": (1.0, 1)}


def planned(parts: DataFrame, groups: DataFrame, fallback: str) -> DataFrame:
    """group, kind, nth, text, weight: the sub-queries of each group, from what is known of it (parts: group, kind, pos, text):
    the first of each kind by pos, as many as the kind may have, 6 in all. Null and empty texts are left out; a group (groups:
    group) without any gets one of the text `fallback`."""
    limits = F.create_map(*[F.lit(x) for kind, (_, n) in KINDS.items() for x in (kind, n)])
    weights = F.create_map(*[F.lit(x) for kind, (w, _) in KINDS.items() for x in (kind, w)])
    own = parts.filter(F.col("kind").isin([x for x in KINDS if x != "fallback"]) & (F.trim("text") != ""))
    ranked = own.withColumn("nth", F.row_number().over(Window.partitionBy("group", "kind").orderBy("pos", "text")))
    chosen = ranked.filter(F.col("nth") <= limits[F.col("kind")]).select("group", "kind", "nth", "text")
    bare = groups.select("group").distinct().join(chosen, "group", "left_anti").select("group", F.lit("fallback").alias("kind"), F.lit(1).alias("nth"), F.lit(fallback).alias("text"))
    return chosen.unionByName(bare).withColumn("weight", weights[F.col("kind")])


def retrieved(found: DataFrame, plan: DataFrame, k: int, least: int = 4, fusion: int = 12) -> DataFrame:
    """group, doc, score: sub-queries' results (found: query, doc, score), the best max(k, least) of each, fused by their
    ranks and the sub-queries' weights (plan: group, query, weight)."""
    ranked = top_ranked(found, max(k, least)).join(plan.select("query", "group", "weight"), "query")
    return ranked.groupBy("group", "doc").agg(F.sum(F.col("weight") / (fusion + F.col("rank"))).alias("score"))
