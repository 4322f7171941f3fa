"""Queries of concept lists, expansion inside the search, plans of sub-queries and their two-level fusion; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evspark.functions import duck
from evspark.functions import text as T
from evspark.operators import retrieval as R
from evspark.operators import search as H
from evspark.plans.text_queries import BM25, PADDED, POSTINGS
from evspark.sources.stored import stored
from evspark.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return register


def wanted_concepts(spark, d, queries=None, key="item_id"):
    """query, concept, pos: two languages that each item asks for."""
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("item_id").alias("i")) if queries is None else queries.select("query", F.col(key).alias("i"))
    names = F.when(F.col("i") % 2 == 0, F.array(F.lit("es"), F.lit("en"))).otherwise(F.array(F.lit("de"), F.lit("fr")))
    return rows.select("query", F.posexplode(names).alias("pos", "concept"))


CONCEPTS = "ci AS (SELECT lang AS concept, doc_id AS doc, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place FROM (SELECT DISTINCT lang, doc_id FROM documents WHERE lang IS NOT NULL))"


def concept_hits_sql(rows: str) -> str:
    """by (query, doc, rank) of rows (query, i)."""
    names = "CASE WHEN i % 2 = 0 THEN ['es', 'en'] ELSE ['de', 'fr'] END"
    return f"wc AS (SELECT query, unnest([0, 1]) AS pos, unnest({names}) AS concept FROM {rows}), cm AS (SELECT query, doc, min({{'pos': pos, 'place': place}}) AS f FROM wc JOIN ci USING (concept) WHERE place <= 24 GROUP BY ALL), ch AS (SELECT query, doc, rank FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY f.pos, f.place, doc) AS rank FROM cm) WHERE rank <= 24)"


@query("concept_hits", f"WITH {CONCEPTS}, {concept_hits_sql('(SELECT item_id AS query, item_id AS i FROM benchmark)')} SELECT query AS item_id, doc AS doc_id, CAST(rank AS INTEGER) AS rank FROM ch")
def concept_hits(spark, d):
    index = H.concept_index(table(spark, d, "documents"), "doc_id", F.array("lang"), 24)
    return H.by_concepts(wanted_concepts(spark, d), index, 24).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "rank")


def expanded_sql(rows: str) -> str:
    """q (query, term): the terms of rows (query, text) and of the documents' vocabulary most like those that it lacks."""
    return f"""u AS (SELECT DISTINCT query, unnest({duck.tokens('text')}) AS term FROM {rows}), v AS (SELECT DISTINCT term FROM post), k AS (SELECT * FROM u WHERE length(term) >= 5 AND term NOT IN (SELECT term FROM v)),
xa AS (SELECT term, len(g) AS n, unnest(g) AS gram FROM (SELECT DISTINCT term, {PADDED} AS g FROM k)), xb AS (SELECT term AS candidate, len(g) AS m, unnest(g) AS gram FROM (SELECT term, {PADDED} AS g FROM v)),
xs AS (SELECT term, candidate, CAST(count(*) AS DOUBLE) / (n + m - count(*)) AS similarity FROM xa JOIN xb USING (gram) GROUP BY term, candidate, n, m),
xr AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY similarity DESC, candidate) AS rank FROM xs WHERE similarity >= 0.45), q AS (SELECT query, term FROM u UNION SELECT query, candidate FROM k JOIN xr USING (term) WHERE rank <= 2)"""


FUSED = "fu AS (SELECT query, doc, sum(part) AS score FROM (SELECT query, doc, 1.0::DOUBLE / (12 + rank) AS part FROM bmr WHERE rank <= 24 UNION ALL SELECT query, doc, 1.1::DOUBLE / (12 + rank) FROM ch) GROUP BY ALL), fr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM fu)"


def _searched(spark, d, queries, key):
    docs = table(spark, d, "documents")
    index = R.indexed(docs, "doc_id", "text")
    terms = stored(H.expanded_terms(queries, "query", "text", index.select("term").distinct()), "expanded")
    concepts = H.concept_index(docs, "doc_id", F.array("lang"), 24)
    return H.searched(terms, wanted_concepts(spark, d, queries, key), index, docs.agg(F.count("*").alias("n")), concepts)


@query("concept_search", f"WITH {POSTINGS}, {expanded_sql('(SELECT item_id AS query, text FROM benchmark)')}, {BM25}, {CONCEPTS}, {concept_hits_sql('(SELECT item_id AS query, item_id AS i FROM benchmark)')}, {FUSED} SELECT query AS item_id, doc AS doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM fr WHERE rank <= 6")
def concept_search(spark, d):
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), "item_id", "text")
    found = R.top_ranked(_searched(spark, d, queries, "item_id"), 6)
    return found.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


PLAN = f"""se AS (SELECT item_id AS g, {duck.sentences('text')} AS s, text FROM benchmark), pa AS (SELECT g, 'misconception' AS kind, p AS nth, s[p] AS text FROM (SELECT g, s, unnest([1, 2]) AS p FROM se) WHERE p <= len(s)
UNION ALL SELECT g, 'prerequisite', 1, 'definition and invariant of ' || array_to_string(list_slice(string_split(lower(trim(text)), ' '), 1, 3), ', ') FROM se WHERE g % 3 = 0 UNION ALL SELECT g, 'problem', 1, left(text, 40) FROM se WHERE g % 2 = 0),
pl AS (SELECT g, kind, nth, text, CASE kind WHEN 'misconception' THEN 1.2::DOUBLE WHEN 'prerequisite' THEN 1.1::DOUBLE WHEN 'problem' THEN 0.6::DOUBLE END AS weight FROM pa WHERE trim(text) <> ''), pq AS (SELECT *, g || '/' || kind || '/' || nth AS query FROM (SELECT * FROM pl UNION ALL SELECT item_id, 'fallback', 1, 'algorithm', 1.0::DOUBLE FROM benchmark WHERE item_id NOT IN (SELECT g FROM pl)))"""


def _plan(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("group"), "text")
    beliefs = items.select("group", F.posexplode(T.sentences(F.col("text"))).alias("pos", "text")).withColumn("kind", F.lit("misconception"))
    names = F.array_join(F.slice(F.split(F.lower(F.trim("text")), " "), 1, 3), ", ")
    before = items.filter("group % 3 = 0").select("group", F.lit(0).alias("pos"), F.concat(F.lit("definition and invariant of "), names).alias("text"), F.lit("prerequisite").alias("kind"))
    titles = items.filter("group % 2 = 0").select("group", F.lit(0).alias("pos"), F.substring("text", 1, 40).alias("text"), F.lit("problem").alias("kind"))
    plan = H.planned(beliefs.unionByName(before).unionByName(titles), items, "algorithm")
    return plan.withColumn("query", F.concat_ws("/", "group", "kind", "nth"))


@query("search_plan", f"WITH {PLAN} SELECT g AS item_id, kind, CAST(nth AS INTEGER) AS nth, text, weight FROM pq")
def search_plan(spark, d):
    return _plan(spark, d).select(F.col("group").alias("item_id"), "kind", "nth", "text", "weight")


@query("planned_search", f"""WITH {POSTINGS}, {PLAN}, {expanded_sql('pq')}, {BM25}, {CONCEPTS}, {concept_hits_sql('(SELECT query, g AS i FROM pq)')}, {FUSED},
tw AS (SELECT g, doc, sum(weight / (12 + rank)) AS score FROM fr JOIN pq USING (query) WHERE rank <= 6 GROUP BY g, doc)
SELECT g AS item_id, doc AS doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(score, 9) DESC, doc) AS rank FROM tw) WHERE rank <= 6""")
def planned_search(spark, d):
    """Six documents of each item: the lists of its plan's sub-queries are fused, and then the sub-queries."""
    plan = stored(_plan(spark, d), "plan")
    found = H.retrieved(_searched(spark, d, plan, "group"), plan, 6)
    ranked = R.top_ranked(found.withColumnRenamed("group", "query"), 6)
    return ranked.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "rank")
