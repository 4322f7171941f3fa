"""Queries of text kernels, retrieval and fingerprints, each with the SQL that it is compared with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evspark.functions import duck
from evspark.functions import text as T
from evspark.operators import fingerprint as P
from evspark.operators import retrieval as R
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


D_TOK = f"(SELECT doc_id, {duck.tokens('text')} AS t FROM documents)"


@query("tokens_per_doc", f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_terms FROM {D_TOK}")
def tokens_per_doc(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.prose_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@query("stem_vocab_df", f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS term FROM {D_TOK}) GROUP BY term")
def stem_vocab_df(spark, d):
    return R.postings(table(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"))


@query("sentence_counts", f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(coalesce(list_sum(list_transform(s, lambda x: length(x))), 0) AS BIGINT) AS n_sentence_chars FROM (SELECT doc_id, {duck.sentences('text')} AS s FROM documents)")
def sentence_counts(spark, d):
    rows = table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.aggregate(F.transform("s", lambda x: F.length(x).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x).alias("n_sentence_chars"))


@query("claim_kinds", f"SELECT role, {duck.claim_kind('s')} AS kind, count(*) AS n FROM (SELECT role, unnest({duck.sentences('text')}) AS s FROM conversations) GROUP BY ALL")
def claim_kinds(spark, d):
    rows = table(spark, d, "conversations").select("role", F.explode(T.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("role", T.claim_kind(F.col("s")).alias("kind")).agg(F.count("*").alias("n"))


@query("turn_trigram_jaccard", f"""
WITH g AS (SELECT conv_id, turn, {duck.trigrams('text')} AS g FROM conversations), p AS (SELECT *, lag(g) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM g)
SELECT conv_id, turn, round(CASE WHEN len(list_distinct(list_concat(g, before))) = 0 THEN 0.0 ELSE CAST(len(list_intersect(g, before)) AS DOUBLE) / len(list_distinct(list_concat(g, before))) END, 6) AS jaccard FROM p WHERE before IS NOT NULL""")
def turn_trigram_jaccard(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", T.char_ngrams(F.col("text"), 3).alias("g"))
    rows = rows.withColumn("before", F.lag("g").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("before IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(T.jaccard(F.col("g"), F.col("before")), 6).alias("jaccard"))


@query("edit_distance_customers", "SELECT c_custkey, n_name, round(CAST(levenshtein(c_mktsegment, n_name) AS DOUBLE) / greatest(length(c_mktsegment), length(n_name)), 6) AS distance FROM customer JOIN nation ON c_nationkey = n_nationkey")
def edit_distance_customers(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", "n_name", F.round(T.edit_distance_ratio(F.col("c_mktsegment"), F.col("n_name")), 6).alias("distance"))


POSTINGS = f"post AS (SELECT doc_id AS doc, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM {D_TOK}) GROUP BY ALL), dl AS (SELECT doc_id AS doc, len(t) AS dl FROM {D_TOK}), tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl)"
QTERMS = f"q AS (SELECT DISTINCT item_id AS query, unnest({duck.tokens('text')}) AS term FROM benchmark)"
BM25 = """idf AS (SELECT term, count(*) AS df, ln(1 + ((SELECT n FROM tot) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY term),
bm AS (SELECT query, p.doc, sum(idf * tf * 2.35 / (tf + 1.35 * (1 - 0.72 + 0.72 * dl / (SELECT avgdl FROM tot)))) AS score FROM q JOIN post p USING (term) JOIN idf USING (term) JOIN dl ON dl.doc = p.doc GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM bm)"""


@query("bm25_idf", f"WITH {POSTINGS} SELECT term, count(*) AS df, round(ln(1 + ((SELECT n FROM tot) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM post GROUP BY term")
def bm25_idf(spark, d):
    docs = table(spark, d, "documents")
    return R.bm25_idf(R.postings(docs, "doc_id", "text"), docs.agg(F.count("*").alias("n"))).select("term", "df", F.round("idf", 6).alias("idf"))


def _bm25(spark, d, index=None):
    return R.bm25(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "text", "doc_id", "text", index=index)


@query("bm25_top10", f"WITH {POSTINGS}, {QTERMS}, {BM25} SELECT query AS item_id, CAST(rank AS INTEGER) AS rank, doc AS doc_id, round(score, 6) AS score FROM bmr WHERE rank <= 10")
def bm25_top10(spark, d):
    return R.top_ranked(_bm25(spark, d), 10).select(F.col("query").alias("item_id"), "rank", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


COSINE = f"""qtf AS (SELECT query, term, count(*) AS tf FROM (SELECT item_id AS query, unnest({duck.tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
ti AS (SELECT term, ln((1 + (SELECT n FROM tot)) / CAST(1 + count(*) AS DOUBLE)) + 1 AS idf FROM post GROUP BY term),
dv AS (SELECT doc, term, (1 + ln(tf)) * idf AS w FROM post JOIN ti USING (term)), qv AS (SELECT query, term, (1 + ln(tf)) * idf AS w FROM qtf JOIN ti USING (term)),
dn AS (SELECT doc, sqrt(sum(w * w)) AS n FROM dv GROUP BY doc), qn AS (SELECT query, sqrt(sum(w * w)) AS n FROM qv GROUP BY query),
co AS (SELECT qv.query, dv.doc, sum(qv.w * dv.w) / (any_value(qn.n) * any_value(dn.n)) AS score FROM qv JOIN dv USING (term) JOIN dn ON dn.doc = dv.doc JOIN qn ON qn.query = qv.query GROUP BY ALL),
cor AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM co)"""


def _cosine(spark, d, index=None):
    return R.tfidf_cosine(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "text", "doc_id", "text", index=index)


@query("tfidf_cosine_top5", f"WITH {POSTINGS}, {COSINE} SELECT query AS item_id, CAST(rank AS INTEGER) AS rank, doc AS doc_id, round(score, 6) AS score FROM cor WHERE rank <= 5")
def tfidf_cosine_top5(spark, d):
    return R.top_ranked(_cosine(spark, d), 5).select(F.col("query").alias("item_id"), "rank", F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@query("rrf_fused", f"""WITH {POSTINGS}, {QTERMS}, {BM25}, {COSINE}, f AS (SELECT query, doc, sum(part) AS score FROM (SELECT query, doc, 1.0::DOUBLE / (12 + rank) AS part FROM bmr WHERE rank <= 24 UNION ALL SELECT query, doc, 0.9::DOUBLE / (12 + rank) FROM cor WHERE rank <= 24) GROUP BY ALL)
SELECT query AS item_id, doc AS doc_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM f) WHERE rank <= 6""")
def rrf_fused(spark, d):
    index = R.indexed(table(spark, d, "documents"), "doc_id", "text")
    fused = R.reciprocal_rank_fusion([(R.top_ranked(_bm25(spark, d, index), 24), 1.0), (R.top_ranked(_cosine(spark, d, index), 24), 0.9)])
    return R.top_ranked(fused, 6).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query("evidence_budget", "SELECT * FROM (SELECT source, doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS used FROM documents) WHERE used <= 20000")
def evidence_budget(spark, d):
    return R.within_budget(table(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", F.col("n_chars"), 20_000).select("source", "doc_id", "used")


@query("exact_dups", "SELECT md5(text) AS fingerprint, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dups(spark, d):
    return P.exact_duplicates(table(spark, d, "documents"), "doc_id", "text")


B_PRINTS = f"(SELECT item_id AS id, g[p] AS hash, CAST(p - 1 AS INTEGER) AS pos, len(g) AS n FROM (SELECT item_id, {duck.grams('t', 5)} AS g, unnest(range(1, len(g) + 1)) AS p FROM (SELECT item_id, {duck.tokens('text', False)} AS t FROM benchmark)))"
D_PRINTS = f"(SELECT doc_id AS id, unnest({duck.grams('t', 5)}) AS hash FROM (SELECT doc_id, {duck.tokens('text', False)} AS t FROM documents))"


@query("kgram_fingerprint", f"SELECT id AS item_id, pos, hash FROM {B_PRINTS}")
def kgram_fingerprint(spark, d):
    return P.fingerprints(table(spark, d, "benchmark"), "item_id", "text").withColumnRenamed("id", "item_id")


@query("winnow_fingerprint", f"""WITH g AS {B_PRINTS}, w AS (SELECT id, n, pos, min({{'h': hash, 'b': -pos}}) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS m FROM g)
SELECT DISTINCT id AS item_id, CAST(-m.b AS INTEGER) AS pos, m.h AS hash FROM w WHERE n > 4 AND pos <= n - 4 UNION ALL SELECT id, pos, hash FROM g WHERE n <= 4""")
def winnow_fingerprint(spark, d):
    return P.winnowed(P.fingerprints(table(spark, d, "benchmark"), "item_id", "text")).withColumnRenamed("id", "item_id")


@query("contamination_containment", f"""WITH b AS (SELECT DISTINCT id, hash FROM {B_PRINTS}), c AS (SELECT DISTINCT id, hash FROM {D_PRINTS}), n AS (SELECT id, count(*) AS n FROM b GROUP BY id)
SELECT b.id AS item_id, c.id AS doc_id, round(CAST(count(*) AS DOUBLE) / any_value(n.n), 6) AS containment FROM b JOIN c USING (hash) JOIN n ON n.id = b.id GROUP BY ALL""")
def contamination_containment(spark, d):
    items, docs = (P.fingerprints(table(spark, d, t), k, "text") for t, k in (("benchmark", "item_id"), ("documents", "doc_id")))
    return P.contained(items, docs).select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), F.round("containment", 6).alias("containment"))


@query("novelty_gate", f"""WITH c AS (SELECT DISTINCT id, hash FROM {D_PRINTS}), r AS (SELECT DISTINCT hash FROM {B_PRINTS}), l AS (SELECT DISTINCT hash FROM {D_PRINTS} x JOIN labels ON x.id = doc_id WHERE quality = 0),
s AS (SELECT c.id, CAST(count(r.hash) AS DOUBLE) / count(*) AS ref, CAST(count(l.hash) AS DOUBLE) / count(*) AS own FROM c LEFT JOIN r USING (hash) LEFT JOIN l USING (hash) GROUP BY c.id)
SELECT id AS doc_id, round(ref, 6) AS ref, round(own, 6) AS self, round(ref * (1 - own), 6) AS score, ref * (1 - own) > 0.18 AS rejected FROM s""")
def novelty_gate(spark, d):
    def prints(rows, key):
        return P.fingerprints(rows, key, "text").select("id", F.unhex("hash").alias("hash"))  # 16 bytes rather than 32 digits

    docs = table(spark, d, "documents")
    own = docs.join(table(spark, d, "labels").filter("quality = 0").select("doc_id"), "doc_id", "left_semi")
    scored = P.novelty(prints(docs, "doc_id"), prints(table(spark, d, "benchmark"), "item_id"), prints(own, "doc_id"))
    return scored.select(F.col("id").alias("doc_id"), F.round("ref", 6).alias("ref"), F.round("self", 6).alias("self"), F.round("score", 6).alias("score"), (F.col("score") > 0.18).alias("rejected"))


def _turn_terms(spark, d):
    turns = table(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("query"), "text")
    return T.exploded_terms(turns, "text").distinct()


TURN_TERMS = f"u AS (SELECT DISTINCT conv_id || '/' || turn AS query, unnest({duck.tokens('text')}) AS term FROM conversations)"


@query("unknown_vocabulary", f"""WITH {POSTINGS}, {TURN_TERMS}, i AS (SELECT term, ln(1 + ((SELECT n FROM tot) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM post GROUP BY term), w AS (SELECT query, idf, coalesce(idf, ln(1 + ((SELECT n FROM tot) + 0.5) / 0.5)) AS w FROM u LEFT JOIN i USING (term))
SELECT query, round(sum(CASE WHEN idf IS NULL THEN w ELSE 0 END) / sum(w), 6) AS ratio FROM w GROUP BY query""")
def unknown_vocabulary(spark, d):
    docs = table(spark, d, "documents")
    return R.unknown_vocabulary(_turn_terms(spark, d), R.indexed(docs, "doc_id", "text"), docs.agg(F.count("*").alias("n"))).withColumn("ratio", F.round("ratio", 6))


PADDED = "list_distinct(list_transform(range(1, length(term) + 1), lambda i: substring('$' || term || '$', i, 3)))"


@query("fuzzy_expansion", f"""WITH {TURN_TERMS}, v AS (SELECT DISTINCT unnest({duck.tokens('text')}) AS term FROM documents), k AS (SELECT * FROM u WHERE length(term) >= 5 AND term NOT IN (SELECT term FROM v)),
a AS (SELECT term, len(g) AS n, unnest(g) AS gram FROM (SELECT DISTINCT term, {PADDED} AS g FROM k)), b AS (SELECT term AS candidate, len(g) AS m, unnest(g) AS gram FROM (SELECT term, {PADDED} AS g FROM v)),
s AS (SELECT term, candidate, CAST(count(*) AS DOUBLE) / (n + m - count(*)) AS similarity FROM a JOIN b USING (gram) GROUP BY term, candidate, n, m),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY similarity DESC, candidate) AS rank FROM s WHERE similarity >= 0.45)
SELECT query, term, candidate, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM k JOIN r USING (term) WHERE rank <= 2""")
def fuzzy_expansion(spark, d):
    vocabulary = stored(T.exploded_terms(table(spark, d, "documents").select("text"), "text").distinct(), "vocabulary")
    return R.expanded(_turn_terms(spark, d), vocabulary).withColumn("similarity", F.round("similarity", 6))


@query("truncated", "SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE rtrim(substring(text, 1, 39), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || '…' END AS short FROM documents")
def truncated(spark, d):
    return table(spark, d, "documents").select("doc_id", T.truncated(F.col("text"), 40).alias("short"))


@query("name_similarity", f"""WITH g AS (SELECT n_name, {duck.trigrams('n_name', 2)} AS g FROM nation) SELECT a.n_name AS a, b.n_name AS b, round(CAST(len(list_intersect(a.g, b.g)) AS DOUBLE) / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity FROM g a JOIN g b ON a.n_name < b.n_name WHERE len(list_intersect(a.g, b.g)) > 0""")
def name_similarity(spark, d):
    g = table(spark, d, "nation").select("n_name", T.char_ngrams(F.col("n_name"), 2).alias("g"))
    shared = g.select(F.col("n_name").alias("a"), F.size("g").alias("n"), F.explode("g").alias("gram")).join(g.select(F.col("n_name").alias("b"), F.size("g").alias("m"), F.explode("g").alias("gram")), "gram").filter("a < b")
    counted = shared.groupBy("a", "b", "n", "m").agg(F.count("*").alias("c"))
    return counted.select("a", "b", F.round(F.col("c") / (F.col("n") + F.col("m") - F.col("c")), 6).alias("similarity"))
