"""Queries of deterministic sampling, interleaving, scores and roll-ups, each with the SQL that it is compared with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evspark.operators import evidence as E
from evspark.operators import learners as L
from evspark.operators import selection as C
from evspark.operators import statistics as S
from evspark.plans.model_queries import MASSES, _masses
from evspark.plans.statistics_queries import M, _ab
from evspark.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return register


UNIT = "CAST(('0x' || substring(md5('seed' || chr(31) || doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE"


@query("stable_units", f"SELECT doc_id, {UNIT} AS unit FROM documents")
def stable_units(spark, d):
    return table(spark, d, "documents").select("doc_id", C.stable_unit(F.lit("seed"), F.col("doc_id")).alias("unit"))


@query("exact_samples", f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {UNIT}, doc_id) AS r FROM documents) WHERE r <= 5")
def exact_samples(spark, d):
    return C.sampled(table(spark, d, "documents").select("source", "doc_id"), ["source"], "doc_id", 5, "seed")


@query("interleaved", """WITH t AS (SELECT * FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS turn FROM events) WHERE turn <= 20)
SELECT event_type, event_id, CAST(turn AS INTEGER) AS turn, CAST(row_number() OVER (ORDER BY turn, event_type) AS INTEGER) AS place FROM t""")
def interleaved(spark, d):
    order = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    ranked = table(spark, d, "events").select("event_type", "event_id", F.row_number().over(order).alias("turn")).filter("turn <= 20")
    return C.interleaved(ranked, "event_type", "turn")


@query("zscores", "SELECT o_orderkey, round(CASE WHEN s < 1e-9 THEN 0 ELSE (o_totalprice - m) / s END, 6) AS z FROM orders JOIN (SELECT o_orderpriority, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders GROUP BY 1) USING (o_orderpriority)")
def zscores(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return S.zscores(rows, ["o_orderpriority"], "o_totalprice").select("o_orderkey", F.round("z", 6).alias("z"))


@query("histograms", "WITH e AS (SELECT l_returnflag, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY 1) SELECT l_returnflag, CAST(CASE WHEN hi - lo <= 1e-12 THEN 0 ELSE least(11, floor((l_quantity - lo) / (hi - lo) * 12)) END AS INTEGER) AS bin, count(*) AS n FROM lineitem JOIN e USING (l_returnflag) GROUP BY ALL")
def histograms(spark, d):
    return S.histogram(table(spark, d, "lineitem").select("l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity")


@query("effect_bands", f"WITH {M}, s AS (SELECT l_returnflag, abs((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) * (1 - 3.0::DOUBLE / (4 * (na + nb - 2) - 1))) AS g FROM m WHERE na > 1 AND nb > 1) SELECT l_returnflag, CASE WHEN g < 0.2 THEN 'negligible' WHEN g < 0.5 THEN 'small' WHEN g < 0.8 THEN 'medium' ELSE 'large' END AS band FROM s")
def effect_bands(spark, d):
    return S.pooled_t(_ab(spark, d).filter("na > 1 AND nb > 1")).select("l_returnflag", S.magnitude(F.col("g"), S.D_BANDS).alias("band"))


@query("ds_ranked", f"""WITH {MASSES}, th AS (SELECT g, src, max(theta) AS theta FROM t GROUP BY ALL), hs AS (SELECT DISTINCT g, h FROM t), q AS (SELECT hs.g, hs.h, product(coalesce(mass, 0) + th.theta) AS q FROM hs JOIN th ON th.g = hs.g LEFT JOIN t ON t.g = hs.g AND t.h = hs.h AND t.src = th.src GROUP BY ALL),
w AS (SELECT g, product(theta) AS w FROM th GROUP BY g), z AS (SELECT q.g, sum(q - w) + any_value(w) AS z FROM q JOIN w ON q.g = w.g GROUP BY q.g), b AS (SELECT q.g, q.h, (q - w) / z AS belief, w / z AS theta FROM q JOIN w ON q.g = w.g JOIN z ON q.g = z.g)
SELECT g AS user_id, h, round(belief + theta, 6) AS plausibility, round(belief + theta / count(*) OVER (PARTITION BY g), 6) AS pignistic, CAST(row_number() OVER (PARTITION BY g ORDER BY round(belief, 9) DESC, h) AS INTEGER) AS rank FROM b""")
def ds_ranked(spark, d):
    ranked = E.ranked(E.dempster(_masses(spark, d), "user_id", "event_type", "h"), "user_id", "h")
    return ranked.select("user_id", "h", F.round("plausibility", 6).alias("plausibility"), F.round("pignistic", 6).alias("pignistic"), "rank")


@query("most_common_type", "SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE r = 1")
def most_common_type(spark, d):
    return C.most_common(table(spark, d, "events"), "user_id", "event_type")


@query("cold_start", "SELECT p_partkey, round(CASE WHEN p_size % 7 = 0 THEN greatest(0.001::DOUBLE, least(0.999::DOUBLE, p_size / 40.0::DOUBLE)) ELSE 0.15::DOUBLE + 0.8::DOUBLE / (1 + exp(-1.1::DOUBLE * (0.3::DOUBLE - (p_size - 25) / 10.0::DOUBLE))) END, 6) AS p FROM part")
def cold_start(spark, d):
    prior = F.when(F.col("p_size") % 7 == 0, F.col("p_size") / 40)
    return table(spark, d, "part").select("p_partkey", F.round(L.cold_start(F.lit(0.3), (F.col("p_size") - 25) / 10, prior), 6).alias("p"))


@query("item_utility", """WITH p AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS mass, 0.2::DOUBLE + 0.8::DOUBLE / (1 + exp(-1.2::DOUBLE * (0.5::DOUBLE - (p_size - 25) / 10.0::DOUBLE))) AS p FROM part), s AS (SELECT p_partkey, (CASE WHEN p < 0.45 THEN power(p / 0.45, 2) WHEN p > 0.85 THEN power((1 - p) / 0.15, 2) ELSE 1.0 END) * (0.35 + 1.2::DOUBLE * 1.2 * (1 - p) / p * power((p - 0.2) / 0.8, 2)) * (0.25 + mass) AS u FROM p)
SELECT p_partkey, round(u, 6) AS utility FROM s""")
def item_utility(spark, d):
    utility = L.item_utility(F.lit(0.5), (F.col("p_size") - 25) / 10, F.lit(1.2), 0.2, F.col("p_size") / 50)
    return table(spark, d, "part").select("p_partkey", F.round(utility, 6).alias("utility"))


@query("multilabel_totals", """WITH g AS (SELECT DISTINCT user_id, event_type AS label FROM events WHERE event_id % 2 = 0), p AS (SELECT DISTINCT user_id, event_type AS label FROM events WHERE event_id % 3 = 0),
j AS (SELECT coalesce(g.user_id, p.user_id) AS u, coalesce(g.label, p.label) AS l, g.label IS NOT NULL AS g, p.label IS NOT NULL AS p FROM g FULL JOIN p ON g.user_id = p.user_id AND g.label = p.label),
i AS (SELECT u, count(*) FILTER (g <> p) AS wrong FROM j GROUP BY u), c AS (SELECT l, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g) AS fp, count(*) FILTER (NOT p) AS fn FROM j GROUP BY l), a AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, count(*) AS labels, avg(CASE WHEN tp + fn > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END) AS macro FROM c)
SELECT (SELECT count(*) FROM i) AS n, round((SELECT avg(CASE WHEN wrong = 0 THEN 1.0::DOUBLE ELSE 0 END) FROM i), 6) AS exact, round(1 - (SELECT avg(wrong) FROM i) / labels, 6) AS hamming, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision, round(CAST(tp AS DOUBLE) / (tp + fn), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS micro_f1, round(macro, 6) AS macro_f1 FROM a""")
def multilabel_totals(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("label"))
    gold, predicted = (events.filter(F.col("event_id") % k == 0).select("user_id", "label").distinct() for k in (2, 3))
    out = S.multilabel_totals(gold, predicted, "user_id", "label")
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("exact", "hamming", "precision", "recall", "micro_f1", "macro_f1")))
