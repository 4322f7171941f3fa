"""Queries of the statistics, each with the SQL that it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from evspark.operators import statistics as S
from evspark.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def _ab(spark, d):
    rows = table(spark, d, "lineitem").filter("l_linestatus IS NOT NULL")
    return S.moments(rows, F.col("l_extendedprice"), F.col("l_linestatus") == "O", ["l_returnflag"])


M = "m AS (SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS na, count(*) FILTER (l_linestatus <> 'O') AS nb, avg(l_extendedprice) FILTER (l_linestatus = 'O') AS ma, avg(l_extendedprice) FILTER (l_linestatus <> 'O') AS mb, coalesce(var_samp(l_extendedprice) FILTER (l_linestatus = 'O'), 0) AS va, coalesce(var_samp(l_extendedprice) FILTER (l_linestatus <> 'O'), 0) AS vb FROM lineitem GROUP BY 1)"


@query("welch", f"WITH {M} SELECT l_returnflag, na, nb, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t, round(power(va / na + vb / nb, 2) / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1)), 4) AS df FROM m")
def welch(spark, d):
    return S.welch(_ab(spark, d)).select("l_returnflag", "na", "nb", F.round("t", 6).alias("t"), F.round("df", 4).alias("df"))


@query("pooled_t_hedges", f"WITH {M}, s AS (SELECT *, sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS sd FROM m) SELECT l_returnflag, round((ma - mb) / sd / sqrt(1.0::DOUBLE / na + 1.0::DOUBLE / nb), 6) AS t, CAST(na + nb - 2 AS DOUBLE) AS df, round((ma - mb) / sd, 6) AS d, round((ma - mb) / sd * (1 - 3.0::DOUBLE / (4 * (na + nb - 2) - 1)), 6) AS g FROM s")
def pooled_t_hedges(spark, d):
    return rounded(S.pooled_t(_ab(spark, d)).select("l_returnflag", "t", "df", "d", "g"), "t", "d", "g")


@query("required_n", f"WITH {M} SELECT l_returnflag, CAST(ceil(2 * power((1.959963984540054::DOUBLE + 0.8416212335729143::DOUBLE) / (abs(ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))), 2) + power(1.959963984540054::DOUBLE, 2) / 4) AS BIGINT) AS n FROM m WHERE na > 1 AND nb > 1")
def required_n(spark, d):
    return S.pooled_t(_ab(spark, d).filter("na > 1 AND nb > 1")).select("l_returnflag", S.required_n(F.col("d")).alias("n"))


PAIRS = "(SELECT l_orderkey, l_extendedprice * l_discount AS x, l_extendedprice * l_tax AS y FROM lineitem)"


def _pairs(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_extendedprice") * F.col("l_discount")).alias("x"), (F.col("l_extendedprice") * F.col("l_tax")).alias("y"))


@query("paired_t", f"SELECT count(*) AS n, round(avg(x - y) / (stddev_samp(x - y) / sqrt(count(*))), 6) AS t, CAST(count(*) - 1 AS DOUBLE) AS df FROM {PAIRS}")
def paired_t(spark, d):
    return rounded(S.paired_t(_pairs(spark, d), F.col("x"), F.col("y")), "t")


@query("mann_whitney_cliff", """
WITH r AS (SELECT l_returnflag AS g, l_linestatus = 'O' AS a, l_quantity AS v FROM lineitem), k AS (SELECT g, v, count(*) AS k FROM r GROUP BY ALL),
m AS (SELECT g, v, k, sum(k) OVER (PARTITION BY g ORDER BY v) - k + (k + 1) / 2.0::DOUBLE AS mr FROM k), t AS (SELECT g, sum(power(k, 3) - k) AS ties FROM k GROUP BY g),
s AS (SELECT r.g, count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nb, coalesce(sum(mr) FILTER (a), 0) AS ra FROM r JOIN m ON r.g = m.g AND r.v = m.v GROUP BY r.g), u AS (SELECT s.*, ties, ra - na * (na + 1) / 2.0::DOUBLE AS ua, CAST(na AS DOUBLE) * nb AS nn, na + nb AS n FROM s JOIN t ON s.g = t.g)
SELECT g AS l_returnflag, na, nb, round(least(ua, nn - ua), 6) AS u, round(CASE WHEN nn / 12 * (n + 1 - ties / (n * (n - 1))) <= 0 THEN 0 ELSE (ua - nn / 2) / sqrt(nn / 12 * (n + 1 - ties / (n * (n - 1)))) END, 6) AS z, round(CASE WHEN nn = 0 THEN NULL ELSE 2 * ua / nn - 1 END, 6) AS delta FROM u WHERE nn > 0""")
def mann_whitney_cliff(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", (F.col("l_linestatus") == "O").alias("open"), "l_quantity")
    both = rows.groupBy("l_returnflag").agg(F.count(F.when(F.col("open"), 1)).alias("a"), F.count(F.when(~F.col("open"), 1)).alias("b")).filter("a > 0 AND b > 0").select("l_returnflag")
    return rounded(S.mann_whitney(rows.join(F.broadcast(both), "l_returnflag"), "l_quantity", "open", ["l_returnflag"]), "u", "z", "delta")


@query("wilcoxon", """
WITH d AS (SELECT l_quantity - 10 * l_linenumber AS d FROM lineitem), r AS (SELECT abs(d) AS v, d > 0 AS up FROM d WHERE d <> 0), k AS (SELECT v, count(*) AS k FROM r GROUP BY v), m AS (SELECT v, k, sum(k) OVER (ORDER BY v) - k + (k + 1) / 2.0::DOUBLE AS mr FROM k),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(mr) FILTER (up) AS plus FROM r JOIN m USING (v)), t AS (SELECT sum(power(k, 3) - k) AS ties FROM k)
SELECT CAST(n AS BIGINT) AS n, round(least(plus, n * (n + 1) / 2 - plus), 6) AS w, round((plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48), 6) AS z FROM s, t""")
def wilcoxon(spark, d):
    return rounded(S.wilcoxon(table(spark, d, "lineitem"), F.col("l_quantity") - 10 * F.col("l_linenumber")), "w", "z")


CHI = "c AS (SELECT o_orderpriority AS r, o_orderstatus AS c, count(*) AS n FROM orders GROUP BY ALL), e AS (SELECT r, c, CAST(nr AS DOUBLE) * nc / (SELECT sum(n) FROM c) AS e FROM (SELECT r, sum(n) AS nr FROM c GROUP BY r), (SELECT c, sum(n) AS nc FROM c GROUP BY c))"


@query("chi2_table", f"WITH {CHI} SELECT round(sum(power(coalesce(n, 0) - e, 2) / e), 6) AS chi2, (count(DISTINCT r) - 1) * (count(DISTINCT c) - 1) AS df, count(*) FILTER (e < 5) AS sparse FROM e LEFT JOIN c USING (r, c)")
def chi2_table(spark, d):
    return rounded(S.chi_square(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus"), "chi2")


RATED = "(SELECT l.doc_id, l.quality AS a, CASE WHEN n_chars > 200 AND toxic = 0 THEN 1 ELSE 0 END AS b, toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _rated(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("a"), F.when((F.col("n_chars") > 200) & (F.col("toxic") == 0), 1).otherwise(0).alias("b"), "toxic")


@query("kappa", f"WITH r AS {RATED}, s AS (SELECT count(*) AS n, CAST(count(*) FILTER (a = b) AS DOUBLE) / count(*) AS o, (CAST(sum(a) AS DOUBLE) * sum(b) + CAST(sum(1 - a) AS DOUBLE) * sum(1 - b)) / (count(*) * count(*)) AS e FROM r) SELECT n, round(o, 6) AS observed, round(e, 6) AS expected, round((o - e) / (1 - e), 6) AS kappa FROM s")
def kappa(spark, d):
    return rounded(S.kappa(_rated(spark, d), "a", "b"), "observed", "expected", "kappa")


@query("kripp_alpha", f"""WITH r AS (SELECT doc_id, unnest([a, b, 1 - toxic]) AS l FROM {RATED}), c AS (SELECT doc_id, l, count(*) AS c FROM r GROUP BY ALL), n AS (SELECT l, sum(c) AS nc FROM c GROUP BY l), t AS (SELECT CAST(sum(nc) AS DOUBLE) AS n, CAST(sum(nc * (nc - 1)) AS DOUBLE) AS p FROM n), s AS (SELECT CAST(sum(c * (c - 1)) AS DOUBLE) / 2 AS s FROM c)
SELECT CAST(n AS BIGINT) AS n, round(1 - s / n, 6) AS observed, round(1 - p / (n * (n - 1)), 6) AS expected, round(1 - (1 - s / n) / (1 - p / (n * (n - 1))), 6) AS alpha FROM t, s""")
def kripp_alpha(spark, d):
    ratings = _rated(spark, d).select("doc_id", F.explode(F.array("a", "b", 1 - F.col("toxic"))).alias("label"))
    return rounded(S.krippendorff(ratings, "doc_id", "label"), "observed", "expected", "alpha")


@query("multilabel", f"""WITH r AS {RATED}, g AS (SELECT doc_id, 'good' AS label FROM r WHERE a = 1 UNION ALL SELECT doc_id, 'toxic' FROM r WHERE toxic = 1), p AS (SELECT doc_id, 'good' AS label FROM r WHERE b = 1 UNION ALL SELECT doc_id, 'toxic' FROM r WHERE b = 0),
j AS (SELECT coalesce(g.label, p.label) AS label, g.doc_id IS NOT NULL AS g, p.doc_id IS NOT NULL AS p FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.label = p.label), c AS (SELECT label, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g) AS fp, count(*) FILTER (NOT p) AS fn FROM j GROUP BY label UNION ALL SELECT '*', count(*) FILTER (g AND p), count(*) FILTER (NOT g), count(*) FILTER (NOT p) FROM j)
SELECT label, tp, fp, fn, round(2.0::DOUBLE * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def multilabel(spark, d):
    r = _rated(spark, d)
    gold = r.filter("a = 1").select("doc_id", F.lit("good").alias("label")).unionByName(r.filter("toxic = 1").select("doc_id", F.lit("toxic").alias("label")))
    predicted = r.select("doc_id", F.when(F.col("b") == 1, "good").otherwise("toxic").alias("label"))
    return rounded(S.multilabel(gold, predicted, "doc_id", "label"), "f1")


TESTS = "t AS (SELECT l_suppkey AS s, 1 / (1 + abs((avg(l_extendedprice) - 30000) / (stddev_samp(l_extendedprice) / sqrt(count(*))))) AS p FROM lineitem GROUP BY 1 HAVING count(*) > 2)"


def _tests(spark, d):
    per = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.avg("l_extendedprice").alias("m"), F.stddev_samp("l_extendedprice").alias("sd"), F.count("*").alias("n")).filter("n > 2")
    return per.select("s", (1 / (1 + F.abs((F.col("m") - 30000) / (F.col("sd") / F.sqrt("n"))))).alias("p"))


@query("holm", f"WITH {TESTS}, r AS (SELECT s, p, row_number() OVER (ORDER BY p, s) AS rank, count(*) OVER () AS n FROM t) SELECT s, round(p, 6) AS p, CAST(rank AS INTEGER) AS rank, round(least(1.0::DOUBLE, max((n - rank + 1) * p) OVER (ORDER BY rank)), 6) AS adjusted FROM r")
def holm(spark, d):
    return rounded(S.holm(_tests(spark, d), "p", "s"), "p", "adjusted")


@query("benjamini_hochberg", f"WITH {TESTS}, r AS (SELECT s, p, row_number() OVER (ORDER BY p, s) AS rank, count(*) OVER () AS n FROM t) SELECT s, round(p, 6) AS p, CAST(rank AS INTEGER) AS rank, round(least(1.0::DOUBLE, min(n * p / rank) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS adjusted FROM r")
def benjamini_hochberg(spark, d):
    return rounded(S.benjamini_hochberg(_tests(spark, d), "p", "s"), "p", "adjusted")


@query("lower_quantiles", "WITH l AS (SELECT l_returnflag, list_sort(list(l_quantity)) AS v FROM lineitem GROUP BY 1) SELECT l_returnflag, q, v[CAST(floor(q * (len(v) - 1)) AS BIGINT) + 1] AS value FROM l, (SELECT unnest([0.1::DOUBLE, 0.5, 0.9]) AS q)")
def lower_quantiles(spark, d):
    return S.lower_quantiles(table(spark, d, "lineitem"), "l_quantity", "l_returnflag", (0.1, 0.5, 0.9))
