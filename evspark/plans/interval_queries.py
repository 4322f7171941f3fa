"""Queries of distribution functions and bootstrap intervals, each with its SQL."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from evspark.functions import chances as C
from evspark.operators import intervals as I
from evspark.operators import statistics as S
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


def rounded(df, n: int, *names):
    return df.withColumns({x: F.round(x, n) for x in names})


def phi_sql(x: str) -> str:
    """The normal distribution function by its alternating series, for numbers of moderate size."""
    return f"(0.5::DOUBLE + list_sum(list_transform(range(80), lambda k: power(-1, k) * power({x}, 2 * k + 1) / (gamma(k + 1) * power(2::DOUBLE, k) * (2 * k + 1)))) / sqrt(2 * pi()))"


#: The regularised incomplete beta function of rows bx (g, a0, b0, x0), as beta (g, p), by 300 steps of Lentz's method.
BETA = """bs AS (SELECT *, x0 < (a0 + 1) / (a0 + b0 + 2) AS direct FROM bx), bt AS (SELECT g, direct, CASE WHEN direct THEN a0 ELSE b0 END AS a, CASE WHEN direct THEN b0 ELSE a0 END AS b, CASE WHEN direct THEN x0 ELSE 1 - x0 END AS x FROM bs),
lz(g, k, a, b, x, c, d, h) AS (SELECT g, 0, a, b, x, 1.0::DOUBLE, 1 / (1 - (a + b) * x / (a + 1)), 1 / (1 - (a + b) * x / (a + 1)) FROM bt UNION ALL
 SELECT g, k, a, b, x, 1 + v / c1, 1 / (1 + v * d1), h1 * (1 + v / c1) / (1 + v * d1) FROM (SELECT g, k + 1 AS k, a, b, x, 1 + u / c AS c1, 1 / (1 + u * d) AS d1, h * (1 + u / c) / (1 + u * d) AS h1, -(a + k + 1) * (a + b + k + 1) * x / ((a + 2 * (k + 1)) * (a + 2 * (k + 1) + 1)) AS v
  FROM (SELECT *, (k + 1) * (b - (k + 1)) * x / ((a + 2 * (k + 1) - 1) * (a + 2 * (k + 1))) AS u FROM lz WHERE k < 300))),
beta AS (SELECT bt.g, CASE WHEN direct THEN f * h / bt.a ELSE 1 - f * h / bt.a END AS p FROM (SELECT *, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) AS f FROM bt) bt JOIN lz ON lz.g = bt.g AND lz.k = 300)"""
WELCH = f"{M}, w AS (SELECT l_returnflag AS g, na, nb, va, vb, (ma - mb) / sqrt(va / na + vb / nb) AS t, power(va / na + vb / nb, 2) / (power(va / na, 2) / (na - 1) + power(vb / nb, 2) / (nb - 1)) AS df FROM m WHERE na > 1 AND nb > 1)"


@query("p_values", f"""WITH RECURSIVE {WELCH}, bx AS (SELECT g, df / 2 AS a0, 0.5::DOUBLE AS b0, df / (df + t * t) AS x0 FROM w), {BETA}
SELECT w.g AS l_returnflag, round(t, 6) AS t, round(df, 4) AS df, round(p, 9) AS p_t, round(2 * {phi_sql('-abs(t)')}, 9) AS p_z, round(2 * {phi_sql('-abs(t)')}, 9) AS p_chi2 FROM w JOIN beta USING (g)""")
def p_values(spark, d):
    t, df = F.col("t"), F.col("df")
    found = S.welch(_ab(spark, d).filter("na > 1 AND nb > 1"))
    found = found.select("l_returnflag", "t", "df", C.t_two_sided(t, df).alias("p_t"), (2 * C.normal_tail(F.abs(t))).alias("p_z"), C.chi2_tail(t * t, F.lit(1.0)).alias("p_chi2"))
    return rounded(rounded(rounded(found, 9, "p_t", "p_z", "p_chi2"), 6, "t"), 4, "df")


@query("tail_chances", f"""WITH RECURSIVE {WELCH}, bx AS (SELECT {{'f': g, 'k': 't'}} AS g, df / 2 AS a0, 0.5::DOUBLE AS b0, df / (df + t * t) AS x0 FROM w UNION ALL SELECT {{'f': g, 'k': 'f'}}, (nb - 1) / 2.0::DOUBLE, (na - 1) / 2.0::DOUBLE, (nb - 1) / ((nb - 1) + (na - 1) * va / vb) FROM w WHERE vb > 0), {BETA}
SELECT w.g AS l_returnflag, round(CASE WHEN t >= 0 THEN b.p / 2 ELSE 1 - b.p / 2 END, 9) AS p_greater, round(CASE WHEN t >= 0 THEN 1 - b.p / 2 ELSE b.p / 2 END, 9) AS p_less, round(f.p, 9) AS p_f FROM w JOIN beta b ON b.g.f = w.g AND b.g.k = 't' JOIN beta f ON f.g.f = w.g AND f.g.k = 'f'""")
def tail_chances(spark, d):
    found = S.welch(_ab(spark, d).filter("na > 1 AND nb > 1 AND vb > 0"))
    p_f = C.f_tail(F.col("va") / F.col("vb"), (F.col("na") - 1).cast("double"), (F.col("nb") - 1).cast("double"))
    found = found.withColumn("p", C.t_tail(F.col("t"), F.col("df"))).select("l_returnflag", F.col("p").alias("p_greater"), (1 - F.col("p")).alias("p_less"), p_f.alias("p_f"))
    return rounded(found, 9, "p_greater", "p_less", "p_f")


@query("normal_table", f"SELECT p_partkey, round({phi_sql('z')}, 9) AS cdf, round(exp(-z * z / 2) / sqrt(2 * pi()), 9) AS density, round(z, 9) AS back FROM (SELECT p_partkey, (p_size - 25) / 8.0::DOUBLE AS z FROM part)")
def normal_table(spark, d):
    """The normal distribution of part sizes on a scale of their own, and the quantile that leads back."""
    rows = table(spark, d, "part").select("p_partkey", ((F.col("p_size") - 25) / 8).alias("z"))
    rows = rows.withColumn("cdf", C.normal_cdf(F.col("z"))).withColumn("density", C.normal_density(F.col("z")))
    return rounded(rows.select("p_partkey", "cdf", "density", C.normal_quantile(F.col("cdf")).alias("back")), 9, "cdf", "density", "back")


def _times_sql(key: str, r: str) -> str:
    steps = [int(-(-c * I.PRIME // 1)) for c in I.STEPS]
    return f"(SELECT {' + '.join(f'CAST(u >= {s} AS BIGINT)' for s in steps)} FROM (SELECT (z * z + {r} * 40692 + y) % {I.PRIME} AS u FROM (SELECT *, (y * y % {I.PRIME} + x) % {I.PRIME} AS z FROM (SELECT *, (x * 48271 + {r} * 69621 + 1) % {I.PRIME} AS y FROM (SELECT {key} % {I.PRIME} AS x)))))"


def _bca_sql(statistic: str, replicates: int) -> str:
    lo, hi = NormalDist().inv_cdf(0.025), NormalDist().inv_cdf(0.975)

    def of(na: str, sa: str, qa: str, nb: str, sb: str, qb: str) -> str:
        df = f"({na} + {nb} - 2)"
        pooled = f"((greatest(0.0::DOUBLE, {qa} - {sa} * {sa} / {na}) + greatest(0.0::DOUBLE, {qb} - {sb} * {sb} / {nb})) / {df})"
        difference = f"({sa} / {na} - {sb} / {nb})"
        value = difference if statistic == "difference" else f"CASE WHEN {pooled} <= 0 THEN 0 ELSE {difference} / sqrt({pooled}) * (1 - 3.0::DOUBLE / (4 * {df} - 1)) END"
        return f"CASE WHEN {na} >= 2 AND {nb} >= 2 THEN {value} END"

    whole = of("na", "sa", "qa", "nb", "sb", "qb")
    without = of("(na - a)", "(sa - a * x)", "(qa - a * x * x)", "(nb - (1 - a))", "(sb - (1 - a) * x)", "(qb - (1 - a) * x * x)")
    sums = ", ".join(f"CAST(sum(CASE WHEN {own} THEN w ELSE 0 END) AS DOUBLE) AS n{s}, sum(CASE WHEN {own} THEN w * x ELSE 0 END) AS s{s}, sum(CASE WHEN {own} THEN w * x * x ELSE 0 END) AS q{s}" for s, own in (("a", "a = 1"), ("b", "a = 0")))

    def place(z: float) -> str:
        return f"least(n - 1, greatest(0, CAST(floor(CASE WHEN abs(1 - bend * (z + {z}::DOUBLE)) < 1e-12 THEN 0.5 ELSE {phi_sql(f'(z + (z + {z}::DOUBLE) / (1 - bend * (z + {z}::DOUBLE)))')} END * n) AS BIGINT)))"

    return f"""WITH RECURSIVE l AS (SELECT l_returnflag AS g, l_orderkey * 8 + l_linenumber AS k, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_returnflag) AS x, CAST(l_linestatus = 'O' AS INTEGER) AS a, 1 AS w FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_linestatus IS NOT NULL),
o AS (SELECT *, {whole} AS v FROM (SELECT g, {sums} FROM l GROUP BY g)), wr AS (SELECT g, r, a, x, {_times_sql('k', 'r')} AS w FROM l, range(1, {replicates + 1}) t(r)),
e AS (SELECT g, v FROM (SELECT g, r, {whole} AS v FROM (SELECT g, r, {sums} FROM wr GROUP BY g, r)) WHERE v IS NOT NULL),
j AS (SELECT l.g, {without} - v AS d FROM l JOIN o USING (g) WHERE v IS NOT NULL), jm AS (SELECT g, avg(d) AS m FROM j WHERE d IS NOT NULL GROUP BY g),
bd AS (SELECT g, CASE WHEN count(*) >= 3 AND 6 * power(sum(power(m - d, 2)), 1.5) > 1e-12 THEN sum(power(m - d, 3)) / (6 * power(sum(power(m - d, 2)), 1.5)) ELSE 0 END AS bend FROM j JOIN jm USING (g) WHERE d IS NOT NULL GROUP BY g),
pr AS (SELECT e.g, count(*) AS n, greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, avg(CAST(e.v < o.v AS DOUBLE)))) AS p FROM e JOIN o USING (g) GROUP BY e.g),
hv(g, p, i, low, high) AS (SELECT g, p, 0, -5.0::DOUBLE, 5.0::DOUBLE FROM pr UNION ALL SELECT g, p, i + 1, CASE WHEN {phi_sql('((low + high) / 2)')} < p THEN (low + high) / 2 ELSE low END, CASE WHEN {phi_sql('((low + high) / 2)')} < p THEN high ELSE (low + high) / 2 END FROM hv WHERE i < 60),
z AS (SELECT pr.g, n, (low + high) / 2 AS z, coalesce(bend, 0) AS bend FROM pr JOIN hv ON hv.g = pr.g AND i = 60 LEFT JOIN bd ON bd.g = pr.g),
pl AS (SELECT g, n, {place(lo)} AS x, {place(hi)} AS y FROM z), sv AS (SELECT g, list_sort(list(v)) AS v FROM e GROUP BY g)
SELECT o.g AS l_returnflag, CAST(na AS BIGINT) AS na, CAST(nb AS BIGINT) AS nb, round(o.v, 6) AS value, round(CASE WHEN n >= {I.FEWEST} THEN sv.v[least(x, y) + 1] ELSE o.v END, 6) AS low, round(CASE WHEN n >= {I.FEWEST} THEN sv.v[greatest(x, y) + 1] ELSE o.v END, 6) AS high FROM o LEFT JOIN pl ON pl.g = o.g LEFT JOIN sv ON sv.g = o.g"""


def _bca(spark, d, statistic, replicates):
    rows = table(spark, d, "lineitem")
    found = I.bca(rows, "l_returnflag", F.col("l_orderkey") * 8 + F.col("l_linenumber"), F.col("l_extendedprice"), F.col("l_linestatus") == "O", statistic, replicates)
    return rounded(found, 6, "value", "low", "high")


@query("bootstrap_hedges_g", _bca_sql("g", 200))
def bootstrap_hedges_g(spark, d):
    return _bca(spark, d, I.hedges_g, 200)


@query("bootstrap_difference", _bca_sql("difference", 200))
def bootstrap_difference(spark, d):
    return _bca(spark, d, I.mean_difference, 200)
