"""Distribution functions against math and plain loops, bootstrap weights and intervals on small samples."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from evspark.functions import chances as C
from evspark.operators import intervals as I
from evspark.operators import statistics as S


def test_normal(spark):
    rows = spark.createDataFrame([(x,) for x in (-7.0, -3.0, -1.96, -0.5, 0.0, 0.3, 2.9, 3.1, 5.0, 8.0, None)], "x double")
    x = F.col("x")
    for r in rows.select(x, C.normal_cdf(x).alias("c"), C.normal_tail(x).alias("t"), C.normal_density(x).alias("d")).collect():
        if r.x is None:
            assert r.c is r.t is r.d is None
            continue
        assert r.c == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), abs=1e-14)
        assert r.t == pytest.approx(0.5 * math.erfc(r.x / math.sqrt(2)), rel=1e-9)
        assert r.d == pytest.approx(NormalDist().pdf(r.x))
    rows = spark.createDataFrame([(p,) for p in (1e-9, 1e-4, 0.025, 0.3, 0.5, 0.8, 0.975, 0.999999)], "p double")
    for r in rows.select("p", C.normal_quantile(F.col("p")).alias("q")).collect():
        assert r.q == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-9)
    assert spark.range(1).select(C.normal_quantile(F.lit(0.0)), C.normal_quantile(F.lit(1.0))).first() == (None, None)


def test_t_chi_square_and_f(spark):
    rows = spark.createDataFrame([(t, n) for t in (-2.5, 0.0, 0.7, 3.0) for n in (1.0, 3.0, 30.0, 5e3, 1e5)], "t double, n double")
    t, n = F.col("t"), F.col("n")
    columns = [C.t_tail(t, n).alias("u"), C.chi2_cdf(F.abs(t) * 10, F.least(n, F.lit(300.0))).alias("c"), C.f_tail(F.abs(t), n, n + 1).alias("f"), C.log_gamma(n / 3).alias("g")]
    for r in rows.select("t", "n", *columns).collect():
        assert r.u == pytest.approx(S.t_upper(r.t, r.n), abs=1e-10)
        assert r.c == pytest.approx(S.incomplete_gamma(min(r.n, 300) / 2, abs(r.t) * 5), abs=1e-10)
        assert r.g == pytest.approx(math.lgamma(r.n / 3), rel=1e-9, abs=1e-9)
        assert r.f == pytest.approx(S.incomplete_beta((r.n + 1) / 2, r.n / 2, (r.n + 1) / (r.n + 1 + r.n * abs(r.t))) if r.t else 1.0, abs=1e-9)
    for r in rows.filter("t = 3").select("n", C.t_quantile(F.lit(0.975), n).alias("q")).collect():
        assert r.q == pytest.approx(S.t_quantile(0.975, r.n), rel=1e-9)


def test_bootstrap_weights_are_poisson(spark):
    w = I.with_times(spark.range(20000).withColumn("r", F.col("id") % 50), "id", "r")
    shares = {r._w: r["count"] / 20000 for r in w.groupBy("_w").count().collect()}
    for k in range(5):
        assert shares[k] == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.012)


def test_bootstrap_interval(spark):
    """Shifted samples, one too small, one constant, rows without value, no rows."""
    rows = [("far", k, 10.0 + k % 7, True) for k in range(60)] + [("far", 100 + k, 3.0 + k % 5, False) for k in range(50)]
    rows += [("small", 1, 2.0, True), ("small", 2, 3.0, False), ("small", 3, 5.0, False)] + [("same", k, 4.0, k % 2 == 0) for k in range(30)] + [("far", 500, None, True), ("far", 501, 9.0, None)]
    df = spark.createDataFrame(rows, "g string, k long, x double, a boolean")
    for n in (1, 4):
        got = {r.g: r for r in I.bca(df.repartition(n), "g", F.col("k"), F.col("x"), F.col("a"), I.mean_difference, 300).collect()}
        far = got["far"]
        assert (far.na, far.nb) == (60, 50) and far.low < far.value < far.high and 6 < far.low and far.high < 9
        assert got["small"].value is None and got["small"].low is None
        assert got["same"].value == got["same"].low == got["same"].high == 0
        before = far if n == 1 else before
        assert far == pytest.approx(before) if isinstance(far, float) else far.low == pytest.approx(before.low)
    g = {r.g: r for r in I.bca(df, "g", F.col("k"), F.col("x"), F.col("a")).collect()}
    a, b = [x for _, _, x, s in rows[:60] if s], [x for _, _, x, s in rows[60:110]]
    ma, mb = sum(a) / 60, sum(b) / 50
    pooled = (sum((x - ma) ** 2 for x in a) + sum((x - mb) ** 2 for x in b)) / 108
    assert g["far"].value == pytest.approx((ma - mb) / math.sqrt(pooled) * (1 - 3 / (4 * 108 - 1)))
    assert I.bca(df.filter("false"), "g", F.col("k"), F.col("x"), F.col("a")).count() == 0
