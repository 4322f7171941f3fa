"""Observations, picks, claims, alignments and power against plain loops and known constants."""

import functools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evspark.operators import claims as V
from evspark.operators import learners as L
from evspark.operators import sequences as Q
from evspark.functions import chances as C
from evspark.operators import statistics as S

letters = st.lists(st.sampled_from("abc"), max_size=7)
numbers = st.lists(st.integers(-9, 9), max_size=9)


@given(letters, letters)
@settings(max_examples=150, deadline=None)
def test_alignment_columns(a, b):
    @functools.cache
    def cost(i, j):
        if not i or not j:
            return i + j
        return min(cost(i - 1, j - 1) + (a[i - 1] != b[j - 1]), cost(i - 1, j) + 1, cost(i, j - 1) + 1)

    i, j, back = len(a), len(b), ""
    while i or j:
        if i and j and cost(i, j) == cost(i - 1, j - 1) + (a[i - 1] != b[j - 1]):
            back += "=" if a[i - 1] == b[j - 1] else "~"
            i, j = i - 1, j - 1
        elif i and cost(i, j) == cost(i - 1, j) + 1:
            back, i = back + "a", i - 1
        else:
            back, j = back + "b", j - 1
    assert Q.alignment_columns(a, b) == back[::-1]
    assert -Q.global_score(a, b, -1, -1, 0) == cost(len(a), len(b))


@given(numbers, numbers, st.integers(0, 4))
@settings(max_examples=150, deadline=None)
def test_warping(a, b, band):
    width = max(band, abs(len(a) - len(b)))

    @functools.cache
    def cost(i, j):
        if not i and not j:
            return 0.0
        if not i or not j or abs(i - j) > width:
            return float("inf")
        return abs(a[i - 1] - b[j - 1]) + min(cost(i - 1, j), cost(i, j - 1), cost(i - 1, j - 1))

    assert Q.warped(np.array(a, float), np.array(b, float), band) == pytest.approx(cost(len(a), len(b)))


def test_likeness_of_series():
    x = np.array([1.0, 2.0, 3.0])
    assert Q.alike(x, x) == pytest.approx(1) and Q.alike(x, np.array([])) == 0
    assert Q.alike(np.full(3, 5.0), np.full(4, 5.0)) == pytest.approx(1)
    assert Q.alike(np.full(3, 2.0), x) == pytest.approx(10 / 17 / (1 + 2 / 3 / 3))
    assert Q.alike(x, 100 * x) < Q.alike(x, x)


def test_power_and_tails(spark):
    assert S.power(0.5, 64) == pytest.approx(0.80, abs=0.005) and S.power(0.5, 1) == 0
    assert S.cases_needed(0.5) in (63, 64) and S.cases_needed(0.8) in (25, 26) and S.cases_needed(0.0) == 100_000
    assert S.power(S.detectable(64), 64) == pytest.approx(0.8, abs=1e-6)
    assert S.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5) and S.t_quantile(0.05, 5) == pytest.approx(-2.015048, abs=1e-5)
    df = spark.createDataFrame([(3.0, 2.0, 10.0)], "x double, a double, b double")
    f, t = df.select(C.f_tail(F.col("x"), F.col("a"), F.col("b")), C.t_tail(F.lit(2.0), F.lit(10.0))).first()
    assert f == pytest.approx(1.6**-5) and t == pytest.approx(0.036694, abs=1e-5)


def test_soft_observations(spark):
    rows = [(1, "a", 4.0, 0.5), (1, "b", 2.0, 0.5), (1, "c", 0.04, 0.5), (1, "d", None, 0.5), (2, "a", 0.0, 0.3)]
    df = spark.createDataFrame(rows, "u long, c string, mass double, prior double")
    got = {(r.u, r.c): r.mastery for r in L.blamed(df, "u", "mass", "prior").collect()}
    wrong = 0.5 * 0.1 / (0.5 * 0.1 + 0.5 * 0.8)
    assert got == pytest.approx({(1, "a"): wrong, (1, "b"): (0.5 + wrong) / 2, (1, "c"): 0.5, (1, "d"): 0.5, (2, "a"): 0.3})


def test_picks(spark):
    rows = [(1, 1, 1.0, ["x"]), (1, 2, 0.9, ["x"]), (1, 3, 0.5, ["y"]), (2, 4, 0.0, ["x"]), (3, 6, 1.0, None), (3, 5, 1.0, []), (4, 7, -1.0, ["x"])]
    df = spark.createDataFrame(rows, "u long, i long, w double, c array<string>")
    picks = L.diverse_items(df, "u", "i", "w", "c", 2, 0.65)
    assert sorted((r.u, r.place, r.i) for r in picks.collect()) == [(1, 1, 1), (1, 2, 3), (3, 1, 5), (3, 2, 6)]
    assert L.diverse_items(df.limit(0), "u", "i", "w", "c", 2, 0.65).count() == 0


def test_claims(spark):
    said = [(1, 0, "user", "Heaps order trees quickly."), (1, 1, "assistant", "Heaps order trees. Volcanoes erupt magma often."), (1, 2, "assistant", ""), (1, 3, "assistant", None), (2, 1, "assistant", "Heaps order trees."), (1, 4, "assistant", "Is that so?")]
    turns = spark.createDataFrame(said, "c long, t long, role string, text string")
    keys = ["c", "t"]
    checked = V.supported(V.claims(turns.filter("role = 'assistant'"), keys, "text"), keys, turns.filter("role = 'user'"), "c", "text")
    judged = {(r.c, r.t): (r.n_claims, r.n_rejected, r.score, r.accepted) for r in V.verified(checked, keys).collect()}
    assert judged == {(1, 1): (2, 1, 0.5, False), (1, 2): (0, 0, 1.0, True), (1, 3): (0, 0, 1.0, True), (2, 1): (1, 1, 0.0, False), (1, 4): (1, 0, 1.0, True)}
    clean = {(r.c, r.t): r.text for r in V.sanitised(checked, keys).collect()}
    assert clean == {(1, 1): "Heaps order trees.", (1, 2): "", (1, 3): "", (2, 1): "", (1, 4): ""}
