"""Kernels against plain Python and known constants."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evspark.functions import text as T
from evspark.operators import sequences as Q
from evspark.operators import statistics as S


def test_stems_and_parts(spark):
    words = ["memoization", "analyze", "queries", "lists", "loops", "passed", "bin", "cities", "creation", "notations"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select(T.stem(F.col("w")).alias("s"))
    assert [r.s for r in df.collect()] == ["memoise", "analyse", "query", "list", "loop", "pass", "bin", "city", "cre", "note"]
    row = spark.createDataFrame([("lowerBound_idx is 3.14 and X",)], "t string").select(T.prose_tokens(F.col("t"), stemmed=False).alias("t")).first()
    assert row.t == ["lower", "bound", "idx", "3.14"]


def test_empty_values(spark):
    df = spark.createDataFrame([("",), (None,)], "t string")
    assert [r.n for r in df.select(F.size(T.char_ngrams(F.col("t"), 3)).alias("n")).collect()] == [0, 0]
    assert [r.n for r in df.select(F.size(T.prose_tokens(F.col("t"))).alias("n")).collect()] == [0, 0]
    with pytest.raises(ValueError):
        T.ngrams(F.col("t"), 0)


@pytest.mark.parametrize(("a", "b", "x", "expected"), [(2, 3, 0.5, 0.6875), (0.5, 0.5, 0.5, 0.5), (5, 1, 0.9, 0.59049)])
def test_incomplete_beta(a, b, x, expected):
    assert S.incomplete_beta(a, b, x) == pytest.approx(expected, abs=1e-9)


def test_incomplete_gamma():
    assert S.incomplete_gamma(1, 2) == pytest.approx(1 - math.exp(-2), abs=1e-12)
    assert S.incomplete_gamma(0.5, 3.841458821 / 2) == pytest.approx(0.95, abs=1e-7)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 4).flatmap(lambda n: st.lists(st.lists(st.integers(0, 9), min_size=5, max_size=5), min_size=n, max_size=n)))
def test_assignment_is_least(rows):
    cost = np.array(rows, float)
    k = Q.assignment(cost)
    assert len(set(k.tolist())) == len(rows)
    best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(5), len(rows)))
    assert cost[np.arange(len(rows)), k].sum() == best


def test_warping_and_alignment():
    assert Q.warped(np.array([1.0, 2, 3]), np.array([1.0, 2, 2, 3]), 3) == 0
    assert Q.warped(np.array([]), np.array([1.0]), 3) == float("inf")
    assert Q.global_score(list("abc"), list("abc")) == 3
    assert Q.global_score(list("abc"), list("ac")) == 1
