"""Nulls and empty tables in operators that count."""

import math

from evspark.operators import learners as L
from evspark.operators import statistics as S


def test_answers_without_result_or_difficulty_dont_count(spark):
    rows = [("a", 0.5, True), ("a", 0.5, None), ("a", None, False), ("b", 0.5, True), ("c", 0.5, None), (None, 0.5, True)]
    got = {r[0]: tuple(round(x, 9) for x in tuple(r)[1:]) for r in L.abilities(spark.createDataFrame(rows, "user string, b double, right boolean"), "user", "b", "right").collect()}
    assert got["a"] == got["b"] and got["a"][0] > 0
    assert got["c"] == (0.0, 1.0, 0.0) and set(got) == {"a", "b", "c"}


def test_observations_without_answer_dont_count(spark):
    rows = [(1, 1, True), (1, 2, None), (1, 3, False), (2, 1, True), (2, 3, False), (3, 1, None), (2, None, True)]
    got = {r.user: (r.mastery, r.n) for r in L.traced(spark.createDataFrame(rows, "user int, at int, right boolean"), "user", "at", "right").collect()}
    assert set(got) == {1, 2} and got[1] == got[2] and got[1][1] == 2


def test_tests_without_p_take_no_part(spark):
    rows = [("x", 0.01), ("y", None), ("z", 0.04), ("w", 0.03)]
    tests = spark.createDataFrame(rows, "s string, p double")
    holm = {r.s: (r.rank, round(r.adjusted, 9)) for r in S.holm(tests, "p", "s").collect()}
    assert holm == {"x": (1, 0.03), "w": (2, 0.06), "z": (3, 0.06)}
    false_rate = {r.s: (r.rank, round(r.adjusted, 9)) for r in S.benjamini_hochberg(tests, "p", "s").collect()}
    assert false_rate == {"x": (1, 0.03), "w": (2, 0.04), "z": (3, 0.04)}


def test_chi_square_of_nothing_and_with_nulls(spark):
    rows = [("a", "x")] * 8 + [("a", "y")] * 2 + [("b", "x")] * 2 + [("b", "y")] * 8 + [(None, "x"), ("a", None)]
    table = spark.createDataFrame(rows, "r string, c string")
    found = S.chi_square(table, "r", "c").first()
    assert math.isclose(found.chi2, 4 * 9 / 5) and found.df == 1 and found.sparse == 0
    assert tuple(S.chi_square(table.filter("false"), "r", "c").first()) == (None, 0, 0)
