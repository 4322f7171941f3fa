"""Budgets and turns that run over ranges, against plain loops."""

import random

from pyspark.sql import functions as F

from evspark.operators import retrieval as R
from evspark.operators import selection as C


def test_within_budget(spark):
    rng = random.Random(5)
    rows = [("hot", k, rng.randrange(0, 9)) for k in range(400)] + [(g, k // 2, 3) for g in ("a", None) for k in range(20)] + [("b", None, 2), ("b", 1, None), ("b", 2, 99), ("b", 3, 0)]
    rng.shuffle(rows)
    got = R.within_budget(spark.createDataFrame(rows, "g string, r int, size int").repartition(6), "g", "r", F.col("size"), 50).collect()
    place = {x: -1 if x[1] is None else x[1] for x in rows}
    want = []
    for x in rows:
        used = sum(y[2] or 0 for y in rows if y[0] == x[0] and place[y] <= place[x])
        want += [(*x, used)] if used <= 50 else []
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and len({x[0] for x in want}) == 4


def test_within_budget_of_nothing(spark):
    empty = spark.createDataFrame([], "g string, r int, size int")
    assert R.within_budget(empty, "g", "r", F.col("size"), 50).count() == 0


def test_interleaved(spark):
    rows = [(s, t) for s, n in (("a", 300), ("b", 7), ("c", 50), (None, 2)) for t in range(1, n + 1)]
    want = {x: k for k, x in enumerate(sorted(rows, key=lambda x: (x[1], x[0] or "")), 1)}
    got = C.interleaved(spark.createDataFrame(rows, "s string, t int").repartition(5), "s", "t").collect()
    assert {(r.s, r.t): r.place for r in got} == want
