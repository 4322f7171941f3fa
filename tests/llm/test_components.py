"""Connected components against a plain search, and the steps that they take."""

import random

import pytest

from evspark.llm import components as made


def brute(pairs):
    of = {}
    for a, b in pairs:
        x, y = of.setdefault(a, {a}), of.setdefault(b, {b})
        if x is not y:
            x |= y
            for n in y:
                of[n] = x
    return {n: min(x) for n, x in of.items() if n > min(x)}


def found_of(got):
    return None if got is None else {r.node: r.component for r in got.collect()}


@pytest.mark.parametrize("pairs", [[(i + 1, i) for i in range(30)], [(7, i) for i in range(20)], [(-3, 5), (5, 5), (5, -3), (9, 5)], [(random.Random(1).randrange(40), i) for i in range(40)]])
def test_components(spark, pairs):
    links = spark.createDataFrame(pairs, "a long, b long")
    assert found_of(made.components(links, "a", "b")) == brute(pairs)


def test_components_go_on_from_those_found(spark):
    rng = random.Random(5)
    one, more = ([(rng.randrange(60), rng.randrange(60)) for _ in range(25)] for _ in range(2))
    known = made.components(spark.createDataFrame(one, "a long, b long"), "a", "b")
    assert found_of(made.components(spark.createDataFrame(more, "a long, b long"), "a", "b", found=known)) == brute(one + more)
    assert made.components(spark.createDataFrame([(3, 3)], "a long, b long"), "a", "b") is None


def test_stars_take_one_step(spark, monkeypatch):
    """Each step starts some ten exchanges, and with each a thread of the driver that stays for a minute."""
    steps = []
    monkeypatch.setattr(made, "written", lambda df, what, write=made.written: steps.append(what) or write(df, what))
    links = spark.createDataFrame([(i, 2) for i in range(3, 30)] + [(40, 31), (41, 31)], "a long, b long")
    assert len(found_of(made.components(links, "a", "b"))) == 29 and len(steps) == 1
