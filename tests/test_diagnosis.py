"""Fusion under total conflict, graph order and validation, learning paths, JSON repair and search plans on small inputs."""

import json
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from evspark.functions import repair as J
from evspark.operators import evidence as E
from evspark.operators import graphs as G
from evspark.operators import latent as S
from evspark.operators import search as H


def test_sources_in_total_conflict_are_passed_over(spark):
    rows = [("x", 1, "a", 1.0, 0.0), ("x", 2, "b", 1.0, 0.0), ("x", 3, "a", 0.5, 0.5), ("y", 1, "a", 0.6, 0.4), ("y", 2, "b", 0.5, 0.5)]
    masses = spark.createDataFrame(rows, "g string, s int, h string, mass double, theta double")
    got = {(r.g, r.h): (r.belief, r.theta) for r in E.dempster(masses, "g", "s", "h").collect()}
    assert got["x", "a"] == pytest.approx((1.0, 0.0)) and ("x", "b") not in got
    z = 1 - 0.6 * 0.5
    assert got["y", "a"] == pytest.approx((0.3 / z, 0.2 / z)) and got["y", "b"] == pytest.approx((0.2 / z, 0.2 / z))
    conflict = {r.g: r.conflict for r in E.in_order(masses, "g", "s", "h").collect()}
    assert conflict["x"] == 1.0 and conflict["y"] == pytest.approx(0.3)
    assert E.dempster(masses.filter("false"), "g", "s", "h").count() == 0


def test_diagnosis_refutes_and_ranks(spark):
    rows = [(1, "symbolic", "loop", 0.9), (1, "odd", "loop", 0.2), (1, "cost", "slow", 0.8), (2, "symbolic", "loop", 0.5), (2, "cost", "slow", 0.9), (2, "model", None, 0.9), (3, "model", "loop", 0.1)]
    found = spark.createDataFrame(rows, "g int, s string, h string, v double")
    groups = spark.createDataFrame([(1, True, False), (2, False, True)], "g int, passed boolean, failed boolean")
    got = {(r.g, r.h): r for r in E.diagnosed(found, "g", "s", "h", "v", groups, F.col("h") == "loop").collect()}
    m, r = 0.9 * 0.86, 0.55 * 0.92
    assert got[1, "loop"].belief == pytest.approx(m * (1 - r) / (1 - m * r)) and got[1, "loop"].conflict == pytest.approx(m * r)
    assert [got[2, h]["rank"] for h in ("loop", "slow")] == [1, 2] and (3, "loop") not in got


def test_topological_order_is_that_of_a_queue(spark):
    rng = np.random.default_rng(5)
    edges = sorted({(int(c), int(p)) for c in range(1, 60) for p in rng.integers(0, c, rng.integers(0, 4))})
    nodes = {n for e in edges for n in e}
    waits = {n: sum(c == n for c, _ in edges) for n in nodes}
    queue, order = deque(sorted(n for n in nodes if not waits[n])), []
    while queue:
        order.append(n := queue.popleft())
        for c in sorted(c for c, p in edges if p == n):
            waits[c] -= 1
            if not waits[c]:
                queue.append(c)
    got = {r.node: r.position for r in G.topological_order(spark.createDataFrame(edges, "child long, parent long")).collect()}
    assert [n for n, _ in sorted(got.items(), key=lambda x: x[1])] == order


def test_cycles_and_duplicates_are_named(spark):
    edges = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (2, 3), (4, 3), (5, 4), (6, 5), (5, 6), (7, 5), (8, 8), (9, 99)], "child long, parent long")
    nodes = spark.createDataFrame([(k,) for k in [*range(10), 4]], "node long")
    got = sorted(map(tuple, G.problems(nodes, edges).collect()))
    assert got == [("cycle", 2), ("cycle", 3), ("cycle", 4), ("cycle", 5), ("cycle", 6), ("cycle", 8), ("duplicate", 4), ("unknown", 9)]
    assert G.problems(nodes.distinct(), edges.filter("child IN (1, 2)").limit(0)).count() == 0


def test_learning_paths(spark):
    rows = [(1, 4, 0.9, [0, 1, 2, 4]), (1, 2, 0.8, [0, 1, 2]), (1, 5, 0.7, [0, 5]), (1, 0, 0.6, [0]), (1, 9, 0.5, [0, 1, 2, 4, 9]), (2, 7, 0.1, [7])]
    got = [(r.g, r.path, r.place) for r in G.learning_paths(spark.createDataFrame(rows, "g int, target int, mass double, path array<int>"), "g").orderBy("g", "place").collect()]
    assert got == [(1, [0, 1, 2, 4], 1), (1, [0, 5], 2)]
    hits = spark.createDataFrame([(1, 0.6, ["a", "b", None, "a"]), (1, 0.2, ["b"]), (1, 0.4, []), (1, 0.4, None)], "g int, v double, c array<string>")
    assert {r.node: round(r.mass, 9) for r in G.seeds_of(hits, "g", "v", F.col("c")).collect()} == {"a": 0.3, "b": 0.5}


CASES = [
    ('{"a": 1}', {"a": 1}), ('Sure: {"a": {"b": "}"}} and {"c": 2}', {"a": {"b": "}"}}), ('```json\n{"a": [1, 2,],}\n```', {"a": [1, 2]}), ("{'a': True, 'b': None}", {"a": True, "b": None}),
    ("{“a”: 1}", {"a": 1}), ('say "{" then {"a": "\\"}"} ok', {"a": '"}'}), ("[1, 2]", None), ("no braces", None), ('{"a": 1', None), ("", None), (None, None), ("} {\"a\": 1}", {"a": 1}), ('{"a": "' + "x" * 5000 + '",}', {"a": "x" * 5000}),
]


def test_json_is_found_repaired_and_parsed(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CASES)], "k int, t string")
    for r in df.select("k", F.to_json(J.parsed(F.col("t"))).alias("o")).collect():
        assert (None if r.o is None else json.loads(r.o)) == CASES[r.k][1], CASES[r.k]
    text = spark.createDataFrame([("<think> a </think> x <THINK>b\nc</THINK> y ",), (None,)], "t string")
    assert [tuple(r) for r in text.select(J.reasoning_of(F.col("t")), J.answer_of(F.col("t"))).collect()] == [("a\nb\nc", "x  y"), ("", "")]


def test_plans_and_concepts(spark):
    parts = spark.createDataFrame([(1, "misconception", k, f"t{k}") for k in range(4)] + [(1, "problem", 0, " "), (1, "odd", 0, "x"), (2, "problem", 0, None)], "group int, kind string, pos int, text string")
    groups = spark.createDataFrame([(1,), (2,), (2,)], "group int")
    got = sorted((r.group, r.kind, r.nth, r.text, r.weight) for r in H.planned(parts, groups, "algorithm").collect())
    assert got == [(1, "misconception", 1, "t0", 1.2), (1, "misconception", 2, "t1", 1.2), (2, "fallback", 1, "algorithm", 1.0)]
    cards = spark.createDataFrame([(5, ["b", "a"]), (3, ["a", "a", None]), (4, ["b"]), (1, None)], "id int, c array<string>")
    wanted = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (2, "z", 0)], "query int, concept string, pos int")
    hits = H.by_concepts(wanted, H.concept_index(cards, "id", F.col("c"), 24), 24).orderBy("rank").collect()
    assert [(r.query, r.doc) for r in hits] == [(1, 4), (1, 5), (1, 3)]


def test_picks_of_other_kinds_resemble_less(spark):
    pool = spark.createDataFrame([(1, d, s) for d, s in ((1, 1.0), (2, 0.9), (3, 0.85))], "query int, doc int, score double")
    vectors = spark.createDataFrame([(1, 1.0, 0.0), (2, 1.0, 0.05), (3, 1.0, 0.06)], "doc int, v0 double, v1 double")
    kinds = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc int, kind string")
    plain = [r.doc for r in S.diversified(pool, vectors, 2).orderBy("pick").collect()]
    told = [r.doc for r in S.diversified(pool, vectors, 2, relevance=0.5, kinds=kinds).orderBy("pick").collect()]
    assert plain == [1, 2] and told == [1, 3]
