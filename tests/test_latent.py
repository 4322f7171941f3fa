"""Latent projection, nearest vectors and diverse picks against numpy on small inputs."""

from pathlib import Path

import numpy as np
import pytest

from evspark.operators import latent as S
from evspark.operators.retrieval import postings

TEXTS = ["heaps order trees", "trees hold heaps and leaves", "graphs hold edges", "edges join graphs and trees", "queues order jobs", "", None, "jobs wait in queues", "leaves fall", "graphs graphs edges queues"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_projection_equals_the_decomposition(spark, docs):
    model = S.latent(docs, "doc_id", "text", components=3, more=5)
    rows = postings(docs, "doc_id", "text").toPandas()
    table = rows.pivot(index="doc", columns="term", values="tf").fillna(0).sort_index()
    tf, df = table.to_numpy(float), (table.to_numpy() > 0).sum(0)
    w = np.where(tf > 0, (1 + np.log(np.maximum(tf, 1))) * (np.log((1 + len(TEXTS)) / (1 + df)) + 1), 0)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    u, s, v = np.linalg.svd(w, full_matrices=False)
    assert model.singular == pytest.approx(s[:3], rel=1e-3)
    got = model.docs.toPandas().sort_values("doc")
    assert list(got.doc) == list(table.index) and not {5, 6} & set(got.doc)
    x = got.drop(columns="doc").to_numpy(float)
    assert x @ x.T == pytest.approx((u[:, :3] * s[:3] ** 2) @ u[:, :3].T, abs=5e-3)
    folded = S.folded(model, docs, "doc_id", "text").toPandas().sort_values("doc").drop(columns="doc").to_numpy(float)
    assert folded == pytest.approx(x, abs=1e-6)


def test_projection_of_nothing(spark, docs):
    model = S.latent(docs.filter("doc_id IN (5, 6)"), "doc_id", "text")
    assert model.singular == [] and model.docs.count() == 0
    assert S.folded(model, docs, "doc_id", "text").count() == 0


def vectors(spark, n, seed):
    x = np.round(np.random.default_rng(seed).normal(size=(n, 3)), 1)
    x[-1] = 0
    return x, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "doc long, v0 double, v1 double, v2 double")


def unit(x):
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(size > 0, x / np.maximum(size, 1e-12), 0)


def test_nearest(spark):
    (a, queries), (b, docs) = vectors(spark, 7, 1), vectors(spark, 60, 2)
    score = np.round(np.clip(unit(a) @ unit(b).T, -1, 1), 9)
    got = {(r.query, r["rank"]): r.doc for r in S.nearest(queries, docs.repartition(4), 5).collect()}
    assert got == {(q, k + 1): d for q in range(7) for k, d in enumerate(sorted(range(60), key=lambda d: (-score[q, d], d))[:5])}


def test_diverse_picks(spark):
    x, docs = vectors(spark, 12, 3)
    x = unit(x)
    pool = [(q, d, float((d * 7 + q * 3) % 5)) for q in range(3) for d in range(q, 12)] + [(9, 1, 2.0), (9, 40, 2.0)]
    got = {(r.query, r.pick): r.doc for r in S.diversified(spark.createDataFrame(pool, "query long, doc long, score double"), docs, 4).collect()}
    for q in {p[0] for p in pool}:
        own = {d: s for p, d, s in pool if p == q}
        low, span = min(own.values()), max(own.values()) - min(own.values())
        vector = {d: x[d] if d < 12 else np.zeros(3) for d in own}
        chosen = []
        while len(chosen) < min(4, len(own)):
            value = {d: 0.72 * ((own[d] - low) / span if span else 1.0) - 0.28 * max([0.0, *(vector[d] @ vector[c] for c in chosen)]) for d in own if d not in chosen}
            chosen.append(min(value, key=lambda d: (-round(value[d], 9), d)))
        assert [got[q, i + 1] for i in range(len(chosen))] == chosen


def test_cosines(spark):
    (a, queries), (b, docs) = vectors(spark, 4, 4), vectors(spark, 5, 5)
    pairs = spark.createDataFrame([(q, d) for q in range(5) for d in range(6)], "query long, doc long")
    for r in S.cosines(pairs, queries, docs).collect():
        expected = float(unit(a)[r.query] @ unit(b)[r.doc]) if r.query < 4 and r.doc < 5 else 0.0
        assert r.cosine == pytest.approx(expected, abs=1e-9)


def test_few_columns_at_a_time_and_small_pieces_change_nothing(spark, docs, monkeypatch):
    from evspark.operators import blocks as B

    whole = S.latent(docs, "doc_id", "text", components=3, more=5)
    monkeypatch.setattr(S, "SENT", 0)
    monkeypatch.setattr(B, "PIECE", 2)
    monkeypatch.setattr(B, "CHARS", 10)
    index = postings(docs, "doc_id", "text")
    few = S.latent(docs, "doc_id", "text", components=3, more=5, index=index)
    assert few.singular == pytest.approx(whole.singular, abs=1e-9)
    a, b = (m.docs.toPandas().sort_values("doc").drop(columns="doc").to_numpy(float) for m in (whole, few))
    assert a @ a.T == pytest.approx(b @ b.T, abs=1e-9)
    a, b = (m.terms.toPandas().sort_values("term") for m in (whole, few))
    assert list(a.term) == list(b.term)
    a, b = (x.drop(columns="term").to_numpy(float) for x in (a, b))
    assert a @ a.T == pytest.approx(b @ b.T, abs=1e-9)


def test_tables_of_former_steps_go(spark):
    from evspark.sources.stored import shared_dir

    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{int(x)}q" for x in rng.zipf(1.3, 60) % 3000)) for i in range(400)]
    folder = Path(shared_dir(spark).removeprefix("file://"))
    was = set(folder.iterdir()) if folder.exists() else set()
    model = S.latent(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "doc_id", "text")
    new = [d.name.rsplit("-", 1)[0] for d in set(folder.iterdir()) - was]
    assert new.count("subspace") == 1 and "weights" not in new and len(model.singular) == 24
