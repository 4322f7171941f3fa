"""Texts that can have no similar one aren't indexed, and no link is lost by that."""

import random

import pytest
from pyspark.sql import functions as F

from evspark.llm import jaccard_join

PERCENT = 80


def made(seed: int) -> list[tuple[int, str]]:
    """Texts that mostly share a common line, copies of some, and some just within and beyond the limit of others."""
    rng, rows = random.Random(seed), []
    line = [f"common{k}" for k in range(12)]
    for k in range(150):
        rows.append(line + [f"w{k}x{rng.randrange(10**6)}" for _ in range(rng.choice([0, 1, 3, 9, 60, 200]))])
    for k in range(0, 150, 5):
        rows.append(list(rows[k]))
        near = list(rows[k])
        for _ in range(rng.randrange(1, 4)):
            near[rng.randrange(len(near))] = f"other{rng.randrange(10**6)}"
        rows.append(near)
    return [(k * 3, " ".join(x)) for k, x in enumerate(rows)]


def shingles(text: str, width: int = 5) -> set:
    words = text.lower().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


@pytest.mark.parametrize("place_rows", [1 << 20, 400])
def test_texts_without_a_similar_one_are_left_out(spark, tmp_path, monkeypatch, place_rows):
    rows = made(place_rows)
    indexed = []
    plain = jaccard_join.index_rows

    def watched(docs, *args):
        indexed.extend(r.id for r in docs.select("id").collect())
        return plain(docs, *args)

    monkeypatch.setattr(jaccard_join, "index_rows", watched)
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 5, PERCENT, place_rows=place_rows).collect()
    sets = {i: shingles(t) for i, t in rows}
    component = {i: i for i in sets}
    linked = set()
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= PERCENT * len(sets[a] | sets[b]):
                lo, hi = sorted((component[a], component[b]))
                component = {i: lo if c == hi else c for i, c in component.items()}
                linked |= {a, b} if dict(rows)[a] != dict(rows)[b] else set()
    assert sorted(map(tuple, got)) == sorted((i, len(s), component[i]) for i, s in sets.items())
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert linked & set(first.values()) <= set(indexed)
    assert len(indexed) == len(set(indexed)) and len(indexed) < len(rows) * 2 // 3


def test_null_ids_and_copies_only(spark):
    """Copies of one text, whatever their ids, share their shingles with no other text."""
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(None, text), (4, text), (4, text), (9, text), (None, "alone " + text[:20]), (2, None), (3, "")]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("s", F.col("n_shingles"))
    assert sorted(((r.doc_id, r.s, r.component_id) for r in got.collect()), key=str) == sorted([(None, 46, 4), (4, 46, 4), (4, 46, 4), (9, 46, 4), (None, 4, None), (2, 0, 2), (3, 0, 3)], key=str)


def lone_and_near(n: int) -> list[tuple[int, str]]:
    """n texts alone, of long words that don't compress, and some near ones."""
    rng = random.Random(n)
    rows = [[f"{rng.getrandbits(480):x}" for _ in range(30)] for _ in range(n)]
    rows += [[*rows[k], "more"] for k in range(0, n, 40)]
    return [(k, " ".join(x)) for k, x in enumerate(rows)]


def shuffled(spark) -> int:
    """Bytes that tasks have written for exchanges so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    every = context.statusStore().executorList(False)
    return sum(every.apply(k).totalShuffleWrite() for k in range(every.size()))


def test_texts_left_out_are_not_shuffled(spark, tmp_path):
    rows = lone_and_near(1500)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the names of texts are many
    try:
        before = shuffled(spark)
        got = jaccard_join.jaccard_join(spark.read.parquet(f"{tmp_path}/documents"), 5, PERCENT).collect()
        assert shuffled(spark) - before < sum(len(t) for _, t in rows) // 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    component = {i: 40 * (i - 1500) if i >= 1500 else i for i, _ in rows}
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted(component.items())


@pytest.mark.parametrize("bits", [1, 64, 1 << 10])
def test_texts_that_share_a_bit_are_told_apart(spark, monkeypatch, bits):
    monkeypatch.setattr(jaccard_join, "LIVE_BITS", bits)
    docs = spark.createDataFrame([(k if k % 7 else None, f"text {k}") for k in range(400)], "id long, text string").selectExpr("id", "unhex(md5(text)) AS class", "text")
    docs = docs.unionByName(docs.selectExpr("id + 1 AS id", "class", "text"))
    live = docs.filter("id % 5 = 0").select("id", "class").repartition(3)
    want = sorted((r.id, r.text) for r in docs.filter("id % 5 = 0").collect())
    assert sorted(map(tuple, jaccard_join.named_texts(docs, live).collect())) == want
    assert jaccard_join.named_texts(docs, live.filter("id < 0")).collect() == []
