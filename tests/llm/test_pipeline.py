"""The pipeline's stages against brute force, each on the stage before it, with odd rows and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with null, empty, toxic, near-equal, repeating and contaminated texts, and columns named like those that stages make."""
    out = tmp_path_factory.mktemp("tables")
    rng = random.Random(4)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()

    def text(n):
        return " ".join(rng.choice(words) + str(rng.randrange(90)) for _ in range(n))

    rows, labels = [], []
    for i in range(120):
        bad = i % 5 == 0
        rows.append((i, text(50) + (" nasty fool nasty fool" if bad else ""), "en", "s", 1, True, "x", 7))
        labels.append((i, 1, int(bad)))
    item, passage = text(14), text(30)
    rows.append((200, rows[1][1] + " end", "en", "s", 1, False, "x", 7))
    rows.append((201, f"{text(20)} {item} {text(20)}", "en", "s", 1, False, "x", 7))
    rows += [(202 + k, f"{text(20)} {passage} {text(20)}", "en", "s", 1, False, "x", 7) for k in range(2)]
    rows += [(300, None, None, None, None, None, None, None), (301, "", "en", None, 0, None, None, None), (None, text(30), None, None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, toxic boolean, kept_text string, n_words int").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    odd = {300, 301, None}
    assert set(kept["toxicity"]) == {i for i in range(120) if i % 5} | {200, 201, 202, 203} | odd
    assert set(kept["near_dedup"]) == set(kept["toxicity"]) - {200}
    assert set(kept["repeats"]) == set(kept["near_dedup"])
    assert len(kept["repeats"][203]) < len(kept["near_dedup"][203]) and kept["repeats"][202] == kept["near_dedup"][202]
    assert set(kept["decontamination"]) == set(kept["repeats"]) - {201}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in packed} == set(kept["decontamination"])


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() == 101
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").filter(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_loses_no_text(spark):
    """Null texts beside real ones under one doc_id, doc_ids with several texts, equal rows, rows without doc_id, maps."""
    rng = random.Random(8)
    a, b, c, d = (" ".join(f"w{rng.randrange(1000)}" for _ in range(30)) for _ in range(4))
    rows = [(1, a, "x"), (1, None, "x"), (2, b, "y"), (9, a, "z"), (9, b, "z"), (5, c, "m"), (5, c, "k"), (5, c, "k"), (None, c, "n"), (None, d, "p"), (None, d, "p"), (None, d, "o"), (None, None, "q"), (None, "", "q"), (3, " ", "r"), (3, " ", "r"), (-1, d + " end", "s"), (-4, a + " tail", "t")]
    docs = spark.createDataFrame([(i, t, {"k": x}, x) for i, t, x in rows], "doc_id long, text string, m map<string, string>, `a.b` string")
    for n in (1, 5):
        got = [(r.doc_id, r.text, r["a.b"]) for r in corpus_pipeline.near_dedup(spark, docs.repartition(n), "").collect()]
        assert all(r in rows for r in got)
        one_of = {(i, t): [x for j, u, x in rows if (j, u) == (i, t)] for i, t, _ in rows}
        found = sorted(((i, t) for i, t, _ in got), key=str)
        assert found == sorted([(-4, a + " tail"), (-1, d + " end"), (2, b), (5, c), (1, None), (None, None), (None, ""), (3, " "), (3, " ")], key=str)
        assert all(x in one_of[i, t] for i, t, x in got)
        first = got if n == 1 else first
        assert sorted(got, key=str) == sorted(first, key=str)
    assert corpus_pipeline.near_dedup(spark, docs.filter(F.lit(False)), "").count() == 0
