"""Decontamination in one pass of Python workers, with the same answers in several blocks, where the text is kept too."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from evspark.llm import decontamination

ITEM = "one two three four five six seven eight nine ten eleven"
TEXTS = [f"Before {ITEM} after", "nothing of it", None, "", f"{ITEM.upper()}; short tail", "a short tail here", f"Before {ITEM} after"]


def passes(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")


@pytest.fixture
def tables(spark):
    docs = spark.createDataFrame([(k, t, f"src{k % 2}") for k, t in enumerate(TEXTS)] + [(6, TEXTS[6], "src0")], "doc_id long, text string, source string")
    return docs, spark.createDataFrame([("i", ITEM), ("j", "short tail"), (None, "nothing")], "item_id string, text string")


@pytest.mark.parametrize("keep", [["doc_id"], ["doc_id", "text"], ["text", "source", "doc_id"]])
def test_blocks_agree_and_one_block_is_one_pass(tables, monkeypatch, keep):
    docs, items = tables
    one = decontamination.contamination(docs, items, keep=keep)
    assert passes(one) == 1
    assert one.columns == [*keep, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    found = sorted(one.collect(), key=repr)
    assert {(r.n_words, r.n_hit, r.n_items) for r in found} == {(13, 11, 1), (3, 0, 0), (0, 0, 0), (13, 13, 2), (4, 2, 1)}
    if "text" in keep:
        assert sorted((r.text for r in found), key=repr) == sorted([*TEXTS, TEXTS[6]], key=repr)
    monkeypatch.setattr(decontamination, "INDEX_BLOCK", 1)
    assert sorted(decontamination.contamination(docs, items, keep=keep).collect(), key=repr) == found


def test_pipeline_stage_keeps_columns_and_sends_the_text_once(spark, tables, tmp_path):
    docs, items = tables
    docs = docs.select("source", "text", F.col("source").alias("n_words"), "doc_id")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    left = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert passes(left) == 1 and left.columns == docs.columns
    assert sorted(left.collect(), key=repr) == sorted((r for r in docs.collect() if r.doc_id in (1, 2, 3)), key=repr)
    sent = left._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[1]
    assert "text#" in sent and ", text, text#" not in sent
