"""Kinds of claims beside accented letters, means in the order of sentences, and rounding as the SQL rounds."""

import duckdb
from pyspark.sql import functions as F

from evspark.functions.rounding import rounded
from evspark.functions.text import claim_kind
from evspark.operators import claims as V
from evspark.plans import registry


def test_accented_letters_end_a_word(spark):
    want = {"handé over it": "self-reference", "éhand it over": "self-reference", "Readé it all": "instruction", "handy it is": "assertion", "Réad it": "assertion", "Read it": "instruction", "re-read": "instruction"}
    rows = spark.createDataFrame([(s,) for s in want], "s string")
    assert {r.s: r.kind for r in rows.select("s", claim_kind(F.col("s")).alias("kind")).collect()} == want


def test_sanitised_text_with_an_accented_instruction(spark):
    said = spark.createDataFrame([(1, 2, "Runé xyzzy plugh. Heaps keep roots."), (1, 4, "Runny xyzzy plugh. Heaps keep roots.")], "conv int, turn int, text string")
    told = spark.createDataFrame([(1, "heaps keep roots")], "conv int, text string")
    checked = V.supported(V.claims(said, ["conv", "turn"], "text"), ["conv", "turn"], told, "conv", "text")
    assert {r.turn: r.text for r in V.sanitised(checked, ["conv", "turn"]).collect()} == {2: "", 4: "Heaps keep roots."}


def test_means_are_summed_in_order_and_rounded_as_the_sql_rounds(spark):
    rows = [(1, p, f"c{p}", "assertion", x, False) for p, x in ((2, 0.3), (1, 0.2), (0, 0.1))] + [(2, None, None, None, None, None)]
    checked = spark.createDataFrame(rows, "t int, pos int, claim string, kind string, score double, ok boolean").coalesce(1)
    assert {r.t: r.score for r in V.verified(checked, ["t"]).collect()} == {1: (0.1 + 0.2 + 0.3) / 3, 2: 1.0}
    assert (0.1 + 0.2 + 0.3) / 3 != (0.3 + 0.2 + 0.1) / 3
    values = spark.createDataFrame([(0.0653125,), (0.5003125,), (-0.5003125,), (None,)], "x double")
    assert [r[0] for r in values.select(rounded(F.col("x"), 6)).collect()] == [0.065312, 0.500313, -0.500313, None]


def test_verified_conversations_at_a_tie(spark, tmp_path):
    """Two claims with 23 of 25 and 1 of 8 tokens known and 14 without any: a mean of 0.0653125, which DuckDB rounds down."""
    words = [f"k{i}a" for i in range(200)]
    claims = ["Aa " + " ".join(words[:22] + ["zza", "zzo"]), "Bb " + " ".join(words[30:37])] + ["Cc " + " ".join(words[40:43])] * 14
    turns = [(1, 0, "user", " ".join(["aa", "bb", *words[:22]])), (1, 1, "assistant", ". ".join(claims))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    for name in ("verified_conversations", "verified_turns"):
        want = connection.execute(registry.ORACLE_SQL[name]).fetchall()
        assert [tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect()] == want and 0.065312 in want[0]


def test_reviewed_means_are_summed_in_order(spark):
    rows = [(1, p, f"c{p}", "assertion", x, False) for p, x in ((2, 0.3), (1, 0.2), (0, 0.1))]
    checked = spark.createDataFrame(rows, "t int, pos int, claim string, kind string, score double, ok boolean").coalesce(1)
    leaks = spark.createDataFrame([], "t int, pos int, leak double")
    assert [r.score for r in V.reviewed(checked, ["t"], leaks).collect()] == [(0.1 + 0.2 + 0.3) / 3]
