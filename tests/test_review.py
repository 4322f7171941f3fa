"""Weighed support and leaks of answers, against plain loops."""

import math

from pyspark.sql import functions as F

from evspark.operators import claims as V
from evspark.operators.retrieval import postings

DOCS = {"a": "heap keeps smallest item root", "b": "stack pops newest item first", "c": "queue serves oldest item"}


def test_cards_before_stay_within_their_span(spark):
    rows = [(g, p) for g in (1, 2) for p in range(-5, 60)] + [(1, 7), (None, 3), (1, None)]
    table = spark.createDataFrame(rows, "g int, p int")
    got = V.cards_before(table, table.filter("p % 2 = 0"), "g", "p", 12).collect()
    want = {(g, p, q) for g in (1, 2) for p in range(-5, 60) for q in range(max(-5, p - 12), p) if q % 2 == 0}
    assert len(got) == len(want) and set(map(tuple, got)) == want


def checked(spark, cosines=None):
    found = spark.createDataFrame([(1, 0, "heap keeps zzyzx root", "assertion"), (1, 1, "stack item", "assertion"), (1, 2, "why?", "question"), (2, 0, "queue item", "assertion"), (3, None, None, None), (4, 0, "an of", "assertion")], "t int, pos int, claim string, kind string")
    cards = spark.createDataFrame([(1, "a"), (1, "b"), (3, "a"), (4, "a")], "t int, card string")
    index = postings(spark.createDataFrame(list(DOCS.items()), "card string, text string"), "card", "text").withColumnRenamed("doc", "card")
    return V.weighed_support(found, ["t"], cards, index, spark.createDataFrame([(3,)], "n long"), cosines)


def idf(df):
    return math.log(1 + (3 - df + 0.5) / (df + 0.5))


def test_weighed_support(spark):
    rows = {(r.t, r.pos): (r.score, r.ok) for r in checked(spark).collect()}
    unknown = math.log(1 + 3.5 / 0.5)
    assert abs(rows[1, 0][0] - 3 * idf(1) / (3 * idf(1) + unknown)) < 1e-6 and rows[1, 0][1]
    assert abs(rows[1, 1][0] - 1.0) < 1e-9
    assert rows[1, 2] == (1.0, True) and rows[3, None] == (None, None)
    assert rows[2, 0] == (0.0, False) and rows[4, 0] == (0.0, False)  # no card, no term


def test_weighed_support_with_cosines(spark):
    cosines = spark.createDataFrame([(1, 0, "a", -0.5), (1, 0, "b", 0.9), (1, 1, "b", 0.5), (2, 0, "c", 1.0)], "t int, pos int, card string, cosine double")
    rows = {(r.t, r.pos): r.score for r in checked(spark, cosines).collect()}
    share = 3 * idf(1) / (3 * idf(1) + math.log(1 + 3.5 / 0.5))
    assert abs(rows[1, 0] - max(0.68 * share, 0.32 * 0.9)) < 1e-6
    assert abs(rows[1, 1] - (0.68 + 0.32 * 0.5)) < 1e-6
    assert rows[2, 0] == 0.0  # c isn't among the text's cards


def test_leaks_and_review(spark):
    told = spark.createDataFrame([("x", "alpha beta gamma delta")], "card string, text string")
    answers = spark.createDataFrame([("red green blue pink grey black white",), ("alpha beta gamma",), (None,)], "text string")
    found = spark.createDataFrame([(1, 0, "red green blue pink grey black white"), (1, 1, "alpha beta gamma"), (1, 2, "red green"), (2, 0, "red green blue sofa"), (3, None, None)], "t int, pos int, claim string")
    found = found.withColumn("kind", F.when(F.col("claim").isNotNull(), F.lit("question")))
    leaks = V.sentence_leaks(found, ["t"], spark.createDataFrame([(1, "x")], "t int, card string"), told, answers, "text")
    assert {(r.t, r.pos): r.leak for r in leaks.collect()} == {(1, 0): 1.0, (1, 1): 0.0, (2, 0): 0.5}
    scored = found.withColumn("score", F.when(F.col("claim").isNotNull(), 1.0)).withColumn("ok", F.col("score") >= 0.4)
    got = {r.t: tuple(r)[1:] for r in V.reviewed(scored, ["t"], leaks).collect()}
    assert got == {1: (3, 0, 1.0, 1.0, False), 2: (1, 0, 1.0, 0.5, False), 3: (0, 0, 1.0, 0.0, True)}
