"""Claims of texts: their kinds and support, judgement of whole texts, texts without what isn't supported."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.functions.text import claim_kind, exploded_terms, kgram_hashes, let, prose_tokens, sentences
from evspark.operators.retrieval import bm25_idf


def claims(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, pos, claim, kind of every sentence; one row with nulls for a text without sentences. keys name one text each."""
    rows = texts.select(*keys, F.posexplode_outer(sentences(F.col(text))).alias("pos", "claim"))
    return rows.withColumn("kind", F.when(F.col("claim").isNotNull(), claim_kind(F.col("claim"))))


def supported(found: DataFrame, keys: list[str], evidence: DataFrame, group: str, text: str, least: float = 0.40) -> DataFrame:
    """claims with score and ok: of assertions, the share of their distinct tokens that texts of their group have (none
    without tokens), which should be `least`; other kinds score 1. Tokens meet by group and token, so no group is gathered.
    """
    known = evidence.select(F.col(group), F.explode(prose_tokens(F.col(text))).alias("token")).distinct().withColumn("_known", F.lit(1))
    asserted = found.filter("kind = 'assertion'").select(*keys, "pos", F.explode(F.array_distinct(prose_tokens(F.col("claim")))).alias("token"))
    shares = asserted.join(known, [group, "token"], "left").groupBy(*keys, "pos").agg((F.count("_known") / F.count("*")).alias("_share"))
    score = F.when(F.col("kind") == "assertion", F.coalesce("_share", F.lit(0.0))).when(F.col("claim").isNotNull(), 1.0)
    return found.join(shares, [*keys, "pos"], "left").withColumn("score", score).withColumn("ok", F.col("score") >= least).drop("_share")


def mean_of_assertions() -> Column:
    """The mean of a text's assertions, summed in the order of its sentences, so that its last digit is always the same; 1
    without any."""
    own = F.array_sort(F.collect_list(F.when(F.col("kind") == "assertion", F.struct("pos", "score"))))
    return let(own, lambda rows: F.when(F.size(rows) > 0, F.aggregate(rows, F.lit(0.0), lambda total, row: total + row["score"]) / F.size(rows)).otherwise(1.0))


def verified(checked: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_claims, n_rejected, score, accepted of each text: the mean of its assertions, 1 without any."""
    rejected = F.count(F.when(~F.col("ok"), 1))
    return checked.groupBy(*keys).agg(F.count("claim").alias("n_claims"), rejected.alias("n_rejected"), mean_of_assertions().alias("score"), (rejected == 0).alias("accepted"))


def sanitised(checked: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text: the accepted sentences in order; empty where there are fewer than two sentences, or none or all are accepted."""
    kept = F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("pos", "claim"))))
    sums = checked.groupBy(*keys).agg(F.count("claim").alias("n"), kept.alias("kept"))
    mixed = (F.col("n") >= 2) & (F.size("kept") > 0) & (F.size("kept") < F.col("n"))
    return sums.select(*keys, F.when(mixed, F.array_join(F.transform("kept", lambda x: x["claim"]), " ")).otherwise("").alias("text"))


def cards_before(asking: DataFrame, told: DataFrame, group: str, place: str, span: int = 12) -> DataFrame:
    """group, place, told_place: the places of `told` among the `span` ones before each place of `asking` in its group, so
    at most `span` for each. They meet by blocks of `span` places, so that no group is gathered however long it is. Rows
    with a null in group or place take no part; repeated rows count once."""
    block = F.floor(F.col(place) / span)
    own = asking.select(group, place).dropna().distinct().withColumn("_block", F.explode(F.array(block - 1, block)))
    theirs = told.select(group, F.col(place).alias("told_place")).dropna().distinct().withColumn("_block", F.floor(F.col("told_place") / span))
    near = F.col("told_place").between(F.col(place) - span, F.col(place) - 1)
    return own.join(theirs, [group, "_block"]).filter(near).select(group, place, "told_place")


def weighed_support(found: DataFrame, keys: list[str], cards: DataFrame, index: DataFrame, n_docs: DataFrame, cosines: DataFrame | None = None, least: float = 0.40, lexical: float = 0.68) -> DataFrame:
    """claims with score and ok. An assertion's support by a card is the share of its distinct terms' weight that the card
    has; terms weigh their idf over all cards, and those that no card has the most. Where cosines (keys, pos, card, cosine)
    are given, `lexical` of that share and the rest of the cosine, 0 at least, add up. The best card's support counts, to 9
    decimals: 0 without cards or terms. Other kinds score 1, a text without sentences null.

    cards (keys, card): a bounded number for each text. index (card, term): distinct terms of every card. n_docs: a row
    with n. Nulls in keys or card meet nothing. Cards that share no term with a claim count where they have a cosine.
    """
    terms = exploded_terms(found.filter("kind = 'assertion'").select(*keys, "pos", "claim"), "claim").distinct()
    idf = bm25_idf(index.join(terms.select("term").distinct(), "term", "left_semi"), n_docs)
    most = F.log(1 + (F.col("n") + 0.5) / 0.5)
    weighed = terms.join(idf, "term", "left").join(F.broadcast(n_docs.select("n")), how="cross").select(*keys, "pos", "term", F.coalesce("idf", most).alias("w"))
    total = weighed.groupBy(*keys, "pos").agg(F.sum("w").alias("_total"))
    held = cards.join(index.select("card", "term"), "card")
    shared = weighed.join(held, [*keys, "term"]).groupBy(*keys, "pos", "card").agg(F.sum("w").alias("_shared"))
    if cosines is None:
        value = F.col("_shared") / F.col("_total")
    else:
        shared = shared.join(cosines.join(cards, [*keys, "card"], "left_semi"), [*keys, "pos", "card"], "full")
        value = lexical * F.coalesce("_shared", F.lit(0.0)) / F.col("_total") + (1 - lexical) * F.greatest(F.lit(0.0), F.coalesce("cosine", F.lit(0.0)))
    best = shared.join(total, [*keys, "pos"]).groupBy(*keys, "pos").agg(F.round(F.max(value), 9).alias("_best"))
    score = F.when(F.col("kind") == "assertion", F.coalesce("_best", F.lit(0.0))).when(F.col("claim").isNotNull(), 1.0)
    return found.join(best, [*keys, "pos"], "left").withColumn("score", score).withColumn("ok", F.col("score") >= least).drop("_best")


def sentence_leaks(found: DataFrame, keys: list[str], cards: DataFrame, told: DataFrame, answers: DataFrame, text: str, short: int = 7, fewest: int = 3) -> DataFrame:
    """keys, pos, leak of every claim of `fewest` tokens or more: the share of its distinct k-grams that `answers` have,
    times the share that the text's own cards don't have; k is three in claims of fewer than `short` tokens, else five.
    cards (keys, card): a bounded number for each text; told (card, text). K-grams meet by hash, no text by text."""

    def tokens(column: str):
        return prose_tokens(F.col(column), stemmed=False)

    def grams(rows: DataFrame, others: list[str]) -> DataFrame:
        sized = [rows.select(*others, F.explode(kgram_hashes(F.col("_t"), k)).alias("gram")) for k in (3, 5)]
        return reduce(DataFrame.unionByName, sized).distinct()

    spans = found.filter("claim IS NOT NULL").select(*keys, "pos", tokens("claim").alias("_t")).filter(F.size("_t") >= fewest)
    k = F.when(F.size("_t") < short, kgram_hashes(F.col("_t"), 3)).otherwise(kgram_hashes(F.col("_t"), 5))
    own = spans.select(*keys, "pos", F.explode(F.array_distinct(k)).alias("gram"))
    known = grams(answers.select(tokens(text).alias("_t")), []).withColumn("_answer", F.lit(1))
    heard = cards.join(grams(told.select("card", tokens("text").alias("_t")), ["card"]), "card").select(*keys, "gram").distinct().withColumn("_heard", F.lit(1))
    counts = own.join(known, "gram", "left").join(heard, [*keys, "gram"], "left").groupBy(*keys, "pos")
    return counts.agg(F.round(F.count("_answer") / F.count("*") * (1 - F.count("_heard") / F.count("*")), 9).alias("leak"))


def reviewed(checked: DataFrame, keys: list[str], leaks: DataFrame, most: float = 0.18) -> DataFrame:
    """keys, n_claims, n_unsupported, score (mean of the assertions, 1 without any), leak (the largest of a claim, 0 without
    any), accepted: nothing unsupported and no leak above `most`."""
    rows = checked.join(leaks, [*keys, "pos"], "left").groupBy(*keys)
    counts = rows.agg(F.count("claim").alias("n_claims"), F.count(F.when(~F.col("ok"), 1)).alias("n_unsupported"), mean_of_assertions().alias("score"), F.coalesce(F.max("leak"), F.lit(0.0)).alias("leak"))
    return counts.withColumn("accepted", (F.col("n_unsupported") == 0) & (F.col("leak") <= most))
