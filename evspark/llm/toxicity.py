"""Severity of toxic texts by cumulative-link ordinal regression on sparse text features.

Features are words and their first bytes, weighted by how often they occur in the whole text. All thresholds share the
weights: P(grade >= k) = sigmoid(w x - t_k) with t_1 <= t_2 <= ..., so the grades stay in order, and the expected
severity is the sum of these probabilities. Weights are fitted by gradient ascent with moments and weight decay.

The model learns from a sample of labelled documents bounded by `sample` for each of grade 0 and the grades above it, of
at most SAMPLE_CHARS characters each. A label without a document, or with nulls, isn't learnt from. Without two grades to
learn, every text has severity 0. Labels that contradict the text (toxic, but without any word that marks toxic texts)
are noise that the model doesn't follow, so documents it was fitted on can be judged against their label.

Null and empty texts have severity 0; texts of any length are read whole, in runs; repeated rows are scored each; texts
that tie have equal scores; an empty table gives no rows. Other columns travel as a struct, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evspark.llm.common import named, table, tidy
from evspark.llm.shingles import PUNCTUATION, blocks, runs_of_words, span_hashes

#: Labelled documents to learn from, of grade 0 and of the others each, about.
SAMPLE = 3000
#: Longest text that is learned from, in characters; longer ones are only scored, so that the sample's bytes are bounded.
SAMPLE_CHARS = 32_768
#: Features of a model.
FEATURES = 512
#: Buckets that features are counted in before the best are counted themselves.
BUCKETS = 1 << 20
#: Deviations by which a feature's share in toxic texts must differ.
LEAST_DEVIATIONS = 4.0
#: First bytes of a word that are features beside the word.
PREFIXES = (4, 5, 6)


def features_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, features, text of each feature, words by text) for runs of texts."""
    for first, data, cuts in blocks(column):
        found, texts, words = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], np.zeros(len(cuts) - 1, np.int64)
        for at, low, starts, ends in runs_of_words(data, cuts, PUNCTUATION):
            of = span_hashes(low)
            text = np.searchsorted(cuts, starts + at, "right") - 1
            found.append(of(starts, ends))
            texts.append(text)
            words += np.bincount(text, minlength=len(words))
            for n in PREFIXES:
                longer = ends - starts > n
                found.append(of(starts[longer], starts[longer] + n) ^ np.uint64(n))
                texts.append(text[longer])
        yield first, np.concatenate(found), np.concatenate(texts), words


class Severity:
    """A fitted model: features in order, a weight for each, thresholds, and the P(grade >= 1) from which a text is rejected."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, thresholds: np.ndarray, reject_at: float = 0.5):
        self.features, self.weights, self.thresholds, self.reject_at = features, weights, thresholds, reject_at
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[features & np.uint64(0xFFFF)] = True

    def known(self, found: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the model's features among those found, and their texts."""
        some = self.maybe[found & np.uint64(0xFFFF)]
        found, text = found[some], text[some]
        k = np.minimum(np.searchsorted(self.features, found), max(len(self.features) - 1, 0))
        hit = self.features[k] == found if len(self.features) else np.zeros(len(found), bool)
        return k[hit], text[hit]

    def values(self, found: np.ndarray, text: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, value) of the texts' features: the logarithm of 1 and how often they occur."""
        k, text = self.known(found, text)
        key, n = np.unique(text * max(1, len(self.features)) + k, return_counts=True)
        row, k = key // max(1, len(self.features)), key % max(1, len(self.features))
        return row, k, np.log1p(n)

    def at_least(self, found: np.ndarray, text: np.ndarray, words: np.ndarray) -> np.ndarray:
        """P(grade >= k) of each text, k from 1."""
        row, k, value = self.values(found, text, words)
        score = np.bincount(row, weights=value * self.weights[k], minlength=len(words))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))


def texts_with(texts: pa.Array, grades: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The distinct features of each text, and whether the text is above grade 0, for runs of texts."""
    for first, found, text, _ in features_of(texts):
        order = np.lexsort((found, text))
        found, text = found[order], text[order]
        new = np.append(True, (found[1:] != found[:-1]) | (text[1:] != text[:-1])) if len(found) else np.zeros(0, bool)
        yield found[new], grades[first + text[new]] > 0


def select(texts: pa.Array, grades: np.ndarray, most: int) -> np.ndarray:
    """The features whose share of texts above grade 0 differs most, in deviations, from that of texts of grade 0.

    Features are counted by hash bucket first; only those of the best buckets are then counted themselves.
    """
    n1, n0 = (grades > 0).sum(), (grades == 0).sum()

    def deviations(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        share = (a + b) / (n1 + n0)
        return np.abs(a / n1 - b / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))

    a, b = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for found, toxic in texts_with(texts, grades):
        bucket = (found >> np.uint64(40)) % np.uint64(BUCKETS)
        np.add.at(a, bucket[toxic], 1)
        np.add.at(b, bucket[~toxic], 1)
    wanted = np.zeros(BUCKETS, bool)
    z = deviations(a, b)
    wanted[np.argpartition(-z, min(4 * most, BUCKETS - 1))[: 4 * most]] = True
    every, bad = [], []
    for found, toxic in texts_with(texts, grades):
        own = wanted[(found >> np.uint64(40)) % np.uint64(BUCKETS)]
        every.append(found[own])
        bad.append(toxic[own])
    names, k = np.unique(np.concatenate(every), return_inverse=True)
    toxic = np.concatenate(bad)
    z = deviations(np.bincount(k[toxic], minlength=len(names)), np.bincount(k[~toxic], minlength=len(names)))
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(names[best[z[best] >= LEAST_DEVIATIONS]])


def fit(texts: list[str], grades: np.ndarray, clean_weight: float = 1.0, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> Severity:
    """Fits weights and thresholds by gradient ascent on the ordinal likelihood, each step scaled by running moments."""
    column = pa.array(texts, pa.string())
    if not len(grades) or grades.max() == 0 or grades.min() > 0:
        return Severity(np.zeros(0, np.uint64), np.zeros(0), np.full(1, 60.0))
    model = Severity(select(column, grades, FEATURES), np.zeros(0), np.zeros(0))
    row, feature, value = [], [], []
    for first, found, text, words in features_of(column):
        r, k, v = model.values(found, text, words)
        row.append(r + first)
        feature.append(k)
        value.append(v)
    row, feature, value = np.concatenate(row), np.concatenate(feature), np.concatenate(value)
    n, top = len(grades), int(grades.max())
    weights, thresholds = np.zeros(len(model.features)), np.arange(top) * 1.0
    mean, square = np.zeros(len(weights) + top), np.zeros(len(weights) + top)
    low = np.where(grades > 0, grades - 1, 0)
    for step in range(1, steps + 1):
        score = np.bincount(row, weights=value * weights[feature], minlength=n)
        p = 1 / (1 + np.exp(np.clip(thresholds[None, :] - score[:, None], -60, 60)))
        p = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], 1)
        i = np.arange(n)
        up, down = p[i, grades], p[i, grades + 1]  # P(>= grade), P(>= grade + 1)
        mass = np.maximum(up - down, 1e-9)
        slope_up, slope_down = up * (1 - up) / mass, down * (1 - down) / mass
        by_score = slope_up - slope_down
        by_threshold = np.zeros(top)
        above = grades > 0
        np.add.at(by_threshold, low[above], -slope_up[above])
        below = grades < top
        np.add.at(by_threshold, grades[below], slope_down[below])
        gradient = np.bincount(feature, weights=value * by_score[row], minlength=len(weights)) / n - decay * weights
        gradient = np.concatenate([gradient, by_threshold / n])
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient**2
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        weights, thresholds = weights + move[:-top], np.maximum.accumulate(thresholds + move[-top:])
    model = Severity(model.features, weights, thresholds)
    p = np.concatenate([model.at_least(found, text, words)[:, 0] for _, found, text, words in features_of(column)])
    return Severity(model.features, weights, thresholds, rejecting_from(p, grades > 0, clean_weight))


def rejecting_from(p: np.ndarray, toxic: np.ndarray, clean_weight: float) -> float:
    """The probability that divides the sample with the fewest errors; a clean text of the sample stands for clean_weight texts."""
    order = np.argsort(p, kind="stable")
    p, toxic = p[order], toxic[order]
    missed = np.append(0, np.cumsum(toxic))  # by rejecting from the i-th on
    wrong = clean_weight * (np.append(0, np.cumsum(~toxic[::-1]))[::-1])
    between = np.append(True, p[1:] > p[:-1])
    cost = np.where(np.append(between, True), missed + wrong, np.inf)
    best = np.flatnonzero(cost <= cost.min() + 1e-9)
    i = int(best[len(best) // 2])
    return float(np.clip(((p[i - 1] if i else 0.0) + (p[i] if i < len(p) else 1.0)) / 2, 0.01, 0.99))


def graded_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, grade: str, sample: int) -> tuple[list[str], np.ndarray, float]:
    """Texts, grades and the weight of a clean text of about `sample` labelled documents of grade 0 and as many above it, by
    a hash of their id. Of labels that repeat an id the highest grade counts, of documents that do the least text."""
    known = labels.filter(F.col(key).isNotNull() & F.col(grade).isNotNull()).groupBy(F.col(key).cast("long").alias("_id")).agg(F.max(F.col(grade).cast("int")).alias("_grade"))
    counts = known.agg(F.count(F.when(F.col("_grade") > 0, 1)).alias("bad"), F.count(F.when(F.col("_grade") <= 0, 1)).alias("good")).first()
    share = lambda n: min(1.0, sample / max(n, 1))
    picked = F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < F.when(F.col("_grade") > 0, share(counts.bad) * 1e6).otherwise(share(counts.good) * 1e6)
    wanted = known.filter(picked).limit(4 * sample)  # about 2 * sample; the limit bounds what is broadcast, whatever the hash
    short = docs.select(F.col(key).cast("long").alias("_id"), named(text).alias("_text")).filter(F.length("_text") <= SAMPLE_CHARS)
    rows = short.join(F.broadcast(wanted), "_id").groupBy("_id", "_grade").agg(F.min("_text").alias("_text")).collect()
    rows.sort(key=lambda r: r._id)
    grades = np.array([max(r._grade, 0) for r in rows], np.int64)
    return [r._text for r in rows], grades, max(1.0, share(counts.bad) / share(counts.good))


def graded_by_marks(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """Grades 0, 1 and 2 where labels tell toxic texts only: toxic texts are severe (2) if the words that mark toxic texts
    occur in them more often than in the median toxic text."""
    if not len(toxic) or toxic.max() == 0 or toxic.min() > 0:
        return toxic
    column = pa.array(texts, pa.string())
    marks = Severity(select(column, toxic, 64), np.zeros(0), np.zeros(0))
    often = np.zeros(len(texts))
    for first, found, text, words in features_of(column):
        _, hit = marks.known(found, text)
        often[first : first + len(words)] = np.bincount(hit, minlength=len(words))
    return toxic + (toxic & (often > np.median(often[toxic > 0])))


SCORES = "n_words long, p_toxic double, severity double, grade int, toxic boolean"


def scores(model: Severity, text: Column) -> Column:
    """n_words, p_toxic (of a grade above 0), severity (expected), grade and toxic (p_toxic >= model.reject_at) of a text,
    as a struct. Only the text goes to Python; rows wait in the JVM."""
    shared = SparkSession.active().sparkContext.broadcast(model)  # FEATURES features at most

    @F.arrow_udf(SCORES)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for batch in batches:
            words, p = np.zeros(len(batch), np.int64), np.zeros((len(batch), len(own.thresholds)))
            for first, found, of, n in features_of(batch):
                words[first : first + len(n)] = n
                p[first : first + len(n)] = own.at_least(found, of, n)
            p[words == 0] = 0
            made = [pa.array(words), pa.array(p[:, 0]), pa.array(p.sum(1)), pa.array((p >= 0.5).sum(1), pa.int32()), pa.array(p[:, 0] >= own.reject_at)]
            yield pa.StructArray.from_arrays(made, ["n_words", "p_toxic", "severity", "grade", "toxic"])
        tidy()

    return score(text)


def severity(docs: DataFrame, model: Severity, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` of each row of docs with its scores."""
    made = docs.select(F.struct(*map(named, keep)).alias("row"), scores(model, named(text)).alias("scores"))
    return made.select("row.*", "scores.*")


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Severity:
    """A model of docs' toxic labels."""
    texts, toxic, clean_weight = graded_sample(docs, labels, "doc_id", "text", "toxic", sample)
    model = fit(texts, graded_by_marks(texts, toxic), clean_weight)
    del texts, toxic
    tidy()  # the driver lives on
    return model


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return severity(docs, learned(docs, table(spark, sf_dir, "labels")), ["doc_id"])
