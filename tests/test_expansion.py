"""Expansion of unknown terms against plain loops over trigrams."""

import random

from evspark.operators import retrieval as R


def grams(term):
    padded = f"${term}$"
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


def similar(asked, vocabulary, least, best):
    out = []
    for term in asked:
        values = [(-len(grams(term) & grams(c)) / len(grams(term) | grams(c)), c) for c in vocabulary]
        out += [(term, c, -s) for s, c in sorted(v for v in values if -v[0] >= least)[:best]]
    return out


def test_most_similar_terms_without_comparing_pairs(spark, monkeypatch):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(500)} | {"aaaaaaaaaa"})
    asked, vocabulary = words[::3], [w for i, w in enumerate(words) if i % 3]
    assert list(R.most_similar(asked, vocabulary, 0.45, 2)) == similar(asked, vocabulary, 0.45, 2)
    assert list(R.most_similar(asked, [], 0.45, 2)) == [] and list(R.most_similar([], vocabulary, 0.45, 2)) == []
    monkeypatch.setattr(R, "KNOWN", 90)
    monkeypatch.setattr(R, "ASKED", 40)
    terms = spark.createDataFrame([(q, w) for w in asked for q in (1, 2)] + [(1, None)], "query int, term string")
    got = R.expanded(terms, spark.createDataFrame([(w,) for w in [*vocabulary, None]], "term string")).collect()
    want = similar([w for w in asked if len(w) >= 5], vocabulary, 0.45, 2)
    assert {(r.query, r.term, r.candidate, round(r.similarity, 12)) for r in got} == {(q, a, c, round(s, 12)) for a, c, s in want for q in (1, 2)} and len(got) == 2 * len(want)
    assert all(r["rank"] == 1 + [c for a, c, _ in want if a == r.term].index(r.candidate) for r in got)
