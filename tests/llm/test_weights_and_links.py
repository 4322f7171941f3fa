"""Importance resampling, token alignment and the Jaccard join against brute force, with odd rows and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from evspark.llm import alignment, jaccard_join, resampling

SCHEMA = "doc_id long, text string, n_words long, score long, `a.b` string, role int, hash long, pair long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def table_of(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, "x", 3, 4, 5) for i, t in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(2)
    base = [sentence(rng, n) for n in (3, 19, 20, 21, 60, 400)]
    texts = [*base, base[4], base[4].upper(), None, "", " \n", "one", "Ärger über Öl — ça déjà vu", "x" * 3000, "ab " * 900, "it's  12.5%\tof <|endoftext|> <s>▁", "\x1c　wide space 漢字", base[5] + " " + base[5]]
    rows = list(enumerate(texts))
    return [*rows, rows[4], rows[4], (None, base[4]), (None, None), (3, base[2])]


def words_of(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().translate(bytes(b if chr(b).isalnum() and b < 128 or b > 127 else 32 for b in range(256))).split(b" ")


def brute_resampled(docs, target, least=20, share=25, longest=2):
    def buckets(text):
        w = [x for x in words_of(text) if x]
        return len(w), [zlib.crc32(b" ".join(w[i : i + n])) % 10000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    own, theirs = [buckets(t) for _, t in docs], [buckets(t) for t in target]
    s, t = Counter(b for _, x in own for b in x), Counter(b for _, x in theirs for b in x)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in s}
    out = []
    for (i, _), (n, x) in zip(docs, own):
        w = sum(gain[b] for b in x) // len(x) if x else 0
        h = None if i is None else int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(x), w, None if i is None else w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    part = sorted((r for r in out if r[1] >= least and r[0] is not None), key=lambda r: (-r[4], r[0]))
    drawn = part[: share * len(part) // 100]
    ranks = [(*r, k + 1) for k, r in enumerate(drawn)]
    return ranks, [(*r, None) for r in out if not any(r is x for x in drawn)]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resampling(spark, odd, longest):
    target = ["alpha3 beta7 gamma1", None, odd[4][1]]
    docs, items = table_of(spark, odd), spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resampled(docs, items, keep=("score", "a.b"), longest=longest, share=50)
    assert got.columns == ["doc_id", "score", "a.b", "n_words", "n_features", "weight", "score", "rank"]
    rows = [(r[0], *r[3:]) for r in got.collect()]
    ranks, rest = brute_resampled(odd, target, share=50, longest=longest)
    assert sorted(rows, key=str) == sorted(ranks + rest, key=str)
    assert all(r[1] == 2 and r[2] == "x" for r in got.collect())


def test_resampling_of_empty_tables(spark, odd):
    docs, items = table_of(spark, odd), spark.createDataFrame([], "text string")
    assert resampling.resampled(docs.filter(F.lit(False)), items).count() == 0
    rows = [tuple(r) for r in resampling.resampled(docs, items).collect()]
    assert sorted(rows, key=str) == sorted(sum(brute_resampled(odd, []), []), key=str)


def test_runs_of_long_texts_count_as_one(monkeypatch):
    rng = random.Random(7)
    data = sentence(rng, 500).encode()
    whole = [resampling.bucket_counts(data, n) for n in (1, 2, 3)]
    for size in (1, 40, 333):
        monkeypatch.setattr(resampling, "RUN", size)
        for (n, counts), longest in zip(whole, (1, 2, 3)):
            m, others = resampling.bucket_counts(data, longest)
            assert m == n and (others == counts).all()


def test_bit_sliced_sums_are_exact():
    rng = np.random.default_rng(1)
    for top in (1, 3, 5000):
        counts, gains = rng.integers(0, top + 1, resampling.BUCKETS), rng.integers(-30000, 30000, resampling.BUCKETS)
        planes = resampling.planes(gains, int(abs(gains).max()).bit_length() + 1)
        assert resampling.sliced_sum(counts, planes) == int(counts @ gains)


A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_aligned(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one, other = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    spelt, found = alignment.Bytewise.of(A).spelt, []
    for i, text in rows:
        ia, ib = (one.encode(" " + text, add_special_tokens=False).ids, other.encode(text)) if text else ([], [])
        sa, sb = [spelt[x] for x in ia], [bytes([int(other.id_to_piece(x)[3:5], 16)]) if other.is_byte(x) else other.id_to_piece(x).replace("▁", " ").encode() for x in ib]
        if not text or not b"".join(sa) == (" " + text).encode() == b"".join(sb):
            found.append((i, 0, 0, [], [], ""))
            continue
        ea, eb = np.cumsum([*map(len, sa)]).tolist(), np.cumsum([*map(len, sb)]).tolist()
        links, groups, x, y = [], [[[], []]], 0, 0
        while x < len(ia):
            links.append((ia[x], ib[y]))
            ends_a, ends_b = ea[x] <= eb[y], eb[y] <= ea[x]
            if ends_a:
                groups[-1][0].append(str(ia[x]))
            if ends_b:
                groups[-1][1].append(str(ib[y]))
            x, y = x + ends_a, y + ends_b
            if ends_a and ends_b:
                groups.append([[], []])
        text_ = ";".join(",".join(a) + "|" + ",".join(b) for a, b in groups[:-1])
        found.append((i, len(ia), len(ib), groups[:-1], links, hashlib.sha256(text_.encode()).hexdigest()))
    n = Counter(link for f in found for link in set(f[4]))
    top = {}
    for (a, _), k in n.items():
        top[a] = max(top.get(a, 0), k)
    return [(i, na, nb, len(g), len(ls), sum(n[x] == top[x[0]] for x in ls), sum(n[x] for x in ls), h) for i, na, nb, g, ls, h in found]


@pytest.mark.parametrize("frequent", [1 << 18, 40, 0])
def test_alignment(spark, odd, frequent):
    got = alignment.token_alignment(table_of(spark, odd), A, B, keep=("pair", "a.b"), frequent=frequent)
    assert sorted((tuple(r)[:1] + tuple(r)[3:] for r in got.collect()), key=str) == sorted(brute_aligned(odd), key=str)
    assert got.columns[:3] == ["doc_id", "pair", "a.b"]
    assert alignment.token_alignment(table_of(spark, odd).filter(F.lit(False)), A, B).count() == 0


def test_runs_are_skipped_without_a_miss():
    rng = random.Random(9)
    for _ in range(300):
        ends = sorted(rng.sample(range(1, 200), rng.randrange(1, 100)))
        a, b = (sorted({x for x in ends if rng.random() < p} | {ends[-1]}) for p in (rng.choice([0.2, 0.9, 1.0]), 0.95))
        la, lb, ga, gb = alignment.aligned(np.array(a), np.array(b))
        cuts = sorted(set(a) | set(b))
        assert sorted(zip(la, lb)) == [(sum(x < c for x in a), sum(x < c for x in b)) for c in cuts]
        both = sorted(set(a) & set(b))
        assert list(zip(ga, gb)) == [(a.index(c) + 1, b.index(c) + 1) for c in both]


def test_both_libraries_agree_on_plain_texts():
    rng, one = random.Random(3), alignment.Bytewise.of(A)
    letters = "abc ABC \t\n\r'sétd.,;!?0123  ÀÿŁ¡²¼ªº«×÷x<|endoftext|>  "
    for _ in range(2000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 60)))
        assert alignment._PLAIN.fullmatch(text)
        assert one.ids(text) == one.library.encode(text, add_special_tokens=False).ids


def test_runs_end_at_the_first_end_that_differs():
    """Runs of every length around those of probes, then an irregular group, and groups' texts with ids of all lengths."""
    spelling = alignment.Spelling(70000)
    for k in [*range(34), 63, 64, 65, 1000]:
        same = np.arange(1, k + 1) * 257
        a, b = np.r_[same, same[-1:].max(initial=0) + [1, 3, 9, 10]], np.r_[same, same[-1:].max(initial=0) + [2, 9, 10]]
        la, lb, ga, gb = alignment.aligned(a, b)
        assert sorted(zip(la.tolist(), lb.tolist())) == [*((i, i) for i in range(k)), (k, k), (k + 1, k), (k + 1, k + 1), (k + 2, k + 1), (k + 3, k + 2)]
        assert ga.tolist() == [*range(1, k + 1), k + 3, k + 4] and gb.tolist() == [*range(1, k + 1), k + 2, k + 3]
        xa, xb = (np.array([(7 * 10 ** (i % 5) + i) % 70000 for i in range(len(x))]) for x in (a, b))
        groups = zip(np.split(xa, ga[:-1]), np.split(xb, gb[:-1]))
        assert spelling(xa, xb, ga, gb).decode() == ";".join("|".join(",".join(map(str, x)) for x in g) for g in groups)


def test_texts_that_lose_bytes_are_not_spelt():
    one = alignment.Bytewise.of(A)
    for text in ("two plain words", "漢字 and more"):
        ids = one.ids(text)
        for own, spelt in ((ids, True), (ids[:-1], False), (ids[1:], False)):
            assert one.spells(text, own, np.array(own), text.encode()) is spelt


def brute_joined(rows, width, percent):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
            if (same or rows[i][0] is not None and rows[i][0] == rows[j][0]) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in set(group)}
    return [(r[0], len(s), least[g]) for r, s, g in zip(rows, sets, group)]


def families(seed):
    """Texts of many sizes with copies from close to just too far, some of which link only over others."""
    rng, rows = random.Random(seed), []
    for n in (1, 2, 4, 5, 6, 9, 12, 20, 33, 64, 130, 300):
        base = sentence(rng, n).split()
        for _ in range(5):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, n // 20))):
                own[rng.randrange(len(own))] = rng.choice(WORDS)
            rows.append((len(rows) * 7 % 1000, " ".join(own[rng.randrange(0, 1 + n // 30) :])))
    chain = sentence(rng, 200).split()
    rows += [(2000 + k, " ".join(chain[3 * k : 3 * k + 80])) for k in range(30)]
    return rows


@pytest.mark.parametrize("width,percent,together,place_rows", [(5, 80, 2000, 1 << 20), (2, 80, 1, 500), (1, 60, 3, 2000)])
def test_jaccard_join(spark, odd, width, percent, together, place_rows):
    rows = [(i if i is None else i + 5000, t) for i, t in odd] + families(width)
    got = jaccard_join.jaccard_join(table_of(spark, rows), width, percent, together=together, place_rows=place_rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_joined(rows, width, percent), key=str)


def test_jaccard_join_in_small_blocks_of_far_ids(spark, odd, monkeypatch):
    """Mixed groups are dealt to several blocks, ids don't fit into four bytes."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    rows = [(i if i is None else (i - 300) << 45, t) for i, t in odd + families(3)]
    got = jaccard_join.jaccard_join(table_of(spark, rows), 2, 70)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_joined(rows, 2, 70), key=str)


def test_jaccard_join_of_nothing(spark, odd):
    assert jaccard_join.jaccard_join(table_of(spark, odd).filter(F.lit(False))).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_allocations_find_every_similar_pair(percent):
    rng, npr = random.Random(percent), np.random.default_rng(percent)
    cost = npr.integers(0, 50, jaccard_join.RARITY)
    for _ in range(400):
        n = rng.choice([1, 2, 3, 5, 8, 17, 40, 150])
        a = npr.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.unique(np.concatenate([a[rng.randrange(0, 1 + jaccard_join.apart(n, percent)) :], npr.integers(0, 1 << 63, rng.randrange(0, 1 + jaccard_join.apart(n, percent))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        if not common or 100 * common < percent * (n + len(b) - common):
            continue
        big, small = (a, b) if n >= len(b) else (b, a)
        band = len(big).bit_length() - 1
        assert band in jaccard_join.bands_of(len(small), percent)
        x, y = jaccard_join.Parts(big, band, percent), jaccard_join.Parts(small, band, percent)
        units = x.allocation(cost, jaccard_join.apart(len(big), percent) + 1)
        assert units.sum() == jaccard_join.apart(len(big), percent) + 1
        whole = any(units[x.full == y.full] > 0)
        two = np.flatnonzero(units == 2)
        cut = set(x.full[two]) & set(y.cut) or set(x.cut[np.isin(x.cut_of, two)]) & set(y.full)
        assert whole or cut


def test_folded_sketches_lose_no_pair_and_take_less_room(spark):
    rng = np.random.default_rng(4)
    sets = [rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (1, 90, 500, 512, 513, 900, 1024, 1025, 3000)]
    rows = [(k, len(x), jaccard_join.sketch(x).tolist()) for k, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "k int, n long, s array<long>").select("k", jaccard_join.folded("s", "n").alias("f"))
    got = df.orderBy("k").toArrow()
    assert [len(x) for x in got.column("f").to_pylist()] == [8, 8, 8, 8, 16, 16, 16, 32, 32]
    wide = jaccard_join.spread(got.column("f").combine_chunks())
    whole = np.array([s for _, _, s in rows], np.int64).view(np.uint64)
    for words in (8, 16, 32):
        some = [k for k, x in enumerate(sets) if jaccard_join.words_of(len(x)) >= words]
        assert (jaccard_join.refolded(wide[some], words) == jaccard_join.refolded(whole[some], words)).all()
    for x in sets:
        y = np.concatenate([x[len(x) // 20 :], rng.integers(0, 1 << 62, len(x) // 20).astype(np.uint64)])
        for words in (8, 16, 32):
            a, b = (jaccard_join.refolded(jaccard_join.sketch(z).view(np.uint64)[None], words) for z in (x, y))
            assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))
