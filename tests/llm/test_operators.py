"""The corpus operators against brute force on small tables with nulls, empties, repeated rows and clashing column names."""

import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from evspark.llm import decontamination, language, licenses, near_duplicates, packing, substrings, token_counts, toxicity, vectors, warc
from evspark.llm.components import components

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, `class` string, chunk int, node long"


def sentence(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()):
    return " ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(n))


def make_texts():
    rng = random.Random(1)
    base = [sentence(rng, 60) for _ in range(6)]
    texts = [*base, base[0], base[0], base[1] + " tail", base[2].replace(base[2].split()[7], "changed"), None, "", "  \n", "one", "two words", "Ärger über Öl — ça déjà vu", "x" * 400, "ab" * 300, "<|endoftext|> it's 12.5% \x1c done"]
    shared = sentence(rng, 25)
    texts += [sentence(rng, 10) + " " + shared + " " + sentence(rng, 10) for _ in range(4)]
    texts += [" ".join(sentence(rng, 50) for _ in range(120))]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    texts = make_texts()
    rows = [(i, t, "en", "s", 1, 2, "c", 3, 4) for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[4], None, None, None, None, None, None, None), (None, "nothing like it here at all", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df):
    return pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns, dtype=object)


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    want = sorted(((i, len((t or "").encode()), n, n > 2048) for i, t in texts_of(docs) for n in [len(library.encode(t or "", add_special_tokens=False).ids)]), key=str)
    got = sorted((tuple(r) for r in token_counts.token_counts(docs, TOKENIZER, ["doc_id"]).collect()), key=str)
    assert got == want
    assert token_counts.token_counts(none, TOKENIZER, ["doc_id"]).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    got = collected(packing.pack(docs, TOKENIZER, capacity=256))
    want = []
    for i, t in texts_of(docs):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(i, k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes())) for k in range(0, len(ids), 256)]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(str, got[columns].itertuples(index=False, name=None))) == sorted(map(str, want))
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s.offset) == [0, *np.cumsum(list(s.length))[:-1]] and s.length.sum() <= 256
    rooms = []  # first-fit decreasing
    for n in sorted(got.length, reverse=True):
        k = next((k for k, r in enumerate(rooms) if r >= n), None)
        if k is None:
            rooms.append(256 - n)
        else:
            rooms[k] -= n
    assert got.sequence_id.nunique() <= len(rooms)
    assert packing.pack(none, TOKENIZER).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_plan_holds_every_piece(seed):
    rng = random.Random(seed)
    histogram = {rng.randrange(1, 101): rng.randrange(1, 2000) for _ in range(40)}
    chosen = packing.plan(histogram, 100, rounds=60)
    held = {}
    for pattern, times in chosen:
        assert sum(k * n for k, n in pattern.items()) <= 100
        for k, n in pattern.items():
            held[k] = held.get(k, 0) + n * times
    assert held == histogram


def brute_components(docs, width, percent):
    texts = texts_of(docs)
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    name = [i for i, _ in texts]
    group = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        same = sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
        if (same or name[a] is not None and name[a] == name[b]) and group[a] != group[b]:
            group = [group[a] if g == group[b] else g for g in group]
    return name, sets, group


def test_near_duplicates(docs, none):
    got = collected(near_duplicates.near_duplicates(docs, width=2))
    name, sets, group = brute_components(docs, 2, 80)
    want = {}
    for i, s, g in zip(name, sets, group):
        ids = [n for n, h in zip(name, group) if h == g and n is not None]
        if i is not None:
            want[i] = (len(s), min(ids), min(ids) == i)
    for r in got[got.doc_id.notna()].itertuples():
        assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id]
    assert len(got) == len(name)
    assert not got[got.doc_id.isna()].kept.any()
    assert near_duplicates.near_duplicates(none).count() == 0


def test_many_loose_copies_stay_whole(spark):
    rng = random.Random(5)
    base = sentence(rng, 100).split()
    rows = [(i, " ".join(w if rng.random() > 0.06 else f"e{i}x{k}" for k, w in enumerate(base))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs, width=2).collect()}
    name, _, group = brute_components(docs, 2, 80)
    assert got == {i: min(n for n, h in zip(name, group) if h == g) for i, g in zip(name, group)}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links, "a", "b").collect()}
    assert {k: v for k, v in got.items() if k != v} == {**dict.fromkeys(range(1, 41), 0), 101: 100}
    assert components(links.filter("a < 0"), "a", "b") is None


def hold_against_all_strings(docs):
    rows = sorted(((r.doc_id if r.doc_id is not None else 1 << 62, (r.text or "").encode()) for r in docs.collect()))
    first = {}
    for i, b in rows:
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    want = []
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        want.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    got = sorted((r.doc_id if r.doc_id is not None else 1 << 62, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.without_repeats(docs).collect())
    assert got == sorted(want)


def test_substrings(docs, none):
    hold_against_all_strings(docs)
    assert substrings.without_repeats(none).count() == 0


def test_substrings_of_random_small_alphabets(spark):
    rng = random.Random(3)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randrange(20, 120))) for _ in range(12)]
    docs = spark.createDataFrame([(i, "".join(rng.choice(pool) for _ in range(rng.randrange(0, 5)))) for i in range(40)], "doc_id long, text string")
    hold_against_all_strings(docs)


def test_substrings_of_a_frequent_seed_are_spread(spark, monkeypatch):
    """A seed that every document holds, between surroundings that differ, must not send every document to one group."""
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    text = some(100_000)
    found = substrings.Parse(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]), 50)
    at = int(found.place[np.argmin(found.trigger >> np.uint64(32))])
    seed, phrase = text[at : at + 16], text[at - 12 : at + 28]
    docs = spark.createDataFrame([(i, some(60) + (seed if i % 2 else phrase) + some(60)) for i in range(3000)], "doc_id long, text string").repartition(3).cache()
    shares, plain = [], type(docs).groupBy

    def watched(df, *columns):
        if columns == ("part",):
            sizes = [r.n for r in plain(df, "part").agg(F.sum(F.octet_length("data")).alias("n")).collect()]
            shares.append(max(sizes) / sum(sizes) if sum(sizes) > 100_000 else 0)
        return plain(df, *columns)

    monkeypatch.setattr(type(docs), "groupBy", watched)
    got = substrings.without_repeats(docs)
    monkeypatch.undo()
    assert shares and max(shares) < 0.05
    assert got.agg(F.sum("n_removed")).first()[0] == 0


def brute_contamination(docs, items):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall((t or "").encode().lower())
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = []
    for i, t in docs:
        w = word.findall((t or "").encode().lower())
        hit, found = [0] * len(w), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    found |= windows[tuple(w[k : k + size])]
                    hit[k : k + size] = [1] * size
        out.append((i, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), sum(hit) > 0))
    return sorted(map(str, out))


@pytest.mark.parametrize("block", [200_000, 7])
def test_contamination(spark, docs, none, block, monkeypatch):
    monkeypatch.setattr(decontamination, "INDEX_BLOCK", block)
    texts = [t for _, t in texts_of(docs)]
    items = [(1, " ".join((max(t for t in texts if t and len(t) < 600)).split()[5:30])), (2, "two words"), (3, None), (4, ""), (5, "one"), (6, "one"), (7, "ÖL — Ça"), (None, "tail")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(str(tuple(r)) for r in decontamination.contamination(docs, bench).collect())
    assert got == brute_contamination(texts_of(docs), [x for x in items if x[0] is not None])
    assert not any(r.contaminated for r in decontamination.contamination(docs, bench.filter("item_id < 0")).collect())
    assert decontamination.contamination(none, bench).count() == 0


def test_contamination_by_share(spark):
    item = "a1 b2 c3 d4 e5 f6 g7 h8 i9 j0"
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, item.replace("a1", "zz")), (3, "g7 h8 i9 j0 a1 b2")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontamination.contamination(docs, bench, share=0.8).collect()}
    assert got == {1: True, 2: True, 3: False}


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/", "<p>same</p>"), (5, "http://b/\r\n", "<p>same</p>"), (5, "http://b/", "<p>same</p>"), (2, None, None), (3, "u", ""), (None, "n", "<p>same</p>"), (-7, "m", "é" * 5000), (1 << 62, "big", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/warc"
    got = warc.read_archives(warc.write_archives(pages, folder), folder).collect()
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -(1 << 63)), i if i is not None else -(1 << 63))
    want = [(i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if i == top[h or ""] else "revisit", None if i == top[h or ""] else top[h or ""]) for i, _, h in rows]
    assert sorted(map(str, want)) == sorted(str((r.record_key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {h or "" for _, _, h in rows}
    empty = pages.filter("page_id = 99")
    assert warc.read_archives(warc.write_archives(empty, folder), folder).count() == 0
    for key in (0, 1, -1, 1 << 62, -(1 << 63), (1 << 63) - 1, None):
        assert warc.key_of(warc.record_id(key)) == key


def test_warc_sample_of_rows_without_key_and_url_is_bounded(spark, tmp_path, monkeypatch):
    rows = [(None, None, f"<p>{i}</p>") for i in range(2000)] + [(7, "u", "<p>same</p>")] * 1000
    sizes, train = [], warc.train
    monkeypatch.setattr(warc, "train", lambda payloads: sizes.append(len(payloads)) or train(payloads))
    folder = f"file://{tmp_path}/warc"
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    assert 0 < sizes[0] <= warc.SAMPLES
    assert warc.read_archives(archives, folder).count() == 3000


def test_top_k(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.2, (300, 16)).astype(np.float32)
    x[10:40] = x[9]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [1.0, None] + [0.0] * 14), (402, [float("nan")] * 16), (450, [0.5, 0.5]), (451, [1.0, 1.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in vectors.top_k(df, F.col("vec_id") % 50 == 0).collect()]
    ints = {i: np.floor(256 * np.array(v, float)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)}
    want = []
    for q in ints:
        if q % 50 == 0:
            best = sorted((-int(ints[q] @ ints[c]), c) for c in ints if c != q and len(ints[c]) == len(ints[q]))[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted(got) == sorted(want)
    assert vectors.top_k(df.filter("vec_id = 7000"), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(20, 30)), rng.normal(size=(40, 30))
    for segments in (1, 4, 16):
        assert (vectors.segment_features(a, segments) @ vectors.segment_features(b, segments).T >= a @ b.T - 1e-9).all()


def test_gradient_of_the_network():
    network = language.Network(3, hidden=4)
    some, y = [b"abc", b"hello", b"x", b"zz"], np.array([0, 1, 2, 1])
    order = np.argsort([-len(s) for s in some], kind="stable")

    def loss():
        p, _, there = network.run(*language.padded([some[i] for i in order]))
        return -(np.log(p[:, np.arange(4), y[order]]) * there).sum() / there.sum()

    for w, g in zip(network.weights(), network.gradient(some, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = w[at]
        w[at] = old + 1e-2
        up = loss()
        w[at] = old - 1e-2
        down = loss()
        w[at] = old
        assert g[at] == pytest.approx((up - down) / 2e-2, rel=1e-2, abs=1e-4)


def test_labels_by_plain_loops():
    """Pooled probabilities against the network's equations, position by position."""
    network = language.Network(3, hidden=4)
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"abc de") for _ in range(n)) for n in (0, 1, 31, 256, 257, 300, 513, 1000)]

    def states(layer, own):
        h, out = np.zeros(4), []
        for b in own:
            a, g = layer.byte[b], h @ layer.gates
            z, r = (1 / (1 + np.exp(-(a[i : i + 4] + g[i : i + 4]))) for i in (0, 4))
            h = z * h + (1 - z) * np.tanh(a[8:] + (r * h) @ layer.state)
            out.append(h)
        return out

    for text, got in zip(texts, network.pooled(texts)):
        total = np.zeros(3)
        for own in range(0, len(text), language.OWN):
            first = max(0, own - language.CONTEXT)
            window = text[first : own + language.OWN + language.CONTEXT]
            both = zip(states(network.ahead, window), states(network.back, window[::-1])[::-1])
            for i, (ahead, back) in enumerate(both):
                if own <= first + i < own + language.OWN and window[i] != 32:
                    p = np.exp(np.concatenate([ahead, back]) @ network.out + network.bias)
                    total += p / p.sum()
        assert got == pytest.approx(total, rel=1e-4, abs=1e-6)


def test_language_of_odd_rows(spark, docs):
    model = language.train(["the cat sat on the mat"] * 4 + ["der hund und die katze"] * 4, ["en"] * 4 + ["de"] * 4, steps=60)
    odd = spark.createDataFrame([(1, "the cat sat", 7), (1, "the cat sat", 7), (None, "der hund " * 5000, 8)], "doc_id long, text string, `my score` long")
    got = sorted((r.doc_id or 0, r["my score"], r.lang_pred) for r in language.identify(odd, model, ["doc_id", "my score"]).collect())
    assert got == [(0, 8, "de"), (1, 7, "en"), (1, 7, "en")]
    assert language.identify(odd.limit(0), model, ["doc_id"]).count() == 0


def test_language(spark, data):
    got = collected(language.op5_language_id(spark, data)).merge(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out.astype(bool)]
    assert (held.lang_pred == held.lang).mean() > 0.95
    assert set(got.held_out) == {True, False} and got.score.astype(float).between(0, 1).all()


def test_language_without_letters(spark, docs):
    model = language.train(["the cat sat on the mat"] * 4 + ["der hund und die katze"] * 4, ["en"] * 4 + ["de"] * 4, steps=20)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !?"), (4, "日本語"), (5, "a" * 500)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, model, ["doc_id"]).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] in ("en", "de") and got[5][0] in ("en", "de")
    assert {r.lang_pred for r in language.identify(odd, language.train([], []), ["doc_id"]).collect()} == {"und"}


def test_toxicity():
    rng = random.Random(2)
    texts = [sentence(rng, 40) + (" you nasty fool" if i % 4 == 0 else "") + (" nasty nasty fool fool" if i % 8 == 0 else "") for i in range(400)]
    toxic = np.array([i % 4 == 0 for i in range(400)]).astype(np.int64)
    model = toxicity.fit(texts[:200], toxicity.graded_by_marks(texts[:200], toxic[:200]))
    import pyarrow as pa

    p = np.concatenate([model.at_least(f, t, n) for _, f, t, n in toxicity.features_of(pa.array(texts[200:]))])
    assert ((p[:, 0] >= model.reject_at) == (toxic[200:] == 1)).mean() > 0.97
    assert (np.diff(p, axis=1) <= 1e-12).all()


def test_toxicity_of_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(0, 0), (1, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    got = toxicity.severity(docs, toxicity.learned(docs, labels), ["doc_id"]).collect()
    assert len(got) == docs.count() and not any(r.toxic for r in got)
    assert toxicity.severity(none, toxicity.learned(none, labels), ["doc_id"]).count() == 0


def test_licenses(spark, none):
    rows = [(1, "Foo.\nReleased under the MIT License. bar"), (2, "licensed UNDER the apache license, version 2.0"), (3, "This work is licensed under the GNU General Public License, version 3."), (4, None), (5, ""), (6, "released under a permissive thing"), (7, "under the MIT License")]
    got = {(r.doc_id, r.license): (round(r.containment, 3), r.start_word) for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1, "MIT"] == (1.0, 1) and got[2, "Apache-2.0"] == (1.0, 0) and got[3, "GPL-3.0"] == (1.0, 0) and got[3, "GPL-2.0"][0] == 0.875
    assert {k for k, _ in got} == {1, 2, 3}
    assert licenses.license_matches(none).count() == 0


def test_top_k_prunes_over_blocks_of_queries(spark, monkeypatch):
    """More candidates than are compared at a time and several blocks of queries; clustered vectors, so that bounds tell."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 40)
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 1, (12, 32))
    x = centers[rng.integers(0, 12, 4000)] + rng.normal(0, 0.15, (4000, 32))
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)] + [(77, x[77].tolist(), "again"), (50, x[50].tolist(), "again")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vectors.top_k(df, F.col("vec_id") % 50 == 0).collect())
    ids, ints = np.array([r[0] for r in rows]), np.floor(256 * np.array([r[1] for r in rows]))
    want = []
    for q in range(0, 4000, 50):
        score = ints @ ints[q]
        order = [c for c in np.lexsort((ids, -score)) if ids[c] != q][:5]
        want += [(q, n + 1, int(ids[c]), int(score[c])) for n, c in enumerate(order)]
    assert got == sorted(want)

    queries, turn = ints[::50][:80], vectors.axes(ints[:1024])
    best = vectors.Best(ids[::50][:80], queries, 5, (4, 16), turn, vectors.floors(ids[::50][:80], queries, (ids[:1024], ints[:1024]), 5))
    for at in range(0, len(ids), vectors.CANDIDATES):
        best.add(ids[at : at + vectors.CANDIDATES], ints[at : at + vectors.CANDIDATES])
    assert best.left[1] < best.left[0] < best.pairs and best.left[1] < 0.3 * best.pairs


def test_plan_of_triplets_is_near_the_optimum():
    rng = random.Random(1)
    histogram = {}
    for _ in range(2000):  # three pieces fill a sequence each, so 2000 sequences are enough
        a, b = rng.randrange(1100, 1700), rng.randrange(1100, 1500)
        for n in (a, b, 4096 - a - b):
            histogram[n] = histogram.get(n, 0) + 1
    chosen = packing.plan(histogram, 4096)
    assert sum(times for _, times in chosen) <= 2020
    held = {}
    for pattern, times in chosen:
        assert sum(k * n for k, n in pattern.items()) <= 4096
        for k, n in pattern.items():
            held[k] = held.get(k, 0) + n * times
    assert held == histogram


def test_near_duplicates_by_ids_that_repeat(spark):
    rng = random.Random(8)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    rows = [(1, a), (2, b), (9, a), (9, b), (4, c), (4, a + " two more"), (9, None), (6, ""), (6, "  "), (5, c), (5, c), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.component_id, r.kept) for r in near_duplicates.near_duplicates(docs, width=2).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(1, 1, True), (2, 1, False), (9, 1, False), (9, 1, False), (4, 1, False), (4, 1, False), (9, 1, False), (6, 6, True), (6, 6, True), (5, 1, False), (5, 1, False), (None, 1, False)]))


def test_sketches_lose_no_link_of_large_sets(spark):
    """Pairs just similar enough, of more shingles than a sketch samples, pass; unlike ones don't."""
    rng = np.random.default_rng(11)
    pairs, similar = [], []
    for n in range(400):
        size, ratio = int(rng.integers(600, 9000)), rng.uniform(0.8, 1.0)
        want = 0.8 if n % 2 else 0.45
        small = int(size * max(ratio, want))
        common = int(np.ceil(want * (size + small) / (1 + want)))
        common = min(common, small)
        both = rng.integers(0, 1 << 63, size + small - common, dtype=np.uint64)
        x, y = np.unique(both[:size]), np.unique(both[size - common :])
        pairs.append((vectors_of(x), len(x), vectors_of(y), len(y)))
        similar.append(100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y)))
    df = spark.createDataFrame(pairs, "sa array<long>, na long, sb array<long>, nb long")
    passed = [r.ok for r in df.select(near_duplicates.may_link("sa", "na", "sb", "nb", 80).alias("ok")).collect()]
    assert sum(similar) > 150 and all(ok for ok, s in zip(passed, similar) if s)
    assert sum(ok for ok, s in zip(passed, similar) if not s) < 0.1 * sum(not s for s in similar)


def vectors_of(shingles):
    return near_duplicates.odd_sketch(shingles).tolist()


def test_family_without_its_origin_is_linked_exactly(spark):
    """Copies of one text changed at random, most of them not similar enough to one another: buckets hold many components."""
    rng = random.Random(6)
    base = sentence(rng, 150).split()
    rows = [(i, " ".join(w if rng.random() > 0.01 * (i % 9) else f"e{i}x{k}" for k, w in enumerate(base))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates.near_duplicates(docs, width=2).collect()}
    name, _, group = brute_components(docs, 2, 80)
    assert got == {i: min(n for n, h in zip(name, group) if h == g) for i, g in zip(name, group)}
    assert len(set(got.values())) > 5


def test_licenses_of_short_repeated_and_long_texts(spark):
    """Against brute force, with texts shorter than a template, repeated ids, and columns named like those that are made."""
    templates = {k: re.findall(r"\w+", v.lower()) for k, v in licenses.TEMPLATES.items()}
    rng = random.Random(3)
    short = "This work is licensed under the GNU General Public License, version"
    long = sentence(rng, 3000) + " released under the terms of the isc license " + sentence(rng, 3000)
    rows = [(1, short), (2, "Licensed under the Apache License"), (3, "under the terms of"), (4, long), (4, short), (5, None), (6, ""), (None, short), (7, "x " + licenses.TEMPLATES["MPL-2.0"] + " y")]
    docs = spark.createDataFrame([(i, t, 1, "w", 2) for i, t in rows], "doc_id long, text string, n_words int, words string, start int")
    best, found = {}, {}
    for i, t in rows:
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        for name, own in templates.items():
            tokens = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
            n = min(len(own), len(w))
            for s in range(len(w) - n + 1) if len(w) >= 5 and tokens else ():
                share = len(tokens & {tuple(w[k : k + 5]) for k in range(s, s + n - 4)}) / len(tokens)
                if share >= 0.8:
                    best[i, name] = max(best.get((i, name), (0, 0)), (share, -s))
                    found.setdefault((i, name), set()).add(s)
    want = sorted(((i, name, share, -s, len(found[i, name])) for (i, name), (share, s) in best.items()), key=str)
    assert (1, "GPL-2.0", 0.875, 0, 1) in want
    assert sorted(map(tuple, licenses.license_matches(docs).collect()), key=str) == want
