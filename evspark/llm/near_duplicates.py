"""Near-duplicate documents: MinHash bands find candidates, odd sketches sift them, full shingle sets confirm them.

The minima of `bands * rows` hash functions over a document's shingles give band keys. An odd sketch folds a set's MinHash
samples, here the SAMPLES shingles of the least hashes, into a bitmap where each sample flips one bit, so the bits in
which two sketches differ estimate how many samples differ and with that the similarity (Mitzenmacher, Pagh and Pham,
2014). Sets of up to SAMPLES shingles are sampled whole; then the differing bits never exceed the shingles that differ,
and no link can be lost. For larger sets, a margin of 5.5 deviations holds.

Only the structure that all links make is needed, so no bucket is expanded into its pairs. First every text of a bucket is
held against the bucket's smallest; then, in buckets that still hold more than one component, against a pivot that
differs from band to band. What links the components that still share a bucket is found by an exact join over those
buckets' texts: on shingles ordered by how rare they are there, of which a pair of similar sets shares one within a
prefix, with bounds by size and place in that order. Sketches sift each of these lists and full sets decide.

Nodes are the distinct texts, named by the smallest doc_id they come with; a doc_id that comes with several texts links
them. Null and empty texts, and texts without words, have an empty set and link with nothing but by their doc_id. Rows
without doc_id get the component of equal texts, else null, and aren't kept. Repeated rows get equal answers. Ties of
minima or in the order of shingles go to the smaller hash. An empty table gives no rows. Texts of any length count
whole. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import table, tidy, written
from evspark.llm.components import components
from evspark.llm.shingles import blocks, mix, shingle_hashes, word_hashes

BANDS, ROWS, SKETCH_BITS, SAMPLES = 32, 4, 2048, 1024
WORDS = SKETCH_BITS // 64
#: Buckets of the table that tells rare shingles from frequent ones, which is broadcast: 2 MB.
RARITY = 1 << 18
#: Rows of a frequent shingle that one task compares, about, and the parts that its rows are dealt to at most.
TOGETHER, MOST_PARTS = 2000, 64


def seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def minima(shingles: np.ndarray, multipliers: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the shingles."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(multipliers), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        np.minimum(least, (x[at : at + 1024, None] * multipliers + shifts).min(axis=0), out=least)
    return least


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """A bitmap, as 64-bit words, in which each sample of distinct shingles flips one bit."""
    x = mix(shingles ^ np.uint64(0x5851F42D4C957F2D))
    x = np.partition(x, SAMPLES - 1)[:SAMPLES] if len(x) > SAMPLES else x
    parity = np.bincount((mix(x) & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view("<i8")


def band_keys(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        key = mix(key * np.uint64(0xA24BAED4963EE407) + column.astype(np.uint64))
    return key.view(np.int64)


def signatures(docs: DataFrame, width: int, key: str, text: str) -> DataFrame:
    """id, class (equal for equal texts), n_shingles, bands and sketch of each row."""
    n = BANDS * ROWS
    random = seeds(2 * n)
    multipliers, shifts = (random[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (random[n:] >> np.uint64(32)).astype(np.uint32)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bands, sketches = [], [], []
            for _, data, cuts in blocks(batch.column(2)):
                words, of, _, _ = word_hashes(data, cuts)
                at = np.searchsorted(of, np.arange(len(cuts)))
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    found = shingle_hashes(words[a:b], width)
                    bands.append(band_keys(minima(found, multipliers, shifts), BANDS, ROWS))
                    found = np.unique(found)
                    sizes.append(len(found))
                    sketches.append(odd_sketch(found))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * w), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x, w in ((bands, BANDS), (sketches, WORDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *lists], ["id", "class", "n_shingles", "bands", "sketch"])
        tidy()

    rows = docs.select(F.col(key).cast("long").alias("id"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("class"), F.col(text).alias("text"))
    return rows.mapInArrow(sign, "id long, class binary, n_shingles long, bands array<long>, sketch array<long>")


def most_bits(na: Column, nb: Column, percent: int) -> Column:
    """The bits in which the sketches of two sets of na and nb shingles can differ if the sets are similar enough."""
    common = (na + nb) * percent / (100 + percent)  # shingles that such sets share at least
    kept = F.least(F.lit(1.0), SAMPLES / F.greatest(na, nb))  # the share of them that both samples hold
    differ = F.least(na, F.lit(SAMPLES)) + F.least(nb, F.lit(SAMPLES)) - 2 * common * kept
    estimate = SKETCH_BITS / 2 * (1 - F.exp(-2 * differ / SKETCH_BITS))
    # deviations of the shared samples, of the samples' bounds, and of how often samples meet in a bit
    chance = common * kept * (1 - common / F.greatest(na, nb)) + SAMPLES * (1 - common / F.least(na, nb))
    margin = 5.5 * F.sqrt(2.6 * chance + 2 * differ * differ / SKETCH_BITS + 16)
    return F.when(kept >= 1, differ + 1e-6).otherwise(estimate + margin)


def may_link(a: str, na: str, b: str, nb: str, percent: int) -> Column:
    """Whether two sets of na and nb shingles, with sketches a and b, can be similar enough."""
    bits = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(WORDS)]
    sized = F.least(na, nb) * 100 >= F.greatest(na, nb) * percent
    return sized & (sum(bits[1:], bits[0]) <= most_bits(F.col(na), F.col(nb), percent))


def confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b (nodes) of those of pairs (ca, cb: classes) whose sketches are close and whose full sets are similar enough."""
    signed = nodes.select("class", "node", "sketch", "n_shingles")
    near = pairs.join(signed.toDF("ca", "a", "sa", "na"), "ca").join(signed.toDF("cb", "b", "sb", "nb"), "cb")
    near = near.filter(may_link("sa", "na", "sb", "nb", percent)).select("ca", "a", "cb", "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            keep = []
            for b, ta, tb in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4)):
                if b != last:  # rows of one b come together
                    last, own = b, full_set(tb.as_py(), width)
                other = full_set(ta.as_py(), width)
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(own) + len(other) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])
        tidy()

    full = near.join(texts.toDF("ca", "ta"), "ca").join(texts.toDF("cb", "tb"), "cb")
    return written(full.select("a", "b", "cb", "ta", "tb").mapInArrow(check, "a long, b long"), "links")


def full_set(packed: bytes, width: int) -> np.ndarray:
    """The distinct shingles of a compressed text, in order."""
    import zstandard

    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.unique(shingle_hashes(word_hashes(data, np.array([0, len(data)]))[0], width))


def packed_texts(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """class, text compressed: one row for each of wanted (id, class, named by one row of docs each)."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack((x or "").encode()) for x in batch.column(1).to_pylist()], pa.binary())], ["class", "packed"])
        tidy()

    rows = docs.join(wanted, ["id", "class"], "left_semi").select("class", text)
    return rows.mapInArrow(squeeze, "class binary, packed binary").dropDuplicates(["class"])


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept of each row: the components of the links between sets of `width`-word shingles
    whose intersection is at least `percent` hundredths of their union."""
    signed = written(signatures(docs, width, key, text), "signatures")
    roots = signed.groupBy("class").agg(F.min("id").alias("node"), F.count("*").alias("n_rows"))
    first = signed.filter("n_shingles > 0 AND id IS NOT NULL").join(roots.select("class", F.col("node").alias("id")), ["class", "id"])
    nodes = written(first.dropDuplicates(["class"]).withColumnRenamed("id", "node"), "nodes")
    banded = nodes.select("class", "node", F.explode("bands").alias("key"))
    pivots = banded.groupBy("key").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).filter("n > 1").select("key", "pivot")
    shared = written(banded.join(pivots, "key"), "buckets")
    plain = docs.select(F.col(key).cast("long").alias("id"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("class"), text)
    texts = written(packed_texts(plain, shared.select(F.col("node").alias("id"), "class").distinct(), text), "texts")

    to_pivot = shared.filter("node <> pivot").select(F.col("class").alias("ca"), "pivot").distinct().join(nodes.select(F.col("node").alias("pivot"), F.col("class").alias("cb")), "pivot")
    links = confirmed(to_pivot.select("ca", "cb"), nodes, texts, width, percent)
    several, of_ids = links_of_ids(signed, roots)
    if several is not None:
        links = links.unionByName(of_ids)
    found = components(links, "a", "b")
    for last in (False, True):
        mixed = mixed_buckets(shared, found)
        if mixed.isEmpty():
            break
        pairs = across(mixed, nodes, texts, width, percent) if last else by_band_pivot(mixed)
        links = confirmed(pairs, nodes, texts, width, percent)
        if not links.isEmpty():
            found = components(links, "a", "b", found=found)

    return labelled(signed, roots, found, several, key)


#: A class of more than this share of all rows is looked up in a broadcast table, of as many rows at most.
HEAVY = 5000


def labelled(signed: DataFrame, roots: DataFrame, found: DataFrame | None, several: DataFrame | None, key: str) -> DataFrame:
    """key, n_shingles, component_id, kept of each row of signed. roots: class, node, n_rows. Components are looked up for
    each class first; rows of frequent classes meet them by a broadcast of HEAVY classes at most, so no task gets all copies
    of a text."""
    classes = roots.withColumn("component", F.col("node")) if found is None else roots.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = written(classes.select("class", "component", "n_rows"), "classes")
    least = signed.count() // HEAVY
    heavy = classes.filter(F.col("n_rows") > least).select("class", F.col("component").alias("_c"), F.lit(True).alias("_heavy"))
    rows = signed.select("id", "class", "n_shingles").join(F.broadcast(heavy), "class", "left")
    light = rows.filter("_heavy IS NULL").drop("_c", "_heavy").join(classes.filter(F.col("n_rows") <= least).select("class", F.col("component").alias("_c")), "class")
    rows = rows.filter("_heavy").drop("_heavy").unionByName(light)
    rows = rows.select("id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("_c")).alias("c"))
    component = F.col("c")
    if several is not None:  # an id's rows have one component, those without words too
        own = rows.join(several, "id", "left_semi").groupBy("id").agg(F.min("c").alias("of_id"))
        rows, component = rows.join(own, "id", "left"), F.coalesce("of_id", "c")
    return rows.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def links_of_ids(signed: DataFrame, roots: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """The ids that come with several texts, and the links (a, b: nodes) between those; None and None if there are none."""
    several = signed.filter("id IS NOT NULL").groupBy("id").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select("id")
    several = written(several, "several")
    return (None, None) if several.isEmpty() else (several, written(id_links(signed, several, roots.select("class", "node")), "ids"))


def id_links(signed: DataFrame, several: DataFrame, roots: DataFrame) -> DataFrame:
    """a, b: the nodes of each id's texts, linked with the smallest of them."""
    of = signed.filter("n_shingles > 0").join(several, "id").select("id", "class").distinct().join(roots, "class").select("id", "node").distinct()
    return of.join(of.groupBy("id").agg(F.min("node").alias("b")), "id").filter("node <> b").select(F.col("node").alias("a"), "b")


def mixed_buckets(shared: DataFrame, found: DataFrame | None) -> DataFrame:
    """key, class, component, main: the rows of buckets that hold several components, with the component most frequent there."""
    named = shared.select("key", "class", "node")
    named = named.withColumn("component", F.col("node")) if found is None else named.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.count("*").alias("k"), F.max(F.struct("n", "component")).alias("m")).filter("k > 1").select("key", F.col("m.component").alias("main"))
    return written(named.join(main, "key").select("key", "class", "component", "main"), "mixed")


def by_band_pivot(mixed: DataFrame) -> DataFrame:
    """Each row of a mixed bucket with a pivot of another component, chosen by a hash that differs from bucket to bucket."""
    pivot = mixed.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "class").alias("h"), "class", "component")).alias("p"))
    pairs = mixed.join(pivot, "key").filter("component <> p.component")
    return pairs.select(F.greatest("class", "p.class").alias("ca"), F.least("class", "p.class").alias("cb")).distinct()


def across(mixed: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs of classes that can be similar enough, of different components, among the texts of mixed buckets, one of them
    outside the main component of one of its buckets: an exact join by rare shingles.

    Two sets share at least c = percent / (100 + percent) of their sizes' sum. In one order for all sets, the first shared
    shingle has at least c shingles from it on in both. So the larger set, of n, has it among its first n - ceil(percent n
    / 100) + 1 and the smaller one among its first n - ceil(2 percent n / (100 + percent)) + 1. Any order is right; rarest
    first, by counts in RARITY buckets, keeps frequent shingles out of these prefixes.
    """
    spark = mixed.sparkSession
    who = mixed.groupBy("class").agg(F.first("component").alias("component"), F.max(F.col("component") != F.col("main")).alias("outside"))
    rows = written(who.join(texts.toDF("class", "packed"), "class"), "residue")

    def buckets(tokens: np.ndarray) -> np.ndarray:
        return (tokens >> np.uint64(64 - RARITY.bit_length() + 1)).astype(np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(RARITY, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                np.add.at(n, buckets(full_set(packed.as_py(), width)), 1)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])
        tidy()

    counted = rows.select("packed").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # RARITY rows at most
    n = np.zeros(RARITY, np.int64)
    n[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    parts = np.clip(-(-(n - 2 * n.mean().astype(np.int64)) // TOGETHER), 1, MOST_PARTS)
    shared = spark.sparkContext.broadcast((n, parts.astype(np.int64)))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, dealt = shared.value
        for batch in batches:
            for name, component, outside, packed in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = full_set(packed, width)
                size, bucket = len(tokens), buckets(tokens)
                order = np.lexsort((tokens, often[bucket]))
                larger, smaller = size - math.ceil(percent * size / 100 - 1e-9) + 1, size - math.ceil(2 * percent * size / (100 + percent) - 1e-9) + 1
                own = order[:larger]
                token, left, of = tokens[own].view(np.int64), size - np.arange(len(own)), dealt[bucket[own]]
                salt = int.from_bytes(name[:6], "big") % of
                out = []
                for is_larger, k, at, part in ((False, smaller, np.arange(min(smaller, len(own))), salt), (True, larger, np.repeat(np.arange(len(own)), of), None)):
                    part = part[at] if part is not None else np.arange(len(at)) - np.repeat(np.cumsum(of) - of, of)
                    out.append((np.full(len(at), is_larger), token[at], part, left[at]))
                columns = [np.concatenate(x) for x in zip(*out)]
                m = len(columns[0])
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([name] * m, pa.binary()), pa.array([component] * m, pa.int64()), pa.array([outside] * m, pa.bool_()), pa.array([size] * m, pa.int64())], ["larger", "token", "part", "left", "class", "component", "outside", "n"])
        tidy()

    every = written(rows.select("class", "component", "outside", "packed").mapInArrow(prefixes, "larger boolean, token long, part long, left long, class binary, component long, outside boolean, n long"), "prefixes")
    a, b = every.filter("larger").alias("a"), every.filter("NOT larger").alias("b")
    similar = (
        (F.col("a.token") == F.col("b.token")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.component") != F.col("b.component")) & (F.col("a.outside") | F.col("b.outside"))
        & (F.col("a.n") >= F.col("b.n")) & (F.col("b.n") * 100 >= F.col("a.n") * percent) & (F.least("a.left", "b.left") * (100 + percent) >= (F.col("a.n") + F.col("b.n")) * percent)
    )
    return a.join(b, similar).select(F.greatest("a.class", "b.class").alias("ca"), F.least("a.class", "b.class").alias("cb")).distinct()


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
