"""Exact join of documents by the Jaccard similarity of their shingle sets, by partitions of the universe and a pigeonhole.

Two sets of which the larger has l shingles can be similar enough only if at most H = floor(2 l (100 - p) / (100 + p)) shingles
are in one of them alone. Shingles are dealt to M segments by their hash. A set that is looked up gives each segment an
allocation of 0, 1 or 2 that add up to H + 1: if each segment's part differed by its allocation at least, the sets would
differ too much, so a similar set has a segment that is equal (allocation 1 or more) or differs by one shingle
(allocation 2), that is, one part is the other's one-deletion neighbour. Sizes are cut into bands [2^b, 2^(b+1)) with an M
each; a set is indexed in its own band and in the next one where similar sets can be that large, and looked up, as the
larger of a pair, in its own.

Allocations are the cheapest: a unit of a segment costs as many rows as there are with such parts in the corpus, by counts
in RARITY buckets. Empty and frequent parts are thus passed over, in exchange for deletions (of one segment in SPREAD) or
for other segments. Costs only decide how much is looked up, never what is found.

Index rows (the hash of a segment and its part, the row's id) are dealt by that hash in packed blocks and sorted in numpy;
parts that are very frequent are dealt to several places. Only rows that share a hash go on. Groups of similar texts are never
expanded into their pairs: in each group all are held against one of their place, and those against each other's least, then
against another one, and what is left are pairs of different components. Sketches, bitmaps in which each shingle flips one bit, differ in no more bits than the
sets in shingles and sift pairs without loss; full sets confirm them.

Only texts that can have a similar one are indexed. A shingle that no other text has is in one set alone, and a set of n
has n (100 - p) / 100 of those at most if it is similar to any. They are counted among half of all shingles, those of small
hashes, so more are never counted than there are: a text that is left out links with nothing. Each chunk of rows sends its
distinct shingles to places by their hash, once each, and gets a bit back for each of them that another chunk has. Texts
meet the names of those that stay in an exact join, after a broadcast table of bits, in which each name sets one, has dropped
most others; so the texts that are left out aren't shuffled.

Nodes are the distinct texts, as for near duplicates: null and empty texts, and texts without words, have an empty set and
link with nothing but by their doc_id; a doc_id with several texts links them; rows without doc_id get the component of
equal texts, else null. Repeated rows get equal answers. Ties of cost go to the segment of smaller number, those of
components to the smaller doc_id. An empty table gives no rows. Texts of any length count whole. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import Chunks, named, new_path, table, tidy, written
from evspark.llm.components import components
from evspark.llm.near_duplicates import full_set, labelled, links_of_ids, packed_texts
from evspark.llm.shingles import blocks, mix, shingle_hashes, word_hashes

SKETCH_BITS = 2048
WORDS = SKETCH_BITS // 64
#: Buckets of the table of costs, which is broadcast: 4 MB.
RARITY = 1 << 19
#: Bits of the table that tells which texts may be indexed, which is broadcast: 4 MB.
LIVE_BITS = 1 << 25
#: Of so many segments one has its deletions indexed.
SPREAD = 16
#: Index rows of one place that a task sorts, about, and the rows of one hash that stay together, with the most parts of it.
PLACE_ROWS, TOGETHER, MOST_PARTS = 1 << 20, 2000, 64
#: Rows of a group that others are compared with at a time.
BLOCK = 4096
#: Rows of a block, rows that are compared with it too, rows that are only compared with it; in the order in which they come.
INNER, BOTH, OUTER = 0, 1, 2
#: Index rows that a task holds before it hands them on.
HELD = 1 << 20


def apart(n: int, percent: int) -> int:
    """The most shingles that a set of n and a smaller one that is similar enough can have alone."""
    return 2 * n * (100 - percent) // (100 + percent)


class Parts:
    """The segments of one set in one band of sizes."""

    def __init__(self, tokens: np.ndarray, band: int, percent: int):
        self.n = (apart((2 << band) - 1, percent) + 1) * 3 // 2 + 1  # half as many again as are looked up, to choose among
        base = mix(np.arange(self.n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(band + 1))
        x = mix(tokens ^ np.uint64(0x2545F4914F6CDD1D))
        of = (mix(x + np.uint64(band)) % np.uint64(self.n)).astype(np.int64)
        sums = np.zeros(self.n, np.uint64)
        np.add.at(sums, of, x)
        #: A hash of each segment with its part.
        self.full = mix(sums ^ base)
        open_ = np.flatnonzero(of % SPREAD == 0)
        #: The segments whose deletions are indexed, one entry for each deletion, and its hash.
        self.cut_of = of[open_]
        self.cut = mix((sums[self.cut_of] - x[open_]) ^ base[self.cut_of])

    def allocation(self, cost: np.ndarray, need: int) -> np.ndarray:
        """Units of the segments, need in all, at the least cost by the numbers of rows that `cost` has for hashes."""
        first = cost[place_of(self.full)].astype(np.int64)
        second = np.full(self.n, np.iinfo(np.int64).max)
        open_ = np.arange(0, self.n, SPREAD)
        second[open_] = 2 * first[open_] + np.bincount(self.cut_of, cost[place_of(self.cut)], self.n)[open_].astype(np.int64)
        units = np.concatenate([first, second[open_]])
        best = np.argsort(units, kind="stable")[:need]
        return np.bincount(np.concatenate([np.arange(self.n), open_])[best], minlength=self.n)


def dealt_to(cost: np.ndarray, together: int) -> np.ndarray:
    """The number of places that rows of each bucket's hashes are dealt to."""
    return np.clip(-(-(cost - 2 * int(cost.mean())) // together), 1, MOST_PARTS)


def place_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - RARITY.bit_length() + 1)).astype(np.int64)


def bands_of(n: int, percent: int) -> range:
    """The bands in which a set of n shingles is indexed: its own and those of larger similar sets."""
    return range(n.bit_length() - 1, (100 * n // percent).bit_length())


def sketch(tokens: np.ndarray) -> np.ndarray:
    """A bitmap, as 64-bit words, in which each shingle flips one bit."""
    bits = np.bincount((mix(tokens ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def sets_of(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, in order."""
    for _, data, cuts in blocks(column):
        words, of, _, _ = word_hashes(data, cuts)
        at = np.searchsorted(of, np.arange(len(cuts)))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield np.unique(shingle_hashes(words[a:b], width))


#: A chunk's rows as a file: the set's size, and of its shingles of small hashes the lower 32 of 40 bits and the upper 8.
SAMPLED = pa.schema([("id", pa.int64()), ("class", pa.binary()), ("n", pa.int64()), ("low", pa.binary()), ("high", pa.binary())])


def signed_rows(docs: DataFrame, width: int, key: str, text: str, folder: str, held: int) -> DataFrame:
    """id, class (equal for equal texts), n_shingles and sketch of each row, with its chunk in the folder and its place there.
    Chunks hold about `held` shingles."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def chunk() -> pa.RecordBatch:
            ids, names, sizes, sketches, low, high = zip(*waiting)
            number = Chunks(folder).write([pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, names, sizes, low, high), SAMPLED)], schema=SAMPLED)], SAMPLED)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * WORDS), pa.array(np.concatenate(sketches)))
            columns = [pa.array(ids, pa.int64()), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), lists, pa.array([number] * len(ids), pa.int64()), pa.array(np.arange(len(ids)))]
            return pa.RecordBatch.from_arrays(columns, ["id", "class", "n_shingles", "sketch", "chunk", "at"])

        for batch in batches:
            for i, name, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets_of(batch.column(2), width)):
                some = tokens[: np.searchsorted(tokens, np.uint64(1 << 63))] >> np.uint64(23)
                waiting.append((i, name, len(tokens), sketch(tokens), some.astype(np.uint32).tobytes(), (some >> np.uint64(32)).astype(np.uint8).tobytes()))
                size += len(some) + WORDS
                if size >= held:
                    yield chunk()
                    waiting, size = [], 0
        if waiting:
            yield chunk()
        tidy()

    return keyed(docs, key, text).mapInArrow(sign, "id long, class binary, n_shingles long, sketch array<long>, chunk long, at long")


def values_of(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, np.uint32).astype(np.uint64) | np.frombuffer(high, np.uint8).astype(np.uint64) << np.uint64(32)


class Sample:
    """The shingles of small hashes of some rows of a chunk, each once, by their place."""

    def __init__(self, folder: str, chunk: int, at: list[int], n_places: int):
        self.rows = Chunks(folder).read(chunk).take(pa.array(sorted(at)))
        low, high = (self.rows.column(c).to_pylist() for c in ("low", "high"))
        values, self.of, n = np.unique(values_of(b"".join(low), b"".join(high)), return_inverse=True, return_counts=True)
        #: The row of each shingle of the rows, and which distinct shingles several rows have.
        self.row, self.several = np.repeat(np.arange(len(high)), [len(x) for x in high]), n > 1
        place = (values % np.uint64(n_places)).astype(np.int64)
        self.order = np.argsort(place, kind="stable")
        self.values = values[self.order]
        self.places, starts = np.unique(place[self.order], return_index=True)
        self.cuts = [*starts.tolist(), len(values)]


def live_rows(nodes: DataFrame, folder: str, percent: int, place_rows: int) -> DataFrame:
    """id, class of those of nodes (chunk, at, n_shingles) that may be similar to another. A written table."""
    chunks = written(nodes.groupBy("chunk").agg(F.collect_list("at").alias("at"), F.sum("n_shingles").alias("n")), "chunks")
    n_chunks, total = chunks.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    n_places = max(1, -(-total // (2 * place_rows)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, at in zip(*(c.to_pylist() for c in batch.columns)):
                own = Sample(folder, chunk, at, n_places)
                cuts = list(zip(own.cuts[:-1], own.cuts[1:]))
                packed = [[x[a:b].tobytes() for a, b in cuts] for x in (own.values.astype(np.uint32), (own.values >> np.uint64(32)).astype(np.uint8))]
                yield pa.RecordBatch.from_arrays([pa.array(own.places), pa.array([chunk] * len(cuts), pa.int64()), *(pa.array(x, pa.binary()) for x in packed)], ["place", "chunk", "low", "high"])
        tidy()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, waiting = None, []

        def shared() -> pa.RecordBatch:
            numbers, values = zip(*waiting)
            every = np.concatenate(values)
            order = np.argsort(every, kind="stable")
            same = every[order][1:] == every[order][:-1]
            some = np.zeros(len(every), bool)
            some[order[1:]] |= same
            some[order[:-1]] |= same
            ends = np.cumsum([len(x) for x in values]).tolist()
            bits = [np.packbits(some[a:b]).tobytes() for a, b in zip([0, *ends], ends)]
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([place] * len(bits), pa.int64()), pa.array(bits, pa.binary())], ["chunk", "place", "bits"])

        for batch in batches:
            for p, chunk, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                if p != place and waiting:
                    yield shared()
                    waiting = []
                place = p
                waiting.append((chunk, values_of(low, high)))
        if waiting:
            yield shared()
        tidy()

    def judge(known: pa.Table) -> pa.Table:
        rows = {p: (bits, at) for p, bits, at in zip(*(known.column(c).to_pylist() for c in ("place", "bits", "at")))}
        own = Sample(folder, known.column("chunk")[0].as_py(), rows[-1][1], n_places)
        some = [np.unpackbits(np.frombuffer(rows[p][0], np.uint8), count=b - a) for p, a, b in zip(own.places.tolist(), own.cuts[:-1], own.cuts[1:])]
        shared = own.several.copy()
        shared[own.order] |= np.concatenate([np.zeros(0, np.uint8), *some]).astype(bool)
        alone = np.bincount(own.row[~shared[own.of]], minlength=own.rows.num_rows)
        live = own.rows.filter(pa.array(alone <= own.rows.column("n").to_numpy() * (100 - percent) // 100)).select(["id", "class"])
        del own, some, shared
        tidy()
        return live

    asked = chunks.select("chunk", "at").repartition(max(1, n_chunks)).mapInArrow(ask, "place long, chunk long, low binary, high binary")
    answers = asked.repartition(min(n_places, 4096), "place").sortWithinPartitions("place").mapInArrow(answer, "chunk long, place long, bits binary")
    known = written(answers, "answers").withColumn("at", F.lit(None).cast("array<long>"))
    known = known.unionByName(chunks.select("chunk", F.lit(-1).cast("long").alias("place"), F.lit(b"").alias("bits"), "at"))
    return written(known.repartition(max(1, n_chunks), "chunk").groupBy("chunk").applyInArrow(judge, "id long, class binary"), "live")


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(named(key).cast("long").alias("id"), F.unhex(F.md5(F.coalesce(named(text), F.lit("")))).alias("class"), named(text).alias("text"))


def named_texts(docs: DataFrame, live: DataFrame) -> DataFrame:
    """id, text of those rows of docs (id, class, text) that live (id, class) names."""
    bit = F.pmod(F.xxhash64("id", "class"), F.lit(LIVE_BITS))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    found = live.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()  # LIVE_BITS / 64 rows at most
    bits = np.zeros(-(-LIVE_BITS // 64), np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def may_be(places: pa.Array) -> pa.Array:
        at = places.to_numpy()
        return pa.array((shared.value[at >> 6] >> (at & 63) & 1).astype(bool))

    return docs.filter(may_be(bit)).join(live, ["id", "class"], "left_semi").select("id", "text")


def costs(docs: DataFrame, width: int, percent: int, key: str, text: str) -> np.ndarray:
    """How many index rows fall into each of RARITY buckets, over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(RARITY, np.int64)
        for batch in batches:
            for tokens in sets_of(batch.column(2), width):
                for band in bands_of(len(tokens), percent) if len(tokens) else ():
                    parts = Parts(tokens, band, percent)
                    np.add.at(n, place_of(parts.full), 1)
                    np.add.at(n, place_of(parts.cut), 1)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])
        tidy()

    found = keyed(docs, key, text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # RARITY rows at most
    out = np.zeros(RARITY, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def index_rows(docs: DataFrame, cost, n_places: int, together: int, width: int, percent: int, key: str, text: str) -> DataFrame:
    """place, hashes, ids (from `least` on), roles, least: packed index rows of all rows with an id and words; a text that a task meets again under
    another id is left out, as equal texts are linked anyway. A role is the allocation of a whole part (0 to 2), and 4 more
    for a deletion."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = cost.value
        parts_of = dealt_to(often, together)
        waiting, size, seen = [], 0, set()

        def dealt() -> Iterator[pa.RecordBatch]:
            hashes, ids, roles = (np.concatenate(x) for x in zip(*waiting))
            spread = parts_of[place_of(hashes)]
            many = spread > 1
            place = (hashes % np.uint64(n_places)).astype(np.int64)
            salt = (mix(ids[many].view(np.uint64)) % spread[many].astype(np.uint64)).astype(np.int64)
            place[many] = (place[many] + salt) % n_places
            order = np.argsort(place, kind="stable")
            own, starts = np.unique(place[order], return_index=True)
            cuts = [*starts.tolist(), len(order)]
            hashes, ids, roles = hashes[order], ids[order], roles[order]
            least = int(ids.min())
            ids = ids.view(np.uint64) - np.uint64(least & (1 << 64) - 1)  # from the least one, in half the bytes where they fit
            ids = ids.astype(np.uint32) if int(ids.max()) < 1 << 32 else ids
            packed = [[x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])] for x in (hashes, ids, roles)]
            yield pa.RecordBatch.from_arrays([pa.array(own), *(pa.array(x, pa.binary()) for x in packed), pa.array(np.full(len(own), least))], ["place", "hashes", "ids", "roles", "least"])

        for batch in batches:
            for i, name, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets_of(batch.column(2), width)):
                if i is None or not len(tokens) or name in seen:
                    continue
                if len(seen) >= HELD:
                    seen.clear()
                seen.add(name)
                for nth, band in enumerate(bands_of(len(tokens), percent)):
                    parts = Parts(tokens, band, percent)
                    role = np.zeros(parts.n, np.int64) if nth else parts.allocation(often, apart(len(tokens), percent) + 1)
                    hashes = np.concatenate([parts.full, parts.cut])
                    waiting.append((hashes, np.full(len(hashes), i, np.int64), np.concatenate([role, 4 + role[parts.cut_of]]).astype(np.uint8)))
                    size += len(hashes)
                if size >= HELD:
                    yield from dealt()
                    waiting, size = [], 0
        if waiting:
            yield from dealt()
        tidy()

    return keyed(docs, key, text).mapInArrow(index, "place long, hashes binary, ids binary, roles binary, least long")


def met(packed: DataFrame, cost, n_places: int, together: int) -> DataFrame:
    """hash, id, role, head, asks, dealt of index rows whose hash others have, where one that is looked up meets another.
    head is the smallest id with a whole part in the row's place, asks whether one of both is looked up in a way that finds
    the other. Hashes
    that are dealt to several places keep all rows. A written table."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, waiting, parts_of = None, [], dealt_to(cost.value, together)

        def shared() -> Iterator[pa.RecordBatch]:
            hashes, ids, roles = (np.concatenate(x) for x in zip(*waiting))
            order = np.argsort(hashes, kind="stable")
            same = hashes[order][1:] == hashes[order][:-1]
            some = parts_of[place_of(hashes[order])] > 1
            some[1:] |= same
            some[:-1] |= same
            order = order[some]
            hashes, ids, roles = hashes[order], ids[order], roles[order]
            if not len(hashes):
                return
            order = np.lexsort((ids, roles >= 4, hashes))
            hashes, ids, roles = hashes[order], ids[order], roles[order]
            whole, unit = roles < 4, roles & 3
            starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
            sizes = np.diff(np.r_[starts, len(hashes)])
            n_whole = np.add.reduceat(whole.astype(np.int64), starts)
            looked = np.maximum.reduceat(np.where(whole, unit, 0), starts)
            finds = (n_whole > 1) & (looked >= 1) | (n_whole > 0) & (n_whole < sizes) & (np.maximum.reduceat(unit, starts) == 2)
            several = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)
            dealt = np.repeat(parts_of[place_of(hashes[starts])] > 1, sizes)
            most = np.maximum(unit, np.repeat(unit[starts], sizes))
            asks = np.where(whole, most >= 1, most == 2)
            keep = dealt | np.repeat(finds & several, sizes)
            columns = [hashes.view(np.int64), ids, roles.astype(np.int32), np.repeat(ids[starts], sizes), asks, dealt]
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], ["hash", "id", "role", "head", "asks", "dealt"])

        for batch in batches:
            for p, hashes, ids, roles, least in zip(*(c.to_pylist() for c in batch.columns)):
                if p != place and waiting:
                    yield from shared()
                    waiting = []
                place = p
                whole = np.uint64 if len(ids) == len(hashes) else np.uint32
                ids = np.frombuffer(ids, whole).astype(np.uint64) + np.uint64(least & (1 << 64) - 1)
                waiting.append([np.frombuffer(hashes, np.uint64), ids.view(np.int64), np.frombuffer(roles, np.uint8)])
        if waiting:
            yield from shared()
        tidy()

    rows = packed.repartition(min(n_places, 4096), "place").sortWithinPartitions("place")
    return written(rows.mapInArrow(sort, "hash long, id long, role int, head long, asks boolean, dealt boolean"), "met")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, percent: int, key: str, text: str) -> DataFrame:
    """Those of pairs (a, b: nodes) whose sketches differ little and whose full sets are similar enough."""
    signed = nodes.select("node", "class", "sketch", "n_shingles")
    both = pairs.join(signed.toDF("a", "ca", "sa", "na"), "a").join(signed.toDF("b", "cb", "sb", "nb"), "b")
    bits = [F.bit_count(F.get("sa", F.lit(i)).bitwiseXOR(F.get("sb", F.lit(i)))) for i in range(WORDS)]
    sized = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    near = both.filter(sized & (sum(bits[1:], bits[0]) * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)))
    near = written(near.select("ca", "a", "cb", "b"), "near")
    wanted = near.select(F.col("a").alias("id"), F.col("ca").alias("class")).unionByName(near.select(F.col("b").alias("id"), F.col("cb").alias("class"))).distinct()
    texts = written(packed_texts(keyed(docs, key, text), wanted, "text"), "texts")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            keep = []
            for b, ta, tb in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if b != last:  # rows of one b come together
                    last, own = b, full_set(tb.as_py(), width)
                other = full_set(ta.as_py(), width)
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * common >= percent * (len(own) + len(other) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])
        tidy()

    full = near.join(texts.toDF("ca", "ta"), "ca").join(texts.toDF("cb", "tb"), "cb")
    return written(full.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long"), "links")


def looked_up(a: str, b: str):
    """Whether of two rows of a hash one is looked up in a way that finds the other: two whole parts by any allocation, a
    whole part and a deletion by an allocation of 2, two deletions never."""
    x, y = F.col(a), F.col(b)
    return F.when((x < 4) & (y < 4), F.greatest(x, y) >= 1).when((x >= 4) & (y >= 4), False).otherwise(F.greatest(F.pmod(x, F.lit(4)), F.pmod(y, F.lit(4))) == 2)


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", together: int = TOGETHER, place_rows: int = PLACE_ROWS) -> DataFrame:
    """key, n_shingles and component_id of each row: the components of the links between sets of `width`-word shingles whose
    intersection is at least `percent` hundredths of their union. `together` and `place_rows` tell how work is dealt."""
    spark = docs.sparkSession
    folder = new_path(spark, "shingles")
    signed = written(signed_rows(docs, width, key, text, folder, place_rows), "signed")
    roots = signed.groupBy("class").agg(F.min("id").alias("node"), F.count("*").alias("n_rows"))
    first = signed.filter("n_shingles > 0 AND id IS NOT NULL").join(roots.select("class", F.col("node").alias("id")), ["class", "id"])
    nodes = written(first.dropDuplicates(["class"]).withColumnRenamed("id", "node"), "nodes")
    live = live_rows(nodes, folder, percent, place_rows)
    docs, key_of, text = written(named_texts(keyed(docs, key, text), live), "texts"), key, "text"
    key = "id"  # of the row that names its text's node

    often = costs(docs, width, percent, key, text)
    n_places = max(1, -(-int(often.sum()) // place_rows))
    cost = spark.sparkContext.broadcast(often)
    rows = met(index_rows(docs, cost, n_places, together, width, percent, key, text), cost, n_places, together)
    asked = rows.filter("dealt AND role % 4 > 0").select("hash").distinct()
    rows = rows.filter("NOT dealt").unionByName(rows.filter("dealt").join(asked, "hash", "left_semi"))
    heads = rows.filter("dealt").select("hash", "head").distinct()
    heads = heads.join(heads.groupBy("hash").agg(F.min("head").alias("first")), "hash").select(F.col("head").alias("id"), F.col("first").alias("head"))
    stars = written(rows.filter("asks").select("id", "head").unionByName(heads).filter("id <> head").distinct(), "stars")

    def confirm(pairs: DataFrame) -> DataFrame:
        return confirmed(pairs.filter("a <> b").distinct(), nodes, docs, width, percent, key, text)

    links = confirm(stars.select(F.greatest("id", "head").alias("a"), F.least("id", "head").alias("b")))
    role = F.col("role")
    rows = written(rows.withColumnRenamed("id", "node").groupBy("hash", "node").agg(F.max(F.when(role < 4, role)).alias("whole"), F.max(F.when(role >= 4, role)).alias("cut")), "groups")
    several, of_ids = links_of_ids(signed, roots)
    if several is not None:
        links = links.unionByName(of_ids)
    found = components(links, "a", "b")
    for last in (False, True):
        mixed = mixed_groups(rows, found)
        if mixed.isEmpty():
            break
        links = confirm(across(merged(mixed), nodes, percent) if last else by_other_pivot(mixed))
        if not links.isEmpty():
            found = components(links, "a", "b", found=found)
    return labelled(signed, roots, found, several, key_of).drop("kept")


def mixed_groups(rows: DataFrame, found: DataFrame | None) -> DataFrame:
    """hash, node, role, component, main, n, alike: the rows of groups that hold several components, with the component most
    frequent there, the number of rows and a signature of the nodes, which groups of the same nodes have in common."""
    named_ = rows.withColumn("component", F.col("node")) if found is None else rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = named_.groupBy("hash", "component").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("alike"))
    main = sizes.groupBy("hash").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("m"), F.bit_xor("alike").alias("alike"))
    main = main.filter("k > 1").select("hash", "n", F.col("m.component").alias("main"), "alike")
    each = F.explode(F.filter(F.array("whole", "cut"), lambda r: r.isNotNull()))
    return written(named_.join(main, "hash").select("hash", "node", each.alias("role"), "component", "main", "n", "alike"), "mixed")


def merged(mixed: DataFrame) -> DataFrame:
    """mixed groups of the same nodes as one: each node has the larger of its roles there, so that no pair that is looked up
    in one of them is left out (some that aren't may come in). Near texts share many parts, and so many such groups."""
    whole, cut = F.max(F.when(F.col("role") < 4, F.col("role"))).alias("whole"), F.max(F.when(F.col("role") >= 4, F.col("role"))).alias("cut")
    one = mixed.groupBy("alike", "n", "main", "node", "component").agg(whole, cut)
    each = F.explode(F.filter(F.array("whole", "cut"), lambda r: r.isNotNull()))
    return one.select(F.xxhash64("alike", "n", "main").alias("hash"), "node", each.alias("role"), "component", "main", "n")


def by_other_pivot(mixed: DataFrame) -> DataFrame:
    """Each row of a mixed group with a whole part of another component, chosen by a hash that differs from group to group."""
    pivot = mixed.filter("role < 4").groupBy("hash").agg(F.min(F.struct(F.xxhash64("hash", "node").alias("h"), "node", "component", "role")).alias("p"))
    pairs = mixed.join(pivot, "hash").withColumn("_r", F.col("p.role")).filter((F.col("component") != F.col("p.component")) & looked_up("role", "_r"))
    return pairs.select(F.greatest("node", "p.node").alias("a"), F.least("node", "p.node").alias("b"))


def words_of(n: int) -> int:
    """Words of the sketches that sets of n shingles travel with: a bit or more for each shingle, 8 words at least."""
    return next((w for w in (8, 16) if 64 * w >= n), WORDS)


def folded(sketch: str, n: str) -> Column:
    """A sketch folded to words_of(n) words. A folded sketch is the same set's sketch of fewer bits, as each shingle still
    flips one, so two of them differ in no more bits than the sets in shingles."""
    out = F.col(sketch)
    for words in (16, 8):
        parts = [[F.get(sketch, F.lit(i)) for i in range(k, WORDS, words)] for k in range(words)]
        out = F.when(F.col(n) <= 64 * words, F.array(*(reduce(Column.bitwiseXOR, x) for x in parts))).otherwise(out)
    return out


def spread(sketches: pa.ListArray) -> np.ndarray:
    """Folded sketches as rows of WORDS words, those beyond their own 0."""
    cuts = sketches.offsets.to_numpy().astype(np.int64)
    flat = sketches.values.to_numpy().view(np.uint64)[cuts[0] : cuts[-1]]
    sizes = np.diff(cuts)
    out = np.zeros((len(sizes), WORDS), np.uint64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(cuts[:-1] - cuts[0], sizes)] = flat
    return out


def refolded(sketches: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(sketches.reshape(len(sketches), -1, words), axis=1)


def across(mixed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs of rows of different components that share a group and are looked up there, of which one is outside the
    group's main component, as far as their sizes and sketches let them be similar. Rows of a group are compared in numpy,
    those outside with BLOCK of all at a time; only pairs that pass become rows. Rows of a group of one block travel once, sketches folded by size; `confirmed` sifts
    the pairs again by whole ones."""
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    signed = mixed.join(nodes.select("node", folded("sketch", "n_shingles").alias("sketch"), "n_shingles"), "node").withColumn("parts", parts)
    columns = ["hash", "part", "place", "node", "component", "role", "n_shingles", "sketch"]
    outside, one = F.col("component") != F.col("main"), F.col("parts") == 1
    place = F.when(outside & one, BOTH).otherwise(INNER)
    every = signed.withColumns({"part": F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), "place": place}).select(columns)
    outer = signed.filter(outside & ~one).withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "place": F.lit(OUTER)}).select(columns)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, inner, both = None, [], []

        def unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
            return [*(batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5, 6)), spread(batch.column(7))]

        def passing(x: list[np.ndarray], y: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            step = max(1, (1 << 16) // len(y[0]))
            words = words_of(int(min(x[3].min(), y[3].min())))
            x, y = [*x[:4], refolded(x[4], words)], [*y[:4], refolded(y[4], words)]
            for at in range(0, len(x[0]), step):
                names, p, r, n, sk = (c[at : at + step] for c in x)
                unit = np.maximum.outer(r & 3, y[2] & 3)
                cuts = (r >= 4)[:, None].astype(int) + (y[2] >= 4)[None, :]
                asks = (cuts == 0) & (unit >= 1) | (cuts == 1) & (unit == 2)
                least, most = np.minimum.outer(n, y[3]), np.maximum.outer(n, y[3])
                i, j = np.nonzero(asks & (p[:, None] != y[1][None, :]) & (least * 100 >= most * percent))
                differ = np.bitwise_count(sk[i] ^ y[4][j]).sum(axis=1, dtype=np.int64)
                near = differ * (100 + percent) <= (n[i] + y[3][j]) * (100 - percent)
                a, b = names[i[near]], y[0][j[near]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

        def joined(rows: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
            return [[np.concatenate(c) for c in zip(*rows)]]

        for batch in batches:
            key = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], 1)
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else np.zeros(0, np.int64)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
                if tuple(key[a, :2]) != group:
                    if both:
                        yield from passing(joined(both)[0], joined(inner)[0])
                    group, inner, both = tuple(key[a, :2]), [], []
                rows = unpacked(batch.slice(a, b - a))
                if key[a, 2] != OUTER:
                    inner.append(rows)
                    both += [rows] if key[a, 2] == BOTH else []
                elif inner:  # rows of a part come before those that are compared with them
                    inner = joined(inner)
                    yield from passing(rows, inner[0])
        if both:
            yield from passing(joined(both)[0], joined(inner)[0])
        tidy()

    rows = every.unionByName(outer).repartition("hash", "part").sortWithinPartitions("hash", "part", "place")
    return rows.mapInArrow(compare, "a long, b long")


def op13_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), width=5, percent=80)
