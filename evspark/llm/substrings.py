"""Removal of repeated byte strings of whole texts, by prefix-free parsing.

A byte belongs to a string of `least` bytes that also starts in a document with a smaller id: such bytes go. Strings are
judged on the input, and never cross documents.

The text is parsed at triggers that a rolling hash sets: the hash of a SEED-byte string triggers where it is the smallest
of a run of least - SEED + 1 starts, so every string of `least` bytes holds a trigger that depends on its bytes alone, and
equal strings are parsed at the same place. A phrase is a trigger with the bytes around it that such strings can reach.

Three rounds follow, each of which asks which keys of a chunk's texts other chunks have too. Keys are dealt by their own
hash, a chunk sends each key once, and the answer is a bit for each key sent, so no group grows with a trigger, a phrase
or a string that very many documents hold: it has at most one row for each chunk.

1. Phrases, with the chunk's smallest document: of an occurrence in a later document than the phrase's smallest, every
   byte goes.
2. Halves of what is left: a string of `least` bytes holds its trigger's right or left half, so phrases go on only where
   one of their halves lies in another document's phrase.
3. Strings of `least` bytes of those phrases, each at the first of its smallest triggers, with the chunk's smallest
   document: a string that starts in a later document goes.

Hashes stand in for the suffix arrays of the dictionary and of the parse: neither is made, strings have no order, and
equal 64-bit hashes in a part count as equal strings without a comparison of bytes.

Chunks of the input are copied to the shared folder once and parsed anew in each round, so that neither texts nor places
are ever shuffled: only hashes, and answers to them.

Null and empty texts have nothing to remove. Rows without id come after all others and don't count as smaller than each
other; rows that repeat an id don't remove each other's bytes. Texts of any length are parsed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.llm.common import Chunks, named, new_path, table, text_bytes, tidy, with_made, written
from evspark.llm.shingles import _BASE, _INVERSE, _power, mix, texts_of

#: Bytes of the string whose hash triggers.
SEED = 16
#: Text bytes of a chunk, and of a part of the dictionary, about.
CHUNK_BYTES, PART_BYTES = 2 << 20, 8 << 20
#: Text bytes that are hashed at a time.
BLOCK = 1 << 17

_LAST = np.iinfo(np.int64).max
ROUTED = "part long, chunk long, data binary"
ANSWERS = "chunk long, kind int, part long, data binary"


def pack(*columns: np.ndarray) -> bytes:
    return b"".join([np.int64(len(columns[0])).tobytes(), *(np.ascontiguousarray(c).tobytes() for c in columns)])


def unpack(data: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def deltas(x: np.ndarray) -> np.ndarray:
    """Small numbers for Spark's compression to find, undone by np.cumsum."""
    return np.diff(x, prepend=x.dtype.type(0))


def order_of(ids: pa.Array) -> np.ndarray:
    return ids.cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)


def column(rows: pa.Table, name: str) -> pa.Array:
    found = rows.column(name)
    return found.combine_chunks() if found.num_chunks != 1 else found.chunk(0)


def sliding(x: np.ndarray, n: int, f: np.ufunc) -> np.ndarray:
    """f over each run of n neighbours, by doubling."""
    width, out = 1, x
    while 2 * width <= n:
        out = f(out[:-width], out[width:])
        width *= 2
    return f(out[: len(out) - (n - width)], out[n - width :]) if n > width else out


class Parse:
    """Triggers of the texts data[cuts[i]:cuts[i+1]] and the hashes of their phrases."""

    def __init__(self, data: np.ndarray, cuts: np.ndarray, least: int):
        n, run = len(data), least - SEED
        self.text = self.place = np.zeros(0, np.int64)
        self.trigger = self.phrase = np.zeros(0, np.uint64)
        self.right = self.left = np.zeros(0, np.uint64)
        self.least, self.owner = least, np.zeros(0, np.int64)
        if n < least:
            return
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, "base", n + 1)[:n], out=total[1:])
        inverse = _power(_INVERSE, "inverse", n + 1)

        def of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (total[b] - total[a]) * inverse[a]

        grams = n - SEED + 1
        seeds = mix((total[SEED:] - total[:grams]) * inverse[:grams])
        rank = (seeds >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        least_of = sliding(rank, run + 1, np.minimum)  # one for each start of a string of `least` bytes
        ends = cuts[1:]
        bad = np.zeros(len(least_of) + 1, np.int32)  # starts whose string would cross into the next text
        np.add.at(bad, np.minimum(np.maximum(ends - least + 1, cuts[:-1]), len(least_of)), 1)
        np.add.at(bad, np.minimum(ends, len(least_of)), -1)
        least_of[np.cumsum(bad[:-1]) > 0] = 0
        padded = np.zeros(grams + run, np.uint32)
        padded[run : run + len(least_of)] = least_of
        place = np.flatnonzero(sliding(padded, run + 1, np.maximum)[:grams] == rank)
        self.text = np.searchsorted(cuts, place, "right") - 1
        low, high = cuts[self.text], cuts[self.text + 1]
        a, b = np.maximum(place - run, low), np.minimum(place + least, high)
        self.trigger = seeds[place]
        self.phrase = mix(of(a, b) + (place - a).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        half = SEED + (run + 1) // 2
        right, left = np.minimum(place + half, high), np.maximum(place + SEED - half, low)
        # hashes of the trigger with half of its surroundings; 0: there is no room
        self.right = np.where(place + half <= high, mix(of(place, right)) | np.uint64(1), np.uint64(0))
        self.left = np.where(place + SEED - half >= low, ~mix(of(left, place + SEED)) | np.uint64(1), np.uint64(0))
        self.place = place - low
        self.of, self.cuts, self.at, self.rank, self.valid = of, cuts, place, rank, least_of > 0

    def strings(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(trigger, hash, text, place) of the strings whose first smallest trigger is asked for."""
        if not asked.any():
            return self.trigger[:0], self.phrase[:0], self.text[:0], self.place[:0]
        keyed = self.rank.astype(np.uint64) << np.uint64(32) | np.arange(len(self.rank), dtype=np.uint64)
        owner = (sliding(keyed, self.least - SEED + 1, np.minimum) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        number = np.full(len(self.rank), -1)
        number[self.at[asked]] = np.flatnonzero(asked)
        start = np.flatnonzero(self.valid & (number[owner] >= 0))
        k = number[owner[start]]
        return self.trigger[k], self.of(start, start + self.least), self.text[k], start - self.cuts[self.text[k]]


def copied(docs: DataFrame, folder: str, text: str) -> DataFrame:
    """Copies docs to chunk files; a table of chunk."""

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, held, size, done = Chunks(folder), [], 0, []
        for batch in batches:
            cuts = texts_of(batch.column(batch.schema.get_field_index(text)))[1]
            at = 0
            while at < len(batch):
                to = min(len(batch), max(at + 1, int(np.searchsorted(cuts, cuts[at] + CHUNK_BYTES - size, "right")) - 1))
                held.append(batch.slice(at, to - at))
                size += int(cuts[to] - cuts[at])
                at = to
                if size >= CHUNK_BYTES or at < len(batch):
                    done.append(chunks.write(held, batch.schema))
                    held, size = [], 0
        if held:
            done.append(chunks.write(held, held[0].schema))
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], ["chunk"])

    return written(docs.mapInArrow(copy, "chunk long"), "chunks")


def runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(sorted_keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return np.flatnonzero(new)


def spread(first: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.append(first, n)))


def keyed(key: np.ndarray, trigger: np.ndarray) -> np.ndarray:
    """Keys by their own hash; the trigger, which equal keys share, adds bits to the key."""
    return mix(key ^ mix(trigger))


class Keys:
    """The distinct keys of a chunk by part and smallest document, and which of them each occurrence has.

    Keys are hashes that fill all 64 bits: their order deals them to parts, so one sort serves both."""

    def __init__(self, key: np.ndarray, doc: np.ndarray, parts: int):
        order = np.lexsort((doc, key))
        first = runs(key[order])
        size = np.diff(np.append(first, len(order)))
        found = order[first]
        name, least = key[found], doc[found]
        part = ((name >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        by = np.lexsort((name, least, part))
        place = np.empty(len(by), np.int32)
        place[by] = np.arange(len(by), dtype=np.int32)
        self.part, self.key, self.doc = part[by], name[by], least[by]
        self.of = np.empty(len(doc), np.int32)
        self.of[order] = np.repeat(place, size)
        #: occurrences in a later document of the chunk than the key's smallest
        self.later = doc > self.doc[self.of]
        begin = runs(self.part)
        self.cuts = list(zip(begin.tolist(), np.append(begin[1:], len(by)).astype(np.int64).tolist()))

    def sent(self, chunk: int, with_doc: bool) -> list[tuple[int, int, bytes]]:
        return [(int(self.part[a]), chunk, pack(self.key[a:b], deltas(self.doc[a:b])) if with_doc else pack(self.key[a:b].astype(np.uint32))) for a, b in self.cuts]

    def answered(self, answers: dict[int, bytes]) -> np.ndarray:
        """The answer for each occurrence."""
        out = np.zeros(len(self.key), bool)
        for a, b in self.cuts:
            data = answers.get(int(self.part[a]))
            if data is not None:
                out[a:b] = np.unpackbits(np.frombuffer(data, np.uint8), count=b - a).astype(bool)
        return out[self.of]


class Chunk:
    """The parse of a chunk and, as far as answers are there, what follows from them."""

    def __init__(self, folder: str, chunk: int, parts: int, least: int, key: str, text: str):
        self.chunk, self.parts, self.least = chunk, parts, least
        self.rows = Chunks(folder).read(chunk)
        self.data, self.cuts = texts_of(column(self.rows, text))
        self.order = order_of(column(self.rows, key))
        self.blocks, at = [], 0
        while at < len(self.order):
            to = max(at + 1, int(np.searchsorted(self.cuts, self.cuts[at] + BLOCK, "right")) - 1)
            self.blocks.append((at, to))
            at = to
        found = []
        for at, to in self.blocks:
            p = self.parse(at, to)
            found.append((p.trigger, p.phrase, p.right, p.left, (p.text + at).astype(np.int32), p.place.astype(np.int32)))
        self.n = [len(x[0]) for x in found]
        self.trigger, self.phrase, self.right, self.left, self.row, self.place = (np.concatenate(x) for x in zip(*found))
        self.doc = self.order[self.row]
        self.phrases = Keys(keyed(self.phrase, self.trigger), self.doc, parts)
        del self.phrase, self.trigger

    def parse(self, at: int, to: int) -> Parse:
        return Parse(self.data[self.cuts[at] : self.cuts[to]], self.cuts[at : to + 1] - self.cuts[at], self.least)

    def copies(self, answers: dict[int, dict[int, bytes]]) -> np.ndarray:
        """Which phrases lie in a later document than their smallest."""
        return self.phrases.later | self.phrases.answered(answers.get(PHRASES, {}))

    def halves(self, copies: np.ndarray) -> tuple[np.ndarray, Keys]:
        own = np.flatnonzero(~copies)
        side = np.concatenate([self.right[own], self.left[own]])
        some = np.flatnonzero(side)
        at, side = np.concatenate([own, own])[some], side[some]
        return at, Keys(mix(side), self.doc[at], self.parts)

    def asked(self, copies: np.ndarray, answers: dict[int, dict[int, bytes]]) -> np.ndarray:
        """Which phrases may share a string with another document's: they share a half."""
        at, halves = self.halves(copies)
        several = np.zeros(len(halves.key), bool)
        several[halves.of[halves.later]] = True
        out = np.zeros(len(self.doc), bool)
        out[at[several[halves.of] | halves.answered(answers.get(HALVES, {}))]] = True
        return out

    def strings(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, Keys]:
        """(row, place) of the asked phrases' strings, and their keys."""
        found, n = [], 0
        for (at, to), k in zip(self.blocks, self.n):
            if asked[n : n + k].any():
                trigger, key, of, place = self.parse(at, to).strings(asked[n : n + k])
                found.append((keyed(key, trigger), (of + at).astype(np.int32), place.astype(np.int32)))
            n += k
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32))
        key, row, place = (np.concatenate(x) for x in zip(none, *found))
        del found
        return row, place, Keys(key, self.order[row], 2 * self.parts)


#: What an answer is about.
PHRASES, HALVES, STRINGS, EVERY = 0, 1, 2, 9


def answers_of(rows: pa.Table) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for kind, part, data in zip(rows.column("kind").to_pylist(), rows.column("part").to_pylist(), rows.column("data").to_pylist()):
        out.setdefault(kind, {})[part] = data
    return out


def routed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["part", "chunk", "data"])


def ask_phrases(chunks: DataFrame, folder: str, parts: int, least: int, key: str, text: str) -> DataFrame:
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                rows = Chunk(folder, chunk, parts, least, key, text).phrases.sent(chunk, True)
                for a in range(0, len(rows), 64):
                    yield routed(rows[a : a + 64])
        tidy()

    return chunks.mapInArrow(ask, ROUTED)


def ask_halves(known: pa.Table, folder: str, parts: int, least: int, key: str, text: str) -> pa.Table:
    number = known.column("chunk")[0].as_py()
    chunk = Chunk(folder, number, parts, least, key, text)
    rows = chunk.halves(chunk.copies(answers_of(known)))[1].sent(number, False)
    del chunk
    tidy()
    return pa.Table.from_batches([routed(rows)])


def ask_strings(known: pa.Table, folder: str, parts: int, least: int, key: str, text: str) -> pa.Table:
    number, answers = known.column("chunk")[0].as_py(), answers_of(known)
    chunk = Chunk(folder, number, parts, least, key, text)
    rows = chunk.strings(chunk.asked(chunk.copies(answers), answers))[2].sent(number, True)
    del chunk
    tidy()
    return pa.Table.from_batches([routed(rows)])


def answer(part: pa.Table, kind: int) -> pa.Table:
    """For each key that a chunk sent: whether another chunk has it in a smaller document or, for halves, at all."""
    chunk, number = part.column("chunk").to_pylist(), part.column("part")[0].as_py()
    got = [unpack(d, ("u4",) if kind == HALVES else ("u8", "i8")) for d in part.column("data").to_pylist()]
    key = np.concatenate([x[0] for x in got])
    yes = np.empty(len(key), bool)
    if kind == HALVES:
        order = np.argsort(key, kind="stable")
        first = runs(key[order])
        yes[order] = spread(first, np.diff(np.append(first, len(key))) > 1, len(key))
    else:
        doc = np.concatenate([np.cumsum(x[1]) for x in got])
        order = np.lexsort((doc, key))
        first = runs(key[order])
        yes[order] = doc[order] > spread(first, doc[order][first], len(key))
    ends = np.cumsum([len(x[0]) for x in got]).tolist()
    out = [(c, np.packbits(yes[a:b]).tobytes()) for c, a, b in zip(chunk, [0, *ends], ends) if yes[a:b].any()]
    return pa.Table.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([kind] * len(out), pa.int32()), pa.array([number] * len(out), pa.int64()), pa.array([d for _, d in out], pa.binary())], ["chunk", "kind", "part", "data"])


def removed_bytes(known: pa.Table, folder: str, parts: int, least: int, key: str, text: str, keep: list[str]) -> pa.Table:
    """A chunk's rows with what is left of their texts."""
    number, answers = known.column("chunk")[0].as_py(), answers_of(known)
    chunk = Chunk(folder, number, parts, least, key, text)
    rows, data, cuts = chunk.rows, chunk.data, chunk.cuts
    size = np.diff(cuts)
    change = np.zeros(len(data) + 1, np.int32)
    copies = chunk.copies(answers)
    row, place, strings = chunk.strings(chunk.asked(copies, answers))
    later = strings.later | strings.answered(answers.get(STRINGS, {}))
    for row, a, b in ((chunk.row[copies], chunk.place[copies].astype(np.int64) - (least - SEED), chunk.place[copies].astype(np.int64) + least), (row[later], place[later].astype(np.int64), place[later].astype(np.int64) + least)):
        a, b = np.maximum(a, 0) + cuts[row], np.minimum(b, size[row]) + cuts[row]
        np.add.at(change, a, 1)
        np.add.at(change, b, -1)
    gone = np.cumsum(change[:-1]) > 0
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    inner = cuts[:-1][size > 0]
    begins[inner] = gone[inner]
    gone_to, begins_to = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, begins))
    left = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    whole = left
    if len(data) and data.max() >= 0x80:  # a character that keeps any of its bytes keeps all of them as text
        of = np.cumsum(data & 0xC0 != 0x80) - 1
        stays = np.bincount(of[~gone], minlength=int(of[-1]) + 1)[of] > 0
        whole = [data[a:b][stays[a:b]].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
    made = {
        "n_bytes": pa.array(size), "n_removed": pa.array(gone_to[cuts[1:]] - gone_to[cuts[:-1]]), "n_spans": pa.array(begins_to[cuts[1:]] - begins_to[cuts[:-1]]),
        "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in left]), "kept_text": pa.array([x.decode() for x in whole]),
    }
    kept = [column(rows, c) for c in keep]
    del chunk, rows, strings, row, place, later, copies, change, gone, begins, left, whole
    tidy()
    return pa.Table.from_arrays([*kept, *(x.cast(pa.int64()) if c.startswith("n_") else x for c, x in made.items())], [*keep, *made])


def without_repeats(docs: DataFrame, least: int = 50, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` (key, as a rule) of each row with n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the
    bytes that stay) and kept_text (those bytes as text; a character of which only some bytes would go stays whole)."""
    spark, keep = docs.sparkSession, keep or [key]
    folder = new_path(spark, "texts")
    parts = max(64, text_bytes(docs, text) // PART_BYTES)
    columns = list(dict.fromkeys([key, *keep, text]))
    chunks = copied(docs.select(*map(named, columns)), folder, text)
    n = max(1, chunks.count())
    given = (folder, parts, least, key, text)

    def answered(asked: DataFrame, kind: int) -> DataFrame:
        return asked.groupBy("part").applyInArrow(lambda t: answer(t, kind), ANSWERS)

    def by_chunk(rows: DataFrame):
        return rows.repartition(n, "chunk").groupBy("chunk")  # answers are small: their size says nothing of the work

    every = chunks.select("chunk", F.lit(EVERY).alias("kind"), F.lit(0).cast("long").alias("part"), F.lit(b"").alias("data"))
    known = every.unionByName(written(answered(ask_phrases(chunks.repartition(n), *given), PHRASES), "phrases"))
    known = known.unionByName(written(answered(by_chunk(known).applyInArrow(lambda t: ask_halves(t, *given), ROUTED), HALVES), "halves"))
    strings = answered(by_chunk(known).applyInArrow(lambda t: ask_strings(t, *given), ROUTED), STRINGS)
    schema = with_made(docs, keep, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return by_chunk(known.unionByName(strings)).applyInArrow(lambda t: removed_bytes(t, *given, keep), schema)


def op8_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("kept_text")
