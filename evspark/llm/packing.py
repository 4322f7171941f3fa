"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

Documents longer than the capacity are cut into pieces of that capacity; all other pieces are packed whole. Spark
tokenizes, counts lengths, numbers the pieces within each length and gives each its place. The driver holds the
histogram alone, whose size is bounded by the capacity: over it, multiplicative weights price sequence patterns by a
knapsack dynamic program, the fractional solution is rounded, what that leaves is solved again, and the last pieces are
placed best-fit decreasing by whole groups of equal sequences, so the driver's work doesn't depend on the number of pieces.

A null text counts as empty: its one piece is the end token. Rows with null or repeated doc_id are packed like any
other; texts of any length are encoded whole. Pieces that agree in doc_id, piece, length and checksum are
interchangeable. An empty table gives no rows. Columns other than the key and the text aren't read.
"""

from __future__ import annotations

import math
import uuid
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evspark.llm.common import named, table, tidy, with_made, written
from evspark.llm.tokens import Encoder

PIECE = "piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32 of each document's pieces; its ids are those of its text and then end_id. part
    names the task that cut them, local numbers its pieces of each length."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = Encoder.of(path), uuid.uuid4().int >> 65, [0] * (capacity + 1)
        for batch in batches:
            row, piece, length, crc, local = [], [], [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                ids = encoder.ids(value or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    row.append(i)
                    piece.append(k)
                    length.append(n)
                    crc.append(zlib.crc32(own))
                    local.append(seen[n])
                    seen[n] += 1
            pieces = np.array(piece, np.int64)
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(pieces, pa.int32()), pa.array(pieces * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int64()), pa.array(local, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [key, "piece", "start", "length", "ids_crc32", "part", "local"])

        tidy()

    return docs.select(named(key), named(text)).mapInArrow(cut, with_made(docs, [key], f"{PIECE}, part long, local long"))


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The value of the best multiset of sizes within each room up to capacity, and what it takes first: an index, -2 for
    a token left free or -1 for nothing. sizes must rise."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(sizes, np.arange(capacity + 1), "right").tolist()
    for room in range(int(sizes[0]), capacity + 1):
        n = fits[room]
        totals = best[room - sizes[:n]] + values[:n]
        k = int(totals.argmax())
        if best[room - 1] > totals[k]:
            best[room], took[room] = best[room - 1], -2
        else:
            best[room], took[room] = totals[k], k
    return best, took


def traced(sizes: list[int], took: list[int], room: int, used: list[bool]) -> dict[int, int] | None:
    """Index in sizes -> copies of the best multiset within room, or None if that holds a used size."""
    pattern: dict[int, int] = {}
    while room > 0 and took[room] != -1:
        k = took[room]
        if k == -2:
            room -= 1
            continue
        if used[k]:
            return None
        pattern[k] = pattern.get(k, 0) + 1
        room -= sizes[k]
    return pattern


def priced_patterns(sizes: np.ndarray, values: np.ndarray, capacity: int, within: float = 0.02) -> tuple[list[dict[int, int]], float]:
    """Patterns worth at least 1 - `within` of the best, no two of which share a size, and the best pattern's value.

    One dynamic program prices all: the best pattern that holds size k is k with the best of the room beside it.
    """
    best, took = knapsack(sizes, values, capacity)
    worth = values + best[capacity - sizes]
    found, used, plain, first = [], [False] * len(sizes), sizes.tolist(), took.tolist()
    for k in np.argsort(-worth, kind="stable").tolist():
        if worth[k] < (1 - within) * best[capacity]:
            break
        if used[k]:
            continue
        pattern = traced(plain, first, capacity - plain[k], used)
        if pattern is None:
            continue
        pattern[k] = pattern.get(k, 0) + 1
        for i in pattern:
            used[i] = True
        found.append(pattern)
    return found, float(best[capacity])


def best_fit_decreasing(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, times) of best-fit decreasing over a histogram. Sequences with equal contents are moved as one group."""
    by_room: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms: list[int] = []

    def put(pattern: dict[int, int], times: int, room: int) -> None:
        if not by_room.setdefault(room, []):
            insort(rooms, room)
        by_room[room].append((pattern, times))

    for k in np.argsort(-sizes, kind="stable").tolist():
        size, n = int(sizes[k]), int(counts[k])
        while n and (at := bisect_left(rooms, size)) < len(rooms):
            fit = rooms[at]
            pattern, times = by_room[fit].pop()
            if not by_room[fit]:
                del rooms[at]
            each = min(fit // size, max(n // times, 1))
            used = min(times, n // each)
            if used < times:
                put(pattern, times - used, fit)
            put(pattern | {k: pattern.get(k, 0) + each}, used, fit - each * size)
            n -= used * each
        if n:
            each = min(capacity // size, n)
            if n // each:
                put({k: each}, n // each, capacity - each * size)
            if n % each:
                put({k: n % each}, 1, capacity - n % each * size)
    return [(pattern, times) for group in by_room.values() for pattern, times in group]


def fractional(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, step: float = 0.1, rate: float = 3.0) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """How often to use each pattern so that the counts are covered evenly, by multiplicative weights on the covering
    program, and a bound from below on the sequences that the counts need.

    A length's weight falls exponentially with the share of its pieces that is covered so far; each round prices all
    lengths and uses every pattern found for `step` of what its scarcest length allows. Weights over the best pattern's
    value are a solution of the dual program, whose worth is the bound.
    """
    covered, bound = np.zeros(len(sizes)), 0.0
    found: dict[tuple[tuple[int, int], ...], float] = {}
    for _ in range(rounds):
        share = covered / counts
        worth = sizes * np.exp(-rate * (share - share.min()))
        patterns, value = priced_patterns(sizes, worth, capacity)
        bound = max(bound, float(counts @ worth) / value)
        for pattern in patterns:
            times = step * min(counts[k] / n for k, n in pattern.items())
            key = tuple(sorted(pattern.items()))
            found[key] = found.get(key, 0.0) + times
            for k, n in pattern.items():
                covered[k] += n * times
    mean = float((covered / counts).mean())
    return {p: x / mean for p, x in found.items()}, bound


def plan(histogram: dict[int, int], capacity: int, rounds: int = 20, levels: int = 8, seed: int = 0) -> list[tuple[dict[int, int], int]]:
    """(pattern of length -> copies, times): every piece of the histogram in sequences of at most capacity tokens.

    The configuration program's fractional solution is rounded at random, up or down with its fraction as probability, as
    far as pieces are there; what that leaves is solved and rounded again, until sequences and best-fit decreasing of the
    rest meet the bound or a level places nothing. Patterns that leave more free than the fullest by 0.5 % aren't used.
    Should best-fit decreasing alone need fewer sequences, it counts.
    """
    sizes, counts = (np.array(x, np.int64) for x in (list(histogram), list(histogram.values())))
    order = np.argsort(sizes)
    sizes, counts = sizes[order], counts[order]
    left, chosen, used, bound, rng = counts.copy(), [], 0, 0.0, np.random.default_rng(seed)

    def rest() -> list[tuple[dict[int, int], int]]:
        open_ = np.flatnonzero(left)
        return [({int(open_[k]): n for k, n in pattern.items()}, times) for pattern, times in best_fit_decreasing(sizes[open_], left[open_], capacity)]

    alone = placed = rest() if len(sizes) else []
    for level in range(levels):
        open_ = np.flatnonzero(left)
        if not len(open_) or level and used + sum(t for _, t in placed) <= math.ceil(bound - 1e-6):
            break
        solved, least = fractional(sizes[open_], left[open_], capacity, rounds)
        bound = bound if level else least
        fills = {p: sum(int(sizes[open_[k]]) * n for k, n in p) for p in solved}
        full, before = max(fills.values()), used
        every = [p for p in solved if fills[p] >= 0.995 * full]
        for i in rng.permutation(len(every)):
            times = min(int(solved[every[i]] + rng.random()), *(int(left[open_[k]]) // n for k, n in every[i]))
            if times:
                chosen.append(({int(open_[k]): n for k, n in every[i]}, times))
                used += times
                for k, n in every[i]:
                    left[open_[k]] -= n * times
        placed = rest()
        if used == before:
            break
    if sum(t for _, t in alone) < used + sum(t for _, t in placed):
        chosen, placed = [], alone
    return [({int(sizes[k]): n for k, n in pattern.items()}, times) for pattern, times in chosen + placed]


def slots(chosen: list[tuple[dict[int, int], int]], span: int) -> dict[str, np.ndarray]:
    """Segments of the pieces of each length, numbered from 0: from `key` = length * span + number on, `sequence` rises with the number at a fixed offset."""
    taken: dict[int, int] = {}
    base, out = 0, []
    for pattern, times in chosen:
        offset = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            for _ in range(copies):
                out.append((length * span + taken.get(length, 0), base, offset))
                taken[length] = taken.get(length, 0) + times
                offset += length
        base += times
    rows = np.array(sorted(out), np.int64).reshape(-1, 3)
    return {"key": rows[:, 0], "sequence": rows[:, 1], "offset": rows[:, 2]}


def numbered(pieces: DataFrame) -> DataFrame:
    """pieces with `number`: 0, 1, ... within each length. Tasks numbered their own pieces when they cut them; the numbers
    of a task and length are shifted by the pieces of that length of the tasks before it. No key has more rows than a task."""
    each = pieces.groupBy("part", "length").agg((F.max("local") + 1).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = each.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    return pieces.join(shift, ["part", "length"]).withColumn("number", F.col("local") + F.col("shift"))


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs."""
    pieces = written(token_pieces(docs, path, capacity, end_id, key, text), "pieces")
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    most = max(histogram.values(), default=0)
    span = most + 1
    at = docs.sparkSession.sparkContext.broadcast(slots(plan(histogram, capacity), span))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = at.value
        for batch in batches:
            k = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64) * span + batch.column("number").to_numpy(zero_copy_only=False)
            i = np.searchsorted(seg["key"], k, "right") - 1
            done = [pa.array(seg["sequence"][i] + k - seg["key"][i], pa.int64()), pa.array(seg["offset"][i], pa.int64())] if len(k) else [pa.array([], pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *done], [*names, "sequence_id", "offset"])

    names = [key, "piece", "start", "length", "ids_crc32"]
    return numbered(pieces).select(*map(named, names), "number").mapInArrow(place, with_made(docs, [key], f"{PIECE}, sequence_id long, offset long"))


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
