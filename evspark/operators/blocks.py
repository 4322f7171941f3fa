"""Weighted postings as packed blocks of documents and parts of the vocabulary, and products with vectors of terms.

A block holds the postings of its documents as arrays, with its own numbers for its terms, in order of their part and spelling.
A part holds the terms that fall to it by hash, and for each block the places of the block's terms. A product sends each
block the vectors of its own terms, part by part, or parts a sum for each term of a block, so that what is sent grows with
the terms of blocks rather than with postings, and no task holds more than a block or a part. Columns of vectors are
multiplied a few at a time: vectors are a list of tables, of (block, a) or (part, a) with some of the columns each.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evspark.sources.stored import stored

#: Characters of text in a block, about, and the fewest blocks.
CHARS, FEWEST = 64_000_000, 8
#: Postings in a packed row.
PIECE = 1_000_000


class Blocks(NamedTuple):
    """matrix: packed rows (kind m: postings of some documents of a block; i: idf of a block's terms of a part). parts: a
    part's terms, their idf, and the places of each block's terms in it. n: blocks, as many as parts. pairs: terms of blocks,
    summed."""

    matrix: DataFrame
    parts: DataFrame
    n: int
    pairs: int


def _kinds(doc: str) -> str:
    return f"kind string, block int, part int, docs array<{doc}>, terms array<string>, a binary, b binary, c binary, blocks array<int>, routes array<binary>"


def _row(schema: pa.Schema, **values) -> pa.RecordBatch:
    """One row; arrays are its lists."""

    def column(field: pa.Field) -> pa.Array:
        value = values.get(field.name)
        if isinstance(value, pa.Array):
            return pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value).cast(field.type)
        return pa.array([value], field.type)

    return pa.RecordBatch.from_arrays([column(f) for f in schema], schema=schema)


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2^32, low bytes first, which compress better so."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


def _arrow(doc: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(_kinds(doc)))


def _values(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def packed(posting: DataFrame, n_docs: int, least_df: int, n: int, placed: bool) -> Blocks:
    """posting (doc, term, tf; no null docs) in n blocks and parts. placed: its rows already lie in n partitions by doc."""
    doc = posting.schema["doc"].dataType.simpleString()
    schema = _arrow(doc)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, known, codes, times, docs = TaskContext.get().partitionId(), {}, [], [], []
        for batch in batches:
            words = pc.dictionary_encode(batch.column("term"))
            own = np.array([known.setdefault(w, len(known)) for w in words.dictionary.to_pylist()], np.int32)
            codes.append(own[words.indices.to_numpy()])
            times.append(batch.column("tf").to_numpy().astype(np.uint32))
            docs.append(batch.column("doc"))
        if not known:
            return
        names = pc.dictionary_encode(pa.chunked_array(docs).combine_chunks())
        docs.clear()
        row, names = names.indices.to_numpy(), names.dictionary
        order = np.argsort(row, kind="stable")
        terms = pa.array(list(known), pa.string())
        parts = np.array([zlib.crc32(w.encode()) % n for w in known], np.int32)
        known.clear()
        rank = pc.sort_indices(pa.table({"p": parts, "t": terms}), sort_keys=[("p", "ascending"), ("t", "ascending")]).to_numpy()
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        idx, tf = place[np.concatenate(codes)][order], np.concatenate(times)[order]
        codes.clear(), times.clear()
        ends = np.cumsum(np.bincount(row, minlength=len(names)))
        counts = np.bincount(idx, minlength=len(rank)).astype("<i8")
        terms, parts = terms.take(pa.array(rank)), parts[rank]
        edges = np.searchsorted(parts, np.arange(n + 1))
        for p in np.unique(parts):
            low, high = int(edges[p]), int(edges[p + 1])
            yield _row(schema, kind="v", block=block, part=int(p), terms=terms.slice(low, high - low), a=counts[low:high].tobytes())
        first, piece = 0, 0
        while first < len(names):
            start = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, start + PIECE, "right")))
            size = np.diff(np.concatenate([[start], ends[first:last]]))
            yield _row(schema, kind="m", block=block, part=piece, docs=names.slice(first, last - first), a=size.astype("<i8").tobytes(), b=_planes(idx[start : ends[last - 1]]), c=_planes(tf[start : ends[last - 1]]))
            first, piece = last, piece + 1

    def part(rows: pa.Table) -> pa.Table:
        blocks, every = _values(rows, "block"), [pa.array(t, pa.string()) for t in _values(rows, "terms")]
        terms = pc.unique(pa.chunked_array(every)).sort()
        df, places = np.zeros(len(terms), np.int64), []
        for own, count in zip(every, _values(rows, "a")):
            places.append(pc.index_in(own, value_set=terms).to_numpy().astype("<i8"))
            df[places[-1]] += np.frombuffer(count, "<i8")
        idf = np.where(df >= least_df, np.log((1 + n_docs) / (1 + df)) + 1, 0.0)
        p = rows.column("part")[0].as_py()
        own = [_row(schema, kind="i", block=block, part=p, a=idf[at].tobytes()) for block, at in zip(blocks, places)]
        return pa.Table.from_batches([_row(schema, kind="p", part=p, terms=terms, a=idf.tobytes(), blocks=blocks, routes=[_planes(at) for at in places]), *own])

    first = stored((posting if placed else posting.repartition(n, "doc")).mapInArrow(pack, _kinds(doc)), "blocks")
    parts = stored(first.filter("kind = 'v'").groupBy("part").applyInArrow(part, _kinds(doc)), "parts")
    columns = ["kind", "block", "part", "docs", "a", "b", "c"]
    matrix = first.filter("kind = 'm'").select(*columns).unionByName(parts.filter("kind = 'i'").select(*columns))
    pairs = parts.filter("kind = 'i'").agg(F.coalesce(F.sum(F.length("a")), F.lit(0))).first()[0] // 8  # one row
    return Blocks(matrix, parts.filter("kind = 'p'").select("part", "terms", "a", "blocks", "routes"), n, pairs)


def terms_of(blocks: Blocks) -> DataFrame:
    """term, idf of terms with idf."""
    each = blocks.parts.select("terms", "a").mapInArrow(_each_idf, "terms array<string>, idf array<double>")
    return each.select(F.explode(F.arrays_zip("terms", "idf")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.idf").alias("idf")).filter("idf > 0")


def _each_idf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            idf = pa.array([np.frombuffer(batch.column("a")[i].as_py(), float)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("terms").slice(i, 1), idf], ["terms", "idf"])


#: Vectors of a part's terms, with where they go.
VECTORS = "part int, a binary, blocks array<int>, routes array<binary>"


def vectors(blocks: Blocks, of: Callable[[Column], Column]) -> DataFrame:
    """Vectors of all terms; of: a term's vector as an array of doubles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = [np.asarray(x.values).tobytes() for x in batch.column("a")]
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(a, pa.binary()), batch.column("blocks"), batch.column("routes")], ["part", "a", "blocks", "routes"])

    rows = blocks.parts.select("part", F.flatten(F.transform("terms", of)).alias("a"), "blocks", "routes")
    return rows.mapInArrow(pack, VECTORS)


def _of(table: pa.Table, kind: str) -> list[int]:
    return [i for i, k in enumerate(_values(table, "kind")) if k == kind]


def _matrix(a: pa.ChunkedArray, i: int, width: int) -> np.ndarray:
    return np.frombuffer(a[i].as_buffer(), float).reshape(-1, width)


def _pieces(table: pa.Table) -> tuple[list[tuple[int, int]], list[tuple]]:
    """Of a block's rows: its parts with their numbers of terms; of each piece in order: its row, sizes, places and weights of
    unit length, and which documents have one."""
    part, a = _values(table, "part"), table.column("a")
    own = sorted((part[i], i) for i in _of(table, "i"))
    idf = np.concatenate([np.frombuffer(a[i].as_py(), float) for _, i in own])

    def pieces() -> Iterator[tuple]:
        for _, i in sorted((part[i], i) for i in _of(table, "m")):
            size = np.frombuffer(a[i].as_py(), "<i8")
            idx, tf = _numbers(table.column("b")[i].as_py()), _numbers(table.column("c")[i].as_py())
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])  # every document has postings
            w = (1 + np.log(tf)) * idf[idx]
            norm = np.sqrt(np.add.reduceat(w * w, starts))
            w /= np.repeat(np.where(norm > 0, norm, 1.0), size)
            yield size, idx, w, starts, norm > 0

    return [(p, len(a[i].as_py()) // 8) for p, i in own], pieces()


def _beside(table: pa.Table, widths: list[int], kind: str = "x") -> np.ndarray:
    """The slices of vectors in a table, side by side."""
    number = _values(table, "slice")
    own = sorted((number[i], i) for i in _of(table, kind))
    return np.hstack([_matrix(table.column("a"), i, widths[k]) for k, i in own])


def _sliced(slices: list[DataFrame], kind: str, *columns: str) -> DataFrame:
    rows = [df.select(F.lit(kind).alias("kind"), F.lit(k).alias("slice"), "a", *columns) for k, df in enumerate(slices)]
    return reduce(DataFrame.unionByName, rows)


def to_documents(blocks: Blocks, x: DataFrame, width: int) -> DataFrame:
    """block, a, known: the weights times vectors of terms, and which documents have a weight."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own, part = _matrix(batch.column("a"), i, width), batch.column("part")[i].as_py()
                for block, at in zip(batch.column("blocks")[i].as_py(), batch.column("routes")[i].as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array(["x"]), pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([own[_numbers(at)].tobytes()], pa.binary())], ["kind", "block", "part", "a"])

    def multiply(table: pa.Table) -> pa.Table:
        (parts, pieces), number = _pieces(table), _values(table, "part")
        local, end = np.empty((width, sum(n for _, n in parts))), 0
        for _, i in sorted((number[i], i) for i in _of(table, "x")):
            own = _matrix(table.column("a"), i, width)
            local[:, end : end + len(own)] = own.T
            end += len(own)
        out, known = [], []
        for _, idx, w, starts, has in pieces:
            out.append(np.stack([np.add.reduceat(w * column[idx], starts) for column in local], 1))
            known.append(has)
        block = table.column("block")[0].as_py()
        return pa.table({"block": pa.array([block], pa.int32()), "a": pa.array([np.vstack(out).tobytes()], pa.binary()), "known": pa.array([np.concatenate(known).tobytes()], pa.binary())})

    rows = blocks.matrix.drop("docs").unionByName(x.mapInArrow(send, "kind string, block int, part int, a binary"), allowMissingColumns=True)
    return rows.groupBy("block").applyInArrow(multiply, "block int, a binary, known binary")


def to_terms(blocks: Blocks, y: list[DataFrame], widths: list[int], turn: np.ndarray) -> DataFrame:
    """Vectors of terms: the transposed weights times the vectors of documents times `turn`."""
    width = turn.shape[1]

    def multiply(table: pa.Table) -> pa.Table:
        (parts, pieces), x, at = _pieces(table), _beside(table, widths) @ turn, 0
        out = np.zeros((width, sum(n for _, n in parts)))
        for size, idx, w, _, _ in pieces:
            for j in range(width):
                out[j] += np.bincount(idx, w * np.repeat(x[at : at + len(size), j], size), out.shape[1])
            at += len(size)
        ends, block = np.cumsum([0, *(n for _, n in parts)]), table.column("block")[0].as_py()
        sums = [np.ascontiguousarray(out[:, ends[k] : ends[k + 1]].T).tobytes() for k in range(len(parts))]
        return pa.table({"kind": pa.array(["y"] * len(parts)), "block": pa.array([block] * len(parts), pa.int32()), "part": pa.array([p for p, _ in parts], pa.int32()), "a": pa.array(sums, pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        own, block = _of(table, "p")[0], _values(table, "block")
        names, routes = (table.column(c)[own].as_py() for c in ("blocks", "routes"))
        places = {b: _numbers(at) for b, at in zip(names, routes)}
        total = np.zeros((1 + max(p.max() for p in places.values()), width))
        for b, i in sorted((block[i], i) for i in _of(table, "y")):
            total[places[b]] += _matrix(table.column("a"), i, width)
        kept = table.slice(own, 1)
        return pa.table({"part": kept.column("part"), "a": pa.array([total.tobytes()], pa.binary()), "blocks": kept.column("blocks"), "routes": kept.column("routes")})

    rows = blocks.matrix.drop("docs").unionByName(_sliced(y, "x", "block"), allowMissingColumns=True)
    sums = rows.groupBy("block").applyInArrow(multiply, "kind string, block int, part int, a binary")
    both = blocks.parts.select(F.lit("p").alias("kind"), "part", "blocks", "routes").unionByName(sums, allowMissingColumns=True)
    return both.groupBy("part").applyInArrow(gather, VECTORS)


def inner(x: list[DataFrame], x_widths: list[int], turn: np.ndarray, y: list[DataFrame], y_widths: list[int]) -> np.ndarray:
    """Inner products of the columns of x times `turn` with those of y, both vectors of documents, summed over blocks."""

    def part(table: pa.Table) -> pa.Table:
        product = (_beside(table, x_widths, "x") @ turn).T @ _beside(table, y_widths, "y")
        return pa.table({"g": pa.array([product.tobytes()], pa.binary())})

    rows = _sliced(x, "x", "block").unionByName(_sliced(y, "y", "block")).groupBy("block").applyInArrow(part, "g binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(turn.shape[1] * sum(y_widths))
        for batch in batches:
            for g in batch.column("g"):
                total += np.frombuffer(g.as_py(), float)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["g"])

    return sum(np.frombuffer(r.g, float) for r in rows.mapInArrow(add, "g binary").collect()).reshape(turn.shape[1], -1)  # a row for each task


def of_documents(blocks: Blocks, y: list[DataFrame], widths: list[int], turn: np.ndarray, names: list[str]) -> DataFrame:
    """doc and the vectors of documents times `turn` as columns, of documents that have a weight."""
    doc = blocks.matrix.schema["docs"].dataType.elementType.simpleString()

    def rows(table: pa.Table) -> pa.Table:
        x, number = _beside(table, widths) @ turn, _values(table, "part")
        known = next(k for k in _values(table, "known") if k is not None)
        docs = pa.chunked_array([table.column("docs")[i].values for _, i in sorted((number[i], i) for i in _of(table, "m"))])
        return pa.table([docs, *(pa.array(np.ascontiguousarray(x[:, j])) for j in range(len(names)))], names=["doc", *names]).filter(pa.array(np.frombuffer(known, bool)))

    own = blocks.matrix.filter("kind = 'm'").select("kind", "block", "part", "docs")
    slices = _sliced(y[:1], "x", "block", "known")
    if len(y) > 1:
        slices = slices.unionByName(_sliced(y, "x", "block").filter("slice > 0"), allowMissingColumns=True)
    return own.unionByName(slices, allowMissingColumns=True).groupBy("block").applyInArrow(rows, f"doc {doc}, " + ", ".join(f"{c} double" for c in names))


def of_terms(blocks: Blocks, x: list[DataFrame], widths: list[int], turn: np.ndarray, names: list[str]) -> DataFrame:
    """term and its vector times `turn` as columns, of terms with idf."""

    def rows(table: pa.Table) -> pa.Table:
        own, vector = _of(table, "p")[0], _beside(table, widths) @ turn
        terms, idf = table.column("terms")[own].values, np.frombuffer(table.column("a")[own].as_py(), float)
        return pa.table([terms, *(pa.array(np.ascontiguousarray(vector[:, j])) for j in range(len(names)))], names=["term", *names]).filter(pa.array(idf > 0))

    both = blocks.parts.select(F.lit("p").alias("kind"), "part", "terms", "a").unionByName(_sliced(x, "x", "part"), allowMissingColumns=True)
    return both.groupBy("part").applyInArrow(rows, "term string, " + ", ".join(f"{c} double" for c in names))
