"""Alignment of sequences: consecutive repeats, common prefixes, time warping, global alignment, assignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType


def without_consecutive_repeats(rows: DataFrame, by: str, order: str, state: str) -> DataFrame:
    """Rows whose state differs from that of the row before."""
    before = F.lag(state).over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != F.col(state))).drop("_before")


def common_prefix(pairs: DataFrame, by: str, position: str, a: str, b: str) -> DataFrame:
    """by, length: positions before the first at which a and b differ; all of them if none does."""
    differ = ~F.col(a).eqNullSafe(F.col(b))
    return pairs.groupBy(by).agg(F.coalesce(F.min(F.when(differ, F.col(position))), F.max(position) + 1).alias("length"))


def warped(a: np.ndarray, b: np.ndarray, band: int) -> float:
    """Dynamic time warping with absolute costs within a band about the diagonal; infinite against an empty sequence.

    A cell is entered from the row before, or along its own row; the second is a running minimum once the row's own costs
    are summed up.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0 if n == m else float("inf")
    band = max(band, abs(n - m))
    row = np.full(m + 1, np.inf)
    row[0] = 0.0
    for i in range(1, n + 1):
        low, high = max(1, i - band), min(m, i + band)
        cost = np.abs(a[i - 1] - b[low - 1 : high])
        run = np.cumsum(cost)
        new = np.full(m + 1, np.inf)
        new[low : high + 1] = run + np.minimum.accumulate(np.minimum(row[low : high + 1], row[low - 1 : high]) + cost - run)
        row = new
    return float(row[m])


@F.pandas_udf(DoubleType())
def dtw(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([warped(np.asarray(x, float), np.asarray(y, float), 5) for x, y in zip(a, b)])


def score_rows(a: list, b: list, gap: int, other: int, same: int) -> Iterator[np.ndarray]:
    """The rows of a global alignment's table of best scores, from that of no item of a on; gaps within a row are a running
    maximum."""
    steps = gap * np.arange(len(b) + 1)
    items = np.empty(len(b), object)
    items[:] = b
    row = steps
    yield row
    for i, x in enumerate(a, 1):
        entered = np.maximum(row[:-1] + np.where(items == x, same, other), row[1:] + gap)
        row = steps + np.maximum.accumulate(np.concatenate(([gap * i], entered)) - steps)
        yield row


def global_score(a: list, b: list, gap: int = -1, other: int = -1, same: int = 1) -> int:
    """Needleman-Wunsch score."""
    for row in score_rows(a, b, gap, other, same):
        pass
    return int(row[-1])


def alignment_columns(a: list, b: list, gap: int = -1, other: int = -1, same: int = 0) -> str:
    """The columns of a best global alignment: = equal, ~ different, a and b for items of one side only. Of equal scores,
    pairs go before items of a, and those before items of b, as seen from the end."""
    rows = list(score_rows(a, b, gap, other, same))
    i, j, out = len(a), len(b), []
    while i or j:
        paired = i and j and rows[i][j] == rows[i - 1][j - 1] + (same if a[i - 1] == b[j - 1] else other)
        if paired:
            out.append("=" if a[i - 1] == b[j - 1] else "~")
            i, j = i - 1, j - 1
        elif i and rows[i][j] == rows[i - 1][j] + gap:
            out.append("a")
            i -= 1
        else:
            out.append("b")
            j -= 1
    return "".join(reversed(out))


@F.pandas_udf(StringType())
def alignment(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alignment_columns(list(x), list(y)) for x, y in zip(a, b)])


def alike(a: np.ndarray, b: np.ndarray, magnitude: float = 10 / 17) -> float:
    """Likeness of two series in [0, 1]: of their values on one scale, and of their shapes in deviations from the mean. Two
    constant series have one shape, a constant and a varying one have none in common; an empty one is like nothing."""
    if not len(a) or not len(b):
        return 0.0
    longest, band = max(len(a), len(b)), max(4, abs(len(a) - len(b)))
    span = max(np.abs(a).max(), np.abs(b).max(), 1.0)
    sizes = 1 / (1 + warped(a / span, b / span, band) / longest)
    flat_a, flat_b = a.std() < 1e-9, b.std() < 1e-9
    if flat_a or flat_b:
        shapes = float(flat_a and flat_b)
    else:
        shapes = 1 / (1 + warped((a - a.mean()) / a.std(), (b - b.mean()) / b.std(), band) / longest)
    return float(magnitude * sizes + (1 - magnitude) * shapes)


@F.pandas_udf(DoubleType())
def series_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([alike(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(a, b)])


@F.pandas_udf(IntegerType())
def alignment_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([global_score(list(x), list(y)) for x, y in zip(a, b)])


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row in an assignment of the least total cost, rows <= columns: shortest augmenting paths with potentials."""
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    u, v, row_of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, way, done = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while row_of[j0]:
            done[j0] = True
            slack = cost[row_of[j0] - 1] - u[row_of[j0]] - v[1:]
            better = ~done[1:] & (slack < least[1:])
            least[1:][better], way[1:][better] = slack[better], j0
            j1 = int(np.where(done[1:], np.inf, least[1:]).argmin()) + 1
            delta = least[j1]
            u[row_of[done]] += delta
            v[done] -= delta
            least[~done] -= delta
            j0 = j1
        while j0:
            row_of[j0] = row_of[way[j0]]
            j0 = way[j0]
    out = np.zeros(n, int)
    out[row_of[1:][row_of[1:] > 0] - 1] = np.flatnonzero(row_of[1:] > 0)
    return out


def assigned(costs: DataFrame, by: str, row: str, column: str, cost: str) -> DataFrame:
    """by, row, column, cost of each group's least assignment; groups are small matrices given cell by cell."""
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index=row, columns=column, values=cost, aggfunc="min", fill_value=1e12).sort_index()
        k = assignment(m.to_numpy(float)) if len(m) <= m.shape[1] else None
        if k is None:
            raise ValueError("more rows than columns")
        return pd.DataFrame({by: pdf[by].iloc[0], row: m.index, column: m.columns[k], cost: m.to_numpy(float)[np.arange(len(m)), k]})

    kinds = ", ".join(f"`{c}` {costs.schema[c].dataType.simpleString()}" for c in (by, row, column)) + f", `{cost}` double"
    return costs.groupBy(by).applyInPandas(solve, kinds)
