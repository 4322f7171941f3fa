"""Selections that are the same in every run: stable numbers, exact samples, interleaving, most common values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evspark.operators.statistics import with_sum_before


def stable_unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone: the first 52 bits of their hash."""
    digest = F.md5(F.concat_ws("\x1f", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def sampled(rows: DataFrame, by: list[str], key: str, k: int, seed: str) -> DataFrame:
    """k rows of each group, all if it has fewer, by the stable numbers of their keys; the k best of each task go on first."""
    order = Window.partitionBy(*by).orderBy(stable_unit(F.lit(seed), F.col(key)), key)
    return rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def interleaved(ranked: DataFrame, source: str, turn: str) -> DataFrame:
    """ranked lists with their rows' place when the lists take turns, numbered range by range. Nulls come first; rows of one
    list and turn, which should be one, get places of their own in any order."""
    numbered = with_sum_before(ranked.withColumns({"_turn": F.struct(turn, source), "_one": F.lit(1)}), [], "_turn", "_one")
    return numbered.select(*ranked.columns, (F.col("before") + 1).cast("int").alias("place"))


def most_common(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, value, n of the value that a group has most often; ties go to the smaller."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("m"), value)).alias("b"))
    return best.select(by, F.col(f"b.{value}").alias(value), (-F.col("b.m")).alias("n"))


def first_seen(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """by, seen: a group's distinct values, which should be few, in the order of their first appearance."""
    firsts = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.min(order).alias("o"))
    seen = F.array_sort(F.collect_list(F.struct("o", F.col(value).alias("v"))))
    return firsts.groupBy(by).agg(F.transform(seen, lambda x: x["v"]).alias("seen"))
