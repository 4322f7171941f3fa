"""Rounding as the SQL rounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    """value to that many digits, halves away from zero, as DuckDB does it: value times a power of ten, both doubles, is what is
    rounded. (Spark's round takes the shortest decimal number that reads as the value, so 0.0653125 differs.)"""
    scale = float(10**digits)
    return F.round(value * scale) / scale
