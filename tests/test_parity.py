"""Every query that has SQL gives that SQL's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from evspark.plans import registry


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(df):
    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return "null"
        return f"{float(x):.9f}" if "float" in type(x).__name__ else str(x)

    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, data, duck, name):
    ours, theirs = registry.QUERIES[name](spark, data).toPandas(), duck.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows(ours), rows(theirs)
    assert len(a) == len(b) > 0
    off = [(x, y) for x, y in zip(a, b) if not all(p == q or abs(float(p) - float(q)) <= 1e-9 * max(1, abs(float(q))) for p, q in zip(x, y))]
    assert not off


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_others_run(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0
