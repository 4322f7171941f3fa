"""Queries of study roll-ups and of the joins, set operations and groupings they rest on, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evspark.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return register


@query("rates_rollup", "SELECT coalesce(event_type, '*') AS event_type, count(*) AS n, round(avg(CASE WHEN value > 100 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM events GROUP BY ROLLUP (event_type)")
def rates_rollup(spark, d):
    rolled = table(spark, d, "events").rollup("event_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") > 100).cast("double")), 6).alias("rate"))
    return rolled.withColumn("event_type", F.coalesce("event_type", F.lit("*")))


@query("grouping_cube", "SELECT coalesce(l_returnflag, '*') AS l_returnflag, coalesce(l_linestatus, '*') AS l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_cube(spark, d):
    cube = table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    return cube.withColumns({c: F.coalesce(c, F.lit("*")) for c in ("l_returnflag", "l_linestatus")})


@query("stratified_arms", "SELECT c_custkey, c_mktsegment, CAST((row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1) % 3 AS INTEGER) AS arm FROM customer")
def stratified_arms(spark, d):
    """Dealt round-robin over all strata in order, though each stratum is numbered apart and shifted by those before it."""
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    sizes = rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    before = sizes.select("c_mktsegment", F.coalesce(F.sum("n").over(Window.orderBy("c_mktsegment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    own = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy("c_custkey")) - 1
    return rows.withColumn("k", own).join(before, "c_mktsegment").select("c_custkey", "c_mktsegment", ((F.col("k") + F.col("shift")) % 3).cast("int").alias("arm"))


@query("attempt_diff", """WITH h AS (SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, list_distinct(list(event_type)) AS h FROM events GROUP BY ALL), p AS (SELECT *, lag(h) OVER (PARTITION BY user_id ORDER BY day) AS b FROM h)
SELECT user_id, day, CAST(len(b) - len(list_intersect(h, b)) AS INTEGER) AS resolved, CAST(len(list_intersect(h, b)) AS INTEGER) AS persists, CAST(len(h) - len(list_intersect(h, b)) AS INTEGER) AS new FROM p WHERE b IS NOT NULL""")
def attempt_diff(spark, d):
    h = table(spark, d, "events").groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.collect_set("event_type").alias("h"))
    p = h.withColumn("b", F.lag("h").over(Window.partitionBy("user_id").orderBy("day"))).filter("b IS NOT NULL")
    return p.select("user_id", "day", F.size(F.array_except("b", "h")).alias("resolved"), F.size(F.array_intersect("h", "b")).alias("persists"), F.size(F.array_except("h", "b")).alias("new"))


@query("file_collapse", "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_returned, bool_and(l_quantity > 5) AS all_large, count(*) AS n, arg_min(l_linestatus, l_linenumber * 1000000 + l_partkey) AS first_status FROM lineitem GROUP BY 1")
def file_collapse(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.bool_and(F.col("l_quantity") > 5).alias("all_large"), F.count("*").alias("n"), F.min_by("l_linestatus", F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("first_status"))


@query("json_props", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_props(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("band_join", "SELECT a.event_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts - INTERVAL 6 HOUR AND a.ts + INTERVAL 6 HOUR GROUP BY 1")
def band_join(spark, d):
    """Rows of one user within six hours: an equi-join on user and six-hour bucket, each row meeting its neighbours' buckets."""
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("bucket", F.floor(F.col("t") / (6 * 3600 * 1_000_000)))
    a = e.filter("event_type = 'error'").select("user_id", "event_id", F.col("t").alias("ta"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    b = e.filter("event_type = 'purchase'").select("user_id", "bucket", F.col("t").alias("tb"))
    return a.join(b, ["user_id", "bucket"]).filter(F.abs(F.col("ta") - F.col("tb")) <= 6 * 3600 * 1_000_000).groupBy("event_id").agg(F.count("*").alias("n"))


@query("semi_anti", "SELECT n_name, (SELECT count(*) FROM customer c WHERE c_nationkey = n_nationkey AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS with_orders, (SELECT count(*) FROM customer c WHERE c_nationkey = n_nationkey AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS without FROM nation")
def semi_anti(spark, d):
    customers, orders = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    parts = [customers.join(orders, "c_custkey", how).groupBy("c_nationkey").agg(F.count("*").alias(name)) for how, name in (("left_semi", "with_orders"), ("left_anti", "without"))]
    nations = table(spark, d, "nation").select("n_name", F.col("n_nationkey").alias("c_nationkey"))
    return nations.join(parts[0], "c_nationkey", "left").join(parts[1], "c_nationkey", "left").select("n_name", F.coalesce("with_orders", F.lit(0)).alias("with_orders"), F.coalesce("without", F.lit(0)).alias("without"))


@query("set_ops", "WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45) SELECT 'union' AS op, count(*) AS n FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)")
def set_ops(spark, d):
    rows = table(spark, d, "lineitem")
    a, b = (rows.filter(c).select(F.col("l_partkey").alias("k")) for c in ("l_returnflag = 'R'", "l_quantity > 45"))
    parts = [(name, df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")) for name, df in (("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.subtract(b)))]
    return parts[0][1].unionByName(parts[1][1]).unionByName(parts[2][1])


@query("full_outer", "SELECT coalesce(a.k, b.k) AS k, coalesce(na, 0) AS n_supplied, coalesce(nb, 0) AS n_customers FROM (SELECT s_nationkey AS k, count(*) AS na FROM supplier GROUP BY 1) a FULL JOIN (SELECT c_nationkey AS k, count(*) AS nb FROM customer GROUP BY 1) b ON a.k = b.k")
def full_outer(spark, d):
    a = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("na"))
    b = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("nb"))
    return a.join(b, "k", "full").select("k", F.coalesce("na", F.lit(0)).alias("n_supplied"), F.coalesce("nb", F.lit(0)).alias("n_customers"))
