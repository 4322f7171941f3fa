"""Queries of evidence, graphs, learners, sequences and streams, each with the SQL that it is compared with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from evspark.operators import evidence as E
from evspark.operators import graphs as G
from evspark.operators import learners as L
from evspark.operators import sequences as Q
from evspark.sources.tables import events_utc, table
from evspark.streaming import events as V

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


MASSES = """s AS (SELECT user_id AS g, event_type AS src, event_id % 4 AS h, max(value) / 500 AS score FROM events WHERE value IS NOT NULL GROUP BY ALL),
m AS (SELECT g, src, h, score * least(1.0::DOUBLE, 0.98::DOUBLE / sum(score) OVER (PARTITION BY g, src)) * 0.86::DOUBLE AS mass FROM s WHERE score > 0), t AS (SELECT *, 1 - sum(mass) OVER (PARTITION BY g, src) AS theta FROM m)"""


def _scores(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type", (F.col("event_id") % 4).alias("h")).agg((F.max("value") / 500).alias("score"))


def _masses(spark, d):
    return E.discounted(_scores(spark, d), "user_id", "event_type", "h", "score", 0.86)


@query("evidence_mass", f"WITH {MASSES} SELECT g AS user_id, src AS event_type, h, round(mass, 6) AS mass, round(theta, 6) AS theta FROM t")
def evidence_mass(spark, d):
    return _masses(spark, d).withColumns({"mass": F.round("mass", 6), "theta": F.round("theta", 6)})


@query("ds_belief", f"""WITH {MASSES}, th AS (SELECT g, src, max(theta) AS theta FROM t GROUP BY ALL), hs AS (SELECT DISTINCT g, h FROM t), q AS (SELECT hs.g, hs.h, product(coalesce(mass, 0) + th.theta) AS q FROM hs JOIN th ON th.g = hs.g LEFT JOIN t ON t.g = hs.g AND t.h = hs.h AND t.src = th.src GROUP BY ALL),
w AS (SELECT g, product(theta) AS w FROM th GROUP BY g), z AS (SELECT q.g, sum(q - w) + any_value(w) AS z FROM q JOIN w ON q.g = w.g GROUP BY q.g)
SELECT q.g AS user_id, q.h, round((q - w) / z, 6) AS belief, round(w / z, 6) AS theta FROM q JOIN w ON q.g = w.g JOIN z ON q.g = z.g""")
def ds_belief(spark, d):
    return E.dempster(_masses(spark, d), "user_id", "event_type", "h").withColumns({"belief": F.round("belief", 6), "theta": F.round("theta", 6)})


CONFLICT = f"""{MASSES}, o AS (SELECT g, src, list_transform(range(4), lambda j: coalesce(list_sum(list_filter(list_transform(l, lambda x: CASE WHEN x.h = j THEN x.mass END), lambda v: v IS NOT NULL)), 0)::DOUBLE) AS m, theta AS t, row_number() OVER (PARTITION BY g ORDER BY src) AS i FROM (SELECT g, src, list({{'h': h, 'mass': mass}}) AS l, max(theta) AS theta FROM t GROUP BY g, src)),
w(g, i, m, t, k) AS (SELECT DISTINCT g, CAST(0 AS BIGINT), [0.0::DOUBLE, 0, 0, 0], 1.0::DOUBLE, 0.0::DOUBLE FROM o UNION ALL SELECT g, i + 1, list_transform(range(1, 5), lambda j: (m[j] * m2[j] + m[j] * t2 + t * m2[j]) / (1 - c)), t * t2 / (1 - c), greatest(k, c) FROM (SELECT w.g, w.i, w.m, w.t, w.k, o.m AS m2, o.t AS t2, list_sum(w.m) * list_sum(o.m) - list_inner_product(w.m, o.m) AS c FROM w JOIN o ON o.g = w.g AND o.i = w.i + 1))
SELECT g AS user_id, round(max(k), 6) AS conflict FROM w GROUP BY g"""


@query("ds_max_conflict", f"WITH RECURSIVE {CONFLICT}")
def ds_max_conflict(spark, d):
    return E.max_conflict(_masses(spark, d), "user_id", "event_type", "h", [0, 1, 2, 3]).withColumn("conflict", F.round("conflict", 6))


@query("fusion_ablation", "SELECT user_id, max(value / 500) AS largest, round(avg(value / 500), 6) AS mean, round(1 - product(1 - value / 500), 6) AS noisy_or FROM events GROUP BY 1")
def fusion_ablation(spark, d):
    out = E.combined(table(spark, d, "events"), ["user_id"], F.col("value") / 500)
    return out.withColumns({"mean": F.round("mean", 6), "noisy_or": F.round("noisy_or", 6)})


@query("ranked_hits", "SELECT user_id, event_id, event_type, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'click', value DESC, event_type, event_id) AS rank FROM events WHERE value >= 110) WHERE rank <= 5")
def ranked_hits(spark, d):
    order = Window.partitionBy("user_id").orderBy(F.col("event_type") == "click", F.desc("value"), "event_type", "event_id")
    return table(spark, d, "events").filter("value >= 110").withColumn("rank", F.row_number().over(order)).filter("rank <= 5").select("user_id", "event_id", "event_type", "value", "rank")


EDGES = "e AS (SELECT DISTINCT p_partkey AS child, unnest([p_partkey // 2, p_partkey // 3]) AS parent FROM part WHERE p_partkey >= 1)"


def _edges(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").filter("p_partkey >= 1").select(k.alias("child"), F.explode(F.array(F.floor(k / 2).cast("long"), F.floor(k / 3).cast("long"))).alias("parent")).distinct()


@query("graph_closure", f"WITH RECURSIVE {EDGES}, w(src, dst, depth) AS (SELECT child, parent, 1 FROM e UNION SELECT w.src, e.parent, w.depth + 1 FROM w JOIN e ON w.dst = e.child) SELECT src, dst, CAST(min(depth) AS INTEGER) AS shortest, CAST(max(depth) AS INTEGER) AS longest FROM w GROUP BY ALL")
def graph_closure(spark, d):
    return G.closure(_edges(spark, d))


@query("ppr_blame", f"""WITH RECURSIVE {EDGES}, k AS (SELECT child, count(*) AS k FROM e GROUP BY 1), w(node, mass) AS (SELECT p_partkey, p_size / 100.0::DOUBLE FROM part WHERE p_size > 45 UNION ALL SELECT e.parent, w.mass * 0.62::DOUBLE / k.k FROM w JOIN e ON w.node = e.child JOIN k ON k.child = e.child)
SELECT node, round(sum(mass) / (SELECT sum(mass) FROM w), 6) AS mass FROM w GROUP BY node HAVING sum(mass) / (SELECT sum(mass) FROM w) > 1e-9""")
def ppr_blame(spark, d):
    seeds = table(spark, d, "part").filter("p_size > 45").select(F.col("p_partkey").alias("node"), (F.col("p_size") / 100).alias("mass"))
    return G.blame(_edges(spark, d), seeds).withColumn("mass", F.round("mass", 6))


@query("deficiency_frontier", f"WITH {EDGES}, n AS (SELECT p_partkey AS node, p_size / 50.0::DOUBLE AS p FROM part) SELECT node, p FROM n WHERE p < 0.62 AND NOT EXISTS (SELECT 1 FROM e JOIN n m ON m.node = e.parent WHERE e.child = n.node AND m.p < 0.62)")
def deficiency_frontier(spark, d):
    return G.frontier(table(spark, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") / 50).alias("p")), _edges(spark, d))


@query("mastery_regularise", f"WITH RECURSIVE {EDGES}, w(src, dst, depth) AS (SELECT child, parent, 1 FROM e UNION SELECT w.src, e.parent, w.depth + 1 FROM w JOIN e ON w.dst = e.child), n AS (SELECT p_partkey AS node, p_size / 50.0::DOUBLE AS p FROM part) SELECT node, round(min(p), 6) AS p FROM (SELECT node, p FROM n UNION ALL SELECT src, 1 - power(0.55::DOUBLE, depth) * (1 - n.p) FROM w JOIN n ON n.node = w.dst) GROUP BY node")
def mastery_regularise(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") / 50).alias("p"))
    return G.regularised(nodes, _edges(spark, d)).withColumn("p", F.round("p", 6))


TRACE = """o AS (SELECT user_id, event_type = 'purchase' AS c, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type IN ('purchase', 'error')),
w(user_id, i, p) AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT), 0.30::DOUBLE FROM o UNION ALL SELECT w.user_id, w.i + 1, greatest(0.001::DOUBLE, least(0.999::DOUBLE, CASE WHEN c THEN p * 0.9 / (p * 0.9 + (1 - p) * 0.2) + (1 - p * 0.9 / (p * 0.9 + (1 - p) * 0.2)) * 0.2 ELSE p * 0.1 / (p * 0.1 + (1 - p) * 0.8) END)) FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)
SELECT user_id, round(arg_max(p, i), 6) AS mastery, max(i) AS n FROM w GROUP BY user_id"""


@query("bkt_mastery", f"WITH RECURSIVE {TRACE}")
def bkt_mastery(spark, d):
    answers = table(spark, d, "events").filter(F.col("event_type").isin("purchase", "error")).select("user_id", "event_id", (F.col("event_type") == "purchase").alias("correct"))
    return L.traced(answers, "user_id", "event_id", "correct").withColumn("mastery", F.round("mastery", 6))


P3 = "(0.2::DOUBLE + 0.8::DOUBLE / (1 + exp(-1.2::DOUBLE * (0.5::DOUBLE - (p_size - 25) / 10.0::DOUBLE))))"


@query("irt_3pl", f"WITH p AS (SELECT p_partkey, {P3} AS p FROM part) SELECT p_partkey, round(p, 6) AS p, round(1.2::DOUBLE * 1.2 * (1 - p) / p * power((p - 0.2) / 0.8, 2), 6) AS info, round(CASE WHEN p < 0.45 THEN power(p / 0.45, 2) WHEN p > 0.85 THEN power((1 - p) / 0.15, 2) ELSE 1.0 END, 6) AS band FROM p")
def irt_3pl(spark, d):
    item = (F.lit(0.5), (F.col("p_size") - 25) / 10, F.lit(1.2), 0.2)
    p = L.response(*item)
    return table(spark, d, "part").select("p_partkey", F.round(p, 6).alias("p"), F.round(L.information(*item), 6).alias("info"), F.round(L.band_weight(p), 6).alias("band"))


@query("abilities", """WITH a AS (SELECT user_id, (event_id % 9 - 4) / 2.0::DOUBLE AS b, event_type = 'purchase' AS c FROM events), g AS (SELECT round(-4 + 0.1::DOUBLE * i, 1) AS t FROM range(81) r(i)),
l AS (SELECT user_id, t, sum(CASE WHEN c THEN ln(0.2::DOUBLE + 0.8::DOUBLE / (1 + exp(-(t - b)))) ELSE ln(1 - (0.2::DOUBLE + 0.8::DOUBLE / (1 + exp(-(t - b))))) END) AS ll FROM a, g GROUP BY ALL), m AS (SELECT user_id, max(ll - t * t / 2) AS top FROM l GROUP BY 1), w AS (SELECT l.user_id, t, ll, exp(ll - t * t / 2 - top) AS w FROM l JOIN m ON l.user_id = m.user_id)
SELECT user_id, round(sum(w * t) / sum(w), 5) AS eap, round(sqrt(sum(w * t * t) / sum(w) - power(sum(w * t) / sum(w), 2)), 5) AS sd, -max({'l': round(ll, 9), 't': -t}).t AS argmax FROM w GROUP BY user_id""")
def abilities(spark, d):
    answers = table(spark, d, "events").select("user_id", ((F.col("event_id") % 9 - 4) / 2).alias("b"), F.col("event_type").eqNullSafe("purchase").alias("correct"))
    return L.abilities(answers, "user_id", "b", "correct").withColumns({"eap": F.round("eap", 5), "sd": F.round("sd", 5)})


@query("consecutive_dedupe", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def consecutive_dedupe(spark, d):
    return Q.without_consecutive_repeats(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@query("divergence_lcp", """WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events), j AS (SELECT a.user_id, a.i, a.event_type AS x, b.event_type AS y FROM s a LEFT JOIN s b ON b.user_id = a.user_id + 1 AND b.i = a.i)
SELECT user_id, CAST(coalesce(min(i) FILTER (x IS DISTINCT FROM y), max(i) + 1) AS INTEGER) AS length FROM j GROUP BY user_id""")
def divergence_lcp(spark, d):
    s = table(spark, d, "events").select("user_id", F.col("event_type").alias("x"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).alias("i"))
    nxt = s.select((F.col("user_id") - 1).alias("user_id"), "i", F.col("x").alias("y"))
    return Q.common_prefix(s.join(nxt, ["user_id", "i"], "left"), "user_id", "i", "x", "y")


def _sequences(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value", "event_type"))).alias("s"))
    nxt = s.select((F.col("user_id") - 1).alias("user_id"), F.col("s").alias("t"))
    return s.join(nxt, "user_id")


@query("dtw_pairs", None)
def dtw_pairs(spark, d):
    return _sequences(spark, d).select("user_id", Q.dtw("s.value", "t.value").alias("distance"))


@query("nw_align", None)
def nw_align(spark, d):
    return _sequences(spark, d).select("user_id", Q.alignment_score("s.event_type", "t.event_type").alias("score"))


@query("hungarian_match", None)
def hungarian_match(spark, d):
    costs = table(spark, d, "events").groupBy((F.col("event_id") % 16).alias("g"), "event_type", F.date_format("ts", "dd").alias("day")).agg(F.min("value").alias("cost"))
    return Q.assigned(costs, "g", "event_type", "day", "cost")


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    return V.drained(V.tumbling(V.event_stream(spark, d), "1 day"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sliding", "SELECT start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS start FROM events) GROUP BY ALL")
def stream_sliding(spark, d):
    return V.drained(V.sliding(V.event_stream(spark, d), "12 hours", "6 hours"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("session_windows", """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, g""")
def session_windows(spark, d):
    return V.sessions(events_utc(spark, d), "6 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_bkt", f"WITH RECURSIVE {TRACE}")
def stream_bkt(spark, d):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = V.drained(V.mastery_stream(V.event_stream(spark, d)), "update")
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return out.withColumn("mastery", F.round("mastery", 6))
