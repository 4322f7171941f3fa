"""Queries of practice and verification: soft observations, picks, claims, ladders of prints, power; each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evspark.functions import duck
from evspark.functions.rounding import rounded
from evspark.operators import claims as V
from evspark.operators import fingerprint as P
from evspark.operators import learners as L
from evspark.operators import selection as C
from evspark.operators import sequences as Q
from evspark.operators import statistics as S
from evspark.plans.model_queries import _sequences
from evspark.plans.statistics_queries import _ab
from evspark.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


SLIP = "CASE WHEN event_type = 'error' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END"
CONCEPTS = "c AS (SELECT user_id, event_type, CAST(count(*) FILTER (value < 5) AS DOUBLE) AS mass, CAST(count(*) FILTER (value >= 50) AS DOUBLE) / count(*) AS good, 0.15::DOUBLE + 0.7::DOUBLE * count(*) FILTER (value >= 10) / count(*) AS prior FROM events GROUP BY ALL)"


def _concepts(spark, d):
    n = F.count("*")
    counts = [F.count(F.when(F.col("value") < 5, 1)).cast("double").alias("mass"), (F.count(F.when(F.col("value") >= 50, 1)) / n).alias("good"), (0.15 + 0.7 * F.count(F.when(F.col("value") >= 10, 1)) / n).alias("prior")]
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(*counts)


def _slip():
    return F.when(F.col("event_type") == "error", 0.2).otherwise(0.1)


@query("blamed_mastery", f"""WITH {CONCEPTS}, w AS (SELECT *, {SLIP} AS slip, CASE WHEN max(mass) OVER (PARTITION BY user_id) > 1e-12 THEN mass / max(mass) OVER (PARTITION BY user_id) END AS share FROM c),
j AS (SELECT *, prior * slip / (prior * slip + (1 - prior) * 0.8::DOUBLE) AS after FROM w)
SELECT user_id, event_type, round(round(CASE WHEN share >= 0.02 THEN greatest(0.001::DOUBLE, least(0.999::DOUBLE, (1 - share) * prior + share * after)) ELSE prior END, 9), 6) AS mastery FROM j""")
def blamed_mastery(spark, d):
    rows = L.blamed(_concepts(spark, d), "user_id", "mass", "prior", slip=_slip())
    return rows.select("user_id", "event_type", F.round(F.round("mastery", 9), 6).alias("mastery"))


@query("credited_mastery", f"""WITH {CONCEPTS}, j AS (SELECT *, prior * (1 - {SLIP}) / (prior * (1 - {SLIP}) + (1 - prior) * 0.2::DOUBLE) AS after FROM c)
SELECT user_id, event_type, round(round(CASE WHEN good > 0 THEN greatest(0.001::DOUBLE, least(0.999::DOUBLE, (1 - good) * prior + good * (after + (1 - after) * 0.2::DOUBLE) * 0.95::DOUBLE)) ELSE prior END, 9), 6) AS mastery FROM j""")
def credited_mastery(spark, d):
    mastery = L.observed(F.col("prior"), F.lit(True), F.col("good"), slip=_slip(), forget=0.05)
    return _concepts(spark, d).select("user_id", "event_type", F.round(F.round(mastery, 9), 6).alias("mastery"))  # sums that end in 5 at the 7th decimal may differ in their last bit


UTILITY = """p AS (SELECT p_partkey, [p_brand, p_type] AS cs, p_size / 50.0::DOUBLE AS mass, 0.2::DOUBLE + 0.8::DOUBLE / (1 + exp(-1.2::DOUBLE * (0.5::DOUBLE - (p_size - 25) / 10.0::DOUBLE))) AS p FROM part),
u AS (SELECT p_partkey, cs, round((CASE WHEN p < 0.45 THEN power(p / 0.45, 2) WHEN p > 0.85 THEN power((1 - p) / 0.15, 2) ELSE 1.0 END) * (0.35 + 1.2::DOUBLE * 1.2 * (1 - p) / p * power((p - 0.2) / 0.8, 2)) * (0.25 + mass), 6) AS u FROM p),
c AS (SELECT DISTINCT l_suppkey AS s, p_partkey AS i, u, cs FROM lineitem JOIN u ON l_partkey = p_partkey)"""


def _round_sql(place: int) -> str:
    """The picks of one round: candidates that no round before picked, against what those cover."""
    before = " UNION ALL ".join(f"SELECT s, i, cs FROM r{k}" for k in range(1, place)) or "SELECT s, i, cs FROM c WHERE false"
    running = f"LEFT JOIN (SELECT s, list_distinct(flatten(list(cs))) AS cov, count(*) AS n FROM ({before}) GROUP BY s) b ON b.s = c.s"
    gain = "round(c.u * (1 - 0.65::DOUBLE * len(list_intersect(c.cs, coalesce(b.cov, []))) / len(list_distinct(c.cs))), 9)"
    return f"""r{place} AS (SELECT s, i, cs, gain FROM (SELECT c.s, c.i, c.cs, {gain} AS gain, row_number() OVER (PARTITION BY c.s ORDER BY {gain} DESC, c.u DESC, c.i) AS r FROM c {running}
WHERE coalesce(b.n, 0) = {place - 1} AND NOT EXISTS (SELECT 1 FROM ({before}) x WHERE x.s = c.s AND x.i = c.i)) WHERE r = 1 AND gain > 0)"""


@query("diverse_items", f"WITH {UTILITY}, {', '.join(map(_round_sql, (1, 2, 3)))} SELECT s AS l_suppkey, 1 AS place, i AS p_partkey, round(gain, 5) AS gain FROM r1 UNION ALL SELECT s, 2, i, round(gain, 5) FROM r2 UNION ALL SELECT s, 3, i, round(gain, 5) FROM r3")
def diverse_items(spark, d):
    utility = F.round(L.item_utility(F.lit(0.5), (F.col("p_size") - 25) / 10, F.lit(1.2), 0.2, F.col("p_size") / 50), 6)
    parts = table(spark, d, "part").select("p_partkey", utility.alias("u"), F.array("p_brand", "p_type").alias("cs"))
    offered = table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey")).distinct()
    return L.diverse_items(offered.join(parts, "p_partkey"), "l_suppkey", "p_partkey", "u", "cs", 3, 0.65).withColumn("gain", F.round("gain", 5))


CHECKED = f"""s AS (SELECT conv_id, turn, {duck.sentences('text')} AS s FROM conversations WHERE role = 'assistant'), t AS (SELECT conv_id, turn, CASE WHEN len(s) = 0 THEN [NULL] ELSE s END AS s FROM s),
cl AS (SELECT conv_id, turn, p, s[p] AS claim FROM (SELECT conv_id, turn, s, unnest(range(1, len(s) + 1)) AS p FROM t)), k AS (SELECT *, CASE WHEN claim IS NULL THEN NULL ELSE {duck.claim_kind('claim')} END AS kind FROM cl),
ev AS (SELECT DISTINCT conv_id, unnest({duck.tokens('text')}) AS token FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, p, unnest(list_distinct({duck.tokens('claim')})) AS token FROM k WHERE kind = 'assertion'),
sh AS (SELECT a.conv_id, a.turn, a.p, CAST(count(ev.token) AS DOUBLE) / count(*) AS share FROM a LEFT JOIN ev ON ev.conv_id = a.conv_id AND ev.token = a.token GROUP BY ALL),
ch AS (SELECT k.conv_id, k.turn, k.p, k.claim, k.kind, CASE WHEN k.kind = 'assertion' THEN coalesce(share, 0) WHEN k.claim IS NOT NULL THEN 1.0::DOUBLE END AS score FROM k LEFT JOIN sh ON sh.conv_id = k.conv_id AND sh.turn = k.turn AND sh.p = k.p),
v AS (SELECT conv_id, turn, count(claim) AS n_claims, count(*) FILTER (score < 0.40) AS n_rejected, coalesce(avg(score) FILTER (kind = 'assertion'), 1.0::DOUBLE) AS score FROM ch GROUP BY ALL)"""


def _checked(spark, d):
    turns = table(spark, d, "conversations")
    found = V.claims(turns.filter("role = 'assistant'"), ["conv_id", "turn"], "text")
    return V.supported(found, ["conv_id", "turn"], turns.filter("role = 'user'"), "conv_id", "text")


@query("verified_turns", f"WITH {CHECKED} SELECT conv_id, turn, n_claims, n_rejected, round(score, 6) AS score, n_rejected = 0 AS accepted FROM v")
def verified_turns(spark, d):
    return V.verified(_checked(spark, d), ["conv_id", "turn"]).withColumn("score", rounded(F.col("score"), 6))


@query("sanitised_turns", f"WITH {CHECKED} SELECT conv_id, turn, CASE WHEN count(claim) >= 2 AND count(*) FILTER (score >= 0.40) BETWEEN 1 AND count(claim) - 1 THEN string_agg(claim, ' ' ORDER BY p) FILTER (score >= 0.40) ELSE '' END AS text FROM ch GROUP BY ALL")
def sanitised_turns(spark, d):
    return V.sanitised(_checked(spark, d), ["conv_id", "turn"])


@query("verified_conversations", f"WITH {CHECKED} SELECT conv_id, round(min(score), 6) AS least_score, count(*) AS n_turns, count(*) FILTER (n_rejected = 0) AS n_accepted FROM v GROUP BY 1")
def verified_conversations(spark, d):
    turns = V.verified(_checked(spark, d), ["conv_id", "turn"])
    return turns.groupBy("conv_id").agg(rounded(F.min("score"), 6).alias("least_score"), F.count("*").alias("n_turns"), F.count(F.when(F.col("accepted"), 1)).alias("n_accepted"))


@query("ladder_fingerprint", f"SELECT item_id, CAST(k AS INTEGER) AS k, CAST(p - 1 AS INTEGER) AS pos, g[p] AS hash FROM (SELECT item_id, k, g, unnest(range(1, len(g) + 1)) AS p FROM (SELECT item_id, CASE WHEN len(t) < 7 THEN 3 ELSE 5 END AS k, CASE WHEN len(t) < 7 THEN {duck.grams('t', 3)} ELSE {duck.grams('t', 5)} END AS g FROM (SELECT item_id, {duck.tokens('text', False)} AS t FROM benchmark)))")
def ladder_fingerprint(spark, d):
    return P.ladder_fingerprints(table(spark, d, "benchmark"), "item_id", "text").withColumnRenamed("id", "item_id")


@query("first_seen_types", "SELECT user_id, string_agg(event_type, '>' ORDER BY o, event_type) AS seen FROM (SELECT user_id, event_type, min(event_id) AS o FROM events WHERE event_type IS NOT NULL GROUP BY ALL) GROUP BY user_id")
def first_seen_types(spark, d):
    return C.first_seen(table(spark, d, "events"), "user_id", "event_id", "event_type").withColumn("seen", F.array_join("seen", ">"))


@query("type_maps", "SELECT user_id, count(*) AS n_types, CAST(sum(n) AS BIGINT) AS total, coalesce(string_agg(event_type || '=' || n, ',' ORDER BY event_type) FILTER (n > 5), '') AS frequent FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY ALL) GROUP BY user_id")
def type_maps(spark, d):
    counts = table(spark, d, "events").filter("event_type IS NOT NULL").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    often = F.array_sort(F.map_entries(F.map_filter("m", lambda t, n: n > 5)))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, n: a + n)
    return maps.select("user_id", F.size("m").cast("long").alias("n_types"), total.alias("total"), F.array_join(F.transform(often, lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("frequent"))


@query("series_likeness", None)
def series_likeness(spark, d):
    return _sequences(spark, d).select("user_id", Q.series_likeness("s.value", "t.value").alias("likeness"))


@query("nw_columns", None)
def nw_columns(spark, d):
    return _sequences(spark, d).select("user_id", Q.alignment("s.event_type", "t.event_type").alias("columns"))


@query("power_plan", None)
def power_plan(spark, d):
    m = S.pooled_t(_ab(spark, d).filter("na > 1 AND nb > 1"))
    n = F.least("na", "nb")
    return m.select("l_returnflag", "d", n.alias("n"), S.power_of("d", n).alias("power"), S.detectable_of(n.cast("double")).alias("detectable"), S.cases_needed_of("d").alias("needed"))
