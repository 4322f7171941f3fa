"""Answers reviewed against what was said before them: weighed support and leaked benchmark texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from evspark.functions import duck
from evspark.functions.rounding import rounded
from evspark.operators import claims as V
from evspark.operators.retrieval import postings
from evspark.plans.practice_queries import CHECKED
from evspark.sources.stored import stored
from evspark.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return register


#: After the claims `k` of the assistant's turns.
REVIEWED = f"""{CHECKED}, near AS (SELECT DISTINCT a.conv_id, a.turn, u.turn AS card FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND u.turn BETWEEN a.turn - 12 AND a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user'),
tok AS (SELECT DISTINCT conv_id, turn AS card, unnest({duck.tokens('text')}) AS term FROM conversations WHERE role = 'user'), nd AS (SELECT count(DISTINCT (conv_id, turn)) AS n FROM conversations WHERE role = 'user'),
idf AS (SELECT term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf FROM (SELECT term, count(*) AS df FROM tok GROUP BY term), nd),
wt AS (SELECT a.*, coalesce(idf, ln(1 + (n + 0.5::DOUBLE) / 0.5::DOUBLE)) AS w FROM (SELECT DISTINCT conv_id, turn, p, token AS term FROM a) a LEFT JOIN idf USING (term), nd),
su AS (SELECT conv_id, turn, p, round(max(part), 9) AS best FROM (SELECT x.conv_id, x.turn, x.p, sum(x.w) / any_value(total) AS part FROM wt x JOIN (SELECT conv_id, turn, p, sum(w) AS total FROM wt GROUP BY ALL) y ON x.conv_id = y.conv_id AND x.turn = y.turn AND x.p = y.p
  JOIN near ON near.conv_id = x.conv_id AND near.turn = x.turn JOIN tok ON tok.conv_id = x.conv_id AND tok.card = near.card AND tok.term = x.term GROUP BY x.conv_id, x.turn, x.p, near.card) GROUP BY ALL),
sc AS (SELECT k.*, CASE WHEN kind = 'assertion' THEN coalesce(best, 0) WHEN claim IS NOT NULL THEN 1.0::DOUBLE END AS score FROM k LEFT JOIN su ON su.conv_id = k.conv_id AND su.turn = k.turn AND su.p = k.p),
sp AS (SELECT conv_id, turn, p, unnest(list_distinct(CASE WHEN len(t) < 7 THEN {duck.grams('t', 3)} ELSE {duck.grams('t', 5)} END)) AS gram FROM (SELECT conv_id, turn, p, {duck.tokens('claim', False)} AS t FROM k WHERE claim IS NOT NULL) WHERE len(t) >= 3),
bt AS (SELECT {duck.tokens('text', False)} AS t FROM benchmark), bg AS (SELECT unnest({duck.grams('t', 3)}) AS gram FROM bt UNION SELECT unnest({duck.grams('t', 5)}) FROM bt),
ut AS (SELECT conv_id, turn AS card, {duck.tokens('text', False)} AS t FROM conversations WHERE role = 'user'), ug AS (SELECT conv_id, card, unnest({duck.grams('t', 3)}) AS gram FROM ut UNION SELECT conv_id, card, unnest({duck.grams('t', 5)}) FROM ut),
hg AS (SELECT DISTINCT near.conv_id, near.turn, gram FROM near JOIN ug ON ug.conv_id = near.conv_id AND ug.card = near.card),
lk AS (SELECT sp.conv_id, sp.turn, sp.p, round(count(bg.gram) / count(*)::DOUBLE * (1 - count(hg.gram) / count(*)::DOUBLE), 9) AS leak FROM sp LEFT JOIN bg ON bg.gram = sp.gram LEFT JOIN hg ON hg.conv_id = sp.conv_id AND hg.turn = sp.turn AND hg.gram = sp.gram GROUP BY ALL),
rv AS (SELECT *, n_unsupported = 0 AND leak <= 0.18 AS accepted FROM (SELECT sc.conv_id, sc.turn, count(claim) AS n_claims, count(*) FILTER (score < 0.40) AS n_unsupported, coalesce(avg(score) FILTER (kind = 'assertion'), 1.0::DOUBLE) AS score, coalesce(max(leak), 0.0::DOUBLE) AS leak
  FROM sc LEFT JOIN lk ON lk.conv_id = sc.conv_id AND lk.turn = sc.turn AND lk.p = sc.p GROUP BY ALL))"""


def _reviewed(spark, d):
    turns = table(spark, d, "conversations")
    asking, user = turns.filter("role = 'assistant'"), turns.filter("role = 'user'")
    told = user.select(F.concat_ws(":", "conv_id", "turn").alias("card"), "text")
    cards = V.cards_before(asking, user, "conv_id", "turn").select("conv_id", "turn", F.concat_ws(":", "conv_id", "told_place").alias("card"))
    cards = stored(cards, "cards")
    index = stored(postings(told, "card", "text").select(F.col("doc").alias("card"), "term"), "postings")
    found = stored(V.claims(asking, ["conv_id", "turn"], "text"), "claims")
    checked = V.weighed_support(found, ["conv_id", "turn"], cards, index, told.agg(F.countDistinct("card").alias("n")))
    return V.reviewed(checked, ["conv_id", "turn"], V.sentence_leaks(found, ["conv_id", "turn"], cards, told, table(spark, d, "benchmark"), "text"))


@query("reviewed_turns", f"WITH {REVIEWED} SELECT conv_id, turn, n_claims, n_unsupported, round(score, 6) AS score, round(leak, 6) AS leak, accepted FROM rv")
def reviewed_turns(spark, d):
    """Each answer: its assertions' support by the user's turns among the 12 before it, and what it tells of the benchmark."""
    return _reviewed(spark, d).withColumns({"score": rounded(F.col("score"), 6), "leak": rounded(F.col("leak"), 6)})


@query("reviewed_conversations", f"WITH {REVIEWED} SELECT conv_id, round(max(leak), 6) AS most_leak, round(min(score), 6) AS least_score, count(*) FILTER (accepted) AS n_kept, count(*) FILTER (NOT accepted) AS n_dropped FROM rv GROUP BY conv_id")
def reviewed_conversations(spark, d):
    kept, dropped = F.count(F.when(F.col("accepted"), 1)).alias("n_kept"), F.count(F.when(~F.col("accepted"), 1)).alias("n_dropped")
    return _reviewed(spark, d).groupBy("conv_id").agg(rounded(F.max("leak"), 6).alias("most_leak"), rounded(F.min("score"), 6).alias("least_score"), kept, dropped)
