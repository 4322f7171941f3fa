"""The novelty gate against sets, with rows dealt out once."""

import random

from evspark.operators import fingerprint as P


def test_shares_and_exchanges(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(60)) for i in range(30) for _ in range(20)] + [(None, 3), (None, 3), (None, 61)]
    reference, own = [(0, h) for h in range(0, 60, 3)] * 2, [(i, h) for i, h in rows if i in (1, 2)]
    frames = [spark.createDataFrame(x, "id int, hash long") for x in (rows, reference, own)]
    scored = P.novelty(*frames)
    got = {r.id: (r.ref, r.self) for r in scored.collect()}
    want = {}
    for i in {i for i, _ in rows}:
        mine = {h for j, h in rows if j == i}
        want[i] = (len(mine & {h for _, h in reference}) / len(mine), len(mine & {h for _, h in own}) / len(mine))
    assert got == want
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = P.novelty(*frames)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert plan.count("Exchange hashpartitioning") == 3  # what is known and candidates by hash, sums by id
