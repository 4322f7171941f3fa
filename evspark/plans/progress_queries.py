"""Query of learners' progress as a stream, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from evspark.streaming import events as V
from evspark.streaming import progress as P

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def progress_history(spark, d):
    """Each user's events as attempts: '' and 0 stand for what the first one lacks. Files may come in any order, so none is late."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        events = V.event_stream(spark, d).withColumnsRenamed({"event_type": "finding", "value": "belief"})
        out = V.drained(P.progress_stream(events, "3650 days"), "update")
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return P.latest(out).withColumns({"before": F.coalesce("before", F.lit("")), "change": F.coalesce(F.round("change", 4), F.lit(0.0))})


QUERIES["progress_history"] = progress_history
ORACLE_SQL["progress_history"] = """SELECT user_id, event_id, row_number() OVER o AS place, coalesce(event_type, '') AS finding, coalesce(lag(coalesce(event_type, '')) OVER o, '') AS before, coalesce(round(value - lag(value) OVER o, 4), 0) AS change, row_number() OVER (PARTITION BY user_id, event_type ORDER BY epoch_ms(ts), event_id) AS seen
FROM events WINDOW o AS (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id)"""
