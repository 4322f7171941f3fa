"""The stream of attempts agrees with the table over several batches, late ones and expired state included."""

import datetime
import random

from evspark.streaming import events as V
from evspark.streaming import progress as P

SCHEMA = "user_id long, event_id long, ts timestamp, finding string, belief double"


def test_stream_agrees_with_table(spark, tmp_path):
    draw, start = random.Random(3), datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(240):
        late = draw.choice([0, 0, 0, 90])  # minutes; the watermark lags by three hours
        at = start + datetime.timedelta(minutes=i * 10 - late)
        rows.append((draw.randint(1, 3), i, at, draw.choice(["a", "b", None]), draw.choice([0.25, 0.5, None])))
    rows += [(None, 999, start, "a", 0.5), (1, None, start, "a", 0.5)]
    for n in range(6):
        spark.createDataFrame(rows[n * 41 : (n + 1) * 41], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        found = V.drained(P.progress_stream(stream, "3 hours"), "update")
    finally:
        spark.conf.unset(key)
    again = found.groupBy("user_id", "event_id").count().filter("count > 1").count()
    ours = sorted(map(tuple, P.latest(found).collect()), key=str)
    theirs = sorted(map(tuple, P.progress(spark.read.parquet(f"{tmp_path}/in")).collect()), key=str)
    assert len(ours) == 240 and ours == theirs
    assert found.agg({"revision": "max"}).first()[0] >= 5 and again > 0
