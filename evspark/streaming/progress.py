"""A learner's attempts as a stream: each comes with its place, what changed since the one before, and how often its finding was seen.

State for a learner: a list of the attempts that a late one may still precede, a map of how often each finding was seen before
those, and the last attempt before those. A timer at each attempt moves it out of the list once the watermark has passed it,
so state doesn't grow with the history.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

ATTEMPT = StructType([StructField("at", LongType()), StructField("event_id", LongType()), StructField("finding", StringType()), StructField("belief", DoubleType())])
PROGRESS = StructType([
    StructField("user_id", LongType()), StructField("event_id", LongType()), StructField("place", LongType()), StructField("finding", StringType()), StructField("before", StringType()),
    StructField("change", DoubleType()), StructField("seen", LongType()), StructField("revision", LongType()),
])


class Progress(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", ATTEMPT)
        self.seen = handle.getMapState("seen", StructType([StructField("finding", StringType())]), StructType([StructField("n", LongType())]))
        self.last = handle.getValueState("last", StructType([*ATTEMPT.fields, StructField("place", LongType())]))
        self.revision = handle.getValueState("revision", StructType([StructField("n", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [(int(a), int(e), f, None if pd.isna(b) else float(b)) for part in rows for a, e, f, b in part[["at", "event_id", "finding", "belief"]].itertuples(index=False)]
        old = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        every = sorted({x[:2]: x for x in old + new}.values(), key=lambda x: x[:2])  # a row that comes again is the same attempt
        first = min(x[:2] for x in new)
        self.open.put(every)
        for at in {x[0] for x in new}:
            self.handle.registerTimer(at)
        n = (self.revision.get()[0] if self.revision.exists() else 0) + 1
        self.revision.update((n,))
        *before, place = tuple(self.last.get()) if self.last.exists() else (None, None, None, None, 0)
        counts: dict[str, int] = {}
        out = []
        for x in every:
            finding, place = x[2], place + 1
            if finding not in counts:
                counts[finding] = self.seen.getValue((finding,))[0] if self.seen.containsKey((finding,)) else 0
            counts[finding] += 1
            if x[:2] >= first:  # from the earliest new one on, all places may have moved
                change = None if x[3] is None or before[3] is None else x[3] - before[3]
                out.append((key[0], x[1], place, finding, before[2], change, counts[finding], n))
            before = list(x)
        yield pd.DataFrame(out, columns=PROGRESS.fieldNames()).astype({"change": "float64"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        limit = expiredTimerInfo.getExpiryTimeInMs()
        every = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        gone = [x for x in every if x[0] <= limit]
        place = self.last.get()[4] if self.last.exists() else 0
        for x in gone:
            n = self.seen.getValue((x[2],))[0] if self.seen.containsKey((x[2],)) else 0
            self.seen.updateValue((x[2],), (n + 1,))
        if gone:
            self.last.update((*gone[-1], place + len(gone)))
            kept = every[len(gone) :]
            self.open.put(kept) if kept else self.open.clear()
        yield pd.DataFrame({f.name: pd.Series(dtype=t) for f, t in zip(PROGRESS.fields, ("int64", "int64", "int64", "object", "object", "float64", "int64", "int64"))})

    def close(self) -> None:
        pass


def progress_stream(events: DataFrame, delay: str) -> DataFrame:
    """user_id, event_id, place (from 1, by ts, then event_id), finding, before (the finding of the one before), change (of
    belief; null for the first, or where either is null), seen (times that the finding was seen so far), revision.

    events: a stream of user_id, event_id, ts, finding, belief. An attempt that comes late, by `delay` at most, is placed where it
    belongs, and it and those after it are given out again with a higher revision; later ones are dropped by the watermark.
    Rows without user, event_id or ts don't count; a null finding is the empty one.
    """
    rows = events.filter("user_id IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", delay)
    rows = rows.select("user_id", "event_id", "ts", F.unix_millis("ts").alias("at"), F.coalesce("finding", F.lit("")).alias("finding"), F.col("belief").cast("double").alias("belief"))
    return rows.groupBy("user_id").transformWithStateInPandas(Progress(), PROGRESS, "Update", "EventTime")


def latest(rows: DataFrame) -> DataFrame:
    """The last revision of every attempt."""
    values = F.struct("place", "finding", "before", "change", "seen")
    return rows.groupBy("user_id", "event_id").agg(F.max_by(values, "revision").alias("v")).select("user_id", "event_id", "v.*")


def progress(events: DataFrame) -> DataFrame:
    """What `latest` gives of the stream's rows, from a table."""
    rows = events.filter("user_id IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL").withColumns({"at": F.unix_millis("ts"), "finding": F.coalesce("finding", F.lit("")), "belief": F.col("belief").cast("double")})
    order = Window.partitionBy("user_id").orderBy("at", "event_id")
    same = Window.partitionBy("user_id", "finding").orderBy("at", "event_id")
    return rows.select("user_id", "event_id", F.row_number().over(order).cast("long").alias("place"), "finding", F.lag("finding").over(order).alias("before"), (F.col("belief") - F.lag("belief").over(order)).alias("change"), F.row_number().over(same).cast("long").alias("seen"))
