"""Timers of listings: each listing has a state and a timer in event time, and only listings whose timer fires are touched again.

Events: ``stale``, when nothing has changed for so many days; ``removed``, when it hasn't been seen for so many days;
``relisted``, when it is seen again after that. A listing's rows of one batch are taken in the order of time; what a gap between them brings is
told at its time, as if a timer had fired. A row that is older than the watermark is late and dropped; one that comes after a newer
row of its listing, within the delay, changes nothing. State is dropped ``forget`` days after the removal.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import TYPE_CHECKING, Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from saltmarsh.sources.shared import shared_dir

if TYPE_CHECKING:
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
DAY = 86_400_000
STALE, REMOVED, FORGET = 90, 30, 365
EVENTS = "listing_id long, at long, event string"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Watch(StatefulProcessor):
    """State: times of the last row and of the last change in milliseconds, the last value, and which events are told since."""

    def __init__(self, stale: float = STALE, removed: float = REMOVED, forget: float = FORGET):
        self.stale, self.removed, self.forget = (int(x * DAY) for x in (stale, removed, forget))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("listing", "seen long, changed long, value double, told_stale boolean, told_removed boolean")

    def due(self, state: list) -> list[tuple[int, str]]:
        """Events that are still to come if nothing else does, in order."""
        seen, changed, _, told_stale, told_removed = state
        return sorted([(changed + self.stale, "stale")] * (not told_stale) + [(seen + self.removed, "removed")] * (not told_removed))

    def until(self, state: list, at: int) -> Iterator[tuple[int, str]]:
        """What comes up to a time, marked as told."""
        for when, event in self.due(state):
            if when <= at:
                state[3 if event == "stale" else 4] = True
                yield when, event

    def keep(self, state: list) -> None:
        self.state.update(tuple(state))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(self.due(state)[0][0] if self.due(state) else state[0] + self.removed + self.forget)

    def frames(self, key: Any, events: list[tuple[int, str]]) -> Iterator[pd.DataFrame]:
        if events:
            yield pd.DataFrame({"listing_id": [key[0]] * len(events), "at": [at for at, _ in events], "event": pd.Series([e for _, e in events], dtype=object)})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(["at", "seq"])
        state, events = list(self.state.get()) if self.state.exists() else None, []
        for at, value in zip(found["at"].tolist(), found["value"].tolist(), strict=True):
            value = None if pd.isna(value) else value
            if state is None:
                state = [at, at, value, False, False]
                continue
            if at < state[0]:
                continue
            events += self.until(state, at)
            if state[4]:
                events.append((at, "relisted"))
            if value != state[2]:
                state[1], state[2], state[3] = at, value, False
            state[0], state[4] = at, False
        self.keep(state)
        yield from self.frames(key, events)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        state = list(self.state.get())
        events = list(self.until(state, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())))
        if events:
            self.keep(state)
        else:  # told all, long ago
            self.state.clear()
        yield from self.frames(key, events)

    def close(self) -> None:
        pass


def events(rows: DataFrame, delay: str, **days: float) -> DataFrame:
    """listing_id, at (milliseconds), event of a stream of rows (listing_id, ts, seq, value)."""
    timed = rows.withWatermark("ts", delay).select("listing_id", "ts", F.unix_millis("ts").alias("at"), "seq", "value")
    return timed.groupBy("listing_id").transformWithStateInPandas(Watch(**days), EVENTS, "Append", "EventTime")


def run(spark: SparkSession, source: str, to: str, delay: str = "1 day", files: int = 4, schema: str = SCHEMA, **days: float) -> DataFrame:
    """Take all files that are new since the last run, and give all events told so far: listing_id, at, event."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
        told = events(stream.selectExpr("user_id as listing_id", "cast(ts as timestamp) as ts", "event_id as seq", "value"), delay, **days)
        told.writeStream.format("parquet").option("path", f"{to}/events").option("checkpointLocation", f"{to}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)
    return spark.read.schema(told.schema).parquet(f"{to}/events")


def replayed(rows: DataFrame, upto: int, stale: float = STALE, removed: float = REMOVED) -> DataFrame:
    """The same events of a whole table of rows (listing_id, at, seq, value) at a watermark, by windows."""
    order = W.partitionBy("listing_id").orderBy("at", "seq")
    old = rows.withColumns({"old": F.lag("value").over(order), "first": F.row_number().over(order) == 1, "next": F.lead("at").over(order)})
    gone = old.select("listing_id", (F.col("at") + int(removed * DAY)).alias("due"), "next").filter((F.col("due") <= F.coalesce("next", F.lit(upto))))
    back = gone.filter("next is not null").select("listing_id", F.col("next").alias("at"), F.lit("relisted").alias("event"))
    changes = old.filter(F.col("first") | ~F.col("value").eqNullSafe(F.col("old"))).withColumn("until", F.lead("at").over(order))
    idle = changes.select("listing_id", (F.col("at") + int(stale * DAY)).alias("due"), "until").filter(F.col("due") <= F.coalesce("until", F.lit(upto)))
    told = lambda df, event: df.select("listing_id", F.col("due").alias("at"), F.lit(event).alias("event"))
    return told(gone, "removed").union(told(idle, "stale")).union(back)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of the events as listings; a tenth of a day without a row counts as removed, half a day without a change as stale. Events
    whose time the watermark has not passed are left out, so that they don't depend on how files fall into batches."""
    told = run(spark, f"{sf_dir}/events.parque[t]", f"{shared_dir(spark)}/timers-{uuid.uuid4().hex}", "6 hours", stale=0.5, removed=0.1)
    return told.select("listing_id", "at", "event")
