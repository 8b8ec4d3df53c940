"""Subscriptions and rate limits as stateful streams: event-time timers, one small state a key.

What a key's events lead to does not depend on how they fall into batches; the batch functions say the same of a finished table.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

from .events import opened

#: The state that a failed payment leads to, and the one after its grace period.
FAILED, DOWNGRADED = "PAST_DUE", "EXPIRED"


def with_state_store(spark) -> None:
    """Timers need the state store that keeps several states a key; a session that names another one keeps it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Subscriptions(StatefulProcessor):
    """A key's state, since when, and a timer that ends the grace period of a failed payment."""

    def __init__(self, states: dict[str, str], grace_ms: int):
        self.states, self.grace_ms = states, grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("subscription", "state string, since_ms long")

    def _ended(self, state: str | None, since: int, now: int) -> bool:
        return state == FAILED and since + self.grace_ms < now

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, since = self.kept.get() if self.kept.exists() else (None, 0)
        for at, _, kind in sorted((r["at_ms"], r["event_id"], r["event_type"]) for r in rows):
            new = self.states.get(kind)
            if new is None:
                continue
            if self._ended(state, since, at):  # the timer's time lies between two events of one batch
                yield Row(key=key[0], state=DOWNGRADED, at_ms=since + self.grace_ms)
            state, since = new, at
            yield Row(key=key[0], state=state, at_ms=at)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state is not None:
            self.kept.update((state, since))
            if state == FAILED:
                self.handle.registerTimer(since + self.grace_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state, since = self.kept.get()
        if state == FAILED and since + self.grace_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.kept.update((DOWNGRADED, since + self.grace_ms))
            yield Row(key=key[0], state=DOWNGRADED, at_ms=since + self.grace_ms)

    def close(self) -> None:
        pass


class Limiter(StatefulProcessor):
    """A key's open window and how many hits it has."""

    def __init__(self, window_s: float, limit: int):
        self.window_s, self.limit = window_s, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("window", "opened double, n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = tuple(self.kept.get()) if self.kept.exists() else None
        for at, event in sorted((r["at_us"], r["event_id"]) for r in rows):
            state = opened(state, at / 1e6, self.window_s)
            yield Row(event_id=event, key=key[0], allowed=state[1] <= self.limit)
        if state is not None:
            self.kept.update(state)

    def close(self) -> None:
        pass


def _timed(events: DataFrame, time: str) -> DataFrame:
    """Events that have a time, as instants of the session's zone."""
    return events.withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull())


def subscription_stream(events: DataFrame, key: str, time: str, id_col: str, states: dict[str, str], grace_days: float, late: str = "0 seconds") -> DataFrame:
    """Stream: every change of a key's state (key, state, at). `states` tells what kinds of events lead to; other kinds change nothing.

    A failed payment that nothing follows within the grace period ends in DOWNGRADED at its end, when the
    watermark passes it: no later event of the key is needed. Events come in order but for `late`; ids of a key are unique.
    """
    with_state_store(events.sparkSession)
    kind = F.col("event_type")
    own = _timed(events, time).withWatermark(time, late).select(F.col(key).alias("key"), F.unix_millis(time).alias("at_ms"), F.col(id_col).cast("long").alias("event_id"), kind.alias("event_type"), time)
    processor = Subscriptions(states, int(grace_days * 86_400_000))
    shape = f"key {dict(events.dtypes)[key]}, state string, at_ms long"
    told = own.groupBy("key").transformWithState(statefulProcessor=processor, outputStructType=shape, outputMode="Append", timeMode="EventTime")
    return told.select("key", "state", F.timestamp_millis("at_ms").alias("at"))


def subscription_changes(events: DataFrame, key: str, time: str, id_col: str, states: dict[str, str], grace_days: float, as_of=None) -> DataFrame:
    """Batch: the changes that `subscription_stream` tells once the watermark is at `as_of`, by default the last event's time."""
    lead = F.create_map(*(F.lit(x) for kv in states.items() for x in kv))
    at = F.unix_millis(time).alias("at_ms")
    known = _timed(events, time)
    now = known.agg(F.coalesce(F.unix_millis(F.lit(as_of).cast("timestamp")), F.unix_millis(F.max(time))).alias("now_ms"))
    telling = known.select(F.col(key).alias("key"), at, F.col(id_col).alias("id"), lead[F.col("event_type")].alias("state")).where("state is not null")
    following = F.lead("at_ms").over(Window.partitionBy("key").orderBy("at_ms", "id"))
    ends = F.col("at_ms") + int(grace_days * 86_400_000)
    told = telling.withColumn("next_ms", following).join(F.broadcast(now), how="cross")  # one row
    over = (F.col("state") == FAILED) & ((ends < F.col("next_ms")) | (F.col("next_ms").isNull() & (ends <= F.col("now_ms"))))
    changes = F.array_compact(F.array(F.struct("state", "at_ms"), F.when(over, F.struct(F.lit(DOWNGRADED).alias("state"), ends.alias("at_ms")))))
    return told.select("key", F.explode(changes).alias("c")).select("key", "c.state", F.timestamp_millis("c.at_ms").alias("at"))


def rate_limited_stream(events: DataFrame, key: str, time: str, id_col: str, window_s: float, limit: int) -> DataFrame:
    """Stream: events (event_id, key, allowed) that come in order of time, each when it comes; the state is one window a key."""
    with_state_store(events.sparkSession)
    own = _timed(events, time).select(F.col(key).alias("key"), F.unix_micros(time).alias("at_us"), F.col(id_col).cast("long").alias("event_id"))
    shape = f"event_id long, key {dict(events.dtypes)[key]}, allowed boolean"
    return own.groupBy("key").transformWithState(statefulProcessor=Limiter(window_s, limit), outputStructType=shape, outputMode="Append", timeMode="None")
