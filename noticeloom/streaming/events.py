"""Events: once each, rate limits, last state. The same functions serve batch and streams where Spark has both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.running import running_sums, runs


def idempotent(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Batch: each event once, the first by `order`."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def idempotent_stream(events: DataFrame, keys: list[str], time: str | None = None, late: str = "7 days") -> DataFrame:
    """Stream: each event once. With `time`, repeats are known for `late` and state is bounded; without, for good."""
    if time is None:
        return events.dropDuplicates(keys)
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def opened(state: tuple | None, at: float, length: float) -> tuple[float, int]:
    """The window that a hit falls into and its number there. A window opens with the first hit after the last one closed: not a token bucket, not a clock window."""
    if state is None or at - state[0] >= length:
        return at, 1
    return state[0], state[1] + 1


def rate_limited(events: DataFrame, key: str, time: str, id_col: str, window_s: float, limit: int) -> DataFrame:
    """Events with `allowed`. A window depends on all earlier hits of its key, so hits are folded in order.

    Where a gap of a whole window makes a fresh start certain a key's history is cut, over sorted ranges, into runs that
    stand alone. Runs stream through tasks sorted; what a task keeps is one window and its count, however long a
    run is. Hits without a time are runs of their own and allowed; ties go by id.
    """
    timed = events.select(id_col, key, (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("_t"))
    cut = runs(timed, [key], ["_t", id_col], window_s, "_run")
    # An order for null keys too, which are one key.
    sorted_ = cut.select(id_col, key, "_t", "_run").repartition(key, "_run").sortWithinPartitions(key, "_run", "_t", id_col)

    def fold(batches):
        import pyarrow as pa

        now, state = None, None
        for batch in batches:
            told = []
            for own, at, run in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if (own, run) != now:
                    now, state = (own, run), None
                if at is None:
                    told.append(limit >= 1)
                    continue
                state = opened(state, at, window_s)
                told.append(state[1] <= limit)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(told, pa.bool_())], [id_col, key, "allowed"])

    schema = events.select(id_col, key).withColumn("allowed", F.lit(True)).schema
    return sorted_.mapInArrow(fold, schema)


def last_state(events: DataFrame, key: str, time: str, id_col: str, states: dict[str, str]) -> DataFrame:
    """Batch: per key the state that its last telling event leads to, and when. Grouped, not sorted."""
    lead = F.create_map(*(F.lit(x) for kv in states.items() for x in kv))
    telling = events.withColumn("state", lead[F.col("event_type")]).where("state is not null")
    best = telling.groupBy(key).agg(F.max(F.struct(time, id_col, "state")).alias("m"))
    return best.select(key, F.col("m.state").alias("state"), F.col(f"m.{time}").alias("since"))


def in_good_standing(state: Column, since: Column, as_of: Column, grace_days: int) -> Column:
    """Active, or past due within the grace period."""
    return (state == "ACTIVE") | ((state == "PAST_DUE") & (F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(since) <= grace_days * 86400))


def last_state_stream(events: DataFrame, key: str, time: str, id_col: str, states: dict[str, str]) -> DataFrame:
    """Stream: the running last state of every key, in update or complete mode."""
    return last_state(events, key, time, id_col, states)


def within_budget(df: DataFrame, keys: list[str], order: list[str], cost: str, budget: float) -> DataFrame:
    """Rows taken in order while their summed cost stays within the budget of each group. `order` is unique within it."""
    return running_sums(df, keys, order, F.col(cost), "spent").withColumn("within_budget", F.col("spent") <= budget)
