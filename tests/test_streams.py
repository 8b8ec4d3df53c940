"""Running sums, runs, rate limits, timers and the bundle source, against loops."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from noticeloom.operators import running
from noticeloom.sources import county
from noticeloom.streaming import events, timers

DAY0 = datetime(2026, 1, 1)


def test_running_sums_and_runs_are_the_loop(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "a", "a", "a", "b"]), rng.randrange(900), rng.choice([None, 1, 5])) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, k string, t int, v long").repartition(5)
    sums, run, before, want = {}, {}, {}, {}
    for i, k, t, v in sorted(rows, key=lambda r: (r[2], r[0])):
        sums[k] = sums.get(k, 0) + (v or 0)
        run[k] = run.get(k, 0) + (k not in before or t - before[k] >= 8)
        before[k], want[i] = t, (sums[k], run[k])
    got = {r["id"]: r["s"] for r in running.running_sums(df, ["k"], ["t", "id"], F.col("v"), "s").collect()}
    assert got == {i: s for i, (s, _) in want.items()}
    assert {r["id"]: r["run"] for r in running.runs(df, ["k"], ["t", "id"], 8).collect()} == {i: n for i, (_, n) in want.items()}
    ranks = sorted((r["t"], r["id"], r["rank"]) for r in running.ranked(df, ["t", "id"]).collect())
    assert [r[2] for r in ranks] == list(range(1, 601)) and running.ranked(df.limit(0), ["t", "id"]).collect() == []
    plan = running.ranked(df, ["t", "id"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan


def test_a_hot_key_without_gaps_is_limited_in_order(spark):
    rows = spark.range(0, 20_000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 7).alias("user_id"), F.timestamp_seconds(F.col("id") * 7).alias("ts"))
    got = {r["event_id"]: r["allowed"] for r in events.rate_limited(rows.repartition(6), "user_id", "ts", "event_id", 600.0, 2).collect()}
    state, want = {}, {}
    for i in range(20_000):
        u = 1 if i % 3 else i % 7
        state[u] = events.opened(state.get(u), i * 7, 600.0)
        want[i] = state[u][1] <= 2
    assert got == want


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_grace_ends_without_a_later_event(spark, tmp_path):
    day = lambda n: DAY0 + timedelta(days=n)
    batches = [
        [(1, day(0), 1, "error"), (2, day(0), 2, "error"), (3, day(0), 3, "purchase"), (4, day(0.5), 4, "error")], [(5, day(1), 2, "purchase"), (6, day(2), 4, "error"), (7, day(2), 3, "view")],
        [(8, day(4.5), 3, "error")], [(9, day(5.5), 9, "signup")], [(10, day(30), 9, "view")],
    ]
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    states = {"purchase": "ACTIVE", "error": timers.FAILED, "signup": "TRIALING"}
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:  # one after the other, with the state kept between
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        told = timers.subscription_stream(_stream(spark, source, schema), "user_id", "ts", "event_id", states, 3)
        run = told.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-offsets").trigger(availableNow=True).start()
        run.awaitTermination(180)
    got = sorted((r["key"], r["state"], r["at"]) for r in spark.read.parquet(out).collect())
    ends = [(1, "EXPIRED", day(3)), (4, "EXPIRED", day(5)), (3, "EXPIRED", day(7.5))]
    assert [g for g in got if g[1] == "EXPIRED"] == sorted(ends)
    every = spark.createDataFrame([r for b in batches for r in b], schema)
    assert got == sorted((r["key"], r["state"], r["at"]) for r in timers.subscription_changes(every, "user_id", "ts", "event_id", states, 3).collect())


def test_limiter_keeps_its_window_between_batches(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, DAY0 + timedelta(minutes=7 * i), i % 2) for i in range(30)]
    for part in (rows[:9], rows[9:10], rows[10:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        told = timers.rate_limited_stream(_stream(spark, source, schema), "user_id", "ts", "event_id", 3600.0, 2)
        told.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-offsets").trigger(availableNow=True).start().awaitTermination(180)
    want = events.rate_limited(spark.createDataFrame(rows, schema), "user_id", "ts", "event_id", 3600.0, 2)
    assert sorted((r["event_id"], r["allowed"]) for r in spark.read.parquet(out).collect()) == sorted((r["event_id"], r["allowed"]) for r in want.collect())


def test_bundles_arrive_once(spark, tmp_path):
    county.register(spark)
    folder = tmp_path / "county"
    folder.mkdir()
    read = lambda: sorted(tuple(r) for r in spark.read.format("county_notices").load(str(folder)).collect())
    assert read() == []
    (folder / "2026-01.txt").write_text("one\ftwo é\r\n\f\fthree")
    (folder / "2026-02.txt").write_text("x" * 200_000 + "\fend\f")
    (folder / "_draft.txt").write_text("no")
    (folder / "2026-03.pdf").write_text("no")
    first = [("2026-01.txt", 1, "one"), ("2026-01.txt", 2, "two é\r\n"), ("2026-01.txt", 3, ""), ("2026-01.txt", 4, "three"), ("2026-02.txt", 1, "x" * 200_000), ("2026-02.txt", 2, "end")]
    assert read() == first
    out = str(tmp_path / "out")

    def advance():
        stream = spark.readStream.format("county_notices").load(str(folder))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-offsets").trigger(availableNow=True).start().awaitTermination(120)
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())

    assert advance() == first
    (folder / "2026-03.txt").write_text("late")
    assert advance() == advance() == [*first, ("2026-03.txt", 1, "late")]
    assert spark.read.format("county_notices").option("suffix", ".pdf").load("file://" + str(folder)).collect()[0]["text"] == "no"
