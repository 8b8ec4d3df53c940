"""Commits of several tables, merges by bucket, chains of merges and the fallback's ledger, on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from noticeloom.operators import dedup, fallback, match
from noticeloom.sources.tables import Conflict, Tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_readers_see_all_of_a_commit_or_none(spark, tmp_path):
    own = Tables(spark, str(tmp_path / "t"))
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(1, 10)], "k int, n int")
    assert own.version() == 0
    with pytest.raises(KeyError):
        own.read("a")
    assert own.commit({"a": own.replaced(a, ["k"], 4), "b": own.replaced(b, ["k"], 4)}, 0) == 1
    held = own.read("a")
    staged = {"a": own.merged("a", spark.createDataFrame([(2, "z")], "k int, v string")), "b": own.merged("b", spark.createDataFrame([(2, 20)], "k int, n int"))}
    assert rows(own.read("a")) == [(1, "x"), (2, "y")] and rows(own.read("b")) == [(1, 10)]  # staged is not seen
    late = {"b": own.merged("b", spark.createDataFrame([(9, 9)], "k int, n int"))}
    assert own.commit(staged, 1) == 2
    assert rows(own.read("a")) == [(1, "x"), (2, "z")] and rows(own.read("b")) == [(1, 10), (2, 20)]
    with pytest.raises(Conflict):
        own.commit(late, 1)
    assert own.version() == 2 and rows(own.read("b")) == [(1, 10), (2, 20)]
    assert rows(held) == rows(own.read("a", 1)) == [(1, "x"), (2, "y")]  # an older version stays readable
    assert own.commit({"b": own.replaced(b.limit(0), ["k"])}, 2) == 3 and rows(own.read("b")) == [] and rows(own.read("a")) == [(1, "x"), (2, "z")]


def test_a_merge_rewrites_touched_buckets_only(spark, tmp_path):
    own = Tables(spark, str(tmp_path / "t"))
    base = spark.range(0, 500).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.lit(1).alias("w"))
    own.commit({"t": own.replaced(base, ["k"], 16)}, 0)
    before = own.manifest()["t"]["buckets"]
    one = own.merged("t", spark.createDataFrame([(7, "old", 1), (7, "new", 2), (None, "null", 1)], "k long, v string, at int"), ["at"])
    assert one.rewritten == sum(before.get(b) != p for b, p in one.entry["buckets"].items()) <= 2
    own.commit({"t": one}, 1)
    assert own.merged("t", base.limit(0)).rewritten == 0
    got = {r["k"]: (r["v"], r["w"]) for r in own.read("t").collect()}
    assert got == {k: ("a", 1) for k in range(500)} | {7: ("new", 1), None: ("null", None)}


def test_matches_are_counted_in_the_cache(spark):
    cache = spark.createDataFrame([("x", "A", "p", 3), ("x", "B", "q", 0)], "county string, legal_key string, candidate_id string, times_reused long")
    found = spark.createDataFrame([("x", "A", "p"), ("x", "A", "r"), ("y", "A", "s"), ("x", None, "t"), ("x", "C", "u"), ("x", "C", "u")], "county string, legal_key string, candidate_id string")
    assert rows(match.recorded_matches(cache, found)) == [("x", "A", "r", 5), ("x", "C", "u", 1), ("y", "A", "s", 0)]


def test_chains_end_and_circles_are_told(spark):
    into = {k: k - 1 for k in range(1, 40)} | {100: 101, 101: 102, 102: 100, 103: 102, 200: 200, 300: 999, 0: None}
    into |= {1000 + k: 39 for k in range(300)}  # many merged into one that is merged itself
    df = spark.createDataFrame([(k, v) for k, v in into.items()], "case_id int, merged_into int").repartition(3)
    want = {k: (0, False) for k in [*range(1, 40), *range(1000, 1300)]} | {k: (None, True) for k in (100, 101, 102, 103, 200)} | {300: (999, False)}
    assert {r["case_id"]: (r["final_id"], r["cyclic"]) for r in dedup.merged_into_final(df).collect()} == want
    assert dedup.merged_into_final(df.limit(0)).collect() == []


def test_the_ledger_is_asked_first_and_the_budget_is_exact(spark):
    kinds = {"amount": "number", "word": "text"}
    wanted = spark.createDataFrame([(k, "t" * 10) for k in range(1, 7)], "id long, text string")
    said = lambda v: json.dumps({"amount": {"value": v, "explicitly_stated": True, "confidence": 0.9, "supporting_text": ""}})
    ledger = spark.createDataFrame([(1, 1, "k", 7, said("5")), (2, 1, "k", 7, said("no")), (3, 1, "k", 7, None), (3, 2, "k", 7, None)], fallback.LEDGER)
    calls = fallback.dealt_calls(wanted, ledger, 28 + 25, F.length("text"), kinds).collect()
    assert sorted((r["id"], r["attempt"]) for r in calls) == [(2, 2), (4, 1)]  # 28 are spent; 10 each, of 25 left

    def provider(key, attempt, text):
        return 4, said("6") if attempt == 2 else None

    out, after = fallback.answered(wanted, provider, ledger, 10_000, F.length("text"), kinds)
    got = {r["id"]: (r["attempts"], r["cost_cents"], r["outcome"], r["fields"]["amount"]["value"] if r["fields"]["amount"] else None) for r in out.collect()}
    assert got == {1: (1, 7, "ACCEPTED", "5"), 2: (2, 11, "ACCEPTED", "6"), 3: (2, 14, "NO_ANSWER", None), 4: (2, 8, "ACCEPTED", "6"), 5: (2, 8, "ACCEPTED", "6"), 6: (2, 8, "ACCEPTED", "6")}
    keys = [r["call_key"] for r in after.where("id > 3").collect()]
    assert len(keys) == len(set(keys)) == 6 and after.count() == 4 + 1 + 6
    again, same = fallback.answered(wanted, provider, after, 10_000, F.length("text"), kinds)
    assert same.count() == after.count() and rows(again.select("id", "outcome")) == rows(out.select("id", "outcome"))
    none, _ = fallback.answered(wanted, None, ledger.limit(0), 10_000, F.length("text"), kinds)
    assert {r["outcome"] for r in none.collect()} == {"NOT_CONFIGURED"}


def test_a_large_bucket_is_several_files(spark, tmp_path):
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    held = spark.conf.get(size)
    own = Tables(spark, str(tmp_path / "t"))
    try:
        spark.conf.set(size, "20000")
        big = spark.range(0, 40000, 1, 4).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        own.commit({"t": own.replaced(big, ["k"], 1)}, 0)
    finally:
        spark.conf.set(size, held)
    (path,) = own.manifest()["t"]["buckets"].values()
    import glob

    assert len(glob.glob(f"{path.removeprefix('file:')}/*.parquet")) > 1
    assert own.read("t").count() == 40000 and own.read("t").select("k").distinct().count() == 40000
