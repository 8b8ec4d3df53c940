"""Rules of triage, usefulness, accounts, legacy rows, roles, exports and searches on small cases."""

import os
from datetime import date

from pyspark.sql import functions as F

from noticeloom.functions import text as T
from noticeloom.operators import dedup, listing, match, publish, reports
from noticeloom.sources import readers, sinks


def test_triage_goes_by_reason_first(spark):
    rows = [
        ("MULTIPLE_APPRAISAL_MATCHES", None, None, 0, "MISSING_DATA"), ("MULTIPLE_APPRAISAL_MATCHES", 0.1, None, 1, "QUICK_APPROVAL"), ("MULTIPLE_APPRAISAL_MATCHES", 0.9, 0.7, 2, "QUICK_APPROVAL"),
        ("MULTIPLE_APPRAISAL_MATCHES", 0.9, 0.8, 2, "MEANINGFUL_REVIEW"), ("MULTIPLE_APPRAISAL_MATCHES", None, None, 2, "MEANINGFUL_REVIEW"), ("NO_ADDRESS_RESOLVED", None, None, 0, "MISSING_DATA"),
        ("NO_ADDRESS_RESOLVED", 0.9, 0.1, 2, "NON_BLOCKING_ENRICHMENT"), ("POSSIBLE_CONTENT_DUPLICATE", 0.9, 0.1, 2, "MEANINGFUL_REVIEW"), ("SALE_DATE_CONFLICT", None, None, 0, "MEANINGFUL_REVIEW"),
        ("POOR_TEXT_QUALITY", 0.9, 0.1, 2, "MISSING_DATA"), ("USER_REPORTED", 0.9, 0.1, 2, "NON_BLOCKING_ENRICHMENT"),
    ]
    df = spark.createDataFrame(rows, "reason string, best double, second double, n int, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", publish.triage_bucket("reason", "best", "second", "n")).collect())
    strict = df.where("n = 1").select(publish.triage_bucket("reason", "best", "second", "n", strict_single=True)).first()[0]
    assert strict == "MEANINGFUL_REVIEW"
    order = spark.createDataFrame([("NON_BLOCKING_ENRICHMENT",), ("QUICK_APPROVAL",), ("MISSING_DATA",), ("MEANINGFUL_REVIEW",)], "b string").select(publish.triage_rank("b")).collect()
    assert [r[0] for r in order] == [4, 3, 2, 1]


def test_usefulness_is_by_named_facts(spark):
    facts = spark.createDataFrame([(True, True, True, True, True), (True, True, False, True, True), (False, True, False, True, True), (True, False, True, True, True), (True, True, True, False, True), (False, True, True, True, None)], "a boolean, s boolean, p boolean, b boolean, l boolean")
    got = [r[0] for r in facts.select(reports.usefulness(*(F.col(c) for c in "aspbl"))).collect()]
    assert got == ["FULLY_USEFUL", "USEFUL", "USEFUL", "LIMITED", "LIMITED", "LIMITED"]


def test_entitlements_give_one_row_each(spark):
    profiles = spark.createDataFrame([(k,) for k in range(7)], "profile_id int")
    today, later = date(2026, 1, 2), date(2026, 1, 3)
    rows = [(1, "COUNTY", "PROMOTIONAL", None), (2, "UNLIMITED", "PAYMENT_FAILED", later), (3, "UNLIMITED", "PAST_DUE", today), (4, "UNLIMITED", "CANCELED", later), (5, "GOLD", "ACTIVE", None), (6, "COUNTY", "ACTIVE", None), (6, "UNLIMITED", "ACTIVE", None)]
    subs = spark.createDataFrame(rows, "profile_id int, plan string, status string, grace_until date").withColumn("counties", F.array(F.lit("x")))
    plans = spark.createDataFrame([("FREE", 5, 0), ("COUNTY", 100, 10), ("UNLIMITED", None, None)], "plan string, max_saved int, monthly_exports int")
    got = {r["profile_id"]: (r["plan"], r["max_saved"]) for r in publish.entitlements(profiles, subs, plans, F.lit(today)).collect()}
    assert got == {0: ("FREE", 5), 1: ("COUNTY", 100), 2: ("UNLIMITED", None), 3: ("FREE", 5), 4: ("FREE", 5), 5: ("FREE", 5), 6: ("UNLIMITED", None)}


def test_county_stats_round_the_mean_of_first_sales(spark):
    visible = spark.createDataFrame([("x", 100, "RESIDENTIAL", date(2026, 1, 1)), ("x", 101, "COMMERCIAL", date(2026, 1, 4)), ("x", None, "UNKNOWN", None)], "county string, value_cents long, classification string, first_sale date")
    documents = spark.createDataFrame([("x", date(2026, 1, 9)), ("x", date(2026, 1, 8)), ("y", date(2026, 1, 1))], "county string, collected_at date")
    got = {r["county"]: r for r in reports.county_stats(visible, documents, F.lit(date(2026, 1, 2))).collect()}
    x = got["x"]
    assert (x["n_cases"], x["avg_value_cents"], x["next_sale"], x["avg_days"], x["newest_notice"]) == (3, 101, date(2026, 1, 1), 1, date(2026, 1, 9))
    assert got["y"]["n_cases"] == 0 and got["y"]["avg_days"] is None


def test_legacy_ladder(spark):
    shape = "id int, number string, instrument string, a string, b string, c string, names array<string>"
    legacy = spark.createDataFrame([
        (1, "F1", "I2", None, None, None, None), (2, None, "I2", None, None, None, None), (3, None, None, "x", "y", "z", None), (4, None, None, "x", "y", None, ["ANA", "BELT"]), (5, None, None, "x", None, None, None), (6, "F9", "I9", None, None, None, ["DEE"]), (7, None, None, "x", None, None, None),
    ], shape).withColumnRenamed("id", "legacy_id")
    ingested = spark.createDataFrame([(10, "F1", None, "x", "y", "z", ["ANA", "BELT", "JR"]), (11, "F1", "I2", "x", None, None, None), (12, "F3", "I2", "x", "y", "q", None)], shape).withColumnRenamed("id", "case_id")
    got = {r["legacy_id"]: (r["class"], r["match_id"], r["n_equal"]) for r in dedup.legacy_matches(legacy, ingested, ["a", "b", "c"]).collect()}
    assert got == {1: ("A", 11, 0), 2: ("B", 12, 0), 3: ("B", 10, 3), 4: ("B", 10, 3), 5: ("E", 10, 1), 6: ("C", None, 0), 7: ("E", 10, 1)}


def test_roles_of_addresses(spark):
    far = "x " * 200
    rows = [
        ("Substitute Trustee's Address: 1 Elm", "1 elm", "TRUSTEE OFFICE"), (f"law firm {far} Beneficiary's address 1 Elm", "1 Elm", "LENDER/MORTGAGEE OFFICE"), (f"1 Elm {far} Smith, P.C.", "1 Elm", "LAW FIRM"),
        ("after recording, return to A", "9 Oak", "MAILING/RETURN ADDRESS"), ("nothing here", "9 Oak", "AMBIGUOUS"), (None, "9 Oak", "AMBIGUOUS"), ("", None, "AMBIGUOUS"), ("courthouse door", None, "COURTHOUSE"),
    ]
    df = spark.createDataFrame(rows, "t string, a string, want string").withColumn("got", T.role_of_context("t", "a"))
    assert [r["got"] for r in df.collect()] == [r[2] for r in rows]


def test_csv_files_have_headers_and_crlf(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "id int, t string").coalesce(1)
    sinks.write_csv(df, str(tmp_path / "csv"))
    (part,) = [p for p in os.listdir(tmp_path / "csv") if p.startswith("part-")]
    assert (tmp_path / "csv" / part).read_bytes() == b'id,t\r\n1,"a ""b"", c"\r\n2,\r\n'


def test_searches_within_a_budget(spark):
    none = None
    shape = "county string, case_id int, owner_names array<string>, city string, parcel_id string, geographic_id string, legal_text string, subdivision string, lot string, block string, acreage double, mailing_address string, stated_address string"
    cases = spark.createDataFrame([("x", 1, ["Ana Belt"], none, "P1", none, none, "OAK", none, none, none, none, none)], shape)
    shape = "county string, candidate_id string, owner_name string, situs_address string, city string, parcel_id string, geographic_id string, legal_text string, subdivision string, lot string, block string, acreage double"
    records = spark.createDataFrame([("x", "a", "ZED", none, none, "P1", none, none, none, none, none, none), ("x", "b", "ZED", none, none, none, none, none, "OAK", none, none, none), ("x", "c", "BELT ANA", none, none, none, none, none, none, none, none, none)], shape)
    found = lambda budget: sorted((r["candidate_id"], r["strategy"]) for r in match.candidates(cases, records, budget=budget).collect())
    assert found(None) == [("a", 1), ("b", 3), ("c", 7)] and found(3) == [("a", 1), ("b", 3)]
    assert found(1) == [("a", 1)] and found(2) == [("a", 1), ("b", 3)] and found(0) == []


def test_explanations(spark):
    rows = [(["parcelId"], [], 0.99, 0.5, 2, True, True), (["city"], ["ownerName"], 0.8, None, 1, False, True), (["city"], ["lot"], 0.8, 0.7, 2, False, True), (["ownerName"], [], 0.8, None, 1, False, True), (["city"], [], 0.8, 0.75, 2, False, True), ([], [], 0.1, None, 1, False, False), ([], [], None, None, 0, False, False)]
    df = spark.createDataFrame(rows, "m array<string>, c array<string>, s double, t double, n int, a boolean, r boolean")
    got = [r[0] for r in df.select(match.decision_explanation(F.col("a"), F.col("r"), match.method_of(F.col("m")), F.col("s"), F.col("t"), F.col("m"), F.col("c"), F.col("n"))).collect()]
    assert got[0] == "Exact parcel ID match to the county appraisal record (best of 2 candidates considered)."
    assert "never auto-accepted" in got[1] and "conflicting lot" in got[2] and "owner name only (score 0.80)" in got[3] and "only 0.05 ahead of the next candidate (0.75)" in got[4]
    assert got[5] == "No candidate scored above the manual-review threshold (best was 0.10)." and got[6].startswith("No appraisal-district candidates")


def test_saved_flag_and_facet(spark):
    items = spark.createDataFrame([(1, 7, "b"), (2, None, ""), (3, 8, None), (4, 9, "a")], "case_id int, property_id int, city string")
    saved = spark.createDataFrame([(5, 7), (5, 7), (6, 8)], "profile_id int, property_id int")
    assert {r["case_id"]: r["is_saved"] for r in listing.with_saved(items, saved, 5).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert not any(r["is_saved"] for r in listing.with_saved(items, saved, None).collect())
    assert [r["city"] for r in reports.facet(items, "city").collect()] == ["a", "b"]


def test_sale_documents_need_a_link(spark):
    pages = spark.createDataFrame([("u1", "s"), ("u2", "s"), ("u3", "s")], "url string, slug string")
    html = spark.createDataFrame([("u1", '<a href="/DocumentCenter/View/77/AUGUST-4-2026-PROPERTY-SALE">'), ("u2", "<a>")], "url string, html string")
    got = readers.sale_documents(pages, html).collect()
    assert [(r["url"], r["document_id"], r["file_name"], r["posted_date"]) for r in got] == [("u1", "77", "AUGUST-4-2026-PROPERTY-SALE.pdf", date(2026, 8, 4))]


def test_profiles_stay_without_a_free_plan(spark):
    profiles = spark.createDataFrame([(1,), (2,)], "profile_id int")
    subs = spark.createDataFrame([(2, "COUNTY", "ACTIVE", None, ["x"])], "profile_id int, plan string, status string, grace_until timestamp, counties array<string>")
    plans = lambda *rows: spark.createDataFrame(list(rows), "plan string, max_saved int, monthly_exports int")
    county, free = ("COUNTY", 50, 5), ("FREE", 3, 1)
    got = lambda p: sorted((r["profile_id"], r["plan"], r["max_saved"], r["monthly_exports"]) for r in publish.entitlements(profiles, subs, p, F.lit("2026-01-01").cast("timestamp")).collect())
    assert got(plans(county, free)) == got(plans(county, free, free)) == [(1, "FREE", 3, 1), (2, "COUNTY", 50, 5)]
    assert got(plans(county)) == [(1, "FREE", 0, 0), (2, "COUNTY", 50, 5)]


def test_a_query_gets_one_search_by_what_it_states(spark):
    shape = "owner_names array<string>, parcel_id string, geographic_id string, legal_text string, subdivision string, acreage double, stated_address string"
    rows = [(["A B"], "P", "G", "L", "S", 1.0, "1 Elm"), (["A B"], None, "G", "L", "S", 1.0, "1 Elm"), (["A B"], None, None, "L", "S", 1.0, "1 Elm"), (["A B"], None, None, "L", "S", 1.0, None), (["A B"], "", None, "L", None, 1.0, " "), (None, None, None, "L", "S", 1.0, None), (None, None, None, "L", None, 1.0, None), (["A B"], None, None, None, None, None, None), ([], None, None, None, None, 1.0, None)]
    df = spark.createDataFrame(rows, shape)
    ask = lambda **k: [r[0] for r in df.select(match.first_search(match.Capabilities(**k))).collect()]
    assert ask() == [1, 2, 0, 5, 6, 3, 4, 7, None]
    assert ask(address=False, parcel=False, subdivision=False) == [6, 6, 6, 6, 6, 4, 4, 7, None]
    assert ask(owner=False, legal=False, address=False) == [1, 2, 3, 3, None, 3, None, None, None]
