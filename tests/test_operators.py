"""Operators on small invented cases."""

from datetime import date, datetime

from pyspark.sql import Row
from pyspark.sql import functions as F

from noticeloom.operators import dedup, extract, match, publish, split
from noticeloom.operators.listing import ListingFilter
from noticeloom.sources import readers, sinks
from noticeloom.streaming import events

NOTICE = """NOTICE OF SUBSTITUTE TRUSTEE'S SALE
Deed of Trust Date: March 5, 2019
Grantor(s): CARL DOVE, Jr. AND ANA BELT
Original Mortgagee: Mortgage Registry, as nominee for Meadow Savings Bank, its successors and assigns.
Summit Ridge Bank is the current mortgagee of the note.
Harbor Point Loans LLC is acting as the Mortgage Servicer for it.
Original Principal Amount: $185,000.00
The property is commonly known as 12 Mesquite Dr, Weslaco, TX 78596
Legal Description: Lot 14, Block 3, OAK RIDGE SUBDIVISION, an addition

Date of Sale: August 4, 2026
Time of Sale: 10:00 AM
"""


def test_extraction(spark):
    r = extract.pipeline(spark.createDataFrame([(1, NOTICE), (2, ""), (3, None)], "doc_id int, text string")).orderBy("doc_id").collect()
    v = {n: r[0][n]["value"] for n in extract.FIELDS}
    assert v["grantor_names"] == ["CARL DOVE, Jr.", "ANA BELT"]
    assert v["original_mortgagee"] == "Meadow Savings Bank" and v["current_mortgagee"] == "Summit Ridge Bank" and v["mortgage_servicer"] == "Harbor Point Loans LLC"
    assert v["original_principal"] == 185000.0 and v["sale_date"] == "2026-08-04" and v["deed_date"] == "2019-03-05"
    assert r[0]["address"]["method"] == "COMMONLY_KNOWN_AS_PHRASE" and v["property_address"] == "12 Mesquite Dr, Weslaco, TX 78596"
    assert (r[0]["legal"]["lot"], r[0]["legal"]["block"]) == ("14", "3")
    assert r[0]["review_reasons"] == [] and not r[0]["used_fallback"]
    assert r[1]["review_reasons"] == ["NO_ADDRESS_RESOLVED", "BORROWER_NAME_CONFLICT", "SALE_DATE_CONFLICT", "LOW_CONFIDENCE"]


def test_a_party_runs_on_where_no_period_ends_the_line(spark):
    """A name may hold commas and line breaks; only a period before a capital ends it."""
    text = NOTICE.replace("assigns.\n", "assigns\n")
    r = extract.lender_parties(spark.createDataFrame([(text,)], "text string")).first()
    assert r["current_mortgagee"]["value"] == "Mortgage Registry, as nominee for Meadow Savings Bank, its successors and assigns Summit Ridge Bank"
    assert r["original_mortgagee"]["value"] == "Meadow Savings Bank"


def test_bare_addresses_skip_other_peoples(spark):
    texts = [("law firm at 1 Elm St, Weslaco, TX 78596 and 2 Oak St, Weslaco, TX 78596",), ("x 3 Elm St, Dallas, TX 75001",), ("Lot here 4 Elm St, Weslaco, TX 78596",)]
    got = [r["a"] for r in spark.createDataFrame(texts, "text string").select(extract.stated_address(F.col("text")).alias("a")).collect()]
    assert got[0] is None and got[1] is None and got[2]["text"] == "4 Elm St, Weslaco, TX 78596"


def _pair(spark, case, record):
    base = dict(case_id=1, owner_names=["Ana Belt"], city=None, parcel_id=None, geographic_id=None, legal_text=None, subdivision=None, lot=None, block=None, acreage=None, mailing_address=None)
    rec = dict(candidate_id="r", owner_name="BELT ANA", situs_address=None, city=None, parcel_id=None, geographic_id=None, legal_text=None, subdivision=None, lot=None, block=None, acreage=None)
    c = "struct<case_id:int,owner_names:array<string>,city:string,parcel_id:string,geographic_id:string,legal_text:string,subdivision:string,lot:string,block:string,acreage:double,mailing_address:string>"
    r = "struct<candidate_id:string,owner_name:string,situs_address:string,city:string,parcel_id:string,geographic_id:string,legal_text:string,subdivision:string,lot:string,block:string,acreage:double>"
    df = spark.createDataFrame([(tuple((base | case).values()), tuple((rec | record).values()))], f"c {c}, r {r}")
    return match.score(df).first()


def test_scores_and_floors(spark):
    assert _pair(spark, {"parcel_id": "7"}, {"parcel_id": "7"})["score"] == 0.99
    assert _pair(spark, {}, {})["score"] == 0.65
    lots = {"subdivision": "Oak Ridge", "lot": "14"}
    assert _pair(spark, lots, lots)["score"] == 0.97
    clash = _pair(spark, lots, {"subdivision": "OAK RIDGE", "lot": "9", "parcel_id": "7"})
    assert clash["conflicting"] == ["lot"] and clash["score"] == 0.0
    other = _pair(spark, {"parcel_id": "7"}, {"parcel_id": "7", "owner_name": "DOVE CARL"})
    assert other["conflicting"] == ["ownerName"] and abs(other["score"] - 0.3) < 1e-9


def test_decisions(spark):
    rows = [(1, "a", 0, 0.97, ["parcelId"], []), (1, "b", 0, 0.80, ["city"], []), (2, "a", 0, 0.97, ["parcelId"], []), (2, "b", 0, 0.83, ["city"], []), (3, "a", 0, 0.95, ["ownerName"], []), (4, "a", 0, 0.95, ["parcelId"], ["ownerName"]), (5, "a", 0, 0.2, [], [])]
    df = spark.createDataFrame(rows, "case_id int, candidate_id string, strategy int, score double, matched array<string>, conflicting array<string>")
    got = {r["case_id"]: r for r in match.decide(df).collect()}
    assert got[1]["selected_id"] == "a" and not got[1]["requires_review"]
    assert all(got[k]["selected_id"] is None and got[k]["requires_review"] for k in (2, 3, 4, 5))
    assert got[5]["method"] == "unresolved" and got[5]["matched"] == []


def test_duplicate_tiers(spark):
    snap = "struct<borrower_names:array<string>,property_address:string,subdivision:string,lot:string,principal_cents:bigint,sale_date:string,deed_date:string,lender_name:string,raw_text:string>"
    base = (["Ana Belt"], "12 Elm St", "Oak Ridge", "1", 100, "2026-08-04", "2019-03-05", "Summit Bank", "2026-12345-TX x")
    change = lambda **k: tuple(k.get(n, b) for n, b in zip(("names", "addr", "sub", "lot", "cents", "sale", "deed", "lender", "raw"), base))
    rows = [(1, 0.0, base, change(raw=None)), (2, 0.0, base, base), (3, 0.95, change(raw=None), change(lot="2")), (4, 0.0, change(raw=None), change(addr=None, sub=None, cents=None, deed=None, lender=None))]
    got = {r["k"]: r for r in dedup.score_pairs(spark.createDataFrame(rows, f"k int, dice double, a {snap}, b {snap}")).collect()}
    assert got[1]["confidence"] == "LIKELY_SAME_EVENT" and got[2]["confidence"] == "CONFIRMED_SAME_EVENT"
    assert got[3]["confidence"] is None and "legalDescription" in got[3]["conflicting"]
    assert got[4]["confidence"] == "POSSIBLE_DUPLICATE"
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_blocked_pairs_are_all_pairs(spark):
    import itertools
    import random

    rng = random.Random(5)
    text = lambda: " ".join(rng.choice("abcdefghij") for _ in range(30))
    base, texts, rows = text(), [text() for _ in range(3)], []
    for i in range(40):
        raw = rng.choice([None, "one", base, base + " x", "2026-12345-TX z", *texts])
        names = rng.choice([None, ["Ana Belt"], ["Ana Belt", "Bo Cole"], ["Dee Fox"]])
        rows.append((i, names, rng.choice(["1 Elm", "11 Elm.", "2 Elm", None]), rng.choice(["Oak", "oak park", None]), rng.choice(["1", "2", None]), rng.choice([1, 2, 3, None]), f"d{rng.randint(0, 4)}", f"e{i}", rng.choice(["Bank", "Bank One", "", None]), raw))
    rows += [(100, *rows[0][1:]), (101, *rows[0][1:]), (102, *rows[3][1:])]
    df = spark.createDataFrame(rows, "case_id int, borrower_names array<string>, property_address string, subdivision string, lot string, principal_cents long, sale_date string, deed_date string, lender_name string, raw_text string")

    def dice(x, y):
        x, y = (set(zip((t or "").split(), (t or "").split()[1:])) for t in (x, y))
        return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0

    want = {}
    for x, y in itertools.combinations(rows, 2):
        near = dice(x[9], y[9])
        key = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").upper()).split())
        held = lambda p, q: bool(key(p) and key(q)) and (key(p) in key(q) or key(q) in key(p))
        equal = sum(x[k] is not None and x[k] == y[k] for k in (5, 6, 7)) + held(x[2], y[2]) + held(x[8], y[8]) + any(held(p, q) for p in x[1] or [] for q in y[1] or [])
        equal += held(x[3], y[3]) and (x[4] is None or y[4] is None or x[4] == y[4])
        if near >= 0.9 or equal >= 2 or (x[9] and x[9] == y[9] and x[9].startswith("2026")):
            want[x[0], y[0]] = near if near >= 0.9 else 0.0
    for block in (256, 3):
        got = dedup.class_members(dedup.blocked_pairs(df, block=block), dedup.snapshot_classes(df)).collect()
        assert len(got) == len(want)
        assert {(r["a"], r["b"]): round(r["dice"], 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_duplicate_tier_scores_all_pairs(spark):
    """Against every two notices of one house; near texts all share a field besides the lender."""
    from noticeloom.plans import catalogue, views

    d = "/root/testdata/sf0.001"
    n = views.notices(spark, d).select("doc_id", "house", "grantor", "kind", "lot", "dollars", "sale", "deed", "text").cache()
    got = catalogue.QUERIES["duplicate_tier"](spark, d).collect()
    pairs = [(r["case_a"], r["case_b"]) for r in got]
    x, y = n.alias("x"), n.alias("y")
    want = {tuple(r) for r in x.join(y, F.expr("x.house = y.house and x.doc_id < y.doc_id")).select("x.doc_id", "y.doc_id").collect()}
    assert len(pairs) == len(set(pairs)) and want <= set(pairs)
    near = dedup.dice_join(n, "doc_id", "text").alias("p").join(x, F.expr("x.doc_id = p.a")).join(y, F.expr("y.doc_id = p.b"))
    equal = " or ".join([*(f"x.{c} = y.{c}" for c in ("house", "grantor", "dollars", "sale", "deed")), "(x.kind = y.kind and x.lot = y.lot)"])
    assert near.where(f"not ({equal})").count() == 0


def test_dice_join_is_exact(spark):
    import random
    import re

    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(5):
            t = list(b)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(60)] = rng.choice(words)
            texts.append(" ".join(t))
    texts += ["", "one", texts[0]]
    grams = [set(zip(w, w[1:])) for w in (re.sub("[^A-Z0-9]+", " ", t.upper()).split() for t in texts)]
    first = {}
    for i, g in enumerate(grams):
        first.setdefault(frozenset(g), i)
    reps = [i for g, i in first.items() if g]
    want = {(a, b) for a in reps for b in reps if a < b and 2 * len(grams[a] & grams[b]) / (len(grams[a]) + len(grams[b])) >= 0.9}
    got = dedup.dice_join(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text").collect()
    assert {(r["a"], r["b"]) for r in got} == want and want


def test_canonical_and_archive(spark):
    at = datetime(2026, 1, 1)
    df = spark.createDataFrame([("c", 1, 10.0, datetime(2026, 1, 2), "Unknown owner", None), ("c", 2, 10.005, datetime(2026, 1, 3), "Ana", None), ("d", 3, 1.0, at, None, None)], "county string, case_id int, score double, created_at timestamp, borrower string, archived_at timestamp")
    chosen = dedup.canonical(df, ["county"])
    got = {r["county"]: r for r in chosen.collect()}
    assert got["c"]["canonical_id"] == 1 and got["c"]["n_tied"] == 2 and got["d"]["n_candidates"] == 1
    out = {r["case_id"]: r for r in dedup.archive_duplicates(df, chosen, ["county"], F.lit(at)).collect()}
    assert out[2]["merged_into"] == 1 and out[2]["archived_at"] and out[1]["borrower"] == "Ana" and out[1]["archived_at"] is None


def test_publication_ladder(spark):
    base = dict(archived_at=None, has_document=True, sale_date=date(2026, 8, 4), borrower="Ana", street="1 Elm", address_method="EXPLICIT_STATED", address_confidence=0.1, has_legal=True, cad_confirmed=True, open_reasons=["LOW_CONFIDENCE"], active_duplicate=False)
    changes = [{}, {"archived_at": date(2026, 1, 1)}, {"sale_date": None}, {"active_duplicate": True}, {"open_reasons": ["POOR_TEXT_QUALITY"]}, {"street": None}, {"street": None, "has_legal": False}, {"borrower": " Unknown Owner "}, {"cad_confirmed": False}, {"address_method": "GEOCODING"}]
    schema = "archived_at date, has_document boolean, sale_date date, borrower string, street string, address_method string, address_confidence double, has_legal boolean, cad_confirmed boolean, open_reasons array<string>, active_duplicate boolean"
    rows = [tuple((base | c).values()) for c in changes]
    got = [r["publication_status"] for r in publish.status(spark.createDataFrame(rows, schema)).collect()]
    limited = "PUBLISHED_WITH_LIMITED_DATA"
    assert got == ["PUBLISHED", "ARCHIVED", "WITHHELD", "PENDING_REVIEW", "PENDING_REVIEW", limited, "PENDING_REVIEW", limited, limited, limited]


def test_split_and_sources(spark, tmp_path):
    pages = spark.createDataFrame([("b", 1, "cover", 90.0, "VG-1-2026-7"), ("b", 2, "more", 80.0, None), ("b", 3, "next", 70.0, "VG-1-2026-8")], readers.PAGES)
    got = {r["doc_number"]: r for r in split.notices(pages).collect()}
    assert got["7"]["text"] == "cover\n\nmore" and got["7"]["end_page"] == 2 and got["7"]["confidence"] == 85.0 and got["8"]["start_page"] == 3
    (tmp_path / "n1.txt").write_text("one")
    source = readers.TextFolder("folder", str(tmp_path))
    readers.register(source)
    assert readers.county_source("folder").discover(spark).first()["external_id"] == "n1.txt"
    raw = spark.createDataFrame([("1", "BELT ANA", None, "1 ELM", "N/A", "1,250.5", "OAK RIDGE SUBDIVISION LOT 4, BLOCK 2", "")], "property_id string, display_name string, situs string, street_primary string, legal_acreage string, market_value string, legal_description string, lot string")
    full = raw.withColumns({c: F.lit(None).cast("string") for c in ("city", "parcel_id", "geo_id", "subdivision", "block", "size_acres", "class_code", "appraised_value", "tax_year")})
    r = readers.map_appraisal_rows(full).first()
    assert (r["lot"], r["block"], r["acreage"], r["market_cents"], r["situs_address"]) == ("4", "2", None, 125050, "1 ELM")
    sinks.swap_table(spark.range(3), str(tmp_path / "t"))
    sinks.swap_table(spark.range(5), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5


def test_rate_limit_is_the_loop(spark):
    import random

    rng = random.Random(5)
    rows = [(i, rng.randrange(3), datetime.fromtimestamp(1_700_000_000 + rng.randrange(20_000))) for i in range(200)]
    got = {r["event_id"]: r["allowed"] for r in events.rate_limited(spark.createDataFrame(rows, "event_id int, user_id int, ts timestamp"), "user_id", "ts", "event_id", 600.0, 2).collect()}
    want, state = {}, {}
    for i, u, t in sorted(rows, key=lambda r: (r[2], r[0])):
        opened, n = state.get(u, (None, 0))
        opened, n = (t, 1) if opened is None or (t - opened).total_seconds() >= 600 else (opened, n + 1)
        state[u], want[i] = (opened, n), n <= 2
    assert got == want


def test_stream_is_batch(spark, tmp_path):
    rows = [Row(id=i, key=i % 4, ts=datetime(2026, 1, 1, 0, i)) for i in range(20)]
    df = spark.createDataFrame(rows)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.idempotent_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["key"])
    q = stream.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == events.idempotent(df, ["key"], ["ts"]).count() == 4


def test_filter_validation():
    import pytest

    for bad in ({"page": 0}, {"page_size": 101}, {"value_min_cents": 2, "value_max_cents": 1}, {"city": ""}, {"min_address_confidence": 2.0}):
        with pytest.raises(ValueError):
            ListingFilter(**bad)


def test_duplicate_tier_takes_equal_names_as_its_sql(spark, tmp_path):
    """Houses 1 and 11 of one lot, owned by "cold rod" and "old rod": one name holds the other, which SQL does not count."""
    import duckdb

    from noticeloom.plans import catalogue
    from noticeloom.plans import search  # noqa: F401

    spark.sql("select * from values (1L, 'cold rod', 'SMALL', 7), (11L, 'old rod', 'SMALL', 7) t(p_partkey, p_name, p_type, p_size)").write.parquet(f"{tmp_path}/part.parquet")
    rows = "(1L, 1L, timestamp'1995-01-02', 1000.5D), (2L, 11L, timestamp'1996-03-04', 2000.5D), (3L, 11L, timestamp'1997-05-06', 2000.7D)"
    spark.sql(f"select * from values {rows} t(o_orderkey, o_custkey, o_orderdate, o_totalprice)").write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    for name in ("part", "orders"):
        db.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = db.execute(catalogue.ORACLES["duplicate_tier"]).fetchall()
    got = [tuple(r) for r in catalogue.QUERIES["duplicate_tier"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(want) == 3
