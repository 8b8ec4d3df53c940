"""Containment searches against brute force, and all eight candidate searches with contained values."""

import random

from noticeloom.operators import contain, match


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_containing_is_brute_force(spark):
    rng = random.Random(1)
    text = lambda lo, hi: "".join(rng.choice("ab é") for _ in range(rng.randint(lo, hi)))
    needles = [(rng.choice("xy"), text(0, 6)) for _ in range(60)] + [("x", "ab"), ("x", "ab"), (None, "ab"), ("x", None)]
    hays = [(rng.choice("xy"), text(0, 25)) for _ in range(80)] + [("x", "zz ab zz")] * 3 + [(None, "abab"), ("y", None)]
    n, h = (spark.createDataFrame(rows, f"county string, {name} string") for rows, name in ((needles, "needle"), (hays, "hay")))
    for starts in (False, True):
        want = sorted({(c, a, b) for c, a in needles for d, b in hays if c and c == d and a and b and (b.startswith(a) if starts else a in b)})
        for block in (2, 512):
            assert pairs(contain.containing(n, h, ["county"], starts=starts, block=block)) == want
    words = sorted({(a, b) for _, a in needles for _, b in hays if a and b and a.split() and set(a.split()) <= set(b.split())})
    assert pairs(contain.holding_words(n, h, block=3)) == words


def test_containing_long_texts_and_nothing(spark):
    long_ = "lorem ipsum " * 5000 + "needle in it"
    n, h = spark.createDataFrame([("needle in",), ("absent",), ("m",)], "needle string"), spark.createDataFrame([(long_,), ("other",)], "hay string")
    assert {(a, len(b)) for a, b in pairs(contain.containing(n, h))} == {("needle in", len(long_)), ("m", len(long_))}
    assert pairs(contain.containing(n.limit(0), h)) == [] and pairs(contain.containing(n, h.limit(0))) == []


def test_a_gram_that_all_hold_is_met_in_blocks(spark):
    n = spark.range(0, 400).selectExpr("concat('same', id % 20) as needle")
    h = spark.range(0, 3000).selectExpr("concat('the same', id) as hay")
    met = contain.containing(n, h, block=64)
    assert met.count() == sum(f"the same{k}".find(f"same{j}") >= 0 for k in range(3000) for j in range(20))
    sizes = met.withColumnRenamed("needle", "n").groupBy("n").count().collect()
    assert len(sizes) == 20


CASE = "county string, case_id int, owner_names array<string>, city string, parcel_id string, geographic_id string, legal_text string, subdivision string, lot string, block string, acreage double, mailing_address string, stated_address string"
RECORD = "county string, candidate_id string, owner_name string, situs_address string, city string, parcel_id string, geographic_id string, legal_text string, subdivision string, lot string, block string, acreage double"


def test_eight_searches_find_what_contains(spark):
    case = lambda i, **k: tuple({**dict.fromkeys(f.split()[0] for f in CASE.split(", ")), "county": "x", "case_id": i, **k}.values())
    record = lambda i, **k: tuple({**dict.fromkeys(f.split()[0] for f in RECORD.split(", ")), "county": "x", "candidate_id": i, **k}.values())
    cases = [
        case(0, stated_address="12 N Oak St, Mission, TX 78572"), case(1, parcel_id="P1"), case(2, geographic_id="S12"), case(3, subdivision="Sol Brilla Subdivision", lot="4"),
        case(4, legal_text="LOT 9 (illegible) OAK #2"), case(5, owner_names=["Ana Belt"], subdivision="Palm Park"), case(6, owner_names=["Ana Cruz"], acreage=1.0), case(7, owner_names=["Ana Dorn", "Zed Other"]),
        case(8, owner_names=["Zoe Erne"]), case(9, subdivision="Sol Brilla", lot="99"), case(10),
    ]
    records = [
        record("a", situs_address="112 OAK ST UNIT 4"), record("b", situs_address="12 ELM ST"), record("c", parcel_id="P1"), record("d", parcel_id="P12"), record("e", geographic_id="S1234"), record("f", geographic_id="XS12"),
        record("g", subdivision="SOL BRILLA PH 2", lot="4"), record("h", legal_text="SOL BRILLA LOT 5", lot="5"), record("i", legal_text="TR A LOT 9 OAK 2 BLK 1"), record("j", subdivision="PALM ESTATES", owner_name="BELTRAN ANA"),
        record("k", subdivision="PALM", owner_name="OTHER"), record("l", owner_name="CRUZ ANA", acreage=1.02), record("m", owner_name="CRUZADO B", acreage=1.2), record("n", owner_name="DORN ANA MARIA"), record("o", owner_name="DORN X"),
        record("p", owner_name="ERNESTO L"), record("q", owner_name="LUIS ERNE"), record("r", owner_name="ANA CRUZ", acreage=1.0),
    ]
    other = [("y", *r[1:]) for r in records]
    got = pairs(match.candidates(spark.createDataFrame(cases, CASE), spark.createDataFrame(records + [(c, f"{i}'", *r) for c, i, *r in other], RECORD)))
    assert got == sorted([
        (0, "a", 0), (1, "c", 1), (2, "e", 2), (3, "g", 3), (4, "i", 4), (5, "j", 3), (5, "k", 3), (6, "l", 6), (6, "r", 7), (7, "n", 7), (8, "p", 7), (9, "g", 3), (9, "h", 3),
    ])
