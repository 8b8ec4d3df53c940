"""Searches and matches over values that very many rows share: the same results as comparing all, without making all pairs."""

import random

from pyspark.sql import functions as F

from noticeloom.operators import dedup, match


def test_legacy_rows_match_without_pairs(spark):
    """Against every two rows; lists of names that share most of the shorter one are met by their rarest words."""
    rnd = random.Random(5)
    words = ["ANA", "BELT", "CRUZ", "DEE", "ELM", "FOX"]
    make = lambda n: [(k, *(rnd.choice([None, "x", "x", "y", str(k)]) for _ in "abc"), rnd.sample(words, rnd.choice([0, 1, 2, 3, 4])) or None) for k in range(n)]
    left, right = make(120), make(90)
    alike = lambda x, y: bool(x and y) and len(set(x) & set(y)) / min(len(x), len(y)) >= 0.6
    want = {}
    for l in left:
        n, r = max(((sum(a is not None and a == b for a, b in zip(l[1:4], r[1:4])) + alike(l[4], r[4]), -r[0]) for r in right))
        want[l[0]] = ("B" if n >= 3 else "E" if n else "C", -r if n else None, n)
    shape = "id int, a string, b string, c string, names array<string>"
    frame = lambda rows, i: spark.createDataFrame(rows, shape).withColumnRenamed("id", i).withColumn("number", F.lit(None).cast("string")).withColumn("instrument", F.lit(None).cast("string"))
    one, two = frame(left, "legacy_id"), frame(right, "case_id")
    got = {r["legacy_id"]: (r["class"], r["match_id"], r["n_equal"]) for r in dedup.legacy_matches(one, two, ["a", "b", "c"]).collect()}
    assert got == want
    lists = lambda df: df.where("names is not null").select(F.array_sort("names").alias("names")).distinct()
    pairs = {(tuple(r["x"]), tuple(r["y"])) for r in dedup.alike_names(lists(one), lists(two), block=3).collect()}
    told = lambda rows: {tuple(sorted(r[4])) for r in rows if r[4]}
    assert pairs == {(x, y) for x in told(left) for y in told(right) if alike(x, y)}


def test_acreage_is_part_of_the_join(spark, capsys):
    """Owners of one surname meet a case only where acreages are near, also at the edges of cells; nothing of rows is a broadcast."""
    none = "cast(null as string)"
    cases = spark.range(40).selectExpr("'x' county", "id case_id", "array('Ana Belt') owner_names", "id * 0.05D + 0.001D acreage", *(f"{none} {c}" for c in ("stated_address", "parcel_id", "geographic_id", "subdivision", "legal_text", "lot", "block")))
    records = spark.range(200).selectExpr("'x' county", "cast(id as string) candidate_id", "'BELT, ANA' owner_name", "id * 0.01D acreage", *(f"{none} {c}" for c in ("situs_address", "parcel_id", "geographic_id", "subdivision", "legal_text", "lot", "block")))
    got = match.search_properties(cases, records)
    assert {(r["case_id"], int(r["candidate_id"])) for r in got.collect()} == {(c, r) for c in range(40) for r in range(200) if abs(c * 0.05 + 0.001 - r * 0.01) < 0.05}
    got.explain()
    plan = capsys.readouterr().out
    assert "cell" in plan and "BroadcastHashJoin" not in plan


def test_names_spelt_out_before_score_the_same(spark):
    none = "cast(null as string)"
    owners = ["array('Ana Belt')", "array('Belt Ana', 'Cruz Dee Jr')", "array('Fox Holdings LLC')", "cast(null as array<string>)", "array(cast(null as string))"]
    case = lambda k, o: spark.range(1).selectExpr(f"{k} case_id", f"{o} owner_names", f"'P{k}' parcel_id", "0.5D acreage", *(f"{none} {c}" for c in match.CASE if c not in ("case_id", "owner_names", "parcel_id", "acreage")))
    cases = case(0, owners[0])
    for k, o in enumerate(owners[1:], 1):
        cases = cases.unionByName(case(k, o))
    records = spark.createDataFrame([(str(k), o) for k, o in enumerate(["BELT, ANA", "DEE CRUZ", "FOX HOLDINGS LLC", "ELM A & B", None, ""])], "candidate_id string, owner_name string")
    records = records.selectExpr("*", "concat('P', candidate_id) parcel_id", "0.52D acreage", *(f"{none} {c}" for c in match.RECORD if c not in ("candidate_id", "owner_name", "parcel_id", "acreage")))
    told = lambda c, r: sorted(match.score(cases.select(c.alias("c")).crossJoin(records.select(r.alias("r")))).select("c.case_id", "r.candidate_id", "score", "matched", "conflicting").collect())
    assert told(match.case_side(), match.record_side()) == told(F.struct(*match.CASE), F.struct(*match.RECORD))


def test_any_import_of_plans_has_all_queries():
    import subprocess
    import sys

    told = subprocess.run([sys.executable, "-c", "from noticeloom.plans import catalogue; print('duplicate_tier' in catalogue.QUERIES)"], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert told.stdout.strip() == "True"


def test_pairs_fall_together_as_keys(spark, capsys):
    """Before the texts of cases and records are made."""
    from noticeloom.plans import further

    further._pairs(spark, "/root/testdata/sf0.001").explain()
    grouped = [line for line in capsys.readouterr().out.splitlines() if "HashAggregate" in line]
    assert grouped and not any("owner_name" in line or "c#" in line for line in grouped)


def test_tiered_pairs_are_all_pairs_with_a_tier(spark):
    """Against every two rows scored, with values that hold others and rows that lack them; a day that all rows share makes no pairs."""
    rnd = random.Random(7)
    shape = "case_id int, borrower_names array<string>, property_address string, subdivision string, lot string, principal_cents long, sale_date string, deed_date string, lender_name string, raw_text string"

    def rows(n, addresses, subs):
        return [(k, [rnd.choice(["Ana Belt", "Bo Cole"])], rnd.choice(addresses), rnd.choice(subs), rnd.choice(["1", "2", "-", None, ""]), rnd.choice([1, 2, None]), "s", "d", "Bank", rnd.choice([None, f"2026-12345-TX {k}"])) for k in range(n)]

    for addresses, subs in ((["1 Elm", "11 Elm.", "2 Elm"], ["Oak", "oak park"]), (["1 Elm", "2 Elm", None, ""], ["Oak", "Pine", None])):
        made = rows(40, addresses, subs)
        df = spark.createDataFrame([*made, (100, *made[0][1:])], shape)
        x, y = (df.select(F.struct("*").alias(k)) for k in "ab")
        scored = dedup.score_pairs(x.crossJoin(y).where("a.case_id < b.case_id").withColumn("dice", F.lit(0.0)))
        want = {(r["a"]["case_id"], r["b"]["case_id"]) for r in scored.where("confidence is not null").collect()}
        got = [(r["a"], r["b"]) for r in dedup.class_members(dedup.tiered_pairs(df, block=3), dedup.snapshot_classes(df)).collect()]
        assert len(got) == len(set(got)) and want <= set(got)
        assert None in addresses or want == set(got)


def test_scored_candidates_fall_together_as_keys(spark, capsys):
    """Before the structs of cases and records are made."""
    from noticeloom.plans import catalogue

    catalogue.QUERIES["candidate_score"](spark, "/root/testdata/sf0.001").explain()
    grouped = [line for line in capsys.readouterr().out.splitlines() if "HashAggregate" in line]
    assert grouped and not any("parcel_id" in line or "c#" in line for line in grouped)


def test_bundles_are_read_in_batches_of_letters(tmp_path):
    """Whatever the number of pages; a page longer than a batch is one alone."""
    from noticeloom.sources import county

    pages = ["a" * 600, "b" * 600, "", "c" * 5000, "d"]
    (tmp_path / "one.txt").write_text("\f".join(pages))
    found = list(county.BundleReader(county.Folder(str(tmp_path))).read(county.Bundle("one.txt")))
    assert [b.num_rows for b in found] == [5] and found[0].to_pydict()["page_no"] == [1, 2, 3, 4, 5]
    small = list(county.Folder(str(tmp_path)).batches("one.txt", 1000))
    assert [b.num_rows for b in small] == [1, 2, 1, 1] and [t for b in small for t in b.to_pydict()["text"]] == pages


def test_sets_of_texts_are_made_once(spark, capsys):
    """No step after them reads the texts again; their hashes tell the same as the bigrams' texts."""
    from noticeloom.functions import text as T

    df = spark.createDataFrame([(1, "Doc-1 a b a b"), (2, "a  b, a"), (3, ""), (4, None), (5, "one")], "id int, text string")
    dedup.dice_join(df, "id", "text").explain()
    dedup.text_classes(df, "id", "text").explain()
    assert "regexp_replace" not in capsys.readouterr().out
    sizes = [(r[0], r[1]) for r in df.select(F.size(T.bigram_hashes("text")), F.size(T.word_bigrams("text"))).collect()]
    assert [n for n, _ in sizes] == [2, 2, 0, 0, 0] and [m for _, m in sizes][:3] == [2, 2, 0]
    assert {r["id"]: r["class_id"] for r in dedup.text_classes(df, "id", "text").collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_pairs_of_names_are_told_without_a_shuffle_of_pairs(spark, capsys):
    """Random cases of few values, so that most pairs are found by several searches: against each search alone. What a name finds is not gathered by pair."""
    import random

    rng, some = random.Random(11), lambda *x: rng.choice([None, *x])
    names, places, streets = ("Ana Belt", "Bo Belter", "Cy Fox"), ("OAK", "OAK PARK", "ELM 1"), ("1 Elm St", "11 Elm St", "2 Oak Ave")
    shape = "county string, case_id int, owner_names array<string>, stated_address string, parcel_id string, geographic_id string, legal_text string, subdivision string, lot string, block string, acreage double"
    cases = spark.createDataFrame([("x", k, [n] if (n := some(*names)) else None, some(*streets), some("p1", "p2"), some("G1", "G12"), some("LOT 1 OAK", "OAK PARK"), some(*places), some("1", "2"), some("1"), some(0.5, 0.52, 0.6)) for k in range(60)], shape)
    shape = "county string, candidate_id string, owner_name string, situs_address string, parcel_id string, geographic_id string, legal_text string, subdivision string, lot string, block string, acreage double"
    records = spark.createDataFrame([("x", str(k), some("BELT ANA", "BELTER, BO", "FOX"), some(*streets), some("p1", "p2"), some("G12", "G123"), some("LOT 1 OAK PARK", "LOT 2 ELM 1"), some(*places), some("1", "2"), some("1", "2"), some(0.5, 0.53, 0.6)) for k in range(40)], shape)
    got = match.candidates(cases, records)
    asked = cases.select("*", F.explode(match.searches_of()).alias("_k"))
    each = match._searched(asked.withColumn("case_id", F.col("case_id") * 8 + F.col("_k")).withColumn("_searches", F.array("_k")), records, "county", single=True)
    want = each.groupBy(F.floor(F.col("case_id") / 8).alias("c"), "candidate_id").agg(F.min("strategy").alias("s"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {tuple(r) for r in want.collect()} and {r[2] for r in rows} == set(range(8))
    got.explain()
    plan = capsys.readouterr().out.split("Physical Plan", 1)[1].splitlines()
    top = next(line for line in plan[1:] if not any(x in line for x in ("Adaptive", "==", "QueryStage")))
    assert top.lstrip("+-: ").startswith("Union"), top


def test_decide_gathers_few_rows_a_case(spark, capsys):
    """Leads over random candidates with many ties, against sorting them all; the plan sorts no case's candidates."""
    rng = random.Random(7)
    rows = [(k % 9, f"r{k}", rng.randint(0, 3), rng.choice([0.5, 0.9, 0.97, 0.97]), ["parcelId"], []) for k in range(60)] + [(50, "only", 0, 0.95, ["parcelId"], [])]
    got = match.decide(spark.createDataFrame(rows, "case_id int, candidate_id string, strategy int, score double, matched array<string>, conflicting array<string>"))
    for r in got.collect():
        own = sorted((x for x in rows if x[0] == r["case_id"]), key=lambda x: (-x[3], x[2], x[1]))
        lead = round(own[0][3] - own[1][3], 9) if len(own) > 1 else own[0][3]
        assert (r["confidence"], r["candidate_count"]) == (own[0][3], len(own))
        assert r["selected_id"] == (own[0][1] if own[0][3] >= 0.92 and (len(own) == 1 or lead >= 0.15) else None)
    got.explain()
    assert "Window" not in capsys.readouterr().out


def test_tiered_scores_shuffle_no_pairs(spark, capsys):
    """Random rows of few places with and without all fields, against every two rows; rows of a place meet in blocks, both sides of a join are one shuffle."""
    import itertools

    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") for _ in range(30)) for _ in range(3)]
    shape = "case_id int, borrower_names array<string>, property_address string, subdivision string, lot string, principal_cents long, sale_date string, deed_date string, lender_name string, raw_text string"
    row = lambda k, lack: (k, rng.choice([None, ["Old Rod"], ["Cold Rod"]]), rng.choice(["1 Elm", "11 Elm."] + [None] * lack), rng.choice(["Oak", "oak park"] + [None] * lack), rng.choice(["1", "2", None]), rng.choice([1, 2, None]), rng.choice(["d", None]), f"e{k % 5}", rng.choice(["Bank", "", None]), rng.choice(base) + f" {rng.choice('kl')}")
    for lack in (0, 1):
        rows = [row(k, lack) for k in range(45)]
        rows += [(45, *rows[0][1:]), (46, *rows[0][1:])]
        df = spark.createDataFrame(rows, shape)
        every = df.alias("x").join(df.alias("y"), F.expr("x.case_id < y.case_id")).select(F.col("x.case_id").alias("a"), F.col("y.case_id").alias("b"), F.struct(*(f"x.{c}" for c in dedup.SCORED)).alias("_a"), F.struct(*(f"y.{c}" for c in dedup.SCORED)).alias("_b"))
        told = dedup.text_dice(every, df, "a", "b", "case_id", "raw_text").select("a", "b", "dice", F.col("_a").alias("x"), F.col("_b").alias("y"))
        for equal in (lack == 0,):
            pairs = told.select(F.col("a").alias("case_a"), F.col("b").alias("case_b"), "dice", F.col("x").alias("a"), F.col("y").alias("b"))
            shown = lambda d: sorted(map(tuple, d.where("confidence is not null").select("case_a", "case_b", F.round("score", 6), "confidence", F.array_join("matched", ",")).collect()))
            want = shown(dedup.score_pairs(pairs, equal))
            got = dedup.tiered_scores(df, block=7, equal_names=equal)
            assert shown(got) == want and len(want) > 100 and "CONFIRMED_SAME_EVENT" in {r[3] for r in want}
            if not lack:
                seen = got.where("score >= 0")
                seen.collect()
                seen.explain()
                plan = capsys.readouterr().out.split("Initial Plan", 1)[0]
                # Above the join of rows nothing is dealt out again, and its second side is the first one's shuffle.
                assert "Exchange" not in plan.split("SortMergeJoin", 1)[0] and "ReusedExchange" in plan


def test_bigrams_of_one_text_are_counted_and_do_not_travel(spark, capsys):
    """Texts of few shared words: pairs as of whole sets, and bigrams of one text are left out before lists are gathered."""
    import re

    words = [f"w{k}" for k in range(40)]
    texts = [" ".join([*words, f"own{k}"]) for k in range(3)] + [" ".join(words[:20] + [f"x{k}{j}" for j in range(20)]) for k in range(3)]
    got = dedup.dice_join(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t")
    assert {(r["a"], r["b"]): round(r["dice"], 9) for r in got.collect()} == {(a, b): round(39 * 2 / 80, 9) for a, b in ((0, 1), (0, 2), (1, 2))}
    dedup.dice_join(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t").explain()
    assert re.search(r"Filter \(often#\d+L? > 1\)", capsys.readouterr().out)
