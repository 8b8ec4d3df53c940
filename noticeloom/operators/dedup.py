"""Duplicate notices: identity keys, weighted evidence, an exact text join, canonical rows."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import names as N
from ..functions import text as T
from ..sources.stage import written
from . import contain


def identity_key(county, filing_number) -> Column:
    """struct<county, number>, null without a usable filing number."""
    number = T.filing_number(filing_number)
    return F.when(number.isNotNull() & T._col(county).isNotNull(), F.struct(T._col(county).alias("county"), number.alias("number")))


def new_cases(batch: DataFrame, known: DataFrame, county: str, filing_number: str, order: list[str]) -> DataFrame:
    """Rows of a batch whose identity is neither known (archived cases aside) nor earlier in the batch.

    Rows without a filing number all stay, with reason MISSING_FILING_NUMBER.
    """
    keyed = batch.withColumn("_id", identity_key(county, filing_number))
    seen = known.where("archived_at is null").select(identity_key(county, filing_number).alias("_id")).where("_id is not null").distinct()
    named = keyed.where("_id is not null").join(seen, "_id", "left_anti")
    first = named.withColumn("_n", F.row_number().over(Window.partitionBy("_id").orderBy(*order))).where("_n = 1").drop("_n")
    none = keyed.where("_id is null").withColumn("review_reason", F.lit("MISSING_FILING_NUMBER"))
    return first.withColumn("review_reason", F.lit(None).cast("string")).unionByName(none).drop("_id")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row, with their number."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def group_totals(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: documents, distinct keys, groups of several, rows in them, rows beyond the first."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    big = F.when(F.col("n") > 1, F.col("n"))
    zero = F.lit(0).cast("long")
    return sizes.agg(
        F.coalesce(F.sum("n"), zero).alias("documents"), F.count(F.lit(1)).alias("distinct_keys"), F.count(big).alias("groups"),
        F.coalesce(F.sum(big), zero).alias("grouped_rows"), F.coalesce(F.sum(big - 1), zero).alias("extra_rows"),
    )


def snapshot_side() -> Column:
    """A snapshot with its texts normalised, as `score_pairs` also takes it: this takes long, and a case meets many cases."""
    keys = [T.comparison_key(n).alias(n) for n in ("property_address", "subdivision", "lot", "lender_name")]
    names = F.filter(F.transform("borrower_names", T.comparison_key), lambda n: n != "").alias("borrower_names")
    return F.struct(*keys, names, (F.coalesce(F.size("borrower_names"), F.lit(0)) > 0).alias("named"), (F.coalesce(F.length("lot"), F.lit(0)) > 0).alias("has_lot"), "principal_cents", "sale_date", "deed_date", T.tracking_number("raw_text").alias("track"))


def score_pairs(pairs: DataFrame, equal_names: bool = False) -> DataFrame:
    """Pairs with structs `a` and `b` (snapshots) and `dice`: adds matched, conflicting, score, confidence.

    A snapshot: borrower_names, property_address, subdivision, lot, principal_cents, sale_date, deed_date,
    lender_name, raw_text. What is missing neither matches nor conflicts. Borrowers match where one name holds the other ("COLD ROD"
    holds "OLD ROD"), with `equal_names` only where names are equal.
    """
    a, b = F.col("a"), F.col("b")
    ready = "has_lot" in pairs.schema["a"].dataType.names
    key = (lambda c: c) if ready else T.comparison_key
    known = lambda n: (F.coalesce(F.length(a[n].cast("string")), F.lit(0)) > 0) & (F.coalesce(F.length(b[n].cast("string")), F.lit(0)) > 0)
    alike = lambda n: T.overlap(a[n], b[n], key)
    keyed = lambda n: (F.coalesce(F.length(key(a[n])), F.lit(0)) > 0) & (F.coalesce(F.length(key(b[n])), F.lit(0)) > 0)
    other = lambda n: keyed(n) & ~alike(n)
    equal = lambda n: known(n) & (a[n] == b[n])
    both_lots, same_lot = a["has_lot"] & b["has_lot"] if ready else known("lot"), key(a["lot"]) == key(b["lot"])
    legal = alike("subdivision") & (~both_lots | same_lot)
    legal_conflict = other("subdivision") | (alike("subdivision") & both_lots & ~same_lot)
    spelt = lambda side: side["borrower_names"] if ready else F.filter(F.transform(side["borrower_names"], T.comparison_key), lambda n: n != "")
    named = a["named"] & b["named"] if ready else (F.coalesce(F.size(a["borrower_names"]), F.lit(0)) > 0) & (F.coalesce(F.size(b["borrower_names"]), F.lit(0)) > 0)
    shared = F.coalesce(F.arrays_overlap(spelt(a), spelt(b)), F.lit(False)) if equal_names else N.any_name(spelt(a), lambda x: F.exists(spelt(b), lambda y: F.contains(x, y) | F.contains(y, x)))
    track = a["track"] == b["track"] if ready else T.tracking_number(a["raw_text"]) == T.tracking_number(b["raw_text"])
    no = F.lit(False)
    tests = {
        "trusteeSaleTrackingNumber": (track, no), "rawTextFingerprint": (F.col("dice") >= fixed.SAME_TEXT, no),
        "propertyAddress": (alike("property_address"), other("property_address")), "legalDescription": (legal, legal_conflict),
        "borrowerNames": (named & shared, named & ~shared), "originalPrincipalAmount": (equal("principal_cents"), known("principal_cents") & (a["principal_cents"] != b["principal_cents"])),
        "deedOfTrustDate": (equal("deed_date"), no), "saleDate": (equal("sale_date"), known("sale_date") & (a["sale_date"] != b["sale_date"])),
        "lenderName": (alike("lender_name"), other("lender_name")),
    }
    # A join whose generated code holds all of this runs slowly: the steps stand apart.
    held = pairs.withColumns({f"_m_{n}": T.apart(F.coalesce(m, no)) if n == "lenderName" else F.coalesce(m, no) for n, (m, _) in tests.items()} | {f"_c_{n}": F.coalesce(c, no) & ~F.coalesce(m, no) for n, (m, c) in tests.items()})
    weight = sum((F.when(F.col(f"_m_{n}"), F.lit(fixed.DUPLICATE_WEIGHTS[n])).when(F.col(f"_c_{n}"), F.lit(fixed.DUPLICATE_CONFLICTS.get(n, 0.0))).otherwise(0.0) for n in tests), F.lit(0.0))
    listed = lambda p: F.concat(*(F.when(F.col(f"_{p}_{n}"), F.array(F.lit(n))).otherwise(F.array().cast("array<string>")) for n in tests))
    told = held.withColumns({"score": T.apart(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(weight, 9)))), "matched": listed("m"), "conflicting": listed("c")})
    decisive = F.col("_m_trusteeSaleTrackingNumber") | F.col("_m_rawTextFingerprint")
    independent = F.size(F.array_except("matched", F.array(F.lit("trusteeSaleTrackingNumber"), F.lit("rawTextFingerprint"))))
    loan = F.arrays_overlap("matched", F.array(*map(F.lit, fixed.LOAN_FIELDS)))
    apart = F.col("_c_propertyAddress") | F.col("_c_legalDescription")
    tier = F.when(apart, None).when(decisive, "CONFIRMED_SAME_EVENT").when((independent >= fixed.LIKELY_FIELDS) & loan, "LIKELY_SAME_EVENT").when(independent >= fixed.POSSIBLE_FIELDS, "POSSIBLE_DUPLICATE")
    return told.withColumn("confidence", tier).drop(*(f"_{p}_{n}" for p in "mc" for n in tests))


def text_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row with the smallest id of the rows with its set of word bigrams: id, class_id, grams.

    Texts without a bigram are alone.
    """
    own = df.select(F.col(id_col).alias("id"), F.sort_array(T.bigram_hashes(text_col)).alias("grams"))
    name = F.when(F.size("grams") > 0, F.struct(F.xxhash64("grams").alias("a"), F.hash("grams").alias("b"), F.size("grams").alias("n")))
    # Written once: sets take long to make, and are read several times.
    named = written(own.withColumn("_name", name), "text-sets")
    least = named.where("_name is not null").groupBy("_name").agg(F.min("id").alias("class_id"))
    return named.join(least, "_name", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), "grams")


def dice_join(df: DataFrame, id_col: str, text_col: str, least: float = fixed.SAME_TEXT) -> DataFrame:
    """Pairs a < b of class representatives whose word bigrams have a Dice of `least` or more: a, b, dice.

    Exact. Only representatives of equal bigram sets meet; `text_classes` tells the members. With r = least / (2 - least)
    linked sets share a bigram among the first n - ceil(r n) + 1 in any one order; taking the rarest first keeps
    those lists of sets short. Survivors of sizes that allow a link are decided by their whole sets.
    """
    ratio = least / (2 - least)
    reps = written(text_classes(df, id_col, text_col).where("id = class_id and size(grams) > 0").select("id", "grams", F.size("grams").alias("n")), "sets")
    each = reps.select("id", "n", F.explode("grams").alias("gram"))
    often = each.groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    # A bigram of one set alone links nothing but takes its place at the front of the order: it is counted, and travels no further.
    ranked = each.join(often.where("often > 1"), "gram").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("order"))
    taken = (F.col("n") - F.ceil(F.round(F.col("n") * ratio, 9)) + 1).cast("int") - (F.col("n") - F.size("order"))
    prefix = ranked.where(taken > 0).select("id", "n", F.explode(F.slice("order", F.lit(1), taken)).alias("p"))
    keys = prefix.select(F.col("p.gram").alias("key"), F.struct("id", "n").alias("id"), F.lit(False).alias("several"))
    met = met_by_key(keys).select("a.id", F.col("a.n").alias("na"), F.col("b.id").alias("b"), F.col("b.n").alias("nb")).withColumnRenamed("id", "a")
    met = met.where(F.least("na", "nb") >= F.round(F.greatest("na", "nb") * ratio, 9)).distinct()
    sets = reps.select("id", "grams")
    full = met.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("grams").alias("y")), "b")
    dice = F.size(F.array_intersect("x", "y")) * 2.0 / (F.col("na") + F.col("nb"))
    return full.select("a", "b", dice.alias("dice")).where(F.col("dice") >= least)


def text_dice(pairs: DataFrame, df: DataFrame, a: str, b: str, id_col: str, text_col: str) -> DataFrame:
    """Pairs with `dice`, the Dice of the word bigrams of both texts; 0 if either has none."""
    own = df.select(F.col(id_col).alias("_id"), T.bigram_hashes(text_col).alias("_g"))
    full = pairs.join(own.select(F.col("_id").alias(a), F.col("_g").alias("_x")), a).join(own.select(F.col("_id").alias(b), F.col("_g").alias("_y")), b)
    dice = F.coalesce(F.size(F.array_intersect("_x", "_y")) * 2.0 / F.nullif(F.size("_x") + F.size("_y"), F.lit(0)), F.lit(0.0))
    return full.withColumn("dice", dice).drop("_x", "_y")


#: What `score_pairs` reads of a case.
SCORED = ["borrower_names", "property_address", "subdivision", "lot", "principal_cents", "sale_date", "deed_date", "lender_name", "raw_text"]
#: Members of a key that meet in one block; longer keys meet block by block.
BLOCK = 256
#: Letters of a gram where numbered addresses are searched: it holds a number and what follows, so few hold it that do not hold the whole.
WHOLE = 12


def snapshot_classes(cases: DataFrame, id_col: str = "case_id") -> DataFrame:
    """Every row with the smallest id of the rows equal in all scored fields, and their number: id, class_id, members."""
    named = cases.select(F.col(id_col).alias("id"), F.sha2(F.to_json(F.struct(*SCORED)), 256).alias("_name"))
    least = named.groupBy("_name").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("members"))
    return named.join(least, "_name").select("id", "class_id", "members")


def class_members(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of classes (a, b, and more) as pairs a < b of all their rows; a = b stands for the pairs within a class."""
    one, two = (classes.select(F.col("class_id").alias(k), F.col("id").alias(f"_{k}")) for k in "ab")
    full = pairs.join(one, "a").join(two, "b").where("a <> b or _a < _b")
    return full.withColumns({"a": F.least("_a", "_b"), "b": F.greatest("_a", "_b")}).drop("_a", "_b")


def met_by_key(keyed: DataFrame, block: int = BLOCK) -> DataFrame:
    """All pairs a <= b of the ids of a key, of distinct rows (key, id, several); a = b only where `several` holds. Pairs repeat.

    A key's ids fall into blocks by hash and blocks meet two at a time, each two under a key of their own.
    """
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("several").alias("any")).where("n > 1 or any")
    cut = F.ceil(F.col("n") / block).cast("int")
    told = keyed.join(sizes, "key").withColumns({"cut": cut, "own": F.pmod(F.xxhash64("id"), cut).cast("int")}).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    dealt = told.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "several")
    one = dealt.where("own = i").select("key", "i", "j", F.col("id").alias("x"), "several")
    two = dealt.where("own = j").select("key", "i", "j", F.col("id").alias("y"))
    met = one.join(two, ["key", "i", "j"]).where("i <> j or x < y or (x = y and several)")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def met_between(keyed: DataFrame, block: int = BLOCK) -> DataFrame:
    """All pairs (x, y) of an id of a key that is `asking` and one that is not, of distinct rows (key, id, asking).

    Both sides of a key fall into blocks by hash, and blocks meet two at a time.
    """
    asks = F.col("asking")
    sizes = keyed.groupBy("key").agg(F.ceil(F.count_if(asks) / block).cast("int").alias("i_cut"), F.ceil(F.count_if(~asks) / block).cast("int").alias("j_cut")).where("i_cut > 0 and j_cut > 0")
    own = lambda cut: F.pmod(F.xxhash64("id"), F.col(cut)).cast("int")
    every = lambda cut: F.explode(F.sequence(F.lit(0), F.col(cut) - 1))
    one = keyed.where(asks).join(sizes, "key").withColumn("i", own("i_cut")).withColumn("j", every("j_cut")).select("key", "i", "j", F.col("id").alias("x"))
    two = keyed.where(~asks).join(sizes, "key").withColumn("j", own("j_cut")).withColumn("i", every("i_cut")).select("key", "i", "j", F.col("id").alias("y"))
    return one.join(two, ["key", "i", "j"]).select("x", "y")


def _alike(values: DataFrame) -> DataFrame:
    """(value, other) of distinct `value`s of which one holds the other, each with itself too; both ways."""
    met = contain.containing(values.withColumnRenamed("value", "needle"), values.withColumnRenamed("value", "hay"), gram=WHOLE).where("needle <> hay")
    ways = [values.select("value", F.col("value").alias("other")), met.select(F.col("hay").alias("value"), F.col("needle").alias("other")), met.select(F.col("needle").alias("value"), F.col("hay").alias("other"))]
    return functools.reduce(DataFrame.unionByName, ways)


def _linked(values: DataFrame, gram: int = contain.GRAM) -> DataFrame:
    """(id, value) with the keys under which equal and contained values meet: the value itself, and each pair of values of which one holds the other."""
    every = values.select("value").distinct()
    met = contain.containing(every.withColumnRenamed("value", "needle"), every.withColumnRenamed("value", "hay"), gram=gram).where("needle <> hay")
    pair = F.concat_ws("\x1e", "hay", "needle")
    links = met.select(F.col("hay").alias("value"), pair.alias("key")).unionByName(met.select(F.col("needle").alias("value"), pair.alias("key")))
    return values.select("id", F.col("value").alias("key")).unionByName(values.join(links, "value").select("id", "key"))


def blocked_pairs(cases: DataFrame, id_col: str = "case_id", least: float = fixed.SAME_TEXT, block: int = BLOCK) -> DataFrame:
    """Pairs a <= b of classes worth scoring, with dice where texts are near: same tracking number, near text, or two matching fields.

    Rows equal in all scored fields are a class (`snapshot_classes`) and its smallest id stands for it; a = b says that
    a class of several rows is worth scoring with itself, and `class_members` gives the pairs of rows. All classes of a
    key meet. Fields match as in `score_pairs`: names, addresses, subdivisions and lenders also where one holds the other, a lot
    also with a missing one. No pair that `score_pairs` gives a tier is left out.
    """
    alone = snapshot_classes(cases, id_col).where("id = class_id").select("id", (F.col("members") > 1).alias("several"))
    reps = cases.withColumnRenamed(id_col, "id").join(alone, "id")
    of = lambda value: reps.select("id", value.alias("value")).where("value <> ''")
    field = lambda df, name: df.select("id", F.lit(name).alias("field"), "key")
    legal = _linked(of(T.comparison_key("subdivision"))).join(reps.select("id", F.coalesce(T.comparison_key("lot"), F.lit("")).alias("lot")), "id")
    # A row without a lot is met by every lot of its subdivision.
    lots = legal.select("key", F.col("lot").alias("_lot")).distinct()
    placed = legal.where("lot <> ''").unionByName(legal.where("lot = ''").drop("lot").join(lots, "key").withColumnRenamed("_lot", "lot").select(*legal.columns))
    equal = {"principal": F.col("principal_cents").cast("string"), "deed": F.col("deed_date").cast("string"), "sale": F.col("sale_date").cast("string")}
    names = reps.select("id", F.explode(F.array_distinct(F.transform("borrower_names", T.comparison_key))).alias("value")).where("value <> ''")
    parts = [
        field(_linked(of(T.comparison_key("property_address"))), "address"), field(_linked(of(T.comparison_key("lender_name"))), "lender"), field(_linked(names), "names"),
        field(placed.select("id", F.concat_ws("\x1d", "key", "lot").alias("key")), "legal"), *(field(of(c).withColumnRenamed("value", "key"), n) for n, c in equal.items()),
    ]
    every = written(functools.reduce(DataFrame.unionByName, parts), "field-keys")
    two = every.alias("p").join(every.alias("q"), F.expr("p.id = q.id and p.field < q.field")).select(F.col("p.id").alias("id"), *(F.xxhash64(F.lit(k), "p.field", "p.key", "q.field", "q.key").alias(f"h{k}") for k in (0, 1)))
    tracked = of(T.tracking_number("raw_text")).select("id", *(F.xxhash64(F.lit(k), F.lit("track"), "value").alias(f"h{k}") for k in (0, 1)))
    keyed = two.unionByName(tracked).select(F.struct("h0", "h1").alias("key"), "id").distinct().join(alone, "id").select("key", "id", "several")
    # Equal texts meet by their class; near ones by their classes' representatives.
    texts = written(text_classes(reps, "id", "raw_text").where("size(grams) > 0").select("id", "class_id"), "text-classes")
    same = met_by_key(texts.join(alone, "id").select(F.col("class_id").alias("key"), "id", "several"), block).withColumn("dice", F.lit(1.0))
    near = class_members(dice_join(reps, "id", "raw_text", least), texts).select("a", "b", "dice")
    met = met_by_key(keyed, block).withColumn("dice", F.lit(0.0)).unionByName(same).unionByName(near)
    return met.groupBy("a", "b").agg(F.max("dice").alias("dice"))


def _parities() -> list[Column]:
    """Two words of 64 bits of the set `grams`: a bit is the parity of the grams that fall on it. Sets differ by as many grams as bits, or more."""
    bit = lambda g, k: F.when(F.shiftright(g, 6).bitwiseAND(F.lit(1)) == k, F.call_function("shiftleft", F.lit(1).cast("long"), g.bitwiseAND(F.lit(63)).cast("int"))).otherwise(F.lit(0).cast("long"))
    word = lambda k: F.aggregate("grams", F.lit(0).cast("long"), lambda done, g: done.bitwiseXOR(bit(g, k)))
    return [word(k).alias(f"p{k}") for k in (0, 1)]


def _spelt_place() -> dict[str, Column]:
    """Address, subdivision and lot as they are compared. A lot is "=" and its key; a row without one has ""."""
    return {"address": T.comparison_key("property_address"), "sub": T.comparison_key("subdivision"), "lot": F.when(F.length("lot") > 0, F.concat(F.lit("="), T.comparison_key("lot"))).otherwise("")}


def _place_of(spelt: dict[str, Column]) -> Column:
    """A place's name of 128 bits."""
    return F.struct(*(F.xxhash64(F.lit(h), *spelt.values()).alias(f"h{h}") for h in (0, 1)))


def _linked_places(places: DataFrame) -> DataFrame:
    """Distinct pairs x_place < y_place of `places` (place, address, sub, lot) whose addresses, subdivisions and lots are alike."""
    addresses, subs = (_alike(places.select(F.col(n).alias("value")).distinct()).select(F.col("value").alias(n), F.col("other").alias(f"_{n}")) for n in ("address", "sub"))
    asked = places.join(addresses, "address").join(subs, "sub").select("place", "_address", "_sub", F.explode(F.array_distinct(F.array("lot", F.lit("")))).alias("_lot"))
    theirs = places.select(F.col("place").alias("_place"), *(F.col(n).alias(f"_{n}") for n in ("address", "sub", "lot")))
    return asked.join(theirs, ["_address", "_sub", "_lot"]).where("place <> _place").select(F.least("place", "_place").alias("x_place"), F.greatest("place", "_place").alias("y_place")).distinct()


def placed_pairs(cases: DataFrame, id_col: str = "case_id", block: int = BLOCK) -> DataFrame:
    """Pairs a <= b of classes that `score_pairs` gives a tier, of rows that all have an address and a subdivision.

    Such rows conflict, and have no tier, unless their addresses are alike and their subdivisions and lots are; these are two matching fields, so
    nothing else is asked. The places meet, not the rows: pairs that are made are pairs that have a tier. Classes as in `blocked_pairs`.
    """
    alone = snapshot_classes(cases, id_col).where("id = class_id").select("id", (F.col("members") > 1).alias("several"))
    spelt = _spelt_place()
    own = cases.select(F.col(id_col).alias("id"), *(c.alias(n) for n, c in spelt.items())).join(alone, "id")
    rows = written(own.withColumn("place", _place_of({n: F.col(n) for n in spelt})), "placed")
    places = written(rows.select("place", *spelt).distinct(), "places")
    met = _linked_places(places)
    within = met_by_key(rows.select(F.col("place").alias("key"), "id", "several"), block)
    held = lambda place, asking: met.select(F.struct("x_place", "y_place").alias("key"), F.col(place).alias("place")).join(rows.select("place", "id"), "place").select("key", "id", F.lit(asking).alias("asking"))
    across = met_between(held("x_place", True).unionByName(held("y_place", False)), block)
    return within.unionByName(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))


def placed_scores(cases: DataFrame, id_col: str = "case_id", block: int = BLOCK, equal_names: bool = False) -> DataFrame:
    """`score_pairs` of all rows case_a < case_b that it gives a tier, of rows that all have an address and a subdivision.

    Pairs are those of `placed_pairs`, but rows bring what is compared to where they meet, so no pair is shuffled. A place is a group, and so are two that
    are alike; a group's rows fall into blocks by hash, and blocks meet two at a time. Both sides of the join are one shuffle of the rows, and only
    places with links or many rows are asked for by a join.
    """
    spelt = _spelt_place()
    counted = cases.select(*(c.alias(n) for n, c in spelt.items())).groupBy(*spelt).agg(F.count(F.lit(1)).alias("n"))
    places = written(counted.withColumn("place", _place_of({n: F.col(n) for n in spelt})), "places")
    pairs = written(_linked_places(places), "linked-places")
    size = lambda k: places.select(F.col("place").alias(f"{k}_place"), F.col("n").alias(f"_{k}"))
    cut = lambda n: F.ceil(n / block).cast("int")
    name = F.struct(*(F.xxhash64(F.lit(h), "x_place", "y_place").alias(f"h{h}") for h in (0, 1)))
    linked = pairs.join(size("x"), "x_place").join(size("y"), "y_place").select(F.explode(F.array("x_place", "y_place")).alias("place"), name.alias("group"), cut(F.col("_x") + F.col("_y")).alias("cut"), F.lit(True).alias("across"))
    # A place alone whose rows are one block is left out: it is its own group.
    own = places.select("place", F.col("place").alias("group"), cut(F.col("n")).alias("cut"), F.lit(False).alias("across"))
    asked = linked.select("place").distinct()
    groups = written(own.join(asked, "place", "left_semi").unionByName(own.where("cut > 1").join(asked, "place", "left_anti")).unionByName(linked), "groups")
    rows = cases.select(F.col(id_col).alias("id"), _place_of(spelt).alias("place"), snapshot_side().alias("side"), T.bigram_hashes("raw_text").alias("grams")).select("*", *_parities())
    told = rows.join(groups, "place", "left").withColumns({"group": F.coalesce("group", "place"), "cut": F.coalesce("cut", F.lit(1)), "across": F.coalesce("across", F.lit(False))})
    dealt = told.withColumn("own", F.pmod(F.xxhash64("id"), "cut").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    dealt = dealt.select("group", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "across", "place", "id", "side", "grams", "p0", "p1")
    x, y = dealt.alias("x"), dealt.hint("merge").alias("y")
    meet = F.expr("x.group = y.group and x.i = y.i and x.j = y.j and (x.own < y.own or (x.own = y.own and x.i = x.j and x.id < y.id)) and (not (x.across and y.across) or x.place <> y.place)")
    n, m = F.size("x.grams"), F.size("y.grams")
    # Whole sets are compared only where so few bits differ that the texts can be near.
    able = (F.least(n, m) > 0) & (sum(F.bit_count(F.col(f"x.p{k}").bitwiseXOR(F.col(f"y.p{k}"))) for k in (0, 1)) <= (n + m) * (1 - fixed.SAME_TEXT) + 0.001)
    dice = T.apart(F.when(able, F.size(F.array_intersect("x.grams", "y.grams")) * 2.0 / (n + m)).otherwise(0.0))
    first = F.col("x.id") < F.col("y.id")
    ids = [F.when(first, F.col(p)).otherwise(F.col(q)).alias(k) for k, p, q in (("case_a", "x.id", "y.id"), ("case_b", "y.id", "x.id"))]
    # What is told of a pair is the same both ways.
    return score_pairs(x.join(y, meet).select(*ids, dice.alias("dice"), F.col("x.side").alias("a"), F.col("y.side").alias("b")), equal_names).where("confidence is not null")


def _whole() -> Column:
    """Whether a row has an address and a subdivision."""
    return functools.reduce(Column.__and__, (F.coalesce(F.length(T.comparison_key(c)), F.lit(0)) > 0 for c in ("property_address", "subdivision")))


def _lacking_pairs(cases: DataFrame, id_col: str, least: float, block: int) -> DataFrame | None:
    """Pairs of `blocked_pairs` with a row that lacks an address or a subdivision; None without such rows."""
    partial = cases.where(~_whole()).select(F.col(id_col).alias("id"))
    if partial.isEmpty():
        return None
    lacking = blocked_pairs(cases, id_col, least, block).select("a", "b")
    one, two = (partial.withColumnRenamed("id", k).withColumn(f"_{k}", F.lit(True)) for k in "ab")
    return lacking.join(one, "a", "left").join(two, "b", "left").where("_a or _b").select("a", "b")


def tiered_pairs(cases: DataFrame, id_col: str = "case_id", least: float = fixed.SAME_TEXT, block: int = BLOCK) -> DataFrame:
    """Distinct pairs a <= b of classes that hold all that `score_pairs` gives a tier.

    Rows with an address and a subdivision meet by their places (`placed_pairs`). A row that lacks either does not conflict by it: pairs with such
    rows are those of `blocked_pairs`, which is asked only if there are any.
    """
    placed, lacking = placed_pairs(cases.where(_whole()), id_col, block), _lacking_pairs(cases, id_col, least, block)
    return placed if lacking is None else placed.unionByName(lacking)


def tiered_scores(cases: DataFrame, id_col: str = "case_id", block: int = BLOCK, equal_names: bool = False) -> DataFrame:
    """`score_pairs` of all rows case_a < case_b that it gives a tier: the pairs of `tiered_pairs`, those of whole rows scored where they meet."""
    placed, lacking = placed_scores(cases.where(_whole()), id_col, block, equal_names), _lacking_pairs(cases, id_col, fixed.SAME_TEXT, block)
    if lacking is None:
        return placed
    pairs = class_members(lacking, snapshot_classes(cases, id_col)).select("a", "b")
    side = lambda k: cases.select(F.col(id_col).alias(k), snapshot_side().alias(f"_{k}"))
    told = text_dice(pairs.join(side("a"), "a").join(side("b"), "b"), cases, "a", "b", id_col, "raw_text")
    scored = score_pairs(told.select(F.col("a").alias("case_a"), F.col("b").alias("case_b"), "dice", F.col("_a").alias("a"), F.col("_b").alias("b")), equal_names)
    return placed.unionByName(scored.where("confidence is not null"))


def canonical_score(has_property, method, confidence, candidate_score, completeness, resolved) -> Column:
    ranks = F.create_map(*(F.lit(x) for kv in fixed.METHOD_RANKS.items() for x in kv))
    c = T._col
    zero = lambda x: F.coalesce(c(x), F.lit(0.0))
    return (
        F.when(c(has_property), 10.0).otherwise(0.0) + 2.0 * F.coalesce(ranks[c(method)], F.lit(0)) + 20.0 * zero(confidence) + 15.0 * zero(candidate_score)
        + 0.5 * F.least(zero(completeness), F.lit(20.0)) + F.least(zero(resolved), F.lit(5.0))
    )


def canonical(scored: DataFrame, keys: list[str], id_col: str = "case_id") -> DataFrame:
    """Per group the row to keep: best score, within 0.01 of it the earliest `created_at`, then the least id.

    Columns: keys, canonical_id, top_score, n_candidates, n_tied, reasoning. An empty group has no row.
    """
    top = scored.groupBy(*keys).agg(F.max("score").alias("top_score"), F.count(F.lit(1)).alias("n_candidates"))
    tied = scored.join(top, keys).where(F.round(F.col("top_score") - F.col("score"), 9) < fixed.TIE)
    picked = tied.groupBy(*keys).agg(
        F.min(F.struct("created_at", F.col(id_col).alias("id"))).alias("pick"), F.count(F.lit(1)).alias("n_tied"), F.first("top_score").alias("top_score"), F.first("n_candidates").alias("n_candidates")
    )
    best = F.format_string("%.2f", "top_score")
    why = F.when(
        F.col("n_tied") > 1,
        F.concat(F.col("n_tied"), F.lit(" of "), F.col("n_candidates"), F.lit(" candidates tied at the top score ("), best, F.lit("); kept the earliest created.")),
    ).otherwise(F.concat(F.lit("Scored highest ("), best, F.lit(" of "), F.col("n_candidates"), F.lit(" candidates); no tie.")))
    return picked.select(*keys, F.col("pick.id").alias("canonical_id"), "top_score", "n_candidates", "n_tied", why.alias("reasoning"))


def archive_duplicates(cases: DataFrame, chosen: DataFrame, keys: list[str], as_of, id_col: str = "case_id") -> DataFrame:
    """Cases with all but the canonical one of a group archived and merged into it.

    A canonical case without a real borrower takes the name of the earliest duplicate that has one.
    """
    real = F.col("borrower").isNotNull() & ~F.lower(F.trim("borrower")).isin(fixed.PLACEHOLDER_BORROWERS)
    joined = cases.join(chosen.select(*keys, "canonical_id"), keys, "left")
    donor = joined.where(real).groupBy(*keys).agg(F.min(F.struct("created_at", F.col(id_col), "borrower"))["borrower"].alias("_donor"))
    full = joined.join(donor, keys, "left")
    gone = F.col("canonical_id").isNotNull() & (F.col("canonical_id") != F.col(id_col))
    return full.withColumns({
        "archived_at": F.when(gone, F.coalesce("archived_at", as_of)).otherwise(F.col("archived_at")),
        "merged_into": F.when(gone, F.col("canonical_id")),
        "borrower": F.when(~gone & ~F.coalesce(real, F.lit(False)) & F.col("canonical_id").isNotNull(), F.coalesce("_donor", "borrower")).otherwise(F.col("borrower")),
    }).drop("_donor", "canonical_id")


def owner_tokens(name) -> Column:
    """Words of two letters or more in any spelling of an owner's name."""
    words = F.flatten(F.transform(N.variants(name), lambda v: F.split(v, r"\s+")))
    return F.coalesce(F.array_distinct(F.filter(words, lambda w: F.length(w) > 1)), F.array().cast("array<string>"))


def alike_names(one: DataFrame, two: DataFrame, block: int = BLOCK) -> DataFrame:
    """(x, y) of the distinct lists `names` of `one` and `two` that share SAME_NAMES of the shorter list's words.

    The shorter list shares one of its first words, rarest first, with the other: it asks by these only. Lists that hold a word fall into blocks.
    """
    side = lambda df, of: df.select(F.lit(of).alias("of"), "names", F.size("names").alias("n"), F.explode("names").alias("w"))
    every = side(one, "x").unionByName(side(two, "y"))
    often = every.groupBy("w").agg(F.count(F.lit(1)).alias("often"), F.count_if(F.col("of") == "x").alias("x"), F.count_if(F.col("of") == "y").alias("y")).where("x > 0 and y > 0")
    # Words of one side alone come first in the order: they take a place and meet nothing.
    ranked = every.join(often, "w", "left").groupBy("of", "names", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "w"))).alias("order"))
    least = F.ceil(F.round(F.col("n") * fixed.SAME_NAMES, 9)).cast("int")
    asking = ranked.select("of", "names", "n", F.explode(F.slice("order", F.lit(1), F.col("n") - least + 1)).alias("p")).where("p.often > 0").select("of", "names", "n", F.col("p.w").alias("w"))
    cut = lambda of: F.ceil(F.col(of) / block).cast("int")

    def met(short: str, long: str) -> DataFrame:
        ask = asking.where(F.col("of") == short).join(often, "w").select("w", F.col("names").alias(short), F.col("n").alias("m"), F.explode(F.sequence(F.lit(0), cut(long) - 1)).alias("i"))
        hold = every.where(F.col("of") == long).join(often, "w").select("w", F.col("names").alias(long), F.col("n").alias("o"), F.pmod(F.xxhash64("names"), cut(long)).cast("int").alias("i"))
        return ask.join(hold, ["w", "i"]).where(F.col("m") <= F.col("o")).where(F.size(F.array_intersect("x", "y")) / F.col("m") >= fixed.SAME_NAMES).select("x", "y")

    return met("x", "y").unionByName(met("y", "x")).distinct()


def legacy_matches(legacy: DataFrame, ingested: DataFrame, fields: list[str], id_l: str = "legacy_id", id_r: str = "case_id") -> DataFrame:
    """Per legacy row its class and ingested row. A: same filing number. B: same instrument number, or three equal fields of `fields`
    and names. E: one or two. C: none, and no match.

    Both have number, instrument and names (array of strings, null without an owner's name); names that share 0.6 of the
    shorter list count as a field. Of several rows with a number the last id counts, of equally many fields the first.
    No pairs are made: every set of fields, alone and with alike names, is a key, whose least ingested id is known once; a row's best is the least id
    of its largest key that any ingested row has. Keys of a row double with each field, so `fields` are few.
    """
    last = lambda c, name: ingested.where(F.col(c).isNotNull()).groupBy(c).agg(F.max(id_r).alias(name))
    told = [*fields, "names"]
    listed = F.array_sort(F.array_distinct(F.array_compact("names")))
    named = lambda df: df.withColumn("names", listed).withColumn("_name", F.sha2(F.to_json(F.struct(*told)), 256))
    classes = lambda df, i: df.groupBy("_name").agg(F.min(F.col(i)).alias("id"), *(F.first(c).alias(c) for c in told))
    # Written once: spelling names takes long, and each side is read several times.
    legacy, named_r = written(named(legacy), "legacy-names"), written(named(ingested), "ingested-names")
    one, two = classes(legacy, id_l), classes(named_r, id_r)
    sets = [s for k in range(len(fields) + 1) for s in itertools.combinations(fields, k)]

    def keyed(df: DataFrame, alike: tuple[bool, ...]) -> DataFrame:
        keys = []
        for k, own in enumerate(sets):
            for a in alike:
                if not (own or a):
                    continue
                values = [F.col(c).cast("string") for c in own] + [F.col("names")] * a
                stated = functools.reduce(Column.__and__, (v.isNotNull() for v in values))
                keys.append(F.when(stated, F.struct(F.lit(len(values)).cast("long").alias("n"), F.lit(2 * k + a).alias("of"), *(F.xxhash64(F.lit(h), *values).alias(f"h{h}") for h in (0, 1)))))
        return df.select("id", F.explode(F.array_compact(F.array(*keys))).alias("key"))

    words = lambda df: df.select("names").where("size(names) > 0").distinct()
    lists = alike_names(words(one), words(two))
    meant = two.join(lists.withColumnRenamed("y", "names"), "names").drop("names").withColumnRenamed("x", "names")
    theirs = keyed(two, (False,)).unionByName(keyed(meant, (True,))).groupBy("key").agg(F.min("id").alias("r"))
    best = keyed(one.withColumn("names", F.when(F.size("names") > 0, F.col("names"))), (False, True)).join(theirs, "key").groupBy("id").agg(F.min(F.struct((-F.col("key.n")).alias("n"), "r")).alias("b")).select("id", F.col("b.r").alias("best_id"), (-F.col("b.n")).alias("n_equal"))
    found = one.select("_name", "id").join(best, "id", "left").drop("id")
    full = legacy.select(id_l, "number", "instrument", "_name").join(last("number", "exact_id"), "number", "left").join(last("instrument", "instrument_id"), "instrument", "left").join(found, "_name")
    n = F.coalesce("n_equal", F.lit(0)).cast("long")
    decided = F.coalesce("exact_id", "instrument_id").isNotNull()
    return full.select(
        id_l, F.when(F.col("exact_id").isNotNull(), "A").when(decided | (n >= fixed.SAME_EVENT_FIELDS), "B").when(n >= 1, "E").otherwise("C").alias("class"),
        F.coalesce("exact_id", "instrument_id", "best_id").alias("match_id"), F.when(decided, 0).otherwise(n).cast("long").alias("n_equal"),
    )


def linked(scored: DataFrame, links: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and review tasks after scored pairs (case_a, case_b, confidence, score, matched, conflicting) are recorded.

    A pair with a tier becomes a link, smaller id first, or renews the link that there is, whose status stays. The later case gets one
    POSSIBLE_CONTENT_DUPLICATE task, if it never had one. `links` adds status to the columns of pairs, `tasks` is case_id, reason, status, notes.
    """
    told = scored.where("confidence is not null").select(
        F.least("case_a", "case_b").alias("case_a"), F.greatest("case_a", "case_b").alias("case_b"), "confidence", "score", "matched", "conflicting"
    ).dropDuplicates(["case_a", "case_b"])
    old = links.select("case_a", "case_b", F.col("status").alias("_status"))
    renewed = told.join(old, ["case_a", "case_b"], "left").withColumn("status", F.coalesce("_status", F.lit("OPEN"))).drop("_status")
    kept = links.join(told.select("case_a", "case_b"), ["case_a", "case_b"], "left_anti")
    reason = "POSSIBLE_CONTENT_DUPLICATE"
    first = told.groupBy("case_b").agg(F.min(F.struct("case_a", "confidence")).alias("l"))
    had = tasks.where(F.col("reason") == reason).select(F.col("case_id").alias("case_b")).distinct()
    notes = F.concat(F.lit("Possible duplicate of case "), F.col("l.case_a").cast("string"), F.lit(" ("), F.col("l.confidence"), F.lit(")."))
    opened = first.join(had, "case_b", "left_anti").select(F.col("case_b").alias("case_id"), F.lit(reason).alias("reason"), F.lit("OPEN").alias("status"), notes.alias("notes"))
    return kept.unionByName(renewed.select(*kept.columns)), tasks.unionByName(opened)


def merged_into_final(cases: DataFrame, id_col: str = "case_id", into_col: str = "merged_into") -> DataFrame:
    """Per merged case (id, final_id, cyclic): the case that its chain of merges ends in.

    Pointers jump: each round a case points as far again, so a chain of n merges takes about log n rounds. A case that points to one
    that is not merged is done and leaves the rounds, so a survivor of many is looked up once by each. Rounds that
    finish nobody leave circles, and what leads to them: cyclic, without a final id. Ids are unique; a case merged into itself or into an unknown
    id is a circle of one, or ends there.
    """
    merged = cases.where(F.col(into_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(into_col).alias("at"))
    now = written(merged.withColumn("done", F.lit(False)), "chains-0")
    left, rounds = now.count(), 0
    while left:
        rounds += 1
        step = now.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("done").alias("_done"))
        jumped = now.where("not done").join(step, "at", "left").select(
            "id", F.coalesce("_at", "at").alias("at"), (F.col("_at").isNull() | F.col("_done")).alias("done")
        )
        now = written(now.where("done").unionByName(jumped), f"chains-{rounds}")
        before, left = left, now.where("not done").count()
        if left == before:
            break
    return now.select(F.col("id").alias(id_col), F.when(F.col("done"), F.col("at")).alias("final_id"), (~F.col("done")).alias("cyclic"))
