"""Cases with appraisal records: candidates, weighted evidence, thresholds and conflicts."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import names as N
from ..functions import text as T
from ..sources.stage import written
from . import contain

CASE = "case_id", "owner_names", "city", "parcel_id", "geographic_id", "legal_text", "subdivision", "lot", "block", "acreage", "mailing_address"
RECORD = "candidate_id", "owner_name", "situs_address", "city", "parcel_id", "geographic_id", "legal_text", "subdivision", "lot", "block", "acreage"
W = fixed.MATCH_WEIGHTS


@dataclass(frozen=True)
class Thresholds:
    """Scores from which a match is accepted or reviewed, and its least lead."""

    accept: float = fixed.ACCEPT
    review: float = fixed.REVIEW
    margin: float = fixed.MARGIN

    @classmethod
    def from_settings(cls, settings: dict[str, str]) -> Thresholds:
        """From text settings accept, review and margin; what is no number keeps its default."""

        def number(name: str) -> float:
            try:
                return float(settings.get(name) or getattr(cls, name))
            except ValueError:
                return getattr(cls, name)

        return cls(*map(number, ("accept", "review", "margin")))


def _present(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


#: What of a case or record is compared after which normaliser, beside its names.
_KEYS = {"subdivision": T.legal_token, "lot": T.legal_token, "block": T.legal_token, "legal_text": T.legal_token, "city": T.city_key}


def _keys(address: str) -> list[Column]:
    return [f(F.col(n)).alias(f"{n}_key") for n, f in _KEYS.items()] + [T.address_key(address).alias(f"{address}_key")]


def _every(of) -> Column:
    """What `of` gives for any of a case's names."""
    return F.flatten(F.filter(F.transform("owner_names", of), lambda n: n.isNotNull()))


def case_side(*more: str | Column) -> Column:
    """The struct `c` of a case, and `more` of its columns, with its names spelt out and its texts normalised: these take long, and a case meets many records."""
    return F.struct(*CASE, *more, _every(N.spelt).alias("spelt"), _every(N.surname_tokens).alias("surnames"), *_keys("mailing_address"))


def record_side(*more: str | Column) -> Column:
    """The struct `r` of a record, and `more` of its columns, with its owner spelt out and its texts normalised."""
    return F.struct(*RECORD, *more, N.spelt("owner_name").alias("spelt"), N.surname_tokens("owner_name").alias("surnames"), *_keys("situs_address"))


def score(pairs: DataFrame) -> DataFrame:
    """Pairs with columns `c` (a case) and `r` (a record), both structs: adds score, matched, conflicting.

    Evidence adds up in a fixed order and is rounded to 9 places, so that thresholds decide alike everywhere. Where both structs have their
    names spelt out and texts normalised (`case_side`, `record_side`), these are compared.
    """
    c, r = F.col("c"), F.col("r")
    ready = all("spelt" in pairs.schema[k].dataType.names for k in "cr")
    both = lambda n: _present(c[n]) & _present(r[n])
    key = lambda side, n, f: side[f"{n}_key"] if ready else f(side[n])
    overlap = lambda n: T.overlap(c[f"{n}_key"], r[f"{n}_key"], lambda k: k) if ready else T.overlap(c[n], r[n])
    place, lot = overlap("subdivision"), overlap("lot")
    block = F.when(_present(c["block"]) | _present(r["block"]), overlap("block")).otherwise(True)
    full = _present(c["subdivision"]) & _present(c["lot"])
    same_lot = full & place & lot & block
    lot_conflict = full & ~same_lot & place & _present(r["lot"]) & ~lot
    block_conflict = full & ~same_lot & ~lot_conflict & both("block") & ~block & place & lot
    known_owner = (F.coalesce(F.size(c["owner_names"]), F.lit(0)) > 0) & _present(r["owner_name"])
    shares = lambda n: F.coalesce(F.arrays_overlap(c[n], r[n]), F.lit(False))
    owner = known_owner & (shares("spelt") if ready else N.any_name(c["owner_names"], lambda n: N.related(n, r["owner_name"])))
    kin = shares("surnames") if ready else N.any_name(c["owner_names"], lambda n: N.surnames_match(n, r["owner_name"]))
    gap = F.abs(c["acreage"] - r["acreage"])
    near, far = F.coalesce(gap < fixed.SAME_ACREAGE, F.lit(False)), F.coalesce(gap > fixed.OTHER_ACREAGE, F.lit(False))
    # (holds, weight, matched fields, conflicting fields), in order
    evidence = [
        (both("parcel_id") & (c["parcel_id"] == r["parcel_id"]), W["parcel_id"], ["parcelId"], []),
        (both("geographic_id") & (c["geographic_id"] == r["geographic_id"]), W["geographic_id"], ["geographicId"], []),
        (same_lot, W["subdivision_lot"], ["subdivision", "lot"], []),
        (same_lot & _present(c["block"]), 0.0, ["block"], []),
        (lot_conflict, W["lot_block_conflict"], [], ["lot"]),
        (block_conflict, W["lot_block_conflict"], [], ["block"]),
        (~full & _present(c["subdivision"]) & place, W["subdivision"], ["subdivision"], []),
        (both("legal_text") & overlap("legal_text"), W["legal_text"], ["legalDescriptionTokens"], []),
        (owner, W["owner"], ["ownerName"], []),
        (known_owner & ~owner & ~kin, W["owner_conflict"], [], ["ownerName"]),
        (near, W["acreage"], ["acreage"], []),
        (far, W["acreage_conflict"], [], ["acreage"]),
        (both("city") & (key(c, "city", T.city_key) == key(r, "city", T.city_key)), W["city"], ["city"], []),
        (_present(c["mailing_address"]) & _present(r["situs_address"]) & (key(c, "mailing_address", T.address_key) == key(r, "situs_address", T.address_key)), W["mailing"], ["mailingAddressMatchesSitus"], []),
    ]
    # Each test is worked out once, as a column, and used for the sum and both lists.
    held = pairs.withColumns({f"_e{k}": F.coalesce(e[0], F.lit(False)) for k, e in enumerate(evidence)})
    total = F.round(sum((F.when(F.col(f"_e{k}"), F.lit(w)).otherwise(0.0) for k, (_, w, _, _) in enumerate(evidence)), F.lit(0.0)), 9)
    # No name is in a list twice: the two tests of a subdivision exclude one another. Functions on elements would be slow, pair by pair.
    listed = lambda side: F.concat(*(F.when(F.col(f"_e{k}"), F.array(*map(F.lit, e[side]))).otherwise(F.array().cast("array<string>")) for k, e in enumerate(evidence) if e[side]))
    told = held.withColumns({"matched": listed(2), "conflicting": listed(3), "score": total}).drop(*(f"_e{k}" for k in range(len(evidence))))
    return told.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), floored(F.col("score"), F.col("matched"), F.col("conflicting")))))


def critical(conflicting: Column) -> Column:
    return F.arrays_overlap(conflicting, F.array(F.lit("lot"), F.lit("block"), F.lit("ownerName")))


def floored(total: Column, matched: Column, conflicting: Column) -> Column:
    """Strong evidence sets a least score, unless lot, block or owner conflict."""
    has = lambda f: F.array_contains(matched, f)
    least = lambda name: F.greatest(total, F.lit(fixed.MATCH_FLOORS[name]))
    return (
        F.when(critical(conflicting), total)
        .when(has("parcelId"), least("parcelId")).when(has("geographicId"), least("geographicId"))
        .when(has("subdivision") & has("lot"), least("subdivision+lot")).when(has("legalDescriptionTokens"), least("legalDescriptionTokens"))
        .when(has("ownerName") & (F.size(matched) >= 2), least("ownerName+")).when(has("ownerName"), least("ownerName")).otherwise(total)
    )


def method_of(matched: Column) -> Column:
    has = lambda f: F.array_contains(matched, f)
    return (
        F.when(has("parcelId"), "parcel_id_match").when(has("geographicId"), "geographic_id_match").when(has("subdivision") & has("lot"), "subdivision_lot_block")
        .when(has("legalDescriptionTokens"), "exact_legal_description").when(F.size(matched) >= 2, "multi_field_match").otherwise("manual")
    )


def explain(matched: Column, conflicting: Column) -> Column:
    """One line on why a candidate scored as it did."""
    has = lambda f: F.array_contains(matched, f)
    others = F.array_join(F.filter(matched, lambda f: f != "ownerName"), ", ")
    why = (
        F.when(has("parcelId"), "exact parcel ID match").when(has("geographicId"), "exact geographic ID match")
        .when(has("subdivision") & has("lot"), "subdivision, lot, and block matched").when(has("legalDescriptionTokens"), "legal description text matched")
        .when(has("ownerName") & has("subdivision"), "owner name plus subdivision matched (no lot stated)").when(has("subdivision"), "subdivision matched (no lot stated)")
        .when(has("ownerName") & (F.size(matched) > 1), F.concat(F.lit("owner name plus "), others))
        .when(has("ownerName"), "owner name only — weak signal, cannot auto-publish alone").when(F.size(matched) > 0, F.concat(F.lit("matched: "), F.array_join(matched, ", ")))
    )
    against = F.when(F.size(conflicting) > 0, F.concat(F.lit("conflicting: "), F.array_join(conflicting, ", ")))
    return F.coalesce(F.nullif(F.concat_ws("; ", why, against), F.lit("")), F.lit("No matching fields found."))


def _filled(template: str, **parts) -> Column:
    """A fixed sentence with columns in place of its {names}."""
    out = F.lit(template)
    for name, part in parts.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), part)
    return out


def explanation_for(method: Column, matched: Column, count: Column) -> Column:
    """Why a record was accepted, and of how many."""
    uniqueness = F.when(count > 1, _filled(fixed.UNIQUENESS, n=count.cast("string"))).otherwise("")
    listed = F.array_join(matched, ", ")
    out = _filled(fixed.EXPLANATIONS["manual"], fields=F.when(listed == "", "no fields").otherwise(listed), uniqueness=uniqueness)
    for name, template in fixed.EXPLANATIONS.items():
        if name != "manual":
            out = F.when(method == name, _filled(template, fields=listed, uniqueness=uniqueness)).otherwise(out)
    return out


def decision_explanation(accepted: Column, reviewed: Column, method: Column, score: Column, second: Column, matched: Column, conflicting: Column, count: Column) -> Column:
    """One sentence on a case's decision. `second` is the next candidate's score, null without one."""
    two = lambda c: F.format_string("%.2f", c)
    say = lambda name, **more: _filled(fixed.REVIEW_EXPLANATIONS[name], score=two(score), **more)
    alone = (F.size(matched) == 1) & F.array_contains(matched, "ownerName")
    review = (
        F.when(critical(conflicting), F.when(F.array_contains(conflicting, "ownerName"), say("owner")).otherwise(say("conflict", conflicts=F.array_join(conflicting, "/"))))
        .when(alone, say("owner_alone")).when(second.isNotNull(), say("close", margin=two(score - second), second=two(second))).otherwise(say("below"))
    )
    told = F.when(accepted, explanation_for(method, matched, count)).when(reviewed, review).otherwise(say("nothing"))
    return F.when(F.coalesce(count, F.lit(0)) == 0, fixed.REVIEW_EXPLANATIONS["none"]).otherwise(told)


def decide(scored: DataFrame, thresholds: Thresholds = Thresholds(), keys: list[str] | None = None, order: str = "strategy") -> DataFrame:
    """Per case the decision on its best candidate. `scored` has candidate_id, score, matched, conflicting.

    Ties go to the smaller `order`, then the smaller candidate id. Columns: selected_id, confidence,
    method, matched, conflicting, candidate_count, requires_review, explanation.
    """
    keys = keys or ["case_id"]
    best = F.struct((-F.col("score")).alias("s"), F.col(order).alias("o"), F.col("candidate_id").alias("id"), "matched", "conflicting")
    # A case has few scores: its candidates shrink to their best of each before they are gathered. The lead needs the next score only.
    few = scored.groupBy(*keys, order, "score").agg(F.min(F.struct("candidate_id", "matched", "conflicting")).alias("p"), F.count(F.lit(1)).alias("n"))
    few = few.select(*keys, order, "score", "n", "p.*")
    ranked = few.groupBy(*keys).agg(F.min(best).alias("top"), F.sum("n").alias("candidate_count"), F.sort_array(F.collect_list(F.struct("score", "n")), asc=False).alias("_scores"))
    told = ranked.withColumn("_second", F.when(F.col("_scores")[0]["n"] > 1, F.col("_scores")[0]["score"]).otherwise(F.get("_scores", F.lit(1))["score"])).drop("_scores")
    value = F.round(-F.col("top.s"), 9)
    margin = F.round(F.when(F.col("_second").isNotNull(), value - F.col("_second")).otherwise(value), 9)
    matched, conflicting = F.col("top.matched"), F.col("top.conflicting")
    alone = (F.size(matched) == 1) & (F.element_at(F.concat(matched, F.array(F.lit(""))), 1) == "ownerName")
    accept = ~critical(conflicting) & ~alone & (value >= thresholds.accept) & ((F.col("candidate_count") == 1) | (margin >= thresholds.margin))
    review = value >= thresholds.review
    return told.select(
        *keys, F.when(accept, F.col("top.id")).alias("selected_id"), value.alias("confidence"),
        F.when(accept | review, method_of(matched)).otherwise("unresolved").alias("method"),
        F.when(accept | review, matched).otherwise(F.array().cast("array<string>")).alias("matched"), conflicting.alias("conflicting"), "candidate_count", (~accept).alias("requires_review"),
        decision_explanation(accept, review, method_of(matched), value, F.col("_second"), matched, conflicting, F.col("candidate_count")).alias("explanation"),
    )


def _unioned(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass(frozen=True)
class Capabilities:
    """What a county's records can be searched by; a geographic id is searched as a parcel is."""

    parcel: bool = True
    address: bool = True
    subdivision: bool = True
    legal: bool = True
    owner: bool = True

    def allowed(self) -> list[bool]:
        """By search, in the order of `candidates`."""
        return [self.address, self.parcel, self.parcel, self.subdivision, self.legal, self.owner and self.subdivision, self.owner, self.owner]


#: The one search that a query gets, by what it states: parcel, geographic id, street, owner with subdivision, owner with acreage, subdivision, legal text, owner.
PRIORITY = (1, 2, 0, 5, 6, 3, 4, 7)


def _able(capabilities: Capabilities) -> list[Column]:
    known = lambda c: F.coalesce(F.length(F.trim(F.col(c))) > 0, F.lit(False))
    owners, place = F.coalesce(F.size("owner_names"), F.lit(0)) > 0, known("subdivision")
    states = [known("stated_address"), known("parcel_id"), known("geographic_id"), place, known("legal_text"), owners & place, owners & F.col("acreage").isNotNull(), owners]
    return [c & F.lit(ok) for c, ok in zip(states, capabilities.allowed())]


def searches_of(budget: int | None = None, capabilities: Capabilities = Capabilities()) -> Column:
    """The searches that a case's fields and the records allow, in their order; with a budget the first so many: one request each."""
    every = F.array_compact(F.array(*(F.when(a, F.lit(k)) for k, a in enumerate(_able(capabilities)))))
    return every if budget is None else F.slice(every, F.lit(1), F.lit(budget)) if budget > 0 else F.array().cast("array<int>")


def first_search(capabilities: Capabilities = Capabilities()) -> Column:
    """The first search by PRIORITY that a query states and the records allow, null without one."""
    able = _able(capabilities)
    return F.coalesce(*(F.when(able[k], F.lit(k)) for k in PRIORITY))


def search_properties(queries: DataFrame, records: DataFrame, county: str = "county", capabilities: Capabilities = Capabilities()) -> DataFrame:
    """(case_id, candidate_id, strategy): each query's one search, dispatched by what it states. Queries have the columns of cases."""
    return _searched(queries.withColumn("_searches", F.array_compact(F.array(first_search(capabilities)))), records, county, single=True)


def _first_person(names) -> Column:
    """The first person that the first of an array of names stands for."""
    return F.try_element_at(N.people(F.try_element_at(names, F.lit(1))), F.lit(1))


def candidates(cases: DataFrame, records: DataFrame, county: str = "county", budget: int | None = None, capabilities: Capabilities = Capabilities()) -> DataFrame:
    """(case_id, candidate_id, strategy) of eight searches of a case's county; a pair keeps its first strategy.

    Cases have `stated_address` beside CASE, records RECORD; both have `county`. By order: 0 the record's street holds the stated one;
    1 equal parcel; 2 the geographic id begins with the case's; 3 the record's subdivision or legal text holds the case's
    subdivision, narrowed to its lot where any record has it; 4 the legal text holds the case's; 5 as 3, all lots, and the owner
    holds the surname; 6 the owner begins with the surname and the acreage is the same; 7 the owner has all words of
    the name, or, for cases where none has, begins with the surname. Surnames and names are those of the first owner. With
    `budget` each case makes its first so many searches only, as `searches_of` tells. Case ids and candidate ids are unique.
    """
    return _searched(cases.withColumn("_searches", searches_of(budget, capabilities)), records, county)


def candidate_pairs(cases: DataFrame, records: DataFrame, county: str = "county", stated: bool = False) -> DataFrame:
    """`candidates` with the structs `c` and `r` that `score` takes; with `stated` also what `enrich` does, and the case's `stated_method` in `c`."""
    sides = (case_side("stated_method", _every(N.significant_tokens).alias("telling")), record_side(N.significant_tokens("owner_name").alias("telling"))) if stated else (case_side(), record_side())
    return _searched(cases.withColumn("_searches", searches_of()), records, county, sides=sides)


#: What a record is searched by, and a case asks for.
ASKED = "street", "parcel_id", "geographic", "place", "legal"


def _found_before(late: int) -> Column:
    """Whether a search before `late` (6 or 7) finds the pair, told from a row that has both: a case's columns, and a record's with "_" before them."""
    asked = lambda k: F.array_contains("_searches", k)
    within = lambda name, *hays: F.coalesce((F.col(name) != "") & functools.reduce(Column.__or__, (F.contains(h, name) for h in hays)), F.lit(False))
    place = within("place", "_place", "_legal")
    tests = [
        within("street", "_street"), F.coalesce((F.col("geographic") != "") & F.startswith("_geographic", "geographic"), F.lit(False)), asked(1) & F.coalesce(F.col("parcel_id") == F.col("_parcel_id"), F.lit(False)), within("legal", "_legal"),
        place & ((asked(3) & (~F.col("_some") | same_lot())) | (asked(5) & F.coalesce(F.contains("_owner", "_surname"), F.lit(False)))),
        *[asked(6) & F.coalesce((F.col("_surname") != "") & F.startswith("_owner", "_surname") & (F.abs(F.col("acreage") - F.col("_acreage")) < fixed.SAME_ACREAGE), F.lit(False))][: late - 6],
    ]
    return functools.reduce(Column.__or__, tests)


def _searched(cases: DataFrame, records: DataFrame, county: str, single: bool = False, sides: tuple[Column, Column] | None = None) -> DataFrame:
    """The searches that `_searches` names for each case; with `single` that is one at most, so no pair is found twice.

    Texts meet first, each pair of texts once. Rows follow search by search and only where the search's own test can hold, so what is made grows with
    what is found. Texts of rows are large in memory for their files: no join of them is a broadcast. Pairs of names and acreages grow with cases times
    records of a name: a row tells by itself whether an earlier search finds its pair, so these pairs are never shuffled. `sides` are what each pair is to
    carry of its case and of its record, as `c` and `r`; for the same reason they come along with the rows.
    """
    asked = lambda k: F.array_contains("_searches", k)
    apart = lambda df: df.hint("merge")
    case_, record_ = (["_side"], ["_other"]) if sides else ([], [])
    # Written once: normalising takes long, and each search reads its own columns.
    told = written(cases.select(
        county, "case_id", "_searches", "acreage", "parcel_id", F.struct("lot", "block").alias("c"), T.surname(_first_person(F.col("owner_names"))).alias("_surname"), F.upper(F.trim(F.try_element_at("owner_names", F.lit(1)))).alias("whole"),
        F.when(asked(0), T.address_key(T.street_term("stated_address"))).alias("street"), F.when(asked(2), F.col("geographic_id")).alias("geographic"),
        F.when(asked(3) | asked(5), T.legal_token(T.subdivision_term("subdivision"))).alias("place"), F.when(asked(4), T.legal_token(T.search_text("legal_text"))).alias("legal"), *(sides[0].alias(k) for k in case_),
    ), "asked")
    theirs = written(records.select(
        county, "candidate_id", F.col("acreage").alias("_acreage"), "parcel_id", F.struct("lot", "block").alias("r"), F.upper(F.trim("owner_name")).alias("_owner"),
        T.address_key("situs_address").alias("street"), F.col("geographic_id").alias("geographic"), T.legal_token("subdivision").alias("place"), T.legal_token("legal_text").alias("legal"), *(sides[1].alias(k) for k in record_),
    ), "searched")
    # A name asks for all its words first; cases for which that finds nothing ask for the surname.
    whole = written(contain.holding_words(told.where(asked(7)).select(county, F.col("whole").alias("needle")), theirs.select(county, F.col("_owner").alias("hay")), [county]), "whole-names")
    exact = whole.select(county, F.col("needle").alias("whole")).distinct()
    begins, near = told.where(asked(7)).join(apart(exact), [county, "whole"], "left_anti"), told.where(asked(6) & F.col("acreage").isNotNull())
    kind = lambda df, name, text: df.select(county, F.lit(name).alias("kind"), F.col(text))
    ask = lambda df, name, text: kind(df.withColumnRenamed(text, "needle"), name, "needle")
    hay = lambda name, text: kind(theirs.withColumnRenamed(text, "hay"), name, "hay")
    needles = _unioned([*(ask(told, k, k) for k in ("street", "geographic", "place", "legal")), ask(begins, "name", "_surname"), ask(near, "name", "_surname")])
    hays = _unioned([hay("street", "street"), hay("geographic", "geographic"), hay("place", "place"), hay("place", "legal"), hay("legal", "legal"), hay("name", "_owner")])
    met = written(contain.containing(needles, hays, [county, "kind"], starts=lambda of: of("kind").isin("geographic", "name")), "met")

    def holders(name: str, text: str) -> DataFrame:
        """(county, needle) with the records whose `text` a needle of a kind met."""
        own = met.where(F.col("kind") == name).drop("kind").withColumnRenamed("hay", text)
        return own.join(apart(theirs), [county, text]).select(county, "needle", "candidate_id", "r", "_owner")

    def plain(number: int, name: str) -> DataFrame:
        own = told.where(asked(number)).select(county, "case_id", F.col(name).alias("needle"))
        return own.join(apart(holders(name, name)), [county, "needle"]).select("case_id", "candidate_id", F.lit(number).alias("strategy"))

    places = told.where(asked(3) | asked(5)).select(county, "case_id", "c", "_surname", asked(3).alias("_3"), asked(5).alias("_5"), F.col("place").alias("needle"))
    placed = written(places.join(apart(holders("place", "place").unionByName(holders("place", "legal"))), [county, "needle"]).select(
        "case_id", "candidate_id", F.col("_3"), (F.col("_3") & same_lot()).alias("_same"), (F.col("_5") & F.coalesce(F.contains("_owner", "_surname"), F.lit(False))).alias("_5")
    ).distinct(), "placed")
    lots = placed.where("_same").select("case_id", F.lit(True).alias("_some")).distinct()
    some = F.coalesce("_some", F.lit(False)).alias("_some")
    by_place = placed.join(apart(lots), "case_id", "left").select("case_id", "candidate_id", F.when(F.col("_3") & (F.col("_same") | ~some), 3).when(F.col("_5"), 5).alias("strategy")).where("strategy is not null")
    parcels = told.where(asked(1)).select(county, "case_id", "parcel_id").join(apart(theirs.select(county, "candidate_id", "parcel_id")), [county, "parcel_id"])
    early = _unioned([plain(0, "street"), parcels.select("case_id", "candidate_id", F.lit(1).alias("strategy")), plain(2, "geographic"), by_place, plain(4, "legal")])
    found = early if single else early.groupBy("case_id", "candidate_id").agg(F.min("strategy").alias("strategy"))
    if sides:
        found = written(found, "found").join(apart(theirs.select("candidate_id", *record_)), "candidate_id").join(apart(told.select("case_id", *case_)), "case_id")

    # What a pair of a name is told by, and what it carries, come along with both rows.
    own = [county, "case_id", "acreage", "_surname", "whole", *case_] + ["_searches", "c", *ASKED] * (not single)
    asking = lambda df, *more: (df if single else df.join(apart(lots), "case_id", "left").withColumn("_some", some)).select(*own, *([] if single else ["_some"]), *more)
    held = theirs.select(county, "candidate_id", "_owner", "_acreage", *record_, *([] if single else ["r", *(F.col(k).alias(f"_{k}") for k in ASKED)]))
    named = met.where(F.col("kind") == "name").select(county, F.col("needle").alias("_surname"), F.col("hay").alias("_owner")).join(apart(held), [county, "_owner"])
    # Acreages that are near are in one cell of twice that width, or in two that touch.
    cell = lambda acreage: F.floor(F.col(acreage) / (2 * fixed.SAME_ACREAGE)).cast("double")
    cells = asking(near, F.explode(F.array_distinct(F.array(*(cell("acreage") + k for k in (-1.0, 0.0, 1.0))))).alias("cell"))
    by_acreage = cells.join(apart(named.withColumn("cell", cell("_acreage"))), [county, "_surname", "cell"]).where(F.abs(F.col("acreage") - F.col("_acreage")) < fixed.SAME_ACREAGE)
    by_surname = asking(begins).join(apart(named), [county, "_surname"])
    wholes = whole.select(county, F.col("needle").alias("whole"), F.col("hay").alias("_owner")).join(apart(held), [county, "_owner"])
    by_name = asking(told.where(asked(7))).join(apart(wholes), [county, "whole"])
    late = [(df if single else df.where(~_found_before(k))).select("case_id", "candidate_id", F.lit(k).alias("strategy"), *case_, *record_) for df, k in ((by_acreage, 6), (by_surname, 7), (by_name, 7))]
    out = _unioned([found.select("case_id", "candidate_id", "strategy", *case_, *record_), *late])
    return out.withColumnsRenamed({"_side": "c", "_other": "r"})


def same_lot() -> Column:
    """Whether lot, and block where both are known, of the structs c and r agree."""
    c, r = F.col("c"), F.col("r")
    same = _present(r["lot"]) & (T.legal_token(c["lot"]) == T.legal_token(r["lot"])) & (~(_present(c["block"]) & _present(r["block"])) | (T.legal_token(c["block"]) == T.legal_token(r["block"])))
    return F.coalesce(same, F.lit(False))


def narrow_by_lot(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs whose lot, and block where both are known, agree; all pairs of a case where none do."""
    told = pairs.withColumn("_same", same_lot())
    some = F.max("_same").over(Window.partitionBy(*keys))
    return told.withColumn("_some", some).where("_same or not _some").drop("_same", "_some")


def enrich(pairs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per case the one record that may add values to a stated address: enrichment_id, owner_conflict.

    `pairs` has `c`, `r` and strategy (0 is the address search). Unique address hit, unique candidate, unique lot
    and block, or unique lot in the subdivision without a block, in that order; conflicts veto.
    """
    keys = keys or ["case_id"]
    c, r = F.col("c"), F.col("r")
    differs = lambda n: c[n].isNotNull() & r[n].isNotNull() & (T.plain_token(c[n]) != T.plain_token(r[n]))
    # Sides that are ready (`candidate_pairs`) have their texts normalised.
    ready = all("telling" in pairs.schema[k].dataType.names for k in "cr")
    place = T.overlap(c["subdivision_key"], r["subdivision_key"], lambda k: k) if ready else T.overlap(c["subdivision"], r["subdivision"])
    fields = differs("lot") | differs("block") | (c["subdivision"].isNotNull() & r["subdivision"].isNotNull() & ~place)
    owner = N.tokens_conflict(r["telling"], c["telling"], c["owner_names"]) if ready else N.owner_conflicts(r["owner_name"], c["owner_names"])
    same = lambda n: _present(c[n]) & _present(r[n]) & (T.plain_token(c[n]) == T.plain_token(r[n]))
    in_place = _present(c["subdivision"]) & _present(r["subdivision"]) & place
    exact = F.when(_present(c["lot"]) & _present(c["block"]), ~fields & same("lot") & same("block")).when(_present(c["lot"]) & ~_present(c["block"]), ~fields & same("lot") & in_place).otherwise(False)
    told = pairs.select(*keys, "strategy", r["candidate_id"].alias("id"), F.coalesce(fields, F.lit(False)).alias("fields"), owner.alias("owner"), F.coalesce(exact, F.lit(False)).alias("exact"))
    only = lambda cond: F.struct(F.count_if(cond).alias("n"), F.min(F.when(cond, F.struct("id", "fields", "owner"))).alias("one"))
    agg = told.groupBy(*keys).agg(only(F.col("strategy") == 0).alias("hit"), only(F.lit(True)).alias("any"), only(F.col("exact") & ~F.col("owner")).alias("free"), only(F.col("exact")).alias("exact"))
    clean = lambda p: ~F.col(f"{p}.one.fields") & ~F.col(f"{p}.one.owner")
    only_owner = lambda p: ~F.col(f"{p}.one.fields") & F.col(f"{p}.one.owner")
    one = lambda p: F.col(f"{p}.n") == 1
    picked = F.when(one("hit"), F.when(clean("hit"), F.col("hit.one.id"))).when(one("any"), F.when(clean("any"), F.col("any.one.id"))).when(one("free"), F.col("free.one.id"))
    conflict = F.when(one("hit"), only_owner("hit")).when(one("any"), only_owner("any")).otherwise((F.col("free.n") == 0) & one("exact") & F.coalesce(F.col("exact.one.owner"), F.lit(False)))
    return agg.select(*keys, picked.alias("enrichment_id"), F.coalesce(conflict, F.lit(False)).alias("owner_conflict"))


def resolve(cases: DataFrame, records: DataFrame, thresholds: Thresholds = Thresholds(), county: str = "county") -> DataFrame:
    """Every case with its address resolution: a stated address is trusted and only enriched, others are matched.

    Cases have `stated_address` and `stated_method` beside CASE. A decision for review carries confidence 0; no candidate is UNRESOLVED.
    """
    pairs = candidate_pairs(cases, records, county, stated=True)
    own = F.col("c.stated_method").isNotNull()
    decided = decide(score(pairs.where(~own)).select("case_id", "candidate_id", "strategy", "score", "matched", "conflicting"), thresholds)
    enriched = enrich(pairs.where(own))
    stated = F.col("stated_method").isNotNull()
    situs = records.select(F.col("candidate_id").alias("selected_id"), "situs_address")
    base = cases.select("case_id", "stated_address", "stated_method").join(decided, "case_id", "left").join(enriched, "case_id", "left").join(situs.hint("merge"), "selected_id", "left")
    methods = F.create_map(*(F.lit(x) for kv in fixed.RESOLUTION_METHODS.items() for x in kv))
    sure = F.create_map(*(F.lit(x) for kv in fixed.STATED_CONFIDENCE.items() for x in kv))
    method = F.coalesce(F.col("method"), F.lit("unresolved"))
    return base.select(
        "case_id", F.when(stated, F.col("stated_method")).otherwise(methods[method]).alias("address_method"),
        F.when(stated, sure[F.col("stated_method")]).otherwise(F.when(F.col("requires_review"), 0.0).otherwise(F.coalesce("confidence", F.lit(0.0)))).alias("address_confidence"),
        F.when(stated, F.col("stated_address")).otherwise(F.col("situs_address")).alias("resolved_address"),
        F.coalesce(F.when(stated, F.col("enrichment_id")), F.col("selected_id")).alias("property_id"),
        F.when(stated, F.coalesce("owner_conflict", F.lit(False))).otherwise(F.col("selected_id").isNull() & F.coalesce(F.array_contains("conflicting", "ownerName"), F.lit(False))).alias("owner_conflict"),
        F.when(stated, False).otherwise(F.coalesce("requires_review", F.lit(True))).alias("requires_review"), F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
    )


def reuse_cached(cases: DataFrame, cache: DataFrame, county: str = "county") -> DataFrame:
    """Cases with `cached_id` of an earlier match of the same county and legal key, and `times_reused` after this one."""
    keyed = cases.withColumn("legal_key", T.legal_cache_key("subdivision", "lot", "block", "legal_text"))
    hit = cache.select(county, "legal_key", F.col("candidate_id").alias("cached_id"), F.col("times_reused").alias("_times"))
    return keyed.join(hit, [county, "legal_key"], "left").withColumn("times_reused", F.when(F.col("cached_id").isNotNull(), F.col("_times") + 1)).drop("_times")


def rerun_status(selected: Column, requires_review: Column, count: Column, within_budget: Column, error: Column) -> Column:
    """What a repeated search of an open case leads to; nothing is written for those not confirmed."""
    return (
        F.when(error.isNotNull(), "ERROR").when(~within_budget, "SKIPPED_GLOBAL_BUDGET_EXHAUSTED").when(count == 0, "NO_CAD_MATCH")
        .when(selected.isNotNull() & ~requires_review, "CAD_PARCEL_CONFIRMED").otherwise("REQUIRES_HUMAN_APPROVAL")
    )


def valuation_lookback(years: DataFrame, keys: list[str], as_of_year: int, most: int = 2) -> DataFrame:
    """Years from `as_of_year` back, `most` further at most, up to the first populated one."""
    window = Window.partitionBy(*keys).orderBy(F.col("tax_year").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = years.where(F.col("tax_year").between(as_of_year - most, as_of_year))
    return near.withColumn("_found", F.coalesce(F.max("populated").over(window), F.lit(False))).where("not _found").drop("_found")


def recorded_matches(cache: DataFrame, matches: DataFrame, county: str = "county") -> DataFrame:
    """Changes of the cache of resolved legal descriptions after `matches` (county, legal_key, candidate_id): a known key was reused once more a match.

    Rows (county, legal_key, candidate_id, times_reused), to be merged into `cache`; of several matches of a key the last candidate id counts. Matches
    without a key change nothing.
    """
    made = matches.where("legal_key is not null").groupBy(county, "legal_key").agg(F.max("candidate_id").alias("candidate_id"), F.count(F.lit(1)).alias("_made"))
    known = cache.select(county, "legal_key", F.col("times_reused").alias("_times"))
    times = F.coalesce(F.col("_times") + F.col("_made"), F.col("_made") - 1)
    return made.join(known, [county, "legal_key"], "left").select(county, "legal_key", "candidate_id", times.cast("long").alias("times_reused"))
