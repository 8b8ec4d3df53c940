"""What may be shown, to whom, and in what words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed
from ..functions import values as V
from ..functions.text import _col



def trusted_address(street, method, confidence) -> Column:
    """Stated addresses always, matched ones from a confidence of 0.7, unresolved ones never."""
    m = _col(method)
    sure = m.isin(*fixed.STATED_CONFIDENCE) | (F.coalesce(_col(confidence), F.lit(0.0)) >= fixed.ADDRESS_TRUST)
    return F.coalesce((F.length(_col(street)) > 0) & m.isNotNull() & (m != "UNRESOLVED") & sure, F.lit(False))


def real_borrower(name) -> Column:
    n = _col(name)
    return F.coalesce((F.length(n) > 0) & ~F.lower(F.trim(n)).isin(fixed.PLACEHOLDER_BORROWERS), F.lit(False))


def status(df: DataFrame) -> DataFrame:
    """Adds publication_status, address_pending, blocking_reasons, investor_label. Native columns, so filters pass through.

    Reads archived_at, has_document, sale_date, borrower, street, address_method, address_confidence, has_legal,
    cad_confirmed, open_reasons (array) and active_duplicate.
    """
    critical = F.filter(F.coalesce("open_reasons", F.array().cast("array<string>")), lambda r: r.isin(fixed.CRITICAL_REASONS))
    twin = F.coalesce("active_duplicate", F.lit(False))
    address, borrower = trusted_address("street", "address_method", "address_confidence"), real_borrower("borrower")
    cad, legal = F.coalesce("cad_confirmed", F.lit(False)), F.coalesce("has_legal", F.lit(False))
    empty = F.array().cast("array<string>")
    gaps = F.array_compact(F.array(F.when(~address, "address_pending"), F.when(~borrower, "borrower_unavailable"), F.when(~cad, "cad_unconfirmed")))
    ladder = [
        (F.col("archived_at").isNotNull(), "ARCHIVED", F.array(F.lit("archived")), F.lit("No longer active")),
        (~F.coalesce("has_document", F.lit(False)) | F.col("sale_date").isNull(), "WITHHELD", F.array(F.lit("missing_or_invalid_source_notice")), F.lit("Unavailable")),
        ((F.size(critical) > 0) | twin, "PENDING_REVIEW", F.concat(critical, F.when(twin, F.array(F.lit("active_duplicate_link"))).otherwise(empty)), F.lit("Pending verification")),
        (~address & ~legal, "PENDING_REVIEW", F.array(F.lit("no_property_identifier")), F.lit("Pending verification")),
        (~address | ~borrower, "PUBLISHED_WITH_LIMITED_DATA", gaps, F.when(~address, "Limited data — address pending").otherwise("Limited data")),
        (~cad, "PUBLISHED_WITH_LIMITED_DATA", gaps, F.lit("Source address")),
        (F.lit(True), "PUBLISHED", empty, F.lit("Verified property")),
    ]
    state, reasons, label = F.lit(None).cast("string"), empty, F.lit(None).cast("string")
    for holds, s, why, words in reversed(ladder):
        state, reasons, label = F.when(holds, s).otherwise(state), F.when(holds, why).otherwise(reasons), F.when(holds, words).otherwise(label)
    told = df.withColumns({"publication_status": state, "blocking_reasons": reasons, "investor_label": label})
    return told.withColumn("address_pending", F.col("publication_status").isin("PUBLISHED_WITH_LIMITED_DATA") & ~address)


def is_visible(state="publication_status") -> Column:
    return _col(state).isin(fixed.PUBLIC)


def public_only(df: DataFrame) -> DataFrame:
    return df.where(is_visible())


def publication_inputs(cases: DataFrame, sales: DataFrame, tasks: DataFrame, links: DataFrame) -> DataFrame:
    """Cases with sale_date (the last), open_reasons and active_duplicate from their child tables.

    Children are filtered and grouped before they meet the cases. A link counts from both of its ends.
    """
    dates = sales.groupBy("case_id").agg(F.max("sale_date").alias("sale_date"))
    reasons = tasks.where("status = 'OPEN'").groupBy("case_id").agg(F.sort_array(F.collect_set("reason")).alias("open_reasons"))
    live = links.where("status = 'OPEN' and confidence in ('LIKELY_SAME_EVENT', 'CONFIRMED_SAME_EVENT')")
    twins = live.select(F.col("case_a").alias("case_id")).union(live.select(F.col("case_b").alias("case_id"))).distinct().withColumn("active_duplicate", F.lit(True))
    return cases.join(dates, "case_id", "left").join(reasons, "case_id", "left").join(twins, "case_id", "left").withColumn("active_duplicate", F.coalesce("active_duplicate", F.lit(False)))


def entitlements(profiles: DataFrame, subscriptions: DataFrame, plans: DataFrame, as_of) -> DataFrame:
    """Per profile its plan now, one row each: in good standing, or late on a payment with an end of grace still to come, else FREE.

    A plan that `plans` does not have is FREE; where `plans` lacks FREE, it allows nothing. UNLIMITED opens all counties. Of several holding subscriptions of
    a profile the largest plan counts. Columns: profile_id, plan, is_all, counties, max_saved, monthly_exports.
    """
    holds = F.col("status").isin(fixed.GOOD_STANDING) | (F.col("status").isin(fixed.PAYMENT_LATE) & (F.col("grace_until") > _col(as_of)))
    rank = F.array_position(F.array(*map(F.lit, fixed.PLANS)), F.col("plan"))
    known = plans.select("plan", "max_saved", "monthly_exports")
    paid = subscriptions.where(holds & (F.col("plan") != "FREE")).select("profile_id", "plan", "counties").join(known, "plan")
    own = paid.groupBy("profile_id").agg(F.max_by(F.struct("plan", "counties", "max_saved", "monthly_exports"), F.struct(rank, "plan", "counties")).alias("own"))
    none = F.array().cast("array<string>").alias("counties")
    kinds = dict(known.dtypes)
    nothing = F.struct(F.lit("FREE").alias("plan"), none, *(F.lit(0).cast(kinds[c]).alias(c) for c in ("max_saved", "monthly_exports")))
    # One row, whether `plans` has none, one or several of FREE.
    free = known.where("plan = 'FREE'").agg(F.coalesce(F.max(F.struct("plan", none, "max_saved", "monthly_exports")), nothing).alias("free"))
    held = profiles.select("profile_id").join(own, "profile_id", "left").join(F.broadcast(free), how="cross").withColumn("own", F.coalesce("own", "free"))
    return held.select(
        "profile_id", "own.plan", (F.col("own.plan") == "UNLIMITED").alias("is_all"), F.coalesce("own.counties", F.array().cast("array<string>")).alias("counties"), "own.max_saved", "own.monthly_exports"
    )


def has_county(county, is_all, counties) -> Column:
    return _col(is_all) | F.coalesce(F.array_contains(_col(counties), _col(county)), F.lit(False))


def masked(df: DataFrame, unlocked: Column, columns: tuple[str, ...] = ("street", "lender", "principal_cents")) -> DataFrame:
    """Columns that only those with access see; places on the map stay."""
    return df.withColumns({c: F.when(unlocked, F.col(c)) for c in columns}).withColumn("locked", ~unlocked)


def visible_rows(df: DataFrame, owner: str, profile_id, is_admin: bool) -> DataFrame:
    """Rows of their owner; all of them for an administrator."""
    return df if is_admin else df.where(F.col(owner) == F.lit(profile_id))


def within_quota(used, most) -> Column:
    """Nothing set is no limit."""
    return F.coalesce(F.coalesce(_col(used), F.lit(0)) < _col(most), F.lit(True))


def triage_bucket(reason, best, second, count, strict_single: bool = False) -> Column:
    """What a review task needs, by its reason; only several appraisal matches are told apart by their candidates.

    A single candidate is quick, with `strict_single` only from a score of 0.15. A missing score counts as 0.
    """
    n, score = F.coalesce(_col(count), F.lit(0)), lambda c: F.coalesce(_col(c), F.lit(0.0))
    lead = score(best) - score(second) >= fixed.MARGIN
    single = (n == 1) & (score(best) >= fixed.MARGIN if strict_single else F.lit(True))
    several = F.when(n == 0, "MISSING_DATA").when(single | ((n > 1) & lead), "QUICK_APPROVAL").otherwise("MEANINGFUL_REVIEW")
    return (
        F.when(_col(reason) == "MULTIPLE_APPRAISAL_MATCHES", several)
        .when(_col(reason) == "NO_ADDRESS_RESOLVED", F.when(n == 0, "MISSING_DATA").otherwise("NON_BLOCKING_ENRICHMENT"))
        .when(_col(reason).isin(fixed.CONFLICT_REASONS), "MEANINGFUL_REVIEW").when(_col(reason).isin(fixed.GAP_REASONS), "MISSING_DATA").otherwise("NON_BLOCKING_ENRICHMENT")
    )


def triage_rank(bucket) -> Column:
    return F.array_position(F.array(*map(F.lit, fixed.TRIAGE_ORDER)), _col(bucket)).cast("int")


def summary(kind, address, city, subdivision, sale_date, borrower, lender, loan_date, principal_cents, balance_cents, method) -> Column:
    """Plain sentences about a case; what is unknown is said to be, or left out."""
    k = F.when(_col(kind) == "COMMERCIAL", "commercial ").when(_col(kind) == "RESIDENTIAL", "residential ").otherwise("")
    town = lambda lead: F.when(_col(city).isNotNull(), F.concat(F.lit(lead), _col(city), F.lit(", TX"))).otherwise("")
    place = (
        F.when(_col(address).isNotNull(), F.concat(F.lit("This "), k, F.lit("property is located at "), _col(address), town(", ")))
        .when(_col(subdivision).isNotNull(), F.concat(F.lit("This "), k, F.lit("property is in the "), _col(subdivision), F.lit(" area"), town(" of "), F.lit(" (exact address not yet confirmed)")))
        .otherwise(F.concat(F.lit("This "), k, F.lit("property's location has not yet been confirmed")))
    )
    sale = F.when(_col(sale_date).isNotNull(), F.concat(F.lit("is scheduled for foreclosure sale on "), V.long_day(sale_date))).otherwise("does not yet have a confirmed foreclosure sale date")
    who = F.when(
        _col(lender).isNotNull(),
        F.concat(F.lit("The notice identifies "), F.when(_col(borrower).isNotNull(), F.concat(_col(borrower), F.lit(" as the borrower and "))).otherwise(""), _col(lender), F.lit(" as the mortgagee.")),
    )
    loan = F.when(
        _col(loan_date).isNotNull() & (_col(principal_cents) > 0),
        F.concat(F.lit("The original deed of trust was recorded around "), V.long_day(loan_date), F.lit(" with an original principal amount of "), V.dollars(principal_cents), F.lit(".")),
    )
    balance = F.when(_col(balance_cents).isNotNull(), F.concat(F.lit("The notice states an unpaid balance of "), V.dollars(balance_cents), F.lit("."))).otherwise("The notice does not state the current payoff balance.")
    said = {
        "EXPLICIT_STATED": "The property address was explicitly stated in the foreclosure notice.",
        "COMMONLY_KNOWN_AS_PHRASE": 'The property address was identified from a "commonly known as" phrase in the notice.',
        "LEGAL_DESCRIPTION_MATCH": "The property address was matched to the county appraisal record using the legal description.",
        "PROPERTY_ID_MATCH": "The property address was matched using the property ID referenced in the notice.",
        "OWNER_MAILING_ADDRESS_MATCH": "The property address was matched using the owner's name against appraisal district records.",
        "GEOCODING": "The property address was resolved with the assistance of a geocoding service.",
        "MANUAL": "The property address was confirmed by an administrator.",
    }
    how = F.lit("The property address could not be confidently resolved and this record is pending manual review.")
    for m, words in said.items():
        how = F.when(_col(method) == m, words).otherwise(how)
    return F.concat_ws(" ", F.concat_ws(" ", place, F.concat(sale, F.lit("."))), who, loan, balance, how)
