"""Queries over the test tables: the operators on whole tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import names as N
from ..functions import text as T
from ..functions import values as V
from ..operators import dedup, extract, listing, match, publish, reports, split
from ..operators.listing import ListingFilter
from ..sources import readers, sinks
from ..streaming import events as E
from . import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DAY = f"DATE '{views.AS_OF}'"


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function's name, with the SQL for its result where there is one."""

    def keep(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = views.sql(sql)
        return f

    return keep


def text(c):
    return F.array_join(c, ",")


def day(c):
    return F.date_format(c, "yyyy-MM-dd")


def _published(spark, d):
    return listing.with_sales(views.publication(spark, d), views.sales(spark, d))


# ---- Listing

LISTED = "case_id, county, city, publication_status, n_sales, strftime(current_sale, '%Y-%m-%d') AS current_sale"


def _listed(df: DataFrame) -> DataFrame:
    return df.select("case_id", "county", "city", "publication_status", "n_sales", day("current_sale").alias("current_sale"))


def _listing_sql(condition: str) -> str:
    return f"SELECT {LISTED} FROM v_status WHERE archived_at IS NULL AND {condition}"


@query(
    f"SELECT {LISTED} FROM v_status WHERE publication_status IN ('PUBLISHED', 'PUBLISHED_WITH_LIMITED_DATA') AND (current_sale IS NULL OR current_sale >= {DAY}) ORDER BY n_sales DESC, case_id LIMIT 25"
)
def listing_page(spark, d):
    """First page of the public listing; its limit is the feature."""
    return _listed(listing.listing(_published(spark, d), ListingFilter(), views.as_of()))


@query(f"SELECT count(*) AS total_count FROM v_status WHERE publication_status IN ('PUBLISHED', 'PUBLISHED_WITH_LIMITED_DATA') AND (current_sale IS NULL OR current_sale >= {DAY})")
def listing_total(spark, d):
    return listing.total_count(_published(spark, d), ListingFilter(), views.as_of())


FILTERS: dict[str, tuple[ListingFilter, str]] = {
    "county": (ListingFilter(county="NATION_3"), "county = 'NATION_3'"),
    "city": (ListingFilter(city="build"), "contains(lower(city), 'build')"),
    "zip": (ListingFilter(zip_code="78503"), "zip = '78503'"),
    "classification": (ListingFilter(classification="COMMERCIAL"), "classification = 'COMMERCIAL'"),
    "confidence": (ListingFilter(min_address_confidence=0.8), "address_confidence >= 0.8"),
    "principal_range": (ListingFilter(principal_min_cents=10_000_000, principal_max_cents=30_000_000), "principal_cents BETWEEN 10000000 AND 30000000"),
    "value_range": (ListingFilter(value_min_cents=2_000_000, value_max_cents=6_000_000), "value_cents BETWEEN 2000000 AND 6000000"),
    "owner_or": (ListingFilter(borrower="#00000001"), "(contains(lower(borrower), '#00000001') OR contains(lower(owner), '#00000001'))"),
    "owner": (ListingFilter(owner="#00000002"), "contains(lower(owner), '#00000002')"),
    "has_value": (ListingFilter(has_value=True, has_street=False), "value_cents IS NOT NULL AND street IS NULL"),
    "new_within_days": (ListingFilter(created_within_days=90), f"created_at >= {DAY} - INTERVAL 90 DAY"),
    "sale_window": (ListingFilter(sale_from=date(1998, 10, 1), sale_to=date(1998, 12, 31)), "case_id IN (SELECT case_id FROM v_sale WHERE sale_date BETWEEN DATE '1998-10-01' AND DATE '1998-12-31')"),
    "saved_only": (ListingFilter(saved_by=5), "case_id IN (SELECT event_id FROM events WHERE user_id = 5 AND event_type = 'click')"),
    "lender_or": (ListingFilter(lender="#00000001"), "case_id IN (SELECT l_orderkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1 HAVING contains(lower(min(s_name)), '#00000001') OR contains(lower(max(s_name)), '#00000001'))"),
    "subdivision": (ListingFilter(subdivision="ing est"), "contains(lower(concat(city, ' ESTATES')), 'ing est')"),
    "property_type": (ListingFilter(property_type="HOUS"), "substr(city, 1, 4) = 'HOUS'"),
    "has_street": (ListingFilter(has_street=True), "street IS NOT NULL"),
    "review_status": (ListingFilter(review_status="OPEN"), "case_id IN (SELECT case_id FROM v_task WHERE status = 'OPEN')"),
}


def _filter_query(f: ListingFilter) -> Query:
    def run(spark, d):
        saved = views.table(spark, d, "events").where("event_type = 'click'").select(F.col("event_id").alias("case_id"), F.col("user_id").alias("profile_id"))
        lenders = views.table(spark, d, "lineitem").join(views.table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).groupBy(F.col("l_orderkey").alias("case_id")).agg(F.min("s_name").alias("lender"), F.max("s_name").alias("mortgagee"))
        cases = _published(spark, d).withColumns({"subdivision": F.concat("city", F.lit(" ESTATES")), "property_type": F.substring("city", 1, 4)})
        cases = cases.join(lenders, "case_id", "left") if f.lender else cases
        return _listed(listing.select_cases(cases, f, views.as_of(), sales=views.sales(spark, d), saved=saved, documents=views.tasks(spark, d).withColumnRenamed("status", "review_status")))

    return run


for _name, (_f, _condition) in FILTERS.items():
    query(_listing_sql(_condition), f"listing_filter_{_name}")(_filter_query(_f))


@query(f"SELECT case_id, strftime(current_sale, '%Y-%m-%d') AS current_sale FROM v_status WHERE archived_at IS NULL AND current_sale BETWEEN {DAY} AND {DAY} + INTERVAL 31 DAY AND contains(lower(city), 'a')")
def investor_search(spark, d):
    df = _published(spark, d).where("archived_at is null").withColumn("lender", F.lit(None).cast("string")).withColumn("subdivision", F.lit(None).cast("string")).drop("street", "borrower")
    df = df.withColumns({"street": F.lit(None).cast("string"), "borrower": F.lit(None).cast("string")})
    return listing.investor_search(df, text="A", sale_within_days=31, as_of=views.as_of()).select("case_id", day("current_sale").alias("current_sale"))


@query("SELECT DISTINCT n_name AS county FROM nation WHERE contains(lower(n_name), 'nation_1') ORDER BY 1 LIMIT 8")
def county_typeahead(spark, d):
    return listing.typeahead(views.table(spark, d, "nation").select(F.col("n_name").alias("county"), F.lit(True).alias("active")), "nation_1").select("county")


@query("SELECT case_id, strftime(sale_date, '%Y-%m-%d') AS current_sale FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY sale_date DESC NULLS FIRST) AS n FROM v_sale) WHERE n = 1")
def current_sale(spark, d):
    """The last sale; one without a date comes last of all."""
    return reports.latest(views.sales(spark, d), ["case_id"], [F.col("sale_date").desc_nulls_first()]).select("case_id", day("sale_date").alias("current_sale"))


@query("SELECT case_id, strftime(min(sale_date), '%Y-%m-%d') AS first_sale FROM v_sale GROUP BY case_id")
def first_sale(spark, d):
    return listing.with_sales(views.sales(spark, d).select("case_id").distinct(), views.sales(spark, d)).select("case_id", day("first_sale").alias("first_sale"))


@query(f"SELECT case_id, strftime(min(sale_date), '%Y-%m-%d') AS next_sale FROM v_sale WHERE sale_date >= {DAY} GROUP BY case_id")
def next_sale(spark, d):
    return listing.with_sales(views.sales(spark, d).select("case_id").distinct(), listing.upcoming(views.sales(spark, d), views.as_of(), "sale_date").where("sale_date is not null")).where("n_sales > 0").select("case_id", day("first_sale").alias("next_sale"))


@query("SELECT case_id, string_agg(concat(coalesce(strftime(sale_date, '%Y-%m-%d'), '-'), ':', sale_status), ';' ORDER BY sale_date NULLS FIRST, sale_status) AS sales FROM v_sale GROUP BY case_id")
def sale_history(spark, d):
    return listing.sale_history(views.sales(spark, d)).select("case_id", F.array_join(F.transform("sales", lambda s: F.concat(F.coalesce(day(s["sale_date"]), F.lit("-")), F.lit(":"), s["sale_status"])), ";").alias("sales"))


# ---- Publication and access

@query("SELECT case_id, publication_status, reasons, investor_label FROM v_status")
def publication_status(spark, d):
    return views.publication(spark, d).select("case_id", "publication_status", text("blocking_reasons").alias("reasons"), "investor_label")


@query("SELECT publication_status, count(*) AS n_cases, count(*) FILTER (WHERE publication_status = 'PUBLISHED_WITH_LIMITED_DATA' AND NOT addr) AS n_pending FROM v_status GROUP BY 1")
def publication_breakdown(spark, d):
    return views.publication(spark, d).groupBy("publication_status").agg(F.count(F.lit(1)).alias("n_cases"), F.count_if("address_pending").alias("n_pending"))


@query("SELECT reason, count(*) AS n_rows FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM v_status WHERE reasons <> '') GROUP BY 1")
def blocking_reason_histogram(spark, d):
    return reports.histogram(views.publication(spark, d), F.col("blocking_reasons"), "reason")


@query("SELECT case_id, CASE WHEN county IN ('NATION_1', 'NATION_2') THEN street END AS street, CASE WHEN county IN ('NATION_1', 'NATION_2') THEN principal_cents END AS principal_cents, county NOT IN ('NATION_1', 'NATION_2') AS locked FROM v_case")
def masked_export(spark, d):
    unlocked = publish.has_county("county", F.lit(False), F.array(F.lit("NATION_1"), F.lit("NATION_2")))
    return publish.masked(views.cases(spark, d), unlocked, ("street", "principal_cents")).select("case_id", "street", "principal_cents", "locked")


@query("""SELECT concat_ws(',', CAST(case_id AS VARCHAR), county, CASE WHEN borrower IS NULL THEN '' ELSE borrower END, concat('"', city, ', ""', state, '""', '"')) AS line FROM v_case""")
def csv_export(spark, d):
    df = views.cases(spark, d).select("case_id", "county", "borrower", F.concat(F.col("city"), F.lit(', "'), F.col("state"), F.lit('"')).alias("place"))
    return df.select(sinks.csv_line(["case_id", "county", "borrower", "place"]).alias("line"))


HOLDS = "(c_nationkey % 6 < 3 OR (c_nationkey % 6 < 5 AND c_acctbal > 0))"


@query(f"""SELECT profile_id, plan, plan = 'UNLIMITED' AS is_all, CASE WHEN plan = 'UNLIMITED' THEN 'ALL' WHEN main = 'COUNTY' THEN county WHEN plan = 'COUNTY' THEN 'EXTRA' ELSE '' END AS counties,
    CAST(CASE plan WHEN 'COUNTY' THEN 100 WHEN 'FREE' THEN 5 END AS INTEGER) AS max_saved FROM (SELECT *, CASE WHEN main = 'UNLIMITED' THEN main WHEN main = 'COUNTY' OR profile_id % 10 = 0 THEN 'COUNTY' ELSE 'FREE' END AS plan
    FROM (SELECT c_custkey AS profile_id, concat('NATION_', c_nationkey) AS county, CASE WHEN {HOLDS} THEN CASE c_mktsegment WHEN 'BUILDING' THEN 'COUNTY' WHEN 'MACHINERY' THEN 'UNLIMITED' END END AS main FROM customer))""")
def entitlement_resolve(spark, d):
    """Six states by nation; grace ends later for accounts in the black, today for those just below, else it is unknown. Every tenth has a second subscription."""
    c = views.table(spark, d, "customer")
    states = F.array(*map(F.lit, ("ACTIVE", "TRIALING", "PROMOTIONAL", "PAST_DUE", "PAYMENT_FAILED", "CANCELED")))
    plan = F.create_map(*map(F.lit, ("BUILDING", "COUNTY", "MACHINERY", "UNLIMITED", "FURNITURE", "FREE", "HOUSEHOLD", "LEGACY")))[F.col("c_mktsegment")]
    grace = F.when(F.col("c_acctbal") > 0, F.lit("1999-01-01")).when(F.col("c_acctbal") > -500, views.AS_OF).cast("date")
    county = F.when(plan == "UNLIMITED", F.array(F.lit("ALL"))).otherwise(F.array(F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))))
    subs = c.select(F.col("c_custkey").alias("profile_id"), plan.alias("plan"), F.get(states, F.col("c_nationkey") % 6).alias("status"), grace.alias("grace_until"), county.alias("counties")).where("plan is not null")
    more = c.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("profile_id"), F.lit("COUNTY").alias("plan"), F.lit("ACTIVE").alias("status"), F.lit(None).cast("date").alias("grace_until"), F.array(F.lit("EXTRA")).alias("counties"))
    plans = spark.sql("SELECT * FROM VALUES ('FREE', 5, 0), ('COUNTY', 100, 10), ('UNLIMITED', NULL, NULL) AS t(plan, max_saved, monthly_exports)")
    told = publish.entitlements(c.select(F.col("c_custkey").alias("profile_id")), subs.unionByName(more), plans, views.as_of())
    return told.select("profile_id", "plan", "is_all", text("counties").alias("counties"), "max_saved")


TRIAGE = """WITH s AS (SELECT case_id, count(*) AS n, max(score) AS best, max(score) FILTER (WHERE k = 2) AS second FROM
    (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC) AS k FROM (SELECT case_id, coalesce(score, 0) AS score FROM v_scored)) GROUP BY case_id)
    SELECT t.case_id, t.reason, CASE WHEN reason = 'MULTIPLE_APPRAISAL_MATCHES' THEN CASE WHEN coalesce(n, 0) = 0 THEN 'MISSING_DATA' WHEN n = 1 OR best - second >= 0.15::DOUBLE THEN 'QUICK_APPROVAL' ELSE 'MEANINGFUL_REVIEW' END
      WHEN reason = 'NO_ADDRESS_RESOLVED' THEN CASE WHEN coalesce(n, 0) = 0 THEN 'MISSING_DATA' ELSE 'NON_BLOCKING_ENRICHMENT' END
      WHEN reason IN ('CAD_OWNER_CONFLICT', 'BORROWER_NAME_CONFLICT', 'SALE_DATE_CONFLICT', 'POSSIBLE_CONTENT_DUPLICATE') THEN 'MEANINGFUL_REVIEW'
      WHEN reason IN ('POOR_TEXT_QUALITY', 'MISSING_FILING_NUMBER') THEN 'MISSING_DATA' ELSE 'NON_BLOCKING_ENRICHMENT' END AS bucket
    FROM (SELECT DISTINCT case_id, reason FROM v_review WHERE status = 'OPEN') t LEFT JOIN s USING (case_id)"""
RANKED = "CASE bucket WHEN 'MEANINGFUL_REVIEW' THEN 1 WHEN 'MISSING_DATA' THEN 2 WHEN 'QUICK_APPROVAL' THEN 3 ELSE 4 END"


def _triaged(spark, d):
    own = views.scored(spark, d).withColumn("score", F.coalesce("score", F.lit(0.0)))
    # The best two of each case: the second is the largest below the first row of its rank.
    ranked = own.withColumn("k", F.row_number().over(Window.partitionBy("case_id").orderBy(F.col("score").desc())))
    per = ranked.groupBy("case_id").agg(F.max("score").alias("best"), F.max(F.when(F.col("k") == 2, F.col("score"))).alias("second"), F.count(F.lit(1)).alias("n"))
    tasks = views.review_tasks(spark, d).where("status = 'OPEN'").select("case_id", "reason").distinct().join(per, "case_id", "left")
    return tasks.withColumn("bucket", publish.triage_bucket("reason", "best", "second", "n"))


@query(TRIAGE)
def triage_task_buckets(spark, d):
    return _triaged(spark, d).select("case_id", "reason", "bucket")


@query(f"SELECT case_id, CAST(min({RANKED}) AS INTEGER) AS priority, count(*) AS n_tasks FROM ({TRIAGE}) GROUP BY case_id")
def triage_case_priority(spark, d):
    return reports.rollup_priority(_triaged(spark, d), publish.triage_rank("bucket"))


@query(f"SELECT publication_status AS row, " + ", ".join(f"count(*) FILTER (WHERE bucket = '{b}') AS \"{b}\"" for b in fixed.TRIAGE_ORDER) + f" FROM v_status JOIN ({TRIAGE}) USING (case_id) GROUP BY 1")
def status_triage_crosstab(spark, d):
    """Tasks by their case's publication status and their bucket."""
    told = _triaged(spark, d).join(views.publication(spark, d).select("case_id", "publication_status"), "case_id")
    return reports.crosstab(told, F.col("publication_status"), F.col("bucket"), fixed.TRIAGE_ORDER)


@query(f"""SELECT case_id, concat_ws(' ', concat('This ', CASE classification WHEN 'COMMERCIAL' THEN 'commercial ' WHEN 'RESIDENTIAL' THEN 'residential ' ELSE '' END,
      CASE WHEN street IS NOT NULL THEN concat('property is located at ', street, ', ', city, ', TX') ELSE 'property''s location has not yet been confirmed' END, ' ',
      CASE WHEN sale_date IS NOT NULL THEN concat('is scheduled for foreclosure sale on ', strftime(sale_date, '%B %-d, %Y')) ELSE 'does not yet have a confirmed foreclosure sale date' END, '.'),
      concat('The original deed of trust was recorded around ', strftime(created_at, '%B %-d, %Y'), ' with an original principal amount of $', format('{{:,}}', CAST(round(principal_cents / 100.0::DOUBLE) AS BIGINT)), '.'),
      'The notice does not state the current payoff balance.',
      CASE address_method WHEN 'EXPLICIT_STATED' THEN 'The property address was explicitly stated in the foreclosure notice.'
        WHEN 'COMMONLY_KNOWN_AS_PHRASE' THEN 'The property address was identified from a "commonly known as" phrase in the notice.'
        WHEN 'LEGAL_DESCRIPTION_MATCH' THEN 'The property address was matched to the county appraisal record using the legal description.'
        WHEN 'OWNER_MAILING_ADDRESS_MATCH' THEN 'The property address was matched using the owner''s name against appraisal district records.'
        ELSE 'The property address could not be confidently resolved and this record is pending manual review.' END) AS summary FROM v_pub""")
def summary_text(spark, d):
    none = F.lit(None).cast("string")
    df = publish.publication_inputs(views.cases(spark, d), views.sales(spark, d), views.tasks(spark, d), views.links(spark, d))
    return df.select("case_id", publish.summary("classification", "street", "city", none, "sale_date", "borrower", none, "created_at", "principal_cents", F.lit(None).cast("long"), "address_method").alias("summary"))


# ---- Reports

@query(f"""WITH s AS (SELECT county, count(*) AS n_cases, CAST(floor(avg(value_cents) + 0.5) AS BIGINT) AS avg_value_cents, count(*) FILTER (WHERE classification = 'RESIDENTIAL') AS residential,
    count(*) FILTER (WHERE classification = 'COMMERCIAL') AS commercial, strftime(min(first_sale), '%Y-%m-%d') AS next_sale, CAST(floor(avg(greatest(0, date_diff('day', {DAY}, first_sale))) + 0.5) AS BIGINT) AS avg_days
    FROM v_status WHERE publication_status IN ('PUBLISHED', 'PUBLISHED_WITH_LIMITED_DATA') GROUP BY county)
    SELECT c.county, coalesce(n_cases, 0) AS n_cases, avg_value_cents, coalesce(residential, 0) AS residential, coalesce(commercial, 0) AS commercial, next_sale, avg_days, strftime(newest, '%Y-%m-%d') AS newest_notice
    FROM (SELECT county, max(created_at) AS newest FROM v_case GROUP BY 1) c LEFT JOIN s USING (county)""")
def county_stats(spark, d):
    documents = views.cases(spark, d).select("county", F.col("created_at").alias("collected_at"))
    stats = reports.county_stats(publish.public_only(_published(spark, d)), documents, views.as_of())
    return stats.withColumns({"next_sale": day("next_sale"), "newest_notice": day("newest_notice")})


@query("SELECT count(*) AS total, count(*) FILTER (WHERE archived_at IS NOT NULL) AS archived, count(*) FILTER (WHERE street IS NOT NULL) AS with_street, count(value_cents) AS with_value, count(*) FILTER (WHERE address_confidence >= 0.85) AS sure FROM v_case")
def dashboard_counts(spark, d):
    c = F.col
    return reports.conditional_counts(views.cases(spark, d), {"archived": c("archived_at").isNotNull(), "with_street": c("street").isNotNull(), "with_value": c("value_cents").isNotNull(), "sure": V.confidence_band("address_confidence") == "high"})


@query("SELECT CAST(sum(CASE WHEN c_nationkey < 5 THEN floor((CASE c_mktsegment WHEN 'BUILDING' THEN 7000 ELSE 27000 END) / 12.0 + 0.5) ELSE CASE c_mktsegment WHEN 'BUILDING' THEN 700 ELSE 2700 END END) AS BIGINT) AS mrr_cents FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey % 4 < 3")
def mrr(spark, d):
    """Active, trialing and promotional subscriptions count, cancelled ones do not."""
    plan = F.when(F.col("c_mktsegment") == "BUILDING", "COUNTY").when(F.col("c_mktsegment") == "MACHINERY", "UNLIMITED")
    status = F.get(F.array(*map(F.lit, ("ACTIVE", "TRIALING", "PROMOTIONAL", "CANCELED"))), F.col("c_nationkey") % 4)
    subs = views.table(spark, d, "customer").select(plan.alias("plan"), status.alias("status"), F.when(F.col("c_nationkey") < 5, "YEAR").otherwise("MONTH").alias("interval"))
    return reports.monthly_revenue(subs, spark.sql("SELECT * FROM VALUES ('COUNTY', 700, 7000), ('UNLIMITED', 2700, 27000) AS t(plan, monthly_cents, yearly_cents)"))


COMPLETE = ["borrower", "owner", "street", "value_cents"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS known, count(*) AS total, round(count({c}) * 100.0::DOUBLE / count(*), 1) AS pct FROM v_case" for c in COMPLETE))
def completeness_rates(spark, d):
    return reports.completeness(views.cases(spark, d), COMPLETE)


@query("SELECT county, CASE WHEN borrower IS NULL THEN 'missing' WHEN borrower = 'Unknown owner' THEN 'placeholder' ELSE 'real' END AS borrower_kind, count(*) AS n_cases FROM v_case GROUP BY 1, 2")
def borrower_quality(spark, d):
    return reports.borrower_quality(views.cases(spark, d), ["county"])


@query("""SELECT tier, count(*) AS n_rows FROM (SELECT CASE WHEN street IS NOT NULL AND sale_date IS NOT NULL AND principal_cents > 10000000 AND real_name AND has_legal THEN 'FULLY_USEFUL'
    WHEN sale_date IS NOT NULL AND real_name AND (street IS NOT NULL OR has_legal) THEN 'USEFUL' ELSE 'LIMITED' END AS tier FROM v_pub) GROUP BY 1""")
def usefulness_tiers(spark, d):
    """Principals up to 100,000 stand for unknown ones."""
    told = publish.publication_inputs(views.cases(spark, d), views.sales(spark, d), views.tasks(spark, d), views.links(spark, d))
    c = F.col
    tier = reports.usefulness(c("street").isNotNull(), c("sale_date").isNotNull(), c("principal_cents") > 10_000_000, publish.real_borrower("borrower"), c("has_legal"))
    return reports.histogram(told, tier, "tier")


@query("""SELECT count(*) AS cases, count(n) AS with_candidates, count(*) FILTER (WHERE sel) AS selected, count(*) FILTER (WHERE NOT coalesce(sel, FALSE)) AS for_review,
    round(avg(n), 2) AS avg_candidates, max(n) AS max_candidates FROM v_case LEFT JOIN (SELECT case_id, count(*) AS n, bool_or(selected) AS sel FROM v_candidate GROUP BY 1) USING (case_id)""")
def resolution_funnel(spark, d):
    return reports.funnel(views.cases(spark, d), views.candidates(spark, d))


@query("SELECT CAST(year(l_shipdate) AS INTEGER) AS tax_year, count(*) AS n_rows FROM lineitem GROUP BY 1")
def valuation_year_histogram(spark, d):
    return reports.histogram(views.table(spark, d, "lineitem"), F.year("l_shipdate"), "tax_year")


@query("SELECT publication_status AS row, count(*) FILTER (WHERE classification = 'RESIDENTIAL') AS \"RESIDENTIAL\", count(*) FILTER (WHERE classification = 'COMMERCIAL') AS \"COMMERCIAL\", count(*) FILTER (WHERE classification = 'UNKNOWN') AS \"UNKNOWN\" FROM v_status GROUP BY 1")
def status_bucket_crosstab(spark, d):
    return reports.crosstab(views.publication(spark, d), F.col("publication_status"), F.col("classification"), ["RESIDENTIAL", "COMMERCIAL", "UNKNOWN"])


YEARS = "SELECT l_partkey AS property_id, CAST(year(l_shipdate) AS INTEGER) AS tax_year, bool_or(l_returnflag <> 'N') AS populated, CAST(max(round(l_extendedprice * 100)) AS BIGINT) AS value_cents FROM lineitem GROUP BY 1, 2"


def _years(spark, d):
    li = views.table(spark, d, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("property_id"), F.year("l_shipdate").alias("tax_year")).agg(F.max(F.col("l_returnflag") != "N").alias("populated"), F.max(F.round(F.col("l_extendedprice") * 100)).cast("long").alias("value_cents"))


@query(f"SELECT property_id, max(tax_year) AS tax_year, max_by(value_cents, tax_year) AS value_cents FROM ({YEARS}) WHERE populated GROUP BY 1")
def latest_valuation(spark, d):
    return reports.display_valuation(_years(spark, d), ["property_id"], ["value_cents"])


@query(f"""SELECT property_id, tax_year, populated FROM (SELECT *, coalesce(bool_or(populated) OVER (PARTITION BY property_id ORDER BY tax_year DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS found
    FROM ({YEARS}) WHERE tax_year BETWEEN 1996 AND 1998) WHERE NOT found""")
def valuation_lookback(spark, d):
    return match.valuation_lookback(_years(spark, d), ["property_id"], 1998).select("property_id", "tax_year", "populated")


@query("SELECT case_id, 'appraised' AS provider, value_cents AS amount_cents FROM v_case WHERE value_cents IS NOT NULL UNION ALL SELECT case_id, 'principal', principal_cents FROM v_case")
def valuation_providers(spark, d):
    return reports.unpivot_values(views.cases(spark, d), ["case_id"], {"appraised": "value_cents", "principal": "principal_cents"})


@query("""SELECT case_id, CASE WHEN e IS NULL THEN 'unavailable' WHEN e < 2500000 THEN 'under_25k' WHEN e <= 7500000 THEN '25k_to_75k' ELSE 'over_75k' END AS bucket
    FROM (SELECT case_id, value_cents * 10 - principal_cents AS e FROM v_case)""")
def equity_buckets(spark, d):
    e = V.equity(F.lit(None).cast("long"), F.col("value_cents") * 10, F.lit(None).cast("long"), "principal_cents")
    return views.cases(spark, d).select("case_id", V.equity_bucket(e).alias("bucket"))


RATE = 1 + 6.5 / 100 / 12


@query(f"""SELECT case_id, months, CAST(CAST(greatest(0, floor(principal_cents / 100.0::DOUBLE * ({RATE ** 360!r}::DOUBLE - pow({RATE!r}::DOUBLE, months)) / {RATE ** 360 - 1!r}::DOUBLE * 100 + 0.5)) AS BIGINT) // 1000 AS BIGINT) AS thousandths,
    CASE WHEN months > 0 AND months < 360 THEN 0.4::DOUBLE ELSE 0.25::DOUBLE END AS confidence
    FROM (SELECT *, CAST(least(360, greatest(0, floor(date_diff('second', created_at, TIMESTAMP '{views.AS_OF}') / 86400.0::DOUBLE / 30.44::DOUBLE + 0.5))) AS BIGINT) AS months FROM v_case)""")
def amortized_balance(spark, d):
    b = V.remaining_balance("principal_cents", "created_at", views.as_of())
    return views.cases(spark, d).select("case_id", b.alias("b")).select("case_id", F.col("b.months").alias("months"), F.floor(F.col("b.cents") / 1000).cast("long").alias("thousandths"), F.col("b.confidence").alias("confidence"))


@query("SELECT street AS key, count(*) AS n_cases, string_agg(CAST(case_id AS VARCHAR), ',' ORDER BY case_id) AS case_ids FROM v_case WHERE street IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def address_reuse_clusters(spark, d):
    found = reports.collected(views.cases(spark, d), T.reuse_key("street"), "case_id")
    return found.withColumn("case_ids", F.array_join(F.transform("case_ids", lambda x: x.cast("string")), ","))


@query("SELECT case_id, CASE WHEN row_number() OVER (PARTITION BY county, street ORDER BY created_at, case_id) = 1 THEN street END AS street FROM v_case")
def address_reuse_first_kept(spark, d):
    return extract.without_reused_addresses(views.cases(spark, d), "county", "street", ["created_at", "case_id"]).select("case_id", "street")


# ---- Duplicates

@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return dedup.duplicate_keys(views.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT CAST(sum(n) AS BIGINT) AS documents, count(*) AS distinct_keys, count(*) FILTER (WHERE n > 1) AS groups, CAST(coalesce(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS grouped_rows,
    CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows FROM (SELECT count(*) AS n FROM documents GROUP BY sha256(text))""")
def dedup_group_totals(spark, d):
    return dedup.group_totals(views.table(spark, d, "documents").select(V.content_hash("text").alias("h")), ["h"])


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents")
def exact_text_dups(spark, d):
    """Every document with the first of the documents with its text."""
    docs = views.table(spark, d, "documents").select("doc_id", V.content_hash("text").alias("h"))
    return docs.join(docs.groupBy("h").agg(F.min("doc_id").alias("first_id")), "h").select("doc_id", "first_id")


CANON = """SELECT *, 10.0::DOUBLE * (value_cents IS NOT NULL)::INT + 2.0::DOUBLE * CASE address_method WHEN 'EXPLICIT_STATED' THEN 10 WHEN 'COMMONLY_KNOWN_AS_PHRASE' THEN 6 WHEN 'LEGAL_DESCRIPTION_MATCH' THEN 7 WHEN 'OWNER_MAILING_ADDRESS_MATCH' THEN 4 ELSE 0 END
    + 20.0::DOUBLE * address_confidence AS score FROM v_case"""


@query(f"""SELECT county, canonical_id, n_candidates, n_tied FROM (SELECT county, first(case_id ORDER BY created_at, case_id) AS canonical_id, max(n) AS n_candidates, count(*) AS n_tied
    FROM (SELECT *, max(score) OVER (PARTITION BY county) AS top, count(*) OVER (PARTITION BY county) AS n FROM ({CANON})) WHERE round(top - score, 9) < 0.01 GROUP BY county)""")
def canonical_selection(spark, d):
    score = dedup.canonical_score(F.col("value_cents").isNotNull(), "address_method", "address_confidence", F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0))
    return dedup.canonical(views.cases(spark, d).withColumn("score", score), ["county"]).select("county", "canonical_id", "n_candidates", "n_tied")


@query("""SELECT case_id FROM (SELECT case_id, row_number() OVER (PARTITION BY county, property_id ORDER BY created_at, case_id) AS n FROM v_case c WHERE archived_at IS NULL
    AND NOT EXISTS (SELECT 1 FROM v_case k WHERE k.county = c.county AND k.property_id = c.property_id AND k.created_at < DATE '1996-01-01' AND k.archived_at IS NULL)) WHERE n = 1""")
def identity_antijoin(spark, d):
    cases = views.cases(spark, d).withColumn("number", F.concat(F.lit("00-"), F.col("property_id").cast("string")))
    new = dedup.new_cases(cases.where("archived_at is null"), cases.where("created_at < date'1996-01-01'"), "county", "number", ["created_at", "case_id"])
    return new.select("case_id")


@query("SELECT a.l_orderkey AS case_id FROM (SELECT DISTINCT l_orderkey FROM lineitem) a ANTI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') b ON a.l_orderkey = b.o_orderkey")
def missing_from_database(spark, d):
    return views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id")).distinct().join(views.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("case_id")), "case_id", "left_anti")


@query("SELECT case_id, ordinal FROM (SELECT case_id, row_number() OVER (ORDER BY created_at, case_id) AS ordinal, archived_at FROM v_case) WHERE archived_at IS NULL ORDER BY ordinal LIMIT 40")
def new_target_selection(spark, d):
    """The first 40 cases that are not archived, and their ordinals; the number is the feature."""
    cases = views.cases(spark, d)
    return reports.first_new(cases, cases.where("archived_at is not null"), "case_id", ["created_at", "case_id"], 40).select("case_id", "ordinal")


GRAMS = """SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w)), lambda i: concat(w[i], '_', w[i + 1])))) AS g
    FROM (SELECT doc_id, list_filter(string_split(regexp_replace(upper(replace(regexp_replace(text, '(?i)^Doc-\\d+\\s*', ''), 'ß', 'SS')), '[^A-Z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 1"""


@query(f"""WITH g AS ({GRAMS}), s AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, ',' ORDER BY g)) AS h FROM g GROUP BY 1), r AS (SELECT min(doc_id) AS doc_id, n FROM s GROUP BY h, n),
    k AS (SELECT g.doc_id, g.g, r.n FROM g JOIN r USING (doc_id)), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c, g) AS k FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM k)),
    m AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id
      WHERE a.k <= a.n - ceil(a.n * 0.8) + 1 AND b.k <= b.n - ceil(b.n * 0.8) + 1 AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n))
    SELECT m.a, m.b, round(2.0::DOUBLE * count(*) / (na + nb), 6) AS dice FROM m JOIN k x ON x.doc_id = m.a JOIN k y ON y.doc_id = m.b AND y.g = x.g GROUP BY m.a, m.b, na, nb HAVING 2.0::DOUBLE * count(*) / (na + nb) >= 0.9""")
def near_dup_pairs(spark, d):
    """Representatives of equal bigram sets with a Dice of 0.9; near_dup_members tells their members."""
    return dedup.dice_join(views.table(spark, d, "documents"), "doc_id", "text").select("a", "b", F.round("dice", 6).alias("dice"))


@query(f"""WITH g AS ({GRAMS}), s AS (SELECT doc_id, md5(string_agg(g, ',' ORDER BY g)) AS h FROM g GROUP BY 1)
    SELECT d.doc_id, coalesce(min(d.doc_id) OVER (PARTITION BY h), d.doc_id) AS class_id FROM documents d JOIN s USING (doc_id) UNION ALL SELECT doc_id, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM s)""")
def near_dup_members(spark, d):
    return dedup.text_classes(views.table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "class_id")


@query("""WITH l AS (SELECT c_custkey AS legacy_id, c_nationkey AS nation, c_mktsegment AS segment, substr(c_name, 10, 7) AS stem, c_custkey % 7 AS k, CASE WHEN c_custkey % 40 = 0 THEN concat('F', c_custkey // 40) END AS number,
      CASE WHEN c_custkey % 40 = 1 THEN concat('I', c_custkey // 40) END AS instrument FROM customer),
    i AS (SELECT s_suppkey AS case_id, s_nationkey AS nation, CASE WHEN s_acctbal > 5000 THEN 'BUILDING' ELSE 'MACHINERY' END AS segment, substr(s_name, 10, 7) AS stem, s_suppkey % 7 AS k, concat('F', s_suppkey // 2) AS number,
      CASE WHEN s_suppkey % 3 = 0 THEN concat('I', s_suppkey) END AS instrument FROM supplier),
    p AS (SELECT legacy_id, case_id, (l.nation = i.nation)::INT + (l.segment = i.segment)::INT + (l.stem = i.stem)::INT + ((l.nation = i.nation)::INT + (l.segment = i.segment)::INT + (l.k = i.k)::INT >= 2)::INT AS n FROM l, i),
    b AS (SELECT legacy_id, first(case_id ORDER BY n DESC, case_id) AS best_id, max(n) AS n FROM p WHERE n > 0 GROUP BY 1),
    e AS (SELECT number, max(case_id) AS exact_id FROM i GROUP BY 1), t AS (SELECT instrument, max(case_id) AS instrument_id FROM i WHERE instrument IS NOT NULL GROUP BY 1)
    SELECT legacy_id, CASE WHEN exact_id IS NOT NULL THEN 'A' WHEN instrument_id IS NOT NULL OR n >= 3 THEN 'B' WHEN n >= 1 THEN 'E' ELSE 'C' END AS class, coalesce(exact_id, instrument_id, best_id) AS match_id,
      CAST(CASE WHEN exact_id IS NULL AND instrument_id IS NULL THEN coalesce(n, 0) ELSE 0 END AS BIGINT) AS n_equal FROM l LEFT JOIN b USING (legacy_id) LEFT JOIN e USING (number) LEFT JOIN t USING (instrument)""")
def legacy_best_match(spark, d):
    """Customers against suppliers; two of the three words of an owner's name make the names alike."""
    names = lambda key, nation, segment: dedup.owner_tokens(F.concat_ws(" ", F.concat(F.lit("K"), (F.col(key) % 7).cast("string")), F.concat(F.lit("N"), F.col(nation).cast("string")), segment))
    number = lambda kind, n: F.concat(F.lit(kind), F.floor(n).cast("string"))
    key, segment = F.col("c_custkey"), F.when(F.col("s_acctbal") > 5000, "BUILDING").otherwise("MACHINERY")
    l = views.dealt(views.table(spark, d, "customer")).select(
        key.alias("legacy_id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.substring("c_name", 10, 7).alias("stem"), names("c_custkey", "c_nationkey", F.col("c_mktsegment")).alias("names"),
        F.when(key % 40 == 0, number("F", key / 40)).alias("number"), F.when(key % 40 == 1, number("I", key / 40)).alias("instrument"),
    )
    i = views.dealt(views.table(spark, d, "supplier")).select(
        F.col("s_suppkey").alias("case_id"), F.col("s_nationkey").alias("nation"), segment.alias("segment"), F.substring("s_name", 10, 7).alias("stem"), names("s_suppkey", "s_nationkey", segment).alias("names"),
        number("F", F.col("s_suppkey") / 2).alias("number"), F.when(F.col("s_suppkey") % 3 == 0, number("I", F.col("s_suppkey"))).alias("instrument"),
    )
    return dedup.legacy_matches(l, i, ["nation", "segment", "stem"])


# ---- Matching

@query("""SELECT l_orderkey AS case_id, concat_ws('-', l_suppkey, l_partkey, l_linenumber) AS candidate_id, CASE WHEN pm THEN 0.99::DOUBLE WHEN cm AND lm THEN 0.97::DOUBLE ELSE round(0.05::DOUBLE * cm::INT, 9) END AS score,
    concat_ws(',', CASE WHEN pm THEN 'parcelId' END, CASE WHEN lm AND cm THEN 'subdivision,lot' END, CASE WHEN cm THEN 'city' END) AS matched
    FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_partkey, l_linenumber, l_suppkey = o_custkey AS pm, s_nationkey = c_nationkey AS cm, FALSE AS lm FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey)""")
def candidate_score(spark, d):
    """Parcel and city evidence of line items' suppliers for their orders' customers."""
    t = lambda n: views.table(spark, d, n)
    # Equal rows fall together as keys, before the texts that follow from them are made; dealt before, as few are equal and a scan's task would hold all of its rows.
    j = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    j = j.select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber", "o_custkey", "c_nationkey", "s_nationkey").repartition("l_orderkey").distinct()
    none = F.lit(None).cast("string")
    c = dict(case_id=F.col("l_orderkey"), owner_names=F.array().cast("array<string>"), city=F.col("c_nationkey").cast("string"), parcel_id=F.col("o_custkey").cast("string"), geographic_id=none, legal_text=none, subdivision=none, lot=none, block=none, acreage=F.lit(None).cast("double"), mailing_address=none)
    r = dict(candidate_id=F.concat_ws("-", "l_suppkey", "l_partkey", "l_linenumber"), owner_name=none, situs_address=none, city=F.col("s_nationkey").cast("string"), parcel_id=F.col("l_suppkey").cast("string"), geographic_id=none, legal_text=none, subdivision=none, lot=none, block=none, acreage=F.lit(None).cast("double"))
    pairs = j.select(F.struct(*(v.alias(k) for k, v in c.items())).alias("c"), F.struct(*(v.alias(k) for k, v in r.items())).alias("r"))
    return match.score(pairs).select("c.case_id", "r.candidate_id", "score", text("matched").alias("matched"))


@query("""WITH s AS (SELECT case_id, candidate_id, greatest(score, 0) AS score FROM v_candidate), k AS (SELECT DISTINCT * FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, candidate_id) AS n, lead(score) OVER (PARTITION BY case_id ORDER BY score DESC, candidate_id) AS second, count(*) OVER (PARTITION BY case_id) AS cnt FROM k)
    SELECT case_id, CASE WHEN score >= 0.92 AND (cnt = 1 OR round(score - second, 9) >= 0.15) THEN candidate_id END AS selected_id, round(score, 9) AS confidence, cnt AS candidate_count,
      CASE WHEN score >= 0.92 AND (cnt = 1 OR round(score - second, 9) >= 0.15) THEN concat('Exact parcel ID match to the county appraisal record', CASE WHEN cnt > 1 THEN concat(' (best of ', cnt, ' candidates considered)') ELSE '' END, '.')
        WHEN score >= 0.7 THEN concat('The top candidate scored ', printf('%.2f', score), CASE WHEN second IS NULL THEN ', below the auto-accept threshold' ELSE concat(', only ', printf('%.2f', score - second), ' ahead of the next candidate (', printf('%.2f', second), ')') END, ' — sent to manual review.')
        ELSE concat('No candidate scored above the manual-review threshold (best was ', printf('%.2f', score), ').') END AS explanation FROM r WHERE n = 1""")
def candidate_resolution(spark, d):
    own = views.candidates(spark, d).select("case_id", "candidate_id", F.greatest("score", F.lit(0.0)).alias("score")).distinct()
    full = own.withColumns({"strategy": F.lit(0), "matched": F.array(F.lit("parcelId")), "conflicting": F.array().cast("array<string>")})
    return match.decide(full).select("case_id", "selected_id", "confidence", "candidate_count", "explanation")


@query("SELECT c_custkey AS id, n_name AS cached_id, CAST(c_nationkey + 1 AS INTEGER) AS times_reused FROM customer LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3) ON n_nationkey = c_nationkey WHERE n_name IS NOT NULL UNION ALL SELECT c_custkey, NULL, NULL FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey >= 3")
def match_cache_reuse(spark, d):
    none = F.lit(None).cast("string")
    cases = views.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("x").alias("county"), F.concat(F.lit("Plat, No. "), F.col("c_nationkey").cast("string")).alias("subdivision"), F.lit("1").alias("lot"), none.alias("block"), none.alias("legal_text"))
    cache = views.table(spark, d, "nation").where("n_regionkey < 3").select(F.lit("x").alias("county"), F.concat(F.lit("SUBDIVISION:PLAT NO "), F.col("n_nationkey").cast("string"), F.lit("|LOT:1|BLOCK:")).alias("legal_key"), F.col("n_name").alias("candidate_id"), F.col("n_nationkey").alias("times_reused"))
    return match.reuse_cached(cases, cache).select("id", "cached_id", "times_reused")


@query("""SELECT a.p_name AS a, b.p_name AS b, list_sort(string_split(a.p_name, ' ')) = list_sort(string_split(b.p_name, ' ')) AS related,
    split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2) AS kin FROM (SELECT DISTINCT p_name, p_size FROM part) a JOIN (SELECT DISTINCT p_name, p_size FROM part) b ON a.p_size = b.p_size AND a.p_name < b.p_name""")
def owner_variants_overlap(spark, d):
    p = views.table(spark, d, "part").select("p_name", "p_size").distinct()
    j = p.select(F.col("p_name").alias("a"), "p_size").join(p.select(F.col("p_name").alias("b"), "p_size"), "p_size").where("a < b")
    return j.select("a", "b", N.related("a", "b").alias("related"), N.surnames_match("a", "b").alias("kin"))


# ---- Extraction

@query("SELECT p_partkey AS id, CAST(p_size AS VARCHAR) AS lot, CAST(p_size + 7 AS VARCHAR) AS block, concat(upper(p_type), ' ESTATES') AS subdivision, round(p_size / 4.0, 2) AS acreage FROM part")
def legal_tokens(spark, d):
    raw = F.concat(F.upper("p_type"), F.lit(" ESTATES LOT "), F.col("p_size").cast("string"), F.lit(", BLOCK "), (F.col("p_size") + 7).cast("string"), F.lit(", "), F.format_string("%.2f", F.col("p_size") / 4.0), F.lit(" ACRES"))
    t = views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), extract.legal_tokens(raw).alias("t"))
    return t.select("id", "t.lot", "t.block", "t.subdivision", "t.acreage")


NOTICE = "FROM orders JOIN part ON p_partkey = o_custkey"


@query(f"""SELECT o_orderkey AS doc_id, concat(upper(substr(split_part(p_name, ' ', 1), 1, 1)), substr(split_part(p_name, ' ', 1), 2), ' ', upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2)) AS grantor,
    'Meadow Savings Bank' AS original_mortgagee, 'Summit Ridge Bank' AS lender, 'Harbor Point Loans LLC' AS servicer, CAST(floor(o_totalprice) AS DOUBLE) AS principal, strftime(o_orderdate, '%Y-%m-%d') AS deed_date, strftime(o_orderdate, '%Y-%m-%d') AS recording_date,
    strftime(CAST(o_orderdate AS DATE) + INTERVAL 36 MONTH, '%Y-%m-%d') AS sale_date, '10:00 AM' AS sale_time, 'County Courthouse Steps' AS sale_location, CAST(o_orderkey AS VARCHAR) AS instrument, concat(o_custkey, ' OAK ST, MISSION, TX 78572') AS address,
    CAST(p_size AS VARCHAR) AS lot, CAST(p_size + 7 AS VARCHAR) AS block, concat(upper(p_type), ' ESTATES') AS subdivision, FALSE AS needs_fallback {NOTICE}""")
def notice_fields_roundtrip(spark, d):
    """Fields extracted from notices that were written from orders: they must come back as they were."""
    f = extract.fields(views.notices(spark, d).select("doc_id", "text"))
    v = lambda n: F.col(f"{n}.value")
    return f.select(
        "doc_id", F.array_join(v("grantor_names"), ";").alias("grantor"), v("original_mortgagee").alias("original_mortgagee"), v("lender_name").alias("lender"), v("mortgage_servicer").alias("servicer"), v("original_principal").cast("double").alias("principal"),
        v("deed_date").alias("deed_date"), v("recording_date").alias("recording_date"), v("sale_date").alias("sale_date"), v("sale_time").alias("sale_time"), v("sale_location").alias("sale_location"), v("instrument_number").alias("instrument"), v("property_address").alias("address"),
        F.col("legal.lot").alias("lot"), F.col("legal.block").alias("block"), F.col("legal.subdivision").alias("subdivision"), extract.needs_fallback().alias("needs_fallback"),
    )


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 'NO_ADDRESS_RESOLVED,BORROWER_NAME_CONFLICT,SALE_DATE_CONFLICT' ELSE '' END AS reasons, o_orderstatus = 'F' AS needs_fallback FROM orders JOIN part ON p_partkey = o_custkey")
def review_reasons(spark, d):
    """Notices of finished orders lose all but their instrument number."""
    n = views.notices(spark, d).join(views.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus"), "doc_id")
    cut = n.withColumn("text", F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Instrument No. "), F.col("doc_id").cast("string"))).otherwise(F.col("text")))
    own = extract.pipeline(cut.select("doc_id", "text"))
    return own.select("doc_id", text("review_reasons").alias("reasons"), extract.needs_fallback().alias("needs_fallback"))


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 'SECOND SOURCE' ELSE concat(o_custkey, ' OAK ST, MISSION, TX 78572') END AS address FROM orders JOIN part ON p_partkey = o_custkey")
def merge_prefer_base(spark, d):
    """A fallback's address where the notice has none."""
    n = views.notices(spark, d).join(views.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus"), "doc_id")
    cut = n.withColumn("text", F.when(F.col("o_orderstatus") == "F", "none").otherwise(F.col("text"))).select("doc_id", "text")
    other = cut.select("doc_id", extract.field(F.lit("SECOND SOURCE"), 0.7, F.lit("SECOND SOURCE")).alias("property_address"))
    return extract.merge(extract.fields(cut), other, "doc_id", ("property_address",)).select("doc_id", F.col("property_address.value").alias("address"))


@query("SELECT o_orderkey AS doc_id, concat(CAST(round(o_totalprice * 100) AS BIGINT), ',', CAST(floor(o_totalprice) AS BIGINT) * 100) AS cents FROM orders")
def currency_all(spark, d):
    o = views.table(spark, d, "orders")
    said = F.concat(F.lit("due $"), F.format_string("%,.2f", "o_totalprice"), F.lit(" and $ "), F.format_number(F.floor("o_totalprice"), 0), F.lit(" or $0 or USD 5"))
    return o.select(F.col("o_orderkey").alias("doc_id"), F.array_join(F.transform(V.all_currency_cents(said), lambda c: c.cast("string")), ",").alias("cents"))


@query("SELECT o_orderkey AS doc_id, strftime(o_orderdate, '%Y-%m-%d') AS long_form, strftime(o_orderdate, '%Y-%m-%d') AS short_form FROM orders")
def labeled_dates(spark, d):
    o = views.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("t"))
    long, short = F.concat(F.lit("SALE INFORMATION: "), views.long_date(F.col("t"))), F.concat(F.lit("x\nDate: "), F.date_format("t", "M/d/yyyy"))
    return o.select(F.col("o_orderkey").alias("doc_id"), V.labeled_date(long, [r"(?i)Date of Sale:?", r"(?i)Sale Information:?"]).alias("long_form"), V.labeled_date(short, [r"(?im)^Date:?"]).alias("short_form"))


@query("SELECT c_custkey AS id, upper(c_name) AS filing, replace(upper(c_name), '#', '') AS reuse, replace(upper(c_name), '#', ' ') AS compare, upper(c_name) AS token FROM customer")
def normalisers(spark, d):
    c = views.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), T.filing_number(F.concat(F.lit(" "), F.regexp_replace("c_name", "#", " #"), F.lit(".- "))).alias("filing"), T.reuse_key("c_name").alias("reuse"), T.comparison_key("c_name").alias("compare"), T.legal_token("c_name").alias("token"))


@query("SELECT c_custkey AS id, concat(c_custkey, ' OAK ST') AS street, concat(c_mktsegment, ' ', c_custkey) AS subdivision, upper(c_name) AS surname FROM customer")
def search_terms(spark, d):
    c = views.table(spark, d, "customer")
    n = F.col("c_custkey").cast("string")
    return c.select(F.col("c_custkey").alias("id"), T.street_term(F.concat(n, F.lit(" W. OAK ST, Mission, TX 78572"))).alias("street"), T.subdivision_term(F.concat(F.col("c_mktsegment"), F.lit(" "), n, F.lit(" ESTATES"))).alias("subdivision"), T.surname(F.concat(F.lit("A B "), F.col("c_name"))).alias("surname"))


# ---- Pages, bundles, events

@query("""WITH b AS (SELECT conv_id, turn, turn = 0 OR role = 'system' AS starts, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
    s AS (SELECT conv_id, turn, last, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM b WHERE starts)
    SELECT CAST(conv_id AS VARCHAR) AS bundle_id, turn AS start_page, CASE WHEN nxt IS NULL THEN last + 1 ELSE nxt END - 1 AS end_page FROM s""")
def bundle_ranges(spark, d):
    c = views.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("bundle_id"), F.col("turn").alias("page_no"), F.when((F.col("turn") == 0) | (F.col("role") == "system"), F.concat(F.lit("VG-1-2026-"), F.col("turn").cast("string"))).alias("barcode_text"))
    totals = c.groupBy("bundle_id").agg(F.max("page_no").alias("total_pages"))
    return split.ranges(split.boundaries(c), totals).select("bundle_id", "start_page", "end_page")


@query("SELECT conv_id, md5(string_agg(text, E'\\n\\n' ORDER BY turn, text)) AS text_md5, avg(CAST(turn AS DOUBLE)) AS confidence FROM conversations GROUP BY conv_id")
def page_text_assembly(spark, d):
    c = views.table(spark, d, "conversations").withColumn("c", F.col("turn").cast("double"))
    return split.assemble(c, ["conv_id"], "turn", "text", "c").select("conv_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "confidence")


@query("SELECT page_id, CAST(len(list_distinct(regexp_extract_all(html, '(?i)href=\"([^\"]*)\"', 1))) AS INTEGER) AS n_links, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def page_links(spark, d):
    p = views.table(spark, d, "pages")
    return p.select("page_id", F.size(readers.links("html", ".*")).alias("n_links"), T.grab("html", '<html lang="([a-z]+)"').alias("lang"))


@query("SELECT user_id, event_type, k, event_id FROM (SELECT *, regexp_extract(props, '(\\d+)', 1) AS k, row_number() OVER (PARTITION BY user_id, event_type, regexp_extract(props, '(\\d+)', 1) ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def event_idempotent(spark, d):
    e = views.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return E.idempotent(e, ["user_id", "event_type", "k"], ["ts", "event_id"]).select("user_id", "event_type", "k", "event_id")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    r AS (SELECT user_id, event_id, k, t AS opened, 1 AS n FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.event_id, e.k, CASE WHEN e.t - r.opened >= 3600 THEN e.t ELSE r.opened END, CASE WHEN e.t - r.opened >= 3600 THEN 1 ELSE r.n + 1 END
      FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) SELECT event_id, user_id, n <= 3 AS allowed FROM r""")
def event_rate_limit(spark, d):
    """Three hits in an hour that opens with a user's first."""
    return E.rate_limited(views.table(spark, d, "events"), "user_id", "ts", "event_id", 3600.0, 3)


@query("SELECT user_id, max_by(state, (ts, event_id)) AS state, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS since FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'ACTIVE' WHEN 'error' THEN 'PAST_DUE' WHEN 'signup' THEN 'TRIALING' END AS state FROM events) WHERE state IS NOT NULL GROUP BY user_id")
def subscription_last_state(spark, d):
    out = E.last_state(views.table(spark, d, "events"), "user_id", "ts", "event_id", {"purchase": "ACTIVE", "error": "PAST_DUE", "signup": "TRIALING"})
    return out.select("user_id", "state", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"))


@query("SELECT doc_id AS external_id FROM documents WHERE NOT (lang = 'en' AND n_chars > 500)")
def incremental_skip(spark, d):
    found = views.table(spark, d, "documents").select(F.col("doc_id").alias("external_id"), V.content_hash("text").alias("sha256"), "lang", "n_chars")
    seen = found.where("lang = 'en'").select("external_id", "sha256", F.when(F.col("n_chars") > 500, "SPLIT_COMPLETE").otherwise("PARTIAL").alias("state"))
    return readers.unchanged_skipped(found, seen).select("external_id")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) <= 500 AS within_budget FROM events")
def event_budget(spark, d):
    e = views.table(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return E.within_budget(e, ["user_id"], ["ts", "event_id"], "cents", 50_000).select("event_id", "within_budget")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN concat(n_name, '!') ELSE n_name END AS n_name FROM nation")
def upsert(spark, d):
    n = views.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    changes = n.where("n_regionkey = 1").withColumn("mark", F.explode(F.array(F.lit("?"), F.lit("!")))).select("n_nationkey", F.concat("n_name", "mark").alias("n_name"), "n_regionkey").withColumn("v", F.when(F.col("n_name").endswith("!"), 2).otherwise(1))
    return sinks.upserted(n, changes, ["n_nationkey"], ["v"]).select("n_nationkey", "n_name")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS entity_id, concat('{\"n_name\":\"', n_name, '\"}') AS before, concat('{\"n_name\":\"', n_name, '!\"}') AS after FROM nation WHERE n_regionkey = 1")
def audit_log(spark, d):
    n = views.table(spark, d, "nation")
    after = n.withColumn("n_name", F.when(F.col("n_regionkey") == 1, F.concat("n_name", F.lit("!"))).otherwise(F.col("n_name")))
    return sinks.audit_rows(n, after, "n_nationkey", ["n_name"], "admin", F.lit(views.AS_OF)).select("entity_id", "before", "after")


@query("SELECT o_orderkey AS id, o_orderdate >= DATE '1996-06-01' AND o_orderdate <= DATE '1997-06-01' AS inside FROM orders WHERE o_orderstatus = 'P' OR o_orderdate BETWEEN DATE '1996-06-01' AND DATE '1997-06-01'")
def discovery_range(spark, d):
    """Postings without a date pass both bounds."""
    o = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date")).alias("posted"))
    return readers.in_range(o, "posted", date(1996, 6, 1), date(1997, 6, 1)).select("id", F.col("o_orderdate").between("1996-06-01", "1997-06-01").alias("inside"))
