"""The test tables as cases, sales, tasks, links, candidates, notices and hits: as DataFrames, and as SQL.

Orders are cases, customers borrowers and properties, nations counties, suppliers lenders, line items sales, tasks and
candidates, events hits. No table holds a null, so CASEs make some.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "1998-10-01"


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(column: str, values: dict[str, str | None], other: Column) -> Column:
    out = other
    for k, v in reversed(values.items()):
        out = F.when(F.col(column) == k, F.lit(v).cast("string")).otherwise(out)
    return out


METHODS = {"1-URGENT": "EXPLICIT_STATED", "2-HIGH": "COMMONLY_KNOWN_AS_PHRASE", "3-MEDIUM": "LEGAL_DESCRIPTION_MATCH", "4-NOT SPECIFIED": "OWNER_MAILING_ADDRESS_MATCH"}


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions are small and left to Spark's own size check for broadcasting."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    c = F.col
    return joined.select(
        c("o_orderkey").alias("case_id"), c("n_name").alias("county"), c("r_name").alias("state"),
        _case("c_mktsegment", {"BUILDING": None, "MACHINERY": "Unknown owner"}, c("c_name")).alias("borrower"), F.when(c("c_acctbal") >= 0, c("c_name")).alias("owner"),
        F.when(c("o_orderstatus") == "P", c("o_orderdate")).alias("archived_at"), c("o_orderdate").alias("created_at"), F.round(c("o_totalprice") * 100).cast("long").alias("principal_cents"),
        c("c_mktsegment").alias("city"), (F.lit(78500) + c("c_nationkey")).cast("string").alias("zip"),
        F.when(c("o_orderpriority") != "5-LOW", F.concat(c("o_custkey").cast("string"), F.lit(" MAIN ST"))).alias("street"), _case("o_orderpriority", METHODS, F.lit("UNRESOLVED")).alias("address_method"),
        F.round(F.lit(0.5) + c("c_nationkey") / F.lit(50.0), 4).alias("address_confidence"), F.when(c("c_acctbal") > 1000, F.round(c("c_acctbal") * 1000).cast("long")).alias("value_cents"),
        _case("c_mktsegment", {"FURNITURE": "COMMERCIAL", "AUTOMOBILE": "UNKNOWN"}, F.lit("RESIDENTIAL")).alias("classification"), c("o_custkey").alias("property_id"),
        F.lit(True).alias("has_document"), (c("c_acctbal") > 2000).alias("has_legal"), (c("c_acctbal") > 5000).alias("cad_confirmed"),
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    no_date = (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.when(~no_date, F.col("l_shipdate").cast("date")).alias("sale_date"), F.when(F.col("l_linestatus") == "O", "SCHEDULED").otherwise("HELD").alias("sale_status"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = _case("l_returnflag", {"R": "CAD_OWNER_CONFLICT", "A": "LOW_CONFIDENCE"}, F.lit("NO_ADDRESS_RESOLVED"))
    open_ = (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), reason.alias("reason"), F.when(open_, "OPEN").otherwise("RESOLVED").alias("status"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two orders of one customer on one day, and what is known of them."""
    o = table(spark, sf_dir, "orders")
    a = o.select("o_custkey", "o_orderstatus", F.col("o_orderkey").alias("case_a"), F.date_trunc("month", "o_orderdate").alias("m"))
    b = o.select("o_custkey", F.col("o_orderkey").alias("case_b"), F.date_trunc("month", "o_orderdate").alias("m"))
    return a.join(b, ["o_custkey", "m"]).where("case_a < case_b").select("case_a", "case_b", F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("CONFIRMED").alias("status"), F.lit("LIKELY_SAME_EVENT").alias("confidence"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.concat_ws("-", "l_suppkey", "l_partkey", "l_linenumber").alias("candidate_id"), F.round(1 - F.col("l_discount") * 4 - F.col("l_tax"), 4).alias("score"), (F.col("l_discount") == 0).alias("selected")
    )


#: Reasons of review tasks by line number.
LINE_REASONS = {1: "MULTIPLE_APPRAISAL_MATCHES", 2: "NO_ADDRESS_RESOLVED", 3: "CAD_OWNER_CONFLICT", 4: "POSSIBLE_CONTENT_DUPLICATE", 5: "POOR_TEXT_QUALITY", 6: "LOW_CONFIDENCE", 7: "MULTIPLE_APPRAISAL_MATCHES"}


def review_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.create_map(*(F.lit(x) for kv in LINE_REASONS.items() for x in kv))[F.col("l_linenumber")]
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), reason.alias("reason"), F.when(F.col("l_linestatus") == "O", "OPEN").otherwise("RESOLVED").alias("status"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of cases, none for some; those without tax have no score."""
    score = F.when(F.col("l_tax") > 0, F.round(1 - F.col("l_tax") * 8 - F.col("l_discount"), 4))
    return table(spark, sf_dir, "lineitem").where("l_discount <= 0.03").select(F.col("l_orderkey").alias("case_id"), F.concat_ws("-", "l_suppkey", "l_partkey", "l_linenumber").alias("candidate_id"), score.alias("score"))


def publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import publish

    return publish.status(publish.publication_inputs(cases(spark, sf_dir), sales(spark, sf_dir), tasks(spark, sf_dir), links(spark, sf_dir)))


def dealt(df: DataFrame) -> DataFrame:
    """A plain scan, its rows dealt to all cores where its files make fewer tasks than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def long_date(c: Column) -> Column:
    return F.date_format(c, "MMMM d, yyyy")


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A notice text for each order, and the parts it was made of. Reading a notice takes long for its bytes, so orders are dealt out before."""
    o, p = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")), table(spark, sf_dir, "part")
    # What is told of a part is spelt once a part, before orders meet it.
    p = p.select("p_partkey", F.initcap("p_name").alias("grantor"), F.col("p_size").cast("string").alias("lot"), (F.col("p_size") + 7).cast("string").alias("block"), F.upper("p_type").alias("kind"))
    j = o.join(p, F.col("p_partkey") == F.col("o_custkey"))
    own = j.select(
        F.col("o_orderkey").alias("doc_id"), "grantor", F.col("o_orderdate").cast("date").alias("deed"), F.add_months(F.col("o_orderdate").cast("date"), 36).alias("sale"),
        F.floor("o_totalprice").cast("long").alias("dollars"), "lot", "block", "kind", F.col("o_custkey").alias("house"),
    )
    lines = [
        F.lit("NOTICE OF SUBSTITUTE TRUSTEE'S SALE"), F.concat(F.lit("Deed of Trust Date: "), long_date(F.col("deed"))), F.concat(F.lit("Grantor(s): "), F.col("grantor")),
        F.lit("Original Mortgagee: Meadow Savings Bank"), F.lit("Current Mortgagee: Summit Ridge Bank"), F.lit("Mortgage Servicer: Harbor Point Loans LLC"),
        F.concat(F.lit("Recording Date: "), F.date_format("deed", "M/d/yyyy")), F.concat(F.lit("Instrument No. "), F.col("doc_id").cast("string")),
        F.concat(F.lit("Original Principal Amount: $"), F.col("dollars").cast("string"), F.lit(".00")), F.concat(F.lit("Property Address: "), F.col("house").cast("string"), F.lit(" OAK ST, MISSION, TX 78572")),
        F.concat(F.lit("Legal Description: Lot "), F.col("lot"), F.lit(", Block "), F.col("block"), F.lit(", "), F.col("kind"), F.lit(" ESTATES")), F.lit(""),
        F.concat(F.lit("Date of Sale: "), long_date(F.col("sale"))), F.lit("Time of Sale: 10:00 AM"), F.lit("Place of Sale: County Courthouse Steps"),
    ]
    return own.withColumn("text", F.concat_ws("\r\n", *lines))


SQL = {
    "v_case": """v_case AS (SELECT o_orderkey AS case_id, n_name AS county, r_name AS state,
      CASE c_mktsegment WHEN 'BUILDING' THEN NULL WHEN 'MACHINERY' THEN 'Unknown owner' ELSE c_name END AS borrower, CASE WHEN c_acctbal >= 0 THEN c_name END AS owner,
      CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS archived_at, o_orderdate AS created_at, CAST(round(o_totalprice * 100) AS BIGINT) AS principal_cents,
      c_mktsegment AS city, CAST(78500 + c_nationkey AS VARCHAR) AS zip, CASE WHEN o_orderpriority <> '5-LOW' THEN concat(o_custkey, ' MAIN ST') END AS street,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'EXPLICIT_STATED' WHEN '2-HIGH' THEN 'COMMONLY_KNOWN_AS_PHRASE' WHEN '3-MEDIUM' THEN 'LEGAL_DESCRIPTION_MATCH'
        WHEN '4-NOT SPECIFIED' THEN 'OWNER_MAILING_ADDRESS_MATCH' ELSE 'UNRESOLVED' END AS address_method,
      round(0.5::DOUBLE + c_nationkey / 50.0::DOUBLE, 4) AS address_confidence, CASE WHEN c_acctbal > 1000 THEN CAST(round(c_acctbal * 1000) AS BIGINT) END AS value_cents,
      CASE c_mktsegment WHEN 'FURNITURE' THEN 'COMMERCIAL' WHEN 'AUTOMOBILE' THEN 'UNKNOWN' ELSE 'RESIDENTIAL' END AS classification, o_custkey AS property_id,
      TRUE AS has_document, c_acctbal > 2000 AS has_legal, c_acctbal > 5000 AS cad_confirmed
      FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)""",
    "v_sale": """v_sale AS (SELECT l_orderkey AS case_id, CASE WHEN NOT (l_returnflag = 'A' AND l_linestatus = 'O') THEN CAST(l_shipdate AS DATE) END AS sale_date,
      CASE WHEN l_linestatus = 'O' THEN 'SCHEDULED' ELSE 'HELD' END AS sale_status FROM lineitem)""",
    "v_task": """v_task AS (SELECT l_orderkey AS case_id, CASE l_returnflag WHEN 'R' THEN 'CAD_OWNER_CONFLICT' WHEN 'A' THEN 'LOW_CONFIDENCE' ELSE 'NO_ADDRESS_RESOLVED' END AS reason,
      CASE WHEN l_linestatus = 'O' AND l_quantity > 45 THEN 'OPEN' ELSE 'RESOLVED' END AS status FROM lineitem)""",
    "v_link": """v_link AS (SELECT a.o_orderkey AS case_a, b.o_orderkey AS case_b, CASE WHEN a.o_orderstatus = 'O' THEN 'OPEN' ELSE 'CONFIRMED' END AS status
      FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND date_trunc('month', a.o_orderdate) = date_trunc('month', b.o_orderdate) AND a.o_orderkey < b.o_orderkey)""",
    "v_candidate": """v_candidate AS (SELECT l_orderkey AS case_id, concat_ws('-', l_suppkey, l_partkey, l_linenumber) AS candidate_id,
      round(1 - l_discount * 4 - l_tax, 4) AS score, l_discount = 0 AS selected FROM lineitem)""",
    "v_review": "v_review AS (SELECT l_orderkey AS case_id, CASE l_linenumber " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in LINE_REASONS.items()) + " END AS reason, CASE WHEN l_linestatus = 'O' THEN 'OPEN' ELSE 'RESOLVED' END AS status FROM lineitem)",
    "v_scored": """v_scored AS (SELECT l_orderkey AS case_id, concat_ws('-', l_suppkey, l_partkey, l_linenumber) AS candidate_id,
      CASE WHEN l_tax > 0 THEN round(1 - l_tax * 8 - l_discount, 4) END AS score FROM lineitem WHERE l_discount <= 0.03)""",
    "v_dates": """v_dates AS (SELECT case_id, min(sale_date) AS first_sale, CASE WHEN count(*) = count(sale_date) THEN max(sale_date) END AS current_sale,
      max(sale_date) AS sale_date, count(*) AS n_sales FROM v_sale GROUP BY case_id)""",
    "v_pub": """v_pub AS (SELECT c.*, d.sale_date, d.first_sale, d.current_sale, coalesce(d.n_sales, 0) AS n_sales, coalesce(t.crit, FALSE) AS crit, coalesce(x.dup, FALSE) AS dup,
      (c.street IS NOT NULL AND c.address_method <> 'UNRESOLVED' AND (c.address_method IN ('EXPLICIT_STATED', 'COMMONLY_KNOWN_AS_PHRASE') OR c.address_confidence >= 0.7)) AS addr,
      coalesce(c.borrower <> 'Unknown owner', FALSE) AS real_name
      FROM v_case c LEFT JOIN v_dates d USING (case_id)
      LEFT JOIN (SELECT case_id, bool_or(reason = 'CAD_OWNER_CONFLICT') AS crit FROM v_task WHERE status = 'OPEN' GROUP BY case_id) t USING (case_id)
      LEFT JOIN (SELECT DISTINCT case_id, TRUE AS dup FROM (SELECT case_a AS case_id FROM v_link WHERE status = 'OPEN' UNION ALL SELECT case_b FROM v_link WHERE status = 'OPEN')) x USING (case_id))""",
    "v_status": """v_status AS (SELECT *, CASE WHEN archived_at IS NOT NULL THEN 'ARCHIVED' WHEN sale_date IS NULL THEN 'WITHHELD' WHEN crit OR dup THEN 'PENDING_REVIEW'
      WHEN NOT addr AND NOT has_legal THEN 'PENDING_REVIEW' WHEN NOT addr OR NOT real_name OR NOT cad_confirmed THEN 'PUBLISHED_WITH_LIMITED_DATA' ELSE 'PUBLISHED' END AS publication_status,
      CASE WHEN archived_at IS NOT NULL THEN 'archived' WHEN sale_date IS NULL THEN 'missing_or_invalid_source_notice'
      WHEN crit OR dup THEN concat_ws(',', CASE WHEN crit THEN 'CAD_OWNER_CONFLICT' END, CASE WHEN dup THEN 'active_duplicate_link' END)
      WHEN NOT addr AND NOT has_legal THEN 'no_property_identifier'
      ELSE concat_ws(',', CASE WHEN NOT addr THEN 'address_pending' END, CASE WHEN NOT real_name THEN 'borrower_unavailable' END, CASE WHEN NOT cad_confirmed THEN 'cad_unconfirmed' END) END AS reasons,
      CASE WHEN archived_at IS NOT NULL THEN 'No longer active' WHEN sale_date IS NULL THEN 'Unavailable' WHEN crit OR dup OR (NOT addr AND NOT has_legal) THEN 'Pending verification'
      WHEN NOT addr THEN 'Limited data — address pending' WHEN NOT real_name THEN 'Limited data' WHEN NOT cad_confirmed THEN 'Source address' ELSE 'Verified property' END AS investor_label FROM v_pub)""",
}
NEEDS = {"v_dates": ["v_sale"], "v_pub": ["v_case", "v_sale", "v_dates", "v_task", "v_link"], "v_status": ["v_case", "v_sale", "v_dates", "v_task", "v_link", "v_pub"]}


def sql(query: str) -> str:
    """`query` with the definitions of the views that it names."""
    used: list[str] = []
    for name in SQL:
        if f" {name}" in query or f"({name}" in query:
            used += [n for n in [*NEEDS.get(name, []), name] if n not in used]
    own = ", ".join(SQL[n] for n in SQL if n in used)
    if query.startswith("WITH "):
        return f"WITH {own}, {query[5:]}" if used else query
    return f"WITH {own} {query}" if used else query
