"""Queries over tables that change: merges, commits of several tables, chains of merged cases, paid fallbacks within a budget."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import values as V
from ..operators import dedup, fallback, match, publish, reports
from ..sources.stage import shared_folder
from ..sources.tables import Tables
from . import views
from .catalogue import query


def _tables(spark) -> Tables:
    return Tables(spark, f"{shared_folder(spark)}/noticeloom/{uuid.uuid4().hex}/tables")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 50 = 7 THEN concat(c_name, '!') ELSE c_name END AS c_name, c_nationkey FROM customer
    UNION ALL SELECT -c_custkey, 'new', NULL FROM customer WHERE c_custkey % 100 = 3""")
def merge_buckets(spark, d):
    """Customers after a merge of changed and new rows, read back; of two changes to a key the later counts, columns without a change stay."""
    c = views.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    own, key = _tables(spark), F.col("c_custkey")
    base = own.commit({"customer": own.replaced(c, ["c_custkey"])}, 0)
    twice = c.where(key % 50 == 7).withColumn("mark", F.explode(F.array(F.lit("?"), F.lit("!")))).select("c_custkey", F.concat("c_name", "mark").alias("c_name"), F.when(F.col("mark") == "!", 2).otherwise(1).alias("v"))
    new = c.where(key % 100 == 3).select((-key).alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(1).alias("v"))
    own.commit({"customer": own.merged("customer", twice.unionByName(new), ["v"])}, base)
    return own.read("customer")


CACHE_KEY = "concat('SUBDIVISION:PLAT ', c_nationkey, '|LOT:', c_custkey % 3, '|BLOCK:')"


@query(f"""WITH approved AS (SELECT o_orderkey AS case_id, min(l_partkey) AS candidate_id, any_value(o_custkey) AS property_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND o_orderkey % 10 = 1 GROUP BY 1),
    m AS (SELECT {CACHE_KEY} AS k, max(candidate_id) AS candidate_id, count(*) AS n FROM approved JOIN customer ON c_custkey = property_id GROUP BY 1), c AS (SELECT DISTINCT {CACHE_KEY} AS k FROM customer WHERE c_nationkey < 5)
    SELECT 'candidate' AS entity, concat(o_orderkey, ':', l_partkey) AS id, CASE WHEN o_orderkey IN (SELECT case_id FROM approved) THEN CASE WHEN (o_orderkey, l_partkey) IN (SELECT case_id, candidate_id FROM approved) THEN 'selected' ELSE 'open' END
      ELSE 'open' END AS state FROM (SELECT DISTINCT o_orderkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
    UNION ALL SELECT 'property', CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey IN (SELECT case_id FROM approved) THEN concat('MANUAL:', (SELECT candidate_id FROM approved WHERE case_id = o_orderkey)) ELSE 'UNRESOLVED' END FROM orders
    UNION ALL SELECT 'task', CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey IN (SELECT case_id FROM approved) THEN 'RESOLVED' ELSE 'OPEN' END FROM orders
    UNION ALL SELECT 'cache', coalesce(m.k, c.k), CASE WHEN m.k IS NULL THEN '1' WHEN c.k IS NULL THEN CAST(n - 1 AS VARCHAR) ELSE CAST(n + 1 AS VARCHAR) END FROM m FULL JOIN c ON c.k = m.k
    UNION ALL SELECT 'audit', CAST(case_id AS VARCHAR), 'APPROVE_PROPERTY_CANDIDATE' FROM approved""")
def approvals(spark, d):
    """Candidates of cases are approved: candidates, properties, review tasks, the match cache and the audit log change in one commit."""
    t = lambda n: views.table(spark, d, n)
    o, own = t("orders"), _tables(spark)
    pairs = o.join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("case_id"), F.col("l_partkey").alias("candidate_id"), "o_orderstatus", F.col("o_custkey").alias("property_id"))
    key = lambda: F.concat(F.lit("SUBDIVISION:PLAT "), F.col("c_nationkey").cast("string"), F.lit("|LOT:"), (F.col("c_custkey") % 3).cast("string"), F.lit("|BLOCK:")).alias("legal_key")
    cache = t("customer").where("c_nationkey < 5").select(F.lit("x").alias("county"), key(), F.lit(0).cast("long").alias("candidate_id"), F.lit(1).cast("long").alias("times_reused")).dropDuplicates(["county", "legal_key"])
    whole = {
        # Dealt before they become distinct: a scan's task would hold all of its rows, as few are equal.
        "candidate": (pairs.select("case_id", "candidate_id", F.lit("open").alias("state")).repartition("case_id").distinct(), ["case_id", "candidate_id"]), "property": (o.select(F.col("o_orderkey").alias("case_id"), F.lit("UNRESOLVED").alias("state")), ["case_id"]),
        "task": (o.select(F.col("o_orderkey").alias("case_id"), F.lit("OPEN").alias("state")), ["case_id"]), "cache": (cache, ["county", "legal_key"]), "audit": (o.limit(0).select(F.col("o_orderkey").alias("case_id"), F.lit("").alias("state")), ["case_id"]),
    }
    base = own.commit({name: own.replaced(df, keys) for name, (df, keys) in whole.items()}, 0)
    approved = pairs.where("o_orderstatus = 'F' and case_id % 10 = 1").groupBy("case_id").agg(F.min("candidate_id").alias("candidate_id"), F.first("property_id").alias("property_id"))
    chosen = approved.select("case_id", F.col("candidate_id").alias("_chosen"))
    matches = approved.join(t("customer"), F.col("c_custkey") == F.col("property_id")).select(F.lit("x").alias("county"), key(), "candidate_id")
    state = lambda value: approved.select("case_id", value.alias("state"))
    own.commit({
        "candidate": own.merged("candidate", own.read("candidate").join(chosen, "case_id").select("case_id", "candidate_id", F.when(F.col("candidate_id") == F.col("_chosen"), "selected").otherwise("open").alias("state"))),
        "property": own.merged("property", state(F.concat(F.lit("MANUAL:"), F.col("candidate_id").cast("string")))), "task": own.merged("task", state(F.lit("RESOLVED"))),
        "cache": own.merged("cache", match.recorded_matches(own.read("cache"), matches)), "audit": own.merged("audit", state(F.lit("APPROVE_PROPERTY_CANDIDATE"))),
    }, base)
    row = lambda name, i, s: own.read(name).select(F.lit(name).alias("entity"), i.alias("id"), s.alias("state"))
    case = F.col("case_id").cast("string")
    out = row("candidate", F.concat_ws(":", "case_id", "candidate_id"), F.col("state")).unionByName(row("cache", F.col("legal_key"), F.col("times_reused").cast("string")))
    for name in ("property", "task", "audit"):
        out = out.unionByName(row(name, case, F.col("state")))
    return out


MERGED = "CASE WHEN o_orderkey % 56 = 0 THEN o_orderkey + 7 WHEN o_orderkey % 8 > 0 THEN o_orderkey - 1 END"


@query(f"""WITH RECURSIVE c AS (SELECT o_orderkey AS id, {MERGED} AS goes FROM orders), w AS (SELECT id, goes, 1 AS n FROM c WHERE goes IS NOT NULL UNION ALL SELECT w.id, c.goes, n + 1 FROM w JOIN c ON c.id = w.goes WHERE c.goes IS NOT NULL AND n < 40)
    SELECT id AS case_id, max(goes) FILTER (WHERE ends AND n < 40) AS final_id, max(n) >= 40 AS cyclic FROM (SELECT w.*, c.goes IS NULL AS ends FROM w LEFT JOIN c ON c.id = w.goes) GROUP BY id""")
def merged_chains(spark, d):
    """Orders as cases merged one into another, in chains, and some in circles."""
    cases = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.expr(MERGED).alias("merged_into"))
    return dedup.merged_into_final(cases)


def _pretend(key: str, attempt: int, text: str) -> tuple[int, str | None]:
    """A provider for tests: what it says follows from the text's number. Costs less than it might."""
    import json

    number, cost = int(text.split()[1]), len(text) - 5
    if number % 4 == 0 and (attempt == 1 or number % 8 == 0):
        return cost, None
    good = not (number % 4 == 1 and (attempt == 1 or number % 8 == 1))
    said = lambda value: {"value": value, "explicitly_stated": True, "confidence": 0.8 if good else 1.8, "supporting_text": "x"}
    return cost, json.dumps({"amount": said(str(number) if number % 3 else "none"), "day": said("2026-01-02")})


NEEDED = "SELECT o_orderkey AS id, concat('Notice ', o_orderkey, repeat('.', CAST(o_orderkey % 50 AS INTEGER))) AS text FROM orders WHERE o_orderkey % 3 < 2"


@query(f"""WITH w AS (SELECT id, length(concat('Notice ', id, ' ', repeat('.', CAST(id % 50 AS INTEGER)))) AS len FROM ({NEEDED})), b AS (SELECT CAST(sum(len) * 11 // 10 AS BIGINT) AS budget FROM w),
    one AS (SELECT id, len, sum(len) OVER (ORDER BY id) <= (SELECT budget FROM b) AS called FROM w), spent AS (SELECT coalesce(sum(len - 5), 0) AS s FROM one WHERE called),
    due AS (SELECT id, len FROM one WHERE called AND id % 4 < 2), un AS (SELECT id, len FROM one WHERE NOT called),
    two AS (SELECT id, attempt, sum(len) OVER (ORDER BY id) + (SELECT s FROM spent) <= (SELECT budget FROM b) AS called FROM (SELECT *, 2 AS attempt FROM due UNION ALL SELECT *, 1 FROM un)),
    n AS (SELECT w.id, w.len, coalesce(one.called, FALSE)::INT + coalesce(two.called, FALSE)::INT AS attempts FROM w JOIN one USING (id) LEFT JOIN two USING (id))
    SELECT id, attempts, CAST(attempts * (len - 5) AS BIGINT) AS cost_cents, CASE WHEN attempts > 0 AND id % 4 >= 2 OR attempts = 2 AND id % 8 IN (4, 5) THEN 'ACCEPTED' WHEN attempts < 2 THEN 'BUDGET' WHEN id % 4 = 0 THEN 'NO_ANSWER' ELSE 'NO_FIELDS' END AS outcome,
      CASE WHEN (attempts > 0 AND id % 4 >= 2 OR attempts = 2 AND id % 8 IN (4, 5)) AND id % 3 > 0 AND id > 0 THEN CAST(id AS VARCHAR) END AS amount FROM n""")
def paid_fallback(spark, d):
    """Two attempts each within a budget that lasts for all first calls and some second ones; the ledger tells what was spent."""
    wanted = views.table(spark, d, "orders").where("o_orderkey % 3 < 2").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Notice "), F.col("o_orderkey").cast("string"), F.lit(" "), F.repeat(F.lit("."), (F.col("o_orderkey") % 50).cast("int"))).alias("text")
    )
    budget = wanted.agg(F.sum(F.length("text"))).first()[0] * 11 // 10
    out, _ = fallback.answered(wanted, _pretend, spark.createDataFrame([], fallback.LEDGER), budget, F.length("text"), {"amount": "number", "day": "date"})
    return out.select("id", "attempts", "cost_cents", "outcome", F.col("fields.amount.value").alias("amount"))


# ---- Reports and texts


@query("""SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents WHERE doc_id % 5 = 0) AS summarized, (SELECT count(*) FROM documents WHERE doc_id % 5 = 1) AS duplicates, (SELECT count(*) FROM documents WHERE n_chars % 100 < 60) AS low_confidence,
    (SELECT CAST(sum(n_chars // 10) AS BIGINT) FROM documents) AS cost_cents, (SELECT count(*) FROM events WHERE event_type = 'error') AS failed_jobs, (SELECT count(*) FROM events WHERE event_type = 'view') AS dead_jobs,
    (SELECT count(*) FROM v_case WHERE address_method = 'UNRESOLVED') AS unresolved, (SELECT count(*) FROM v_task WHERE status = 'OPEN') AS open_tasks, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS open_corrections, 0::BIGINT AS open_requests""")
def admin_dashboard(spark, d):
    t, c = (lambda n: views.table(spark, d, n)), F.col
    docs = t("documents").select(F.when(c("doc_id") % 5 == 0, "SUMMARIZED").when(c("doc_id") % 5 == 1, "DUPLICATE").alias("status"), (c("n_chars") % 100 / 100.0).alias("confidence"), F.floor(c("n_chars") / 10).alias("cost_cents"))
    jobs = t("events").select(F.when(c("event_type") == "error", "FAILED").when(c("event_type") == "view", "DEAD_LETTER").alias("status"))
    fixes = t("customer").select(F.when(c("c_acctbal") < 0, "OPEN").otherwise("CLOSED").alias("status"))
    return reports.dashboard(docs, jobs, views.cases(spark, d), views.tasks(spark, d), fixes, fixes.limit(0))


@query("SELECT k AS key, CASE WHEN count(DISTINCT s) = 2 THEN 'both' ELSE min(s) END AS side FROM (SELECT l_partkey % 700 AS k, 'left' AS s FROM lineitem WHERE l_discount < 0.05 UNION ALL SELECT l_partkey % 1100, 'right' FROM lineitem WHERE l_discount > 0.05) GROUP BY k")
def filing_number_sets(spark, d):
    rows = lambda n, cond: views.table(spark, d, "lineitem").where(cond).select((F.col("l_partkey") % n).alias("k"))
    return reports.key_sets(rows(700, "l_discount < 0.05"), rows(1100, "l_discount > 0.05"), F.col("k"))


@query("SELECT l_orderkey AS case_id, l_linenumber, n FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n <= 3")
def latest_documents(spark, d):
    """The three newest rows of each case, and their places."""
    rows = views.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    kept = reports.latest(rows, ["case_id"], [F.desc("l_shipdate"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")], keep=3)
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("l_shipdate"), "l_linenumber", "l_partkey", "l_suppkey"))
    return kept.select("case_id", "l_linenumber", place.cast("long").alias("n"))


@query("""SELECT case_id, CASE WHEN value_cents IS NULL THEN 'Estimated equity unavailable' ELSE concat('~$', format('{:,}', CAST(floor(value_cents / 100.0 + 0.5) AS BIGINT))) END AS equity, CASE WHEN value_cents IS NULL THEN 'County value unavailable' ELSE concat('$', format('{:,}', CAST(floor(value_cents / 100.0 + 0.5) AS BIGINT))) END AS value,
    CASE WHEN archived_at IS NULL THEN 'Sale date unavailable' ELSE strftime(archived_at, '%b %-d, %Y') END AS day, coalesce(CASE WHEN borrower <> 'Unknown owner' THEN borrower END, 'Owner unavailable') AS owner,
    CASE WHEN NOT (value_cents > 3000000) OR value_cents IS NULL THEN CASE WHEN street IS NULL THEN 'Address not yet available' ELSE 'Address available with paid plan' END ELSE coalesce(street, 'Address not yet available') END AS address FROM v_case""")
def display_texts(spark, d):
    """What a reader sees of a listing, by what is known and whether it is unlocked."""
    cases = views.cases(spark, d).withColumn("unlocked", F.coalesce(F.col("value_cents") > 3_000_000, F.lit(False))).withColumn("pending", F.col("street").isNull())
    shown = publish.masked(cases, F.col("unlocked"), ("street",))
    return shown.select(
        "case_id", V.money_text("value_cents", fixed.NO_EQUITY, "~").alias("equity"), V.money_text("value_cents", fixed.NO_COUNTY_VALUE).alias("value"), V.short_day("archived_at").alias("day"), V.owner_text("borrower").alias("owner"),
        V.address_text("street", "pending", "unlocked").alias("address"),
    )
