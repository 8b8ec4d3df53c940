"""Counts, rates, funnels, histograms and latest values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import values as V
from .publish import real_borrower
from .running import ranked


def pct(part: Column, whole: Column) -> Column:
    """Percentage with one decimal; null of nothing."""
    return F.round(F.try_divide(part.cast("double") * 100, whole.cast("double")), 1)


def county_stats(visible: DataFrame, documents: DataFrame, as_of: Column, key: str = "county") -> DataFrame:
    """Per county of `documents` (county, collected_at): its visible cases, their mean value and classes, the earliest of their
    first sales, the mean of the whole days to those, and when its newest document came. `visible` has first_sale.
    """
    days = F.greatest(F.lit(0).cast("long"), V.days_until("first_sale", as_of))
    stats = visible.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_cases"), V.half_up(F.avg("value_cents")).alias("avg_value_cents"), F.count_if(F.col("classification") == "RESIDENTIAL").alias("residential"),
        F.count_if(F.col("classification") == "COMMERCIAL").alias("commercial"), F.min("first_sale").alias("next_sale"), V.half_up(F.avg(days)).alias("avg_days"),
    )
    newest = documents.groupBy(key).agg(F.max("collected_at").alias("newest_notice"))
    zero = F.lit(0).cast("long")
    return newest.join(stats, key, "left").withColumns({n: F.coalesce(n, zero) for n in ("n_cases", "residential", "commercial")})


def conditional_counts(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row of counts from one scan."""
    return df.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()))


def monthly_revenue(subscriptions: DataFrame, plans: DataFrame, legacy: bool = False) -> DataFrame:
    """Revenue a month in cents of subscriptions in good standing: yearly prices count a twelfth. `legacy` divides the monthly price, as was done once."""
    joined = subscriptions.where(F.col("status").isin(fixed.GOOD_STANDING)).join(plans, "plan")
    yearly = F.col("monthly_cents") if legacy else F.col("yearly_cents")
    return joined.agg(F.coalesce(F.sum(F.when(F.col("interval") == "YEAR", V.half_up(yearly / 12.0)).otherwise(F.col("monthly_cents"))), F.lit(0)).cast("long").alias("mrr_cents"))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: known, total, percentage."""
    counts = df.agg(F.count(F.lit(1)).alias("total"), *(F.count(c).alias(c) for c in columns))
    return counts.select("total", F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("known")) for c in columns))).alias("f")).select(
        "f.field", "f.known", "total", pct(F.col("f.known"), F.col("total")).alias("pct")
    )


def borrower_quality(df: DataFrame, keys: list[str]) -> DataFrame:
    """Real, placeholder and missing borrowers."""
    kind = F.when(F.coalesce(F.length("borrower"), F.lit(0)) == 0, "missing").when(real_borrower("borrower"), "real").otherwise("placeholder")
    return df.groupBy(*keys, kind.alias("borrower_kind")).agg(F.count(F.lit(1)).alias("n_cases"))


def usefulness(address: Column, sale_date: Column, principal: Column, borrower: Column, legal: Column) -> Column:
    """FULLY_USEFUL with all five facts; USEFUL with a sale date, a real borrower and an address or legal text; else LIMITED."""
    a, s, p, b, t = (F.coalesce(k, F.lit(False)) for k in (address, sale_date, principal, borrower, legal))
    return F.when(a & s & p & b & t, "FULLY_USEFUL").when(s & b & (a | t), "USEFUL").otherwise("LIMITED")


def run_summary(bundles: DataFrame, notices: DataFrame, calls: DataFrame) -> DataFrame:
    """One row of what a run did.

    `bundles` has outcome (PROCESSED, SKIPPED_UNCHANGED, FAILED); `notices` outcome, low_confidence, content_source,
    ocr_confidence and reasons; `calls` of the fallback have cost_cents, within_budget and merged.
    """
    is_ = lambda c, v: F.count_if(F.coalesce(F.col(c) == v, F.lit(False)))
    kept = F.col("outcome").isin("persisted", "extraction_failed")
    held = F.col("outcome") != "skipped_not_in_target"
    of_bundles = bundles.agg(
        F.count(F.lit(1)).alias("bundles_discovered"), is_("outcome", "PROCESSED").alias("bundles_processed"), is_("outcome", "SKIPPED_UNCHANGED").alias("bundles_skipped_unchanged"), is_("outcome", "FAILED").alias("bundles_failed")
    )
    of_notices = notices.agg(
        F.count(F.lit(1)).alias("notices_split"), is_("outcome", "skipped_not_in_target").alias("notices_skipped_not_in_target"), F.count_if(held & F.coalesce("low_confidence", F.lit(False))).alias("notices_low_confidence"),
        F.count_if(held & (F.col("content_source") == "ocr")).alias("notices_ocr"), F.count_if(held & (F.col("content_source") == "other")).alias("notices_other_reader"), is_("outcome", "duplicate").alias("notices_duplicate"),
        F.count_if(kept).alias("notices_persisted"), F.count_if(kept).alias("notices_extracted"), is_("outcome", "failed").alias("notices_failed"),
        F.count_if(kept & (F.coalesce(F.size("reasons"), F.lit(0)) > 0)).alias("notices_for_review"), F.round(F.avg(F.when(held, F.col("ocr_confidence"))), 6).alias("avg_ocr_confidence"),
        is_("outcome", "extraction_failed").alias("extraction_errors"),
    )
    of_calls = calls.agg(
        F.count_if("within_budget").alias("fallback_calls"), F.coalesce(F.max(~F.col("within_budget")), F.lit(False)).alias("budget_exhausted"),
        F.coalesce(F.sum(F.when(F.col("within_budget"), F.col("cost_cents"))), F.lit(0)).cast("long").alias("fallback_cost_cents"), F.count_if(F.col("within_budget") & ~F.col("merged")).alias("fallback_errors"),
    )
    return of_bundles.join(of_notices).join(of_calls)


def facet(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column that are neither null nor empty, sorted."""
    return df.select(column).where(F.col(column) != "").distinct().orderBy(column)


def funnel(cases: DataFrame, candidates: DataFrame) -> DataFrame:
    """Cases, those with candidates, selected and for review; mean and most candidates a case. Grouped first."""
    per = candidates.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("selected").cast("int")).alias("sel"))
    told = cases.select("case_id").join(per, "case_id", "left")
    return told.agg(
        F.count(F.lit(1)).alias("cases"), F.count("n").alias("with_candidates"), F.count_if(F.col("sel") == 1).alias("selected"),
        F.count_if(F.coalesce("sel", F.lit(0)) == 0).alias("for_review"), F.round(F.avg("n"), 2).alias("avg_candidates"), F.max("n").alias("max_candidates"),
    )


def histogram(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Values with their number of rows; arrays count each of their elements."""
    one = df.select(value.alias(name))
    if dict(one.dtypes)[name].startswith("array"):
        one = one.select(F.explode(name).alias(name))
    return one.groupBy(name).agg(F.count(F.lit(1)).alias("n_rows"))


def crosstab(df: DataFrame, row: Column, column: Column, values: list[str]) -> DataFrame:
    """Counts of `values` by row, one column each."""
    own = df.select(row.alias("row"), column.alias("c"))
    return own.groupBy("row").agg(*(F.count_if(F.coalesce(F.col("c") == v, F.lit(False))).alias(v) for v in values))


def latest(df: DataFrame, keys: list[str], order: list[Column], keep: int = 1) -> DataFrame:
    """The first `keep` rows of each group; Spark filters groups before it shuffles them."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= keep).drop("_n")


def display_valuation(years: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The latest populated year's values."""
    newest = years.where("populated").groupBy(*keys).agg(F.max(F.struct("tax_year", *columns)).alias("v"))
    return newest.select(*keys, "v.*")


def collected(df: DataFrame, key: Column, id_col: str, least: int = 2) -> DataFrame:
    """Keys that several rows share: key, n_cases, case_ids."""
    own = df.select(key.alias("key"), id_col).where("key is not null and key <> ''")
    counts = own.groupBy("key").agg(F.count(F.lit(1)).alias("n_cases")).where(F.col("n_cases") >= least)
    return own.join(counts, "key").groupBy("key", "n_cases").agg(F.sort_array(F.collect_list(id_col)).alias("case_ids"))


def coverage(total: int, df: DataFrame, suppressed: Column) -> DataFrame:
    """Share of a bundle that was taken in, and events beside suppressed duplicates."""
    return df.agg(F.count(F.lit(1)).alias("ingested"), pct(F.count(F.lit(1)), F.lit(total)).alias("coverage_pct"), (F.count(F.lit(1)) - F.count_if(suppressed)).alias("unique_events"))


def first_new(df: DataFrame, known: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The first `n` rows in order whose key is unknown, and each one's ordinal among all rows. `order` is unique.

    Ordinals come from sorted ranges and their sizes, not from one sorted task.
    """
    flagged = df.join(known.select(key).distinct().withColumn("_old", F.lit(True)), key, "left")
    return ranked(flagged, order, "ordinal").where("_old is null").drop("_old").orderBy("ordinal").limit(n)


def rollup_priority(tasks: DataFrame, rank: Column) -> DataFrame:
    """Per case the smallest rank of its tasks."""
    return tasks.groupBy("case_id").agg(F.min(rank).alias("priority"), F.count(F.lit(1)).alias("n_tasks"))


def unpivot_values(df: DataFrame, keys: list[str], providers: dict[str, str]) -> DataFrame:
    """One row per provider with a value: keys, provider, amount_cents."""
    rows = F.array(*(F.struct(F.lit(p).alias("provider"), F.col(c).cast("long").alias("amount_cents")) for p, c in providers.items()))
    return df.select(*keys, F.explode(rows).alias("v")).select(*keys, "v.*").where("amount_cents is not null")


def bounds(df: DataFrame, x: str, y: str, pad: float = 0.02) -> DataFrame:
    """Points as percentages of their padded box. The box is a bounded aggregate."""
    box = df.agg((F.min(x) - pad).alias("_x0"), (F.max(x) + pad).alias("_x1"), (F.min(y) - pad).alias("_y0"), (F.max(y) + pad).alias("_y1"))
    placed = df.join(F.broadcast(box))
    return placed.withColumns({"left_pct": (F.col(x) - F.col("_x0")) / (F.col("_x1") - F.col("_x0")) * 100, "top_pct": (F.col("_y1") - F.col(y)) / (F.col("_y1") - F.col("_y0")) * 100}).drop("_x0", "_x1", "_y0", "_y1")


def dashboard(documents: DataFrame, jobs: DataFrame, properties: DataFrame, tasks: DataFrame, corrections: DataFrame, requests: DataFrame) -> DataFrame:
    """One row of ten counts and the summed cost of processing; each table is scanned once, and a table without rows counts 0."""
    is_ = lambda c, v: F.count_if(F.coalesce(F.col(c) == v, F.lit(False)))
    parts = [
        documents.agg(F.count(F.lit(1)).alias("documents"), is_("status", "SUMMARIZED").alias("summarized"), is_("status", "DUPLICATE").alias("duplicates"), F.count_if(F.coalesce(F.col("confidence") < fixed.MEDIUM_CONFIDENCE, F.lit(False))).alias("low_confidence"),
                      F.coalesce(F.sum("cost_cents"), F.lit(0)).cast("long").alias("cost_cents")),
        jobs.agg(is_("status", "FAILED").alias("failed_jobs"), is_("status", "DEAD_LETTER").alias("dead_jobs")), properties.agg(is_("address_method", "UNRESOLVED").alias("unresolved")),
        tasks.agg(is_("status", "OPEN").alias("open_tasks")), corrections.agg(is_("status", "OPEN").alias("open_corrections")), requests.agg(is_("status", "OPEN").alias("open_requests")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), how="cross")  # one row each
    return out


def key_sets(left: DataFrame, right: DataFrame, key: Column) -> DataFrame:
    """Distinct keys of two tables with where they are: left, right or both. Null keys are in neither."""
    side = lambda df, name: df.select(key.alias("key"), F.lit(name).alias("side")).where("key is not null")
    told = side(left, "left").unionByName(side(right, "right")).groupBy("key").agg(F.min("side").alias("a"), F.max("side").alias("b"))
    return told.select("key", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("both").alias("side"))
