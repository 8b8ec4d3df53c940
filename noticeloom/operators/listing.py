"""The listing: filters, joins to children, order, pages."""

from __future__ import annotations

from dataclasses import dataclass, fields
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from .publish import public_only


@dataclass(frozen=True)
class ListingFilter:
    """Filters of the listing; None does not filter. All that are set hold together."""

    county: str | None = None
    city: str | None = None
    zip_code: str | None = None
    property_type: str | None = None
    classification: str | None = None
    min_address_confidence: float | None = None
    value_min_cents: int | None = None
    value_max_cents: int | None = None
    principal_min_cents: int | None = None
    principal_max_cents: int | None = None
    equity_min_cents: int | None = None
    equity_max_cents: int | None = None
    min_extraction_confidence: float | None = None
    sale_from: date | None = None
    sale_to: date | None = None
    borrower: str | None = None
    owner: str | None = None
    lender: str | None = None
    subdivision: str | None = None
    review_status: str | None = None
    has_value: bool | None = None
    has_street: bool | None = None
    created_within_days: int | None = None
    saved_by: int | None = None
    page: int = 1
    page_size: int = 25

    def __post_init__(self):
        if self.page < 1 or not 1 <= self.page_size <= 100:
            raise ValueError("page is 1 or more, page_size 1 to 100")
        for low, high in (("value_min_cents", "value_max_cents"), ("principal_min_cents", "principal_max_cents"), ("equity_min_cents", "equity_max_cents"), ("sale_from", "sale_to")):
            a, b = getattr(self, low), getattr(self, high)
            if a is not None and b is not None and a > b:
                raise ValueError(f"{low} is above {high}")
        for f in fields(self):
            v = getattr(self, f.name)
            if isinstance(v, str) and not 1 <= len(v) <= 200:
                raise ValueError(f"{f.name} has 1 to 200 characters")
            if f.name.endswith("confidence") and v is not None and not 0 <= v <= 1:
                raise ValueError(f"{f.name} is between 0 and 1")


def like(column: str, part: str) -> Column:
    """Contains `part`, whatever the case; % and _ are plain characters."""
    return F.coalesce(F.contains(F.lower(F.col(column)), F.lit(part.lower())), F.lit(False))


def predicates(f: ListingFilter, as_of: Column) -> list[Column]:
    """Conditions on a case's own columns, which Catalyst pushes down to the scan."""
    c, out = F.col, [F.col("archived_at").isNull()]
    for value, column in ((f.county, "county"), (f.zip_code, "zip"), (f.property_type, "property_type"), (f.classification, "classification")):
        if value is not None:
            out.append(c(column) == value)
    for low, high, column in ((f.value_min_cents, f.value_max_cents, "value_cents"), (f.principal_min_cents, f.principal_max_cents, "principal_cents"), (f.equity_min_cents, f.equity_max_cents, "equity_cents")):
        out += [c(column) >= low] if low is not None else []
        out += [c(column) <= high] if high is not None else []
    for least, column in ((f.min_address_confidence, "address_confidence"), (f.min_extraction_confidence, "extraction_confidence")):
        out += [c(column) >= least] if least is not None else []
    for value, columns in ((f.city, ("city",)), (f.borrower, ("borrower", "owner")), (f.owner, ("owner",)), (f.lender, ("mortgagee", "lender")), (f.subdivision, ("subdivision",))):
        if value is not None:
            any_of = F.lit(False)
            for column in columns:
                any_of = any_of | like(column, value)
            out.append(any_of)
    for flag, column in ((f.has_value, "value_cents"), (f.has_street, "street")):
        if flag is not None:
            out.append(c(column).isNotNull() if flag else c(column).isNull())
    if f.created_within_days is not None:
        out.append(c("created_at") >= F.date_sub(as_of, f.created_within_days).cast("timestamp"))
    return out


def select_cases(cases: DataFrame, f: ListingFilter, as_of: Column, sales: DataFrame | None = None, documents: DataFrame | None = None, saved: DataFrame | None = None) -> DataFrame:
    """Cases that all filters admit. What a child table must have is a semi-join on the filtered child."""
    out = cases
    for p in predicates(f, as_of):
        out = out.where(p)
    if sales is not None and (f.sale_from or f.sale_to):
        own = sales.where(F.col("sale_date") >= F.lit(f.sale_from)) if f.sale_from else sales
        own = own.where(F.col("sale_date") <= F.lit(f.sale_to)) if f.sale_to else own
        out = out.join(own, "case_id", "left_semi")
    if documents is not None and f.review_status is not None:
        out = out.join(documents.where(F.col("review_status") == f.review_status), "case_id", "left_semi")
    if saved is not None and f.saved_by is not None:
        out = out.join(saved.where(F.col("profile_id") == f.saved_by), "case_id", "left_semi")
    return out


def with_sales(cases: DataFrame, sales: DataFrame) -> DataFrame:
    """first_sale, current_sale (a sale without a date is the current one: null) and n_sales; grouped before the join."""
    per = sales.groupBy("case_id").agg(
        F.min("sale_date").alias("first_sale"), F.when(F.count_if(F.col("sale_date").isNull()) == 0, F.max("sale_date")).alias("current_sale"), F.count(F.lit(1)).alias("n_sales")
    )
    return cases.join(per, "case_id", "left").withColumn("n_sales", F.coalesce("n_sales", F.lit(0).cast("long")))


def sale_history(sales: DataFrame) -> DataFrame:
    """A case's sales as one ordered array."""
    return sales.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("sale_date", "sale_status"))).alias("sales"))


def upcoming(df: DataFrame, as_of: Column, column: str = "current_sale") -> DataFrame:
    """No sale date yet, or one from today on."""
    return df.where(F.col(column).isNull() | (F.col(column) >= as_of))


def page(df: DataFrame, number: int, size: int, order: list[Column]) -> DataFrame:
    """A page of a total order. Top-k with offset: no full sort."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def listing(cases: DataFrame, f: ListingFilter, as_of: Column, **children: DataFrame) -> DataFrame:
    """The public page: filters, not over yet, visible, most sales first, then the case id."""
    chosen = public_only(upcoming(select_cases(cases, f, as_of, **children), as_of))
    return page(chosen, f.page, f.page_size, [F.col("n_sales").desc(), F.col("case_id")])


def with_saved(items: DataFrame, saved: DataFrame, profile_id: int | None) -> DataFrame:
    """`items` with is_saved: whether the reader has saved their property. Without a reader, or a property, it is false."""
    if profile_id is None:
        return items.withColumn("is_saved", F.lit(False))
    own = saved.where(F.col("profile_id") == profile_id).select("property_id", F.lit(True).alias("is_saved")).distinct()
    return items.join(own, "property_id", "left").withColumn("is_saved", F.coalesce("is_saved", F.lit(False)))


def total_count(cases: DataFrame, f: ListingFilter, as_of: Column, free: bool = False, **children: DataFrame) -> DataFrame:
    """The number of cases that the listing has over all pages; those without a plan see 20 at most."""
    n = public_only(upcoming(select_cases(cases, f, as_of, **children), as_of)).agg(F.count(F.lit(1)).alias("total_count"))
    return n.withColumn("total_count", F.least("total_count", F.lit(20))) if free else n


def page_size_for(plan: str, asked: int) -> int:
    return min(asked, 20 if plan == "FREE" else 100)


def envelope(items: DataFrame, total: DataFrame, f: ListingFilter) -> DataFrame:
    """One JSON text with a page's items, its place and the total."""
    listed = items.agg(F.collect_list(F.struct(*items.columns)).alias("items"))
    return listed.join(total).select(F.to_json(F.struct("items", F.lit(f.page).alias("page"), F.lit(f.page_size).alias("pageSize"), F.col("total_count").alias("totalCount"))).alias("body"))


def investor_search(df: DataFrame, text: str | None = None, city: str | None = None, sale_within_days: int | None = None, equity: str | None = None, as_of: Column | None = None) -> DataFrame:
    """Filters of the investor's view: text in any of five columns, city, coming sale, equity bucket. Earliest sale first."""
    out = df
    if text:
        any_of = F.lit(False)
        for column in ("street", "city", "borrower", "lender", "subdivision"):
            any_of = any_of | like(column, text)
        out = out.where(any_of)
    if city:
        out = out.where(F.col("city") == city)
    if sale_within_days is not None:
        out = out.where(V.days_until("current_sale", as_of).between(0, sale_within_days))
    if equity:
        out = out.where(V.equity_bucket("equity_cents") == equity)
    return out.orderBy(F.col("current_sale").asc_nulls_last(), "case_id")


def typeahead(names: DataFrame, part: str) -> DataFrame:
    """County names that contain `part`: the first 8, of none the first 6. Active ones first."""
    own = names.where(like("county", part)) if part.strip() else names
    return own.orderBy(F.col("active").desc(), "county").limit(8 if part.strip() else 6)


def export_rows(df: DataFrame, allowed: Column, most: int = 5000) -> DataFrame:
    """The first `most` rows of the export, then those in counties that the reader has. The order of the two counts."""
    return df.orderBy("case_id").limit(most).where(allowed)


def detail(cases: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows for ids that name a property or else a case: a property wins."""
    by_property = wanted.join(cases.where("property_id is not null").withColumnRenamed("property_id", "id"), "id").withColumn("_by", F.lit(0))
    by_case = wanted.join(cases.withColumn("id", F.col("case_id")).drop("property_id"), "id").withColumn("_by", F.lit(1))
    both = by_property.unionByName(by_case, allowMissingColumns=True)
    first = Window.partitionBy("id").orderBy("_by", "case_id")
    return both.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_by")


def by_rank(df: DataFrame, column: str, order: list[str], then: list[str]) -> DataFrame:
    """Sorted by the place of a value in a list, as an enumeration sorts."""
    return df.orderBy(F.array_position(F.array(*map(F.lit, order)), F.col(column)), *then)
