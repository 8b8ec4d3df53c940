"""Readers: notice bundles and pages as DataFrames, with explicit schemas and no network.

OCR, rendering and barcode decoding have no engine here; their results are input columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V

PAGES = "bundle_id string, page_no int, ocr_text string, ocr_confidence double, barcode_text string"


class CountySource(Protocol):
    """A county's postings: what there is, and its pages. Without `split` a file is one notice."""

    key: str

    def discover(self, spark: SparkSession) -> DataFrame: ...

    def pages(self, spark: SparkSession, found: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class TextFolder:
    """A folder of text files, one notice each."""

    key: str
    path: str

    def discover(self, spark: SparkSession) -> DataFrame:
        files = spark.read.text(self.path, wholetext=True).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("text"))
        return files.select(F.regexp_extract("uri", r"([^/]+)\z", 1).alias("external_id"), "uri", F.lit(None).cast("date").alias("posted_date"), "text", V.content_hash("text").alias("sha256"))

    def pages(self, spark: SparkSession, found: DataFrame) -> DataFrame:
        return found.select(F.col("external_id").alias("bundle_id"), F.lit(1).alias("page_no"), F.col("text").alias("ocr_text"), F.lit(100.0).alias("ocr_confidence"), F.lit(None).cast("string").alias("barcode_text"))


@dataclass(frozen=True)
class PageTable:
    """Pages whose text and barcodes were read elsewhere, as Parquet."""

    key: str
    path: str

    def discover(self, spark: SparkSession) -> DataFrame:
        read = spark.read.schema(PAGES).parquet(self.path)
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", F.coalesce("ocr_text", F.lit("")).alias("t")))), lambda p: p["t"]), "\n\n")
        return read.groupBy(F.col("bundle_id").alias("external_id")).agg(V.content_hash(joined).alias("sha256")).withColumn("posted_date", F.lit(None).cast("date"))

    def pages(self, spark: SparkSession, found: DataFrame) -> DataFrame:
        return spark.read.schema(PAGES).parquet(self.path).join(found.select(F.col("external_id").alias("bundle_id")), "bundle_id", "left_semi")


_registry: dict[str, CountySource] = {}


def register(source: CountySource) -> None:
    _registry[source.key] = source


def county_source(key: str) -> CountySource:
    if key not in _registry:
        raise KeyError(f"no source is registered for {key}; there are {sorted(_registry)}")
    return _registry[key]


def county_sources() -> list[str]:
    return sorted(_registry)


def in_range(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Postings within the bounds; those without a date are in."""
    out = df if start is None else df.where(F.col(column).isNull() | (F.col(column) >= F.lit(start)))
    return out if end is None else out.where(F.col(column).isNull() | (F.col(column) <= F.lit(end)))


def sitemap_pages(sitemaps: DataFrame, column: str = "value") -> DataFrame:
    """Sale pages that sitemap texts name: url, slug, posted_date."""
    urls = F.regexp_extract_all(F.col(column), F.lit(r"<loc>\s*([^<\s]*-PROPERTY-SALE[^<\s]*)\s*</loc>"), F.lit(1))
    named = sitemaps.select(F.explode(F.array_distinct(urls)).alias("url")).withColumn("slug", F.regexp_extract("url", r"([^/]+)/?\z", 1))
    return named.withColumn("posted_date", V.sale_month("slug"))


def sale_documents(pages: DataFrame, html: DataFrame) -> DataFrame:
    """Documents that sale pages (url, slug) link to: url, document_id, document_slug, file_name, posted_date.

    `html` (url, html) are the pages that could be read; a page that is missing, or has no link, waits for the next run.
    """
    link = r"(?i)DocumentCenter/View/(\d+)/([A-Za-z0-9-]*PROPERTY-SALE)"
    own = pages.select("url").join(html.select("url", T.grab("html", link, 1).alias("document_id"), T.grab("html", link, 2).alias("document_slug")), "url").where("document_id is not null")
    return own.select("url", "document_id", "document_slug", F.concat("document_slug", F.lit(".pdf")).alias("file_name"), V.sale_month("document_slug").alias("posted_date"))


def links(html: Column | str, pattern: str) -> Column:
    """Distinct link targets of a page that match; a page without one has none."""
    found = F.regexp_extract_all(T._col(html), F.lit(r'(?i)href="([^"]*)"'), F.lit(1))
    return F.array_distinct(F.filter(found, lambda u: u.rlike(pattern)))


def map_appraisal_rows(raw: DataFrame) -> DataFrame:
    """Raw appraisal rows as typed records: the better of two columns, cents, N/A and blanks as null."""
    number = lambda c: F.regexp_replace(F.trim(c), ",", "").try_cast("double")
    text = lambda *names: F.coalesce(*(T.blank_to_null(F.col(n)) for n in names))
    cents = lambda n: V.half_up(number(F.col(n)) * 100)
    from ..operators.extract import legal_tokens

    own = raw.withColumn("_t", legal_tokens("legal_description"))
    kind = F.upper(F.coalesce("class_code", F.lit("")))
    return own.select(
        F.col("property_id").cast("string").alias("candidate_id"), text("display_name").alias("owner_name"), text("situs", "street_primary").alias("situs_address"), text("city").alias("city"),
        text("parcel_id").alias("parcel_id"), text("geo_id").alias("geographic_id"), text("legal_description").alias("legal_text"), F.coalesce(text("subdivision"), F.col("_t.subdivision")).alias("subdivision"),
        F.coalesce(text("lot"), F.col("_t.lot")).alias("lot"), F.coalesce(text("block"), F.col("_t.block")).alias("block"), F.coalesce(number(F.col("legal_acreage")), number(F.col("size_acres"))).alias("acreage"),
        F.when(kind.contains("RES"), "RESIDENTIAL").when(kind.contains("COM"), "COMMERCIAL").otherwise("UNKNOWN").alias("classification"), cents("market_value").alias("market_cents"), cents("appraised_value").alias("appraised_cents"),
        number(F.col("tax_year")).cast("int").alias("tax_year"), (cents("market_value") > 0).alias("populated"),
    )


def search_records(records: DataFrame, **query) -> DataFrame:
    """Records that all given terms admit: owner by surname, address and subdivision by containment, the rest by equality."""
    out = records
    for name, value in query.items():
        if value is None:
            continue
        if name == "owner_name":
            last = str(value).strip().split()[-1:] or [""]
            out = out.where(F.contains(F.lower("owner_name"), F.lit(last[0].lower())))
        elif name in ("situs_address", "subdivision", "legal_text"):
            out = out.where(F.contains(F.lower(name), F.lit(str(value).strip().lower())))
        else:
            out = out.where(F.lower(F.trim(name)) == str(value).strip().lower())
    return out


def unchanged_skipped(found: DataFrame, seen: DataFrame) -> DataFrame:
    """Bundles to take in: new ones and those whose content changed, or that were never finished."""
    done = seen.where("state = 'SPLIT_COMPLETE'").select("external_id", "sha256")
    return found.join(done, ["external_id", "sha256"], "left_anti")


def targets_only(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose filing number, normalised, is wanted."""
    keys = wanted.select(T.filing_number(column).alias("_k")).where("_k is not null").distinct()
    return df.withColumn("_k", T.filing_number(column)).join(keys, "_k", "left_semi").drop("_k")
