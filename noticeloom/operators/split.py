"""Page bundles into notices: boundaries, page ranges, text, and how far to trust it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as T


def boundaries(pages: DataFrame, bundle: str = "bundle_id", page: str = "page_no", barcode: str = "barcode_text") -> DataFrame:
    """Pages whose barcode starts a notice: bundle, start_page, doc_number."""
    return pages.select(bundle, F.col(page).alias("start_page"), T.barcode_number(barcode).alias("doc_number")).where("doc_number is not null")


def ranges(starts: DataFrame, totals: DataFrame, bundle: str = "bundle_id") -> DataFrame:
    """start_page to end_page, both inclusive; a bundle's last notice runs to `total_pages`."""
    following = F.lead("start_page").over(Window.partitionBy(bundle).orderBy("start_page"))
    return starts.join(totals, bundle).withColumn("end_page", F.coalesce(following - 1, F.col("total_pages")))


def assemble(pages: DataFrame, keys: list[str], page: str = "page_no", text: str = "ocr_text", confidence: str = "ocr_confidence") -> DataFrame:
    """Pages joined by an empty line in order, with the mean confidence; no text is ("", 0)."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return pages.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias("text"), F.coalesce(F.avg(confidence), F.lit(0.0)).alias("confidence"))


def notices(pages: DataFrame, bundle: str = "bundle_id") -> DataFrame:
    """Bundles of pages to notices with text. Pages join their notice by a window, not by a range join."""
    marked = pages.withColumn("doc_number", T.barcode_number("barcode_text"))
    so_far = Window.partitionBy(bundle).orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    own = marked.withColumn("start_page", F.last(F.when(F.col("doc_number").isNotNull(), F.col("page_no")), True).over(so_far)).where("start_page is not null")
    text = assemble(own, [bundle, "start_page"])
    span = own.groupBy(bundle, "start_page").agg(F.max("page_no").alias("end_page"), F.max("doc_number").alias("doc_number"))
    return span.join(text, [bundle, "start_page"])


def needs_other_ocr(text, confidence) -> Column:
    return F.coalesce((T._col(confidence) < fixed.OCR_TRUST) | (F.length(F.trim(T._col(text))) < fixed.OCR_LEAST_CHARS), F.lit(True))


def low_confidence(text, start, end) -> Column:
    return (F.length(T._col(text)) < fixed.SHORT_TEXT) | (T._col(end) - T._col(start) + 1 > fixed.LONG_SPAN)
