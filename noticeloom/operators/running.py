"""Running sums, ranks and runs over whole tables, without a task that sees all rows of a group.

Rows are dealt to sorted ranges and written once with the number of their range. A range works on its own
rows; what stands before it comes from the earlier ranges, one row each and key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import written


def _ranged(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    return written(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def _inside(keys: list[str], order: list[str | Column]):
    return Window.partitionBy("_range", *keys).orderBy(*order)


def _joined(ranged: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what stands before their range; keys may be null."""
    renamed = before.select(F.col("_range").alias("_at"), *(F.col(k).alias(f"_at_{k}") for k in keys), "_before")
    same = F.col("_range") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_at_{k}"))
    return ranged.join(renamed, same)


def _summed(ranged: DataFrame, keys: list[str], order: list[str | Column], value: Column) -> DataFrame:
    """`ranged` with `_sum`, the sum of `value` over a row and all rows of its keys before it."""
    valued = ranged.withColumn("_value", value)
    sums = valued.groupBy("_range", *keys).agg(F.sum("_value").alias("_all"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_before", F.coalesce(F.sum("_all").over(earlier), F.lit(0)))
    inside = _inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _joined(valued.withColumn("_own", F.sum("_value").over(inside)), before, keys).withColumn("_sum", F.col("_before") + F.col("_own"))


def running_sums(df: DataFrame, keys: list[str], order: list[str | Column], value: Column, name: str) -> DataFrame:
    """`df` with the sum of `value` over a row and all rows of its keys before it.

    `order` must be unique within the keys, so that ranges and sums are. Null values count as 0, null keys are a group. A key
    with most of the rows is as many ranges as its rows need: a range is cut by keys and order together. An empty table
    gives no rows. Ranges hold the columns of `df`, so give it the narrow ones.
    """
    told = _summed(_ranged(df, keys, order), keys, order, F.coalesce(value, F.lit(0)))
    return told.select(*(f"`{c}`" for c in df.columns), F.col("_sum").alias(name))


def ranked(df: DataFrame, order: list[str | Column], name: str = "rank", keys: list[str] | None = None) -> DataFrame:
    """`df` with each row's place (from 1) in `order`, which must be unique, of all rows or of its keys."""
    return running_sums(df, keys or [], order, F.lit(1).cast("long"), name)


def runs(df: DataFrame, keys: list[str], order: list[str], gap: float, name: str = "run") -> DataFrame:
    """`df` with the number of each row's run: a run ends where the next row's first `order` column is `gap` or more later.

    Rows with a null there are runs of their own.
    """
    ranged = _ranged(df, keys, order)
    at = F.col(order[0])
    last = ranged.groupBy("_range", *keys).agg(F.max(at).alias("_last"))
    before = last.withColumn("_before", F.max("_last").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)))
    known = _joined(ranged, before, keys).withColumn("_earlier", F.coalesce(F.lag(at).over(_inside(keys, order)), F.col("_before")))
    begun = known.select(*ranged.columns, F.coalesce((at - F.col("_earlier") >= gap).cast("int"), F.lit(1)).alias("_begins"))
    told = _summed(written(begun, "runs"), keys, order, F.col("_begins"))
    return told.select(*(f"`{c}`" for c in df.columns), F.col("_sum").alias(name))
