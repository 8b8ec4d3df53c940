"""Writers: CSV, JSON reports, upserts, audit rows, swapped tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def csv_line(columns: list[str]) -> Column:
    """A row as a CSV line: quoted where it holds a quote, comma or line end; null is empty."""
    cell = lambda c: F.coalesce(F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c), F.lit(""))
    return F.concat_ws(",", *(cell(F.col(c).cast("string")) for c in columns))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files of `csv_line` rows with CRLF line ends; every part begins with the header."""
    header = ",".join(df.columns)

    def headed(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([header])], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, ["value"])

    df.select(csv_line(df.columns).alias("value")).mapInArrow(headed, "value string").write.option("lineSep", "\r\n").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def upserted(base: DataFrame, changes: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """`base` with the rows of `changes` in place of its own; of several changes to a key the last by `order`.

    A single writer's rewrite: plain Parquet has no row-level updates.
    """
    last = changes
    if order:
        window = Window.partitionBy(*keys).orderBy(*(F.col(o).desc() for o in order))
        last = changes.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")
    return base.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*base.columns))


def audit_rows(before: DataFrame, after: DataFrame, key: str, columns: list[str], actor: str, at: Column) -> DataFrame:
    """One row per changed key with the old and new values as JSON."""
    old = before.select(key, F.to_json(F.struct(*columns)).alias("before"))
    new = after.select(key, F.to_json(F.struct(*columns)).alias("after"))
    return old.join(new, key, "full").where(~F.col("before").eqNullSafe(F.col("after"))).select(F.col(key).cast("string").alias("entity_id"), "before", "after", F.lit(actor).alias("actor"), at.alias("at"))


def swap_table(df: DataFrame, path: str) -> None:
    """Replace a table's folder by one rename, once all of the new one is written.

    A reader sees the old or the new table, but for the moment between the two renames.
    """
    spark: SparkSession = df.sparkSession
    draft, old = f"{path}.draft-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(draft)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hadoop(path)) and not fs.rename(hadoop(path), hadoop(old)):
        raise RuntimeError(f"{path} could not be set aside")
    if not fs.rename(hadoop(draft), hadoop(path)):
        raise RuntimeError(f"{draft} could not be moved to {path}")
    fs.delete(hadoop(old), True)


def selection_manifest(chosen: DataFrame, key: str) -> DataFrame:
    """What a run will take, as one JSON text: keys in order, their number, the last ordinal."""
    keys = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", key))), lambda x: x[key])
    return chosen.agg(F.to_json(F.struct(keys.alias("keys"), F.count(F.lit(1)).alias("n"), F.max("ordinal").alias("window"))).alias("manifest"))
