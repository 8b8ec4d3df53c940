"""Sharded tables by size-tiered compaction, with DataFrame operations only.

Arrivals become small immutable shards as they stand, without a shuffle. Compaction puts shards
into tiers by size, merges runs of one tier into files of a target size, and commits a new
version of the manifest, the list of live shards, by one atomic rename. Readers follow a version;
files of older versions stay until `expire`. Merging never changes a file in place, so a
lost executor or a lost race costs a retry and no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that a merged file aims at; shards from half of it on stay as they are.
TARGET_BYTES = 128 << 20
#: Ratio of sizes between tiers, and shards of a tier that make it worth merging.
FANOUT = 4
MANIFEST = "path string, bytes long, rows long, tier int, generation int"


def _fs(spark: SparkSession, path: str):
    """Hadoop's file system of a path and the path, for listing and the atomic rename."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def tier_of(size: Column, target: int = TARGET_BYTES, fanout: int = FANOUT) -> Column:
    """0 for shards of at least half the target, one more for each `fanout` times smaller."""
    whole = F.ceil(F.log(float(fanout), F.lit(target / 2) / F.greatest(size, F.lit(1)))).cast("int")
    return F.greatest(F.lit(0), whole)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Committed manifest versions, oldest first."""
    fs, path = _fs(spark, f"{root}/manifest")
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Live shards of a version (the newest by default): path, bytes, rows, tier, generation."""
    known = versions(spark, root)
    if not known:
        return spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in map(str.split, MANIFEST.split(", "))))
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/v{version or known[-1]}")


def commit(spark: SparkSession, root: str, shards: DataFrame, base: int) -> int:
    """Publish `shards` as version base + 1; raises if another writer has published it meanwhile.

    The list is written beside the versions and renamed into place. A rename onto a name
    that is taken puts the folder inside it, so the name is looked at before and after.
    """
    version = base + 1
    fs, place = _fs(spark, f"{root}/manifest/v{version}")
    draft = f"{root}/manifest/_draft-{uuid.uuid4().hex}"
    shards.write.parquet(draft)
    _, drafted = _fs(spark, draft)
    if fs.exists(place) or not fs.rename(drafted, place) or fs.exists(_fs(spark, f"{root}/manifest/v{version}/{draft.rsplit('/', 1)[1]}")[1]):
        raise RuntimeError(f"version {version} of {root} was committed by another writer")
    return version


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder with their bytes and rows. Reads no column: Parquet footers have the counts."""
    read = spark.read.parquet(folder).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
    return read.groupBy("path").agg(F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def append(df: DataFrame, root: str) -> int:
    """Add rows as small shards, one a task, and commit. Returns the version.

    Rows are not moved between tasks. No rows make no shard; the version still counts, and tells the columns.
    """
    spark = df.sparkSession
    known = versions(spark, root)
    folder = f"{root}/data/g0-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    fs, path = _fs(spark, folder)
    base = known[-1] if known else 0
    held = manifest(spark, root)
    if any(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(path)):
        fresh = _sizes(spark, folder).where("rows > 0").select("path", "bytes", "rows", tier_of(F.col("bytes")).alias("tier"), F.lit(0).alias("generation"))
        held = held.unionByName(fresh)
    return commit(spark, root, held, base)


def plan(shards: DataFrame, target: int = TARGET_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Shards to merge with their `bin`, a future file of about `target` bytes.

    A tier's shards run in order of size and are cut where their sum passes the target;
    tiers with fewer than `fanout` shards wait, so does a cut of a single shard. The list has
    one row a shard; sums are taken within a hash slice of the tier, so no task gets them all.
    """
    small = shards.withColumn("tier", tier_of(F.col("bytes"), target, fanout)).where("tier > 0")
    full = small.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("all")).where(F.col("n") >= fanout)
    # A slice holds 256 targets or more, so its cuts lose little.
    sliced = small.join(full, "tier").withColumn("slice", F.pmod(F.xxhash64("path"), F.greatest(F.lit(1), F.floor(F.col("all") / (256 * target)))))
    order = Window.partitionBy("tier", "slice").orderBy("bytes", "path").rowsBetween(Window.unboundedPreceding, -1)
    cut = sliced.withColumn("cut", F.floor(F.coalesce(F.sum("bytes").over(order), F.lit(0)) / target))
    binned = cut.withColumn("bin", F.concat_ws("-", F.lit("b"), "tier", "slice", "cut"))
    pairs = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("bin")
    return binned.join(pairs, "bin").select("path", "bytes", "rows", "bin")


def compact(spark: SparkSession, root: str, target: int = TARGET_BYTES, fanout: int = FANOUT) -> int:
    """Merge what `plan` says into one file a bin and commit; returns the newest version.

    Rows go to their bin once, each bin to a task of its own; a bin is bounded by the target and the largest small shard.
    Without anything to merge the version stays. Superseded files stay for older readers. Nulls, repeated rows and columns of
    any name stay as they are.
    """
    known = versions(spark, root)
    if not known:
        raise ValueError(f"nothing is stored in {root}")
    live = manifest(spark, root, known[-1])
    chosen = f"{root}/plan/{uuid.uuid4().hex}"
    planned = plan(live, target, fanout)
    # One row for each future file: few enough to be numbered in one task.
    numbers = planned.select("bin").distinct().withColumn("number", F.row_number().over(Window.orderBy("bin")) - 1)
    planned.join(numbers, "bin").select("path", "bytes", "rows", F.col("number").alias("bin")).write.parquet(chosen)
    bins = spark.read.parquet(chosen)
    n_bins = bins.agg(F.max("bin").alias("n")).first()["n"]
    if n_bins is None:
        return known[-1]
    folder = f"{root}/data/g1-{uuid.uuid4().hex}"
    path, number = (f"noticeloom_{kind}_{uuid.uuid4().hex}" for kind in ("path", "bin"))  # no column of the table has such a name
    rows = _rows(spark, root, bins).withColumn(path, F.col("_metadata.file_path"))
    placed = rows.join(bins.select(F.col("path").alias(path), F.col("bin").alias(number)), path).drop(path)
    placed.repartitionById(n_bins + 1, number).drop(number).write.option("compression", "zstd").parquet(folder)
    merged = _sizes(spark, folder).where("rows > 0").select("path", "bytes", "rows", tier_of(F.col("bytes"), target, fanout).alias("tier"), F.lit(1).alias("generation"))
    return commit(spark, root, live.join(bins.select("path"), "path", "left_anti").unionByName(merged), known[-1])


def _rows(spark: SparkSession, root: str, shards: DataFrame) -> DataFrame:
    """All rows of the folders that shards are in, one folder for each append or compaction; the driver sees folders, not shards."""
    names = shards.select(F.regexp_extract("path", r"/data/(g\d+-[0-9a-f]+)/[^/]+\z", 1).alias("folder")).distinct().collect()
    return spark.read.parquet(*(f"{root}/data/{r['folder']}" for r in names))


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Rows of a version's live shards. Without any it has no rows, and the columns of the newest append that is still there."""
    live = manifest(spark, root, version)
    if live.limit(1).count():
        path = f"noticeloom_path_{uuid.uuid4().hex}"
        rows = _rows(spark, root, live).withColumn(path, F.col("_metadata.file_path"))
        return rows.join(live.select(F.col("path").alias(path)), path, "left_semi").drop(path)
    fs, data = _fs(spark, f"{root}/data")
    folders = sorted((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(data)) if fs.exists(data) else []
    if not folders:
        raise ValueError(f"nothing is stored in {root}")
    return spark.read.parquet(f"{root}/data/{folders[-1][1]}").limit(0)


def expire(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Delete shards that none of the newest `keep` versions lists, and older versions. Returns their paths."""
    known = versions(spark, root)
    live = {r["path"] for v in known[-keep:] for r in manifest(spark, root, v).select("path").collect()}
    gone = sorted({r["path"] for v in known[:-keep] for r in manifest(spark, root, v).select("path").collect()} - live)
    for path in [*gone, *(f"{root}/manifest/v{v}" for v in known[:-keep])]:
        fs, place = _fs(spark, path)
        fs.delete(place, True)
    return gone
