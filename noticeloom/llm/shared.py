"""What several training-data operators need: the shared folder, byte words, components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One more than the largest value of a 64-bit signed integer's half range, for readable masks.
MASK63 = (1 << 63) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. A local session without one, as in tests, gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="noticeloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Rows of an Arrow batch: whole texts can be long, and a batch stands in memory several times.
BATCH_ROWS = 1024


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, in a session whose Arrow batches have BATCH_ROWS rows at most."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def give_back() -> None:
    """At a task's start: memory that earlier tasks of this Python worker freed goes back to the system."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its own counsel
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/noticeloom/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """`staged` in buckets of `key`, as many as joins have partitions: joins and groups by it find their rows in place.

    Spark keeps buckets in its catalogue, so the table has a name there until `unstage`.
    """
    spark, mark = df.sparkSession, uuid.uuid4().hex
    path, table = f"{shared_dir(spark)}/noticeloom/{mark}/{name}", f"noticeloom_{mark}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    out = spark.table(table)
    out.staged_at, out.staged_as = path, table
    return out


def let_go(spark: SparkSession) -> None:
    """Plans that nothing holds any more go now, and Spark's cleaner removes their shuffle files."""
    gc.collect()
    spark._jvm.System.gc()


def unstage(*tables: DataFrame) -> None:
    """Remove what `staged` and `bucketed` wrote for `tables`, for when all that was made of them is itself written.

    Nothing is then computed from them again, whichever executors are lost.
    """
    spark = tables[0].sparkSession
    for table in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(table.staged_at)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        if name := getattr(table, "staged_as", None):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    let_go(spark)


def text_bytes(column) -> list:
    """An Arrow string column as a list of bytes or None, without decoding."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def crc32_of_id(column):
    """crc32 of the decimal text of an id; the contracts' folds take remainders of it."""
    return F.crc32(column.cast("string").cast("binary"))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest reachable id for each endpoint of `edges` (u long, v long): columns id, component.

    Each round every id takes the smallest label among itself and its neighbours, then
    jumps to its label's label, so a path of n links needs about log n rounds. Rounds end
    when no label changed. Labels and edges stay distributed; one count per round reaches
    the driver. An empty edge table gives an empty result.
    """
    ends = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = staged(ends.where("u <> v").distinct(), f"{name}-edges")
    labels = staged(both.groupBy(F.col("u").alias("id")).agg(F.least("id", F.min("v")).alias("component")), f"{name}-0")
    rounds = 0
    while True:
        rounds += 1
        near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near"))
        better = labels.join(near, "id", "left").select("id", F.col("component").alias("was"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("component").alias("next"))
        moved = staged(
            better.join(jump, "mid", "left").select("id", "was", F.least("mid", F.coalesce("next", "mid")).alias("component")),
            f"{name}-{rounds}",
        )
        del near, better, jump
        changed = moved.where("was <> component").limit(1).count()
        unstage(labels)
        labels = moved.select("id", "component")
        labels.staged_at = moved.staged_at
        if not changed:
            unstage(both)
            return labels
