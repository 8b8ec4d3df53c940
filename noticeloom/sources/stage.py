"""Tables between the steps of a job, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The folder of a local session without spark.checkpoint.dir, by application. It goes when Python ends.
_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local session without one, as in tests, gets a folder that is its own; on a cluster it must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="noticeloom-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return _local[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table in the shared folder: it is made once, and lost executors lose none of it.

    Tables stay until the folder is cleared: what is read from them may still be running.
    """
    path = f"{shared_folder(df.sparkSession)}/noticeloom/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
