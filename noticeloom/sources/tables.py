"""Several tables that change together: one manifest names the version of all of them, and one rename publishes it.

A table's rows lie in a fixed number of buckets by the hash of its keys. A merge rewrites only the buckets that its changes touch;
the others stay the files that they are. Readers follow the newest manifest, or one that they name, so they see all
of a commit or none of it; a writer whose base is no longer the newest is told so and has changed nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a table by default; bounds the manifest and the files of a merge, whatever the table's size.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has committed since the version that a commit was based on."""


@dataclass(frozen=True)
class Staged:
    """A table's entry for the next manifest, already written but not yet seen by anybody."""

    entry: dict
    rewritten: int


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


class Tables:
    """Tables below `root`. Manifests are `root/manifests/<version>.json`, data `root/data/<id>/bucket=<n>`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- Manifests

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        fs, at = _fs(self.spark, f"{self.root}/manifests")
        if not fs.exists(at):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(at)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {}
        text = self.spark.read.text(f"{self.root}/manifests/{version}.json", wholetext=True).first()[0]
        return json.loads(text)

    def commit(self, changes: dict[str, Staged], base: int) -> int:
        """Publish staged tables, and the others as they are, as version base + 1; Conflict if there is one already."""
        entries = self.manifest(base) | {name: s.entry for name, s in changes.items()}
        folder, (fs, place) = f"{self.root}/manifests", _fs(self.spark, f"{self.root}/manifests/{base + 1}.json")
        _, draft = _fs(self.spark, f"{folder}/_{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(entries).encode()))
        out.close()
        # The rename refuses a name that is taken: of two writers one is told.
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri() if place.isAbsoluteAndSchemeAuthorityNull() is False else fs.getUri())
        none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            if self.version() != base:
                raise Conflict(f"{self.root} is at version {self.version()}, not {base}")
            context.rename(fs.makeQualified(draft), fs.makeQualified(place), none)
        except Conflict:
            fs.delete(draft, False)
            raise
        except Exception as error:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(error) or fs.exists(place):
                raise Conflict(f"version {base + 1} of {self.root} was committed by another writer") from error
            raise
        return base + 1

    # --- Reading

    def read(self, name: str, version: int | None = None) -> DataFrame:
        entry = self.manifest(version).get(name)
        if entry is None:
            raise KeyError(f"no table {name} in {self.root}")
        return self._rows(entry, sorted(entry["buckets"].values()))

    def _rows(self, entry: dict, paths: list[str]) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # --- Writing

    @staticmethod
    def _bucket(keys: list[str], n: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int").alias("bucket")

    def _write(self, df: DataFrame, keys: list[str], n: int) -> dict[str, str]:
        """Rows by bucket in a folder of their own; the buckets that have any. A large bucket is several tasks' work, and several files."""
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        df.withColumn("bucket", self._bucket(keys, n)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
        fs, at = _fs(self.spark, path)
        folders = [f.getPath().getName() for f in fs.listStatus(at) if f.isDirectory()]
        return {f.split("=")[1]: f"{path}/{f}" for f in folders if f.startswith("bucket=")}

    def replaced(self, df: DataFrame, keys: list[str], buckets: int = BUCKETS) -> Staged:
        """A whole table, to be committed."""
        found = self._write(df, keys, buckets)
        return Staged({"schema": df.schema.jsonValue(), "keys": keys, "n": buckets, "buckets": found}, len(found))

    def merged(self, name: str, changes: DataFrame, order: list[str] | None = None, version: int | None = None) -> Staged:
        """A table with changed rows in place of its own and new ones added; of several changes to a key the last by `order`. To be committed.

        Only buckets that hold a changed key are read and written. Columns that `changes` lacks keep their values, null for new rows.
        Null keys are a key like others. Without changes nothing is rewritten.
        """
        entry = self.manifest(version)[name]
        keys, n = entry["keys"], entry["n"]
        last = changes
        if order:
            last = changes.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(o).desc() for o in order)))).where("_n = 1").drop("_n")
        touched = sorted(str(r["bucket"]) for r in last.select(self._bucket(keys, n)).distinct().collect())  # `n` rows at most
        if not touched:
            return Staged(entry, 0)
        base = self._rows(entry, [entry["buckets"][b] for b in touched if b in entry["buckets"]])
        given = [c for c in base.columns if c in last.columns and c not in keys]
        side = last.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.col(c).alias(f"_v_{c}") for c in given), F.lit(True).alias("_new"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        both = base.withColumn("_old", F.lit(True)).join(side, same, "full")
        pick = lambda c: F.when(F.col("_old").isNull(), F.col(f"_k_{c}")).otherwise(F.col(c)) if c in keys else F.when(F.col("_new"), F.col(f"_v_{c}")).otherwise(F.col(c)) if c in given else F.col(c)
        found = self._write(both.select(*(pick(c).alias(c) for c in base.columns)), keys, n)
        return Staged(entry | {"buckets": {b: p for b, p in entry["buckets"].items() if b not in touched} | found}, len(found))
