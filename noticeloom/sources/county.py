"""County bundles as a data source: `spark.read.format("county_notices")`, and the same as a stream.

A folder holds bundles, one text file each; form feeds part its pages. A bundle is a partition, read where its
task runs. A stream's offset is the name of the last bundle, so bundles arrive under names that sort in order of arrival, as
postings named by date do. Names that begin with . or _ are not bundles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "bundle_id string, page_no int, text string"
PAGE_END = "\f"
#: Letters of a batch of pages. Spark gathers rows by number, so long pages would take much memory; a longer page is a batch alone.
BATCH = 1 << 21


@dataclass
class Bundle(InputPartition):
    name: str


@dataclass(frozen=True)
class Folder:
    """A folder by path or URI; any file system that Arrow opens."""

    path: str
    suffix: str = ".txt"

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if ":" in self.path.split("/")[0] else (fs.LocalFileSystem(), self.path)

    def names(self) -> list[str]:
        from pyarrow import fs

        system, root = self._open()
        found = (f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.is_file)
        return sorted(n for n in found if n.endswith(self.suffix) and n[0] not in "._")

    def pages(self, name: str) -> Iterator[tuple]:
        """Pages in order, one at a time; the end of the last page needs no form feed."""
        import io

        system, root = self._open()
        with system.open_input_stream(f"{root.rstrip('/')}/{name}") as stream, io.TextIOWrapper(stream, "utf-8", newline="") as lines:
            number, rest = 0, ""
            while block := lines.read(1 << 16):
                *whole, rest = (rest + block).split(PAGE_END)
                for text in whole:
                    number += 1
                    yield name, number, text
            if rest:
                yield name, number + 1, rest

    def batches(self, name: str, letters: int = BATCH) -> Iterator:
        """Pages in order as Arrow batches of about so many letters."""
        import pyarrow as pa

        shape = pa.schema([("bundle_id", pa.string()), ("page_no", pa.int32()), ("text", pa.string())])
        held, size = [], 0
        for page in self.pages(name):
            if held and size + len(page[2]) > letters:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), shape)], schema=shape)
                held, size = [], 0
            held.append(page)
            size += len(page[2])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), shape)], schema=shape)


class BundleReader(DataSourceReader):
    def __init__(self, folder: Folder):
        self.folder = folder

    def partitions(self) -> list[Bundle]:
        return [Bundle(n) for n in self.folder.names()]

    def read(self, partition: Bundle | None) -> Iterator:
        if partition is not None:  # a folder without bundles is one partition of nothing
            yield from self.folder.batches(partition.name)


class BundleStream(DataSourceStreamReader):
    def __init__(self, folder: Folder):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": max(self.folder.names(), default="")}

    def partitions(self, start: dict, end: dict) -> list[Bundle]:
        return [Bundle(n) for n in self.folder.names() if start["last"] < n <= end["last"]]

    def read(self, partition: Bundle) -> Iterator:
        yield from self.folder.batches(partition.name)

    def commit(self, end: dict) -> None:
        pass


class CountyNotices(DataSource):
    """Options: path, suffix (by default .txt). Columns: bundle_id, page_no from 1, text."""

    @classmethod
    def name(cls) -> str:
        return "county_notices"

    def schema(self) -> str:
        return SCHEMA

    def _folder(self) -> Folder:
        if "path" not in self.options:
            raise ValueError("county_notices needs the path of a folder of bundles")
        return Folder(self.options["path"], self.options.get("suffix", ".txt"))

    def reader(self, schema) -> BundleReader:
        return BundleReader(self._folder())

    def streamReader(self, schema) -> BundleStream:
        return BundleStream(self._folder())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CountyNotices)
