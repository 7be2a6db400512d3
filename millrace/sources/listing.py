"""Objects under a folder, listed by the tasks: a data source whose partitions are folders.

The driver opens folders level by level only until it has ``width`` of them; each is then walked by one task, a folder
at a time, so neither the driver nor a task holds the listing. Nothing but names, sizes and times is read. A path is
opened by Arrow's file systems (local, HDFS, S3, GCS), since tasks of a Python source have no Spark session.
"""

from __future__ import annotations

import posixpath
import sys
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

WIDTH = 256
BATCH = 10_000
_SCHEMA = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])

# Workers get the classes by value, so a cluster needs no copy of this package for them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Folders(InputPartition):
    """Folders for one task: ``whole`` with all below them, the others for their own files only."""

    folders: tuple[str, ...]
    whole: bool


class ObjectReader(DataSourceReader):
    def __init__(self, root: str, width: int) -> None:
        self.root, self.width = root, width

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def _below(self, store, folder: str) -> tuple[list[str], list]:
        from pyarrow import fs

        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [f.path for f in found if f.type == fs.FileType.Directory], [f for f in found if f.type == fs.FileType.File]

    def partitions(self) -> Sequence[InputPartition]:
        store, top = self._open()
        waiting, opened = deque([top]), []
        while waiting and len(waiting) < self.width:
            folder = waiting.popleft()
            waiting.extend(self._below(store, folder)[0])
            opened.append(folder)
            if len(opened) >= self.width:  # deep and narrow: leave the rest to the tasks
                break
        step = max(1, len(opened) // 16)
        flat = [Folders(tuple(opened[i : i + step]), False) for i in range(0, len(opened), step)]
        return [*flat, *(Folders((f,), True) for f in waiting)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        store, _ = self._open()
        prefix = self.root.split("://")[0] + "://" if "://" in self.root else ""
        waiting, held = deque(partition.folders), []
        while waiting:
            folders, files = self._below(store, waiting.popleft())
            if partition.whole:
                waiting.extendleft(folders)
            held += [(prefix + f.path, f.size, f.mtime) for f in files]
            while len(held) >= BATCH:
                yield _batch(held[:BATCH])
                held = held[BATCH:]
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_SCHEMA)], schema=_SCHEMA)


class Objects(DataSource):
    """``spark.read.format("objects").load(root)`` after ``register``."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return "path string, bytes long, modified timestamp"

    def reader(self, schema) -> ObjectReader:
        return ObjectReader(_as_uri(self.options["path"]), int(self.options.get("width", WIDTH)))


def _as_uri(path: str) -> str:
    """Spark writes local paths as ``file:/x``; Arrow reads ``file:///x``."""
    if path.startswith("file:/") and not path.startswith("file://"):
        return "file://" + path.removeprefix("file:")
    return path if "://" in path else posixpath.abspath(path)


def list_objects(spark: SparkSession, root: str, *, width: int = WIDTH) -> DataFrame:
    """(path, bytes, modified) of every object under ``root``; a missing root has none."""
    spark.dataSource.register(Objects)
    return spark.read.format("objects").option("width", width).load(root)


def hidden(path: Column) -> Column:
    """Whether Spark's readers skip the object: a part of the path starts with ``_`` or ``.`` (but ``_x=1`` is data)."""
    return path.rlike(r"/(?:[._](?!_*[^/=]*=))[^/]*(?:/|$)")


def folder_under(path: Column, root: str) -> Column:
    """The folder of an object relative to ``root``, empty for objects in the root itself."""
    plain = F.regexp_replace(path, r"^[a-z0-9]+:/+", "/")
    top = "/" + _as_uri(root).split("://")[-1].strip("/")
    return F.regexp_replace(F.substr(plain, F.lit(len(top) + 2)), r"/?[^/]*$", "")


def location(spark: SparkSession, table: str) -> str:
    """The folder of a table's current version."""
    described = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'").head()
    if described is None:
        raise ValueError(f"{table} has no location")
    return described["data_type"]


def live_files(spark: SparkSession, table: str) -> DataFrame:
    """(path, bytes, partition) of the data files a table's current version is made of; no row is read.

    A version of a table is a folder of its own here, which the catalog names, so the files under it are the live ones.
    ``partition`` is the ``column=value`` path below it, empty for a table without partitions.
    """
    root = location(spark, table)
    found = list_objects(spark, root)
    inside = F.concat(F.lit("/"), folder_under(F.col("path"), root), F.lit("/"), F.element_at(F.split("path", "/"), -1))
    return found.filter(~hidden(inside)).select("path", "bytes", folder_under(F.col("path"), root).alias("partition"))
