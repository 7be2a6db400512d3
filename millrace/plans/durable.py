"""Cut a plan's lineage by writing it to the shared checkpoint folder.

An iterative plan grows with every round, and a layout that later steps refer to row by row must
not be recomputed differently after an executor is lost. Both are solved by a Parquet table in the
folder the session names in ``spark.checkpoint.dir``: it survives executors, and its file sizes
give Catalyst real statistics for choosing the next join.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_local_fallback: dict[str, str] = {}


def durable_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set (local tests)."""
    configured = (
        spark.conf.get(_CONF, None)
        or spark.sparkContext.getConf().get(_CONF, None)
        or spark.sparkContext.getCheckpointDir()
    )
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"set {_CONF} to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_fallback:
        _local_fallback[app] = tempfile.mkdtemp(prefix="millrace-")
    return _local_fallback[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{durable_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"


def table_path(spark: SparkSession, table: str) -> str:
    """A new folder for a version of a table: in the warehouse, never among the intermediates."""
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{warehouse}/millrace/{table.replace('.', '-')}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, keys: Sequence[str], label: str = "cut", *, distinct: bool = False) -> DataFrame:
    """Like ``cut``, the rows laid out by hash of ``keys``: a join on them reads the table without moving its rows.

    There is one bucket per shuffle partition of the session. ``distinct`` drops repeated rows in the same shuffle.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartition(n, *keys)
    name = f"millrace_{label}_{uuid.uuid4().hex}"
    path = fresh_path(spark, label)
    rows = laid.distinct() if distinct else laid
    rows.write.bucketBy(n, *keys).option("path", path).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)
