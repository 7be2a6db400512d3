"""Loads that a lost checkpoint cannot double: what is loaded is known by its source files.

A step writes the rows of the files nobody has loaded yet into the folder of its own load, and then enters those files
in the ledger; the entry is the commit. Readers see the loads the ledger names, so a step that died before its entry
left nothing. A new checkpoint starts over at step 0 and meets files the ledger already has: their rows are left out.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = "_file"
_ENTRIES = "load string, file string, newest timestamp"


def entries(spark: SparkSession, root: str) -> DataFrame:
    """(load, file, newest): the files loaded and the newest event time of each; none before the first load."""
    return read(spark, f"{root}/ledger", _ENTRIES)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table by its path, empty while nothing has been written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def fresh(batch: DataFrame, root: str) -> DataFrame:
    """The rows of a step whose files are not in the ledger."""
    known = entries(batch.sparkSession, root).select("file").distinct()
    return batch.join(known, batch[FILE] == known["file"], "left_anti")


def load_id(step: int, files: DataFrame) -> str:
    """A name that a repeated step finds again and another step never does: from its files, by a mergeable digest."""
    digest = files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("file")), F.sum(F.pmod(F.xxhash64(F.lit(1), "file"), F.lit(2**40)))).head()
    return f"{step:08d}-{hashlib.sha256(repr(tuple(digest)).encode()).hexdigest()[:16]}"


def commit(files: DataFrame, load: str, root: str) -> None:
    """Enter (file, newest) under the load; a repeated step writes the same entry again."""
    entry = files.select(F.lit(load).alias("load"), "file", "newest")
    entry.write.mode("overwrite").parquet(f"{root}/ledger/part={load}")


def committed(rows: DataFrame, root: str) -> DataFrame:
    """Rows of the loads in the ledger; ``rows`` was read from folders ``load=<id>``."""
    loads = entries(rows.sparkSession, root).select(F.col("load").alias("_load")).distinct()
    return rows.join(loads, rows["load"] == loads["_load"], "left_semi")
