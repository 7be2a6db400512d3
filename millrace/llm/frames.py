"""Small helpers shared by the operators: tables, folds, checked broadcasts and settings."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.durable import cut

__all__ = ["cut", "reach_workers", "read", "split_of", "tidy_shuffles", "up_to_bound"]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def split_of(doc_id: str | Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets`` (a null id counts as empty text)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % buckets


def up_to_bound(small: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where a count proves ``small`` within ``rows``; beyond it Spark shuffles."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def reach_workers(spark: SparkSession) -> None:
    """Let the Python workers of a local session import this package; a cluster gets it by --py-files or an install."""
    context = spark.sparkContext
    root = str(Path(__file__).resolve().parents[2])
    known = context.environment.get("PYTHONPATH", "")
    if context.master.startswith("local") and root not in known.split(":"):
        context.environment["PYTHONPATH"] = ":".join(filter(None, [root, known]))


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Drop the shuffle files of each finished query inside, as every step ends in a written table."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
