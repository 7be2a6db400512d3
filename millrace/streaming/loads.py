"""Incremental loads as streams: the checkpoint is the position, the ledger is what counts as loaded.

Each micro-batch is one step: it is written, entered in the ledger, and only then committed. An empty step moves the
position forward without an update event, so nothing downstream is woken for no change.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import times
from millrace.operators.ingest import INGESTED_AT, append_if_absent, stringify
from millrace.plans.durable import cut, fresh_path
from millrace.streaming import ledger


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, *, files_per_step: int | None = None, fmt: str = "parquet"
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_step:
        reader = reader.option("maxFilesPerTrigger", files_per_step)
    return reader.load(path)


def _run(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str | None) -> None:
    """Everything available, step by step."""
    query = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint or fresh_path(stream.sparkSession, "stream"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def _with_file(stream: DataFrame) -> DataFrame:
    return stream.select("*", F.col("_metadata.file_path").alias(ledger.FILE))


def incremental_stream_load(
    stream: DataFrame,
    root: str,
    *,
    ingested_at: str,
    on_update: Callable[[int, int], None] | None = None,
    checkpoint: str | None = None,
) -> int:
    """Load everything available as raw strings into ``root``; returns the rows loaded by this call.

    ``stream`` reads files; each of them is loaded once, whatever becomes of the checkpoint. ``on_update(step, rows)``
    fires only for steps that brought rows.
    """
    spark = stream.sparkSession
    loaded = {"rows": 0}

    def step(batch: DataFrame, number: int) -> None:
        rows = ledger.fresh(batch, root)
        files = cut(rows.groupBy(F.col(ledger.FILE).alias("file")).agg(F.lit(None).cast("timestamp").alias("newest")), "files")
        if files.isEmpty():
            return
        load = ledger.load_id(number, files)
        stringify(rows.drop(ledger.FILE), ingested_at).write.mode("overwrite").parquet(f"{root}/rows/load={load}")
        ledger.commit(files, load, root)
        count = spark.read.parquet(f"{root}/rows/load={load}").count()  # from file footers
        loaded["rows"] += count
        if count and on_update:
            on_update(number, count)

    _run(_with_file(stream), step, checkpoint)
    return loaded["rows"]


def loaded_rows(spark: SparkSession, root: str) -> DataFrame:
    return ledger.committed(spark.read.parquet(f"{root}/rows"), root).drop("load")


def latest_per_key(raw: DataFrame, keys: Sequence[str]) -> DataFrame:
    """After overlapping re-reads, the newest load per key."""
    from millrace.operators.ingest import late_overlap

    return late_overlap(raw, keys)


def event_log(spark: SparkSession, root: str, events: DataFrame) -> None:
    """Append update events ``(source, step, rows)`` once per (source, step)."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields)
    stored = ledger.read(spark, root, schema)
    append_if_absent(stored, events, ["source", "step"]).filter("rows > 0").write.mode("append").parquet(root)


def _local(ts: str, tz: str) -> Column:
    """Wall-clock time of the zone, so that a day is cut at local midnight also where the offset changes."""
    return F.convert_timezone(None, F.lit(tz), F.col(ts).cast("timestamp_ntz"))


def daily_tumbling(events: DataFrame, ts: str, *, tz: str = "UTC", measures: Sequence[Column] = ()) -> DataFrame:
    """Day buckets in local time of a batch."""
    day = F.date_format(_local(ts, tz), "yyyy-MM-dd").alias("date")
    return events.groupBy(day).agg(*(measures or [F.count(F.lit(1)).alias("n")]))


def daily_stream(
    stream: DataFrame, ts: str, root: str, *, measures: Mapping[str, Column], tz: str = "UTC", delay: str = "1 day",
    checkpoint: str | None = None,
) -> None:
    """Day buckets in append mode: a day's row is final once the watermark has passed its end.

    The watermark is the newest event time of the steps before, less ``delay``. Rows of a day that was already closed
    when they came are kept in the side table (``late_rows``) and change no bucket: Spark's own watermark would drop
    them unseen. A step writes one partial row per open day it met, never the state of the others; ``measures`` are
    sums or counts, which add up over steps. Rows without a time belong to no day and are kept as late.
    """

    def step(batch: DataFrame, number: int) -> None:
        rows = ledger.fresh(batch, root).withColumn("_local", _local(ts, tz).cast("timestamp"))
        files = cut(rows.groupBy(F.col(ledger.FILE).alias("file")).agg(F.max("_local").alias("newest")), "files")
        if files.isEmpty():
            return
        load = ledger.load_id(number, files)
        mark = ledger.entries(batch.sparkSession, root).agg((F.max("newest") - F.expr(f"INTERVAL {delay}")).alias("_m")).scalar()
        ends = F.date_trunc("day", F.col("_local")) + F.expr("INTERVAL 1 DAY")
        placed = rows.withColumn("_late", F.coalesce(ends <= mark, F.col("_local").isNull()))
        late = placed.filter("_late").drop("_late", "_local", ledger.FILE)
        late.write.mode("overwrite").parquet(f"{root}/late/load={load}")
        parts = placed.filter("not _late").groupBy(F.to_date("_local").alias("day")).agg(*[m.alias(k) for k, m in measures.items()])
        parts.write.mode("overwrite").parquet(f"{root}/days/load={load}")
        ledger.commit(files, load, root)

    _run(_with_file(stream), step, checkpoint)


def closed_days(spark: SparkSession, root: str, *, delay: str = "1 day") -> DataFrame:
    """The final rows so far: date and measures of every day that ended before the watermark."""
    parts = ledger.committed(spark.read.parquet(f"{root}/days"), root)
    mark = ledger.entries(spark, root).agg((F.max("newest") - F.expr(f"INTERVAL {delay}")).alias("_m")).scalar()
    over = parts.filter(F.col("day").cast("timestamp") + F.expr("INTERVAL 1 DAY") <= mark)
    sums = [F.sum(c).alias(c) for c in parts.columns if c not in ("day", "load")]
    return over.groupBy(F.date_format("day", "yyyy-MM-dd").alias("date")).agg(*sums)


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    """Rows that came after their day was closed."""
    return ledger.committed(spark.read.parquet(f"{root}/late"), root).drop("load")


__all__ = [
    "INGESTED_AT", "closed_days", "daily_stream", "daily_tumbling", "event_log", "file_stream", "incremental_stream_load",
    "late_rows", "latest_per_key", "loaded_rows", "times",
]
