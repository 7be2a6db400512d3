"""Streaming operators fed from the supplied tables through a file source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.durable import fresh_path
from millrace.registry.book import book
from millrace.registry.facts import table
from millrace.streaming import changes, loads


@book.entry(
    "incremental_stream_load",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, 'now' AS _ingested_at FROM events""",
)
def stream_load(spark: SparkSession, sf: str) -> DataFrame:
    landing, root, mark = (fresh_path(spark, p) for p in ("landing", "raw", "position"))
    rows = table(spark, sf, "events").select("event_id", "event_type")
    rows.filter("event_type <> 'view'").write.parquet(landing)
    stream = loads.file_stream(spark, landing, rows.schema)
    loads.incremental_stream_load(stream, root, ingested_at="now", checkpoint=mark)
    # A second run picks up only what landed since; a third finds nothing and adds nothing.
    rows.filter("event_type = 'view'").write.mode("append").parquet(landing)
    for _ in range(2):
        loads.incremental_stream_load(stream, root, ingested_at="now", checkpoint=mark)
    return loads.loaded_rows(spark, root)


@book.entry(
    "skip_when_empty",
    "SELECT 'events' AS source, CAST(0 AS BIGINT) AS step, count(*) AS rows FROM events",
)
def skip_when_empty(spark: SparkSession, sf: str) -> DataFrame:
    landing, root, mark, log = (fresh_path(spark, p) for p in ("landing", "raw", "position", "log"))
    rows = table(spark, sf, "events").select("event_id")
    rows.write.parquet(landing)

    def woken(step: int, n: int) -> None:
        loads.event_log(spark, log, spark.createDataFrame([("events", step, n)], "source string, step long, rows long"))

    stream = loads.file_stream(spark, landing, rows.schema)
    loads.incremental_stream_load(stream, root, ingested_at="now", checkpoint=mark, on_update=woken)
    rows.limit(0).write.mode("append").parquet(landing)
    loads.incremental_stream_load(stream, root, ingested_at="now", checkpoint=mark, on_update=woken)
    return spark.read.parquet(log)


_OBSERVED = """obs AS (SELECT 'n' || CAST(user_id AS VARCHAR) AS id, ts AS seen_at, event_id AS tick,
    CASE WHEN event_type IN ('click','view') THEN 'run' WHEN event_type = 'error' THEN 'err' ELSE 'ok' END AS state FROM events)"""
_CHANGES = f"""WITH {_OBSERVED}, l AS (SELECT *, lag(state) OVER (PARTITION BY id ORDER BY seen_at, tick) AS before FROM obs)
   SELECT id, CAST(seen_at AS VARCHAR) AS seen_at, state FROM l WHERE before IS NULL OR before <> state"""


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("id"), F.col("ts").cast("timestamp").alias("seen_at"),
        F.col("event_id").alias("tick"),
        F.when(kind.isin("click", "view"), "run").when(kind == "error", "err").otherwise("ok").alias("state"),
    )


@book.entry("status_changes", _CHANGES)
def status_changes(spark: SparkSession, sf: str) -> DataFrame:
    return changes.status_changes(_observed(spark, sf)).select("id", F.col("seen_at").cast("string").alias("seen_at"), "state")


@book.entry("status_change_stream", _CHANGES)
def status_stream(spark: SparkSession, sf: str) -> DataFrame:
    landing, root, mark = (fresh_path(spark, p) for p in ("observed", "changes", "position"))
    rows = _observed(spark, sf)
    # Three arrivals out of order, all within the delay; the last row ends the stream.
    for turn in (2, 0, 1):
        rows.filter(F.col("tick") % 3 == turn).write.mode("append").parquet(landing)
        stream = loads.file_stream(spark, landing, rows.schema)
        changes.status_change_stream(stream, root, delay="400 days", checkpoint=mark)
    changes.close(spark, landing, "2030-01-01")
    changes.status_change_stream(stream, root, delay="400 days", checkpoint=mark)
    out = changes.emitted_changes(spark, root)
    return out.select("id", F.col("seen_at").cast("string").alias("seen_at"), "state")


@book.entry(
    "run_end_marker",
    f"""WITH {_OBSERVED}, r AS (SELECT strftime(seen_at, '%Y-%m-%d') AS run, * FROM obs WHERE state <> 'run'),
        l AS (SELECT *, row_number() OVER (PARTITION BY run, id ORDER BY seen_at DESC, tick DESC) AS rn FROM r)
        SELECT run, CASE WHEN count(*) FILTER (WHERE state = 'err') > 0 THEN 'err' ELSE 'ok' END AS status,
               arg_min(id, CAST(substr(id, 2) AS BIGINT)) FILTER (WHERE state = 'err') AS failed_node FROM l WHERE rn = 1 GROUP BY 1""",
)
def end_marker(spark: SparkSession, sf: str) -> DataFrame:
    seen = _observed(spark, sf).filter("state <> 'run'").withColumn("run", F.date_format("seen_at", "yyyy-MM-dd"))
    order = table(spark, sf, "events").select(
        F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("id"), F.col("user_id").alias("seq")).distinct()
    return changes.end_marker(seen, order)


_DAILY = """SELECT strftime(ts + INTERVAL {h} HOUR, '%Y-%m-%d') AS date, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors
   FROM events GROUP BY 1"""


def _daily_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")


def _measures() -> dict[str, Column]:
    return {"n": F.count(F.lit(1)), "errors": F.count_if(F.col("event_type") == "error")}


@book.entry("daily_tumbling", _DAILY.format(h=9))
def daily_batch(spark: SparkSession, sf: str) -> DataFrame:
    measures = [m.alias(k) for k, m in _measures().items()]
    return loads.daily_tumbling(_daily_rows(spark, sf), "ts", tz="Asia/Seoul", measures=measures)


def _streamed(spark: SparkSession, sf: str) -> str:
    """Events by day in order, then every thirteenth event of the first days once more too late; the folder they load to.

    The second run has lost its checkpoint: it reads all files again and loads only the new one.
    """
    landing, root = fresh_path(spark, "days"), fresh_path(spark, "buckets")
    rows = _daily_rows(spark, sf)
    first = rows.agg(F.min("ts")).scalar()
    newest = rows.agg(F.max("ts")).scalar()
    for arrival in (
        rows.filter(F.col("ts") < newest - F.expr("INTERVAL 2 DAYS")), rows.filter(F.col("ts") >= newest - F.expr("INTERVAL 2 DAYS")),
        rows.filter((F.col("event_id") % 13 == 0) & (F.col("ts") < first + F.expr("INTERVAL 3 DAYS"))),
    ):
        arrival.write.mode("append").parquet(landing)
        stream = loads.file_stream(spark, landing, rows.schema)
        loads.daily_stream(stream, "ts", root, measures=_measures(), delay="1 day")
    return root


@book.entry(
    "daily_tumbling_stream",
    f"""SELECT * FROM ({_DAILY.format(h=0)}) WHERE CAST(date AS DATE) + INTERVAL 1 DAY
        <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
)
def daily_stream(spark: SparkSession, sf: str) -> DataFrame:
    return loads.closed_days(spark, _streamed(spark, sf))


@book.entry(
    "daily_late_rows",
    "SELECT event_id, event_type FROM events WHERE event_id % 13 = 0 AND ts < (SELECT min(ts) FROM events) + INTERVAL 3 DAY",
)
def daily_late(spark: SparkSession, sf: str) -> DataFrame:
    return loads.late_rows(spark, _streamed(spark, sf)).select("event_id", "event_type")
