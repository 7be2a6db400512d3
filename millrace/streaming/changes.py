"""Node state changes: a row only where a node's state differs from its previous observation."""

from __future__ import annotations

import sys
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.plans.durable import fresh_path
from millrace.plans.ordered import previous

# Workers get the function by value, so a cluster needs no copy of this package for it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def status_changes(observed: DataFrame, *, key: str = "id", order: str = "seen_at", tie: str = "tick") -> DataFrame:
    """Batch form over ``(id, seen_at, tick, state)``: first observations and every later change."""
    compared = previous(observed, [key], [order, tie], {"_before": "state"})
    changed = F.col("is_first") | ~F.col("state").eqNullSafe(F.col("_before"))
    return compared.filter(changed).select(*observed.columns)


def end_marker(observed: DataFrame, order: DataFrame, *, run: str = "run") -> DataFrame:
    """Per finished run: its status and the first failed node in run order.

    ``observed(run, id, seen_at, tick, state)``; a run is over when no node is waiting or running.
    """
    last = observed.groupBy(run, "id").agg(F.max(F.struct("seen_at", "tick", "state")).alias("_l"))
    state = F.col("_l.state")
    placed = last.join(order.select("id", "seq"), "id")
    failed = F.when(state == "err", F.struct("seq", "id"))
    ended = placed.groupBy(run).agg(
        F.count_if(state.isin("wait", "run")).alias("_open"), F.min(failed).alias("_f")
    )
    return ended.filter("_open = 0").select(
        run, F.when(F.col("_f").isNull(), "ok").otherwise("err").alias("status"), F.col("_f.id").alias("failed_node")
    )


_ROW = "id string, seen_at timestamp, tick long, state string"
_KEPT = "known boolean, last string, at array<long>, tick array<long>, state array<string>"


def _follow(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
    """Changes of one node among the observations that no earlier one can still come before."""
    known, last, *held = kept.get if kept.exists else (False, None, [], [], [])
    waiting = list(zip(*held))
    for frame in frames:
        waiting += zip(frame["at"].tolist(), frame["tick"].tolist(), (None if pd.isna(s) else s for s in frame["state"]))
    waiting.sort(key=lambda row: row[:2])
    mark = kept.getCurrentWatermarkMs()
    settled = bisect_left(waiting, mark * 1000, key=lambda row: row[0])
    out = []
    for at, tick, state in waiting[:settled]:
        if not known or state != last:
            out.append((key[0], at, tick, state))
        known, last = True, state
    waiting = waiting[settled:]
    kept.update((known, last, *(list(column) for column in (zip(*waiting) if waiting else ([], [], [])))))
    if waiting:
        kept.setTimeoutTimestamp(max(mark, waiting[0][0] // 1000) + 1)
    if out:
        yield pd.DataFrame(out, columns=["id", "at", "tick", "state"])


def status_change_stream(observed: DataFrame, root: str, *, delay: str = "1 day", checkpoint: str | None = None) -> None:
    """Streaming form over ``(id, seen_at, tick, state)``: everything available, changes appended under ``root``.

    State is kept per node: its last settled state and the observations still within ``delay`` of the newest one, in
    which earlier ones may yet arrive. The watermark settles them in (seen_at, tick) order, and an event-time timer
    does so for nodes that are not heard of again, so arrival order does not matter and a step touches only the nodes
    it hears of or settles. Observations later than the delay are dropped, those without an id or a time are no
    observations; a row with a null id still moves the watermark, which is how ``close`` ends a stream.
    """
    timed = observed.select("id", F.col("seen_at").cast("timestamp").alias("seen_at"), "tick", "state").withWatermark("seen_at", delay)
    # One condition on both columns: a filter on the id alone would be moved below the watermark, which null ids move.
    rows = timed.filter(F.when(F.col("seen_at").isNotNull(), F.col("id").isNotNull())).select(
        "id", "seen_at", F.unix_micros("seen_at").alias("at"), F.coalesce(F.col("tick").cast("long"), F.lit(-1)).alias("tick"), "state"
    )
    found = rows.groupBy("id").applyInPandasWithState(
        _follow, "id string, at long, tick long, state string", _KEPT, "append", GroupStateTimeout.EventTimeTimeout
    )
    query = (
        found.select("id", F.timestamp_micros("at").alias("seen_at"), "tick", "state").writeStream.format("parquet")
        .outputMode("append").option("path", f"{root}/changes")
        .option("checkpointLocation", checkpoint or fresh_path(observed.sparkSession, "stream"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def close(spark: SparkSession, landing: str, after: str) -> None:
    """Let every waiting observation settle: one row without an id, so far ahead that the delay is over."""
    spark.createDataFrame([(None, after)], "id string, at string").select(
        "id", F.col("at").cast("timestamp").alias("seen_at"), F.lit(0).cast("long").alias("tick"), F.lit(None).cast("string").alias("state")
    ).write.mode("append").parquet(landing)


def emitted_changes(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_ROW).parquet(f"{root}/changes")
