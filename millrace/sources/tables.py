"""Tables: strict raw loads, model builds, previews, file lists, exports, stored violations.

Each table version is written to a folder of its own and then made current by moving the table's
location, so a reader sees the old version or the new one and a lost executor leaves no half table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from typing import Any
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.ingest import (
    call_plan, dedupe_batch, schema_diff, stringify, within_budget,
)
from millrace.plans.durable import cut, table_path
from millrace.sources import files, listing

_NAME = re.compile(r"^[a-z][a-z0-9_]{1,62}$")
PREVIEW_DEFAULT, PREVIEW_MAX = 20, 200
_PLACE = "_place"
_BOM = "﻿"


def check_table_name(name: str) -> None:
    if not _NAME.match(name or ""):
        raise ValueError("a table name is 2-63 lower-case letters, digits or underscores, a letter first")


def table_count(spark: SparkSession, table: str) -> int | None:
    """Exact count; None, not 0, when the table does not exist."""
    return spark.table(table).count() if spark.catalog.tableExists(table) else None


def _point_at(spark: SparkSession, table: str, path: str) -> None:
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
    spark.catalog.refreshTable(table)


def _replace(spark: SparkSession, table: str, df: DataFrame) -> None:
    """Write a new version and make it current; create the table where it does not exist."""
    path = table_path(spark, table)
    exists = spark.catalog.tableExists(table)
    if exists and set(spark.table(table).columns) == set(df.columns):
        df = df.select(*spark.table(table).columns)  # in the stored order the location can simply move
    df.write.parquet(path)
    if exists:
        same = [(f.name, f.dataType) for f in spark.table(table).schema.fields] == [
            (f.name, f.dataType) for f in df.schema.fields
        ]
        if same:
            _point_at(spark, table, path)
            return
        spark.sql(f"DROP TABLE {table}")  # external: the old version's files stay
    spark.catalog.createTable(table, path=path, source="parquet", schema=df.schema)


def _append(spark: SparkSession, table: str, df: DataFrame) -> int:
    """Append by column name; a table has one writer, so its growth is what was added.

    Both counts read file footers only.
    """
    before = spark.table(table).count()
    df.select(*spark.table(table).columns).write.insertInto(table)
    spark.catalog.refreshTable(table)
    return spark.table(table).count() - before


def load_raw(
    spark: SparkSession, table: str, batch: DataFrame, *, mode: str = "append",
    dedupe: Sequence[str] | None = None, pos: str | None = None, ingested_at: str,
) -> dict[str, Any]:
    """Load a batch as strings. The first load creates the table; later ones need the same columns.

    ``overwrite`` replaces the table in one step, ``append`` matches columns by name. ``pos`` is the
    batch's position column, needed to dedupe; it is not stored.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    if dedupe and not pos:
        raise ValueError("dedupe needs the batch's position column")
    kept = dedupe_batch(batch, dedupe, pos) if dedupe else batch
    rows = stringify(kept.drop(pos) if pos else kept, ingested_at)
    exists = spark.catalog.tableExists(table)
    if exists:
        stored = spark.table(table).columns
        added, gone = schema_diff(rows.columns, stored)
        if added or gone:
            raise ValueError(f"{table}: columns differ; new: {added or 'none'}, gone: {gone or 'none'}")
    if exists and mode == "append":
        loaded = _append(spark, table, rows)
    else:
        _replace(spark, table, rows)
        loaded = spark.table(table).count()
    out: dict[str, Any] = {"table": table, "rows": loaded, "mode": mode, "created": not exists}
    if dedupe:
        out["deduped"] = batch.count() - loaded
    return out


def run_ingest(
    spark: SparkSession,
    job: Mapping[str, Any],
    fetch: Callable[[list[dict[str, str]]], DataFrame],
    mark: Callable[[str], None],
    *,
    today: str | None = None,
    ingested_at: str,
) -> dict[str, Any]:
    """Step by step: read all calls of a step, load them, then move the watermark.

    The watermark moves after every finished step, empty ones too, so a run that stops continues
    with the next step. The first write uses the job's mode, later ones append. A step is never
    split; with a call budget the rest is left for the next run (``remaining``). The plan is at most
    a few thousand calls, so it is read by the driver; the data of a step never is.
    """
    from millrace.operators.ingest import plan_errors

    fields = ("id", "mode", "shape", "unit", "format", "start_param", "end_param", "param",
              "initial_start", "watermark", "fan_param", "fan_values")
    scope = dict(job.get("scope") or {})
    row = {f: scope.get(f) for f in fields} | {"id": job["id"], "watermark": job.get("watermark")}
    schema = ", ".join(f"{f} string" for f in fields) + ", overlap int"
    jobs = spark.createDataFrame([(*[row[f] for f in fields], int(scope.get("overlap") or 0))], schema)
    problem = plan_errors(jobs, today=today).head()
    if problem:
        raise ValueError(problem["error"])
    plan = call_plan(jobs, today=today)
    budget = int(scope.get("max_calls_per_run") or 0)
    allowed = {r["step"] for r in within_budget(plan, budget).filter("runs").collect()} if budget else None
    steps: dict[int, list[Any]] = {}
    for r in plan.orderBy("step", "call").collect():
        steps.setdefault(r["step"], []).append(r)

    out: dict[str, Any] = {"table": job["target"], "rows": 0, "created": False, "calls": 0,
                           "steps": len(steps), "mode": job["mode"], "remaining": False, "covered": None}
    mode = job["mode"]
    for step, calls in steps.items():
        if allowed is not None and step not in allowed:
            out["remaining"] = True
            break
        batch = cut(fetch([dict(c["params"]) for c in calls]), "fetched")
        out["calls"] += len(calls)
        if not batch.isEmpty():
            if job.get("columns"):
                batch = batch.select(*job["columns"], *([job["pos"]] if job.get("pos") else []))
            done = load_raw(spark, job["target"], batch, mode=mode, dedupe=job.get("dedupe"),
                            pos=job.get("pos"), ingested_at=ingested_at)
            out["created"] = out["created"] or done["created"]
            out["rows"] += done["rows"] + done.get("deduped", 0)
            mode = "append"
        if calls[0]["covered"] is not None:
            out["covered"] = calls[0]["covered"].isoformat()
            mark(out["covered"])
    return out


def file_records(spark: SparkSession, path: str, config: Mapping[str, Any]) -> tuple[DataFrame, str]:
    """A job's files as string columns, and the column that holds each row's place in them.

    ``config`` gives ``format`` (``csv``, the default, with a ``delimiter``, or ``json`` or ``jsonl``: one object a line).
    """
    kind = config.get("format") or "csv"
    if kind == "csv":
        rows = files.read_csv_raw(spark, path, delimiter=config.get("delimiter") or ",", multiline=config.get("multiline", True), place=_PLACE)
    elif kind in ("json", "jsonl"):
        rows = files.read_jsonl_raw(spark, path, place=_PLACE)
    else:
        raise ValueError(f"files of format {kind!r} cannot be loaded")
    return rows, _PLACE


def run_file_job(spark: SparkSession, job: Mapping[str, Any], path: str, *, ingested_at: str) -> dict[str, Any]:
    """Load a job's files in its mode, with its columns (none given: those found) and its in-batch dedupe.

    Files without rows load nothing and make no table: the answer has ``rows`` 0, so that a caller can pass over what
    follows. The files are read by the tasks.
    """
    rows, place = file_records(spark, path, job.get("config") or {})
    if rows.isEmpty():
        return {"table": job["target"], "rows": 0, "mode": job["mode"], "created": False}
    if wanted := job.get("columns"):
        given = set(rows.columns)
        rows = rows.select(*[F.col(f"`{c}`") if c in given else F.lit(None).cast("string").alias(c) for c in wanted], place)
    return load_raw(spark, job["target"], cut(rows, "file-rows"), mode=job["mode"], dedupe=job.get("dedupe"),
                    pos=place, ingested_at=ingested_at)


def load_seed(spark: SparkSession, table: str, path: str, *, delimiter: str = ",") -> int:
    """Replace a table by its CSV; returns the rows now in it."""
    _replace(spark, table, files.read_csv_raw(spark, path, delimiter=delimiter))
    return spark.table(table).count()


_BUCKET = "_bucket"


def merge_keyed(
    spark: SparkSession, name: str, df: DataFrame, keys: Sequence[str], *, newer_than: str | None = None, buckets: int = 64
) -> DataFrame:
    """Merge rows into a table by key: a new key is added, a known one replaced; of several rows of a key the newest stays.

    The table lies in ``buckets`` folders by a hash of the key (a number chosen at its first build and kept). A batch
    rewrites the folders its keys fall into and no others, so its cost follows the batch and not the table. Rows older
    than the stored maximum of ``newer_than`` are left out, those equal to it are not: they may be late. Without
    ``newer_than`` every row of the batch counts as newer than the table's.
    """
    order = [newer_than] if newer_than else []
    fresh = df
    if known := spark.catalog.tableExists(name):
        stored = spark.table(name)
        buckets = int(spark.sql(f"SHOW TBLPROPERTIES {name}('buckets')").head()["value"])
        if newer_than and (high := stored.agg(F.max(newer_than)).head()[0]) is not None:
            fresh = df.filter(F.col(newer_than) >= F.lit(high))
    placed = fresh.withColumn(_BUCKET, F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int"))
    placed = cut(placed.withColumn("_new", F.lit(True)), "batch")
    if known:
        touched = placed.select(F.col(_BUCKET).alias("_b")).distinct()
        there = stored.join(F.broadcast(touched), F.col(_BUCKET) == F.col("_b"), "left_semi")  # ``buckets`` rows at most
        placed = placed.unionByName(there.withColumn("_new", F.lit(False)))
    plain = [c for c in placed.columns if c not in (*keys, _BUCKET, "_new")]
    newest = placed.groupBy(*keys, _BUCKET).agg(F.max_by(F.struct(*plain), F.struct(*order, "_new", *plain)).alias("_row"))
    merged = cut(newest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns], _BUCKET), "merged")
    if not known:
        path = table_path(spark, name)
        merged.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(path)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in merged.schema.fields)
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (`{_BUCKET}`) LOCATION '{path}' TBLPROPERTIES ('buckets' = '{buckets}')"
        )
        spark.sql(f"MSCK REPAIR TABLE {name}")
    else:
        # Only the folders in ``merged`` are replaced, each when the job commits.
        replaced = merged.repartition(_BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        replaced.partitionBy(_BUCKET).parquet(listing.location(spark, name))
        spark.sql(f"MSCK REPAIR TABLE {name}")
        spark.sql(f"REFRESH TABLE {name}")
    return spark.table(name).drop(_BUCKET)


def materialize(
    spark: SparkSession, name: str, df: DataFrame, how: str = "table", *, newer_than: str | None = None,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Build a model as ``table``, ``view``, ``incremental`` (rows beyond the stored maximum of the ``newer_than``
    column are appended; with ``keys`` they are merged, see ``merge_keyed``) or ``ephemeral`` (the plan itself is handed on)."""
    if how == "incremental" and keys:
        return merge_keyed(spark, name, df, keys, newer_than=newer_than)
    if how == "ephemeral":
        return df
    if how == "view":
        df.createOrReplaceTempView(name)
        return spark.table(name)
    if how == "table" or not spark.catalog.tableExists(name):
        if how not in ("table", "incremental"):
            raise ValueError(f"unknown materialization {how!r}")
        _replace(spark, name, df)
        return spark.table(name)
    if how != "incremental":
        raise ValueError(f"unknown materialization {how!r}")
    fresh = df
    if newer_than:
        high = spark.table(name).agg(F.max(newer_than)).head()[0]
        if high is not None:
            fresh = df.filter(F.col(newer_than) > F.lit(high))
    _append(spark, name, fresh)
    return spark.table(name)


def output_safe(df: DataFrame) -> DataFrame:
    """Decimals as doubles, times as ISO text, bytes as hex: values any client can show."""

    def safe(f: T.StructField):
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            return col.cast("double")
        if isinstance(f.dataType, T.BinaryType):
            return F.lower(F.hex(col))
        if isinstance(f.dataType, T.DateType):
            return F.date_format(col, "yyyy-MM-dd")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            whole = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
            micros = F.date_format(col, "SSSSSS")
            return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))
        return col

    return df.select(*[safe(f).alias(f.name) for f in df.schema.fields])


def preview(df: DataFrame, limit: int = PREVIEW_DEFAULT) -> DataFrame:
    """The first rows in output-safe types; 1 to 200 of them."""
    if not 1 <= limit <= PREVIEW_MAX:
        raise ValueError(f"limit must be between 1 and {PREVIEW_MAX}")
    return output_safe(df.limit(limit))


def export_csv(df: DataFrame, path: str, *, limit: int | None = None) -> None:
    """CSV files with a header and a BOM each, so spreadsheets read them as UTF-8; all rows unless a limit is asked."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    first, *rest = df.columns
    rows = (df if limit is None else df.limit(limit)).withColumnRenamed(first, _BOM + first)
    rows.write.option("header", True).option("escape", '"').csv(path)


def _rule_folder(root: str, rule_id: str) -> str:
    return f"{root}/rule={quote(rule_id, safe='')}"


def store_violations(failing: DataFrame, rule_id: str, root: str) -> None:
    """Keep a rule's failing rows as text, one folder per rule; storing again replaces them."""
    packed = failing.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row"))
    packed.write.mode("overwrite").parquet(_rule_folder(root, rule_id))


def read_violations(
    spark: SparkSession, root: str, rule_id: str, *, status: str, limit: int | None = 20
) -> tuple[str, DataFrame | None]:
    """(``passed`` | ``not_stored`` | ``rows``, rows): no rows stored is not the same as no violation.

    ``limit`` is 1 to 200 for a screen, or None for all of them.
    """
    if limit is not None and not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    if status == "ok":
        return "passed", None
    try:
        stored = spark.read.schema("row string").parquet(_rule_folder(root, rule_id))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return "not_stored", None
    if stored.isEmpty():
        return "not_stored", None
    return "rows", stored if limit is None else stored.limit(limit)


def append_history(spark: SparkSession, table: str, incoming: DataFrame, keys: Sequence[str],
                   order: Sequence[str] = ()) -> int:
    """Idempotent append of keyed rows; returns how many were new."""
    from millrace.operators.ingest import append_if_absent

    if not spark.catalog.tableExists(table):
        spark.catalog.createTable(table, path=table_path(spark, table), source="parquet", schema=incoming.schema)
    return _append(spark, table, append_if_absent(spark.table(table), incoming, keys, order))
