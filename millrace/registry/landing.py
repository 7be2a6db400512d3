"""Ingest shaping, files, landed responses and loads over data derived from the supplied tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import times
from millrace.operators import ingest as ing
from millrace.plans.durable import fresh_path
from millrace.registry.book import book
from millrace.registry.facts import dealt, table
from millrace.sources import artifacts, files, listing, responses, tables

TODAY = "2024-01-31"

# ---------------------------------------------------------------- windows and plans

_JOBS_SQL = """jobs AS (
  SELECT 'j' || CAST(c_custkey AS VARCHAR) AS id,
         CASE WHEN c_custkey % 4 = 0 THEN 'full' ELSE 'incremental' END AS mode,
         CASE WHEN c_nationkey % 2 = 0 THEN 'month' ELSE 'day' END AS unit,
         CASE WHEN c_custkey % 3 = 0 THEN 'range' ELSE 'point' END AS shape,
         CASE c_nationkey % 4 WHEN 0 THEN 'YYYYMM' WHEN 1 THEN 'YYYYMMDD' WHEN 2 THEN 'YYYY-MM' ELSE 'YYYY-MM-DD' END AS format,
         CASE WHEN c_custkey % 17 = 5 THEN ' ' ELSE 'from' END AS start_param, 'to' AS end_param,
         CASE WHEN c_custkey % 19 = 3 THEN '' ELSE 'ym' END AS param,
         '2023-12-' || CAST(10 + c_nationkey % 20 AS VARCHAR) AS initial_start,
         CASE WHEN c_custkey % 23 = 0 THEN '2024-03-05' WHEN c_custkey % 5 > 0
              THEN CAST(CAST(DATE '2023-09-01' + CAST(c_nationkey * 6 AS INTEGER) AS DATE) AS VARCHAR) END AS watermark,
         CAST(c_custkey % 3 AS INTEGER) AS overlap,
         CASE WHEN c_custkey % 7 < 3 THEN 'region' END AS fan_param,
         CASE WHEN c_custkey % 7 IN (0, 1, 4) THEN 'a, b' || chr(10) || 'b  c' END AS fan_values
  FROM customer),
win AS (SELECT *, least(CASE WHEN watermark IS NULL THEN CAST(initial_start AS DATE)
          WHEN unit = 'month' THEN CAST(date_trunc('month', CAST(watermark AS DATE)) + INTERVAL 1 MONTH * (CASE WHEN overlap > 0 THEN -overlap ELSE 1 END) AS DATE)
          ELSE CAST(watermark AS DATE) + (CASE WHEN overlap > 0 THEN -overlap ELSE 1 END) END, DATE '2024-01-31') AS range_start,
          DATE '2024-01-31' AS range_end FROM jobs),
pl AS (SELECT *, CASE WHEN unit = 'month' THEN CAST(date_trunc('month', range_start) AS DATE) ELSE range_start END AS first_point,
              CASE WHEN mode = 'incremental' AND shape = 'point' THEN
                   CASE WHEN unit = 'month' THEN date_diff('month', range_start, range_end) ELSE date_diff('day', range_start, range_end) END + 1
                   ELSE 1 END AS steps,
              CASE WHEN fan_values IS NULL THEN 0 ELSE 3 END AS n_values FROM win),
chk AS (SELECT *, CASE WHEN fan_param IS NOT NULL AND n_values = 0 THEN 'fan-out parameter without values'
               WHEN fan_param IS NULL AND n_values > 0 THEN 'fan-out values without a parameter'
               WHEN mode = 'incremental' AND shape = 'range' AND trim(start_param) = '' THEN 'start and end parameters are needed'
               WHEN mode = 'incremental' AND shape = 'point' AND param = '' THEN 'the point parameter is needed'
               WHEN steps > 120 THEN 'more than 120 steps'
               WHEN steps * greatest(n_values, 1) > 5000 THEN 'more than 5000 calls' END AS error FROM pl),
stepped AS (SELECT *, unnest(range(CAST(steps AS BIGINT))) AS s FROM chk WHERE error IS NULL),
pts AS (SELECT *, CASE WHEN steps = 1 AND (mode = 'full' OR shape = 'range') THEN range_end
                  WHEN unit = 'month' THEN CAST(first_point + INTERVAL 1 MONTH * CAST(s AS INTEGER) AS DATE)
                  ELSE first_point + CAST(s AS INTEGER) END AS pt FROM stepped),
fanned AS (SELECT *, unnest(CASE WHEN n_values > 0 THEN [0, 1, 2] ELSE [0] END) AS c FROM pts),
plan AS (SELECT id, s + 1 AS step, CASE WHEN mode = 'incremental' THEN CAST(pt AS VARCHAR) END AS covered, c + 1 AS call,
   CASE WHEN mode = 'incremental' AND shape = 'range' THEN CASE format WHEN 'YYYYMM' THEN strftime(range_start, '%Y%m') WHEN 'YYYYMMDD' THEN strftime(range_start, '%Y%m%d') WHEN 'YYYY-MM' THEN strftime(range_start, '%Y-%m') ELSE strftime(range_start, '%Y-%m-%d') END END AS p_from,
   CASE WHEN mode = 'incremental' AND shape = 'range' THEN CASE format WHEN 'YYYYMM' THEN strftime(range_end, '%Y%m') WHEN 'YYYYMMDD' THEN strftime(range_end, '%Y%m%d') WHEN 'YYYY-MM' THEN strftime(range_end, '%Y-%m') ELSE strftime(range_end, '%Y-%m-%d') END END AS p_to,
   CASE WHEN mode = 'incremental' AND shape = 'point' THEN CASE format WHEN 'YYYYMM' THEN strftime(pt, '%Y%m') WHEN 'YYYYMMDD' THEN strftime(pt, '%Y%m%d') WHEN 'YYYY-MM' THEN strftime(pt, '%Y-%m') ELSE strftime(pt, '%Y-%m-%d') END END AS p_point,
   CASE WHEN n_values > 0 THEN substr('abc', c + 1, 1) END AS p_fan
   FROM fanned)"""


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    mark = F.when(k % 23 == 0, "2024-03-05").when(
        k % 5 > 0, F.date_add(F.lit("2023-09-01").cast("date"), n * 6).cast("string")
    )
    fmt = F.when(n % 4 == 0, "YYYYMM").when(n % 4 == 1, "YYYYMMDD").when(n % 4 == 2, "YYYY-MM").otherwise("YYYY-MM-DD")
    return dealt(table(spark, sf, "customer").select("c_custkey", "c_nationkey")).select(
        F.concat(F.lit("j"), k.cast("string")).alias("id"),
        F.when(k % 4 == 0, "full").otherwise("incremental").alias("mode"),
        F.when(n % 2 == 0, "month").otherwise("day").alias("unit"),
        F.when(k % 3 == 0, "range").otherwise("point").alias("shape"), fmt.alias("format"),
        F.when(k % 17 == 5, " ").otherwise("from").alias("start_param"), F.lit("to").alias("end_param"),
        F.when(k % 19 == 3, "").otherwise("ym").alias("param"),
        F.concat(F.lit("2023-12-"), (n % 20 + 10).cast("string")).alias("initial_start"),
        mark.alias("watermark"), (k % 3).cast("int").alias("overlap"),
        F.when(k % 7 < 3, "region").alias("fan_param"),
        F.when((k % 7).isin(0, 1, 4), "a, b\nb  c").alias("fan_values"),
    )


@book.entry(
    "incremental_window",
    f"WITH {_JOBS_SQL} SELECT id, CAST(range_start AS VARCHAR) AS range_start, CAST(range_end AS VARCHAR) AS range_end FROM win",
)
def window(spark: SparkSession, sf: str) -> DataFrame:
    out = ing.incremental_window(_jobs(spark, sf), today=TODAY)
    return out.select("id", F.col("range_start").cast("string").alias("range_start"), F.col("range_end").cast("string").alias("range_end"))


def _plan_columns(plan: DataFrame) -> DataFrame:
    get = lambda k: F.try_element_at("params", F.lit(k))
    return plan.select(
        "id", F.col("step").cast("long").alias("step"), F.col("covered").cast("string").alias("covered"),
        "call", get("from").alias("p_from"), get("to").alias("p_to"), get("ym").alias("p_point"), get("region").alias("p_fan"),
    )


@book.entry("call_plan", f"WITH {_JOBS_SQL} SELECT * FROM plan")
def call_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _plan_columns(ing.call_plan(_jobs(spark, sf), today=TODAY))


@book.entry("call_plan_errors", f"WITH {_JOBS_SQL} SELECT id, error FROM chk WHERE error IS NOT NULL")
def call_plan_errors(spark: SparkSession, sf: str) -> DataFrame:
    return ing.plan_errors(_jobs(spark, sf), today=TODAY)


@book.entry("probe_params", f"WITH {_JOBS_SQL} SELECT id, p_from, p_to, p_point, p_fan FROM plan WHERE step = 1 AND call = 1")
def probe(spark: SparkSession, sf: str) -> DataFrame:
    plan = ing.call_plan(_jobs(spark, sf), today=TODAY)
    first = ing.probe_params(plan).join(plan.filter("step = 1 AND call = 1").drop("params"), "id")
    return _plan_columns(first).select("id", "p_from", "p_to", "p_point", "p_fan")


@book.entry(
    "call_budget",
    f"""WITH {_JOBS_SQL}, g AS (SELECT id, step, count(*) AS calls FROM plan GROUP BY 1, 2),
        r AS (SELECT *, CAST(sum(calls) OVER (PARTITION BY id ORDER BY step) AS BIGINT) AS calls_so_far FROM g)
        SELECT id, step, calls, calls_so_far, step = 1 OR calls_so_far <= 25 AS runs FROM r""",
)
def call_budget(spark: SparkSession, sf: str) -> DataFrame:
    out = ing.within_budget(ing.call_plan(_jobs(spark, sf), today=TODAY), 25)
    return out.select("id", F.col("step").cast("long").alias("step"), "calls", "calls_so_far", "runs")


@book.entry(
    "fill_date_placeholders",
    """SELECT o_orderkey, 'from=' || strftime(o_orderdate - INTERVAL 1 DAY, '%Y%m%d') || '&ym=' ||
         strftime(date_trunc('month', o_orderdate) - INTERVAL 2 MONTH, '%Y%m') || '&d=' || strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') ||
         '&t=' || strftime(o_orderdate, '%Y%m%d') || '&p=' || o_orderpriority AS url FROM orders""",
)
def placeholders(spark: SparkSession, sf: str) -> DataFrame:
    template = F.concat(
        F.lit("from={{ymd-1}}&ym={{ ym -2 }}&d={{date+3}}&t={{ ymd }}&p="), F.col("o_orderpriority")
    )
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select("o_orderkey", times.fill_placeholders(template, day).alias("url"))


# ---------------------------------------------------------------- rows


@book.entry(
    "stringify",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(value > 50 AS VARCHAR) AS is_big,
              '{"kind":"' || event_type || '","user":' || CAST(user_id AS VARCHAR) || '}' AS detail,
              '["' || event_type || '","x"]' AS tags, CAST(NULL AS VARCHAR) AS nothing,
              '2024-01-31T00:00:00+00:00' AS _ingested_at FROM events""",
)
def stringify(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(
        "event_id", (F.col("value") > 50).alias("is_big"),
        F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("user")).alias("detail"),
        F.array("event_type", F.lit("x")).alias("tags"), F.lit(None).cast("int").alias("nothing"),
    )
    return ing.stringify(rows, "2024-01-31T00:00:00+00:00")


@book.entry(
    "dedupe_batch",
    """WITH o AS (SELECT CASE WHEN o_custkey % 50 = 0 THEN NULL WHEN o_custkey % 50 = 1 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS k,
                         o_orderstatus AS v, o_orderkey AS pos FROM orders),
       r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(k, '') ORDER BY pos DESC) AS rn,
                    min(pos) OVER (PARTITION BY coalesce(k, '')) AS first_pos FROM o)
       SELECT k, v, first_pos AS pos FROM r WHERE rn = 1""",
)
def dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return ing.dedupe_batch(_dup_rows(spark, sf), ["k"], "pos")


def _dup_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("o_custkey") % 50
    key = F.when(c == 0, None).when(c == 1, "").otherwise(F.col("o_custkey").cast("string"))
    return table(spark, sf, "orders").select(key.alias("k"), F.col("o_orderstatus").alias("v"), F.col("o_orderkey").alias("pos"))


@book.entry(
    "dedupe_counts",
    """SELECT count(*) AS rows, count(*) - count(DISTINCT CASE WHEN o_custkey % 50 < 2 THEN '' ELSE CAST(o_custkey AS VARCHAR) END) AS dropped FROM orders""",
)
def dedupe_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ing.dedupe_counts(_dup_rows(spark, sf), ["k"])


@book.entry(
    "infer_raw_columns",
    """SELECT name, 'string' AS type, min(pos) AS first_row FROM (
         SELECT unnest(['event_id', 'user_id', CASE WHEN event_id > 5 THEN event_type END, CASE WHEN value > 300 THEN 'big' END]) AS name,
                event_id AS pos FROM events) WHERE name IS NOT NULL GROUP BY 1""",
)
def infer_columns(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    keys = F.array_compact(F.array(
        F.lit("event_id"), F.lit("user_id"), F.when(F.col("event_id") > 5, F.col("event_type")),
        F.when(F.col("value") > 300, "big"),
    ))
    record = F.map_from_arrays(keys, F.transform(keys, lambda k: k))
    out = files.infer_raw_columns(e.select(record.alias("record"), F.col("event_id").alias("pos")), "record", "pos")
    return out.select("name", "type", F.col("first_seen.pos").alias("first_row"))


@book.entry(
    "schema_diff",
    """WITH a AS (SELECT DISTINCT 't' || CAST(l_suppkey AS VARCHAR) AS "table", 'c' || CAST(l_linenumber AS VARCHAR) AS "column" FROM lineitem WHERE l_returnflag = 'A' AND l_quantity < 2),
       b AS (SELECT DISTINCT 't' || CAST(l_suppkey AS VARCHAR) AS "table", 'c' || CAST(l_linenumber AS VARCHAR) AS "column" FROM lineitem WHERE l_quantity > 49)
       SELECT *, 'added' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
       UNION ALL SELECT *, 'gone' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def schema_diff(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")

    def cols(df: DataFrame) -> DataFrame:
        return df.select(
            F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("table"),
            F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("column"),
        ).distinct()

    return ing.column_diff(cols(li.filter("l_returnflag = 'A' AND l_quantity < 2")), cols(li.filter("l_quantity > 49")))


@book.entry(
    "union_by_name",
    "SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier",
)
def union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    stored = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    incoming = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"))
    return ing.union_by_name(stored, incoming)


@book.entry(
    "late_overlap",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_shipdate AS DATE) AS day,
          strftime(l_shipdate, '%Y-%m-%d') || 'T' || lpad(CAST(l_suppkey % 24 AS VARCHAR), 2, '0') AS at FROM lineitem
          WHERE l_shipdate >= TIMESTAMP '1997-06-01')
       SELECT l_orderkey, l_linenumber, l_partkey, at AS _ingested_at FROM (
         SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY at DESC, l_partkey DESC) AS rn FROM r) WHERE rn = 1""".replace(" AS at", " AS at_").replace("ORDER BY at", "ORDER BY at_").replace(", at AS", ", at_ AS"),
)
def late_overlap(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("date").alias("day"),
        F.concat(
            F.date_format("l_shipdate", "yyyy-MM-dd'T'"), F.lpad((F.col("l_suppkey") % 24).cast("string"), 2, "0")
        ).alias(ing.INGESTED_AT),
    )
    kept = ing.late_overlap(raw.filter(F.col("day") >= "1997-06-01").drop("day"), ["l_orderkey", "l_linenumber"])
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", ing.INGESTED_AT)


# ---------------------------------------------------------------- keyed tables and versions


@book.entry(
    "append_if_absent",
    """WITH inc AS (SELECT o_custkey AS k, o_orderstatus AS run, o_totalprice AS price, o_orderkey AS n FROM orders),
       st AS (SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN 'F' ELSE 'P' END AS run FROM customer)
       SELECT k, run, price, n FROM (SELECT *, row_number() OVER (PARTITION BY k, run ORDER BY n) AS rn FROM inc)
       WHERE rn = 1 AND (k, run) NOT IN (SELECT (k, run) FROM st)""",
)
def append_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    incoming = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("run"),
        F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("n"),
    )
    stored = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 0, "F").otherwise("P").alias("run")
    )
    return ing.append_if_absent(stored, incoming, ["k", "run"], ["n"])


@book.entry(
    "patch_upsert",
    """WITH st AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS seg, 'w' || CAST(c_custkey AS VARCHAR) AS watermark,
                    '2023-01-01' AS created_at, '2023-01-01' AS updated_at FROM customer WHERE c_acctbal > 2000),
       pt AS (SELECT c_custkey AS id, CASE WHEN c_nationkey < 10 THEN 'new ' || c_name END AS name,
                    CASE WHEN c_nationkey % 2 = 0 THEN 'SEG' END AS seg, 'never' AS watermark FROM customer WHERE c_acctbal < 5000)
       SELECT coalesce(st.id, pt.id) AS id, coalesce(pt.name, st.name, CASE WHEN st.id IS NULL THEN 'unnamed' END) AS name,
              CASE WHEN pt.id IS NOT NULL THEN pt.seg ELSE st.seg END AS seg, st.watermark,
              CASE WHEN st.id IS NULL THEN '2024-01-31' ELSE st.created_at END AS created_at,
              CASE WHEN pt.id IS NOT NULL THEN '2024-01-31' ELSE st.updated_at END AS updated_at
       FROM st FULL JOIN pt ON st.id = pt.id""",
)
def patch_upsert(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    stored = c.filter("c_acctbal > 2000").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"),
        F.concat(F.lit("w"), F.col("c_custkey").cast("string")).alias("watermark"),
        F.lit("2023-01-01").alias("created_at"), F.lit("2023-01-01").alias("updated_at"),
    )
    patch = c.filter("c_acctbal < 5000").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_nationkey") < 10, F.concat(F.lit("new "), "c_name")).alias("name"),
        F.when(F.col("c_nationkey") % 2 == 0, "SEG").alias("seg"), F.lit("never").alias("watermark"),
    )
    return ing.patch_upsert(
        stored, patch, "id", nullable=["seg"], untouched=["watermark"], now="2024-01-31",
        defaults={"name": "unnamed"},
    )


@book.entry(
    "source_registry",
    """WITH j AS (SELECT 't' || CAST(o_custkey AS VARCHAR) AS target, CAST(o_orderdate AS VARCHAR) AS created_at, o_orderkey AS id,
                   'job ' || CAST(o_orderkey AS VARCHAR) AS name, o_orderstatus AS c1, o_orderpriority AS c2 FROM orders)
       SELECT target AS name, name || ' loads this source' AS description, c1 || ',' || c2 || ',_ingested_at' AS columns FROM (
         SELECT *, row_number() OVER (PARTITION BY target ORDER BY created_at, id) AS rn FROM j) WHERE rn = 1""",
)
def source_registry(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "orders").select(
        F.concat(F.lit("t"), F.col("o_custkey").cast("string")).alias("target"),
        F.col("o_orderdate").cast("string").alias("created_at"), F.col("o_orderkey").alias("id"),
        F.concat(F.lit("job "), F.col("o_orderkey").cast("string")).alias("name"),
        F.array("o_orderstatus", "o_orderpriority").alias("columns"),
    )
    return ing.source_registry(jobs).withColumn("columns", F.concat_ws(",", "columns"))


_VERSIONS_SQL = """saves AS (SELECT o_custkey AS job, o_orderkey AS at_, o_orderstatus AS name, substr(o_orderpriority, 1, 1) AS target,
    CASE WHEN o_totalprice > 250000 THEN 'append' ELSE 'overwrite' END AS mode,
    list_filter(['k', CASE WHEN o_orderkey % 2 = 0 THEN 'a' END, CASE WHEN o_orderkey % 3 = 0 THEN 'b' END,
      CASE WHEN o_orderkey % 5 = 0 THEN 'c' END, CASE WHEN o_orderkey % 7 < 4 THEN 'd' END], lambda x: x IS NOT NULL) AS cols FROM orders)"""


def _saves(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("job"), k.alias("at_"), F.col("o_orderstatus").alias("name"),
        F.substring("o_orderpriority", 1, 1).alias("target"),
        F.when(F.col("o_totalprice") > 250000, "append").otherwise("overwrite").alias("mode"),
        F.array_compact(F.array(
            F.lit("k"), F.when(k % 2 == 0, "a"), F.when(k % 3 == 0, "b"), F.when(k % 5 == 0, "c"), F.when(k % 7 < 4, "d")
        )).alias("columns"),
    )


@book.entry(
    "next_version",
    f"""WITH {_VERSIONS_SQL}, l AS (SELECT *, lag(name) OVER w AS pn, lag(mode) OVER w AS pm, row_number() OVER w AS rn FROM saves
          WINDOW w AS (PARTITION BY job ORDER BY at_))
        SELECT job, at_, name, mode, row_number() OVER (PARTITION BY job ORDER BY at_) AS version
        FROM l WHERE rn = 1 OR pn <> name OR pm <> mode""",
)
def next_version(spark: SparkSession, sf: str) -> DataFrame:
    return ing.next_version(_saves(spark, sf).select("job", "at_", "name", "mode"), "job", "at_", ["name", "mode"])


@book.entry(
    "version_changes",
    f"""WITH {_VERSIONS_SQL}, l AS (SELECT *, lag(name) OVER w AS pn, lag(target) OVER w AS pt, lag(mode) OVER w AS pm, lag(cols) OVER w AS pc,
            row_number() OVER w AS rn FROM saves WINDOW w AS (PARTITION BY job ORDER BY at_)),
        d AS (SELECT job, at_, list_filter(cols, lambda x: NOT list_contains(pc, x)) AS added, list_filter(pc, lambda x: NOT list_contains(cols, x)) AS gone,
            name, pn, target, pt, mode, pm FROM l WHERE rn > 1),
        n AS (SELECT job, at_, list_filter([CASE WHEN name <> pn THEN 'name changed to ' || name END,
            CASE WHEN target <> pt THEN 'target changed to raw.' || target END, CASE WHEN mode <> pm THEN 'load mode changed' END,
            CASE WHEN len(added) > 0 THEN CAST(len(added) AS VARCHAR) || ' columns added (' || array_to_string(added[1:3], ', ') || CASE WHEN len(added) > 3 THEN ' and more' ELSE '' END || ')' END,
            CASE WHEN len(gone) > 0 THEN CAST(len(gone) AS VARCHAR) || ' columns removed (' || array_to_string(gone[1:3], ', ') || CASE WHEN len(gone) > 3 THEN ' and more' ELSE '' END || ')' END],
            lambda x: x IS NOT NULL) AS notes FROM d)
        SELECT job, at_, CAST(len(notes) AS INTEGER) AS changes, coalesce(array_to_string(notes[1:3], ', '), '') ||
               CASE WHEN len(notes) > 3 THEN ' and ' || CAST(len(notes) - 3 AS VARCHAR) || ' more' ELSE '' END AS note FROM n""",
)
def version_changes(spark: SparkSession, sf: str) -> DataFrame:
    named = {"name": "name changed to {}", "target": "target changed to raw.{}", "mode": "load mode changed"}
    return ing.version_changes(_saves(spark, sf), "job", "at_", named=named)


# ---------------------------------------------------------------- files


@book.entry(
    "read_csv_raw",
    """SELECT CAST(o_orderkey AS VARCHAR) AS orderkey, o_orderstatus AS status, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE o_orderpriority END AS prio,
              'say "' || o_orderpriority || '"; twice' AS quoted FROM orders""",
)
def csv_raw(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "csv")
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias(" orderkey "), F.col("o_orderstatus").alias("status"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("prio"),
        F.concat(F.lit('say "'), "o_orderpriority", F.lit('"; twice')).alias("quoted"),
    )
    rows.write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    return files.require_rows(files.read_csv_raw(spark, path, delimiter=";"))


@book.entry(
    "read_jsonl_raw",
    """SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(value > 50 AS VARCHAR) AS big,
              '{"k":' || regexp_extract(props, '([0-9]+)', 1) || '}' AS props, CASE WHEN value > 100 THEN '한글' END AS note FROM events""",
)
def jsonl_raw(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "jsonl")
    e = table(spark, sf, "events")
    objects = e.select(F.to_json(F.struct(
        "event_id", "event_type", (F.col("value") > 50).alias("big"),
        F.from_json("props", "k int").alias("props"), F.when(F.col("value") > 100, "한글").alias("note"),
    )).alias("value"))
    noise = table(spark, sf, "nation").select(F.explode(F.array(F.lit("  "), F.to_json(F.array("n_name")))).alias("value"))
    objects.unionAll(noise).write.text(path)
    return files.read_jsonl_raw(spark, path)


@book.entry(
    "jsonl_bad_lines",
    "SELECT count(*) AS bad, CAST(min(o_orderkey) * 0 + 1 AS BIGINT) AS lowest_line FROM orders WHERE o_orderstatus = 'P'",
)
def jsonl_bad(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "jsonl-bad")
    o = table(spark, sf, "orders")
    line = F.to_json(F.struct("o_orderkey"))
    cut = F.when(F.col("o_orderstatus") == "P", F.substring(line, 1, 8)).otherwise(line)
    o.orderBy(F.col("o_orderstatus") != "P").select(cut.alias("value")).write.text(path)
    return files.jsonl_bad_lines(spark, path).agg(
        F.count(F.lit(1)).alias("bad"), F.min("line_number").alias("lowest_line")
    )


@book.entry(
    "read_text_with_fallback",
    """SELECT '고객 ' || c_name AS value, CASE WHEN c_custkey % 2 = 0 THEN 'utf-8' ELSE 'cp949' END AS encoding FROM customer""",
)
def text_fallback(spark: SparkSession, sf: str) -> DataFrame:
    root = fresh_path(spark, "text")
    c = table(spark, sf, "customer").withColumn("value", F.concat(F.lit("고객 "), "c_name"))
    c.filter("c_custkey % 2 = 0").select("value").write.text(f"{root}/utf")

    def encode(values: pd.Series) -> pd.Series:
        return values.str.encode("cp949")

    packed = F.pandas_udf(encode, "binary")("value").cast("string")
    c.filter("c_custkey % 2 = 1").select(packed.alias("value")).write.text(f"{root}/kr")
    return files.read_text_with_fallback(spark, f"{root}/*").select("value", "encoding")


# ---------------------------------------------------------------- landed responses


def _q(name: str, value: Column) -> Column:
    return F.concat(F.lit(f'"{name}":'), value)


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON body per order, in six shapes a source is known to send."""
    k = F.col("o_orderkey")
    item = lambda a, b: F.concat(F.lit('{"k":'), a.cast("string"), F.lit(',"v":'), b, F.lit("}"))
    prio = F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"'))
    one, two = item(k, prio), item(F.col("o_custkey"), F.lit("null"))
    ok = '{"response":{"header":{"resultCode":"00"},"body":'
    body = (
        F.when(k % 6 == 0, F.concat(F.lit(ok + '{"items":{"item":['), one, F.lit(","), two, F.lit(']},"totalCount":"2"}}}')))
        .when(k % 6 == 1, F.concat(F.lit(ok + '{"items":{"item":'), one, F.lit('},"totalCount":1}}}')))
        .when(k % 6 == 2, F.lit(ok + '{"items":"","totalCount":0}}}'))
        .when(k % 6 == 3, F.lit(ok + '{"rows":1}}}'))
        .when(k % 6 == 4, F.lit(ok + '{"items":{"item":[1,2]}}}}'))
        .when(k % 12 == 5, F.concat(F.lit('{"response":{"header":{"resultCode":"22","resultMsg":"LIMIT '), F.col("o_orderstatus"), F.lit('"}}}')))
        .otherwise(F.lit('{"OpenAPI_ServiceResponse":{"cmmMsgHeader":{"errMsg":"SERVICE ERROR","returnReasonCode":"30"}}}'))
    )
    return table(spark, sf, "orders").select(k.alias("call_id"), F.lit(1).alias("page"), body.alias("body"))


@book.entry(
    "records_from_json",
    """SELECT o_orderkey AS call_id, 0 AS pos, CAST(o_orderkey AS VARCHAR) AS k, o_orderpriority AS v FROM orders WHERE o_orderkey % 6 IN (0, 1)
       UNION ALL SELECT o_orderkey, 1, CAST(o_custkey AS VARCHAR), NULL FROM orders WHERE o_orderkey % 6 = 0""",
)
def records_json(spark: SparkSession, sf: str) -> DataFrame:
    out = responses.records_from_json(_responses(spark, sf), "response.body.items.item", strict=False)
    return out.select("call_id", "pos", F.col("record")["k"].alias("k"), F.col("record")["v"].alias("v"))


@book.entry(
    "response_outcomes",
    """SELECT o_orderkey AS call_id, CASE o_orderkey % 6 WHEN 0 THEN 'records' WHEN 1 THEN 'records' WHEN 2 THEN 'empty'
              WHEN 3 THEN 'path_error' WHEN 4 THEN 'not_records' ELSE 'path_error' END AS outcome FROM orders""",
)
def response_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return responses.walk_outcomes(_responses(spark, sf), "response.body.items.item").select("call_id", "outcome")


@book.entry(
    "flag_error_bodies",
    """SELECT o_orderkey AS call_id, o_orderkey % 6 = 5 AS is_error,
              CASE WHEN o_orderkey % 12 = 5 THEN '22' WHEN o_orderkey % 12 = 11 THEN '30' END AS error_code,
              CASE WHEN o_orderkey % 12 = 5 THEN 'LIMIT ' || o_orderstatus WHEN o_orderkey % 12 = 11 THEN 'SERVICE ERROR' END AS error_message FROM orders""",
)
def flag_errors(spark: SparkSession, sf: str) -> DataFrame:
    return responses.flag_error_bodies(_responses(spark, sf)).drop("page", "body")


@book.entry(
    "flag_error_bodies_mixed",
    """SELECT c_custkey AS call_id, c_custkey % 6 IN (1, 2, 3) AS is_error,
              CASE c_custkey % 6 WHEN 1 THEN '022' WHEN 2 THEN '30' WHEN 3 THEN '5' END AS error_code,
              CASE c_custkey % 6 WHEN 1 THEN 'LIMIT ' || c_mktsegment WHEN 2 THEN 'SERVICE ERROR' WHEN 3 THEN c_name END AS error_message FROM customer""",
)
def flag_errors_mixed(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey") % 6
    head = lambda inner: F.concat(F.lit("<?xml version='1.0'?><!-- a > b --><response><header>"), inner, F.lit("</header><body/></response>"))
    body = (
        F.when(k == 0, head(F.lit("<resultCode>00</resultCode>")))
        .when(k == 1, head(F.concat(F.lit("<resultCode>022</resultCode><resultMsg> LIMIT "), "c_mktsegment", F.lit(" </resultMsg>"))))
        .when(k == 2, "<OpenAPI_ServiceResponse><cmmMsgHeader><errMsg>SERVICE ERROR</errMsg><returnReasonCode>30</returnReasonCode></cmmMsgHeader></OpenAPI_ServiceResponse>")
        .when(k == 3, F.to_json(F.struct(F.struct(F.struct(F.lit(5).alias("resultCode"), F.col("c_name").alias("resultMsg")).alias("header")).alias("response"))))
        .when(k == 4, "<response><header><resultCode>9</resultCode>").otherwise("<other><header><resultCode>9</resultCode></header></other>")
    )
    calls = table(spark, sf, "customer").select(F.col("c_custkey").alias("call_id"), body.alias("body"))
    return responses.flag_error_bodies(calls).drop("body")


@book.entry(
    "records_from_xml",
    """SELECT c_custkey AS call_id, 0 AS pos, CAST(c_custkey AS VARCHAR) AS k, c_mktsegment AS v FROM customer WHERE c_custkey % 4 < 2
       UNION ALL SELECT c_custkey, 1, CAST(c_nationkey AS VARCHAR), '' FROM customer WHERE c_custkey % 4 = 0""",
)
def records_xml(spark: SparkSession, sf: str) -> DataFrame:
    out = responses.records_from_xml(_xml(spark, sf), "response.body.items.item", strict=False)
    return out.select("call_id", "pos", F.col("record")["k"].alias("k"), F.col("record")["v"].alias("v"))


def _xml(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    one = F.concat(F.lit('<item id="7"><k>'), k.cast("string"), F.lit("</k><v> "), "c_mktsegment", F.lit(" </v></item>"))
    two = F.concat(F.lit("<item><k>"), F.col("c_nationkey").cast("string"), F.lit("</k><v/></item>"))
    wrap = lambda inner: F.concat(F.lit("<response><body>"), inner, F.lit("</body></response>"))
    body = (
        F.when(k % 4 == 0, wrap(F.concat(F.lit("<items>"), one, two, F.lit("</items>"))))
        .when(k % 4 == 1, wrap(F.concat(F.lit("<items>"), one, F.lit("</items>"))))
        .when(k % 4 == 2, wrap(F.lit("<items/>"))).otherwise(wrap(F.lit("<other>1</other>")))
    )
    rows = dealt(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"))
    return rows.select(k.alias("call_id"), body.alias("body"))


@book.entry(
    "xml_outcomes",
    """SELECT c_custkey AS call_id, CASE c_custkey % 4 WHEN 2 THEN 'empty' WHEN 3 THEN 'path_error' ELSE 'records' END AS outcome FROM customer""",
)
def xml_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return responses.xml_outcomes(_xml(spark, sf), "response.body.items.item").select("call_id", "outcome")


_PAGES_SQL = """pages AS (SELECT l_orderkey AS call_id, l_linenumber AS page, CAST(sum(l_quantity) AS BIGINT) AS rows,
    CASE WHEN l_orderkey % 3 = 0 THEN CAST(100 AS VARCHAR) WHEN l_orderkey % 3 = 1 THEN 'n/a' END AS total FROM lineitem GROUP BY 1, 2),
  along AS (SELECT *, CAST(sum(rows) OVER w AS BIGINT) AS collected, row_number() OVER w AS nth_page FROM pages
    WINDOW w AS (PARTITION BY call_id ORDER BY page))"""


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("call_id")
    grouped = table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("page")
    ).agg(F.sum("l_quantity").cast("long").alias("rows"))
    return grouped.withColumn("total", F.when(k % 3 == 0, "100").when(k % 3 == 1, "n/a"))


@book.entry("running_page_total", f"WITH {_PAGES_SQL} SELECT call_id, page, rows, collected, nth_page FROM along")
def running_total(spark: SparkSession, sf: str) -> DataFrame:
    return responses.running_page_total(_pages(spark, sf)).select("call_id", "page", "rows", "collected", "nth_page")


@book.entry(
    "page_completeness",
    f"""WITH {_PAGES_SQL}, e AS (SELECT *, TRY_CAST(total AS BIGINT) AS t, coalesce(collected >= TRY_CAST(total AS BIGINT), false) OR rows = 0 OR rows < 20 AS ends FROM along),
        c AS (SELECT call_id, count(*) AS pages, CAST(sum(rows) AS BIGINT) AS rows, max(t) AS declared, arg_max(ends, page) AS last_ends,
              count(*) FILTER (WHERE ends) AS n_ends FROM e GROUP BY 1)
        SELECT call_id, pages, rows, declared, CASE WHEN pages > 500 THEN 'too_many_pages' WHEN NOT last_ends THEN 'truncated'
               WHEN n_ends > 1 THEN 'read_past_end' ELSE 'complete' END AS verdict,
               CASE WHEN declared IS NULL THEN 0 ELSE greatest(declared - rows, 0) END AS missing FROM c""",
)
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    return responses.page_completeness(_pages(spark, sf), size=20)


@book.entry(
    "page_sizes_per_call",
    f"""WITH {_PAGES_SQL}, e AS (SELECT *, CASE WHEN call_id % 4 > 0 THEN 10 * (call_id % 4) ELSE 0 END AS asked, TRY_CAST(total AS BIGINT) AS t FROM along),
        f AS (SELECT *, coalesce(collected >= t, false) OR rows = 0 OR (asked > 0 AND rows < asked) OR (t IS NULL AND asked = 0) AS ends FROM e),
        c AS (SELECT call_id, arg_max(ends, page) AS last_ends, count(*) FILTER (WHERE ends) AS n_ends FROM f GROUP BY 1)
        SELECT call_id, CASE WHEN NOT last_ends THEN 'truncated' WHEN n_ends > 1 THEN 'read_past_end' ELSE 'complete' END AS verdict FROM c""",
)
def page_sizes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("call_id") % 4
    pages = _pages(spark, sf).withColumn("asked", F.when(k > 0, k * 10))
    return responses.page_completeness(pages, size="asked").select("call_id", "verdict")


# ---------------------------------------------------------------- loads


def _fresh_table(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"


@book.entry(
    "load_raw",
    """SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS name, 'b' AS _ingested_at FROM customer
       UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, 'c' FROM supplier""",
)
def load_raw(spark: SparkSession, sf: str) -> DataFrame:
    name = _fresh_table("raw_people")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    s = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"))
    tables.load_raw(spark, name, s.select("k", "name"), mode="append", ingested_at="a")
    tables.load_raw(spark, name, c, mode="overwrite", ingested_at="b")
    tables.load_raw(spark, name, s, mode="append", ingested_at="c")
    return spark.table(name)


@book.entry(
    "run_ingest",
    """SELECT CAST(o_orderkey AS VARCHAR) AS orderkey, o_orderstatus AS status, strftime(o_orderdate, '%Y%m') AS month, 'now' AS _ingested_at
       FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-07-01' AND o_orderstatus IN ('F','O')""",
)
def run_ingest(spark: SparkSession, sf: str) -> DataFrame:
    landed = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"),
        F.date_format("o_orderdate", "yyyyMM").alias("month"), F.col("o_orderdate"),
    )

    def fetch(calls: list[dict[str, str]]) -> DataFrame:
        hit = F.lit(False)
        for c in calls:
            first = F.to_timestamp_ntz(F.lit(c["ym"] + "01"), F.lit("yyyyMMdd"))
            inside = (F.col("o_orderdate") >= first) & (F.col("o_orderdate") < first + F.expr("INTERVAL 1 MONTH"))
            hit = hit | (inside & (F.col("status") == c["status"]))
        return landed.filter(hit).drop("o_orderdate")

    name = _fresh_table("raw_orders")
    scope = {"mode": "incremental", "shape": "point", "unit": "month", "format": "YYYYMM", "param": "ym",
             "fan_param": "status", "fan_values": "F O", "max_calls_per_run": 4}
    marks = ["1995-02-10"]
    job = {"id": "j", "target": name, "mode": "overwrite", "scope": scope}
    while tables.run_ingest(
        spark, {**job, "watermark": marks[-1]}, fetch, marks.append, today="1995-06-15", ingested_at="now"
    )["remaining"]:
        job["mode"] = "append"
    return spark.table(name)


@book.entry(
    "run_file_job",
    """SELECT k, arg_max(segment, n) AS segment, arg_max(_ingested_at, n) AS _ingested_at FROM (
         SELECT CAST(c_nationkey AS VARCHAR) AS k, c_mktsegment AS segment, 'csv' AS _ingested_at, c_custkey AS n FROM customer) GROUP BY 1
       UNION ALL SELECT CAST(s_suppkey AS VARCHAR), NULL, 'jsonl' FROM supplier""",
)
def file_job(spark: SparkSession, sf: str) -> DataFrame:
    root, name = fresh_path(spark, "job"), _fresh_table("raw_files")
    c = table(spark, sf, "customer").orderBy("c_custkey").coalesce(1)
    c.select(F.col("c_nationkey").alias(" k "), F.col("c_mktsegment").alias("segment"), "c_name").write.options(header=True, sep=";").csv(f"{root}/csv")
    table(spark, sf, "supplier").select(F.to_json(F.struct(F.col("s_suppkey").alias("k"), "s_name")).alias("value")).write.text(f"{root}/jsonl")
    job = {"id": "f", "target": name, "mode": "overwrite", "columns": ["k", "segment"], "dedupe": ["k"],
           "config": {"format": "csv", "delimiter": ";"}}
    tables.run_file_job(spark, job, f"{root}/csv", ingested_at="csv")
    job |= {"mode": "append", "config": {"format": "jsonl"}}
    tables.run_file_job(spark, job, f"{root}/jsonl", ingested_at="jsonl")
    return spark.table(name)


@book.entry(
    "materialize_incremental",
    "SELECT o_orderkey, o_orderstatus FROM orders",
)
def materialize(spark: SparkSession, sf: str) -> DataFrame:
    name = _fresh_table("model_orders")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    half = tables.materialize(spark, f"{name}_view", o.filter("o_orderkey < 700"), "view")
    tables.materialize(spark, name, tables.materialize(spark, name, half, "ephemeral"), "table")
    return tables.materialize(spark, name, o, "incremental", newer_than="o_orderkey")


@book.entry(
    "materialize_merge",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'late' ELSE o_orderstatus END AS o_orderstatus,
              strftime(CASE WHEN o_orderkey % 5 = 0 THEN (SELECT max(o_orderdate) FROM orders) ELSE o_orderdate END, '%Y-%m-%d') AS day FROM orders""",
)
def materialize_merge(spark: SparkSession, sf: str) -> DataFrame:
    name = _fresh_table("merged_orders")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    newest = orders.agg(F.max("day")).scalar()
    late = orders.filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit("late").alias("o_orderstatus"), newest.alias("day"))
    tables.materialize(spark, name, orders, "incremental", newer_than="day", keys=["o_orderkey"])
    return tables.materialize(spark, name, late, "incremental", newer_than="day", keys=["o_orderkey"])


@book.entry(
    "load_seed",
    "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name FROM supplier",
)
def load_seed(spark: SparkSession, sf: str) -> DataFrame:
    path, name = fresh_path(spark, "seed"), _fresh_table("seed_supplier")
    table(spark, sf, "supplier").select("s_suppkey", "s_name").write.option("header", True).csv(path)
    tables.load_seed(spark, name, path)
    return spark.table(name)


@book.entry(
    "append_history",
    """WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events)
       SELECT user_id, event_type, event_id FROM a WHERE rn = 1""",
)
def append_history(spark: SparkSession, sf: str) -> DataFrame:
    name = _fresh_table("rule_history")
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    tables.append_history(spark, name, rows, ["user_id", "event_type"], ["event_id"])
    tables.append_history(spark, name, rows, ["user_id", "event_type"], ["event_id"])
    return spark.table(name)


@book.entry(
    "table_preview",
    """SELECT o_orderpriority, lower(hex(encode(o_orderpriority))) AS bytes, CAST(count(*) AS DOUBLE) AS price,
              strftime(max(o_orderdate), '%Y-%m-%d') AS day, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS since
       FROM orders GROUP BY 1""",
)
def preview(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.max(F.col("o_orderpriority").cast("binary")).alias("bytes"),
        F.count(F.lit(1)).cast("decimal(18,2)").alias("price"),
        F.max("o_orderdate").cast("date").alias("day"), F.min("o_orderdate").alias("since"),
    )
    return tables.preview(rows, 200)


@book.entry(
    "table_counts",
    "SELECT 'customer' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'missing', NULL",
)
def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    name = _fresh_table("v_customer")
    table(spark, sf, "customer").createOrReplaceTempView(name)
    counts = [("customer", tables.table_count(spark, name)), ("missing", tables.table_count(spark, "no_such_table_here"))]
    return spark.createDataFrame(counts, "name string, rows long")


@book.entry(
    "live_files",
    """SELECT DISTINCT 'o_orderpriority=' || o_orderpriority AS partition, CAST(1 AS BIGINT) AS files, TRUE AS filled
       FROM orders""",
)
def live_files(spark: SparkSession, sf: str) -> DataFrame:
    name = f"priorities_{uuid.uuid4().hex[:12]}"
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    for _ in range(2):  # the second version replaces the first in a folder of its own, so its files alone are live
        path = tables.table_path(spark, name)
        orders.repartition("o_orderpriority").write.partitionBy("o_orderpriority").parquet(path)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.catalog.createTable(name, path=path, source="parquet")
    found = listing.live_files(spark, name)
    return found.groupBy("partition").agg(F.count(F.lit(1)).alias("files"), (F.min("bytes") > 0).alias("filled"))


@book.entry(
    "list_objects",
    """SELECT DISTINCT 'year=' || year(CAST(o_orderdate AS DATE)) || '/status=' || o_orderstatus AS folder, CAST(1 AS BIGINT) AS objects
       FROM orders""",
)
def list_objects(spark: SparkSession, sf: str) -> DataFrame:
    root = fresh_path(spark, "objects")
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.year(F.col("o_orderdate").cast("date")).alias("year"), F.col("o_orderstatus").alias("status")
    )
    orders.repartition("year", "status").write.partitionBy("year", "status").parquet(root)
    found = listing.list_objects(spark, root, width=4).filter(~listing.hidden(F.col("path")))
    return found.groupBy(listing.folder_under(F.col("path"), root).alias("folder")).agg(F.count(F.lit(1)).alias("objects"))


@book.entry(
    "export_csv",
    "SELECT count(*) AS rows, true AS has_bom FROM customer",
)
def export_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "export")
    tables.export_csv(table(spark, sf, "customer").select("c_custkey", "c_name"), path)
    raw = spark.read.text(path)
    bom = raw.filter(F.col("value").endswith("c_custkey,c_name"))
    return files.read_csv_raw(spark, path).agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "has_bom", F.lit(not bom.isEmpty())
    )


@book.entry(
    "store_violations",
    """SELECT '{"c_custkey":' || CAST(c_custkey AS VARCHAR) || '}' AS row FROM customer WHERE c_acctbal < 0""",
)
def store_violations(spark: SparkSession, sf: str) -> DataFrame:
    from millrace.operators.quality import accepted_range

    root = fresh_path(spark, "violations")
    bad = accepted_range(table(spark, sf, "customer"), "c_acctbal", 0).select("c_custkey")
    tables.store_violations(bad, "c_bal", root)
    return tables.read_violations(spark, root, "c_bal", status="err", limit=None)[1]


@book.entry(
    "read_run_artifacts",
    """WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, event_type, value, event_id,
           row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d'), user_id, event_type = 'signup' ORDER BY event_id DESC) AS rn FROM events),
       k AS (SELECT CASE WHEN event_type = 'signup' THEN 'test.shop.t' || CAST(user_id AS VARCHAR) ELSE 'm' || CAST(user_id AS VARCHAR) END AS key,
           CASE WHEN event_type = 'signup' THEN 'test' ELSE 'model' END AS resource_type, event_type AS status, value AS execution_time, event_id AS rows_affected, day
           FROM d WHERE rn = 1)
       SELECT key, resource_type, status, execution_time, rows_affected FROM (
         SELECT *, row_number() OVER (PARTITION BY key ORDER BY day DESC) AS r FROM k) WHERE r = 1""",
)
def run_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    root = fresh_path(spark, "artifacts")
    e = table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    is_test = F.col("event_type") == "signup"
    last = e.groupBy("day", "user_id", is_test.alias("is_test")).agg(
        F.max(F.struct("event_id", "event_type", "value")).alias("r")
    )
    uid = F.concat(F.when(F.col("is_test"), "test.shop.t").otherwise("model.shop.m"), F.col("user_id").cast("string"))
    doc = F.to_json(F.struct(F.array(F.struct(
        uid.alias("unique_id"), F.col("r.event_type").alias("status"), F.col("r.value").alias("execution_time"),
        F.struct(F.col("r.event_id").alias("rows_affected")).alias("adapter_response"),
    )).alias("results")))
    last.select("day", doc.alias("value")).write.partitionBy("day").text(root)
    broken = table(spark, sf, "region").select(F.lit("2023-12-31").alias("day"), F.concat(F.lit('{"results": ['), "r_name").alias("value"))
    broken.write.mode("append").partitionBy("day").text(root)
    out = artifacts.read_run_artifacts(spark, root, pattern="*/*.txt", multiline=False)
    return out.select("key", "resource_type", "status", "execution_time", "rows_affected")


def _manifest_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Manifest entries made from customers (models), suppliers (sources) and orders (tests)."""
    s = table(spark, sf, "supplier")
    c = dealt(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"))
    o = dealt(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    text = lambda col: F.col(col).cast("string")
    dep = lambda v: F.struct(F.array(v).alias("nodes")).alias("depends_on")
    sources = s.select(
        F.concat(F.lit("source.shop.raw.s"), text("s_suppkey")).alias("uid"), F.lit("sources").alias("section"),
        F.to_json(F.struct(
            F.concat(F.lit("s"), text("s_suppkey")).alias("name"), F.lit("shop").alias("package_name"), F.lit("raw").alias("schema"),
        )).alias("node"),
    )
    models = c.select(
        F.concat(F.lit("model.shop.m"), text("c_custkey")).alias("uid"), F.lit("nodes").alias("section"),
        F.to_json(F.struct(
            F.concat(F.lit("m"), text("c_custkey")).alias("name"), F.lit("model").alias("resource_type"),
            F.when(F.col("c_custkey") % 10 == 9, "other").otherwise("shop").alias("package_name"),
            F.lit("analytics").alias("schema"), F.struct(F.lit("table").alias("materialized")).alias("config"),
            dep(F.concat(F.lit("source.shop.raw.s"), (F.col("c_custkey") % 150).cast("string"))),
            F.create_map(F.lit("id"), F.struct(F.lit("bigint").alias("data_type"),
                         F.struct(F.col("c_mktsegment").alias("label")).alias("meta"))).alias("columns"),
        )).alias("node"),
    )
    tests = o.select(
        F.concat(F.lit("test.shop.t"), text("o_orderkey")).alias("uid"),
        F.when(F.col("o_orderstatus") == "P", "disabled").otherwise("nodes").alias("section"),
        F.to_json(F.struct(
            F.concat(F.lit("t"), text("o_orderkey")).alias("name"), F.lit("test").alias("resource_type"),
            F.lit("shop").alias("package_name"), F.when(F.col("o_orderkey") % 3 > 0, "id").alias("column_name"),
            F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("model.shop.m"), text("o_custkey"))).alias("attached_node"),
            F.struct(F.when(F.col("o_orderpriority") == "5-LOW", "WARN").alias("severity")).alias("config"),
            dep(F.concat(F.lit("model.shop.m"), text("o_custkey"))),
            F.when(F.col("o_orderkey") % 3 > 0, F.struct(
                F.when(F.col("o_orderkey") % 3 == 1, "not_null").otherwise("unique").alias("name"),
                F.create_map(F.lit("model"), F.lit("x"), F.lit("limit"), text("o_custkey")).alias("kwargs"),
            )).alias("test_metadata"),
        )).alias("node"),
    )
    return sources.unionByName(models).unionByName(tests)


def _manifest(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return artifacts.read_manifest(_manifest_entries(spark, sf), "shop")


_MAN_RULES_SQL = """man_rules AS (SELECT 'test.shop.t' || CAST(o_orderkey AS VARCHAR) AS uid,
    CASE o_orderkey % 3 WHEN 0 THEN 'singular' WHEN 1 THEN 'not_null' ELSE 'unique' END AS check_name,
    CASE WHEN o_orderkey % 3 > 0 THEN 'id' ELSE '' END AS col, CASE WHEN o_orderpriority = '5-LOW' THEN 'warn' ELSE 'error' END AS severity,
    CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS VARCHAR) END AS lim, o_orderkey % 3 = 0 AS singular,
    o_orderstatus <> 'P' AS enabled, 'm' || CAST(o_custkey AS VARCHAR) AS model_id FROM orders WHERE o_custkey % 10 <> 9)"""


@book.entry("read_manifest_rules", f"WITH {_MAN_RULES_SQL} SELECT * FROM man_rules")
def manifest_rules(spark: SparkSession, sf: str) -> DataFrame:
    out = _manifest(spark, sf)["rules"]
    return out.select(
        "uid", "check_name", "col", "severity", F.try_element_at("kwargs", F.lit("limit")).alias("lim"),
        "singular", "enabled", "model_id",
    )


@book.entry(
    "read_manifest_columns",
    f"""WITH {_MAN_RULES_SQL} SELECT 'm' || CAST(c_custkey AS VARCHAR) AS model_id, 'id' AS name, c_mktsegment AS label, 'BIGINT' AS type,
          'm' || CAST(c_custkey AS VARCHAR) IN (SELECT model_id FROM man_rules WHERE check_name = 'not_null' AND severity = 'error' AND enabled) AS required
        FROM customer WHERE c_custkey % 10 <> 9""",
)
def manifest_columns(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf)["columns"].drop("pos")


@book.entry(
    "read_manifest_physical",
    """SELECT 'm' || CAST(c_custkey AS VARCHAR) AS model_id, 'id' AS name, c_mktsegment AS label, 'BIGINT' AS type, 0 AS nth FROM customer WHERE c_custkey % 10 <> 9
       UNION ALL SELECT 'm' || CAST(c_custkey AS VARCHAR), 'nation', 'nation', 'VARCHAR', 1 FROM customer WHERE c_custkey % 10 <> 9 AND c_custkey % 2 = 0
       UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), 'phone', 'phone', '', 0 FROM supplier""",
)
def manifest_physical(spark: SparkSession, sf: str) -> DataFrame:
    model = F.concat(F.lit("model.shop.m"), F.col("c_custkey").cast("string")).alias("uid")
    found = F.explode(F.array(
        F.struct(F.lit(0).alias("pos"), F.lit("id").alias("name"), F.lit("hugeint").alias("type")),
        F.struct(F.lit(1).alias("pos"), F.lit("nation").alias("name"), F.lit("varchar").alias("type")),
    ))
    models = table(spark, sf, "customer").select(model, "c_custkey", found.alias("f")).filter("f.pos = 0 OR c_custkey % 2 = 0").select("uid", "f.*")
    sources = table(spark, sf, "supplier").select(
        F.concat(F.lit("source.shop.raw.s"), F.col("s_suppkey").cast("string")).alias("uid"), F.lit(0).alias("pos"),
        F.lit("phone").alias("name"), F.lit(None).cast("string").alias("type"),
    )
    out = artifacts.read_manifest(_manifest_entries(spark, sf), "shop", models.unionByName(sources))["columns"]
    # Positions have gaps; the documented column comes first.
    return out.select("model_id", "name", "label", "type", F.when(F.col("pos") > 0, 1).otherwise(0).alias("nth"))


@book.entry(
    "read_manifest_models",
    """SELECT 'm' || CAST(c_custkey AS VARCHAR) AS id, 'model' AS dbt_type, 'analytics.m' || CAST(c_custkey AS VARCHAR) AS phys, 'DATA MODEL' AS "group", 'table' AS mat FROM customer WHERE c_custkey % 10 <> 9
       UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), 'source', 'raw.s' || CAST(s_suppkey AS VARCHAR), 'SOURCE', '' FROM supplier""",
)
def manifest_models(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf)["models"].select("id", "dbt_type", "phys", "group", "mat")


@book.entry(
    "read_manifest_edges",
    """SELECT 's' || CAST(s_suppkey AS VARCHAR) AS src, 'm' || CAST(c_custkey AS VARCHAR) AS dst FROM customer JOIN supplier ON s_suppkey = c_custkey % 150
       WHERE c_custkey % 10 <> 9""",
)
def manifest_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _manifest(spark, sf)["edges"]
