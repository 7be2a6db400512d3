"""Run, node and test history over facts derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import times
from millrace.operators import history as h
from millrace.registry import facts
from millrace.registry.book import book
from millrace.registry.facts import AS_OF, table

R, I, T = facts.RUN_RESULTS_SQL, facts.INVOCATIONS_SQL, facts.TEST_RESULTS_SQL
_BUILD = "resource_type IN ('model','seed','snapshot')"
_TEST = "resource_type IN ('test','unit_test')"
_BAD = "status NOT IN ('success','pass')"


def _since(col: str, days: int) -> str:
    return f"CAST({col} AS TIMESTAMP) >= TIMESTAMP '{AS_OF}' - INTERVAL {days} DAY"


def _pct(p: str, w: str, d: int = 1, empty: str = "NULL") -> str:
    return f"CASE WHEN {w} > 0 THEN round(CAST({p} AS DOUBLE) / CAST({w} AS DOUBLE) * 100 + 1e-9, {d}) ELSE {empty} END"


def _text(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("string"))
    return df


_NODE = f"""count(*) FILTER (WHERE {_BUILD}) AS node_runs,
  count(*) FILTER (WHERE {_BUILD} AND {_BAD}) AS node_fails,
  round(sum(execution_time) FILTER (WHERE {_BUILD}) + 1e-9, 1) AS build_seconds,
  count(*) FILTER (WHERE {_TEST}) AS test_runs,
  count(*) FILTER (WHERE {_TEST} AND status = 'pass') AS test_pass,
  count(*) FILTER (WHERE {_TEST} AND status = 'warn') AS test_warn,
  count(*) FILTER (WHERE {_TEST} AND status IN ('fail','error')) AS test_fail"""
_RATES = f"{_pct('node_runs - node_fails', 'node_runs')} AS success_rate, {_pct('test_pass', 'test_runs')} AS test_pass_rate"


def _summary_sql(days: int, commands: bool = True) -> str:
    extra = ", count(DISTINCT command) AS commands" if commands else ""
    return f"""SELECT n.*, i.*, {_RATES}, {days} AS days
      FROM (SELECT {_NODE} FROM run_results WHERE {_since('generated_at', days)}) n,
           (SELECT count(*) AS runs, CAST(min(CAST(run_started_at AS TIMESTAMP)) AS VARCHAR) AS first_run,
                   CAST(max(CAST(run_started_at AS TIMESTAMP)) AS VARCHAR) AS last_run {extra}
            FROM invocations WHERE {_since('run_started_at', days)}) i"""


@book.entry("history_summary", f"WITH {I} {_summary_sql(30)}")
def summary(spark: SparkSession, sf: str) -> DataFrame:
    out = h.summary(facts.invocations(spark, sf), facts.run_results(spark, sf), days=30, as_of=AS_OF)
    return _text(out, "first_run", "last_run")


@book.entry("two_span_summary", f"WITH {I} {_summary_sql(1, False)} UNION ALL BY NAME {_summary_sql(7, False)}")
def two_span(spark: SparkSession, sf: str) -> DataFrame:
    out = h.two_span_summary(facts.invocations(spark, sf), facts.run_results(spark, sf), as_of=AS_OF)
    return _text(out, "first_run", "last_run")


def _slow_sql(days: int, limit: int) -> str:
    return f"""SELECT *, {_pct('total_seconds', 'sum(total_seconds) OVER ()', 1, '0.0')} AS share FROM (
      SELECT name, count(*) AS runs, round(sum(execution_time) + 1e-9, 1) AS total_seconds,
             round(avg(execution_time) + 1e-9, 2) AS avg_seconds, round(max(execution_time) + 1e-9, 2) AS max_seconds
      FROM run_results WHERE {_since('generated_at', days)} AND {_BUILD}
      GROUP BY 1 ORDER BY total_seconds DESC, name LIMIT {limit})"""


@book.entry("slowest_models", f"WITH {R} {_slow_sql(30, 10)}")
def slowest(spark: SparkSession, sf: str) -> DataFrame:
    return h.slowest_models(facts.run_results(spark, sf), days=30, as_of=AS_OF)


@book.entry("share_of_total", f"WITH {R} SELECT name, share FROM ({_slow_sql(7, 100)})")
def share(spark: SparkSession, sf: str) -> DataFrame:
    return h.slowest_models(facts.run_results(spark, sf), days=7, as_of=AS_OF, limit=100).select("name", "share")


@book.entry(
    "two_span_slowest",
    f"WITH {R} SELECT *, 1 AS days FROM ({_slow_sql(1, 100)}) UNION ALL SELECT *, 7 AS days FROM ({_slow_sql(7, 100)})",
)
def two_slow(spark: SparkSession, sf: str) -> DataFrame:
    return h.two_span_slowest(facts.run_results(spark, sf), as_of=AS_OF)


@book.entry(
    "spans_agree",
    f"""WITH {R} SELECT 'summary ' || d || 'd' AS checked, 1 AS compared, 0 AS differences, true AS ok
          FROM (SELECT unnest(['1','7']) AS d) WHERE (SELECT count(*) FROM run_results) > 0
        UNION ALL SELECT 'slowest 1d', (SELECT count(*) FROM ({_slow_sql(1, 100)})), 0, true
        UNION ALL SELECT 'slowest 7d', (SELECT count(*) FROM ({_slow_sql(7, 100)})), 0, true""",
)
def agree(spark: SparkSession, sf: str) -> DataFrame:
    return h.spans_agree(facts.invocations(spark, sf), facts.run_results(spark, sf), as_of=AS_OF)


@book.entry(
    "runs_with_nodes",
    f"""WITH {I} SELECT i.invocation_id, i.command, i.run_started_at, i.run_completed_at,
          round(date_diff('millisecond', CAST(run_started_at AS TIMESTAMP), CAST(run_completed_at AS TIMESTAMP)) / 1000.0 + 1e-9, 1) AS wall_seconds,
          count(r.unique_id) AS nodes, count(*) FILTER (WHERE {_BAD}) AS fails,
          round(sum(execution_time) + 1e-9, 2) AS exec_seconds
        FROM invocations i LEFT JOIN run_results r ON r.invocation_id = i.invocation_id
        WHERE command = 'build' AND {_since('run_started_at', 20)}
        GROUP BY 1, 2, 3, 4 ORDER BY run_started_at DESC, invocation_id LIMIT 50""",
)
def runs_with_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return h.runs_with_nodes(
        facts.invocations(spark, sf), facts.run_results(spark, sf), days=20, as_of=AS_OF, command="build"
    )


@book.entry(
    "run_nodes",
    f"""WITH {R} SELECT unique_id, name, status, execution_time, rows_affected, failures,
          round(date_diff('millisecond', CAST(compile_started_at AS TIMESTAMP), CAST(compile_completed_at AS TIMESTAMP)) / 1000.0 + 1e-9, 3) AS compile_seconds,
          round(date_diff('millisecond', CAST(execute_started_at AS TIMESTAMP), CAST(execute_completed_at AS TIMESTAMP)) / 1000.0 + 1e-9, 3) AS execute_seconds
        FROM run_results WHERE invocation_id = '2024-01-15-2'""",
)
def run_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return h.run_nodes(facts.run_results(spark, sf), "2024-01-15-2").select(
        "unique_id", "name", "status", "execution_time", "rows_affected", "failures", "compile_seconds", "execute_seconds"
    )


@book.entry(
    "model_stats",
    f"""WITH {R} SELECT name, unique_id, resource_type, count(*) AS runs, count(*) FILTER (WHERE {_BAD}) AS fails,
          round(avg(execution_time) + 1e-9, 2) AS avg_seconds,
          round(quantile_cont(execution_time, 0.5) + 1e-9, 2) AS p50_seconds,
          round(quantile_cont(execution_time, 0.95) + 1e-9, 2) AS p95_seconds,
          round(max(execution_time) + 1e-9, 2) AS max_seconds, round(sum(execution_time) + 1e-9, 1) AS total_seconds,
          CAST(max(CAST(generated_at AS TIMESTAMP)) AS VARCHAR) AS last_run_at, max(materialization) AS materialization,
          {_pct(f'count(*) FILTER (WHERE {_BAD})', 'count(*)', 1, '0.0')} AS fail_rate,
          coalesce(bool_or(name IN (SELECT 'm' || CAST(s_suppkey AS VARCHAR) FROM supplier)), false) AS exists
        FROM run_results WHERE {_since('generated_at', 30)} AND {_BUILD}
        GROUP BY 1, 2, 3 ORDER BY total_seconds DESC, name, unique_id, resource_type LIMIT 500""",
)
def model_stats(spark: SparkSession, sf: str) -> DataFrame:
    catalog = table(spark, sf, "supplier").select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("id"))
    out = h.model_stats(facts.run_results(spark, sf), days=30, as_of=AS_OF, limit=500, catalog=catalog)
    return _text(out, "last_run_at")


@book.entry(
    "model_series",
    f"""WITH {R} SELECT generated_at, status, execution_time, invocation_id,
          round(date_diff('millisecond', CAST(compile_started_at AS TIMESTAMP), CAST(compile_completed_at AS TIMESTAMP)) / 1000.0 + 1e-9, 3) AS compile_seconds,
          round(date_diff('millisecond', CAST(execute_started_at AS TIMESTAMP), CAST(execute_completed_at AS TIMESTAMP)) / 1000.0 + 1e-9, 3) AS execute_seconds FROM run_results
        WHERE name = 'm42' AND {_since('generated_at', 30)} ORDER BY generated_at DESC, unique_id LIMIT 100""",
)
def model_series(spark: SparkSession, sf: str) -> DataFrame:
    return h.model_series(facts.run_results(spark, sf), "m42", days=30, as_of=AS_OF).select(
        "generated_at", "status", "execution_time", "invocation_id", "compile_seconds", "execute_seconds"
    )


@book.entry(
    "test_series",
    f"""WITH {T} SELECT detected_at, status, failures, severity FROM test_results
        WHERE test_name = 't42' AND {_since('detected_at', 30)} ORDER BY detected_at DESC LIMIT 100""",
)
def test_series(spark: SparkSession, sf: str) -> DataFrame:
    return h.test_series(facts.test_results(spark, sf), "t42", days=30, as_of=AS_OF).select(
        "detected_at", "status", "failures", "severity"
    )


@book.entry(
    "daily_trend",
    f"""WITH {R} SELECT date, node_runs, node_fails, build_seconds, test_runs, test_pass, invocations, {_RATES} FROM (
        SELECT CAST(CAST(CAST(generated_at AS TIMESTAMP) AS DATE) AS VARCHAR) AS date, {_NODE},
               count(DISTINCT invocation_id) AS invocations
        FROM run_results WHERE {_since('generated_at', 14)} GROUP BY 1)""",
)
def daily(spark: SparkSession, sf: str) -> DataFrame:
    return h.daily_trend(facts.run_results(spark, sf), days=14, as_of=AS_OF)


_TESTS = """count(*) AS runs, count(*) FILTER (WHERE status = 'pass') AS passes,
  count(*) FILTER (WHERE status = 'warn') AS warns, count(*) FILTER (WHERE status IN ('fail','error')) AS fails"""


@book.entry(
    "test_stats",
    f"""WITH {T} SELECT *, {_pct('passes', 'runs')} AS pass_rate FROM (
        SELECT test_unique_id, test_name, max(model_unique_id) AS model_unique_id, max(table_name) AS table_name,
               max('c' || CAST(event_id % 3 AS VARCHAR)) AS column_name,
               max(CASE event_id % 2 WHEN 0 THEN 'dbt_test' ELSE 'anomaly_detection' END) AS test_type,
               max(severity) AS severity, {_TESTS}, max(failures) AS max_failures,
               CAST(max(CAST(detected_at AS TIMESTAMP)) AS VARCHAR) AS last_run_at,
               CAST(max(CAST(detected_at AS TIMESTAMP)) FILTER (WHERE status IN ('fail','error','warn')) AS VARCHAR) AS last_issue_at
        FROM test_results WHERE {_since('detected_at', 30)} GROUP BY 1, 2
        ORDER BY fails DESC, warns DESC, runs DESC, test_unique_id LIMIT 200)""",
)
def test_stats(spark: SparkSession, sf: str) -> DataFrame:
    results = facts.test_results(spark, sf).withColumns({
        "column_name": F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")),
        "test_type": F.when(F.col("event_id") % 2 == 0, "dbt_test").otherwise("anomaly_detection"),
    })
    out = h.test_stats(results, days=30, as_of=AS_OF)
    return _text(out, "last_run_at", "last_issue_at")


@book.entry(
    "tests_daily",
    f"""WITH {T} SELECT *, {_pct('passes', 'runs')} AS pass_rate FROM (
        SELECT CAST(CAST(CAST(detected_at AS TIMESTAMP) AS DATE) AS VARCHAR) AS date, {_TESTS}
        FROM test_results WHERE {_since('detected_at', 14)} GROUP BY 1)""",
)
def tests_daily(spark: SparkSession, sf: str) -> DataFrame:
    return h.tests_daily(facts.test_results(spark, sf), days=14, as_of=AS_OF)


@book.entry(
    "recent_failures",
    f"""WITH {R} SELECT generated_at, name, unique_id, status, failures FROM run_results
        WHERE {_since('generated_at', 30)} AND status IN ('error','fail','warn','skipped')
        ORDER BY CAST(generated_at AS TIMESTAMP) DESC, unique_id LIMIT 200""",
)
def recent_failures(spark: SparkSession, sf: str) -> DataFrame:
    return h.recent_failures(facts.run_results(spark, sf), days=30, as_of=AS_OF, limit=200).select(
        "generated_at", "name", "unique_id", "status", "failures"
    )


@book.entry(
    "since_days",
    f"WITH {R} SELECT generated_at, unique_id, event_id FROM run_results WHERE {_since('generated_at', 3)}",
)
def since_days(spark: SparkSession, sf: str) -> DataFrame:
    return h.since_days(facts.run_results(spark, sf), "generated_at", 3, AS_OF).select(
        "generated_at", "unique_id", "event_id"
    )


@book.entry(
    "elapsed_seconds",
    f"""WITH {I} SELECT invocation_id,
          round(date_diff('millisecond', CAST(run_started_at AS TIMESTAMP), CAST(run_completed_at AS TIMESTAMP)) / 1000.0 + 1e-9, 1) AS seconds,
          CASE WHEN command = 'build' THEN round(date_diff('millisecond', CAST(run_started_at AS TIMESTAMP), CAST(run_completed_at AS TIMESTAMP)) / 1000.0 + 1e-9, 3) END AS phase
        FROM invocations""",
)
def elapsed(spark: SparkSession, sf: str) -> DataFrame:
    start, end = times.as_time("run_started_at"), times.as_time("run_completed_at")
    return facts.invocations(spark, sf).select(
        "invocation_id", times.elapsed_seconds(start, end).alias("seconds"),
        times.elapsed_seconds(start, F.when(F.col("command") == "build", end), 3).alias("phase"),
    )


def _run_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.count_if(F.col("status").isin("error", "fail"))
    return facts.run_results(spark, sf).groupBy("invocation_id").agg(
        F.min("generated_at").alias("started_at"), F.max("generated_at").alias("ended_at"),
        F.when(bad > 20, "failed").otherwise("success").alias("state"),
    )


@book.entry(
    "run_trend",
    f"""WITH {R}, runs AS (SELECT invocation_id, max(generated_at) AS ended_at,
          CASE WHEN count(*) FILTER (WHERE status IN ('error','fail')) > 20 THEN 'failed' ELSE 'success' END AS state
          FROM run_results GROUP BY 1)
        SELECT CAST(CAST(CAST(ended_at AS TIMESTAMP) AS DATE) AS VARCHAR) AS date,
               count(*) FILTER (WHERE state = 'success') AS ok, count(*) FILTER (WHERE state <> 'success') AS err
        FROM runs GROUP BY 1 ORDER BY 1 DESC LIMIT 7""",
)
def run_trend(spark: SparkSession, sf: str) -> DataFrame:
    return h.run_trend(_run_outcomes(spark, sf), days=7)


@book.entry(
    "top_n_with_other",
    """WITH t AS (SELECT CAST(o_custkey AS VARCHAR) AS custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1),
       top AS (SELECT custkey, total, 1 AS members FROM t ORDER BY total DESC, custkey LIMIT 5),
       al AS (SELECT * FROM top UNION ALL
              SELECT 'other', (SELECT sum(total) FROM t) - (SELECT sum(total) FROM top),
                     (SELECT count(*) FROM t) - 5)
       SELECT custkey, round(total, 2) AS total, members, round(total / (SELECT sum(total) FROM t) * 100 + 1e-9, 0) AS pct FROM al""",
)
def top_n(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("custkey"), "o_totalprice")
    return h.top_n_with_other(orders, "custkey", "o_totalprice").withColumn("total", F.round("total", 2))


@book.entry(
    "spike_vs_median",
    f"""WITH {R}, l AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CAST(generated_at AS TIMESTAMP) DESC, event_id DESC) AS rn
          FROM run_results WHERE {_BUILD}), g AS (
        SELECT name, count(*) AS runs, min(execution_time) FILTER (WHERE rn = 1) AS last_value,
               list_sort(list(execution_time))[count(*) // 2 + 1] AS median_value, max(execution_time) AS max_value
        FROM l WHERE rn <= 10 GROUP BY 1)
        SELECT *, median_value <> 0 AND last_value > median_value * 1.5 AS spike FROM g""",
)
def spike(spark: SparkSession, sf: str) -> DataFrame:
    return h.spike_vs_median(facts.run_results(spark, sf), tie="event_id")


@book.entry(
    "spike_in_rows",
    f"""WITH {R}, l AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY CAST(generated_at AS TIMESTAMP) DESC, event_id DESC) AS rn
          FROM run_results WHERE {_BUILD}), g AS (
        SELECT name, count(*) AS runs, min(CAST(coalesce(rows_affected, 0) AS DOUBLE)) FILTER (WHERE rn = 1) AS last_value,
               list_sort(list(CAST(coalesce(rows_affected, 0) AS DOUBLE)))[count(*) // 2 + 1] AS median_value, max(CAST(coalesce(rows_affected, 0) AS DOUBLE)) AS max_value
        FROM l WHERE rn <= 10 GROUP BY 1)
        SELECT *, median_value <> 0 AND last_value > median_value * 1.5 AS spike FROM g""",
)
def spike_rows(spark: SparkSession, sf: str) -> DataFrame:
    return h.spike_vs_median(facts.run_results(spark, sf), tie="event_id", value="rows_affected")
