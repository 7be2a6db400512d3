"""Fact tables the platform operators need, derived from the supplied tables.

Each derivation exists twice with the same meaning: as a DataFrame and as SQL text for the oracle.
Sizes follow the supplied tables; no rows are made up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over the cores before work that is heavy per row: a table of one row group is else read by one task."""
    spark = df.sparkSession
    n = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n)


# ---------------------------------------------------------------- run history (from events)

RUN_RESULTS_SQL = """
run_results AS (
  SELECT strftime(ts, '%Y-%m-%d') || '-' || CAST(user_id % 5 AS VARCHAR) AS invocation_id,
         CASE WHEN event_type IN ('signup','purchase') THEN 'test.shop.t' ELSE 'model.shop.m' END
           || CAST(user_id AS VARCHAR) AS unique_id,
         CASE WHEN event_type IN ('signup','purchase') THEN 't' ELSE 'm' END
           || CAST(user_id AS VARCHAR) AS name,
         CASE event_type WHEN 'view' THEN 'seed' WHEN 'signup' THEN 'test'
              WHEN 'purchase' THEN 'test' ELSE 'model' END AS resource_type,
         CASE WHEN event_type = 'error' THEN 'error'
              WHEN event_type = 'purchase' AND value > 200 THEN 'fail'
              WHEN event_type = 'purchase' AND value > 100 THEN 'warn'
              WHEN event_type IN ('purchase','signup') THEN 'pass' ELSE 'success' END AS status,
         value AS execution_time,
         CASE WHEN event_type = 'purchase' AND value > 100 THEN CAST(floor(value) AS BIGINT)
              WHEN event_type IN ('purchase','signup') THEN 0 END AS failures,
         CASE WHEN event_type IN ('click','view') THEN event_id % 1000 END AS rows_affected,
         CASE WHEN event_type = 'view' THEN 'seed' ELSE 'table' END AS materialization,
         CAST(ts AS VARCHAR) AS generated_at,
         CAST(ts AS VARCHAR) AS compile_started_at,
         CAST(ts + INTERVAL 250 MILLISECOND AS VARCHAR) AS compile_completed_at,
         CAST(ts + INTERVAL 250 MILLISECOND AS VARCHAR) AS execute_started_at,
         CASE WHEN event_id % 7 > 0 THEN CAST(ts + to_milliseconds(250 + event_id % 5000) AS VARCHAR) END AS execute_completed_at,
         event_id
  FROM events)"""


def run_results(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    is_test = F.col("event_type").isin("signup", "purchase")
    buy = F.col("event_type") == "purchase"
    uid = F.col("user_id").cast("string")
    return e.select(
        F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("-"), (F.col("user_id") % 5).cast("string"))
        .alias("invocation_id"),
        F.concat(F.when(is_test, "test.shop.t").otherwise("model.shop.m"), uid).alias("unique_id"),
        F.concat(F.when(is_test, "t").otherwise("m"), uid).alias("name"),
        F.when(F.col("event_type") == "view", "seed").when(is_test, "test").otherwise("model")
        .alias("resource_type"),
        F.when(F.col("event_type") == "error", "error")
        .when(buy & (F.col("value") > 200), "fail")
        .when(buy & (F.col("value") > 100), "warn")
        .when(is_test, "pass").otherwise("success").alias("status"),
        F.col("value").alias("execution_time"),
        F.when(buy & (F.col("value") > 100), F.floor("value")).when(is_test, F.lit(0))
        .cast("long").alias("failures"),
        F.when(F.col("event_type").isin("click", "view"), F.col("event_id") % 1000)
        .alias("rows_affected"),
        F.when(F.col("event_type") == "view", "seed").otherwise("table").alias("materialization"),
        F.col("ts").cast("string").alias("generated_at"),
        F.col("ts").cast("string").alias("compile_started_at"),
        (F.col("ts") + F.expr("INTERVAL '0.250' SECOND")).cast("string").alias("compile_completed_at"),
        (F.col("ts") + F.expr("INTERVAL '0.250' SECOND")).cast("string").alias("execute_started_at"),
        F.when(F.col("event_id") % 7 > 0, F.col("ts") + F.expr("make_dt_interval(0, 0, 0, (250 + event_id % 5000) / CAST(1000 AS DECIMAL(8, 3)))"))
        .cast("string").alias("execute_completed_at"),
        "event_id",
    )


INVOCATIONS_SQL = (
    RUN_RESULTS_SQL
    + """,
invocations AS (
  SELECT invocation_id,
         CASE WHEN substr(invocation_id, 12) IN ('0','1') THEN 'build'
              WHEN substr(invocation_id, 12) = '2' THEN 'run' ELSE 'test' END AS command,
         min(generated_at) AS run_started_at, max(generated_at) AS run_completed_at
  FROM run_results GROUP BY invocation_id)"""
)


def invocations(spark: SparkSession, sf: str) -> DataFrame:
    slot = F.substring("invocation_id", 12, 10)
    return (
        run_results(spark, sf).groupBy("invocation_id")
        .agg(F.min("generated_at").alias("run_started_at"), F.max("generated_at").alias("run_completed_at"))
        .select(
            "invocation_id",
            F.when(slot.isin("0", "1"), "build").when(slot == "2", "run").otherwise("test")
            .alias("command"),
            "run_started_at", "run_completed_at",
        )
    )


TEST_RESULTS_SQL = """
test_results AS (
  SELECT 'test.shop.t' || CAST(user_id AS VARCHAR) AS test_unique_id,
         't' || CAST(user_id AS VARCHAR) AS test_name,
         'model.shop.m' || CAST(user_id AS VARCHAR) AS model_unique_id,
         'orders_' || CAST(user_id % 7 AS VARCHAR) AS table_name,
         'error' AS severity, event_id,
         CASE WHEN event_type = 'purchase' AND value > 200 THEN 'fail'
              WHEN event_type = 'purchase' AND value > 100 THEN 'warn' ELSE 'pass' END AS status,
         CASE WHEN event_type = 'purchase' AND value > 100 THEN CAST(floor(value) AS BIGINT)
              ELSE 0 END AS failures,
         CAST(ts AS VARCHAR) AS detected_at
  FROM events WHERE event_type IN ('signup','purchase'))"""


def test_results(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter(F.col("event_type").isin("signup", "purchase"))
    buy = F.col("event_type") == "purchase"
    uid = F.col("user_id").cast("string")
    return e.select(
        F.concat(F.lit("test.shop.t"), uid).alias("test_unique_id"),
        F.concat(F.lit("t"), uid).alias("test_name"),
        F.concat(F.lit("model.shop.m"), uid).alias("model_unique_id"),
        F.concat(F.lit("orders_"), (F.col("user_id") % 7).cast("string")).alias("table_name"),
        F.lit("error").alias("severity"),
        "event_id",
        F.when(buy & (F.col("value") > 200), "fail").when(buy & (F.col("value") > 100), "warn")
        .otherwise("pass").alias("status"),
        F.when(buy & (F.col("value") > 100), F.floor("value")).otherwise(F.lit(0)).cast("long")
        .alias("failures"),
        F.col("ts").cast("string").alias("detected_at"),
    )


RULE_RESULTS_SQL = (
    TEST_RESULTS_SQL
    + """,
rule_results AS (
  SELECT test_unique_id AS rule_uid,
         'el:' || CAST(CAST(floor(epoch(CAST(detected_at AS TIMESTAMP))) AS BIGINT) AS VARCHAR) AS run_id,
         CASE status WHEN 'pass' THEN 'ok' WHEN 'warn' THEN 'warn' ELSE 'err' END AS status,
         failures, epoch(CAST(detected_at AS TIMESTAMP)) AS ran_at
  FROM test_results)"""
)


def rule_results(spark: SparkSession, sf: str) -> DataFrame:
    """History rows as the platform stores them: epoch seconds, ok/warn/err."""
    from millrace.operators.quality import history_from_tests

    return history_from_tests(test_results(spark, sf), as_of=AS_OF, days=365)


# ---------------------------------------------------------------- rules and models (from customer)

RULES_SQL = """
rules AS (
  SELECT 't' || CAST(c_custkey AS VARCHAR) AS name,
         'test.shop.t' || CAST(c_custkey AS VARCHAR) AS uid,
         CASE c_nationkey % 7 WHEN 0 THEN 'not_null' WHEN 1 THEN 'unique'
              WHEN 2 THEN 'dbt_utils.unique_combination_of_columns' WHEN 3 THEN 'accepted_values'
              WHEN 4 THEN 'relationships' WHEN 5 THEN 'dbt_utils.accepted_range'
              ELSE 'expression_is_true' END AS check_name,
         CASE WHEN c_nationkey % 7 = 6 THEN '' ELSE 'col_' || lower(c_mktsegment) END AS col,
         CASE WHEN c_acctbal < 3000 THEN 'warn' ELSE 'error' END AS severity,
         CASE WHEN c_nationkey % 7 = 5 THEN ' (min_value=0 · max_value=' || CAST(c_nationkey AS VARCHAR) || ')'
              WHEN c_nationkey % 7 = 3 THEN ' (values=A, B, ' || c_mktsegment || ')' ELSE '' END AS args_text,
         c_custkey % 11 <> 3 AS enabled, c_custkey % 50 = 7 AS singular,
         'm' || CAST(c_custkey // 4 AS VARCHAR) AS first_model
  FROM customer),
rule_targets AS (
  SELECT *, first_model AS model_id FROM rules
  UNION ALL
  SELECT *, 'm' || CAST(CAST(substr(name, 2) AS BIGINT) // 4 + 1 AS VARCHAR) FROM rules WHERE singular)"""


def rules(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    kind = F.col("c_nationkey") % 7
    check = F.lit("expression_is_true")
    for i, n in enumerate(["not_null", "unique", "dbt_utils.unique_combination_of_columns",
                           "accepted_values", "relationships", "dbt_utils.accepted_range"]):
        check = F.when(kind == i, n).otherwise(check)
    args = F.when(
        kind == 5,
        F.create_map(
            F.lit("min_value"), F.array(F.lit("0")),
            F.lit("max_value"), F.array(F.col("c_nationkey").cast("string")),
        ),
    ).when(kind == 3, F.create_map(F.lit("values"), F.array(F.lit("A"), F.lit("B"), F.col("c_mktsegment"))))
    block = F.floor(F.col("c_custkey") / 4)
    home = F.concat(F.lit("m"), block.cast("string"))
    beside = F.concat(F.lit("m"), (block + 1).cast("string"))
    return c.select(
        F.concat(F.lit("t"), F.col("c_custkey").cast("string")).alias("name"),
        F.concat(F.lit("test.shop.t"), F.col("c_custkey").cast("string")).alias("uid"),
        check.alias("check_name"),
        F.when(kind == 6, "").otherwise(F.concat(F.lit("col_"), F.lower("c_mktsegment"))).alias("col"),
        F.when(F.col("c_acctbal") < 3000, "warn").otherwise("error").alias("severity"),
        args.alias("args"),
        (F.col("c_custkey") % 11 != 3).alias("enabled"),
        (F.col("c_custkey") % 50 == 7).alias("singular"),
        F.when(F.col("c_custkey") % 50 == 7, F.array(home, beside)).otherwise(F.array(home)).alias("targets"),
    )


STATE_SQL = (
    RULES_SQL + "," + RULE_RESULTS_SQL
    + f""",
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_uid ORDER BY ran_at DESC, run_id DESC) AS rn
                 FROM rule_results) WHERE rn = 1),
run_now AS (
  SELECT test_unique_id AS uid, status, failures FROM (
    SELECT *, row_number() OVER (PARTITION BY test_unique_id ORDER BY detected_at DESC, event_id DESC) AS rn
    FROM test_results WHERE detected_at >= '2024-01-30') WHERE rn = 1),
state AS (
  SELECT r.name AS rule_id, r.uid,
         CASE check_name WHEN 'not_null' THEN 'notnull' WHEN 'unique' THEN 'unique'
              WHEN 'dbt_utils.unique_combination_of_columns' THEN 'unique'
              WHEN 'accepted_values' THEN 'accepted' WHEN 'relationships' THEN 'rel'
              WHEN 'dbt_utils.accepted_range' THEN 'range' ELSE 'sql' END AS type,
         CASE check_name WHEN 'not_null' THEN 'completeness' WHEN 'unique' THEN 'uniqueness'
              WHEN 'dbt_utils.unique_combination_of_columns' THEN 'uniqueness'
              WHEN 'accepted_values' THEN 'validity' WHEN 'relationships' THEN 'consistency'
              WHEN 'dbt_utils.accepted_range' THEN 'accuracy' ELSE 'custom' END AS dimension,
         r.model_id, r.col, r.check_name || r.args_text AS cond, r.severity AS sev,
         r.enabled AS active, r.singular,
         CASE WHEN NOT r.enabled THEN 'unknown'
              WHEN n.uid IS NOT NULL THEN CASE n.status WHEN 'pass' THEN 'ok' WHEN 'warn' THEN 'warn' ELSE 'err' END
              ELSE coalesce(h.status, 'unknown') END AS status,
         CASE WHEN NOT r.enabled THEN 0
              ELSE coalesce(CASE WHEN n.uid IS NOT NULL THEN n.failures ELSE h.failures END, 0) END AS cnt,
         CASE WHEN n.uid IS NULL THEN h.ran_at END AS measured_at
  FROM rule_targets r LEFT JOIN run_now n ON n.uid = r.uid LEFT JOIN latest h ON h.rule_uid = r.uid)"""
)


def current_run(spark: SparkSession, sf: str) -> DataFrame:
    """Raw results of the last day's run, newest per test."""
    day = test_results(spark, sf).filter(F.col("detected_at") >= "2024-01-30")
    newest = F.max(F.struct("detected_at", "event_id", "status", "failures")).alias("_r")
    return day.groupBy(F.col("test_unique_id").alias("uid")).agg(newest).select(
        "uid", "_r.status", "_r.failures"
    )


def rule_state(spark: SparkSession, sf: str) -> DataFrame:
    from millrace.operators.quality import rules_state

    return rules_state(rules(spark, sf), current_run(spark, sf), rule_results(spark, sf))


# ---------------------------------------------------------------- model graph (supply chain)
# supplier → part → order → customer → nation → region: a layered graph that grows with the data.

GRAPH_SQL = """
edges AS (
  SELECT DISTINCT 's' || CAST(l_suppkey AS VARCHAR) AS src, 'p' || CAST(l_partkey AS VARCHAR) AS dst FROM lineitem
  UNION ALL SELECT DISTINCT 'p' || CAST(l_partkey AS VARCHAR), 'o' || CAST(l_orderkey AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'o' || CAST(o_orderkey AS VARCHAR), 'c' || CAST(o_custkey AS VARCHAR) FROM orders
  UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR) FROM customer
  UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR) FROM nation),
models AS (
  SELECT 's' || CAST(s_suppkey AS VARCHAR) AS id, 'source' AS dbt_type FROM supplier
  UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), CASE WHEN p_size > 40 THEN 'seed' ELSE 'model' END FROM part
  UNION ALL SELECT 'o' || CAST(o_orderkey AS VARCHAR), 'model' FROM orders
  UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'model' FROM customer
  UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'model' FROM nation
  UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR), 'model' FROM region)"""


def _key(prefix: str, col: str) -> Column:
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def edge_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The edges as a plan, for what writes them itself. Keys are made unique before they become texts."""
    li = table(spark, sf, "lineitem")
    parts = [
        li.select(a, b).distinct().select(_key(x, a).alias("src"), _key(y, b).alias("dst"))
        for x, a, y, b in (("s", "l_suppkey", "p", "l_partkey"), ("p", "l_partkey", "o", "l_orderkey"))
    ]
    for name, a, x, b, y in (
        ("orders", "o", "o_orderkey", "c", "o_custkey"),
        ("customer", "c", "c_custkey", "n", "c_nationkey"),
        ("nation", "n", "n_nationkey", "r", "n_regionkey"),
    ):
        parts.append(table(spark, sf, name).select(_key(a, x).alias("src"), _key(b, y).alias("dst")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def edges(spark: SparkSession, sf: str, by: str | None = None) -> DataFrame:
    from millrace.operators.lineage import stored

    return stored(edge_rows(spark, sf), by)


def models(spark: SparkSession, sf: str) -> DataFrame:
    kinds = [
        ("supplier", "s", "s_suppkey", F.lit("source")),
        ("part", "p", "p_partkey", F.when(F.col("p_size") > 40, "seed").otherwise("model")),
        ("orders", "o", "o_orderkey", F.lit("model")), ("customer", "c", "c_custkey", F.lit("model")),
        ("nation", "n", "n_nationkey", F.lit("model")), ("region", "r", "r_regionkey", F.lit("model")),
    ]
    out = None
    for name, prefix, col, kind in kinds:
        part = table(spark, sf, name).select(_key(prefix, col).alias("id"), kind.alias("dbt_type"))
        out = part if out is None else out.unionAll(part)
    return out


FLOWS_SQL = """
flows AS (
  SELECT 'f' || CAST(c_custkey AS VARCHAR) AS id, CAST(c_custkey * 37 % 1009 AS DOUBLE) AS created_at,
         c_custkey % 2 = 0 AS include_seeds,
         CASE WHEN c_custkey % 3 = 0 THEN 'schedule' ELSE 'upstream' END AS trigger_type,
         'f' || CAST(CASE WHEN c_custkey % 10 = 1 THEN c_custkey + 1 WHEN c_custkey % 10 = 2 THEN c_custkey - 1
                          ELSE c_custkey // 2 END AS VARCHAR) AS upstream_id
  FROM customer),
flow_targets AS (
  SELECT 'f' || CAST(c_custkey AS VARCHAR) AS flow, 'c' || CAST(c_custkey AS VARCHAR) AS id FROM customer
  UNION ALL SELECT 'f' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR) FROM customer
    WHERE c_acctbal > 9500)"""


def flows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    up = F.when(k % 10 == 1, k + 1).when(k % 10 == 2, k - 1).otherwise(F.floor(k / 2))
    return table(spark, sf, "customer").select(
        _key("f", "c_custkey").alias("id"), (k * 37 % 1009).cast("double").alias("created_at"),
        (k % 2 == 0).alias("include_seeds"),
        F.when(k % 3 == 0, "schedule").otherwise("upstream").alias("trigger_type"),
        F.concat(F.lit("f"), up.cast("long").cast("string")).alias("upstream_id"),
    )


def flow_targets(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    flow = _key("f", "c_custkey").alias("flow")
    return c.select(flow, _key("c", "c_custkey").alias("id")).unionAll(
        c.filter("c_acctbal > 9500").select(flow, _key("n", "c_nationkey").alias("id"))
    )


COLUMN_EDGES_SQL = """
raw_column_edges AS (
  SELECT 's' || CAST(l_suppkey AS VARCHAR) AS from_id, lower(l_returnflag) AS from_col,
         'p' || CAST(l_partkey AS VARCHAR) AS to_id, lower(l_linestatus) AS to_col,
         CASE WHEN l_tax > 0.04 THEN 'transform' ELSE 'copy' END AS kind,
         l_orderkey * 100000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS pos FROM lineitem
  UNION ALL
  SELECT 'p' || CAST(l_partkey AS VARCHAR), CASE WHEN l_quantity > 45 THEN '*' ELSE lower(l_linestatus) END,
         'o' || CAST(l_orderkey AS VARCHAR), 'total', CASE WHEN l_discount > 0.05 THEN 'transform' ELSE 'copy' END,
         l_orderkey * 100000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber FROM lineitem),
column_edges AS (
  SELECT from_id, from_col, to_id, to_col, kind, pos FROM (
    SELECT *, row_number() OVER (PARTITION BY from_id, from_col, to_id, to_col ORDER BY pos, kind) AS rn
    FROM raw_column_edges) WHERE rn = 1)"""


def raw_column_edges(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    pos = (
        F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey") * 10
        + F.col("l_linenumber")
    ).alias("pos")
    first = li.select(
        _key("s", "l_suppkey").alias("from_id"), F.lower("l_returnflag").alias("from_col"),
        _key("p", "l_partkey").alias("to_id"), F.lower("l_linestatus").alias("to_col"),
        F.when(F.col("l_tax") > 0.04, "transform").otherwise("copy").alias("kind"), pos,
    )
    second = li.select(
        _key("p", "l_partkey").alias("from_id"),
        F.when(F.col("l_quantity") > 45, "*").otherwise(F.lower("l_linestatus")).alias("from_col"),
        _key("o", "l_orderkey").alias("to_id"), F.lit("total").alias("to_col"),
        F.when(F.col("l_discount") > 0.05, "transform").otherwise("copy").alias("kind"), pos,
    )
    return first.unionAll(second)


def column_edges(spark: SparkSession, sf: str) -> DataFrame:
    from millrace.operators.lineage import distinct_edges, stored

    keys = ["from_id", "from_col", "to_id", "to_col"]
    return stored(distinct_edges(raw_column_edges(spark, sf), keys, "pos"))


LOADS_SQL = """
load_times AS (
  SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS id, o_orderdate AS loaded_at FROM orders
  UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR),
         CASE WHEN c_custkey % 9 > 0 THEN TIMESTAMP '1998-01-01' + INTERVAL 1 DAY * CAST(c_nationkey * 50 AS INTEGER) END FROM customer
  UNION ALL SELECT 'p' || CAST(p_partkey AS VARCHAR), TIMESTAMP '1997-01-01' + INTERVAL 1 DAY * (p_size * 30) FROM part)"""


def load_times(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(_key("o", "o_orderkey").alias("id"), F.col("o_orderdate").alias("loaded_at"))
    c = table(spark, sf, "customer").select(
        _key("c", "c_custkey").alias("id"),
        F.when(
            F.col("c_custkey") % 9 > 0,
            F.expr("TIMESTAMP_NTZ '1998-01-01 00:00:00' + make_dt_interval(c_nationkey * 50)"),
        ).alias("loaded_at"),
    )
    p = table(spark, sf, "part").select(
        _key("p", "p_partkey").alias("id"),
        F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00' + make_dt_interval(p_size * 30)").alias("loaded_at"),
    )
    return o.unionAll(c).unionAll(p)


USAGE_SQL = """
datasets AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_mktsegment = 'BUILDING'
             UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR) FROM region),
marts AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_acctbal > 8000
          UNION ALL SELECT 'r' || CAST(r_regionkey AS VARCHAR) FROM region WHERE r_regionkey < 2),
usage AS (SELECT 'c' || CAST(user_id AS VARCHAR) AS id, 'chart-' || CAST(event_id AS VARCHAR) AS analysis
          FROM events WHERE event_type = 'view')"""


def datasets(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(_key("c", "c_custkey").alias("id"))
    return c.unionAll(table(spark, sf, "region").select(_key("r", "r_regionkey").alias("id")))


def marts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").filter("c_acctbal > 8000").select(_key("c", "c_custkey").alias("id"))
    r = table(spark, sf, "region").filter("r_regionkey < 2").select(_key("r", "r_regionkey").alias("id"))
    return c.unionAll(r)


def usage(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter("event_type = 'view'").select(
        _key("c", "user_id").alias("id"), _key("chart-", "event_id").alias("analysis")
    )
