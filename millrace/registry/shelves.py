"""Catalog and storage views over the model graph and object listings derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import texts
from millrace.operators import catalog as cat
from millrace.operators import storage as sto
from millrace.registry import facts
from millrace.registry.book import book
from millrace.registry.facts import table

G, U, FL, ST = facts.GRAPH_SQL, facts.USAGE_SQL, facts.FLOWS_SQL, facts.STATE_SQL

# ---------------------------------------------------------------- catalog

_CATALOG_SQL = """shelf AS (SELECT id, 'model ' || id AS name, CASE WHEN dbt_type = 'source' THEN 'raw.' ELSE 'analytics.' END || id AS phys,
    dbt_type, 'about ' || dbt_type AS "desc", CASE WHEN id LIKE 'o%' THEN 'models/staging/' || id ELSE 'models/' || id END AS path FROM models),
  folders AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS model_id, c_mktsegment AS folder_id FROM customer)"""


def _shelf(spark: SparkSession, sf: str) -> DataFrame:
    return facts.models(spark, sf).select(
        "id", F.concat(F.lit("model "), "id").alias("name"),
        F.concat(F.when(F.col("dbt_type") == "source", "raw.").otherwise("analytics."), "id").alias("phys"),
        "dbt_type", F.concat(F.lit("about "), "dbt_type").alias("desc"),
        F.concat(F.when(F.col("id").startswith("o"), "models/staging/").otherwise("models/"), "id").alias("path"),
    )


def _folders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("model_id"), F.col("c_mktsegment").alias("folder_id")
    )


def _state_on_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Rule states hung on the customer models of the graph."""
    return facts.rule_state(spark, sf).withColumn("model_id", F.regexp_replace("model_id", "^m", "c"))


_VIEW_SQL = f"""{G}, {U}, {ST}, {_CATALOG_SQL},
  qs AS (SELECT replace(model_id, 'm', 'c') AS q, CASE WHEN count(*) FILTER (WHERE active AND status = 'err') > 0 THEN 'err'
           WHEN count(*) FILTER (WHERE active AND status = 'warn') > 0 THEN 'warn' ELSE 'ok' END AS qstat, count(*) AS n FROM state GROUP BY 1),
  up AS (SELECT dst, count(*) AS n FROM edges GROUP BY 1), dn AS (SELECT src, count(*) AS n FROM edges GROUP BY 1),
  view AS (SELECT s.id, s.name, s.phys, CASE WHEN m.id IS NOT NULL THEN 'DATA MART' WHEN dbt_type = 'model' THEN 'DATA MODEL' ELSE 'SOURCE' END AS "group",
      m.id IS NOT NULL AS is_mart, CASE WHEN dbt_type <> 'model' THEN 'raw' WHEN m.id IS NOT NULL THEN 'mart' WHEN path LIKE '%/staging/%' THEN 'staged' ELSE 'analysis' END AS layer,
      f.folder_id, coalesce(q.qstat, 'ok') AS quality_status, coalesce(q.n, 0) AS test_count, coalesce(up.n, 0) AS upstream_count, coalesce(dn.n, 0) AS downstream_count
    FROM shelf s LEFT JOIN marts m ON m.id = s.id LEFT JOIN folders f ON f.model_id = s.id LEFT JOIN qs q ON q.q = s.id
    LEFT JOIN up ON up.dst = s.id LEFT JOIN dn ON dn.src = s.id)"""


def _view(spark: SparkSession, sf: str, search: str | None = None) -> DataFrame:
    return cat.catalog_view(
        _shelf(spark, sf), facts.edges(spark, sf), facts.marts(spark, sf), _folders(spark, sf),
        _state_on_customers(spark, sf), search=search,
    )


@book.entry("catalog_view", f"WITH {_VIEW_SQL} SELECT * FROM view")
def catalog_view(spark: SparkSession, sf: str) -> DataFrame:
    return cat.ordered_catalog(_view(spark, sf))


@book.entry("catalog_search", f"WITH {_VIEW_SQL} SELECT id, layer FROM view WHERE contains(name || ' ' || phys, 'c14')")
def catalog_search(spark: SparkSession, sf: str) -> DataFrame:
    return _view(spark, sf, "C14").select("id", "layer")


@book.entry(
    "classify_layer",
    """SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'raw' WHEN s_acctbal > 7000 THEN 'mart' WHEN s_nationkey < 12 THEN 'staged' ELSE 'analysis' END AS layer,
              count(*) AS n FROM supplier GROUP BY 1""",
)
def classify_layer(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("s_suppkey") % 4 == 0, "source").otherwise("model")
    path = F.when(F.col("s_nationkey") < 12, "models/staging/x.sql")
    return table(spark, sf, "supplier").groupBy(
        cat.classify_layer(kind, F.col("s_acctbal") > 7000, path).alias("layer")
    ).agg(F.count(F.lit(1)).alias("n"))


@book.entry(
    "ordered_by_next_run",
    "SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS VARCHAR) END AS next_run FROM orders",
)
def by_next_run(spark: SparkSession, sf: str) -> DataFrame:
    flows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("string")).alias("next_run")
    )
    return cat.by_next_run(flows)


@book.entry(
    "usage_counts",
    """SELECT c_custkey, coalesce(n, 0) AS items FROM customer LEFT JOIN
       (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) ON user_id = c_custkey""",
)
def usage_counts(spark: SparkSession, sf: str) -> DataFrame:
    views = table(spark, sf, "events").filter("event_type = 'view'")
    return cat.usage_counts(views, "user_id", table(spark, sf, "customer").select("c_custkey"), "c_custkey")


_VOLUME_SQL = """vol AS (SELECT CASE WHEN p_size < 5 THEN 'raw' ELSE p_type END AS "schema", p_brand AS "group",
    CASE WHEN p_partkey % 9 > 0 THEN CAST(floor(p_retailprice) AS BIGINT) END AS rows FROM part)"""


@book.entry(
    "volume_rollup",
    f"""WITH {_VOLUME_SQL}, u AS (SELECT 'schema' AS axis, "schema" AS key, rows FROM vol UNION ALL SELECT 'group', "group", rows FROM vol
          UNION ALL SELECT 'total', 'all', rows FROM vol)
        SELECT axis, key, count(*) AS tables, CAST(coalesce(sum(rows), 0) AS BIGINT) AS rows, count(*) FILTER (WHERE rows IS NULL) AS unknown FROM u GROUP BY 1, 2""",
)
def volume_rollup(spark: SparkSession, sf: str) -> DataFrame:
    vol = table(spark, sf, "part").select(
        F.when(F.col("p_size") < 5, "raw").otherwise(F.col("p_type")).alias("schema"), F.col("p_brand").alias("group"),
        F.when(F.col("p_partkey") % 9 > 0, F.floor("p_retailprice")).alias("rows"),
    )
    return cat.volume_rollup(vol)


@book.entry("semi_catalog", f"WITH {G}, {U} SELECT id FROM marts WHERE id IN (SELECT id FROM models WHERE dbt_type = 'model')")
def semi_catalog(spark: SparkSession, sf: str) -> DataFrame:
    return cat.semi_catalog(facts.marts(spark, sf), "id", facts.models(spark, sf).filter("dbt_type = 'model'"))


@book.entry(
    "anti_catalog",
    """WITH m AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 3 > 0),
       d AS (SELECT DISTINCT 'c' || CAST(o_custkey AS VARCHAR) AS id FROM orders WHERE o_orderpriority = '1-URGENT')
       SELECT id, 'gone' AS gap FROM d WHERE id NOT IN (SELECT id FROM m) UNION ALL SELECT id, 'unmapped' FROM m WHERE id NOT IN (SELECT id FROM d)""",
)
def anti_catalog(spark: SparkSession, sf: str) -> DataFrame:
    name = lambda col: F.concat(F.lit("c"), F.col(col).cast("string")).alias("id")
    models = table(spark, sf, "customer").filter("c_custkey % 3 > 0").select(name("c_custkey"))
    mapped = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(name("o_custkey"))
    return cat.anti_catalog(mapped, models)


_ASSETS_SQL = """assets AS (SELECT l_orderkey AS asset, l_linenumber AS pos, l_partkey AS dataset_id FROM lineitem),
  mapping AS (SELECT p_partkey AS dataset_id, p_brand AS id FROM part WHERE p_size > 10)"""


def _assets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    assets = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("asset"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("dataset_id")
    )
    mapping = table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("dataset_id"), F.col("p_brand").alias("id"))
    return cat.asset_models(assets, mapping)


@book.entry("asset_models", f"WITH {_ASSETS_SQL} SELECT asset, id, min(pos) AS pos FROM assets JOIN mapping USING (dataset_id) GROUP BY 1, 2")
def asset_models(spark: SparkSession, sf: str) -> DataFrame:
    return _assets(spark, sf)[0]


@book.entry(
    "asset_unmapped",
    f"WITH {_ASSETS_SQL} SELECT asset, count(*) FILTER (WHERE id IS NULL) AS unmapped, count(DISTINCT id) AS models FROM assets LEFT JOIN mapping USING (dataset_id) GROUP BY 1",
)
def asset_unmapped(spark: SparkSession, sf: str) -> DataFrame:
    return _assets(spark, sf)[1]


@book.entry(
    "source_consumers",
    """WITH j AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem), f AS (SELECT DISTINCT l_partkey AS p, l_linenumber AS ln FROM lineitem WHERE l_quantity > 48)
       SELECT 'j' || CAST(j.s AS VARCHAR) AS job, 'p' || CAST(j.p AS VARCHAR) AS model, 'f' || CAST(f.ln AS VARCHAR) AS flow FROM j LEFT JOIN f ON f.p = j.p""",
)
def source_consumers(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    jobs = table(spark, sf, "supplier").select(name("j", "s_suppkey").alias("id"), name("s", "s_suppkey").alias("target"))
    targets = li.filter("l_quantity > 48").select(name("f", "l_linenumber").alias("flow"), name("p", "l_partkey").alias("id"))
    edges = facts.edges(spark, sf).filter("src LIKE 's%'")
    return cat.source_consumers(jobs, edges, targets)


@book.entry(
    "model_flows",
    "SELECT DISTINCT 'f' || CAST(l_linenumber AS VARCHAR) AS flow FROM lineitem WHERE l_partkey = 7 AND l_returnflag <> 'R'",
)
def model_flows(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "lineitem").select(
        F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("flow"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id"), (F.col("l_returnflag") != "R").alias("executable"),
    )
    return cat.model_flows(nodes, "p7")


@book.entry(
    "node_runs",
    """WITH ord AS (SELECT DISTINCT 'f' || CAST(l_linenumber AS VARCHAR) AS flow, l_linenumber AS flow_pos, 'p' || CAST(l_partkey AS VARCHAR) AS id FROM lineitem),
       res AS (SELECT 'f' || CAST(l_linenumber AS VARCHAR) AS flow, 'p' || CAST(l_partkey AS VARCHAR) AS id, max(CASE l_returnflag WHEN 'A' THEN 'success' WHEN 'N' THEN 'error' ELSE 'pass' END) AS status,
                 max(l_tax) AS seconds, max(l_orderkey) AS rows FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 30 GROUP BY 1, 2),
       tsk AS (SELECT 'f' || CAST(l_linenumber AS VARCHAR) AS flow, 'p' || CAST(l_partkey AS VARCHAR) AS id, max(CASE WHEN l_discount > 0.05 THEN 'upstream_failed' ELSE 'queued' END) AS state, 2 AS try_number
               FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 30 GROUP BY 1, 2),
       fl AS (SELECT x.flow, t.id, count(*) AS n FROM (SELECT DISTINCT 'f' || CAST(l_linenumber AS VARCHAR) AS flow, l_suppkey AS uid FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.08) x
              JOIN (SELECT DISTINCT l_suppkey AS uid, 'p' || CAST(l_partkey AS VARCHAR) AS id FROM lineitem WHERE l_quantity > 40) t ON t.uid = x.uid GROUP BY 1, 2),
       j AS (SELECT o.id, o.flow_pos, o.flow, coalesce(fl.n, 0) AS failed_tests, seconds, rows, coalesce(try_number, 1) AS try_number,
               CASE WHEN res.status = 'error' THEN 'err' WHEN res.status IN ('success','pass') THEN CASE WHEN coalesce(fl.n, 0) > 0 THEN 'err' ELSE 'ok' END
                    WHEN tsk.state = 'upstream_failed' THEN 'skip' ELSE 'wait' END AS state
             FROM ord o LEFT JOIN res ON res.flow = o.flow AND res.id = o.id LEFT JOIN tsk ON tsk.flow = o.flow AND tsk.id = o.id LEFT JOIN fl ON fl.flow = o.flow AND fl.id = o.id)
       SELECT id, flow, state, failed_tests, seconds, rows, try_number FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY flow_pos) AS rn FROM j) WHERE rn = 1""",
)
def node_runs(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    flow = F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("flow")
    pid = F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("id")
    flag = F.col("l_returnflag")
    raw = F.when(flag == "A", "success").when(flag == "N", "error").otherwise("pass")
    return cat.node_runs(
        li.select(flow, F.col("l_linenumber").alias("flow_pos"), pid).distinct(),
        li.filter("l_linestatus = 'F' AND l_quantity > 30").groupBy(flow, pid).agg(
            F.max(raw).alias("status"), F.max("l_tax").alias("seconds"), F.max("l_orderkey").alias("rows")),
        li.filter("l_linestatus = 'O' AND l_quantity > 30").groupBy(flow, pid).agg(
            F.max(F.when(F.col("l_discount") > 0.05, "upstream_failed").otherwise("queued")).alias("state"), F.lit(2).alias("try_number")),
        li.filter("l_quantity = 50 AND l_discount > 0.08").select(flow, F.col("l_suppkey").alias("uid"), F.lit("fail").alias("status")),
        li.filter("l_quantity > 40").select(F.col("l_suppkey").alias("uid"), pid).distinct(),
    )


# ---------------------------------------------------------------- storage

_OBJECTS_SQL = """objects AS (SELECT CASE o_orderkey % 8
      WHEN 0 THEN 'analytics/t' || CAST(o_custkey AS VARCHAR) || '/data/' || CAST(o_orderkey AS VARCHAR) || '.parquet'
      WHEN 1 THEN 'analytics/t' || CAST(o_custkey AS VARCHAR) || '/metadata/v' || CAST(o_orderkey AS VARCHAR) || '.json'
      WHEN 2 THEN 'ducklake/analytics/t' || CAST(o_custkey AS VARCHAR) || '__dbt_tmp/' || CAST(o_orderkey AS VARCHAR) || '.parquet'
      WHEN 3 THEN 'analytics/t' || CAST(o_custkey AS VARCHAR) || '__tmp_1/data/x'
      WHEN 4 THEN 'watch/r' || CAST(o_custkey % 20 AS VARCHAR) || '/data/x' WHEN 5 THEN 'gone/t' || CAST(o_custkey AS VARCHAR) || '/data/x'
      WHEN 6 THEN 'top' || CAST(o_orderkey AS VARCHAR) || '.txt' ELSE 'ducklake/short/' || CAST(o_orderkey AS VARCHAR) END AS path,
      CAST(floor(o_totalprice) AS BIGINT) AS length FROM orders),
  known AS (SELECT 'analytics.t' || CAST(c_custkey AS VARCHAR) AS phys FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT 'gone.never' || CAST(s_suppkey AS VARCHAR) FROM supplier),
  live AS (SELECT 'analytics.t' || CAST(user_id AS VARCHAR) AS phys, CAST(floor(value * 1000) AS BIGINT) AS bytes FROM events),
  keyed AS (SELECT path, length, CASE WHEN p[1] = 'ducklake' THEN CASE WHEN len(p) >= 4 THEN p[2] END WHEN len(p) >= 3 THEN p[1] END AS "schema",
      CASE WHEN p[1] = 'ducklake' THEN CASE WHEN len(p) >= 4 THEN regexp_replace(p[3], '__dbt_tmp$', '') END WHEN len(p) >= 3 THEN p[2] END AS "table",
      CASE WHEN p[1] = 'ducklake' THEN CASE WHEN len(p) >= 4 THEN 'data' END WHEN len(p) >= 3 THEN p[3] END AS area FROM (SELECT *, string_split(path, '/') AS p FROM objects)),
  tb AS (SELECT "schema", "table", "schema" || '.' || "table" AS phys, CAST(sum(length) AS BIGINT) AS bytes, count(*) AS objects,
      CAST(coalesce(sum(length) FILTER (WHERE area = 'data'), 0) AS BIGINT) AS data_bytes, CAST(coalesce(sum(length) FILTER (WHERE area <> 'data'), 0) AS BIGINT) AS metadata_bytes
      FROM keyed WHERE "schema" IS NOT NULL GROUP BY 1, 2),
  store AS (SELECT coalesce(tb.phys, k.phys) AS phys, coalesce("schema", string_split(k.phys, '.')[1]) AS "schema", coalesce("table", string_split(k.phys, '.')[2]) AS "table",
      coalesce(tb.bytes, 0) AS bytes, coalesce(objects, 0) AS objects, coalesce(data_bytes, 0) AS data_bytes, coalesce(metadata_bytes, 0) AS metadata_bytes,
      CASE WHEN tb.bytes IS NOT NULL AND k.phys IS NOT NULL THEN l.lb END AS live_bytes,
      CASE WHEN tb.bytes IS NOT NULL AND k.phys IS NOT NULL AND l.lb IS NOT NULL THEN greatest(tb.bytes - l.lb, 0) END AS stale_bytes,
      CASE WHEN k.phys IS NOT NULL THEN 'catalog' WHEN contains("table", '__tmp_') THEN 'temp' WHEN "schema" = 'watch' THEN 'observability' ELSE 'orphan' END AS kind
      FROM tb FULL JOIN known k ON k.phys = tb.phys LEFT JOIN (SELECT phys, CAST(sum(bytes) AS BIGINT) AS lb FROM live GROUP BY 1) l ON l.phys = coalesce(tb.phys, k.phys))"""


def _objects(spark: SparkSession, sf: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    ks = k.cast("string")
    paths = [
        F.concat(F.lit("analytics/t"), c, F.lit("/data/"), ks, F.lit(".parquet")),
        F.concat(F.lit("analytics/t"), c, F.lit("/metadata/v"), ks, F.lit(".json")),
        F.concat(F.lit("ducklake/analytics/t"), c, F.lit("__dbt_tmp/"), ks, F.lit(".parquet")),
        F.concat(F.lit("analytics/t"), c, F.lit("__tmp_1/data/x")),
        F.concat(F.lit("watch/r"), (F.col("o_custkey") % 20).cast("string"), F.lit("/data/x")),
        F.concat(F.lit("gone/t"), c, F.lit("/data/x")),
        F.concat(F.lit("top"), ks, F.lit(".txt")),
        F.concat(F.lit("ducklake/short/"), ks),
    ]
    path = F.lit(None).cast("string")
    for i, p in enumerate(paths):
        path = F.when(k % 8 == i, p).otherwise(path)
    return table(spark, sf, "orders").select(path.alias("path"), F.floor("o_totalprice").alias("length"))


def _known(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").filter("c_custkey % 3 > 0").select(
        F.concat(F.lit("analytics.t"), F.col("c_custkey").cast("string")).alias("phys"))
    return c.unionAll(table(spark, sf, "supplier").select(F.concat(F.lit("gone.never"), F.col("s_suppkey").cast("string")).alias("phys")))


def _store(spark: SparkSession, sf: str) -> DataFrame:
    live = table(spark, sf, "events").select(
        F.concat(F.lit("analytics.t"), F.col("user_id").cast("string")).alias("phys"), F.floor(F.col("value") * 1000).alias("bytes"))
    return sto.stale_bytes(_objects(spark, sf), _known(spark, sf), live, observed=["watch"])


@book.entry("split_object_key", f'WITH {_OBJECTS_SQL} SELECT path, "schema", "table", area FROM keyed')
def split_key(spark: SparkSession, sf: str) -> DataFrame:
    k = texts.object_key(F.col("path"))
    return _objects(spark, sf).select(
        "path", k["schema"].alias("schema"), k["table"].alias("table"), k["area"].alias("area"))


@book.entry("stale_bytes", f"WITH {_OBJECTS_SQL} SELECT * FROM store")
def stale_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return _store(spark, sf)


@book.entry("classify_storage", f"WITH {_OBJECTS_SQL} SELECT phys, kind FROM store")
def classify_storage(spark: SparkSession, sf: str) -> DataFrame:
    return _store(spark, sf).select("phys", "kind")


@book.entry(
    "storage_by_kind",
    f"WITH {_OBJECTS_SQL} SELECT kind, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS tables, CAST(sum(objects) AS BIGINT) AS objects FROM store GROUP BY 1",
)
def storage_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    return sto.by_kind(_store(spark, sf))


_SCHEMAS_SQL = f"""{_OBJECTS_SQL}, schemas AS (SELECT "schema", CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(live_bytes) AS BIGINT) AS live_bytes, count(*) AS tables,
   count(*) FILTER (WHERE kind = 'catalog') AS catalog_tables, CAST(sum(objects) AS BIGINT) AS objects, count(*) FILTER (WHERE kind = 'catalog') > 0 AS "primary" FROM store GROUP BY 1)"""


@book.entry("storage_by_schema", f"WITH {_SCHEMAS_SQL} SELECT * FROM schemas")
def storage_by_schema(spark: SparkSession, sf: str) -> DataFrame:
    return sto.by_schema(_store(spark, sf))


@book.entry(
    "storage_totals",
    f"""WITH {_OBJECTS_SQL}, s AS (SELECT CAST(sum(bytes) AS BIGINT) AS table_bytes, CAST(coalesce(sum(live_bytes) FILTER (WHERE kind = 'catalog'), 0) AS BIGINT) AS live_bytes,
          CAST(sum(bytes) FILTER (WHERE kind = 'catalog') AS BIGINT) AS cb, CAST(sum(bytes) FILTER (WHERE kind = 'temp') AS BIGINT) AS temp_bytes,
          CAST(sum(bytes) FILTER (WHERE kind = 'orphan') AS BIGINT) AS orphan_bytes FROM store)
        SELECT table_bytes, live_bytes, greatest(cb - live_bytes, 0) AS stale_bytes, temp_bytes, orphan_bytes, greatest(cb - live_bytes, 0) + temp_bytes + orphan_bytes AS reclaimable FROM s""",
)
def storage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return sto.storage_totals(_store(spark, sf))


@book.entry(
    "schema_share_with_other",
    f"""WITH {_SCHEMAS_SQL} SELECT "schema", bytes, catalog_tables AS tables FROM schemas WHERE "primary"
        UNION ALL SELECT 'other', greatest((SELECT CAST(sum(length) AS BIGINT) FROM objects) - (SELECT CAST(sum(bytes) AS BIGINT) FROM schemas WHERE "primary"), 0),
                  (SELECT CAST(sum(tables) AS BIGINT) FROM schemas WHERE NOT "primary")""",
)
def schema_share(spark: SparkSession, sf: str) -> DataFrame:
    return sto.schema_share_with_other(sto.by_schema(_store(spark, sf)), _objects(spark, sf))


@book.entry(
    "load_times",
    """SELECT 'zone' || CAST(s.s_nationkey AS VARCHAR) || '.' || p.p_name || CAST(p.p_partkey AS VARCHAR) AS phys, CAST(max(o.o_orderdate) AS VARCHAR) AS loaded_at
       FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey AND p.p_size < 45
       JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey <> 3) s ON s.s_nationkey = p.p_partkey % 25
       JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY 1""",
)
def load_times(spark: SparkSession, sf: str) -> DataFrame:
    data_files = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("table_id"), F.col("l_orderkey").alias("begin_snapshot"))
    tables = table(spark, sf, "part").select(
        F.col("p_partkey").alias("table_id"), (F.col("p_partkey") % 25).alias("schema_id"),
        F.concat("p_name", F.col("p_partkey").cast("string")).alias("table_name"), F.when(F.col("p_size") >= 45, 1).alias("end_snapshot"),
    )
    schemas = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("schema_id"), F.concat(F.lit("zone"), F.col("s_nationkey").cast("string")).alias("schema_name"),
        F.when(F.col("s_nationkey") == 3, 1).alias("end_snapshot"),
    ).distinct()
    snapshots = table(spark, sf, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("snapshot_time"))
    out = sto.load_times(data_files, tables, schemas, snapshots)
    return out.withColumn("loaded_at", F.col("loaded_at").cast("string"))


# ---------------------------------------------------------------- model SQL text (from documents)

_SQL_TEXTS = """mt AS (SELECT doc_id AS id, 'select a.*, ''' || replace(replace(text, '''', ''''''), '--', '- -') || '; drop table t'' as note from {{ ref(''' || source || ''') }} a'
    || CASE doc_id % 6 WHEN 0 THEN ' join {{ ref("missing_one") }} b on true' WHEN 1 THEN '; delete from x' WHEN 2 THEN ' -- {{ ref(''commented'') }} ; select 1'
       WHEN 3 THEN ' join {{ source(''raw'', ''' || lang || ''') }} s on 1 = 1 /* ; create table q */' WHEN 4 THEN ' {% set x = 1 ; select %}' ELSE ';' END AS sql,
    doc_id % 6 AS k, source, lang FROM documents)"""


def _model_sql(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 6
    note = F.replace(F.replace("text", F.lit("'"), F.lit("''")), F.lit("--"), F.lit("- -"))
    tail = (
        F.when(k == 0, ' join {{ ref("missing_one") }} b on true').when(k == 1, "; delete from x")
        .when(k == 2, " -- {{ ref('commented') }} ; select 1")
        .when(k == 3, F.concat(F.lit(" join {{ source('raw', '"), "lang", F.lit("') }} s on 1 = 1 /* ; create table q */")))
        .when(k == 4, " {% set x = 1 ; select %}").otherwise(";")
    )
    sql = F.concat(F.lit("select a.*, '"), note, F.lit("; drop table t' as note from {{ ref('"), "source", F.lit("') }} a"), tail)
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), sql.alias("sql"))


@book.entry(
    "audit_sql",
    """SELECT doc_id AS id, CASE doc_id % 6 WHEN 1 THEN 2 ELSE 1 END AS statements, 0 AS ctes, 1 AS selects,
              CASE WHEN doc_id % 6 = 1 THEN 'delete from' END AS ddl, CASE WHEN doc_id % 6 = 0 THEN 'missing_one' ELSE '' END AS missing,
              doc_id % 6 NOT IN (0, 1) AS ok FROM documents""",
)
def audit_sql(spark: SparkSession, sf: str) -> DataFrame:
    from millrace.operators.sqltexts import audit_sql

    known = table(spark, sf, "documents").select(F.col("source").alias("id")).distinct()
    out = audit_sql(_model_sql(spark, sf), known)
    return out.select("id", "statements", "ctes", "selects", "ddl", F.concat_ws(",", "missing").alias("missing"), "ok")


@book.entry(
    "extract_refs",
    """SELECT doc_id AS id, 'ref' AS kind, source AS target, 0 AS pos FROM documents
       UNION ALL SELECT doc_id, 'ref', 'missing_one', 1 FROM documents WHERE doc_id % 6 = 0
       UNION ALL SELECT doc_id, 'source', 'raw.' || lang, 0 FROM documents WHERE doc_id % 6 = 3""",
)
def extract_refs(spark: SparkSession, sf: str) -> DataFrame:
    from millrace.operators.sqltexts import extract_refs

    return extract_refs(_model_sql(spark, sf))
