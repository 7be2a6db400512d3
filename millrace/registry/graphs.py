"""Lineage and ownership over the supply-chain graph derived from the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import lineage as ln
from millrace.operators import quality as q
from millrace.registry import facts
from millrace.registry.book import book
from millrace.registry.facts import table

G, FL = facts.GRAPH_SQL, facts.FLOWS_SQL

_UP = "up(id) AS (SELECT src FROM edges WHERE dst = '{0}' UNION SELECT e.src FROM edges e JOIN up ON e.dst = up.id)"
_DOWN = "down(id) AS (SELECT dst FROM edges WHERE src = '{0}' UNION SELECT e.dst FROM edges e JOIN down ON e.src = down.id)"


@book.entry(
    "lineage_closure",
    f"""WITH RECURSIVE {G}, {_UP.format('c42')}, {_DOWN.format('c42')}
        SELECT id, 'up' AS direction FROM up UNION ALL SELECT id, 'down' FROM down""",
)
def lineage(spark: SparkSession, sf: str) -> DataFrame:
    return ln.lineage_closure(facts.edges(spark, sf), "c42")


@book.entry(
    "lineage_closure_from_source",
    f"WITH RECURSIVE {G}, {_DOWN.format('s7')} SELECT id, 'down' AS direction FROM down",
)
def lineage_source(spark: SparkSession, sf: str) -> DataFrame:
    return ln.lineage_closure(facts.edges(spark, sf), "s7")


_TARGETS = ["c42", "c43", "no_such_model"]
_FLOW_SQL = f"""{G},
stops AS (SELECT 'p' || CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_brand = 'Brand#2'),
inc(id) AS (SELECT id FROM models WHERE id IN ('c42','c43','no_such_model')
            UNION SELECT e.src FROM edges e JOIN inc ON e.dst = inc.id WHERE inc.id NOT IN (SELECT id FROM stops)),
ie AS (SELECT * FROM edges WHERE src IN (SELECT id FROM inc) AND dst IN (SELECT id FROM inc)),
dp(id, depth) AS (SELECT id, 0 FROM inc UNION SELECT ie.dst, dp.depth + 1 FROM ie JOIN dp ON ie.src = dp.id),
nodes AS (SELECT i.id, d.depth, m.dbt_type, i.id IN ('c42','c43') AS is_target,
                 i.id IN (SELECT id FROM stops) AS read_only,
                 m.dbt_type = 'model' AND i.id NOT IN (SELECT id FROM stops) AS executable
          FROM inc i JOIN models m ON m.id = i.id JOIN (SELECT id, max(depth) AS depth FROM dp GROUP BY 1) d ON d.id = i.id),
flow AS (SELECT n.*, s.seq FROM nodes n LEFT JOIN (
           SELECT id, row_number() OVER (ORDER BY depth, id) AS seq FROM nodes WHERE executable) s ON s.id = n.id)"""


def _flow(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    edges = facts.edges(spark, sf)
    stop = table(spark, sf, "part").filter("p_brand = 'Brand#2'").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id")
    )
    return ln.flow_nodes(facts.models(spark, sf), edges, _TARGETS, stop=stop), edges


@book.entry("flow_nodes", f"WITH RECURSIVE {_FLOW_SQL} SELECT * FROM flow")
def flow_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _flow(spark, sf)[0]


@book.entry(
    "missing_targets",
    f"WITH {G} SELECT t AS id FROM (SELECT unnest(['c42','c43','no_such_model']) AS t) WHERE t NOT IN (SELECT id FROM models)",
)
def missing(spark: SparkSession, sf: str) -> DataFrame:
    return ln.missing_targets(facts.models(spark, sf), _TARGETS)


@book.entry(
    "longest_path_depth",
    f"""WITH RECURSIVE {G}, dp(id, depth) AS (SELECT id, 0 FROM models
          UNION SELECT e.dst, dp.depth + 1 FROM edges e JOIN dp ON e.src = dp.id)
        SELECT id, max(depth) AS depth FROM dp GROUP BY 1""",
)
def depth(spark: SparkSession, sf: str) -> DataFrame:
    from millrace.plans.reach import longest_path

    return longest_path(facts.edges(spark, sf, by="src"), facts.models(spark, sf))


@book.entry(
    "exec_sequence",
    f"""WITH {G} SELECT id, row_number() OVER (ORDER BY CASE substr(id, 1, 1) WHEN 'p' THEN 1 WHEN 'o' THEN 2
          WHEN 'c' THEN 3 WHEN 'n' THEN 4 WHEN 'r' THEN 5 ELSE 0 END, id) AS seq
        FROM models WHERE dbt_type = 'model'""",
)
def exec_sequence(spark: SparkSession, sf: str) -> DataFrame:
    layer = F.lit(0)
    for i, p in enumerate("pocnr", 1):
        layer = F.when(F.substring("id", 1, 1) == p, i).otherwise(layer)
    nodes = facts.models(spark, sf).select("id", layer.alias("depth"), (F.col("dbt_type") == "model").alias("executable"))
    return ln.exec_sequence(nodes).filter("executable").select("id", "seq")


@book.entry(
    "task_graph",
    f"""WITH RECURSIVE {_FLOW_SQL}, run AS (SELECT id FROM flow WHERE executable),
        te AS (SELECT src, dst FROM ie WHERE src IN (SELECT id FROM run) AND dst IN (SELECT id FROM run))
        SELECT * FROM te UNION ALL SELECT id, '_done' FROM run WHERE id NOT IN (SELECT src FROM te)""",
)
def task_graph(spark: SparkSession, sf: str) -> DataFrame:
    return ln.task_graph(*_flow(spark, sf))


@book.entry(
    "task_graph_single",
    f"WITH RECURSIVE {_FLOW_SQL} SELECT 'all' AS src, '_done' AS dst FROM flow WHERE executable LIMIT 1",
)
def task_graph_single(spark: SparkSession, sf: str) -> DataFrame:
    return ln.task_graph(*_flow(spark, sf), mode="single")


@book.entry(
    "exec_order",
    f"""WITH RECURSIVE {_FLOW_SQL} SELECT f.id, f.seq, NOT f.executable AS source, e.src AS depends_on
        FROM flow f LEFT JOIN ie e ON e.dst = f.id""",
)
def exec_order(spark: SparkSession, sf: str) -> DataFrame:
    return ln.exec_order(*_flow(spark, sf))


# The owner of a model is the smallest (created_at, id) among the flows that reach it; the layers
# let the oracle fold it level by level.
_OWNER_SQL = f"""{G}, {FL},
tl AS (SELECT t.id, (f.created_at, f.id) AS label FROM flow_targets t JOIN flows f ON f.id = t.flow),
ln AS (SELECT id, min(label) AS label FROM tl WHERE id LIKE 'n%' GROUP BY 1),
lc AS (SELECT id, min(label) AS label FROM (SELECT * FROM tl WHERE id LIKE 'c%'
         UNION ALL SELECT e.src, l.label FROM edges e JOIN ln l ON l.id = e.dst) GROUP BY 1),
lo AS (SELECT e.src AS id, min(l.label) AS label FROM edges e JOIN lc l ON l.id = e.dst GROUP BY 1),
lp AS (SELECT e.src AS id, min(l.label) AS label FROM edges e JOIN lo l ON l.id = e.dst GROUP BY 1),
owned AS (SELECT * FROM (SELECT * FROM ln UNION ALL SELECT * FROM lc UNION ALL SELECT * FROM lo UNION ALL SELECT * FROM lp)
          WHERE id IN (SELECT id FROM models WHERE dbt_type = 'model')),
seeded AS (SELECT e.src AS id, min(l.label) AS label FROM edges e JOIN owned l ON l.id = e.dst
             JOIN models m ON m.id = e.src AND m.dbt_type = 'seed'
             JOIN flows f ON f.id = l.label[2] AND f.include_seeds GROUP BY 1),
owner AS (SELECT id, label[2] AS owner FROM owned UNION ALL SELECT id, label[2] FROM seeded)"""
_OWNER_SQL = _OWNER_SQL.replace("(f.created_at, f.id) AS label", "{'at': f.created_at, 'flow': f.id} AS label").replace(
    "l.label[2]", "l.label.flow").replace("label[2]", "label.flow")


def _owner(spark: SparkSession, sf: str, edges: DataFrame | None = None) -> DataFrame:
    return ln.ownership(
        facts.models(spark, sf), edges or facts.edge_rows(spark, sf), facts.flows(spark, sf), facts.flow_targets(spark, sf)
    )


@book.entry("ownership", f"WITH {_OWNER_SQL} SELECT * FROM owner")
def ownership(spark: SparkSession, sf: str) -> DataFrame:
    return _owner(spark, sf)


@book.entry(
    "ownership_conflicts",
    f"WITH {_OWNER_SQL} SELECT t.flow, t.id, o.owner FROM flow_targets t JOIN owner o ON o.id = t.id WHERE o.owner <> t.flow",
)
def conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return ln.ownership_conflicts(_owner(spark, sf), facts.flow_targets(spark, sf))


@book.entry(
    "suggested_upstreams",
    f"""WITH RECURSIVE {_FLOW_SQL}, {_OWNER_SQL.replace(G + ', ', '')}
        SELECT o.owner, count(*) AS inputs FROM flow f JOIN owner o ON o.id = f.id WHERE f.read_only GROUP BY 1""",
)
def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _flow(spark, sf)
    return ln.suggested_upstreams(_owner(spark, sf, edges), nodes)


@book.entry(
    "rerun_scope",
    f"""WITH RECURSIVE {_FLOW_SQL}, st AS (SELECT min(id) AS id FROM flow WHERE id LIKE 'o%'),
        rr(id) AS (SELECT id FROM st UNION SELECT ie.dst FROM ie JOIN rr ON ie.src = rr.id)
        SELECT id, seq FROM flow WHERE executable AND id IN (SELECT id FROM rr)""",
)
def rerun(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _flow(spark, sf)
    start = nodes.filter("id LIKE 'o%'").agg(F.min("id")).head()[0]
    return ln.rerun_scope(nodes, edges, start)


_TRIG = "trig AS (SELECT upstream_id AS src, id AS dst FROM flows WHERE trigger_type = 'upstream')"


@book.entry(
    "chained_flows",
    f"""WITH RECURSIVE {FL}, {_TRIG}, ch(id) AS (SELECT 'f4' UNION SELECT t.dst FROM trig t JOIN ch ON t.src = ch.id)
        SELECT id FROM ch WHERE id <> 'f4'""",
)
def chained(spark: SparkSession, sf: str) -> DataFrame:
    return ln.chained_flows(facts.flows(spark, sf), "f4")


@book.entry(
    "chain_cycles",
    f"""WITH RECURSIVE {FL}, {_TRIG},
        walk(root, pos) AS (SELECT dst, src FROM trig UNION SELECT w.root, t.src FROM walk w JOIN trig t ON t.dst = w.pos)
        SELECT root AS id, min(pos) AS cycle FROM walk WHERE root IN (SELECT root FROM walk WHERE root = pos) GROUP BY root""",
)
def cycles(spark: SparkSession, sf: str) -> DataFrame:
    return ln.chain_cycles(facts.flows(spark, sf))


@book.entry(
    "flow_links",
    f"""WITH {FL}, {_TRIG} SELECT src, dst, 'success' AS cond FROM trig
        UNION ALL SELECT 'j' || CAST(s_suppkey AS VARCHAR), 'f' || CAST(c_custkey AS VARCHAR), 'asset'
        FROM customer JOIN supplier ON s_suppkey = c_custkey""",
)
def flow_links(spark: SparkSession, sf: str) -> DataFrame:
    reads = table(spark, sf, "customer").select(
        F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("flow"),
        F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("source_id"),
    )
    jobs = table(spark, sf, "supplier").select(
        F.concat(F.lit("j"), F.col("s_suppkey").cast("string")).alias("id"),
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("target"),
    )
    return ln.flow_links(facts.flows(spark, sf), reads, jobs)


@book.entry(
    "updated_inputs",
    """WITH w AS (SELECT 'f' || CAST(o_custkey % 500 AS VARCHAR) AS flow, 'u' || CAST(o_orderkey % 200 AS VARCHAR) AS input_id,
                 CASE o_orderpriority WHEN '1-URGENT' THEN 'source' WHEN '2-HIGH' THEN 'seed' ELSE 'read_only' END AS input_kind FROM orders),
       kept AS (SELECT * FROM w WHERE input_kind <> 'source' OR input_id IN (SELECT 'u' || CAST(s_suppkey AS VARCHAR) FROM supplier)),
       ev AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS input_id, max(ts) AS updated_at FROM events GROUP BY 1),
       j AS (SELECT flow, max(updated_at) AS updated_at FROM kept JOIN ev USING (input_id) GROUP BY 1),
       lr AS (SELECT 'f' || CAST(user_id * 2 AS VARCHAR) AS flow, max(ts) AS last_run FROM events WHERE event_type = 'click' GROUP BY 1)
       SELECT flow, CAST(updated_at AS VARCHAR) AS updated_at, CAST(last_run AS VARCHAR) AS last_run
       FROM j LEFT JOIN lr USING (flow) WHERE last_run IS NULL OR updated_at > last_run""",
)
def updated_inputs(spark: SparkSession, sf: str) -> DataFrame:
    prio = F.col("o_orderpriority")
    watched = table(spark, sf, "orders").select(
        F.concat(F.lit("f"), (F.col("o_custkey") % 500).cast("string")).alias("flow"),
        F.concat(F.lit("u"), (F.col("o_orderkey") % 200).cast("string")).alias("input_id"),
        F.when(prio == "1-URGENT", "source").when(prio == "2-HIGH", "seed").otherwise("read_only").alias("input_kind"),
    )
    ev = table(spark, sf, "events")
    updates = ev.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("input_id"), F.col("ts").alias("at"))
    runs = ev.filter("event_type = 'click'").select(
        F.concat(F.lit("f"), (F.col("user_id") * 2).cast("string")).alias("flow"), F.col("ts").alias("at")
    )
    loaded = table(spark, sf, "supplier").select(F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("target"))
    out = ln.updated_inputs(watched, updates, runs, loaded)
    return out.withColumn("updated_at", F.col("updated_at").cast("string")).withColumn(
        "last_run", F.col("last_run").cast("string")
    )


_PROPOSED = """proposed AS (
  SELECT CASE o_orderkey % 5 WHEN 1 THEN 'c' || CAST(o_custkey AS VARCHAR) ELSE 'o' || CAST(o_orderkey AS VARCHAR) END AS src,
         CASE o_orderkey % 5 WHEN 0 THEN 'c' || CAST(o_custkey AS VARCHAR) WHEN 1 THEN 'o' || CAST(o_orderkey AS VARCHAR)
              WHEN 2 THEN 's' || CAST(o_orderkey % 10 AS VARCHAR) WHEN 3 THEN 'o' || CAST(o_orderkey AS VARCHAR)
              ELSE 'o' || CAST(o_orderkey - 1 AS VARCHAR) END AS dst FROM orders)"""


@book.entry(
    "edge_check",
    f"""WITH RECURSIVE {G}, {_PROPOSED},
        below(root, id) AS (SELECT DISTINCT dst, dst FROM proposed
          UNION SELECT b.root, e.dst FROM below b JOIN edges e ON e.src = b.id)
        SELECT p.src, p.dst, CASE WHEN m.dbt_type <> 'model' THEN 'source_input'
            WHEN (p.src, p.dst) IN (SELECT (src, dst) FROM edges) THEN 'duplicate'
            WHEN p.src = p.dst OR (p.dst, p.src) IN (SELECT (root, id) FROM below) THEN 'cycle' ELSE 'ok' END AS verdict
        FROM proposed p JOIN models m ON m.id = p.dst""",
)
def edge_check(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    o, c = F.concat(F.lit("o"), k.cast("string")), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    proposed = table(spark, sf, "orders").select(
        F.when(k % 5 == 1, c).otherwise(o).alias("src"),
        F.when(k % 5 == 0, c).when(k % 5 == 1, o)
        .when(k % 5 == 2, F.concat(F.lit("s"), (k % 10).cast("string"))).when(k % 5 == 3, o)
        .otherwise(F.concat(F.lit("o"), (k - 1).cast("string"))).alias("dst"),
    )
    return ln.edge_check(facts.models(spark, sf), facts.edges(spark, sf, by="src"), proposed)


@book.entry(
    "between_models",
    f"""WITH RECURSIVE {G}, {_DOWN.format('s7')}, {_UP.format('c42')}
        SELECT id FROM down WHERE id IN (SELECT id FROM up) AND id <> 'c42' AND id <> 's7'""",
)
def between(spark: SparkSession, sf: str) -> DataFrame:
    return ln.between_models(facts.edges(spark, sf), "c42", "s7")


@book.entry(
    "connected_component",
    f"""WITH RECURSIVE {G}, und AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges),
        comp(id) AS (SELECT 'r2' UNION SELECT und.b FROM und JOIN comp ON und.a = comp.id)
        SELECT id FROM comp WHERE id <> 'r2'""",
)
def component(spark: SparkSession, sf: str) -> DataFrame:
    return ln.component(facts.edge_rows(spark, sf), "r2")


CE = facts.COLUMN_EDGES_SQL


@book.entry("distinct_edges", f"WITH {CE} SELECT * FROM column_edges")
def distinct_edges(spark: SparkSession, sf: str) -> DataFrame:
    return ln.distinct_edges(facts.raw_column_edges(spark, sf), ["from_id", "from_col", "to_id", "to_col"], "pos")


@book.entry(
    "column_path",
    f"""WITH RECURSIVE {CE},
        dn(id, col) AS (SELECT to_id, to_col FROM column_edges WHERE from_id = 'p7' AND from_col = 'f'
          UNION SELECT e.to_id, e.to_col FROM column_edges e JOIN dn ON e.from_id = dn.id AND e.from_col = dn.col),
        up(id, col) AS (SELECT from_id, from_col FROM column_edges WHERE to_id = 'p7' AND to_col = 'f'
          UNION SELECT e.from_id, e.from_col FROM column_edges e JOIN up ON e.to_id = up.id AND e.to_col = up.col)
        SELECT id, col, 'down' AS direction FROM dn UNION ALL SELECT id, col, 'up' FROM up""",
)
def column_path(spark: SparkSession, sf: str) -> DataFrame:
    return ln.column_path(facts.column_edges(spark, sf), "p7", "f")


@book.entry(
    "column_lineage_summary",
    f"""WITH {CE}, cols AS (SELECT 'o' || CAST(l_orderkey AS VARCHAR) AS model_id,
            CASE WHEN l_linenumber > 2 THEN 'unknown' ELSE 'ok' END AS status FROM lineitem),
        k AS (SELECT to_id, count(*) FILTER (WHERE kind = 'copy') AS copies, count(*) FILTER (WHERE kind = 'transform') AS transforms
              FROM column_edges WHERE from_col <> '*' GROUP BY 1)
        SELECT model_id, columns, coalesce(copies, 0) AS copies, coalesce(transforms, 0) AS transforms,
               CASE WHEN u THEN 'unknown' ELSE 'ok' END AS status
        FROM (SELECT model_id, count(*) AS columns, bool_and(status = 'unknown') AS u FROM cols GROUP BY 1) c
        LEFT JOIN k ON k.to_id = c.model_id""",
)
def column_summary(spark: SparkSession, sf: str) -> DataFrame:
    columns = table(spark, sf, "lineitem").select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("model_id"),
        F.when(F.col("l_linenumber") > 2, "unknown").otherwise("ok").alias("status"),
    )
    return ln.column_lineage_summary(facts.column_edges(spark, sf), columns)


_HIDDEN = "hidden AS (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus = 'P')"


@book.entry(
    "visible_graph",
    f"""WITH {G}, {_HIDDEN} SELECT src, dst FROM edges
        WHERE src NOT IN (SELECT id FROM hidden) AND dst NOT IN (SELECT id FROM hidden)""",
)
def visible(spark: SparkSession, sf: str) -> DataFrame:
    hidden = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id")
    )
    return ln.visible_graph(facts.models(spark, sf), facts.edges(spark, sf), hidden)[1]


U = facts.USAGE_SQL


@book.entry(
    "mart_eligibility",
    f"""WITH {G}, {U}, d AS (SELECT src, count(DISTINCT dst) AS n FROM edges GROUP BY 1),
        u AS (SELECT id, count(*) AS n FROM usage GROUP BY 1),
        b AS (SELECT m.id, m.dbt_type, m.id IN (SELECT id FROM marts) AS is_mart, coalesce(d.n, 0) AS downstream,
                     coalesce(u.n, 0) AS analyses FROM models m LEFT JOIN d ON d.src = m.id LEFT JOIN u ON u.id = m.id)
        SELECT id, is_mart, downstream, analyses, dbt_type = 'model' AND downstream = 0 AND NOT is_mart AS can_mark,
               is_mart AND analyses = 0 AS can_unmark,
               CASE WHEN is_mart THEN '' WHEN dbt_type <> 'model' THEN 'source' WHEN downstream > 0 THEN 'has_downstream' ELSE '' END AS mark_blocked,
               is_mart AND downstream > 0 AS violates_final FROM b""",
)
def marts(spark: SparkSession, sf: str) -> DataFrame:
    return ln.mart_eligibility(
        facts.models(spark, sf), facts.edges(spark, sf), facts.marts(spark, sf), facts.usage(spark, sf)
    )


@book.entry(
    "seed_marts",
    f"""WITH {G}, {U} SELECT id FROM models WHERE dbt_type = 'model' AND id NOT IN (SELECT src FROM edges)
        AND id IN (SELECT id FROM datasets)""",
)
def seed_marts(spark: SparkSession, sf: str) -> DataFrame:
    return ln.seed_marts(facts.models(spark, sf), facts.edges(spark, sf), facts.datasets(spark, sf))


@book.entry(
    "staleness",
    f"""WITH {G}, {facts.LOADS_SQL},
        lp AS (SELECT id, loaded_at AS t FROM load_times WHERE id LIKE 'p%'),
        po AS (SELECT e.dst AS id, max(lp.t) AS t FROM edges e JOIN lp ON lp.id = e.src GROUP BY 1),
        lo AS (SELECT l.id, greatest(l.loaded_at, po.t) AS t FROM load_times l LEFT JOIN po USING (id) WHERE l.id LIKE 'o%'),
        oc AS (SELECT e.dst AS id, max(lo.t) AS t FROM edges e JOIN lo ON lo.id = e.src GROUP BY 1),
        above AS (SELECT * FROM po UNION ALL SELECT * FROM oc)
        SELECT l.id, CAST(l.loaded_at AS VARCHAR) AS loaded_at, CAST(a.t AS VARCHAR) AS upstream_load,
               coalesce(a.t > l.loaded_at, false) AS stale FROM load_times l LEFT JOIN above a USING (id)""",
)
def staleness(spark: SparkSession, sf: str) -> DataFrame:
    out = ln.staleness(facts.edges(spark, sf, by="src"), facts.load_times(spark, sf))
    return out.withColumn("loaded_at", F.col("loaded_at").cast("string")).withColumn(
        "upstream_load", F.col("upstream_load").cast("string")
    )


@book.entry(
    "target_conflicts",
    f"""WITH {G}, jobs AS (SELECT 'o' || CAST(o_custkey AS VARCHAR) AS target FROM orders WHERE o_totalprice > 250000)
        SELECT target, 'two_jobs' AS reason FROM jobs GROUP BY 1 HAVING count(*) > 1
        UNION ALL SELECT DISTINCT target, 'model_name' FROM jobs WHERE target IN (SELECT id FROM models WHERE dbt_type <> 'source')""",
)
def target_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    jobs = table(spark, sf, "orders").filter("o_totalprice > 250000").select(
        F.concat(F.lit("o"), F.col("o_custkey").cast("string")).alias("target")
    )
    return ln.target_conflicts(jobs, facts.models(spark, sf))


@book.entry(
    "drop_impact",
    f"""WITH {G}, {FL}, {U}, w AS (SELECT id FROM marts)
        SELECT DISTINCT src AS id, 'model' AS kind, dst AS blocker FROM edges WHERE src IN (SELECT id FROM w)
        UNION ALL SELECT DISTINCT id, 'flow', flow FROM flow_targets WHERE id IN (SELECT id FROM w)
        UNION ALL SELECT DISTINCT id, 'analysis', analysis FROM usage WHERE id IN (SELECT id FROM w)""",
)
def drop_impact(spark: SparkSession, sf: str) -> DataFrame:
    return ln.drop_impact(
        facts.marts(spark, sf), facts.edges(spark, sf), facts.flow_targets(spark, sf), facts.usage(spark, sf)
    )


@book.entry(
    "skip_downstream",
    f"""WITH RECURSIVE {G}, bad AS (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_totalprice > 499000),
        hit(id) AS (SELECT id FROM bad UNION SELECT e.dst FROM edges e JOIN hit ON e.src = hit.id)
        SELECT id, CASE WHEN id IN (SELECT id FROM bad) THEN 'err' WHEN id IN (SELECT id FROM hit) THEN 'skip' ELSE 'ok' END AS state
        FROM models""",
)
def skip_downstream(spark: SparkSession, sf: str) -> DataFrame:
    failed = q.accepted_range(table(spark, sf, "orders"), "o_totalprice", None, 499000).select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id")
    )
    return q.skip_downstream(facts.models(spark, sf), facts.edges(spark, sf), failed)
