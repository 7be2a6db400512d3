"""Lineage, run order, ownership and staleness over edge tables.

Shapes: ``edges(src, dst)``, ``models(id, dbt_type, …)``, ``flows(id, created_at, include_seeds, …)``
with ``flow_targets(flow, id)``. A flow builds its targets and everything upstream of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans import reach
from millrace.plans.durable import cut, cut_by
from millrace.plans.ordered import number_rows

DONE = "_done"


def _reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _ids(df: DataFrame, values: Sequence[str], name: str = "dst") -> DataFrame:
    """A few given ids as a one-partition DataFrame."""
    one = df.sparkSession.range(0, 1, 1, 1)
    return one.select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def _both_ways(edges: DataFrame, starts: Sequence[str]) -> DataFrame:
    """(root, direction, id, hop) for several starts, up and down, in one walk."""
    steps = edges.select(F.lit("down").alias("direction"), "src", "dst").unionAll(
        _reverse(edges).select(F.lit("up").alias("direction"), "src", "dst")
    )
    roots = _ids(edges, starts, "root").select(
        F.explode(F.array(F.lit("up"), F.lit("down"))).alias("direction"), F.col("root").alias("dst"), "root"
    )
    return reach.closure(
        steps, roots, frm=("direction", "src"), to=("direction", "dst"), carry=("root",)
    ).withColumnRenamed("dst", "id")


def distinct_edges(edges: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Unique edges; the first-seen row decides the other columns."""
    rest = [c for c in edges.columns if c not in (*keys, pos)]
    first = F.min_by(F.struct(*rest), pos).alias("_f") if rest else F.min(pos).alias(pos)
    out = edges.groupBy(*keys).agg(first, F.min(pos).alias(pos)) if rest else edges.groupBy(*keys).agg(first)
    return out.select(*keys, *[F.col(f"_f.{c}").alias(c) for c in rest], pos)


def lineage_closure(edges: DataFrame, model_id: str) -> DataFrame:
    """All upstream and downstream ids of one model, itself excluded."""
    return _both_ways(edges, [model_id]).filter(F.col("id") != model_id).select("id", "direction")


# ---------------------------------------------------------------- flows


def flow_nodes(
    models: DataFrame, edges: DataFrame, targets: Sequence[str], *,
    include_seeds: bool = False, stop: DataFrame | None = None,
) -> DataFrame:
    """Targets and their upstream with depth, executability and run sequence.

    A model in ``stop`` (owned by another flow) is shown but neither run nor walked past; targets
    themselves always run.
    """
    wanted = _ids(models, targets)
    known = wanted.join(models.select(F.col("id").alias("dst")), "dst", "left_semi")
    blocked = None
    if stop is not None:
        blocked = stop.select(F.col("id").alias("dst")).distinct().join(wanted, "dst", "left_anti")
    real = models.select(F.col("id").alias("dst"))
    reached = cut(
        reach.closure(_reverse(edges), known, stop=blocked, within=real).select(F.col("dst").alias("id")), "reached"
    )
    depth = cut(reach.longest_path(cut(inner_edges(edges, reached), "inner"), reached), "depth")
    kinds = models.select("id", "dbt_type")
    nodes = cut(depth.join(kinds, "id"), "nodes").withColumn("is_target", F.col("id").isin(list(targets)))
    if blocked is None:
        nodes = nodes.withColumn("read_only", F.lit(False))
    else:
        mark = blocked.select(F.col("dst").alias("_b"))
        nodes = nodes.join(mark, F.col("id") == F.col("_b"), "left").withColumn(
            "read_only", F.col("_b").isNotNull()
        ).drop("_b")
    runs = (F.col("dbt_type") == "model") | ((F.col("dbt_type") == "seed") & F.lit(include_seeds))
    nodes = nodes.withColumn("executable", runs & ~F.col("read_only"))
    return cut(exec_sequence(cut(nodes, "nodes")), "nodes")


def exec_sequence(nodes: DataFrame) -> DataFrame:
    """Number executable nodes from 1 by (depth, id); the others have no number."""
    order = number_rows(nodes.filter("executable").select("id", "depth"), ["depth", "id"], "seq")
    numbered = order.select(F.col("id").alias("_n"), F.col("seq"))
    return nodes.join(numbered, F.col("id") == F.col("_n"), "left").drop("_n")


def missing_targets(models: DataFrame, targets: Sequence[str]) -> DataFrame:
    wanted = _ids(models, targets).withColumnRenamed("dst", "id")
    return wanted.join(models.select("id"), "id", "left_anti")


def inner_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return (
        edges.select("src", "dst")
        .join(nodes.select(F.col("id").alias("src")), "src", "left_semi")
        .join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
        .select("src", "dst").distinct()
    )


def task_graph(nodes: DataFrame, edges: DataFrame, *, mode: str = "per_model") -> DataFrame:
    """Run-order edges between executable nodes, plus a done marker after every sink."""
    runnable = nodes.filter("executable").select("id")
    if mode == "single":
        any_task = runnable.limit(1)
        return any_task.select(F.lit("all").alias("src"), F.lit(DONE).alias("dst"))
    steps = inner_edges(edges, runnable)
    sinks = runnable.join(steps.select(F.col("src").alias("id")), "id", "left_anti")
    return steps.unionAll(sinks.select(F.col("id").alias("src"), F.lit(DONE).alias("dst")))


def exec_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per (node, dependency); a node without inputs has one row with no dependency."""
    deps = inner_edges(edges, nodes).select(F.col("src").alias("depends_on"), F.col("dst").alias("_d"))
    return nodes.join(deps, F.col("id") == F.col("_d"), "left").select(
        "id", "seq", (~F.col("executable")).alias("source"), "depends_on"
    )


def ownership(models: DataFrame, edges: DataFrame, flows: DataFrame, flow_targets: DataFrame) -> DataFrame:
    """Each executable model's owner: the earliest-created flow that reaches it.

    The earliest (created_at, id) travels upstream and is merged per model. Whatever lies above a
    model that is already owned belongs to the same or an earlier flow, so stopping there, as a
    later flow does, cannot change the minimum. Seeds are run only by flows that include them:
    the owner of a reading model (or a flow targeting it), or a flow that targets the seed itself.
    """
    at = F.coalesce("created_at", F.lit(0.0)).cast("double").alias("at")
    ranked = flows.groupBy(at, F.col("id").alias("flow")).agg(
        F.coalesce(F.bool_or("include_seeds"), F.lit(False)).alias("seeds")
    ).select("flow", F.struct("at", "flow", "seeds").alias("label"))
    # Walked upstream, in several rounds and once more for the seeds: one layout for all.
    up = cut_by(_reverse(edges), ["src"], "up", distinct=True)
    kinds = models.select("id", "dbt_type")
    target_labels = flow_targets.join(ranked, "flow").join(kinds, "id")
    built = target_labels.filter("dbt_type = 'model'").select("id", "label")
    spread = reach.spread(up, built)
    owned = spread.join(kinds.filter("dbt_type = 'model'"), "id", "left_semi").select("id", "label")
    # A flow walks past its own targets even where another flow owns them.
    walked = owned.unionByName(built).filter("label.seeds").groupBy("id").agg(F.min("label").alias("label"))
    readers = up.join(walked.select(F.col("id").alias("src"), "label"), "src").select(F.col("dst").alias("id"), "label")
    direct = target_labels.filter("dbt_type = 'seed' AND label.seeds").select("id", "label")
    seeds = (
        readers.unionAll(direct).groupBy("id").agg(F.min("label").alias("label"))
        .join(kinds.filter("dbt_type = 'seed'"), "id", "left_semi")
    )
    return owned.unionByName(seeds).select("id", F.col("label.flow").alias("owner"))


def ownership_conflicts(owner: DataFrame, flow_targets: DataFrame) -> DataFrame:
    """Targets that another flow already loads."""
    return flow_targets.join(owner, "id").filter(F.col("owner") != F.col("flow")).select("flow", "id", "owner")


def suggested_upstreams(owner: DataFrame, nodes: DataFrame) -> DataFrame:
    """Flows that load a flow's read-only inputs, with how many of them."""
    return nodes.filter("read_only").join(owner, "id").groupBy("owner").agg(
        F.count(F.lit(1)).alias("inputs")
    )


def rerun_scope(nodes: DataFrame, edges: DataFrame, start: str) -> DataFrame:
    """Executable nodes reachable from ``start`` (included), in run order."""
    reached = reach.closure(inner_edges(edges, nodes), _ids(nodes, [start]))
    hit = reached.select(F.col("dst").alias("id"))
    return nodes.filter("executable").join(hit, "id", "left_semi").select("id", "seq").orderBy("seq")


def chained_flows(flows: DataFrame, flow_id: str) -> DataFrame:
    """Flows that start, directly or through others, when this one ends."""
    found = reach.closure(trigger_edges(flows), _ids(flows, [flow_id]))
    return found.filter(F.col("dst") != flow_id).select(F.col("dst").alias("id"))


def trigger_edges(flows: DataFrame) -> DataFrame:
    on = (F.col("trigger_type") == "upstream") & F.col("upstream_id").isNotNull()
    return flows.filter(on).select(F.col("upstream_id").alias("src"), F.col("id").alias("dst"))


def chain_cycles(flows: DataFrame) -> DataFrame:
    """(id, cycle): flows whose trigger chain leads back to themselves, and the smallest flow of that cycle."""
    return reach.on_cycles(trigger_edges(flows).select(F.col("dst").alias("id"), F.col("src").alias("next")))


def flow_links(flows: DataFrame, flow_sources: DataFrame, jobs: DataFrame) -> DataFrame:
    """Flow-level edges: trigger chains, and ingest job → flow that reads the job's source."""
    chain = trigger_edges(flows).withColumn("cond", F.lit("success"))
    fills = jobs.select(F.col("id").alias("src"), F.col("target").alias("_t"))
    asset = flow_sources.join(fills, F.col("source_id") == F.col("_t")).select(
        "src", F.col("flow").alias("dst"), F.lit("asset").alias("cond")
    )
    return chain.unionByName(asset)


def updated_inputs(watched: DataFrame, events: DataFrame, last_runs: DataFrame, loaded: DataFrame) -> DataFrame:
    """Consumers to wake: any watched input was updated after the consumer's last run.

    ``watched(flow, input_id, input_kind)`` holds read-only inputs, seeds and sources; a source no
    job loads is not watched. ``events(input_id, at)`` are update events.
    """
    filled = loaded.select(F.col("target").alias("_f")).distinct()
    kept = watched.join(filled, F.col("input_id") == F.col("_f"), "left").filter(
        (F.col("input_kind") != "source") | F.col("_f").isNotNull()
    )
    newest = events.groupBy("input_id").agg(F.max("at").alias("updated_at"))
    joined = kept.join(newest, "input_id").groupBy("flow").agg(F.max("updated_at").alias("updated_at"))
    runs = last_runs.groupBy("flow").agg(F.max("at").alias("last_run"))
    return joined.join(runs, "flow", "left").filter(
        F.col("last_run").isNull() | (F.col("updated_at") > F.col("last_run"))
    )


# ---------------------------------------------------------------- graph questions


def edge_check(models: DataFrame, edges: DataFrame, proposed: DataFrame) -> DataFrame:
    """Verdict per proposed edge, in this order: source input, duplicate, cycle, ok.

    ``dst`` lies upstream of ``src`` exactly when ``src`` lies downstream of ``dst``, so one walk
    per distinct proposed target answers all of its proposals. Only targets of proposals that nothing else decides are
    walked from.
    """
    have = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct()
    kinds = models.select(F.col("id").alias("_id"), (F.col("dbt_type") != "model").alias("_source"))
    seen = (
        proposed.join(kinds, F.col("dst") == F.col("_id"))
        .join(have, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left")
    )
    seen = cut(seen.select(
        "src", "dst",
        F.when(F.col("_source"), "source_input").when(F.col("_s").isNotNull(), "duplicate")
        .when(F.col("src") == F.col("dst"), "cycle").alias("_verdict"),
    ), "proposed")
    starts = seen.filter("_verdict IS NULL").select("dst", F.col("dst").alias("root")).distinct()
    below = reach.closure(edges, starts, carry=["root"]).filter(F.col("dst") != F.col("root"))
    back = below.select(F.col("root").alias("_root"), F.col("dst").alias("_down"))
    out = seen.join(back, (F.col("dst") == F.col("_root")) & (F.col("src") == F.col("_down")), "left")
    return out.select(
        "src", "dst",
        F.coalesce("_verdict", F.when(F.col("_down").isNotNull(), "cycle").otherwise("ok")).alias("verdict"),
    )


def between_models(edges: DataFrame, first: str, second: str) -> DataFrame:
    """Models strictly between two models on any path, whichever lies upstream."""
    walked = _both_ways(edges, [first, second]).filter("hop > 0")
    met = walked.filter(~F.col("id").isin(first, second)).groupBy("id").agg(*[
        F.bool_or((F.col("root") == r) & (F.col("direction") == d)).alias(f"{d}_{i}")
        for i, r in enumerate((first, second)) for d in ("up", "down")
    ])
    return met.filter("(down_0 AND up_1) OR (down_1 AND up_0)").select("id")


def component(edges: DataFrame, model_id: str) -> DataFrame:
    """Models connected to one model, directions ignored, itself excluded."""
    ends = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    both = cut_by(edges.select(ends.alias("e")).select("e.*"), ["src"], "both", distinct=True)
    found = reach.closure(both, _ids(edges, [model_id]))
    return found.filter(F.col("dst") != model_id).select(F.col("dst").alias("id"))


def column_path(column_edges: DataFrame, model_id: str, col: str) -> DataFrame:
    """The full upstream and downstream path of one column as (id, col, direction)."""
    steps = column_edges.select(
        F.lit("down").alias("direction"), "from_id", "from_col", "to_id", "to_col"
    ).unionAll(column_edges.select(F.lit("up"), "to_id", "to_col", "from_id", "from_col"))
    start = _ids(column_edges, ["up", "down"], "direction").select(
        "direction", F.lit(model_id).alias("to_id"), F.lit(col).alias("to_col")
    )
    walked = reach.closure(
        steps, start, frm=("direction", "from_id", "from_col"), to=("direction", "to_id", "to_col")
    )
    return walked.filter("hop > 0").select(F.col("to_id").alias("id"), F.col("to_col").alias("col"), "direction")


def column_lineage_summary(column_edges: DataFrame, columns: DataFrame) -> DataFrame:
    """Per model: copied and transformed columns, and ``unknown`` when no column is known."""
    real = column_edges.filter(F.col("from_col") != "*")
    kinds = real.groupBy(F.col("to_id").alias("_m")).agg(
        F.count_if(F.col("kind") == "copy").alias("copies"),
        F.count_if(F.col("kind") == "transform").alias("transforms"),
    )
    known = columns.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("columns"), F.bool_and(F.col("status") == "unknown").alias("_u")
    )
    return known.join(kinds, F.col("model_id") == F.col("_m"), "left").select(
        "model_id", "columns", F.coalesce("copies", F.lit(0)).alias("copies"),
        F.coalesce("transforms", F.lit(0)).alias("transforms"),
        F.when(F.col("_u"), "unknown").otherwise("ok").alias("status"),
    )


def visible_graph(nodes: DataFrame, edges: DataFrame, hidden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that are not hidden and the edges whose two ends are both visible."""
    kept = nodes.join(hidden.select("id"), "id", "left_anti")
    return kept, inner_edges(edges, kept)


def mart_eligibility(models: DataFrame, edges: DataFrame, marts: DataFrame, usage: DataFrame) -> DataFrame:
    """Which models may become or stop being a mart, and which marts are read by other models."""
    down = edges.groupBy(F.col("src").alias("_s")).agg(F.count_distinct("dst").alias("downstream"))
    used = usage.groupBy(F.col("id").alias("_u")).agg(F.count(F.lit(1)).alias("analyses"))
    mark = marts.select(F.col("id").alias("_m")).distinct()
    base = (
        models.select("id", "dbt_type")
        .join(down, F.col("id") == F.col("_s"), "left")
        .join(used, F.col("id") == F.col("_u"), "left")
        .join(mark, F.col("id") == F.col("_m"), "left")
    )
    is_mart = F.col("_m").isNotNull()
    n_down, n_used = F.coalesce("downstream", F.lit(0)), F.coalesce("analyses", F.lit(0))
    is_model = F.col("dbt_type") == "model"
    return base.select(
        "id", is_mart.alias("is_mart"), n_down.alias("downstream"), n_used.alias("analyses"),
        (is_model & (n_down == 0) & ~is_mart).alias("can_mark"),
        (is_mart & (n_used == 0)).alias("can_unmark"),
        F.when(is_mart, "").when(~is_model, "source").when(n_down > 0, "has_downstream").otherwise("")
        .alias("mark_blocked"),
        (is_mart & (n_down > 0)).alias("violates_final"),
    )


def seed_marts(models: DataFrame, edges: DataFrame, datasets: DataFrame) -> DataFrame:
    """First-time marking: every final model that has a dataset."""
    final = models.filter("dbt_type = 'model'").join(
        edges.select(F.col("src").alias("id")), "id", "left_anti"
    )
    return final.join(datasets.select("id"), "id", "left_semi").select("id")


def staleness(edges: DataFrame, load_times: DataFrame) -> DataFrame:
    """Own load time against the newest load anywhere upstream; unknown times are never stale."""
    known = load_times.filter(F.col("loaded_at").isNotNull()).select("id", F.col("loaded_at").alias("label"))
    newest = reach.spread(edges, known, keep="max")
    above = newest.filter(F.col("came").isNotNull()).select(F.col("id").alias("_d"), F.col("came").alias("upstream_load"))
    return load_times.join(above, F.col("id") == F.col("_d"), "left").select(
        "id", "loaded_at", "upstream_load",
        F.coalesce(F.col("upstream_load") > F.col("loaded_at"), F.lit(False)).alias("stale"),
    )


def target_conflicts(jobs: DataFrame, models: DataFrame) -> DataFrame:
    """Raw tables claimed by two jobs, or named like a model."""
    doubled = jobs.groupBy("target").agg(F.count(F.lit(1)).alias("jobs")).filter("jobs > 1").select(
        "target", F.lit("two_jobs").alias("reason")
    )
    named = models.filter("dbt_type <> 'source'").select(F.col("id").alias("target"))
    shadow = jobs.select("target").distinct().join(named, "target", "left_semi").select(
        "target", F.lit("model_name").alias("reason")
    )
    return doubled.unionAll(shadow)


def drop_impact(
    ids: DataFrame, edges: DataFrame, flow_targets: DataFrame, usage: DataFrame
) -> DataFrame:
    """What blocks removing each model: one row per blocker."""
    wanted = ids.select(F.col("id").alias("_w")).distinct()

    def blockers(df: DataFrame, key: str, who: str, kind: str) -> DataFrame:
        picked = df.select(F.col(key).alias("id"), F.col(who).alias("blocker")).distinct()
        hit: Column = picked["id"] == wanted["_w"]
        return picked.join(wanted, hit, "left_semi").withColumn("kind", F.lit(kind))

    return (
        blockers(edges, "src", "dst", "model")
        .unionByName(blockers(flow_targets, "id", "flow", "flow"))
        .unionByName(blockers(usage, "id", "analysis", "analysis"))
        .select("id", "kind", "blocker")
    )


def stored(edges: DataFrame, by: str | None = None) -> DataFrame:
    """Write a derived edge table once, before walks that read it every round; ``by`` lays it out for walks from that end."""
    return cut_by(edges, [by], "edges", distinct=True) if by else cut(edges, "edges")
