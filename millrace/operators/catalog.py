"""Catalog views over model, mart, folder and usage tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import status as st
from millrace.functions import texts

# Catalog groups in display order.
GROUP_ORDER = {"SOURCE": 0, "DATA MODEL": 1, "DATA MART": 2}


def classify_layer(kind: Column, is_mart: Column, path: Column) -> Column:
    """Source → raw, marked → mart, a staging path → staged, everything else → analysis."""
    return (
        F.when(kind == "source", "raw").when(is_mart, "mart")
        .when(F.coalesce(path, F.lit("")).contains("/staging/"), "staged").otherwise("analysis")
    )


def group_rank(group: Column) -> Column:
    out = F.lit(9)
    for name, i in GROUP_ORDER.items():
        out = F.when(group == name, F.lit(i)).otherwise(out)
    return out


def _with_marts(models: DataFrame, marts: DataFrame) -> DataFrame:
    marked = marts.select(F.col("id").alias("_mart")).distinct()
    out = models.join(marked, F.col("id") == F.col("_mart"), "left")
    is_mart = F.col("_mart").isNotNull()
    base = F.when(F.col("dbt_type") == "model", "DATA MODEL").otherwise("SOURCE")
    return out.withColumn("is_mart", is_mart).withColumn(
        "group", F.when(is_mart, "DATA MART").otherwise(base)
    ).drop("_mart")


def catalog_view(
    models: DataFrame, edges: DataFrame, marts: DataFrame, folders: DataFrame, rule_state: DataFrame,
    *, search: str | None = None,
) -> DataFrame:
    """Models with group, layer, folder, active-rule quality, rule and neighbour counts."""
    out = models
    if search:
        out = out.filter(texts.contains_any(search, [F.col("name"), F.col("phys"), F.col("desc")]))
    out = _with_marts(out, marts)
    quality = rule_state.groupBy(F.col("model_id").alias("_q")).agg(
        st.worst(F.when(F.col("active"), F.col("status"))).alias("quality_status"),
        F.count(F.lit(1)).alias("test_count"),
    )
    ups = edges.groupBy(F.col("dst").alias("_d")).agg(F.count(F.lit(1)).alias("upstream_count"))
    downs = edges.groupBy(F.col("src").alias("_s")).agg(F.count(F.lit(1)).alias("downstream_count"))
    placed = folders.select(F.col("model_id").alias("_f"), "folder_id")
    joined = (
        out.join(placed, F.col("id") == F.col("_f"), "left")
        .join(quality, F.col("id") == F.col("_q"), "left")
        .join(ups, F.col("id") == F.col("_d"), "left")
        .join(downs, F.col("id") == F.col("_s"), "left")
    )
    kind = F.when(F.col("dbt_type") == "model", "model").otherwise("source")
    return joined.select(
        "id", "name", "phys", "group", "is_mart", classify_layer(kind, F.col("is_mart"), F.col("path")).alias("layer"),
        "folder_id", F.coalesce("quality_status", F.lit("ok")).alias("quality_status"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("test_count", "upstream_count", "downstream_count")],
    )


def ordered_catalog(view: DataFrame) -> DataFrame:
    return view.orderBy(group_rank(F.col("group")), "name", "id")


def by_next_run(flows: DataFrame, at: str = "next_run") -> DataFrame:
    """Soonest first; a flow without a next run comes last."""
    return flows.orderBy(F.col(at).asc_nulls_last(), "id")


def usage_counts(items: DataFrame, key: str, groups: DataFrame, group_key: str) -> DataFrame:
    """Items per group, with zero for groups that have none."""
    counted = items.groupBy(F.col(key).alias("_g")).agg(F.count(F.lit(1)).alias("items"))
    return groups.join(counted, F.col(group_key) == F.col("_g"), "left").select(
        *groups.columns, F.coalesce("items", F.lit(0)).alias("items")
    )


def volume_rollup(tables: DataFrame) -> DataFrame:
    """Tables, rows and uncounted tables by schema, by group and in total, from one pass.

    ``tables(schema, group, rows)``; a null row count means the table was never built.
    """
    rolled = tables.groupingSets([["schema"], ["group"], []], "schema", "group").agg(
        F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("tables"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count_if(F.col("rows").isNull()).alias("unknown"),
    )
    axis = F.when(F.col("_g") == 1, "schema").when(F.col("_g") == 2, "group").otherwise("total")
    return rolled.select(
        axis.alias("axis"), F.coalesce("schema", "group", F.lit("all")).alias("key"), "tables", "rows", "unknown"
    )


def semi_catalog(rows: DataFrame, key: str, models: DataFrame) -> DataFrame:
    """Rows whose model still exists."""
    return rows.join(models.select(F.col("id").alias(key)), key, "left_semi")


def anti_catalog(mapped: DataFrame, models: DataFrame) -> DataFrame:
    """Both gaps: mapped but gone from the catalog, and in the catalog but unmapped."""
    ids = models.select("id").distinct()
    known = mapped.select("id").distinct()
    gone = known.join(ids, "id", "left_anti").withColumn("gap", F.lit("gone"))
    return gone.unionByName(ids.join(known, "id", "left_anti").withColumn("gap", F.lit("unmapped")))


def asset_models(assets: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Models behind each dashboard (first position kept) and the datasets it uses without a model.

    ``assets(asset, pos, dataset_id)``, ``mapping(dataset_id, id)``.
    """
    m = mapping.select(F.col("dataset_id").alias("_ds"), "id")
    joined = assets.join(m, F.col("dataset_id") == F.col("_ds"), "left")
    models = joined.filter(F.col("id").isNotNull()).groupBy("asset", "id").agg(F.min("pos").alias("pos"))
    counts = joined.groupBy("asset").agg(
        F.count_if(F.col("id").isNull()).alias("unmapped"), F.count_distinct("id").alias("models")
    )
    return models, counts


def source_consumers(jobs: DataFrame, edges: DataFrame, flow_targets: DataFrame) -> DataFrame:
    """Connector → models reading its source → flows that build those models."""
    reads = jobs.join(edges, F.col("target") == F.col("src")).select(
        F.col("id").alias("job"), F.col("dst").alias("model")
    ).distinct()
    builds = flow_targets.select(F.col("id").alias("_m"), "flow").distinct()
    return reads.join(builds, F.col("model") == F.col("_m"), "left").select("job", "model", "flow")


def model_flows(flow_nodes: DataFrame, model_id: str) -> DataFrame:
    """Flows whose run order holds the model."""
    return flow_nodes.filter((F.col("id") == model_id) & F.col("executable")).select("flow").distinct()


def node_runs(
    order: DataFrame, results: DataFrame, tasks: DataFrame, tests: DataFrame, rule_targets: DataFrame
) -> DataFrame:
    """One state row per (flow, model) of the latest run; the first flow in order wins a model.

    ``order(flow, flow_pos, id)``, ``results(flow, id, status, seconds, rows)``, ``tasks(flow, id,
    state, try_number)``, ``tests(flow, uid, status)``, ``rule_targets(uid, id)``. Failed tests are
    matched by unique id, not by name.
    """
    failed = (
        tests.filter(F.col("status").isin("fail", "error")).select("flow", "uid").distinct()
        .join(rule_targets, "uid").groupBy(F.col("flow").alias("_tf"), F.col("id").alias("_ti"))
        .agg(F.count(F.lit(1)).alias("_failed"))
    )
    r = results.select(F.col("flow").alias("_rf"), F.col("id").alias("_ri"), F.col("status").alias("_rs"), "seconds", "rows")
    t = tasks.select(F.col("flow").alias("_kf"), F.col("id").alias("_ki"), F.col("state").alias("_ks"), "try_number")
    joined = (
        order.join(r, (F.col("flow") == F.col("_rf")) & (F.col("id") == F.col("_ri")), "left")
        .join(t, (F.col("flow") == F.col("_kf")) & (F.col("id") == F.col("_ki")), "left")
        .join(failed, (F.col("flow") == F.col("_tf")) & (F.col("id") == F.col("_ti")), "left")
    )
    n = F.coalesce("_failed", F.lit(0))
    state = st.node_state(F.col("_rs"), F.col("_ks"), n > 0)
    shaped = joined.select(
        "id", "flow_pos", "flow", state.alias("state"), n.alias("failed_tests"), "seconds", "rows",
        F.coalesce("try_number", F.lit(1)).alias("try_number"),
    )
    first = F.min(F.struct(*[c for c in shaped.columns if c != "id"])).alias("_n")
    return shaped.groupBy("id").agg(first).select("id", "_n.*").drop("flow_pos")
