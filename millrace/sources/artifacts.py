"""Run artifacts and project manifests as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.durable import cut

_RESULTS = (
    "results array<struct<unique_id:string,status:string,execution_time:double,message:string,"
    "adapter_response:struct<rows_affected:bigint>,failures:bigint>>"
)


def read_run_artifacts(
    spark: SparkSession, root: str, *, pattern: str = "*/run_results.json", multiline: bool = True
) -> DataFrame:
    """Last result per node over all artifact files of a run; unreadable files are passed over.

    A model or seed is keyed by its name, anything else by its full id. Files count in path order,
    a later one (and within it a later entry) replaces the earlier.
    """
    docs = spark.read.schema(_RESULTS).option("multiLine", multiline).json(f"{root}/{pattern}")
    rows = docs.select(
        F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_doc"),
        F.posexplode("results").alias("_pos", "r"),
    )
    parts = F.split("r.unique_id", r"\.")
    kind = parts[0]
    keyed = rows.filter(F.size(parts) >= 3).select(
        F.when(kind.isin("model", "seed"), F.element_at(parts, -1)).otherwise(F.col("r.unique_id")).alias("key"),
        F.struct(
            "_file", "_doc", "_pos", "r.unique_id", kind.alias("resource_type"), "r.status",
            "r.execution_time", "r.message", F.col("r.adapter_response.rows_affected").alias("rows_affected"),
            "r.failures",
        ).alias("r"),
    )
    return keyed.groupBy("key").agg(F.max("r").alias("r")).select("key", "r.*").drop("_file", "_doc", "_pos")


_NODE = (
    "name string, resource_type string, package_name string, schema string, alias string, "
    "description string, original_file_path string, column_name string, attached_node string, "
    "tags array<string>, config struct<materialized:string,severity:string>, "
    "depends_on struct<nodes:array<string>>, test_metadata struct<name:string,kwargs:map<string,string>>, "
    "columns map<string,struct<description:string,data_type:string,meta:struct<label:string>>>"
)


def manifest_nodes(spark: SparkSession, path: str) -> DataFrame:
    """A manifest file's entries as rows ``(uid, section, node)``, the node as JSON text."""
    schema = (
        "nodes map<string,string>, sources map<string,string>, disabled map<string,array<string>>"
    )
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    parts = [
        doc.select(F.explode(s).alias("uid", "node"), F.lit(s).alias("section")) for s in ("nodes", "sources")
    ]
    off = doc.select(F.explode("disabled").alias("uid", "_n")).select(
        "uid", F.explode("_n").alias("node"), F.lit("disabled").alias("section")
    )
    return parts[0].unionByName(parts[1]).unionByName(off).select("uid", "section", "node")


def _with_physical(columns: DataFrame, physical: DataFrame) -> DataFrame:
    """Documented columns typed by the warehouse where the text gives no type, then the undocumented ones.

    One grouped pass brings both descriptions of a column together; ``pos`` keeps the documented order first and the
    warehouse's order after it, with gaps.
    """
    last = columns.groupBy(F.col("model_id").alias("_m")).agg((F.max("pos") + 1).alias("_next"))
    known = physical.join(last, F.col("model_id") == F.col("_m"), "left").select(
        "model_id", (F.coalesce("_next", F.lit(0)) + F.col("pos")).alias("pos"), "name", F.col("name").alias("label"),
        F.upper(F.coalesce("type", F.lit(""))).alias("type"), F.lit(False).alias("required"), F.lit(1).alias("_rank"),
    )
    both = columns.withColumn("_rank", F.lit(0)).unionByName(known)
    merged = both.groupBy("model_id", "name").agg(
        F.min_by(F.struct("pos", "label", "type", "required"), "_rank").alias("c"),
        F.max_by("type", "_rank").alias("_type"),
    )
    return merged.select(
        "model_id", "c.pos", "name", "c.label",
        F.when(F.col("c.type") != "", F.col("c.type")).otherwise(F.col("_type")).alias("type"), "c.required",
    )


def read_manifest(nodes: DataFrame, package: str, physical: DataFrame | None = None) -> dict[str, DataFrame]:
    """``models``, ``edges``, ``rules`` and ``columns`` of one package from its manifest entries.

    A generic test hangs on its attached node, a singular one on everything it depends on; disabled
    tests stay, marked. A column is required when an enabled, error-level not_null hangs on it.
    ``physical(uid, pos, name, type)`` are the columns the warehouse has: they fill in missing types, and those nobody
    documented follow the documented ones. The entries are parsed once and written, since every part reads them several
    times.
    """
    parsed = nodes.select("uid", "section", F.from_json("node", _NODE).alias("n"))
    n = cut(parsed.filter(F.col("n.package_name") == package), "manifest")
    rtype = F.when(F.col("section") == "sources", "source").otherwise(F.col("n.resource_type"))
    alias = F.coalesce("n.alias", "n.name")
    wanted = ((F.col("section") == "nodes") & rtype.isin("model", "seed")) | (F.col("section") == "sources")
    entries = n.filter(wanted).select(
        "uid", F.col("n.name").alias("id"), rtype.alias("dbt_type"),
        F.when(F.coalesce("n.schema", F.lit("")) != "", F.concat("n.schema", F.lit("."), alias)).otherwise(alias).alias("phys"),
        F.when(rtype == "model", "DATA MODEL").otherwise("SOURCE").alias("group"),
        F.coalesce("n.config.materialized", F.when(rtype == "seed", "seed").otherwise("")).alias("mat"),
        F.coalesce("n.original_file_path", F.lit("")).alias("path"),
        F.trim(F.coalesce("n.description", F.lit(""))).alias("desc"),
        "n.tags", F.col("n.depends_on.nodes").alias("_deps"), F.col("n.columns").alias("_cols"),
    )
    ids = entries.select(F.col("uid").alias("_uid"), F.col("id").alias("_id"))
    edges = (
        entries.select(F.col("id").alias("dst"), F.explode("_deps").alias("_d"))
        .join(ids, F.col("_d") == F.col("_uid")).select(F.col("_id").alias("src"), "dst").distinct()
    )
    tests = n.filter((F.col("n.resource_type") == "test") & F.col("section").isin("nodes", "disabled")).select(
        "uid", F.col("n.name").alias("name"), F.coalesce("n.test_metadata.name", F.lit("singular")).alias("check_name"),
        F.coalesce("n.column_name", F.lit("")).alias("col"),
        F.lower(F.coalesce("n.config.severity", F.lit("ERROR"))).alias("severity"),
        F.map_filter("n.test_metadata.kwargs", lambda k, v: ~k.isin("model", "column_name")).alias("kwargs"),
        F.col("n.test_metadata").isNull().alias("singular"), (F.col("section") == "nodes").alias("enabled"),
        F.col("n.attached_node").alias("_attached"), F.col("n.depends_on.nodes").alias("_deps"),
    )
    hung = tests.join(ids.withColumnRenamed("_uid", "_a"), F.col("_attached") == F.col("_a"), "left")
    attached = hung.filter(F.col("_id").isNotNull()).withColumnRenamed("_id", "model_id").drop("_a")
    loose = (
        hung.filter(F.col("_id").isNull()).drop("_id", "_a").withColumn("_d", F.explode("_deps"))
        .join(ids, F.col("_d") == F.col("_uid")).withColumnRenamed("_id", "model_id").drop("_d", "_uid")
    )
    rules = attached.unionByName(loose).select(
        "uid", "name", "check_name", "col", "severity", "kwargs", "singular", "enabled", "model_id"
    ).dropDuplicates(["uid", "model_id"])
    required = rules.filter("check_name = 'not_null' AND col <> '' AND severity = 'error' AND enabled").select(
        F.col("model_id").alias("_rm"), F.col("col").alias("_rc")
    ).distinct()
    columns = (
        entries.select(F.col("id").alias("model_id"), F.posexplode("_cols").alias("pos", "name", "c"))
        .join(required, (F.col("model_id") == F.col("_rm")) & (F.col("name") == F.col("_rc")), "left")
        .select(
            "model_id", "pos", "name",
            F.coalesce(F.nullif(F.trim("c.meta.label"), F.lit("")), F.col("name")).alias("label"),
            F.upper(F.coalesce("c.data_type", F.lit(""))).alias("type"), F.col("_rc").isNotNull().alias("required"),
        )
    )
    if physical is not None:
        owned = physical.join(ids, F.col("uid") == F.col("_uid")).select(F.col("_id").alias("model_id"), "pos", "name", "type")
        columns = _with_physical(columns, owned)
    return {
        "models": entries.drop("_deps", "_cols"), "edges": edges, "rules": rules, "columns": columns,
    }
