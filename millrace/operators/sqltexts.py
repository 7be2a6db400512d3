"""Checks over a table of model SQL texts ``(id, sql)``, by pattern only: nothing is parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import texts


def extract_refs(models: DataFrame) -> DataFrame:
    """Edge rows ``(id, kind, target, pos)`` for ``ref()`` and ``source()`` calls outside comments."""
    refs = models.select(
        "id", F.lit("ref").alias("kind"), F.posexplode(texts.referenced_models(F.col("sql"))).alias("pos", "target")
    )
    sources = models.select(
        "id", F.lit("source").alias("kind"), F.posexplode(texts.referenced_sources(F.col("sql"))).alias("pos", "target")
    )
    return refs.unionByName(sources).select("id", "kind", "target", "pos")


def audit_sql(models: DataFrame, known: DataFrame) -> DataFrame:
    """Counts and verdict per model: one statement, no DDL or DML, a select, only known refs.

    Unknown references are found by joining the reference rows to the known ids, so neither side is
    gathered; a model's own unknown references (a handful) come back as a list in call order.
    """
    scan = texts.TokenScan(F.col("_t"))
    counted = models.select("id", texts.sql_tokens(F.col("sql")).alias("_t")).select(
        "id", scan.statements().alias("statements"), scan.ctes().alias("ctes"),
        scan.selects().alias("selects"), scan.change().alias("ddl"),
    )
    refs = extract_refs(models).filter("kind = 'ref'")
    unknown = refs.join(known.select(F.col("id").alias("_known")), F.col("target") == F.col("_known"), "left_anti")
    missing = unknown.groupBy(F.col("id").alias("_m")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "target"))), lambda r: r["target"]).alias("missing")
    )
    out = counted.join(missing, F.col("id") == F.col("_m"), "left").drop("_m").withColumn(
        "missing", F.coalesce("missing", F.expr("CAST(array() AS array<string>)"))
    )
    errors = F.array_compact(F.array(
        F.when(F.col("statements") > 1, F.concat(F.col("statements").cast("string"), F.lit(" statements; a model is one"))),
        F.when(F.col("ddl").isNotNull(), F.concat(F.col("ddl"), F.lit(" is not allowed"))),
        F.when(F.col("selects") == 0, F.lit("no select")),
        F.when(F.size("missing") > 0, F.concat(F.lit("unknown references: "), F.concat_ws(", ", "missing"))),
    ))
    return out.withColumn("errors", errors).withColumn("ok", F.size("errors") == 0)
