"""Storage accounting over object listings, live file lists and snapshot metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import texts


def table_objects(objects: DataFrame) -> DataFrame:
    """Objects that belong to a table, with schema, table and area; others are left out."""
    return objects.withColumn("_k", texts.object_key(F.col("path"))).filter(
        F.col("_k").isNotNull()
    ).select("path", "length", "_k.schema", "_k.table", "_k.area")


def table_bytes(objects: DataFrame) -> DataFrame:
    data = F.col("area") == "data"
    return table_objects(objects).groupBy("schema", "table").agg(
        F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("objects"),
        F.coalesce(F.sum(F.when(data, F.col("length"))), F.lit(0)).alias("data_bytes"),
        F.coalesce(F.sum(F.when(~data, F.col("length"))), F.lit(0)).alias("metadata_bytes"),
    )


def classify_storage(in_catalog: Column, schema: Column, table: Column, observed: Sequence[str]) -> Column:
    """catalog, then temp, then observability, else orphan: the first match wins."""
    return (
        F.when(in_catalog, "catalog").when(table.contains("__tmp_"), "temp")
        .when(schema.isin(list(observed)), "observability").otherwise("orphan")
    )


def stale_bytes(
    objects: DataFrame, models: DataFrame, live: DataFrame, *, observed: Sequence[str] = ()
) -> DataFrame:
    """Per table: what lies in storage, what the current version uses, and the stale remainder.

    ``models(phys)`` is the catalog, ``live(phys, bytes)`` the current files of tables that could be
    asked. Unknown live size is null, and a catalog table never built is zeros with live null.
    """
    stored = table_bytes(objects).withColumn("phys", F.concat("schema", F.lit("."), "table"))
    known = models.select(F.col("phys").alias("_phys")).distinct()
    now = live.groupBy(F.col("phys").alias("_live")).agg(F.sum("bytes").alias("_lb"))
    joined = stored.join(known, F.col("phys") == F.col("_phys"), "full")
    phys = F.coalesce("phys", "_phys")
    full = joined.withColumn("phys", phys).join(
        now, (F.col("phys") == F.col("_live")) & F.col("bytes").isNotNull() & F.col("_phys").isNotNull(), "left"
    )
    schema = F.coalesce("schema", F.substring_index("phys", ".", 1))
    table = F.coalesce("table", F.substring_index("phys", ".", -1))
    return full.select(
        "phys", schema.alias("schema"), table.alias("table"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("bytes", "objects", "data_bytes", "metadata_bytes")],
        F.col("_lb").alias("live_bytes"),
        F.when(F.col("_lb").isNotNull(), F.greatest(F.coalesce("bytes", F.lit(0)) - F.col("_lb"), F.lit(0)))
        .alias("stale_bytes"),
        classify_storage(F.col("_phys").isNotNull(), schema, table, observed).alias("kind"),
    )


def by_kind(tables: DataFrame) -> DataFrame:
    return tables.groupBy("kind").agg(
        F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("tables"), F.sum("objects").alias("objects")
    )


def by_schema(tables: DataFrame) -> DataFrame:
    """Per schema; live bytes are null (not known) when no table of the schema could be asked."""
    cat = F.col("kind") == "catalog"
    return tables.groupBy("schema").agg(
        F.sum("bytes").alias("bytes"), F.sum("live_bytes").alias("live_bytes"),
        F.count(F.lit(1)).alias("tables"), F.count_if(cat).alias("catalog_tables"),
        F.sum("objects").alias("objects"),
    ).withColumn("primary", F.col("catalog_tables") > 0)


def storage_totals(tables: DataFrame) -> DataFrame:
    """Live and stale bytes of catalog tables and what could be reclaimed."""

    def total(kind: str, col: str = "bytes") -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(col))), F.lit(0))

    summed = tables.agg(
        F.sum("bytes").alias("table_bytes"), total("catalog", "live_bytes").alias("live_bytes"),
        total("catalog").alias("_cat"), total("temp").alias("temp_bytes"), total("orphan").alias("orphan_bytes"),
    )
    stale = F.greatest(F.col("_cat") - F.col("live_bytes"), F.lit(0))
    return summed.select(
        "table_bytes", "live_bytes", stale.alias("stale_bytes"), "temp_bytes", "orphan_bytes",
        (stale + F.col("temp_bytes") + F.col("orphan_bytes")).alias("reclaimable"),
    )


def schema_share_with_other(schemas: DataFrame, objects: DataFrame) -> DataFrame:
    """Bytes per primary schema, and one row for everything else in the store."""
    primary = schemas.filter("primary").select("schema", "bytes", F.col("catalog_tables").alias("tables"))
    whole = objects.agg(F.sum("length").alias("b")).scalar()
    rest = schemas.agg(
        F.coalesce(F.sum(F.when(F.col("primary"), F.col("bytes"))), F.lit(0)).alias("_p"),
        F.coalesce(F.sum(F.when(~F.col("primary"), F.col("tables"))), F.lit(0)).alias("tables"),
    ).select(
        F.lit("other").alias("schema"),
        F.greatest(F.coalesce(whole, F.lit(0)) - F.col("_p"), F.lit(0)).alias("bytes"), "tables",
    )
    return primary.unionByName(rest.filter("bytes > 0"))


def load_times(
    data_files: DataFrame, tables: DataFrame, schemas: DataFrame, snapshots: DataFrame
) -> DataFrame:
    """Last load per living table: files ⋈ tables ⋈ schemas ⋈ snapshots.

    Only the newest snapshot of a table matters when snapshot ids grow with time, but that is not
    promised, so times are joined first and the maximum is taken per table id before names are added.
    """
    files = data_files.select("table_id", F.col("begin_snapshot").alias("snapshot_id")).distinct()
    newest = files.join(snapshots, "snapshot_id").groupBy("table_id").agg(
        F.max("snapshot_time").alias("loaded_at")
    )
    living = tables.filter("end_snapshot IS NULL").select("table_id", "schema_id", "table_name")
    named = schemas.filter("end_snapshot IS NULL").select("schema_id", "schema_name")
    joined = newest.join(living, "table_id").join(named, "schema_id")
    phys = F.concat("schema_name", F.lit("."), "table_name")
    return joined.groupBy(phys.alias("phys")).agg(F.max("loaded_at").alias("loaded_at"))
