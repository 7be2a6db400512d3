"""Raw files as all-string rows: delimited text, JSON Lines, and text in more than one encoding."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.durable import cut
from millrace.plans.ordered import running

SAMPLE_ROWS = 50
_BOM = "﻿"
_FILE, _BLOCK, _ID = "_file", "_block", "_line"


def read_csv_raw(
    spark: SparkSession, path: str, *, delimiter: str = ",", multiline: bool = True, place: str | None = None
) -> DataFrame:
    """Header CSV, every column a string, header names stripped, nameless columns dropped.

    An empty cell is ``""``; Spark's reader cannot tell it from a cell a short row lacks, so that
    becomes ``""`` too. Line breaks inside quotes are part of a cell, so a file is read by one task; ``multiline=False``
    splits large files over tasks and is right only where no cell holds a line break.
    ``place`` names a column to add that orders the rows as they stand in the files.
    """
    options = {"sep": delimiter, "escape": '"', "multiLine": multiline}
    raw = spark.read.options(header=True, **options).csv(path)
    # Spark renames blank and equal headers; the header line itself says which are which. The last of equal names wins.
    top = spark.read.options(header=False, **options).csv(path).first()
    header = [(cell or "").replace(_BOM, "").strip() for cell in top] if top else []
    chosen = {name: given for name, given in zip(header, raw.columns) if name}
    named = [F.col(f"`{given}`").alias(name) for name, given in chosen.items()]
    return raw.select(*named, *([_place().alias(place)] if place else [])).na.fill("")


def _place() -> Column:
    """Where a row stands: file, block, number within what a task reads."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))


def require_rows(df: DataFrame, what: str = "rows") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what} to read; check the header line and the delimiter")
    return df


def sample(df: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    return df.limit(rows)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with what is needed to put them back in file order."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias(_FILE),
        F.col("_metadata.file_block_start").alias(_BLOCK),
        F.monotonically_increasing_id().alias(_ID),
    )


def _as_map(line: Column) -> Column:
    return F.from_json(line, "map<string,string>")


def _malformed(line: Column) -> Column:
    looks_object = F.ltrim(line).startswith("{")
    return F.when(looks_object, _as_map(line).isNull()).otherwise(F.try_parse_json(line).isNull())


def jsonl_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON object: ``record`` (map of strings) and its file position.

    Blank lines and non-objects are skipped; a malformed line stops the query, naming the line's
    text (:func:`jsonl_bad_lines` gives its number).
    """
    lines = _lines(spark, path).filter(F.trim("value") != "")
    checked = lines.withColumn(
        "value",
        F.when(
            _malformed(F.col("value")),
            F.raise_error(F.concat(F.lit("line is not JSON: "), F.col("value"))),
        ).otherwise(F.col("value")),
    )
    return checked.filter(F.ltrim("value").startswith("{")).select(
        _as_map(F.col("value")).alias("record"), _FILE, _BLOCK, _ID
    )


def jsonl_bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """Malformed lines with their 1-based number in their file."""
    lines = _lines(spark, path)
    numbered = running(lines, [_FILE], [_BLOCK, _ID], number="line_number")
    return numbered.filter((F.trim("value") != "") & _malformed(F.col("value"))).select(
        F.col(_FILE).alias("file"), "line_number", "value"
    )


def infer_raw_columns(records: DataFrame, record: str = "record", *order: str) -> DataFrame:
    """Union of record keys with where each was first seen; every type is string."""
    keyed = records.select(*order, F.posexplode(F.map_keys(record)).alias("_slot", "name"))
    return keyed.groupBy("name").agg(
        F.min(F.struct(*order, "_slot")).alias("first_seen"), F.lit("string").alias("type")
    )


def column_names(inferred: DataFrame) -> list[str]:
    """The inferred names in first-seen order (a schema, so small enough for the driver)."""
    return [r["name"] for r in inferred.orderBy("first_seen").select("name").collect()]


def record_columns(records: DataFrame, columns: Sequence[str], record: str = "record") -> DataFrame:
    keep = [c for c in records.columns if c != record]
    return records.select(*[F.try_element_at(record, F.lit(c)).alias(c) for c in columns], *keep)


def read_jsonl_raw(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, *, place: str | None = None
) -> DataFrame:
    """JSON Lines as string columns; without ``columns`` the keys are collected first. ``place`` as for CSV."""
    records = jsonl_records(spark, path)
    names = columns or column_names(infer_raw_columns(records, "record", _FILE, _BLOCK, _ID))
    if not names:
        raise ValueError("no records to read")
    if place:
        records = records.withColumn(place, F.struct(_FILE, _BLOCK, _ID))
    return record_columns(records, names).drop(_FILE, _BLOCK, _ID)


def _decode_korean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for raw in batches:
        yield raw.map(lambda b: None if b is None else bytes(b).decode("cp949"))


def read_text_with_fallback(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files that are UTF-8 (with or without BOM) or, failing that, cp949.

    Files are read line by line, so a large one is split over tasks; the encoding is decided per
    file, from all of its lines. Only the lines of the other files go through Python.
    """
    lines = _lines(spark, path)
    # One row per file, written so that its true size decides how it is joined.
    utf8 = cut(lines.groupBy(_FILE).agg(F.bool_and(F.is_valid_utf8("value")).alias("_utf8")), "encodings")
    marked = lines.join(utf8, _FILE)
    good = marked.filter("_utf8").withColumn("value", F.regexp_replace("value", f"^{_BOM}", ""))
    # Non-deterministic, or a filter on the decoded text would be pushed below the join and the
    # decoder would see the UTF-8 lines as well.
    decode = F.pandas_udf(_decode_korean, "string").asNondeterministic()
    other = marked.filter("NOT _utf8").withColumn("value", decode(F.col("value").cast("binary")))
    return good.unionByName(other).select(
        "value", F.col(_FILE).alias("file"), F.col(_BLOCK).alias("block"), F.col(_ID).alias("line"),
        F.when(F.col("_utf8"), "utf-8").otherwise("cp949").alias("encoding"),
    )


def delimited_columns(lines: DataFrame, header: Sequence[str], *, delimiter: str = ",") -> DataFrame:
    """Decoded lines as string columns; each file's header line is left out."""
    schema = ", ".join(f"`{h.strip()}` string" for h in header)
    body = lines.filter(F.col("value") != delimiter.join(header))
    parsed = F.from_csv("value", F.lit(schema), {"sep": delimiter, "escape": '"'})
    return body.select(parsed.alias("_r")).select("_r.*").na.fill("")
