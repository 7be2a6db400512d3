"""Row numbers, running sums and previous-row lookups that never put one key into one task.

A plain window sends a whole partition key to a single task. Here rows are range-partitioned by
(keys, order), so a key holding a third of the table spans many partitions, and each piece is
scanned on its own. What a piece must know of the pieces before it (their count, sums, last row)
is put in front of it as one extra row, so the stitching needs no join and no second shuffle.
The order columns must be unique within a key, else equal rows are numbered arbitrarily.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.durable import cut

_PART, _SLOT = "_part", "_slot"
_HEAD = -1  # the slot of the extra row in front of a piece


def _layout(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Rows tagged with their range partition and a slot that increases along (keys, order)."""
    by = [F.col(k) for k in keys] + [F.col(o) if isinstance(o, str) else o for o in order]
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by)
    tagged = placed.withColumn(_PART, F.spark_partition_id()).withColumn(
        _SLOT, F.monotonically_increasing_id()
    )
    return cut(tagged, "layout")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    *,
    number: str | None = None,
    sums: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add a 1-based row number and/or inclusive running sums per key, in the given order."""
    sums = dict(sums or {})
    laid = _layout(df, keys, order)
    piece = [*keys, _PART]
    # One summary row per (key, partition): a key's rows here are at most one per partition.
    totals = laid.groupBy(*piece).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_v_{o}") for o, c in sums.items()]
    )
    across = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = across.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select(
        *piece,
        F.lit(_HEAD).cast("long").alias(_SLOT),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
        *[F.coalesce(F.sum(f"_v_{o}").over(before), F.lit(0)).alias(f"_v_{o}") for o in sums],
    )
    rows = laid.select(
        "*", F.lit(1).cast("long").alias("_n"), *[F.col(c).alias(f"_v_{o}") for o, c in sums.items()]
    )
    upto = Window.partitionBy(*piece).orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = rows.unionByName(heads, allowMissingColumns=True)
    outputs = [F.col(c) for c in df.columns]
    for out, source in [*([(number, "_n")] if number else []), *[(o, f"_v_{o}") for o in sums]]:
        scanned = scanned.withColumn(f"_r_{out}", F.sum(source).over(upto))
        outputs.append(F.col(f"_r_{out}").alias(out))
    return scanned.filter(F.col(_SLOT) != _HEAD).select(*outputs)


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    cols: Mapping[str, str],
    *,
    first: str = "is_first",
) -> DataFrame:
    """Add each row's predecessor values within its key (null on the first row, flagged)."""
    laid = _layout(df, keys, order)
    piece = [*keys, _PART]
    carried = F.struct(*[F.col(c).alias(o) for o, c in cols.items()])
    tails = laid.groupBy(*piece).agg(F.max_by(carried, _SLOT).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy(_PART)
    heads = tails.select(*piece, F.lit(_HEAD).cast("long").alias(_SLOT), F.lag("_tail").over(across).alias("_row"))
    rows = laid.withColumn("_row", carried)
    scanned = rows.unionByName(heads.filter(F.col("_row").isNotNull()), allowMissingColumns=True)
    along = Window.partitionBy(*piece).orderBy(_SLOT)
    looked = scanned.withColumn("_prev", F.lag("_row").over(along)).filter(F.col(_SLOT) != _HEAD)
    return looked.select(
        *[F.col(c) for c in df.columns],
        *[F.col(f"_prev.{o}").alias(o) for o in cols],
        F.col("_prev").isNull().alias(first),
    )


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Global 1-based numbering in the given order without a single-task window."""
    return running(df, [], order, number=name)
