"""Exact continuous percentiles by distributed selection, for groups of any size.

No group's values are ever in one place. A pass counts the rows of every group in numbered buckets that keep the order
of the values; the counts tell in which bucket a wanted rank lies, and only the rows of that bucket go on. Buckets of
the first pass are sixteenths of an octave, so they fit any range of doubles; those of a later pass divide what lies
between the least and the greatest value of the bucket before, so a pass always narrows, for all groups at once, and
three of them reach the resolution of a double. A rank is found when its bucket holds one value. What a task orders is
the counts of one bucket's parts, a bounded number; the rows themselves are only counted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.plans.durable import cut

#: Buckets an octave in the first pass, and parts of a bucket in later ones.
_PER_OCTAVE = 16
_PARTS = 1 << 20
#: Above the number of any octave a double has.
_ABOVE = 1100 * _PER_OCTAVE


@dataclass(frozen=True)
class Quantile:
    name: str
    value: Column
    p: float


def grouped(
    df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], quantiles: Sequence[Quantile]
) -> DataFrame:
    """``groupBy(keys).agg(aggs)`` plus one exact percentile column per entry of ``quantiles``.

    Nulls are not counted and a group without a value has a null percentile; NaN is the greatest value.
    """
    plain = df.groupBy(*keys).agg(*aggs) if aggs or not quantiles else df.select(*keys).distinct()
    if not quantiles:
        return plain
    values = _selected(df, keys, quantiles)
    return _beside(plain, values, keys) if keys or aggs else values


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two aggregations over the same groups side by side; a group ``right`` lacks has nulls."""
    if keys:
        return _join(left, right, list(keys), how="left")
    packed = right.select(F.struct("*").alias("_x")).scalar()
    return left.withColumn("_x", packed).select(*map(_q, left.columns), "_x.*")


def _first_bucket(v: Column) -> Column:
    """The number of a value's bucket in the first pass; greater values never have a smaller one."""
    size = F.floor(F.log2(F.abs(v)) * _PER_OCTAVE) + _ABOVE
    beyond = F.lit(2 * _ABOVE)
    return (
        F.when(F.isnan(v), beyond + 1).when(v == float("inf"), beyond).when(v == float("-inf"), -beyond)
        .when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")
    )


def _next_bucket(v: Column) -> Column:
    """The number of a value's part between the ends of its bucket."""
    return F.floor((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * _PARTS).cast("long")


def _narrowed(rows: DataFrame, wanted: DataFrame | None, quantiles: Sequence[Quantile], keys: list[str]) -> DataFrame:
    """(keys, _m, _size, _t, _rank, _lo, _hi): each wanted rank in the bucket where it lies; ``_size`` counts the values.

    ``rows`` has (keys, _m, _at, _v, _b): a value ``_v`` of measure ``_m`` in the part ``_b`` of the bucket that starts
    with ``_at``. ``wanted`` is the result of the pass before, None before the first.
    """
    bucket = [*keys, "_m", "_at"]
    counts = rows.groupBy(*bucket, "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    before = Window.partitionBy(*bucket).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("_upto", F.sum("_n").over(before)).withColumn("_from", F.col("_upto") - F.col("_n"))
    if wanted is None:
        whole = Window.partitionBy(*bucket)
        placed, total = placed.withColumn("_size", F.sum("_n").over(whole)), F.col("_size")
        asked = [
            F.struct(F.lit(2 * k + side).alias("t"), F.lit(m).alias("m"), rank(total, q.p).cast("long").alias("rank"))
            for k, (q, m) in enumerate(zip(quantiles, _measures(quantiles)[1])) for side, rank in enumerate((_low, _high))
        ]
        ranked = placed.withColumn("_w", F.explode(F.array(*asked))).filter(F.col("_w.m") == F.col("_m"))
        ranked = ranked.select(
            *keys, "_m", "_size", "_from", "_upto", "_lo", "_hi", F.col("_w.t").alias("_t"), F.col("_w.rank").alias("_rank")
        )
    else:
        ranks = wanted.select(*keys, "_m", F.col("_lo").alias("_at"), "_size", "_t", "_rank")
        ranked = _join(placed, ranks, bucket)
    inside = (F.col("_from") <= F.col("_rank")) & (F.col("_rank") < F.col("_upto"))
    return ranked.filter(inside).select(*keys, "_m", "_size", "_t", (F.col("_rank") - F.col("_from")).alias("_rank"), "_lo", "_hi")


def _low(total: Column, p: float) -> Column:
    return F.floor((total - 1) * p)


def _high(total: Column, p: float) -> Column:
    return F.ceil((total - 1) * p)


def _measures(quantiles: Sequence[Quantile]) -> tuple[list[Column], list[int]]:
    """The distinct value columns, and which of them each quantile is of."""
    columns: list[Column] = []
    places = []
    for q in quantiles:
        known = next((k for k, c in enumerate(columns) if c is q.value), None)
        places.append(len(columns) if known is None else known)
        if known is None:
            columns.append(q.value)
    return columns, places


def _selected(df: DataFrame, keys: Sequence[str], quantiles: Sequence[Quantile]) -> DataFrame:
    keys = list(keys)
    columns, places = _measures(quantiles)
    cells = [F.struct(F.lit(m).alias("m"), c.cast("double").alias("v")) for m, c in enumerate(columns)]
    rows = df.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(
        *keys, F.col("_c.m").alias("_m"), F.col("_c.v").alias("_v")
    ).filter("_v is not null")
    rows = rows.select("*", _first_bucket(F.col("_v")).alias("_b"), F.lit(0.0).alias("_at"))
    wanted = cut(_narrowed(rows, None, quantiles, keys), "ranks")
    found = wanted.filter(~_open())
    while True:
        still = wanted.filter(_open())
        if still.isEmpty():
            break
        # Only rows of an open bucket go on; its ends tell it from the other buckets of its group.
        parts = still.select(*keys, "_m", "_lo", "_hi").distinct()
        joined = _join(rows.select(*keys, "_m", "_v"), parts, [*keys, "_m"], also=lambda r: r["_v"].between(r["_lo"], r["_hi"]))
        rows = cut(joined.select(*keys, "_m", "_v", _next_bucket(F.col("_v")).alias("_b"), F.col("_lo").alias("_at")), "inside")
        wanted = cut(_narrowed(rows, still, quantiles, keys), "ranks")
        found = found.unionByName(wanted.filter(~_open()))
    values = []
    for k, q in enumerate(quantiles):
        exact = (F.col("_size") - 1) * F.lit(q.p)
        low = F.max(F.when(F.col("_t") == 2 * k, F.col("_lo")))
        high = F.max(F.when(F.col("_t") == 2 * k + 1, F.col("_lo")))
        part = F.max(F.when(F.col("_t") == 2 * k, exact - F.floor(exact)))
        values.append(F.when(low == high, low).otherwise(low + (high - low) * part).alias(q.name))
    return found.groupBy(*keys).agg(*values)


def _open() -> Column:
    return F.col("_lo") != F.col("_hi")


def _join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", also: Callable[[dict], Column] | None = None
) -> DataFrame:
    """Null-safe join on equal names; ``also`` adds a condition on the other columns of both sides by name."""
    sides = {c: F.col(_q(c)) for c in (*left.columns, *right.columns) if c not in on}
    renamed = right.select(*[F.col(_q(c)).alias(f"_j_{c}" if c in on else c) for c in right.columns])
    parts = [left[_q(c)].eqNullSafe(renamed[_q(f"_j_{c}")]) for c in on]
    cond = reduce(and_, parts + ([also(sides)] if also else []))
    return left.join(renamed, cond, how).drop(*[f"_j_{c}" for c in on])


def _q(name: str) -> str:
    """A column name as Spark reads it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"
