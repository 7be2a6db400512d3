"""Embedding near-dedup: an exact metric range join of unit vectors.

Cosine >= c between unit vectors is a Euclidean distance of at most r = sqrt(2 - 2c). Pivots (a bounded sample) split the
vectors into cells of their nearest pivot. A vector near another cell is copied there: by the triangle inequality a
partner in cell p can only exist where d(v, p) <= d(v, home) + 2r, and only if v lies within r of the plane half-way
between the two pivots, which is the tighter of the two. Copies go to lower-numbered cells only, so each pair meets in
exactly one cell, and cells join independently in double precision.

A cell is cut into blocks of home vectors (``BLOCK``); a task holds one block and streams the cell's other vectors past it,
so a cell of any size is many tasks. Equal vectors are one class with a count. Out come link counts and, per block, a few
links that keep components together; never all pairs of a group.

In high dimensions random vectors lie close to every such plane, most are copied to most cells, and the work tends to
all pairs: exactness has that price there; cells still bound what a task holds.

Defined cases: a vector that is null, empty, zero, or holds a null or non-finite component links with nothing; vectors of
different lengths do not link; rows with an equal vec_id give one row (most links, smallest component); a null vec_id gives
a row without links; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytesets import tidy
from millrace.llm.components import components
from millrace.llm.frames import cut, tidy_shuffles

COSINE = 0.95
BLOCK = 4_096
STREAM = 1_024
PIVOTS = 1_024  # at most; their vectors are the only ones that reach the driver
SLACK = 1e-9  # more than a squared distance loses to rounding


def _units(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.float64).reshape(len(cells), -1)


def _classes(embeddings: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Written table (cls, vec_id list head, copies, dim, unit): distinct usable vectors at unit length."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    usable = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = (
        embeddings.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
        .filter("vec_id is not null").filter(usable & F.exists("v", lambda x: x != 0))
    )
    return cut(rows.distinct().groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low")), "vectors")


def _distinct(points: np.ndarray) -> np.ndarray:
    """Pivots without those that coincide with an earlier one up to rounding."""
    square, kept = 2.0 - 2.0 * points @ points.T, []
    for k in range(len(points)):
        if (square[k, kept] > SLACK).all():
            kept.append(k)
    return points[kept]


def _near_cells(units: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Home cell of each vector, and the lower-numbered cells in which it may have a partner.

    ``SLACK`` is added to squared lengths before a root is taken: near zero the root would magnify their rounding, and as a
    factor of a distance that cancelled to zero it would allow for nothing.
    """
    radius = math.sqrt(radius * radius + SLACK)
    square = np.maximum(0.0, 2.0 - 2.0 * units @ pivots.T)
    home = square.argmin(1)
    own = square[np.arange(len(units)), home]
    apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * pivots @ pivots.T) + SLACK)[home]
    plane = (square - own[:, None]) <= 2.0 * apart * radius + SLACK
    ball = np.sqrt(square) <= np.sqrt(own + SLACK)[:, None] + 2.0 * radius + SLACK
    lower = np.arange(len(pivots))[None, :] < home[:, None]
    reach = plane & ball & lower
    return home, [np.flatnonzero(r) for r in reach]


def _placed(classes: DataFrame, pivots: dict[int, np.ndarray], radius: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                some = lists.take(pa.array(at))
                raw = some.flatten().to_numpy().reshape(len(at), dim)
                big = np.abs(raw).max(1, keepdims=True)
                units = raw / big
                units /= np.linalg.norm(units, axis=1, keepdims=True)
                home, near = _near_cells(units, pivots[dim], radius)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), b.column(2).take(pa.array(at)), pa.array(np.full(len(at), dim, np.int32)),
                     pa.array(home.astype(np.int32)), pa.array([n.tolist() for n in near], pa.list_(pa.int32())),
                     pa.array([u.tobytes() for u in units], pa.binary())],
                    ["cls", "copies", "dim", "home", "near", "unit"],
                )

    return classes.select("cls", "v", "copies").mapInArrow(
        tidy(run), "cls long, copies long, dim int, home int, near array<int>, unit binary"
    )


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _joined(dealt: DataFrame, cosine: float) -> DataFrame:
    """(cls, other, links) of every block: counts where ``other`` is null, else links that tie components."""

    def compare(ids: np.ndarray, units: np.ndarray, copies: np.ndarray, ids2: np.ndarray, units2: np.ndarray, copies2: np.ndarray, same: bool) -> tuple[np.ndarray, pa.RecordBatch]:
        counts = np.zeros(len(ids), np.int64)
        back = np.zeros(len(ids2), np.int64)
        left, right = [], []
        for lo in range(0, len(ids2), STREAM):
            near = units @ units2[lo : lo + STREAM].T >= cosine
            if same:
                k = np.arange(lo, min(lo + STREAM, len(ids2)))
                near[k, k - lo] = False
            i, j = np.nonzero(near)
            if not len(i):
                continue
            j += lo
            np.add.at(counts, i, copies2[j])
            if not same:
                np.add.at(back, j, copies[i])
            root = _roots(i, len(ids) + j, len(ids) + len(ids2)) if not same else _roots(i, j, len(ids))
            tied = np.flatnonzero(root != np.arange(len(root)))
            names = ids if same else np.r_[ids, ids2]
            left.append(names[root[tied]])
            right.append(names[tied])
        some = np.flatnonzero(back)
        a = np.concatenate([ids2[some], *left]) if left or len(some) else ids2[:0]
        b = np.concatenate([np.zeros(len(some), np.int64), *right]) if left or len(some) else ids2[:0]
        mask = np.arange(len(a)) < len(some)
        links = np.r_[back[some], np.zeros(len(a) - len(some), np.int64)]
        return counts, pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=mask), pa.array(links)], ["cls", "other", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None

        def close() -> Iterator[pa.RecordBatch]:
            """The block is complete: compare it with itself."""
            nonlocal block, held
            if held:
                t = pa.Table.from_batches(held)
                ids, copies = t.column("cls").to_numpy(), t.column("copies").to_numpy()
                units = _units(t.column("unit").to_pylist())
                counts, links = compare(ids, units, copies, ids, units, copies, True)
                block, held = [ids, units, copies, counts], []
                yield links

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal block
            yield from close()
            if block is not None:
                some = np.flatnonzero(block[3])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[0][some]), pa.nulls(len(some), pa.int64()), pa.array(block[3][some])], ["cls", "other", "links"]
                )
            block = None

        for b in batches:
            cols = [b.column(k).to_numpy() for k in range(4)]
            turn = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if b.num_rows > 1 else np.zeros(0, int)
            for s, e in zip([0, *turn], [*turn, b.num_rows]):
                if e <= s:
                    continue
                here = tuple(int(c[s]) for c in cols[:3])
                if here != key:
                    yield from done()
                    key = here
                part = b.slice(s, e - s)
                if cols[3][s] == 0:
                    held.append(part)
                    continue
                yield from close()
                if block is None:
                    continue
                ids, copies = part.column(4).to_numpy(), part.column(5).to_numpy()
                counts, links = compare(*block[:3], ids, _units(part.column(6).to_pylist()), copies, False)
                block[3] += counts
                yield links
        yield from done()

    rows = dealt.select("dim", "cell", "block", "side", "cls", "copies", "unit")
    laid = rows.repartition("dim", "cell", "block").sortWithinPartitions("dim", "cell", "block", "side")
    return laid.mapInArrow(tidy(run), "cls long, other long, links long")


def near_vectors(embeddings: DataFrame, *, cosine: float = COSINE, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    spark = embeddings.sparkSession
    radius = math.sqrt(2.0 - 2.0 * cosine)
    with tidy_shuffles(spark):
        classes = cut(_classes(embeddings, id_col, vector).withColumn("cls", F.monotonically_increasing_id()), "classes")
        pivots: dict[int, np.ndarray] = {}
        for row in classes.groupBy(F.size("v").alias("dim")).count().collect():  # one row per vector length
            wanted = max(1, min(PIVOTS, row["count"] // BLOCK))
            drawn = (
                classes.filter(F.size("v") == row["dim"]).orderBy(F.xxhash64("v"), "cls").select("v").limit(wanted).collect()
            )
            points = np.array([r["v"] for r in drawn], float)
            points /= np.abs(points).max(1, keepdims=True)
            pivots[row["dim"]] = _distinct(points / np.linalg.norm(points, axis=1, keepdims=True))
        placed = cut(_placed(classes, pivots, radius), "placed")
        # One row per cell: bounded by the pivots.
        blocks = placed.groupBy("dim", F.col("home").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
        blocks = cut(blocks, "cells").select(F.col("dim").alias("_dim"), F.col("cell").alias("_cell"), "n")
        mine = F.pmod(F.xxhash64("cls"), F.col("n")).cast("int")
        home = placed.join(F.broadcast(blocks), (F.col("dim") == F.col("_dim")) & (F.col("home") == F.col("_cell")))
        home = home.withColumn("_b", F.explode(F.sequence(F.lit(0), mine))).select(
            "dim", F.col("home").alias("cell"), F.col("_b").alias("block"), (F.col("_b") != mine).cast("int").alias("side"),
            "cls", "copies", "unit",
        )
        away = placed.withColumn("_near", F.explode("near")).join(
            F.broadcast(blocks), (F.col("dim") == F.col("_dim")) & (F.col("_near") == F.col("_cell"))
        )
        away = away.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
            "dim", F.col("_near").alias("cell"), F.col("_b").alias("block"), F.lit(1).alias("side"), "cls", "copies", "unit"
        )
        found = cut(_joined(home.unionAll(away), cosine), "near")
        roots = components(found.filter("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b")))
        links = found.filter("other is null").groupBy("cls").agg(F.sum("links").alias("links"))
        rooted = (
            classes.join(links, "cls", "left").join(roots.withColumnRenamed("id", "cls"), "cls", "left")
            .select("cls", "v", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cls").alias("root"))
        )
        names = rooted.groupBy("root").agg(F.min("low").alias("component"))
        named = rooted.join(names, "root").select("v", "n_links", "component")
        rows = embeddings.select(
            F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v")
        )
        merged = rows.join(named, "v", "left").groupBy("vec_id").agg(
            F.max(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
            F.min(F.coalesce("component", "vec_id")).alias("component_id"),
        )
        nameless = F.col("vec_id").isNull()
        return cut(merged.select(
            "vec_id", F.when(nameless, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"),
            F.when(~nameless, F.col("component_id")).alias("component_id"),
            F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        ), "vectors")
