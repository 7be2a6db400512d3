"""Embedding whitening by shifted CholeskyQR.

The centred rows A of all vectors are never held together: a pass over the table solves each batch of rows against the
triangular factors found so far and adds up its Gram matrix, and only that matrix (dimension squared) reaches the
driver. The first factor is the Cholesky factor of the Gram matrix plus a shift that keeps it positive definite at any
condition; further passes orthogonalise what is left until the Gram matrix is the identity. The composed factor R has
the singular values and right vectors of A, so the SVD of R gives the components. Later Cholesky steps pivot and stop
at the numerical rank, so constant or dependent dimensions are no hindrance.

Entries are put on a grid first, x = floor(unit * c) + offset, so counts and sums are exact integers whatever the
order of the rows, and a centred row is (n * x - S) / n.

Defined cases: a vector that is null, empty or holds a null or non-finite entry is dropped; so is one whose length is
not the commonest (of equally common lengths the larger counts); x beyond +-2^31 is held there. Repeated rows and
rows with an equal or null id all count and all come back. Directions without variance are no component, so an empty
table, a single vector or copies of one vector give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytesets import tidy

UNIT = 1024.0
OFFSET = 100_000
COMPONENTS = 8
#: The Gram matrix of orthonormal rows is this close to the identity; a pass that comes no closer is the last.
ORTHOGONAL = 1e-11
PASSES = 8
#: Part of the largest pivot below which a direction of already scaled rows counts as dependent.
DEPENDENT = 1e-12
BATCH_ENTRIES = 1 << 20
_LIMIT = float(2**31)


@dataclass(frozen=True)
class Factor:
    """One orthogonalisation: the columns kept and their triangular factor."""

    kept: np.ndarray
    upper: np.ndarray

    def solve(self, rows: np.ndarray) -> np.ndarray:
        """rows @ inverse(upper), column by column."""
        out = rows[:, self.kept]
        for j in range(len(self.kept)):
            if j:
                out[:, j] -= out[:, :j] @ self.upper[:j, j]
            out[:, j] /= self.upper[j, j]
        return out


@dataclass(frozen=True)
class Whitening:
    """A fitted model: everything a task needs to whiten a vector."""

    n: int
    sums: np.ndarray  # of x per dimension, as long
    components: np.ndarray  # unit eigenvectors as columns
    eigenvalues: np.ndarray
    explained: np.ndarray
    unit: float
    offset: int

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ (self.components / np.sqrt(self.eigenvalues))


def usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them numbers."""
    number = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, number), F.lit(False))


def _grid(column: pa.Array, dim: int, unit: float, offset: int) -> np.ndarray:
    x = np.floor(column.flatten().to_numpy(zero_copy_only=False) * unit) + offset
    return np.clip(x, -_LIMIT, _LIMIT).astype(np.int64).reshape(-1, dim)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, in Python integers where 64 bits might not hold it."""
    top = max(int(np.abs(x).max(initial=0)) * n, int(max(map(abs, sums.tolist()), default=0)))
    if top < 2**62:
        return n * x - sums
    return n * x.astype(object) - sums.astype(object)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (_deviations(x, n, sums) / n).astype(np.float64)


def _each(vectors: DataFrame, dim: int, unit: float, offset: int, use: Callable, schema: str) -> DataFrame:
    """``use`` over the grid rows of a bounded batch at a time; (batch column 0, x) in, record batches out."""
    step = max(1, BATCH_ENTRIES // dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (b.slice(i, step) for b in batches for i in range(0, b.num_rows, step))
        yield from use((b.column(0), _grid(b.column(b.num_columns - 1), dim, unit, offset)) for b in blocks)

    return vectors.mapInArrow(tidy(run), schema)


def _added(parts: DataFrame, width: int) -> np.ndarray:
    """Sum of (i, values) rows by i, added up in a stream; a task holds about 32 rows of the matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            values = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            for i, row in zip(b.column(0).to_pylist(), values):
                total[i] = total[i] + row if i in total else row.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()))], ["i", "row"])

    out = np.zeros((width, width))
    for r in parts.repartition(-(-width // 32), "i").mapInArrow(tidy(run), "i int, row array<double>").collect():
        out[r["i"]] = r["row"]
    return out


def _gram(vectors: DataFrame, dim: int, width: int, unit: float, offset: int, rows: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Gram matrix of ``rows(x)`` over all vectors: one pass, a matrix per task, a matrix to the driver."""

    def use(blocks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros((width, width)), False
        for _, x in blocks:
            made = rows(x)
            total += made.T @ made
            met = True
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(list(total))], ["i", "row"])

    return _added(_each(vectors, dim, unit, offset, use, "i int, row array<double>"), width)


def _totals(vectors: DataFrame, dim: int, unit: float, offset: int) -> tuple[int, np.ndarray]:
    """Exact count and per-dimension sums of x."""

    def use(blocks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        count, sums = 0, np.zeros(dim, object)
        for _, x in blocks:
            count += len(x)
            sums = sums + x.sum(0).astype(object)
        if count:
            cells = [str(v) for v in (count, *sums.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dim, dtype=np.int32)), pa.array(cells)], ["i", "total"])

    parts = _each(vectors, dim, unit, offset, use, "i int, total string")
    whole = parts.groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r["i"]: int(r["total"]) for r in whole.collect()}  # one row per dimension
    if not found:
        return 0, np.zeros(dim, np.int64)
    sums = [found[i] for i in range(dim)]
    fits = max(map(abs, sums)) < 2**62
    return found[-1], np.array(sums, np.int64 if fits else object)


def pivoted_cholesky(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the columns kept, R of shape kept x all columns in their own order) with gram = R' R up to rank."""
    d = len(gram)
    left, rows, kept = gram.copy(), [], []
    top = float(np.diag(gram).max(initial=0.0))
    for _ in range(d):
        diagonal = np.diag(left).copy()
        diagonal[kept] = -1.0
        j = int(diagonal.argmax())
        if diagonal[j] <= DEPENDENT * top or diagonal[j] <= 0:
            break
        row = left[j] / np.sqrt(diagonal[j])
        row[kept] = 0.0
        left -= np.outer(row, row)
        rows.append(row)
        kept.append(j)
    return np.array(kept, np.int64), np.array(rows).reshape(len(rows), d)


def fit(
    table: DataFrame, vector: str = "embedding", *, components: int = COMPONENTS, unit: float = UNIT, offset: int = OFFSET
) -> tuple[DataFrame, Whitening | None]:
    """The usable rows and their whitening (None where no direction has variance)."""
    good = table.filter(usable(F.col(vector)))
    lengths = good.groupBy(F.size(vector).alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("dim")).first()
    if common is None:
        return good, None
    dim = int(common["dim"])
    good = good.filter(F.size(vector) == dim)
    entries = good.select(F.col(vector).cast("array<double>").alias("v"))
    n, sums = _totals(entries, dim, unit, offset)

    def gram(factors: list[Factor]) -> np.ndarray:
        def rows(x: np.ndarray) -> np.ndarray:
            out = centred(x, n, sums)
            for f in factors:
                out = f.solve(out)
            return out

        return _gram(entries, dim, len(factors[-1].kept) if factors else dim, unit, offset, rows)

    first = gram([])
    trace = float(np.trace(first))
    if trace <= 0:
        return good, None
    shift = 11 * (n * dim + dim * (dim + 1)) * np.finfo(float).eps / 2 * float(np.linalg.norm(first, 2))
    upper = np.linalg.cholesky(first + shift * np.eye(dim)).T
    factors, composed = [Factor(np.arange(dim), upper)], upper
    apart = np.inf
    for _ in range(PASSES):
        rest = gram(factors)
        before, apart = apart, float(np.abs(rest - np.eye(len(rest))).max())
        if apart <= ORTHOGONAL or apart >= before / 2 and apart < 1e-6:
            break
        kept, rows = pivoted_cholesky(rest)
        factors.append(Factor(kept, rows[:, kept]))
        composed = rows @ composed
    _, singular, right = np.linalg.svd(composed, full_matrices=False)
    eigen = singular**2 / n
    real = eigen > eigen[0] * dim * np.finfo(float).eps
    k = min(components, int(real.sum()))
    model = Whitening(n, sums, right[:k].T.copy(), eigen[:k], eigen[:k] / (trace / n), unit, offset)
    return good, model


def identity_error(rows: DataFrame, vector: str, model: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, measured by one more pass."""
    dim, k = model.components.shape
    entries = rows.select(F.col(vector).cast("array<double>").alias("v"))

    def with_one(x: np.ndarray) -> np.ndarray:
        return np.c_[model.whitened(x), np.ones(len(x))]

    gram = _gram(entries, dim, k + 1, model.unit, model.offset, with_one) / model.n
    mean = gram[:k, k]
    return float(np.abs(gram[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(table: DataFrame, vector: str = "embedding", key: str = "vec_id", **settings) -> DataFrame:
    """Per usable row: its id, x's exact deviation, its whitened coordinates and the model's figures.

    ``deviation`` is decimal(38, 0); ``whitened`` and ``explained`` are arrays with one entry per component.
    """
    rows, model = fit(table, vector, **settings)
    kind = table.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    if model is None:
        return table.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, vector, model)
    dim, k = model.components.shape

    def use(blocks: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        for ids, x in blocks:
            count = len(x)
            apart = _deviations(x, model.n, model.sums)
            if apart.dtype != object and int(np.abs(apart).max(initial=0)) ** 2 * dim < 2**63:
                square = pa.array((apart * apart).sum(1))
            else:
                square = pa.array([str(v) for v in (apart.astype(object) ** 2).sum(1)])
            ends = pa.array(np.arange(count + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.full(count, model.n)), square.cast(pa.decimal128(38, 0)),
                 pa.ListArray.from_arrays(ends, pa.array(model.whitened(x).ravel())),
                 pa.ListArray.from_arrays(ends, pa.array(np.tile(model.explained, count))), pa.array(np.full(count, error))],
                [key, "n", "deviation", "whitened", "explained", "identity_error"],
            )

    wanted = rows.select(key, F.col(vector).cast("array<double>").alias("v"))
    return _each(wanted, dim, model.unit, model.offset, use, schema)


def per_component(whitened: DataFrame, key: str = "vec_id") -> DataFrame:
    """One row per vector and component; a deviation beyond a long is null."""
    cells = whitened.select(
        key, "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error",
        F.posexplode(F.arrays_zip("whitened", "explained")).alias("_at", "_c"),
    )
    return cells.select(
        key, (F.col("_at") + 1).cast("int").alias("component"), "n", "deviation", "_c.whitened", "_c.explained", "identity_error"
    )
