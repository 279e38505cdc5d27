"""Whitening of embeddings by shifted CholeskyQR: distributed Gram passes, triangular solves, and the SVD of the composed factor."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytomill.session import cut

#: Fixed values of the integer grid: x = floor(SCALE * c) + LIFT.
SCALE, LIFT = 64, 1_000_000
#: Rows that a task holds as numbers at once, the widest vectors, and the most Gram passes.
BLOCK, MOST_DIMS, MOST_PASSES = 4096, 4096, 8
UNIT = float(np.finfo(float).eps) / 2


class Whitening(NamedTuple):
    """n rows in the fit list with sums per dimension; unit components as columns, their variances by falling size, and the
    largest absolute entry of the whitened covariance minus the identity."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x minus the mean: the integer numerator n * x - S is exact, so only the division rounds."""
        return (self.n * x - self.sums) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.variances))

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Exact sum over dimensions of (n * x - S) squared; fails where 64 bits do not hold it."""
        far = self.n * x - self.sums
        if len(far) and (np.square(far.astype(float)).sum(1) >= 2.0**63).any():
            raise OverflowError("the squared deviation of a row passes 64 bits")
        return np.square(far).sum(1)


def on_grid(vector: Column) -> Column:
    """The vector on the integer grid, array<bigint>; null where it is null, empty, or holds null or non-finite entries."""
    inf = F.lit(float("inf"))
    whole = (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != inf))
    return F.when(F.coalesce(whole, F.lit(False)), F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + LIFT))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _total(rows: DataFrame, d: int, part: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray:
    """Sum of part(block) over all blocks of rows, flat. A task adds up its blocks, Spark adds the tasks' entries by place,
    and only as many entries as one part has reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for at in range(0, len(x), BLOCK):
                p = part(x[at : at + BLOCK]).ravel()
                total = p if total is None else total + p
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["at", "value"])

    summed = rows.select("x").mapInArrow(run, f"at long, value {kind}").groupBy("at").agg(F.sum("value").alias("value"))
    found = sorted((r["at"], r["value"]) for r in summed.collect())
    return np.array([v for _, v in found])


def _solved(centred: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """Rows times the inverse of every triangular factor, one solve each."""
    y = centred.T
    for r in factors:
        y = np.linalg.solve(r.T, y)
    return y.T


def _factor(gram: np.ndarray, always: bool) -> np.ndarray:
    """Upper Cholesky factor of a Gram matrix, with a shift where `always` asks for it or the plain factor does not exist."""
    d = len(gram)
    shift = 11 * d * (d + 1) * UNIT * np.trace(gram)
    if not always:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(d)).T
        except np.linalg.LinAlgError:
            shift *= 10


def fit(df: DataFrame, vector: str = "x", most: int = 16) -> Whitening | None:
    """Fits on each distinct grid vector once (`on_grid`; null rows are left out). None when no row or no variance is left.

    Each pass sums the Gram matrix of the rows solved by all factors so far; the first factor is shifted, so it exists for
    any condition, and later ones bring the rows to orthonormal. The product R of the factors has the singular values and right
    vectors of the centred rows. Directions without variance (constant dimensions, fewer rows than dimensions) give no component.
    Vectors of another length than the longest are left out. Copies are merged on the map side before the shuffle, the fit list is
    written once, and a pass holds one block of rows and one Gram matrix a task.
    """
    grid = df.select(F.col(vector).alias("x")).where("x is not null")
    d = grid.agg(F.max(F.size("x"))).first()[0]
    if d is None:
        return None
    if d > MOST_DIMS:
        raise ValueError(f"vectors of {d} dimensions; at most {MOST_DIMS}")
    rows = cut(grid.where(F.size("x") == d).distinct())
    counted = _total(rows, d, lambda x: np.append(x.sum(0), len(x)), "long")
    n, sums = int(counted[-1]), counted[:-1].astype(np.int64)
    plain = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), np.zeros(0), 0.0)
    factors: list[np.ndarray] = []

    def gram(x: np.ndarray) -> np.ndarray:
        y = _solved(plain.centred(x), factors)
        return y.T @ y

    for k in range(MOST_PASSES):
        g = _total(rows, d, gram, "double").reshape(d, d)
        if k == 0 and not np.trace(g) > 0:
            return None
        near = np.linalg.eigvalsh(g)
        if k > 1 and np.minimum(np.abs(near - 1), np.abs(near)).max() < 64 * d * UNIT:
            break
        factors = [*factors, _factor(g, k == 0)]
    r = np.eye(d)
    for f in factors:
        r = f @ r
    _, sigma, vt = np.linalg.svd(r)
    variances = sigma**2 / n
    real = int((variances > variances[0] * d * 2 * UNIT).sum())
    k = min(most, real)
    components = vt[:k].T
    components = components * np.sign(components[np.abs(components).argmax(0), np.arange(k)])
    model = plain._replace(components=components, variances=variances[:k], explained=variances[:k] / variances[:real].sum())

    def spread(x: np.ndarray) -> np.ndarray:
        w = model.whitened(x)
        return np.concatenate([w.T @ w, w.sum(0)[None]])

    s = _total(rows, d, spread, "double").reshape(k + 1, k)
    mean = s[k] / n
    return model._replace(identity_error=float(np.abs(s[:k] / n - np.outer(mean, mean) - np.eye(k)).max()))


def transform(df: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "x") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row per component of each vector of the model's length.

    Without a model there are no rows. Null keys stay; rows that repeat are repeated. Other columns of df are not read.
    """
    d = 0 if model is None else len(model.sums)
    kept = df.select(F.col(key).alias("key"), F.col(vector).alias("x")).where(F.size("x") == d if d else F.lit(False))
    kind = df.schema[key].dataType.simpleString()
    schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = model.components.shape[1]
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                m = batch.num_rows
                x = _matrix(batch.column(1), d)
                whitened, deviation = model.whitened(x), model.deviation(x)
                again = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n, np.int64)), pa.array(np.repeat(deviation, k)), pa.array(whitened.ravel()),
                    pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error)),
                ], ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.mapInArrow(run, f"key {kind}, {schema}").withColumnRenamed("key", key)
