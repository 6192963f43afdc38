"""Whitening of embeddings by polarisation: variances of dimensions and of sums of two dimensions give all covariances.

cov(a, b) = (var(a + b) - var(a) - var(b)) / 2, so only squared centred values are ever added up. They are whole
numbers, and their sums are exact whatever the order: tasks add them in limbs of _LIMB bits, Spark adds the limbs, and
the driver, which only holds a number per pair of dimensions, assembles the matrix for the symmetric eigenproblem.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotaspark.llm.common import staged

#: Entries are counted in steps of 1/STEPS.
STEPS = 256
COMPONENTS = 4
#: The driver holds a matrix of this many rows at most; wider vectors are refused.
MAX_DIMENSIONS = 2048
_LIMB, _LIMBS = 40, 5
_SAFE = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """What whitening needs: n vectors with sums per dimension; unit eigenvectors as columns and their eigenvalues."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def scales(self) -> np.ndarray:
        """Columns that turn centred vectors into whitened values; NaN where the eigenvalue is zero but for rounding."""
        least = self.values.size * np.finfo(float).eps * max(float(self.values.max(initial=0.0)), 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.values > least, self.vectors / np.sqrt(self.values), np.nan)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: 64-bit integers where all of them fit, Python's otherwise."""
        most = self.n * _most(x) + max(map(abs, self.sums), default=0)
        exact = np.int64 if most < _SAFE else object
        return x.astype(exact) * self.n - np.array(self.sums, exact)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ self.scales


def _most(x: np.ndarray) -> int:
    return max(int(x.max()), -int(x.min())) if x.size else 0


def _squares(c: np.ndarray) -> np.ndarray:
    """Sum of the squares of each row, exact."""
    most = _most(c)
    return np.square(c).sum(axis=1) if most * most * max(c.shape[1], 1) < 2 * _SAFE else np.square(c.astype(object)).sum(axis=1)


class _Limbs:
    """Exact running sums of n numbers, as limbs of _LIMB bits that Spark can add up further."""

    def __init__(self, n: int) -> None:
        self.limbs = np.zeros((_LIMBS, n), np.int64)

    def add(self, values: np.ndarray) -> None:
        for k in range(_LIMBS):
            low = values if k == _LIMBS - 1 else values & ((1 << _LIMB) - 1)
            self.limbs[k] += low.astype(np.int64)
            values = values >> _LIMB
        for k in range(_LIMBS - 1):
            self.limbs[k + 1] += self.limbs[k] >> _LIMB
            self.limbs[k] &= (1 << _LIMB) - 1

    def batch(self, *keys: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(k, pa.int32()) for k in keys] + [pa.array(row, pa.int64()) for row in self.limbs]
        return pa.RecordBatch.from_arrays(columns, ["i", "j"][: len(keys)] + [f"limb{k}" for k in range(_LIMBS)])


def _added(partial: DataFrame, keys: list[str]) -> dict[tuple[int, ...], int]:
    """The whole sums per key, from the tasks' limbs."""
    whole = partial.groupBy(*keys).agg(*[F.sum(f"limb{k}").alias(f"limb{k}") for k in range(_LIMBS)]).toPandas()
    limbs = [whole[f"limb{k}"].tolist() for k in range(_LIMBS)]
    return {
        key: sum(x << (_LIMB * k) for k, x in enumerate(row))
        for key, row in zip(zip(*(whole[k].tolist() for k in keys)), zip(*limbs))
    }


def _schema(keys: str) -> str:
    return keys + "".join(f", limb{k} long" for k in range(_LIMBS))


def steps(vector: Column) -> Column:
    """Each entry as a whole number of steps; NULL for a NULL vector and for one with NULL or non-finite entries."""
    entries = vector.cast("array<double>")
    fine = F.forall(entries, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), F.lit(False)))
    return F.when(fine, F.transform(entries, lambda c: F.floor(c * STEPS).cast("long")))


def _matrices(batches: Iterator[pa.RecordBatch], d: int, column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _column_sums(d: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limbs = _Limbs(d + 1)
        for _, x in _matrices(batches, d):
            exact = x if _most(x) * len(x) < _SAFE else x.astype(object)
            limbs.add(np.append(exact.sum(axis=0), len(x)))
        yield limbs.batch(np.append(np.arange(d), -1))

    return run


def _pair_squares(d: int, near: list[int]) -> Callable:
    """Sums over all rows of (y_i + y_j)**2 for i < j and of y_i**2 for i = j, where y = x - near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limbs, most_near = _Limbs(d * (d + 1) // 2), max(map(abs, near), default=0)
        for _, x in _matrices(batches, d):
            most = 2 * (_most(x) + most_near)
            exact = np.int64 if most * most * len(x) < _SAFE else object
            y = x.astype(exact) - np.array(near, exact)
            sums = []
            for i in range(d):
                pair = y[:, i:].copy()
                pair[:, 1:] += y[:, i : i + 1]
                sums.append(np.square(pair).sum(axis=0))
            limbs.add(np.concatenate(sums))
        yield limbs.batch(*np.triu_indices(d))

    return run


def polarised_covariance(n: int, sums: list[int], near: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance matrix, each entry rounded once from the exact fraction.

    squares are centred at whole numbers near the means. Centred at the means themselves and times n**2, the sum of
    squares of a value with rest r = sum - n * near is n**2 * square - n * r**2.
    """
    d = len(sums)
    rest = [s - n * m for s, m in zip(sums, near)]
    own = [n * n * squares[i, i] - n * rest[i] ** 2 for i in range(d)]
    out = np.empty((d, d))
    for i in range(d):
        out[i, i] = own[i] / n**3
        for j in range(i + 1, d):
            both = n * n * squares[i, j] - n * (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - own[i] - own[j]) / (2 * n**3)
    return out


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of a table, each counted once; None where there is none.

    Vectors have the length that most distinct ones have (ties: the greater); others do not count, nor do empty ones.
    The distinct vectors are written to the shared folder and read three times: for the sums, for the squares around
    them, and to measure how far the covariance of the whitened values is from the identity.
    """
    rows = vectors.select(steps(F.col(column)).alias("x")).where(F.size("x") > 0).distinct()
    rows = staged(rows.select("x", F.size("x").alias("d")), "whitening-fit")
    found = rows.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if found is None:
        return None
    d = found["d"]
    if d > MAX_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions; the limit is {MAX_DIMENSIONS}")
    rows = rows.where(F.col("d") == d).select("x")
    totals = _added(rows.mapInArrow(_column_sums(d), _schema("i int")), ["i"])
    n, sums = totals[-1,], [totals[i,] for i in range(d)]
    near = [(2 * s + n) // (2 * n) for s in sums]
    squares = _added(rows.mapInArrow(_pair_squares(d, near), _schema("i int, j int")), ["i", "j"])
    covariance = polarised_covariance(n, sums, near, squares)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    lead = np.abs(axes).argmax(axis=0)
    axes = axes * np.where(axes[lead, np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    model = Whitening(n, tuple(sums), axes, values, float(np.trace(covariance)))
    return Whitening(n, tuple(sums), axes, values, model.trace, _identity_error(rows, model))


def _identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """The largest entry of the whitened values' covariance minus the identity, in absolute value, as measured."""
    d, k = model.vectors.shape
    good = np.flatnonzero(np.isfinite(model.scales).all(axis=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for _, x in _matrices(batches, d):
            w = model.whitened(model.centred(x))
            total += w.T @ w
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "total"])

    if not good.size:
        return None
    parts = rows.mapInArrow(run, "i int, j int, total double").where(F.col("i").isin(good.tolist()) & F.col("j").isin(good.tolist()))
    found = parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    return round(max(abs(r["total"] / model.n - (r["i"] == r["j"])) for r in found), 12)


_RESULT = [
    ("component", "int", pa.int32()),
    ("n", "long", pa.int64()),
    ("deviation", "long", pa.int64()),
    ("whitened", "double", pa.float64()),
    ("explained", "double", pa.float64()),
    ("identity_error", "double", pa.float64()),
]


def _number(x: float) -> float | None:
    return float(x) if math.isfinite(x) else None


def whiten(vectors: DataFrame, model: Whitening | None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row per row of vectors and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows with a NULL vector, NULL or non-finite entries, or another number of dimensions than the model's are dropped;
    rows with a NULL key and repeated rows give rows like any other. deviation is the exact squared distance of n times
    the vector from the sums (NULL where a long cannot hold it); whitened is NULL for a component without variance, and
    explained where nothing varies. Columns of vectors besides key and column are ignored, whatever their names. Without
    a model (an empty table) there are no rows.
    """
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}" + "".join(f", {name} {sql}" for name, sql, _ in _RESULT)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d, k = model.vectors.shape
    explained = [_number(v / model.trace) if model.trace > 0 else None for v in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches, d, 1):
            rows, centred = len(x), model.centred(x)
            deviation = [v if v < 2 * _SAFE else None for v in _squares(centred).tolist()]
            whitened = model.whitened(centred)
            columns = (
                np.tile(np.arange(1, k + 1), rows),
                np.full(rows * k, model.n),
                [v for v in deviation for _ in range(k)],
                pa.array(whitened.ravel(), mask=~np.isfinite(whitened.ravel())),
                explained * rows,
                [model.identity_error] * (rows * k),
            )
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(rows), k)))
            made = [c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, _, t) in zip(columns, _RESULT)]
            yield pa.RecordBatch.from_arrays([keys, *made], [key, *(name for name, _, _ in _RESULT)])

    rows = vectors.select(F.col(key), steps(F.col(column)).alias("x")).where(F.size("x") == d)
    return rows.mapInArrow(run, schema)
