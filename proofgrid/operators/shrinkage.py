"""Mahalanobis distances under a shrunk covariance of leading components, from sums over rows.

`fit` takes two passes: sums of vectors and of outer products give the mean and the principal components, and the sum of the
fourth powers of the projected lengths gives the Ledoit-Wolf intensity in closed form: with eigenvalues v of mean m, n rows
and p components, beta = (sum |z|^4 / n - sum v^2) / (p n) and delta = (sum v^2 - p m^2) / p, and the covariance is shrunk by
min(beta, delta) / delta towards m times the identity. Both stay diagonal in the components. What reaches the driver are
d * d numbers, d being the length of a vector; rows are scored where they are. Rows with a null vector don't count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shrunk:
    mean: np.ndarray
    axes: np.ndarray
    spread: np.ndarray
    shrinkage: float
    rows: int

    @property
    def variances(self) -> np.ndarray:
        return (1 - self.shrinkage) * self.spread + self.shrinkage * self.spread.mean()


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, j, s) of a task: sums of products for i <= j; of the components for i = -1; the number of rows for i = j = -1."""
    n, total, outer = 0, 0.0, 0.0
    for b in batches:
        if b.num_rows:
            x = _vectors(b.column(0))
            n, total, outer = n + len(x), total + x.sum(0), outer + x.T @ x
    if n:
        d = len(total)
        i, j = np.triu_indices(d)
        at = np.concatenate([i, np.full(d + 1, -1)]), np.concatenate([j, np.arange(d), [-1]])
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(np.concatenate([outer[i, j], total, [n]]))], ["i", "j", "s"])


def fit(reference: DataFrame, vector: str, dims: int = 32) -> Shrunk:
    """The components and the shrinkage of a reference of at least two rows."""
    rows = reference.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    sums = {(r.i, r.j): r.s for r in rows.mapInArrow(_moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    n = int(sums.get((-1, -1), 0))
    if n < 2:
        raise ValueError("a covariance needs two rows")
    d = sum(1 for i, j in sums if i == -1 and j >= 0)
    mean = np.array([sums[-1, j] for j in range(d)]) / n
    cov = np.array([[sums[min(i, j), max(i, j)] for j in range(d)] for i in range(d)]) / n - np.outer(mean, mean)
    spread, axes = np.linalg.eigh(cov)
    k = min(dims, d, n - 1)
    spread, axes = np.maximum(spread[::-1][:k], 0), axes[:, ::-1][:, :k]

    def fourth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the type is given, as a task without rows has the integer 0
        yield pa.RecordBatch.from_arrays([pa.array([sum(float(((((_vectors(b.column(0)) - mean) @ axes) ** 2).sum(1) ** 2).sum()) for b in batches if b.num_rows)], pa.float64())], ["s"])

    power = rows.mapInArrow(fourth, "s double").agg(F.sum("s")).first()[0]
    square, level = float((spread**2).sum()), float(spread.mean())
    delta = (square - k * level**2) / k
    beta = min((power / n - square) / (k * n), delta)
    return Shrunk(mean, axes, spread, beta / delta if beta > 0 else 0.0, n)


def distances(model: Shrunk, rows: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, distance): squared Mahalanobis distances; a null vector has a null one."""
    scale = 1 / np.maximum(model.variances, 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = b.column(1).is_valid()
            z = (_vectors(b.column(1).filter(known)) - model.mean) @ model.axes if b.num_rows and known.true_count else np.zeros((0, len(scale)))
            out = np.full(b.num_rows, np.nan)
            out[known.to_numpy(zero_copy_only=False)] = (z * z * scale).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, from_pandas=True)], [id_col, "distance"])

    kept = rows.select(id_col, F.col(vector).cast("array<double>").alias("v"))
    return kept.mapInArrow(run, f"`{id_col}` {kept.schema[0].dataType.simpleString()}, distance double")
