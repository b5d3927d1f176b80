"""Two clusters in each class's activations, over all rows of a class.

Everything that a class needs is a sum over its rows: the moments that give its principal axes, each round's cluster
sums, and the silhouette. Tasks add up their rows first, so a large class costs no task more than its share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.operators.components import shared_table


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _by_class(batch: pa.RecordBatch):
    """(class, the numbers of its rows) for each class of a batch."""
    codes = batch.column("cls").dictionary_encode()
    at = codes.indices.to_numpy()
    for k, name in enumerate(codes.dictionary.to_pylist()):
        yield name, np.flatnonzero(at == k)


def _rows(total: dict, names: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), names), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["cls", "sums"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class's number of rows, sum of vectors and sum of outer products over a task."""
    total: dict = {}
    kind = None
    for batch in batches:
        kind = batch.column("cls").type
        x = _vectors(batch.column("embedding"))
        for name, at in _by_class(batch):
            own = x[at]
            sums = np.concatenate([[len(at)], own.sum(0), (own.T @ own).ravel()])
            total[name] = total[name] + sums if name in total else sums
    if total:
        yield _rows(total, kind)


def _axes(components: int):
    """From the moments of one task's classes: each class's mean and principal axes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        kind = None
        for batch in batches:
            kind = batch.column("cls").type
            for name, raw in zip(batch.column("cls").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                sums = np.frombuffer(raw)
                total[name] = total[name] + sums if name in total else sums
        out = {}
        for name, sums in total.items():
            d = int((np.sqrt(4 * len(sums) - 3) - 1) / 2)  # 1 + d + d * d numbers
            mean = sums[1 : d + 1] / sums[0]
            spread = sums[d + 1 :].reshape(d, d) / sums[0] - np.outer(mean, mean)
            axes = np.linalg.eigh(spread)[1][:, ::-1][:, : min(components, d)].T
            out[name] = np.concatenate([mean, axes.ravel()])
        if out:
            yield _rows(out, kind)

    return run


def _project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _vectors(batch.column("embedding"))
        out: list = [None] * len(x)
        for _, at in _by_class(batch):
            model = np.frombuffer(batch.column("sums")[int(at[0])].as_py()).reshape(-1, x.shape[1])
            for i, z in zip(at, (x[at] - model[0]) @ model[1:].T, strict=True):
                out[i] = z
        yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("vec_id"), pa.array(out, pa.list_(pa.float64()))], ["cls", "vec_id", "z"])


def _sides(z: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((z[:, None] - centres) ** 2).sum(2).argmin(1)


def _cluster_sums(centres: dict):
    """(cls, at, total): number, sum of squares and sum of vectors of a class's two clusters, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        kind = None
        for batch in batches:
            kind = batch.column("cls").type
            x = _vectors(batch.column("z"))
            for name, at in _by_class(batch):
                z = x[at]
                side = _sides(z, centres[name])
                sums = np.concatenate([np.concatenate([[(side == s).sum(), (z[side == s] ** 2).sum()], z[side == s].sum(0)]) for s in (0, 1)])
                total[name] = total[name] + sums if name in total else sums
        if total:
            width = len(next(iter(total.values())))
            names = pa.array([n for n in total for _ in range(width)], kind)
            yield pa.RecordBatch.from_arrays([names, pa.array(np.tile(np.arange(width, dtype=np.int32), len(total))), pa.array(np.concatenate(list(total.values())))], ["cls", "at", "total"])

    return run


def _silhouettes(centres: dict, clusters: dict):
    """(cls, minority side, silhouette) of each row; ``clusters``: n, mean square and mean vector of both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column("z"))
            small, value = np.zeros(len(x), bool), np.zeros(len(x))
            for name, at in _by_class(batch):
                side, (n, square, mean) = _sides(x[at], centres[name]), clusters[name]
                small[at] = side == n.argmin()
                if n.min() == 0:
                    small[at] = False
                    continue
                apart = ((x[at][:, None] - mean) ** 2).sum(2) + square - (mean**2).sum(1)
                row = np.arange(len(at))
                own = np.sqrt(np.maximum(apart[row, side], 0) * n[side] / np.maximum(n[side] - 1, 1))
                other = np.sqrt(np.maximum(apart[row, 1 - side], 0))
                value[at] = np.where(n[side] > 1, (other - own) / np.maximum(np.maximum(own, other), 1e-12), 0)
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(small), pa.array(value)], ["cls", "small", "value"])

    return run


def split_classes(rows: DataFrame, components: int = 10, rounds: int = 50) -> DataFrame:
    """(cls, n, minority, silhouette) for rows (cls, vec_id, embedding): two-means over each class's first principal
    axes, started at the ends of the first, the smaller cluster's share, and the mean silhouette.

    All rows of a class count. The distance of a row to a cluster is the root of its mean squared distance to the
    cluster's rows, which sums give exactly; the mean of plain distances, of which it is an upper bound, would take all
    pairs. Rows without a class or a vector take no part; vectors are of one length. A class whose rows are all equal
    has minority and silhouette 0. The driver gets 24 numbers of a class a round.
    """
    rows = rows.select("cls", "vec_id", "embedding").filter("cls IS NOT NULL AND embedding IS NOT NULL")
    cls = f"cls {dict(rows.dtypes)['cls']}"
    models = rows.select("cls", "embedding").mapInArrow(_moments, f"{cls}, sums binary").repartition("cls").mapInArrow(_axes(components), f"{cls}, sums binary")
    # a large class's rows are split by the adaptive skew join, which needs no key of ours
    z = shared_table(rows.join(models, "cls").mapInArrow(_project, f"{cls}, vec_id {dict(rows.dtypes)['vec_id']}, z array<double>"))
    order = F.struct(F.col("z")[0], "vec_id")
    ends = z.groupBy("cls").agg(F.min_by("z", order).alias("a"), F.max_by("z", order).alias("b")).collect()
    centres = {r.cls: np.array([r.a, r.b]) for r in ends}
    clusters: dict = {}
    for _ in range(rounds):
        found = {k: np.zeros((2, 2 + v.shape[1])) for k, v in centres.items()}
        for r in z.mapInArrow(_cluster_sums(centres), f"{cls}, at int, total double").groupBy("cls", "at").agg(F.sum("total").alias("total")).collect():
            found[r.cls].ravel()[r.at] = r.total
        moved = False
        clusters, now = {}, {}
        for k, s in found.items():
            n = s[:, 0]
            mean = np.where(n[:, None] > 0, s[:, 2:] / np.maximum(n, 1)[:, None], centres[k])
            clusters[k] = (n, s[:, 1] / np.maximum(n, 1), mean)
            now[k] = mean
            moved = moved or not np.allclose(mean, centres[k])
        if not moved:
            break
        used, centres = centres, now
    else:
        if clusters:
            centres = used  # the sides that the last sums are of
    each = z.mapInArrow(_silhouettes(centres, clusters), f"{cls}, small boolean, value double")
    return each.groupBy("cls").agg(F.count("*").alias("n"), F.avg(F.col("small").cast("double")).alias("minority"), F.avg("value").alias("silhouette"))


def flag_overlap(members: DataFrame, flags: DataFrame, least: float = 0.5) -> DataFrame:
    """(cls, n_minority, n_flagged, overlap, corroborated) of the smaller clusters, ``members`` (sample_id, cls), with samples that
    other checks flagged; a sample counts once however many flags it has."""
    seen = flags.select("sample_id", F.lit(1).alias("hit")).distinct()
    out = members.select("sample_id", "cls").join(seen, "sample_id", "left").groupBy("cls").agg(F.count("*").alias("n_minority"), F.count("hit").alias("n_flagged"))
    share = F.col("n_flagged") / F.col("n_minority")
    return out.select("cls", "n_minority", "n_flagged", share.alias("overlap"), (share >= least).alias("corroborated"))
