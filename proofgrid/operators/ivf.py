"""Nearest neighbours through an inverted file: vectors by cell, queries that ask the cells most likely to hold theirs.

`fit` clusters a sample of the base, chosen by a hash of the id and of about ``sample`` rows, into cells, and takes as many
cells for a query as put a share ``aim`` of the sample's own nearest neighbours within reach. `search` puts every base row
in its nearest cell; cells beyond ``block`` rows are split by a hash of the id, so no task holds a large one. Distances in
the cells that a query asks are exact, and so is the order among them; neighbours in other cells are missed, which `recall`
measures against the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.operators.components import shared_table
from proofgrid.operators.pairs import _solve, nearest


@dataclass(frozen=True)
class Cells:
    centres: np.ndarray
    probes: int
    metric: str

    def _unit(self, x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if self.metric == "cosine" else x


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def fit(base: DataFrame, id_col: str, vector: str, k: int, metric: str = "euclidean", sample: int = 20_000, cells: int | None = None, aim: float = 0.97, rounds: int = 10, seed: int = 0) -> Cells:
    n = base.count()
    share = min(1.0, sample / max(1, n))
    kept = base.filter((F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))) & F.col(vector).isNotNull())
    x = np.array([r[0] for r in kept.select(F.col(vector).cast("array<double>")).collect()], np.float64)  # about ``sample`` rows
    if not len(x):
        return Cells(np.zeros((1, 1)), 1, metric)
    made = Cells(np.zeros((1, x.shape[1])), 1, metric)
    x = np.unique(made._unit(x), axis=0)  # copies would be centres of the same cell
    cells = cells or max(1, min(4_096, round(n**0.5), len(x) // 8))
    cells = min(cells, len(x))
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), cells, replace=False))]
    nearest_cell = lambda: np.concatenate([_squares(x[a : a + 2_000], centres).argmin(1) for a in range(0, len(x), 2_000)])
    for _ in range(rounds):
        own = nearest_cell()
        for c in np.unique(own):
            centres[c] = x[own == c].mean(0)
    own = nearest_cell()
    asked = rng.choice(len(x), min(300, len(x)), replace=False)
    near = _squares(x[asked], x)
    near[np.arange(len(asked)), asked] = np.inf
    true = np.argsort(near, axis=1)[:, : min(k, max(1, len(x) - 1))]
    place = np.argsort(np.argsort(_squares(x[asked], centres), axis=1), axis=1)  # the rank of each cell for each query
    ranks = np.take_along_axis(place, own[true], axis=1)
    return Cells(centres, min(cells, int(np.quantile(ranks, aim, method="higher")) + 1), metric)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :]


def _placed(cells: Cells, many: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1_024):
                part = batch.slice(a, 1_024)
                found = np.argsort(_squares(cells._unit(_rows(part.column(1))), cells.centres), axis=1, kind="stable")[:, :many]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["id", "v", "cells"])

    return run


def search(queries: DataFrame, base: DataFrame, id_col: str, vector: str, k: int, cells: Cells, block: int = 4_096) -> DataFrame:
    """(query, neighbour, distance, rank): the k nearest other base rows in the cells that each query asks; a query whose
    cells hold fewer than k others is searched exactly."""
    kind = dict(base.dtypes)[id_col]
    thin = lambda df, many: df.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(_placed(cells, many), f"id {kind}, v array<double>, cells array<int>")
    held = shared_table(thin(base, 1).select("id", "v", F.col("cells")[0].alias("cell")))
    parts = F.broadcast(held.groupBy("cell").agg(F.ceil(F.count("*") / block).alias("parts")))  # a row a cell
    b = held.join(parts, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), F.lit(True).alias("is_base"), "id", "v")
    q = thin(queries, cells.probes).select("id", "v", F.explode("cells").alias("cell")).join(parts, "cell")
    q = q.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(False).alias("is_base"), "id", "v")
    dealt = b.unionByName(q).select((F.col("cell").cast("long") * (1 << 32) + F.col("part")).alias("block"), "is_base", "id", "v").repartition("block").sortWithinPartitions("block", F.col("is_base").desc())
    best = dealt.mapInArrow(_solve(k, cells.metric), f"query {kind}, neighbour {kind}, distance double")
    last = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    out = shared_table(best.withColumn("rank", last).filter(F.col("rank") <= k))
    full = out.filter(F.col("rank") == k).select(F.col("query").alias(id_col))
    short = shared_table(queries.filter(F.col(vector).isNotNull()).select(id_col, vector).join(full, id_col, "left_anti"))
    if short.isEmpty():
        return out
    rest = nearest(short, base.filter(F.col(vector).isNotNull()), id_col, vector, k, cells.metric)
    return out.join(short.select(F.col(id_col).alias("query")), "query", "left_anti").unionByName(rest)


def recall(found: DataFrame, queries: DataFrame, base: DataFrame, id_col: str, vector: str, k: int, metric: str = "euclidean") -> DataFrame:
    """(n_true, n_found): neighbours by the exact search, and how many of them ``found`` has."""
    true = nearest(queries, base, id_col, vector, k, metric).select("query", "neighbour")
    hit = found.select("query", "neighbour", F.lit(1).alias("hit"))
    return true.join(hit, ["query", "neighbour"], "left").agg(F.count("*").alias("n_true"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_found"))
