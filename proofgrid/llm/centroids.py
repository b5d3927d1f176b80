"""Lloyd's clustering of quantised vectors with weights: equal vectors are moved and measured once.

1. ``quantised``: vectors of exactly ``dim`` components, none null or non-finite, become integers floor(scale * x), with
   x as double. Other rows have no result.
2. Equal quantised vectors are grouped with their number (partial counts before the shuffle, so a vector that a third of
   all rows hold costs a row a task); the distinct ones are written to the shared folder.
3. The first centroids are the vectors of the ``k`` rows with the least sha256 of ``seed:<vec_id>`` (fewer if there are
   fewer rows). In each round every task assigns its distinct vectors and sends at most ``k`` weighted integer sums; their
   total is floor-divided. Only ``k`` centroids reach the driver, and go to the tasks again.
4. The distinct vectors' clusters are joined back to the rows; vectors that very many rows hold go by broadcast.

All arithmetic is exact: blocks whose distances stay below 2^53 go through floating point products, others through Python
integers. A distance or sum of distances beyond a long is given as the largest long; a component beyond +-2^53 is taken
as that. Ties go to the smaller centroid. A null id is hashed like the others of no id (as ``seed:``); rows that repeat
count each and have a row each; among rows of equal id the lesser vector is the earlier seed. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import bounded, columns, cut, shared_join

LARGEST = 2**63 - 1
_COMPONENT = 2**53
#: Components up to this have distances below 2^53 in 64 dimensions, where floating point is exact.
_EXACT = 2**22
STEP = 4_096


def _quantum(x: Column, scale: int) -> Column:
    return F.greatest(F.lit(-_COMPONENT), F.least(F.lit(_COMPONENT), F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))).cast("long")


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, q array<long>) of the vectors that take part."""
    v = F.col(vector_col)
    fit = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return vectors.filter(fit).select(F.col(id_col).alias("vec_id"), F.transform(v, lambda x: _quantum(x, scale)).alias("q"))


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(q, n): each distinct vector and how many rows hold it, as a table."""
    return cut(rows.groupBy("q").agg(F.count("*").alias("n")), "vectors")


def first_centroids(rows: DataFrame, k: int, seed: str) -> list[list[int]]:
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r.q) for r in rows.select("q", mark.alias("mark")).orderBy("mark", "q").limit(k).collect()]


def _nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """The nearest centroid of each row, the first of equals, and the exact squared distance."""
    c = np.array(centroids, np.int64)
    if max(np.abs(x).max(), np.abs(c).max()) <= _EXACT * 64 // max(64, x.shape[1]):
        a, b = x.astype(np.float64), c.astype(np.float64)
        d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]
        best = d.argmin(1)
        return best, d[np.arange(len(x)), best].astype(np.int64).tolist()
    a, b = x.astype(object), c.astype(object)
    d = np.stack([((a - row) ** 2).sum(1) for row in b], 1)
    best = d.argmin(1)
    return best, d[np.arange(len(x)), best].tolist()


def _blocks(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for start in range(0, batch.num_rows, STEP):
        part = batch.slice(start, STEP)
        yield part, columns(part, "q").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)


def _sums(centroids: list[list[int]]):
    """Tasks' weighted sums: (cluster, place, total); place is a component's, or -1 for the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = len(centroids), len(centroids[0])
        total = [[0] * (dim + 1) for _ in range(k)]
        for batch in batches:
            for part, x in _blocks(batch, dim):
                best, _ = _nearest(x, centroids)
                n = columns(part, "n").to_numpy(zero_copy_only=False)
                small = int(np.abs(x).max()) * int(n.sum()) < 2**62
                for j in np.unique(best).tolist():
                    own = best == j
                    sums = (x[own] * n[own, None]).sum(0) if small else (x[own].astype(object) * n[own, None].astype(object)).sum(0)
                    for i, s in enumerate([*sums.tolist(), int(n[own].sum())]):
                        total[j][i] += s
        used = [j for j in range(k) if total[j][dim]]
        if used:
            exact = pa.array([str(s) for j in used for s in total[j]]).cast(pa.decimal128(38, 0))
            place = [*range(dim), -1] * len(used)
            yield pa.RecordBatch.from_arrays([pa.array([j for j in used for _ in range(dim + 1)], pa.int32()), pa.array(place, pa.int32()), exact], ["cluster", "place", "total"])

    return run


def _assigned(centroids: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in _blocks(batch, len(centroids[0])):
                best, d = _nearest(x, centroids)
                near = pa.array([min(v, LARGEST) for v in d], pa.int64())
                yield pa.RecordBatch.from_arrays([columns(part, "q"), columns(part, "n"), pa.array(best.astype(np.int32)), near], ["q", "n", "cluster", "distance"])

    return run


def lloyd(distinct: DataFrame, centroids: list[list[int]], rounds: int) -> list[list[int]]:
    """The centroids after so many rounds over the weighted distinct vectors."""
    for _ in range(rounds if centroids else 0):
        parts = distinct.mapInArrow(_sums(centroids), "cluster int, place int, total decimal(38,0)")
        sums = {(r.cluster, r.place): int(r.total) for r in parts.groupBy("cluster", "place").agg(F.sum("total").cast("decimal(38,0)").alias("total")).collect()}
        centroids = [[sums[j, i] // sums[j, -1] for i in range(len(c))] if (j, -1) in sums else c for j, c in enumerate(centroids)]
    return centroids


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, seed: str = "2") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, copies) of every vector that takes part.

    copies: how many rows hold the same quantised vector. The digest is that of the final centroid's components, in
    decimal and joined by commas.
    """
    spark = bounded(vectors.sparkSession)
    rows = quantised(vectors, id_col, vector_col, dim, scale)
    distinct = distinct_vectors(rows)
    final = lloyd(distinct, first_centroids(rows, k, seed), rounds)
    kind = "q array<bigint>, n bigint, cluster int, distance bigint"
    if not final:
        placed = distinct.select("*", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    else:
        placed = cut(distinct.mapInArrow(_assigned(final), kind), "assigned")
    exact = F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n"))
    own = {r.cluster: (int(r.d), r.n) for r in placed.groupBy("cluster").agg(exact.cast("decimal(38,0)").alias("d"), F.sum("n").alias("n")).collect()}
    inertia = min(sum(d for d, _ in own.values()), LARGEST)
    about = [(j, min(d, LARGEST), inertia, hashlib.sha256(",".join(map(str, final[j])).encode()).hexdigest()) for j, (d, _) in own.items() if final]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    back = shared_join(rows, placed, ["q"], "n", sum(n for _, n in own.values())).drop("q")
    out = back.join(F.broadcast(about), "cluster")  # at most k rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", F.col("n").alias("copies"))


def sql(dim: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, seed: str = "2") -> str:
    """The same rows by plain Lloyd over all vectors, for DuckDB."""
    parts = [f"""v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""", f"""c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS j, q FROM v ORDER BY j LIMIT {k})"""]
    near = lambda i: f"""a{i} AS (
  SELECT r, vec_id, v.q, j, list_sum(list_transform(list_zip(v.q, c{i}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM v CROSS JOIN c{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, j) = 1)"""  # noqa: E731
    for i in range(rounds):
        parts += [near(i), f"""u{i} AS (
  SELECT j, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT j, unnest(q) AS x, unnest(range({dim})) AS i FROM a{i}) GROUP BY j, i)""", f"""c{i + 1} AS (
  SELECT c{i}.j, coalesce(m.q, c{i}.q) AS q FROM c{i} LEFT JOIN (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM u{i} GROUP BY j) m ON m.j = c{i}.j)"""]
    parts.append(near(rounds))
    return f"""WITH {', '.join(parts)}
SELECT vec_id, a{rounds}.j::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a{rounds}.j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c{rounds}.q, ',')) AS centroid_sha256, count(*) OVER (PARTITION BY a{rounds}.q) AS copies
FROM a{rounds} JOIN c{rounds} ON c{rounds}.j = a{rounds}.j"""
