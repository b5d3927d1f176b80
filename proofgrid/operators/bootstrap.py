"""Bootstrap intervals without resampled copies: each row's weight in a replicate is drawn from a hash.

A row's weight in a replicate is Poisson with mean 1, so rows of one score and side together have one whose mean is their
number: weights are drawn for distinct scores, from a hash of score, side, replicate and seed, by the inverse distribution
up to 64 rows and by a rounded normal variate beyond. Reruns agree, whatever the partitions. Scores are dealt by range, and a
task adds up the rank sums of all replicates over its own scores; what the ranges before it add comes from their totals, so
that neither weights nor replicates of a score move between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

FEW = 64
#: Scores that a task draws for at once.
STEP = 1_024


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _below(n: int) -> np.ndarray:
    """The distribution of a Poisson variate of mean ``n``."""
    p, out = exp(-n), []
    for k in range(1, n + 20 * int(n**0.5 + 2)):
        out.append(p)
        p *= n / k
    return np.cumsum(out)


def _draws(n: np.ndarray, seed: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """(row, replicate): Poisson variates of means ``n``, each from a hash of its row's seed and replicate alone."""
    at = _mixed(seed.astype(np.int64).view(np.uint64))[:, None] + replicates.astype(np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    uniform = lambda x: ((x >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)
    first = uniform(_mixed(at))
    out = np.zeros(first.shape)
    for k in np.unique(n[(n > 0) & (n <= FEW)]):
        out[n == k] = np.searchsorted(_below(int(k)), first[n == k])
    if len(many := np.flatnonzero(n > FEW)):
        normal = np.sqrt(-2 * np.log(first[many])) * np.cos(2 * np.pi * uniform(_mixed(~at[many])))
        mean = n[many].astype(np.float64)[:, None]
        out[many] = np.maximum(0, np.round(mean + np.sqrt(mean) * normal))
    return out


@F.pandas_udf(T.IntegerType())
def _one_draw(n: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series(_draws(n.to_numpy(), seed.to_numpy(), np.array([1]))[:, 0].astype(np.int32))


def weight(n: Column, *keys: Column) -> Column:
    """A Poisson variate of mean ``n`` that depends on ``keys`` alone."""
    return _one_draw(n.cast("long"), F.xxhash64(*keys))


def _rank_sums(n_keys: int, kinds: list[pa.DataType], names: list[str], replicates: int):
    """Rows (keys, score, p, m, seeds of both) sorted by keys and score: for each key of a task its first score, and for each
    replicate the weights of both sides and the rank sum of the positive ones. Replicate 0 is the sample itself."""
    reps = np.arange(1, replicates + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, p, m, u = None, None, 0.0, 0.0, 0.0

        def out() -> pa.RecordBatch:
            same = [pa.array([v] * (replicates + 1), t) for v, t in zip(key, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*same, pa.array([first] * (replicates + 1), pa.float64()), pa.array(np.arange(replicates + 1, dtype=np.int32)), *map(pa.array, (p, m, u))], names)

        for whole in batches:
            for start in range(0, whole.num_rows, STEP):
                b = whole.slice(start, STEP)
                keys = list(zip(*(b.column(k).to_pylist() for k in range(n_keys)), strict=True)) if n_keys else [()] * b.num_rows
                score, n_pos, n_neg, s_pos, s_neg = (b.column(n_keys + k).to_numpy(zero_copy_only=False) for k in range(5))
                x, y = (np.hstack([n[:, None].astype(np.float64), _draws(n, s, reps)]) for n, s in ((n_pos, s_pos), (n_neg, s_neg)))
                edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
                for s, e in zip(edges[:-1], edges[1:], strict=True):
                    if key != keys[s]:
                        if key is not None:
                            yield out()
                        key, first, (p, m, u) = keys[s], score[s], np.zeros((3, replicates + 1))
                    u = u + (x[s:e] * (m + np.cumsum(y[s:e], 0) - y[s:e] / 2)).sum(0)
                    p, m = p + x[s:e].sum(0), m + y[s:e].sum(0)
        if key is not None:
            yield out()

    return run


def auroc_intervals(rows: DataFrame, keys: list[str], score: str, positive: Column, replicates: int = 500, level: float = 0.95, seed: int = 0) -> DataFrame:
    """(keys, n_pos, n_neg, auroc, low, high) with percentile intervals; keys with rows of one side only have nulls."""
    counts = rows.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.sum(positive.cast("long")).alias("p"), F.sum((~positive).cast("long")).alias("m"))
    counts = counts.select(*keys, "score", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("m", F.lit(0)).alias("m"), *(F.xxhash64(*keys, "score", F.lit(c), F.lit(seed)).alias(f"seed_{c}") for c in "pm"))
    fields = T.StructType([*(counts.schema[k] for k in keys), T.StructField("first", T.DoubleType()), T.StructField("rep", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in "pmu")])
    dealt = counts.repartitionByRange(*keys, "score").sortWithinPartitions(*keys, "score")
    parts = dealt.mapInArrow(_rank_sums(len(keys), [to_arrow_type(counts.schema[k].dataType) for k in keys], fields.names, replicates), fields)
    # a row for each range, key and replicate; the negative weights of the ranges before are below all of a range's positive ones
    before = F.coalesce(F.sum("m").over(Window.partitionBy(*keys, "rep").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    area = parts.withColumn("u", F.col("u") + F.col("p") * before).groupBy(*keys, "rep").agg(F.sum("p").alias("p"), F.sum("m").alias("m"), F.sum("u").alias("u"))
    area = area.withColumn("a", F.when((F.col("p") > 0) & (F.col("m") > 0), F.col("u") / F.col("p") / F.col("m")))
    own = F.col("rep") == 0
    edges = [(1 - level) / 2, (1 + level) / 2]
    spread = F.percentile(F.when(~own, F.col("a")), F.array(*map(F.lit, edges)))  # as many values as replicates
    out = area.groupBy(*keys).agg(F.max(F.when(own, F.col("p"))).cast("long").alias("n_pos"), F.max(F.when(own, F.col("m"))).cast("long").alias("n_neg"), F.max(F.when(own, F.col("a"))).alias("auroc"), spread.alias("s"))
    return out.select(*keys, "n_pos", "n_neg", "auroc", F.get("s", F.lit(0)).alias("low"), F.get("s", F.lit(1)).alias("high"))
