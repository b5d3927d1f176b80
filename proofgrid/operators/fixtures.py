"""Damage to sample tables with known truth, for tests: by a hash of the id, never by chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chosen(id_col: str, share: float, seed: str) -> Column:
    """True for about ``share`` of the ids."""
    return F.pmod(F.xxhash64(F.lit(seed), id_col), F.lit(1_000_000)) < int(share * 1_000_000)


def flip_labels(samples: DataFrame, contributor: str, source: str, target: str, share: float = 0.9) -> DataFrame:
    hit = (F.col("contributor") == contributor) & (F.col("label") == source) & chosen("sample_id", share, f"flip {contributor}")
    return samples.withColumn("true_label", F.col("label")).withColumn("label", F.when(hit, target).otherwise(F.col("label")))


def flood(samples: DataFrame, contributor: str, originals: int, copies: int) -> DataFrame:
    """``samples`` and ``copies`` copies of each of a contributor's first rows by hash, with ids of their own."""
    base = samples.filter(F.col("contributor") == contributor).orderBy(F.xxhash64("sample_id"), "sample_id").limit(originals)
    extra = base.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("sample_id", F.concat_ws("#", F.col("sample_id").cast("string"), F.col("_k").cast("string"))).drop("_k")
    return samples.withColumn("sample_id", F.col("sample_id").cast("string")).unionByName(extra)


def burst(samples: DataFrame, contributor: str, start: str, share: float = 0.2, step_s: int = 2) -> DataFrame:
    """A contributor's chosen rows moved into one run of uploads."""
    hit = (F.col("contributor") == contributor) & chosen("sample_id", share, f"burst {contributor}")
    at = F.timestamp_add("SECOND", F.pmod(F.xxhash64("sample_id"), F.lit(100)) * step_s, F.lit(start).cast("timestamp"))
    return samples.withColumn("timestamp", F.when(hit, at).otherwise(F.col("timestamp")))


def shift_axis(axes: DataFrame, axis: str, factor: float, offset: float = 0.0) -> DataFrame:
    moved = ~F.col("is_ref") & (F.col("axis") == axis)
    return axes.withColumn("value", F.when(moved, F.col("value") * factor + offset).otherwise(F.col("value")))
