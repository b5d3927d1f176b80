"""Localized trigger patterns: windows that are hot in many images at one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.functions import special
from proofgrid.operators.statistics import bh_qvalues


def hot_windows(energies: DataFrame, id_col: str = "sample_id", limit: float = 6.0) -> DataFrame:
    """(id, position): windows far above their own image's median in scaled deviations."""
    e = F.col("energies")
    med = lambda a: (F.element_at(F.array_sort(a), (F.floor((F.size(a) + 1) / 2)).cast("int")) + F.element_at(F.array_sort(a), (F.floor(F.size(a) / 2) + 1).cast("int"))) / 2
    rows = energies.filter(F.size("energies") > 0).select(id_col, e, med(e).alias("m")).withColumn("mad", med(F.transform("energies", lambda x: F.abs(x - F.col("m")))) * 1.4826)
    each = rows.select(id_col, "m", "mad", F.posexplode("energies").alias("position", "energy"))
    return each.filter(F.col("energy") - F.col("m") > limit * F.greatest("mad", F.lit(1e-12))).select(id_col, "position")


def persistent_positions(hot: DataFrame, images: int, positions: int, least: int = 6, alpha: float = 0.01) -> DataFrame:
    """(position, k, q): places that are hot in more images than the mean rate over all places explains."""
    counts = hot.groupBy("position").agg(F.count("*").alias("k"))
    total = counts.agg(F.sum("k").alias("all"))
    t = counts.crossJoin(F.broadcast(total)).withColumn("rate", F.col("all") / (images * positions))  # one row
    t = t.withColumn("p", special.binomial_tail(F.col("k").cast("double"), F.lit(float(images)), "rate"))
    return bh_qvalues(t, "p").filter((F.col("q") < alpha) & (F.col("k") >= least)).select("position", "k", "q")


def occlusion(rows: DataFrame) -> DataFrame:
    """(members, controls, dependent) for rows (member, before, after): labels that flip when the region is covered."""
    rate = lambda m: F.avg(F.when(F.col("member") == m, (F.col("before") != F.col("after")).cast("int")))
    out = rows.agg(rate(True).alias("members"), rate(False).alias("controls"))
    return out.withColumn("dependent", (F.col("members") >= 0.3) & (F.col("members") >= 3 * F.greatest("controls", F.lit(1e-9))))
