"""Statistics over groups of any size: prefix sums over range partitions, then aggregates of those.

Nothing here sorts a whole group in one task: `running` cuts each group at range-partition borders and adds
the totals of the partitions before, of which there are few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.functions.special import normal_tail
from proofgrid.operators.components import shared_table


def running(df: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str]) -> DataFrame:
    """``df`` (one row for each key and ``order`` value) with ``cum_<c>`` for each of ``sums``, inclusive, and ``next_``,
    the following value of ``order`` under the same keys."""
    part = shared_table(df.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()))
    totals = part.groupBy(*keys, "_part").agg(F.min(order).alias("_first"), *(F.sum(c).alias(f"_t_{c}") for c in sums))
    along = Window.partitionBy(*keys).orderBy("_part")
    before = totals.select(*keys, "_part", F.lead("_first").over(along).alias("_after"), *(F.coalesce(F.sum(f"_t_{c}").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_b_{c}") for c in sums))
    inside = Window.partitionBy(*keys, "_part").orderBy(order)
    out = part.join(before, [*keys, "_part"])
    for c in sums:
        out = out.withColumn(f"cum_{c}", F.col(f"_b_{c}") + F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("next_", F.coalesce(F.lead(order).over(inside), F.col("_after")))
    return out.drop("_part", "_after", *(f"_b_{c}" for c in sums))


def side_counts(df: DataFrame, keys: Sequence[str], value: str, is_ref: Column) -> DataFrame:
    """(keys, value, r, c): rows of the reference and of the current side by distinct value. Nulls and NaN don't count."""
    v = F.col(value)
    return df.filter(v.isNotNull() & ~F.isnan(v.cast("double"))).groupBy(*keys, v.cast("double").alias("value")).agg(F.sum(is_ref.cast("long")).alias("r"), F.sum((~is_ref).cast("long")).alias("c"))


def ecdf(df: DataFrame, keys: Sequence[str], value: str, is_ref: Column) -> DataFrame:
    """One row for each key and distinct value: r and c (rows of the reference and of the current side), running sums,
    totals and the next value. Nulls and NaN don't count."""
    return ecdf_of_counts(side_counts(df, keys, value, is_ref), keys)


def ecdf_of_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    totals = counts.groupBy(*keys).agg(F.sum("r").alias("n_ref"), F.sum("c").alias("n_cur"))
    return running(counts, keys, "value", ["r", "c"]).join(totals, list(keys))


def quantile(p: float, cum: str, total: str, value: str = "value") -> Column:
    """An aggregate over running counts ``cum`` of ``total`` rows by distinct value: the exact quantile, interpolated between
    the two ranks around it. Partial results are two numbers, so that no task gets a group's values."""
    at = F.lit(p) * (F.max(total) - 1)
    low, high = (F.min(F.when((F.col(total) > 0) & (F.col(cum) > f(F.lit(p) * (F.col(total) - 1))), F.col(value))) for f in (F.floor, F.ceil))
    return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def compare(df: DataFrame, keys: Sequence[str], value: str, is_ref: Column, least: int = 5) -> DataFrame:
    """For each key: n_ref, n_cur, KS statistic, Wasserstein distance and Cliff's delta (current against reference)."""
    return compare_ecdf(ecdf(df, keys, value, is_ref), keys, least)


def compare_ecdf(steps: DataFrame, keys: Sequence[str], least: int = 5) -> DataFrame:
    """The same from the result of ``ecdf``, with the medians of both sides."""
    gap = F.col("cum_r") / F.col("n_ref") - F.col("cum_c") / F.col("n_cur")
    wins = F.col("c") * (2 * F.col("cum_r") - F.col("r") - F.col("n_ref"))
    return (
        steps.filter((F.col("n_ref") >= least) & (F.col("n_cur") >= least))
        .groupBy(*keys, "n_ref", "n_cur")
        .agg(F.max(F.abs(gap)).alias("ks"), F.sum(F.abs(gap) * F.coalesce(F.col("next_") - F.col("value"), F.lit(0.0))).alias("wasserstein"), F.sum(wins).alias("_wins"), quantile(0.5, "cum_r", "n_ref").alias("ref_median"), quantile(0.5, "cum_c", "n_cur").alias("cur_median"))
        .select(*keys, "n_ref", "n_cur", "ks", "wasserstein", (F.col("_wins") / F.col("n_ref") / F.col("n_cur")).alias("delta"), "ref_median", "cur_median")
    )


def bh_qvalues(df: DataFrame, p: str, by: Sequence[str] = (), out: str = "q") -> DataFrame:
    """Step-up adjusted p-values. The rows are tests (one for each contributor, axis or position), which are few."""
    asc = Window.partitionBy(*by).orderBy(p)
    ranked = df.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).withColumn("_i", F.row_number().over(asc))
    back = Window.partitionBy(*by).orderBy(F.col("_i").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_i")).over(back))).drop("_n", "_i")


def bh_qvalues_of_rows(df: DataFrame, p: str, out: str = "q") -> DataFrame:
    """The same for tests as many as rows: from counts by distinct p, prefix sums, and a minimum from above in two levels
    (4,096 ranges of ranks, then inside each), so that no task orders all. Rows without a p take no part and get none."""
    df = shared_table(df)  # read twice, and joined on its values
    ranked = running(df.filter(F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("_p")).agg(F.count("*").alias("n")), [], "_p", ["n"])
    t = ranked.crossJoin(F.broadcast(ranked.agg(F.max("cum_n").alias("_all"))))  # one row
    t = t.select("_p", (F.col("_p") * F.col("_all") / F.col("cum_n")).alias("_raw"), F.floor(F.col("cum_n") * 4096 / F.col("_all")).cast("int").alias("_range"))
    above = Window.orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = t.groupBy("_range").agg(F.min("_raw").alias("_low")).select("_range", F.min("_low").over(above).alias("_later"))  # 4,097 rows at most
    inside = Window.partitionBy("_range").orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, 0)
    q = t.withColumn("_own", F.min("_raw").over(inside)).join(F.broadcast(later), "_range").select("_p", F.least(F.lit(1.0), "_own", "_later").alias(out))
    return df.join(q, F.col(p).cast("double") == F.col("_p"), "left").drop("_p")


def robust_z(df: DataFrame, x: str, by: Sequence[str], out: str = "z", or_mean: bool = True) -> DataFrame:
    """Modified z-score in each group: the median and the scaled median deviation, or the scaled mean one if that is 0.
    Without ``or_mean`` a median deviation of 0 leaves the floating-point quotient: NaN at the median, else infinity."""
    keys = list(by)
    med = df.groupBy(*keys).agg(F.percentile(x, 0.5).alias("_med"))
    near = df.join(med, keys)
    dev = near.groupBy(*keys).agg(F.percentile(F.abs(F.col(x) - F.col("_med")), 0.5).alias("_mad"), F.avg(F.abs(F.col(x) - F.col("_med"))).alias("_mean"))
    mean = F.col("_mean") * 1.2533
    scale = F.when(F.col("_mad") * 1.4826 >= 1e-12, F.col("_mad") * 1.4826).when(mean > 0, mean).otherwise(1e-12)
    off = F.col(x) - F.col("_med")
    none = F.when(off > 0, float("inf")).when(off < 0, float("-inf")).when(off == 0, float("nan"))
    z = off / scale if or_mean else F.when(F.col("_mad") == 0, none).otherwise(off / F.nullif(F.col("_mad") * 1.4826, F.lit(0.0)))
    return near.join(dev, keys).withColumn(out, z).drop("_med", "_mad", "_mean")


def conformal_pvalues(calibration: DataFrame, test: DataFrame, score: str, out: str = "p") -> DataFrame:
    """``test`` with (1 + calibration scores at or above) / (n + 1)."""
    both = calibration.select(F.col(score).cast("double").alias("s"), F.lit(1).alias("cal")).unionByName(test.select(F.col(score).cast("double").alias("s"), F.lit(0).alias("cal")))
    counts = both.groupBy("s").agg(F.sum("cal").alias("n"))
    total = calibration.agg(F.count(score).alias("_n"))
    ranked = running(counts, [], "s", ["n"]).crossJoin(F.broadcast(total))  # total is one row
    p = ranked.select(F.col("s").alias("_s"), ((1 + F.col("_n") - F.col("cum_n") + F.col("n")) / (F.col("_n") + 1)).alias(out))
    return test.join(p, F.col(score).cast("double") == F.col("_s")).drop("_s")


def psi(df: DataFrame, keys: Sequence[str], value: str, is_ref: Column, bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """Population stability index over the reference's quantile bins, the outer ones open; 0 with fewer than 3 edges."""
    # rows are counted by value first, so that quantiles and bins handle each distinct value once
    seen = shared_table(df.groupBy(*keys, value).agg(F.sum(is_ref.cast("long")).alias("r"), F.sum((~is_ref).cast("long")).alias("c")))
    known = seen.filter(F.col("r") > 0).filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("value"), "r", "c")
    return psi_of_counts(seen, ecdf_of_counts(known, keys), keys, value, bins, eps)


def psi_of_counts(seen: DataFrame, steps: DataFrame, keys: Sequence[str], value: str = "value", bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """The same from rows counted by value (keys, value, r, c) and their ``ecdf``, which gives the edges."""
    edges = F.array_distinct(F.array(*(quantile(i / bins, "cum_r", "n_ref") for i in range(bins + 1))))
    cuts = shared_table(steps.filter("n_ref > 0").groupBy(*keys).agg(edges.alias("edges")))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    at = seen.join(cuts, list(keys)).withColumn("bin", F.size(F.filter(inner, lambda e: F.col(value) >= e)))
    counts = at.groupBy(*keys, "edges", "bin").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    all_bins = counts.groupBy(*keys, "edges").agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"), F.map_from_entries(F.collect_list(F.struct("bin", F.struct("r", "c").alias("n")))).alias("m"))
    bin_ = lambda side, total: lambda b: F.coalesce(F.try_element_at("m", b)[side], F.lit(0)) / F.col(total) + eps
    r, c = bin_("r", "nr"), bin_("c", "nc")
    total = F.aggregate(F.sequence(F.lit(0), F.size("edges") - 2), F.lit(0.0), lambda acc, b: acc + (c(b) - r(b)) * F.log(c(b) / r(b)))
    return all_bins.select(*keys, F.when(F.size("edges") < 3, 0.0).otherwise(total).alias("psi"))


def reliability(df: DataFrame, prob: str, label: str, bins: int = 10) -> DataFrame:
    """One row for each equal bin that has rows: n, mean prediction, observed rate. The last bin is closed."""
    b = F.least(F.floor(F.col(prob) * bins), F.lit(bins - 1))
    return df.groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(prob).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("observed_rate"))


def mann_whitney(rows: DataFrame, group: str, value: str, least: int = 8) -> DataFrame:
    """(a, b, n_a, n_b, u, z, p) for each two groups a < b of at least ``least`` values: U of a over b with ties halved, and the
    two-sided p-value of the normal approximation, corrected for ties and continuity (1 if all values are equal).

    Rows are counted by value before they meet other groups, so a pair handles each distinct value once. Nulls and NaN don't count.
    """
    v = F.col(value).cast("double")
    counts = shared_table(rows.filter(F.col(group).isNotNull() & v.isNotNull() & ~F.isnan(v)).groupBy(F.col(group).alias("g"), v.alias("value")).agg(F.count("*").alias("n")))
    sizes = counts.groupBy("g").agg(F.sum("n").alias("size")).filter(F.col("size") >= least)
    names = sizes.agg(F.collect_list("g").alias("names"))
    met = counts.join(sizes.select("g"), "g").crossJoin(F.broadcast(names)).select("g", "value", "n", F.explode("names").alias("o")).filter("g <> o")  # names is one row
    first = F.col("g") < F.col("o")
    met = met.groupBy(F.least("g", "o").alias("a"), F.greatest("g", "o").alias("b"), "value").agg(F.sum(F.when(first, F.col("n")).otherwise(0)).alias("x"), F.sum(F.when(first, 0).otherwise(F.col("n"))).alias("y"))
    t = (F.col("x") + F.col("y")).cast("double")
    out = running(met, ["a", "b"], "value", ["y"]).groupBy("a", "b").agg(F.sum("x").alias("n_a"), F.sum("y").alias("n_b"), F.sum(F.col("x") * (F.col("cum_y") - F.col("y") / 2)).alias("u"), F.sum(t * t * t - t).alias("ties"))
    n, m = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    variance = n * m / 12 * (n + m + 1 - F.col("ties") / ((n + m) * (n + m - 1)))
    z = F.when(variance <= 0, 0.0).otherwise(F.greatest(F.abs(F.col("u") - n * m / 2) - 0.5, F.lit(0.0)) / F.sqrt(variance))
    return out.select("a", "b", "n_a", "n_b", "u", z.alias("z")).withColumn("p", F.least(F.lit(1.0), 2 * normal_tail("z")))
