"""Drift between a reference and a current population."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from proofgrid.functions import columns as c
from proofgrid.functions import special
from proofgrid.operators import interpretation as ip
from proofgrid.operators import statistics as st
from proofgrid.operators.components import shared_table
from proofgrid.plans import bindings as b
from proofgrid.plans.catalog import query
from proofgrid.plans.statistics import _ECDF


def compare_axes(axes, keys=("axis",)):
    """Medians, shift, KS with its asymptotic p and q, PSI, Wasserstein and Cliff's delta of each axis."""
    keys = list(keys)
    is_ref = F.col("is_ref")
    counts = shared_table(st.side_counts(axes, keys, "value", is_ref))  # all but the deviation comes from these
    steps = shared_table(st.ecdf_of_counts(counts, keys))
    sd = axes.groupBy(*keys).agg(F.stddev_pop(F.when(is_ref, F.col("value"))).alias("sd"))
    out = st.compare_ecdf(steps, keys).join(sd, keys).join(st.psi_of_counts(counts, steps, keys), keys)
    sd = F.when(F.col("sd") > 0, F.col("sd")).otherwise(1e-9)
    out = out.withColumn("shift_sd", (F.col("cur_median") - F.col("ref_median")) / sd).withColumn("wasserstein_sd", F.col("wasserstein") / sd)
    out = out.withColumn("p", special.ks_pvalue("ks", F.col("n_ref").cast("double"), F.col("n_cur").cast("double")))
    return st.bh_qvalues(out, "p", [k for k in keys if k != "axis"]).withColumn("magnitude", c.effect_label(F.col("delta"))).drop("sd", "wasserstein")


def severity(results, alpha=0.01, effect=0.147):
    """HIGH with two large material axes, MEDIUM with one large or two material, LOW with one, else INFO."""
    material = (F.col("q") < alpha) & (F.abs("delta") >= effect)
    n = results.agg(F.count_if(material).alias("material"), F.count_if(material & (F.col("magnitude") == "large")).alias("large"))
    return n.withColumn("severity", F.when(F.col("large") >= 2, "HIGH").when((F.col("large") == 1) | (F.col("material") >= 2), "MEDIUM").when(F.col("material") == 1, "LOW").otherwise("INFO"))


@query("SELECT axis, round(quantile_cont(value, 0.5) FILTER (is_ref), 6) AS ref_median, round(quantile_cont(value, 0.5) FILTER (NOT is_ref), 6) AS cur_median, count(*) FILTER (is_ref) AS n_ref, count(*) FILTER (NOT is_ref) AS n_cur FROM (" + b.AXES_SQL + ") GROUP BY axis")
def drift_axes(spark, d):
    return compare_axes(b.axes(spark, d)).select("axis", F.round("ref_median", 6).alias("ref_median"), F.round("cur_median", 6).alias("cur_median"), "n_ref", "n_cur")


@query(_ECDF.format(src="SELECT is_ref, grp || '/' || axis AS axis, value FROM (" + b.AXES_SQL + ")") + " SELECT split_part(axis, '/', 1) AS grp, split_part(axis, '/', 2) AS axis, round(max(abs(fr - fc)), 9) AS ks FROM f GROUP BY ALL")
def drift_groups(spark, d):
    return st.compare(b.axes(spark, d), ["grp", "axis"], "value", F.col("is_ref"), least=15).select("grp", "axis", F.round("ks", 9).alias("ks"))


@query()
def drift_material(spark, d):
    """p-values are asymptotic; the oracle would need the same series."""
    return severity(compare_axes(b.axes(spark, d)))


@query("""WITH x AS (SELECT event_type, ts < TIMESTAMP '2024-01-16' AS is_ref FROM events), k AS (SELECT event_type, count(*) FILTER (is_ref) + 0.5 AS r, count(*) FILTER (NOT is_ref) + 0.5 AS c FROM x GROUP BY 1),
t AS (SELECT sum(r) AS nr, sum(c) AS nc, sum(r + c) AS n FROM k)
SELECT round(sum((r - (r + c) * nr / n) * (r - (r + c) * nr / n) / ((r + c) * nr / n) + (c - (r + c) * nc / n) * (c - (r + c) * nc / n) / ((r + c) * nc / n)), 6) AS chi2, round(max(c / nc - r / nr), 8) AS largest_increase FROM k, t""")
def class_mix_shift(spark, d):
    e = b.read(spark, d, "events").select("event_type", (F.col("ts") < F.lit("2024-01-16").cast("timestamp")).alias("is_ref"))
    k = e.groupBy("event_type").agg((F.count_if("is_ref") + 0.5).alias("r"), (F.count_if(~F.col("is_ref")) + 0.5).alias("c"))
    t = k.agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"), F.sum(F.col("r") + F.col("c")).alias("n"))
    z = k.crossJoin(F.broadcast(t))  # t is one row
    part = lambda x, total: F.pow(F.col(x) - (F.col("r") + F.col("c")) * F.col(total) / F.col("n"), 2) / ((F.col("r") + F.col("c")) * F.col(total) / F.col("n"))
    return z.agg(F.round(F.sum(part("r", "nr") + part("c", "nc")), 6).alias("chi2"), F.round(F.max(F.col("c") / F.col("nc") - F.col("r") / F.col("nr")), 8).alias("largest_increase"))


@query()
def drift_interpretation(spark, d):
    """A verdict for each group from its share of material axes and their common direction."""
    r = compare_axes(b.axes(spark, d), ["grp", "axis"])
    material = (F.col("q") < 0.01) & (F.abs("delta") >= 0.147)
    g = r.groupBy("grp").agg(F.count("*").alias("axes"), F.count_if(material).alias("material"), F.max(F.abs("delta")).alias("strongest"))
    others = g.agg(F.count_if(F.col("material") > 0).alias("moved"), F.count("*").alias("groups"))
    out = g.crossJoin(F.broadcast(others))  # one row
    verdict = F.when(F.col("material") == 0, "NONE").when(F.col("moved") == F.col("groups"), "OPERATIONAL").when((F.col("moved") == 1) & (F.col("groups") > 1), "SUSPICIOUS").otherwise("UNDETERMINED")
    return out.select("grp", "axes", "material", F.round("strongest", 6).alias("strongest"), verdict.alias("verdict"))


def _seed(*names) -> int:
    import hashlib

    return int.from_bytes(hashlib.sha256("|".join(map(str, names)).encode()).digest()[:8], "big") & (2**63 - 1)


def mmd(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, permutations: int = 200) -> tuple[float, float]:
    """Unbiased squared MMD with a median-heuristic kernel, and its permutation p-value."""
    z = np.vstack([x, y])
    sq = (z * z).sum(1)
    dist = np.maximum(sq[:, None] + sq - 2 * z @ z.T, 0)
    kernel = np.exp(-dist / (np.median(dist[np.triu_indices(len(z), 1)]) or 1.0))
    np.fill_diagonal(kernel, 0)
    n, m = len(x), len(y)

    def value(side: np.ndarray) -> float:
        both = kernel @ side
        xx, all_x = side @ both, both.sum()
        total = kernel.sum()
        yy = total - 2 * all_x + xx
        return xx / (n * (n - 1)) + yy / (m * (m - 1)) - 2 * (all_x - xx) / (n * m)

    side = np.zeros(len(z))
    side[:n] = 1
    seen = value(side)
    return float(seen), float((1 + sum(value(rng.permutation(side)) >= seen for _ in range(permutations))) / (permutations + 1))


def bounded(df, id_col, most):
    """At most ``most`` rows, the first by a hash of the id."""
    return df.orderBy(F.xxhash64(id_col), id_col).limit(most)


def mmd_test(x, y, id_col, vector, most=300, permutations=200, seed="mmd"):
    """(mmd2, p) on at most ``most`` rows of each side, in one task: the test's own bound."""
    rows = bounded(x, id_col, most).select(F.lit(0).alias("side"), id_col, F.col(vector).alias("v")).unionByName(bounded(y, id_col, most).select(F.lit(1).alias("side"), id_col, F.col(vector).alias("v")))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", id_col])
        v = np.vstack(pdf["v"].to_numpy()).astype(float)
        side = pdf["side"].to_numpy()
        return pd.DataFrame([mmd(v[side == 0], v[side == 1], np.random.default_rng(_seed(seed)), permutations)], columns=["mmd2", "p"])

    return rows.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "mmd2 double, p double")


@query()
def mmd_permutation(spark, d):
    v = b.vectors(spark, d)
    return mmd_test(v.filter("label < 5"), v.filter("label >= 5"), "vec_id", "embedding")


def c2st(x, y, id_col, vector, most=600, folds=5, penalty=0.5):
    """(auc) of a logistic regression that tells the sides apart, by folds over a hash of the id."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = bounded(x, id_col, most).withColumn("label", F.lit(0.0)).unionByName(bounded(y, id_col, most).withColumn("label", F.lit(1.0)))
    rows = rows.select(F.col(id_col).alias("id"), "label", array_to_vector(vector).alias("features"), F.pmod(F.xxhash64(id_col), F.lit(folds)).alias("fold")).cache()
    scored = None
    for k in range(folds):
        train = rows.filter(F.col("fold") != k)
        model = LogisticRegression(regParam=1 / (penalty * max(1, train.count())), elasticNetParam=0.0, standardization=False, maxIter=200).fit(train)
        part = model.transform(rows.filter(F.col("fold") == k)).select("label", vector_to_array("probability")[1].alias("prob"))
        scored = part if scored is None else scored.unionByName(part)
    return st.compare(scored.withColumn("all", F.lit(1)), ["all"], "prob", F.col("label") == 0, least=1).select(F.round((F.col("delta") + 1) / 2, 6).alias("auc"))


@query()
def c2st_auc(spark, d):
    v = b.vectors(spark, d).withColumnRenamed("label", "cls")
    return c2st(v.filter("cls < 5").drop("cls"), v.filter("cls >= 5").drop("cls"), "vec_id", "embedding")


@query("""WITH e AS (SELECT ts < TIMESTAMP '2024-01-16' AS is_ref, 'u' || (user_id % 6) AS grp, event_type AS cls FROM events),
r AS (SELECT cls, count(*) AS r FROM e WHERE is_ref GROUP BY 1), n AS (SELECT grp, count(*) AS n FROM e WHERE NOT is_ref GROUP BY 1 HAVING count(*) >= 15), c AS (SELECT grp, cls, count(*) AS c FROM e WHERE NOT is_ref GROUP BY ALL),
k AS (SELECT cls FROM r UNION SELECT cls FROM c), s AS (SELECT n.grp, n.n, k.cls, coalesce(c, 0) / n.n - coalesce(r, 0) / (SELECT sum(r) FROM r) AS rise FROM n CROSS JOIN k LEFT JOIN c ON c.grp = n.grp AND c.cls = k.cls LEFT JOIN r ON r.cls = k.cls)
SELECT grp, n, cls AS spike_class, round(rise, 9) AS spike FROM s QUALIFY row_number() OVER (PARTITION BY grp ORDER BY rise DESC, cls) = 1""")
def class_spikes(spark, d):
    """For each of six sources, the event type whose share rose most against the first half of the month."""
    e = b.read(spark, d, "events").select((F.col("ts") < F.lit("2024-01-16").cast("timestamp")).alias("is_ref"), F.concat(F.lit("u"), (F.col("user_id") % 6).cast("string")).alias("grp"), F.col("event_type").alias("cls"))
    return ip.spikes(e).select("grp", "n", "spike_class", F.round("spike", 9).alias("spike"))
