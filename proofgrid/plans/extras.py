"""Further statistics and rollups: calibrators, rank tests, tails, Mahalanobis distances, listings."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofgrid.functions import special
from proofgrid.operators import bootstrap, shrinkage
from proofgrid.operators import labels as lb
from proofgrid.operators import statistics as st
from proofgrid.operators import triggers
from proofgrid.operators.components import shared_table
from proofgrid.operators.pairs import nearest
from proofgrid.plans import bindings as b
from proofgrid.plans.catalog import query


def _log_sums(theta: np.ndarray):
    """Rows (at, total): the sum of n * log1p(theta[at] * x) over a task's rows (x, n)."""

    def run(batches):
        total = np.zeros(len(theta))
        for batch in batches:
            x, n = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns)
            for s in range(0, len(x), 4096):
                total += np.log1p(np.outer(theta, x[s : s + 4096])) @ n[s : s + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(theta)), pa.int32()), pa.array(total)], ["at", "total"])

    return run


def tail_pvalues(calibration: DataFrame, test: DataFrame, score: str, tail: float = 0.2, least: int = 20) -> DataFrame:
    """Conformal p-values whose resolution beyond the largest calibration score comes from a generalised Pareto tail.

    The tail is a fifth of the calibration scores, whatever their number: its start comes from counts by value and prefix
    sums, and each step of the fit is a sum over the tail's values, of which 201 numbers reach the driver.
    """
    out = st.conformal_pvalues(calibration, test, score)
    s = calibration.select(F.col(score).cast("double").alias("s")).filter("s IS NOT NULL")
    n = s.count()
    k = max(least, round(n * tail))
    if n < 2 * least or k >= n:
        return out
    ranked = st.running(s.groupBy("s").agg(F.count("*").alias("n")), [], "s", ["n"])
    low = ranked.filter(F.lit(n) - F.col("cum_n") + F.col("n") > k).agg(F.max("s")).first()[0]
    exceed = shared_table(ranked.filter(F.col("s") > low).select((F.col("s") - low).alias("x"), F.col("n").cast("long").alias("n")))
    have, total, last = exceed.agg(F.sum("n"), F.sum(F.col("x") * F.col("n")), F.max("x")).first()
    if not have or last <= 1e-12:  # scores equal to the tail's start exceed it by 0, and add nothing to the sums
        return out

    def mean_log(theta: np.ndarray) -> np.ndarray:
        sums = exceed.mapInArrow(_log_sums(theta), "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
        got = np.zeros(len(theta))
        for r in sums:
            got[r["at"]] = r.total
        return got / k

    shape, scale = special.pareto_profile(mean_log, total / k, last)
    shape = float(np.clip(shape, -0.5, 0.5))

    @F.pandas_udf(T.DoubleType())
    def beyond(s: pd.Series) -> pd.Series:
        x = np.maximum(s.to_numpy(float) - low, 0) / scale
        sf = np.exp(-x) if abs(shape) < 1e-12 else np.maximum(1 + shape * x, 0) ** (-1 / shape)
        return pd.Series(np.maximum(k / (n + 1) * sf, 1e-300))

    return out.withColumn("p", F.when(F.col(score) > low + last, beyond(F.col(score).cast("double"))).otherwise(F.col("p")))


@query()
def tail_extrapolation(spark, d):
    e = b.read(spark, d, "events").select("event_id", "value")
    test = e.filter("event_id % 2 = 1").withColumn("value", F.col("value") + F.when(F.col("event_id") % 100 == 1, 400.0).otherwise(0.0))
    out = tail_pvalues(e.filter("event_id % 2 = 0"), test, "value")
    return out.select("event_id", F.round(F.log10("p"), 6).alias("log10_p"))


@query("""WITH v AS (SELECT event_type = 'error' AS a, avg(i) OVER (PARTITION BY value) AS r FROM (SELECT event_type, value, row_number() OVER (ORDER BY value) AS i FROM events WHERE event_type IN ('error', 'click')))
SELECT sum(r) FILTER (a) - count(*) FILTER (a) * (count(*) FILTER (a) + 1) / 2 AS u FROM v""")
def mann_whitney(spark, d):
    """U of the first sample, with ties halved."""
    e = b.read(spark, d, "events").filter("event_type IN ('error', 'click')").withColumn("all", F.lit(1))
    return st.compare(e, ["all"], "value", F.col("event_type") == "click").select(F.round((F.col("delta") + 1) / 2 * F.col("n_ref") * F.col("n_cur"), 1).alias("u"))


def kendall_tau(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, tau) by pairs within each key, for short lists; 1 if a side is constant."""
    a = rows.select(key, F.col(x).alias("x1"), F.col(y).alias("y1"), F.col("pos").alias("p1"))
    z = rows.select(key, F.col(x).alias("x2"), F.col(y).alias("y2"), F.col("pos").alias("p2"))
    sx, sy = F.signum(F.col("x1") - F.col("x2")), F.signum(F.col("y1") - F.col("y2"))
    t = a.join(z, key).filter("p1 < p2").groupBy(key).agg(F.sum(sx * sy).alias("c"), F.sum(F.abs(sx)).alias("nx"), F.sum(F.abs(sy)).alias("ny"))
    return t.select(key, F.when((F.col("nx") == 0) | (F.col("ny") == 0), 1.0).otherwise(F.col("c") / F.sqrt(F.col("nx") * F.col("ny"))).alias("tau"))


@query("""WITH v AS (SELECT vec_id, generate_subscripts(embedding, 1) AS p, unnest(embedding[1:8])::DOUBLE AS x, unnest(embedding[9:16])::DOUBLE AS y FROM (SELECT vec_id, embedding FROM embeddings) WHERE true),
w AS (SELECT * FROM v WHERE p <= 8) SELECT a.vec_id, round(sum(sign(a.x - z.x) * sign(a.y - z.y)) / sqrt(sum(abs(sign(a.x - z.x))) * sum(abs(sign(a.y - z.y)))), 8) AS tau FROM w a JOIN w z ON a.vec_id = z.vec_id AND a.p < z.p GROUP BY 1""")
def rank_agreement(spark, d):
    v = b.vectors(spark, d).select("vec_id", F.posexplode(F.arrays_zip(F.slice("embedding", 1, 8).alias("x"), F.slice("embedding", 9, 8).alias("y"))).alias("pos", "z"))
    rows = v.select("vec_id", "pos", F.col("z.x").cast("double").alias("x"), F.col("z.y").cast("double").alias("y"))
    return kendall_tau(rows, "vec_id", "x", "y").withColumn("tau", F.round("tau", 8))


def calibrate(rows: DataFrame, score: str, label: str, method: str = "isotonic"):
    """A fitted calibrator of scores in [0, 1] (isotonic) or any range (platt); apply it with `calibrated`."""
    if method == "isotonic":
        return IsotonicRegression(featuresCol="f", labelCol="y").fit(rows.select(array_to_vector(F.array(F.col(score).cast("double"))).alias("f"), F.col(label).cast("double").alias("y")))
    return LogisticRegression(featuresCol="f", labelCol="y", regParam=1e-6, standardization=False).fit(rows.select(array_to_vector(F.array(F.col(score).cast("double"))).alias("f"), F.col(label).cast("double").alias("y")))


def calibrated(model, rows: DataFrame, score: str) -> DataFrame:
    out = model.transform(rows.withColumn("f", array_to_vector(F.array(F.col(score).cast("double")))))
    return out.withColumn("calibrated", vector_to_array("probability")[1] if "probability" in out.columns else F.col("prediction")).select(*rows.columns, "calibrated")


@query()
def calibration(spark, d):
    rows = b.read(spark, d, "labels").join(b.read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", (F.col("n_chars") / 1000).alias("score"), F.col("toxic").alias("label"))
    iso = calibrated(calibrate(rows, "score", "label"), rows, "score")
    return iso.select("doc_id", F.round("calibrated", 8).alias("calibrated"))


def mahalanobis(reference: DataFrame, rows: DataFrame, id_col: str, vector: str, dims: int = 32) -> DataFrame:
    """(id, distance): squared distances under the reference's leading components with a shrunk covariance."""
    return shrinkage.distances(shrinkage.fit(reference, vector, dims), rows, id_col, vector)


@query("""WITH r AS (SELECT lang, n_chars, toxic FROM labels JOIN documents USING (doc_id) WHERE n_chars IS NOT NULL),
n AS (SELECT lang, count(*) FILTER (toxic = 1) AS n_pos, count(*) FILTER (toxic = 0) AS n_neg FROM r GROUP BY 1),
u AS (SELECT a.lang, sum(CASE WHEN a.n_chars > b.n_chars THEN 1.0 WHEN a.n_chars = b.n_chars THEN 0.5 ELSE 0 END)::DOUBLE AS u FROM r a JOIN r b ON a.lang IS NOT DISTINCT FROM b.lang AND a.toxic = 1 AND b.toxic = 0 GROUP BY 1)
SELECT n.lang, n_pos, n_neg, round(u / n_pos / n_neg, 8) AS auroc, CASE WHEN u IS NOT NULL THEN true END AS inside FROM n LEFT JOIN u ON n.lang IS NOT DISTINCT FROM u.lang""")
def auroc_interval(spark, d):
    """AUROC of text lengths for toxic documents in each language, and whether its bootstrap interval holds it."""
    rows = b.read(spark, d, "labels").join(b.read(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    out = bootstrap.auroc_intervals(rows, ["lang"], "n_chars", F.col("toxic") == 1, replicates=200)
    return out.select("lang", "n_pos", "n_neg", F.round("auroc", 8).alias("auroc"), ((F.col("low") <= F.col("auroc")) & (F.col("auroc") <= F.col("high"))).alias("inside"))


@query()
def mahalanobis_distance(spark, d):
    v = b.vectors(spark, d)
    return mahalanobis(v.filter("vec_id % 2 = 0"), v, "vec_id", "embedding").select("vec_id", F.round("distance", 6).alias("distance"))


@query()
def label_consistency(spark, d):
    """Held-out predictions against declared labels, for vectors of four contributors."""
    v = b.vectors(spark, d)
    s = v.select(F.col("vec_id").alias("sample_id"), F.concat(F.lit("c"), (F.col("vec_id") % 4).cast("string")).alias("contributor"), "label", "embedding")
    model = lb.label_model(s)
    near = nearest(v, v, "vec_id", "embedding", 10, "cosine")
    own = v.select(F.col("vec_id").alias("query"), F.col("label").alias("mine"))
    agreement = near.join(own, "query").join(v.select(F.col("vec_id").alias("neighbour"), "label"), "neighbour").groupBy(F.col("query").alias("sample_id")).agg(F.avg((F.col("label") == F.col("mine")).cast("int")).alias("agreement"))
    return lb.inconsistent(model, agreement, least=0.3).select("sample_id", "declared", "predicted", F.round("score", 6).alias("score"))


@query("""WITH h AS (SELECT user_id % 30 AS position, count(*) FILTER (event_type = 'error') AS hot, count(*) AS n FROM events WHERE user_id % 30 < 30 GROUP BY 1) SELECT position, hot, n, round(hot / n, 9) AS rate FROM h WHERE hot >= 6""")
def spatial_persistence(spark, d):
    e = b.read(spark, d, "events")
    return e.groupBy((F.col("user_id") % 30).alias("position")).agg(F.count_if(F.col("event_type") == "error").alias("hot"), F.count("*").alias("n")).filter("hot >= 6").withColumn("rate", F.round(F.col("hot") / F.col("n"), 9))


@query()
def persistent_windows(spark, d):
    """Hot windows of energies that stand for images: squared vectors with one place raised in some of them."""
    v = b.vectors(spark, d).select(F.col("vec_id").alias("sample_id"), F.transform("embedding", lambda x, i: F.abs(x.cast("double")) + F.when((i == 17) & (F.col("vec_id") % 6 == 0), 5.0).otherwise(0.0)).alias("energies"))
    n = v.count()
    return triggers.persistent_positions(triggers.hot_windows(v), n, 64)


@query("""WITH r AS (SELECT l_linenumber AS probe, avg((l_returnflag = 'R')::INT) FILTER (l_suppkey % 2 = 0) AS c, avg((l_returnflag = 'R')::INT) FILTER (l_suppkey % 2 = 1) AS f FROM lineitem GROUP BY 1)
SELECT probe, round(c - f, 9) AS excess, c - f >= 0.25 AND c >= 2 * greatest(f, 0.05) AS flagged FROM r""")
def stress_excess(spark, d):
    """Candidate against reference: 25 points and twice the rate."""
    li = b.read(spark, d, "lineitem")
    hit = (F.col("l_returnflag") == "R").cast("int")
    r = li.groupBy(F.col("l_linenumber").alias("probe")).agg(F.avg(F.when(F.col("l_suppkey") % 2 == 0, hit)).alias("c"), F.avg(F.when(F.col("l_suppkey") % 2 == 1, hit)).alias("f"))
    return r.select("probe", F.round(F.col("c") - F.col("f"), 9).alias("excess"), ((F.col("c") - F.col("f") >= 0.25) & (F.col("c") >= 2 * F.greatest("f", F.lit(0.05)))).alias("flagged"))


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i % greatest(1, n // 150) = 0")
def timeline_thinning(spark, d):
    e = b.read(spark, d, "events")
    i = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")) - 1
    n = F.count("*").over(Window.partitionBy("event_type"))
    return e.select("event_type", "event_id", i.alias("i"), n.alias("n")).filter(F.col("i") % F.greatest(F.lit(1), F.floor(F.col("n") / 150)) == 0).select("event_type", "event_id")


@query("SELECT name FROM (SELECT lang AS name FROM documents UNION SELECT event_type FROM events UNION SELECT p_type FROM part)")
def class_union(spark, d):
    return b.read(spark, d, "documents").select(F.col("lang").alias("name")).union(b.read(spark, d, "events").select("event_type")).union(b.read(spark, d, "part").select("p_type")).distinct()


@query("""WITH a AS (SELECT p_brand AS role, max(p_partkey) AS digest FROM part WHERE p_partkey % 2 = 0 AND p_brand <> 'Brand#3' GROUP BY 1), z AS (SELECT p_brand AS role, max(p_partkey) AS digest FROM part WHERE p_partkey % 3 = 0 AND p_brand <> 'Brand#5' GROUP BY 1)
SELECT role, a.digest AS old, z.digest AS new FROM a FULL JOIN z USING (role) WHERE a.digest IS DISTINCT FROM z.digest""")
def asset_digest_diff(spark, d):
    p = b.read(spark, d, "part")
    a = p.filter("p_partkey % 2 = 0 AND p_brand <> 'Brand#3'").groupBy(F.col("p_brand").alias("role")).agg(F.max("p_partkey").alias("old"))
    z = p.filter("p_partkey % 3 = 0 AND p_brand <> 'Brand#5'").groupBy(F.col("p_brand").alias("role")).agg(F.max("p_partkey").alias("new"))
    return a.join(z, "role", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))


@query("SELECT 'F-' || upper(substr(sha256('s|' || event_type || '|' || event_id), 1, 10)) AS finding_id, event_id FROM events")
def finding_ids(spark, d):
    from proofgrid.functions.columns import finding_id

    return b.read(spark, d, "events").select(finding_id(F.lit("s"), F.col("event_type"), F.col("event_id").cast("string")).alias("finding_id"), "event_id")
