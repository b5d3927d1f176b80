import numpy as np
import pytest
from pyspark.sql import functions as F

from proofgrid.operators import bootstrap, shrinkage


def dense(x, y, dims):
    """Components, and the covariance shrunk as in the paper, from all outer products."""
    mean = x.mean(0)
    _, _, axes = np.linalg.svd(x - mean, full_matrices=False)
    z = (x - mean) @ axes[: min(dims, x.shape[1], len(x) - 1)].T
    s, p = z.T @ z / len(z), z.shape[1]
    level = np.trace(s) / p * np.eye(p)
    delta = ((s - level) ** 2).sum() / p
    beta = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in z) / p / len(z) ** 2, delta)
    cov = (1 - beta / delta) * s + beta / delta * level
    w = (y - mean) @ axes[: z.shape[1]].T
    return beta / delta, np.einsum("ij,jk,ik->i", w, np.linalg.inv(cov), w)


@pytest.mark.parametrize("n, d, dims", [(60, 8, 32), (25, 12, 5), (9, 20, 32)])
def test_against_a_dense_computation(spark, n, d, dims):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + 5
    y = np.vstack([x[:5], rng.normal(size=(20, d)) * 9])
    ref = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "v array<double>").repartition(3)
    model = shrinkage.fit(ref, "v", dims)
    want = dense(x, y, dims)
    got = shrinkage.distances(model, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(y)] + [(99, None)], "id int, v array<double>"), "id", "v").collect()
    assert model.rows == n and abs(model.shrinkage - want[0]) < 1e-9
    assert np.allclose([r.distance for r in sorted(got)[:-1]], want[1], rtol=1e-6) and sorted(got)[-1].distance is None


def test_no_covariance_of_one_row(spark):
    with pytest.raises(ValueError):
        shrinkage.fit(spark.createDataFrame([([1.0, 2.0],)], "v array<double>"), "v")


def test_partitions_without_rows(spark):
    rows = spark.range(0, 5, 1, 8).selectExpr("id", "array(double(id), double(id * id), 1D) AS v")  # 8 partitions
    model, one = shrinkage.fit(rows, "v", 2), shrinkage.fit(rows.coalesce(1), "v", 2)
    assert model.rows == 5 and abs(model.shrinkage - one.shrinkage) < 1e-12


def test_intervals_agree_with_resampling_and_cover(spark):
    rng = np.random.default_rng(0)
    rows = [(k, float(rng.normal(0.8 if i % 2 else 0)), i % 2) for k in range(120) for i in range(100)]
    df = spark.createDataFrame(rows, "k int, score double, y int")
    run = lambda x: {r.k: r for r in bootstrap.auroc_intervals(x, ["k"], "score", F.col("y") == 1, replicates=200).collect()}
    got = run(df)
    assert run(df.repartition(7)) == got
    true = 0.7141  # of two normal distributions 0.8 apart
    assert 0.88 <= np.mean([r.low <= true <= r.high for r in got.values()]) <= 1.0
    area = lambda p, m: (p[:, None] > m[None, :]).mean()
    for k in (0, 1):
        p, m = (np.array([s for j, s, y in rows if j == k and y == v]) for v in (1, 0))
        draws = [area(p[rng.integers(0, 50, 50)], m[rng.integers(0, 50, 50)]) for _ in range(2_000)]
        low, high = np.percentile(draws, [2.5, 97.5])
        assert abs(got[k].auroc - area(p, m)) < 1e-12 and abs(got[k].low - low) < 0.035 and abs(got[k].high - high) < 0.035


def test_weights_are_poisson(spark):
    for n in (1, 7, 200):
        r = spark.range(20_000).select(bootstrap.weight(F.lit(n), F.col("id")).alias("w")).agg(F.avg("w").alias("m"), F.variance("w").alias("v")).first()
        assert abs(r.m - n) < 4 * (n / 20_000) ** 0.5 + 0.01 and abs(r.v / n - 1) < 0.06


def test_intervals_of_rows_without_a_key(spark):
    """A null key is a key, and no replicate of a score moves between tasks."""
    rows = [(None if i % 3 else "a", float(i % 17), i % 2) for i in range(90)]
    out = bootstrap.auroc_intervals(spark.createDataFrame(rows, "k string, score double, y int"), ["k"], "score", F.col("y") == 1, replicates=20)
    got = {r.k: r for r in out.collect()}
    for k in (None, "a"):
        p, m = (np.array([s for j, s, y in rows if j == k and y == v]) for v in (1, 0))
        want = ((p[:, None] > m).mean() + (p[:, None] == m).mean() / 2)
        assert (got[k].n_pos, got[k].n_neg) == (len(p), len(m)) and abs(got[k].auroc - want) < 1e-12 and got[k].low <= want <= got[k].high
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString()
