import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofgrid.functions import columns as c
from proofgrid.functions import special as sp
from proofgrid.operators import statistics as st


def test_special_functions_against_sums_and_known_values():
    for n, p in ((1, 0.5), (10, 0.5), (40, 0.03), (200, 0.7)):
        pmf = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
        assert np.allclose(sp.binomial_sf(np.arange(n + 2), n, p), [sum(pmf[k:]) for k in range(n + 2)], rtol=1e-9, atol=1e-13)
    for m in (0.2, 3.0, 40.0):
        pmf = [math.exp(k * math.log(m) - m - math.lgamma(k + 1)) for k in range(300)]
        assert np.allclose(sp.poisson_sf(np.arange(60), m), [sum(pmf[k:]) for k in range(60)], rtol=1e-8, atol=1e-13)
    x = np.linspace(0, 1, 200_001)
    for a, b in ((2.0, 5.0), (0.7, 3.0), (30.0, 400.0)):
        y = np.exp((a - 1) * np.log(np.maximum(x, 1e-300)) + (b - 1) * np.log(np.maximum(1 - x, 1e-300)))
        if a > 1:
            cdf = np.concatenate([[0], np.cumsum((y[1:] + y[:-1]) / 2)])
            assert np.allclose(sp.beta_sf(x[::20_000], a, b), 1 - (cdf / cdf[-1])[::20_000], atol=1e-6)
        q = sp.beta_ppf([0.05, 0.5, 0.95], a, b)
        assert np.allclose(1 - sp.beta_sf(q, a, b), [0.05, 0.5, 0.95], atol=1e-9)
    assert np.allclose(sp.chi2_sf([3.841458820694124, 5.991464547107979], [1, 2]), 0.05)
    assert abs(float(sp.normal_sf(1.959963984540054)) - 0.025) < 1e-12
    assert sp.beta_binomial_ppf(0.5, 10, 1.0, 1.0) == 5
    assert abs(float(sp.kolmogorov_sf(0.2, 100, 100)[0]) - 0.0366) < 1e-3


def test_pareto_tail_recovers_its_shape():
    u = (np.arange(1, 4001) - 0.5) / 4000
    for shape, scale in ((0.3, 2.0), (-0.2, 1.0)):
        got = sp.pareto_tail(scale * ((1 - u) ** -shape - 1) / shape)
        assert abs(got[0] - shape) < 0.03 and abs(got[1] - scale) < 0.05 * scale


def test_step_up_values_by_hand(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.2)], "i int, p double")
    q = [r.q for r in st.bh_qvalues(df, "p").orderBy("i").collect()]
    assert np.allclose(q, [0.04, 0.16 / 3, 0.16 / 3, 0.2])


def test_two_samples_with_ties(spark):
    rng = np.random.default_rng(4)
    ref, cur = rng.integers(0, 12, 70).astype(float), rng.integers(2, 15, 55).astype(float)
    df = spark.createDataFrame([(k, float(v), True) for v in ref for k in "ab"] + [(k, float(v), False) for v in cur for k in "ab"], "k string, v double, r boolean").repartition(5)
    for row in st.compare(df, ["k"], "v", F.col("r")).collect():
        grid = np.unique(np.concatenate([ref, cur]))
        fr, fc = (np.array([(x <= g).mean() for g in grid]) for x in (ref, cur))
        assert abs(row.ks - np.abs(fr - fc).max()) < 1e-12
        assert abs(row.wasserstein - (np.abs(fr - fc)[:-1] * np.diff(grid)).sum()) < 1e-9
        assert abs(row.delta - np.sign(cur[:, None] - ref).mean()) < 1e-12
    assert st.compare(df.limit(3), ["k"], "v", F.col("r")).count() == 0


def test_robust_scores_fall_back_when_half_are_equal(spark):
    df = spark.createDataFrame([("a", 1.0)] * 6 + [("a", 5.0)] * 2 + [("b", 2.0)] * 3, "g string, x double")
    rows = {(r.g, r.x): r.z for r in st.robust_z(df, "x", ["g"]).collect()}
    assert rows["a", 1.0] == 0 and abs(rows["a", 5.0] - 4 / (1.2533 * 1.0)) < 1e-9 and rows["b", 2.0] == 0


def test_conformal_values_with_ties(spark):
    cal = [0.1, 0.4, 0.4, 0.9]
    df = spark.createDataFrame([(x,) for x in cal], "s double")
    got = {r.s: r.p for r in st.conformal_pvalues(df, spark.createDataFrame([(0.0,), (0.4,), (1.0,)], "s double"), "s").collect()}
    assert got == {0.0: 1.0, 0.4: 0.8, 1.0: 0.2}


@pytest.mark.parametrize("p, q, want", [([1.0, 0.0], [0.0, 1.0], math.log(2)), ([0.5, 0.5], [0.5, 0.5], 0.0)])
def test_array_measures(spark, p, q, want):
    df = spark.createDataFrame([(p, q)], "p array<double>, q array<double>")
    r = df.select(c.jsd(F.col("p"), F.col("q")).alias("j"), c.entropy_bits(F.array(F.lit(1), F.lit(1), F.lit(2))).alias("h"), c.hamming(F.lit(5), F.lit(2)).alias("d"), c.hex16(F.lit(255)).alias("x")).first()
    assert abs(r.j - want) < 1e-9 and abs(r.h - 1.5) < 1e-12 and r.d == 3 and r.x == "00000000000000ff"


def test_paths_and_intervals(spark):
    paths = ["a/b.png", "../x", "/etc", "c:\\x", "a\\..\\b", "a//./b", None, ""]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(c.is_unsafe_path(F.col("p"))).collect()] == [False, True, True, True, True, False, True, True]
    assert df.select(c.normal_path(F.col("p")).alias("p")).collect()[5].p == "a/b"
    low, high = c.wilson(F.lit(0), F.lit(0))
    r = df.limit(1).select(low.alias("a"), high.alias("b")).first()
    assert (r.a, r.b) == (0.0, 1.0)


def test_tail_p_values_match_a_fit_in_memory(spark):
    import numpy as np

    from proofgrid.plans.extras import tail_pvalues

    rng = np.random.default_rng(3)
    cal = np.round(rng.exponential(2.0, 3_000), 2)  # many ties
    df = lambda v: spark.createDataFrame([(float(x),) for x in v], "score double")
    top = np.sort(cal)[-601:]
    shape, scale = sp.pareto_tail(top[1:] - top[0])
    got = {r.score: r.p for r in tail_pvalues(df(cal).repartition(5), df([cal.max() + 1, cal.max() + 9, 3.0]), "score").collect()}
    for x in (cal.max() + 1, cal.max() + 9):
        want = 600 / 3_001 * max(1 + np.clip(shape, -0.5, 0.5) * (x - top[0]) / scale, 0) ** (-1 / np.clip(shape, -0.5, 0.5))
        assert abs(got[x] - want) < 1e-6 * want
    assert abs(got[3.0] - (1 + (cal >= 3.0).sum()) / 3_001) < 1e-12


def test_qvalues_of_many_rows_are_those_of_one_window(spark):
    rng = np.random.default_rng(8)
    values = [*np.round(rng.uniform(size=3000) ** 3, 4).tolist(), 0.0, 1.0, 1.0]
    df = spark.createDataFrame(list(enumerate(values)), "i long, p double")
    few = {r.i: r.q for r in st.bh_qvalues(df, "p").collect()}
    many = {r.i: r.q for r in st.bh_qvalues_of_rows(df, "p").collect()}
    assert few.keys() == many.keys() and all(abs(few[i] - many[i]) < 1e-12 for i in few)
    odd = spark.createDataFrame([(1, None), (2, 0.5)], "i long, p double")
    assert {r.i: r.q for r in st.bh_qvalues_of_rows(odd, "p").collect()} == {1: None, 2: 0.5}
    assert not st.bh_qvalues_of_rows(df.limit(0), "p").collect()


def test_anomaly_index_without_a_median_deviation_follows_its_sql(spark, tmp_path):
    import duckdb

    from proofgrid.plans import catalog

    spark.range(70).selectExpr("id AS p_partkey", "'B' || id % 7 AS p_brand", "CASE id % 7 WHEN 5 THEN 880.0D WHEN 6 THEN 907.0D ELSE 900.0D END AS p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    want = con.execute(catalog.oracle_sql()["anomaly_index"]).fetchall()
    got = [tuple(r) for r in catalog.queries()["anomaly_index"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 7


def test_medians_of_axes_come_from_running_counts(spark):
    from proofgrid.plans.drift import compare_axes

    rng = np.random.default_rng(4)
    rows = [(a, bool(r), float(v)) for a in "xy" for r, v in zip(rng.random(301) < 0.4, rng.integers(0, 40, 301) / 8, strict=True)]
    out = compare_axes(spark.createDataFrame(rows, "axis string, is_ref boolean, value double"))
    for r in out.collect():
        side = lambda s: np.median([v for a, f, v in rows if a == r.axis and f == s])  # noqa: E731, B023
        assert abs(r.ref_median - side(True)) < 1e-12 and abs(r.cur_median - side(False)) < 1e-12
    assert "percentile" not in out._jdf.queryExecution().optimizedPlan().toString()  # it takes all of a group to one task
