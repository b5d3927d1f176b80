import numpy as np
import pytest

from proofgrid.operators import ivf


@pytest.mark.parametrize("metric, block", [("euclidean", 4_096), ("cosine", 64)])
def test_recall_and_exact_order(spark, metric, block):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 16))[rng.integers(0, 12, 3_000)] * 2 + rng.normal(size=(3_000, 16))
    x[100:700] = x[100]  # a cell of copies, split in blocks
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5_000, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    asked = df.filter("id % 50 = 0")
    cells = ivf.fit(df, "id", "v", 5, metric, sample=1_000)
    got = {}
    for r in ivf.search(asked, df, "id", "v", 5, cells, block).collect():
        got.setdefault(r.query, {})[r.rank] = (r.neighbour, r.distance)
    y = x / np.linalg.norm(x, axis=1, keepdims=True) if metric == "cosine" else x
    hits = total = 0
    for q in range(0, 3_000, 50):
        d = 1 - y @ y[q] if metric == "cosine" else np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want = set(np.lexsort((np.arange(len(d)), np.round(d, 9)))[:5].tolist())
        found = [got[q][k] for k in range(1, 6)]
        assert [round(v, 9) for _, v in found] == sorted(round(float(d[n]), 9) for n, _ in found)
        hits, total = hits + len(want & {n for n, _ in found}), total + 5
    assert hits >= 0.9 * total and cells.probes < len(cells.centres)


def test_nothing(spark):
    df = spark.createDataFrame([], "id long, v array<double>")
    assert ivf.search(df, df, "id", "v", 5, ivf.fit(df, "id", "v", 5)).count() == 0
