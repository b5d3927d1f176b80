import hashlib
import math

import duckdb
import numpy as np

from proofgrid.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def brute(rows, dim, k, rounds, scale=256, seed="2"):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v, _ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [r[1] for r in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = {}
        for _, q in kept:
            own.setdefault(near(q)[1], []).append(q)
        c = [[sum(x) // len(own[j]) for x in zip(*own[j])] if j in own else m for j, m in enumerate(c)]
    last = [(i, *near(q), sum(q == p for _, p in kept)) for i, q in kept]
    total = sum(d for _, d, _, _ in last)
    cap = lambda n: min(n, centroids.LARGEST)
    return sorted([(i, j, cap(d), cap(sum(e for _, e, g, _ in last if g == j)), cap(total), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest(), n) for i, d, j, n in last], key=repr)


def got(spark, rows, **options):
    return sorted(map(tuple, centroids.clusters(spark.createDataFrame(rows, SCHEMA).repartition(5), **options).collect()), key=repr)


def test_against_plain_lloyd_with_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist(), "x") for i in range(300)]
    rows += [(1_000 + i, [0.5, 0.5, -0.25, 0.0], "hot") for i in range(400)]
    rows += [(2, [1.0, 1.0, 1.0, 1.0], None), (None, [0.0, 0.0, 0.0, 0.0], None), (None, [0.0, 0.0, 0.0, 0.0], None)]
    rows += [(3, None, ""), (4, [], ""), (5, [1.0, 2.0, 3.0], ""), (6, [1.0, None, 0.0, 0.0], ""), (7, [float("nan"), 0.0, 0.0, 0.0], ""), (8, [float("inf"), 0.0, 0.0, 0.0], ""), (9, [0.0] * 5, "")]
    assert got(spark, rows, dim=4, k=7, rounds=4) == brute(rows, 4, 7, 4)
    assert got(spark, rows, dim=4, k=2_000, rounds=1) == brute(rows, 4, 2_000, 1)


def test_components_beyond_floating_point(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=3) * 1e6).astype(np.float32).tolist(), "") for i in range(60)] + [(100, [3e9, 0.0, 0.0], ""), (101, [3.1e9, 1e10, 0.0], "")]
    assert got(spark, rows, dim=3, k=3, rounds=3) == brute(rows, 3, 3, 3)
    far = got(spark, [(1, [3e38, -3e38], ""), (2, [0.0, 0.0], "")], dim=2, k=1, rounds=1)
    assert {r[2] for r in far} <= {centroids.LARGEST} or all(r[2] > 2**60 for r in far)


def test_no_rows(spark):
    assert got(spark, []) == [] and got(spark, [(1, [1.0], "")]) == []


def test_sql(spark, sf_dir):
    from proofgrid.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    out = con.execute(queries.oracle_sql()["op11_centroid_clustering"])
    names = [d[0] for d in out.description]
    df = queries.queries()["op11_centroid_clustering"](spark, sf_dir)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(out.fetchall())
