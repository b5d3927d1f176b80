import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from proofgrid.functions import vision
from proofgrid.operators import fixtures, risk, triggers
from proofgrid.operators.activations import split_classes
from proofgrid.operators.components import connected_components
from proofgrid.operators.pairs import _solve, hamming_pairs, nearest
from proofgrid.plans import engine


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(500, 500), (None, 3)]
    up = list(range(600))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges[:-1]:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: root(x) for e in edges[:-1] for x in e}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("most", [0, 3, 8])
def test_hamming_pairs_match_brute_force(spark, most):
    rng = random.Random(most)
    base = [rng.getrandbits(63) for _ in range(60)]
    rows = [(k, h, rng.choice(base) ^ (1 << rng.randrange(63))) for k, h in enumerate(base + [b ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for b in base])]
    near = lambda a, b: bin(a ^ b).count("1")
    want = set()
    for i, h, _ in rows:
        for j, g, f in rows:
            if i < j and near(h, g) <= most:
                want.add((i, j, near(h, g), False))
            elif i < j and near(h, f) <= most:
                want.add((i, j, near(h, f), True))
    got = hamming_pairs(spark.createDataFrame(rows, "i long, h long, f long"), "i", "h", most, flip="f")
    assert {(r.i, r.j, r.distance, r.mirrored) for r in got.collect()} == want


def test_nearest_in_blocks_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (90, 3)).astype(float)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")
    for metric in ("euclidean", "cosine"):
        got = {(r.query, r["rank"]): r.neighbour for r in nearest(df.filter("id < 20"), df, "id", "v", 4, metric, base_block=17).collect()}
        if metric == "euclidean":
            for q in range(20):
                order = sorted((float(np.sqrt(((x[q] - x[j]) ** 2).sum())), j) for j in range(90) if j != q)
                assert [got[q, k] for k in range(1, 5)] == [j for _, j in order[:4]]
        assert len(got) == 80


def odd_vectors(n):
    """Copies, rows far from the others, a common offset, and rows without a distance."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 32)) + 1e5
    x[n // 8 : n // 4] = x[3]
    x[7], x[8], x[9] = 1e12, -1e9, 1e200
    x[11, 2], x[12, 0], x[13, 31] = np.nan, np.inf, -np.inf
    return x


def brute(ids, x, base_ids, base, k):
    out = []
    with np.errstate(all="ignore"):
        for q, row in zip(ids, x, strict=True):
            d = np.sqrt(((base - row) ** 2).sum(1))
            d[(base_ids == q) | ~np.isfinite(d)] = np.inf
            out += [(int(q), int(base_ids[j]), float(d[j])) for j in np.lexsort((base_ids, d))[:k] if d[j] < np.inf]
    return out


def test_nearest_by_products_is_the_measured_order_at_a_fraction_of_its_time(spark):
    x = odd_vectors(6_000)
    ids = np.random.default_rng(6).permutation(6_000)
    base, asked = np.arange(0, 6_000, 2), np.arange(1, 6_000, 4)
    at = np.concatenate([base, base[:30], asked])
    kinds = [pa.array(np.zeros(len(at), np.int32)), pa.array(np.arange(len(at)) < len(base)), pa.array(ids[at]), pa.array(list(x[at]), pa.list_(pa.float64()))]
    batch = pa.RecordBatch.from_arrays(kinds, ["block", "is_base", "id", "v"])

    def timed(f):
        began = time.perf_counter()
        return f(), time.perf_counter() - began

    want, slow = timed(lambda: brute(ids[at[len(base) :]], x[at[len(base) :]], ids[base], x[base], 5))
    got, fast = timed(lambda: [tuple(r.values()) for b in _solve(5, "euclidean")(iter([batch])) for r in b.to_pylist()])
    assert got == want
    assert fast < slow / 2


def test_nearest_in_blocks_and_groups_with_odd_vectors(spark):
    x = odd_vectors(160)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [None] + [1e5] * 31)], "id long, v array<double>")
    got = nearest(df.filter("id % 3 > 0 or id >= 900"), df.filter("id % 2 = 0 or id >= 900"), "id", "v", 5, base_block=17).collect()
    asked, base = np.array([k for k in range(160) if k % 3]), np.arange(0, 160, 2)
    want = brute(asked, x[asked], base, x[base], 5)
    assert sorted((r.query, r["rank"], r.neighbour, r.distance) for r in got) == sorted((q, 1 + sum(w[0] == q for w in want[:i]), n, d) for i, (q, n, d) in enumerate(want))
    with pytest.raises(Exception, match="differ in length"):
        nearest(df, df.union(spark.sql("SELECT 999L, array(1d)")), "id", "v", 5).collect()


def test_contributor_risk_on_a_planted_contributor(spark):
    samples = [(k, f"c{k % 5}", "b") for k in range(500)] + [(1000 + k, "small", None) for k in range(4)]
    flags = [(k, "duplicate_flood", 0.95, "HIGH") for k in range(500) if k % 5 == 2 and k % 3] + [(k, "ood_injection", 0.9, "LOW") for k in range(0, 500, 41)] + [(9999, "x", 1.0, "HIGH"), (3, "x", 0.1, "HIGH")]
    s = spark.createDataFrame(samples, "sample_id long, contributor string, batch string")
    f = spark.createDataFrame(flags, "sample_id long, attack_class string, confidence double, severity string")
    found = spark.createDataFrame([(["c2"], "duplicate_flood", 30, "HIGH"), (["c2"], "ood_injection", 9, "HIGH"), (["c1"], "ood_injection", 2, "HIGH")], "contributors array<string>, attack_class string, affected long, severity string")
    got = {r.contributor: r for r in risk.contributor_risk(s, f, found).collect()}
    assert got["c2"].strength == "HIGH" and got["c2"].tier == "CRITICAL" and got["c2"].action == "QUARANTINE"
    assert all(got[c].tier == "LOW" for c in ("c0", "c1", "c3", "c4", "small"))
    rates = sorted(r.rate for k, r in got.items() if k != "c0")
    assert abs(got["c0"].baseline - np.median(rates)) < 1e-12
    assert risk.contributor_risk(s.filter("contributor = 'c1'"), f).count() == 0


def test_guardrails(spark):
    rows = [
        ("record_modification", "PROVENANCE", True, True, "HIGH", 0.99, "FULL", [], {}),
        ("duplicate_flood", "DATA", False, False, "HIGH", 0.9, "DEGRADED", ["a", "b"], {}),
        ("model_substitution", "MODEL", True, True, "HIGH", 0.9, "FULL", [], {"parameters": "identical"}),
        ("anything", "DATA", True, True, "INFO", 0.1, "FULL", [], {}),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "i int, attack_class string, layer string, deterministic boolean, calibrated boolean, severity string, confidence double, availability string, signals array<string>, tags map<string,string>").withColumn("detector_id", F.lit("d"))
    got = {r.i: (r.rule_id, r.decided_severity, r.disposition, r.decided_confidence, r.guardrails) for r in risk.decide(df).collect()}
    assert got[0] == ("provenance.failure", "CRITICAL", "QUARANTINE", 0.99, [])
    assert got[1] == ("corroborated.high", "HIGH", "REVIEW", 0.85, ["G2", "G5"])
    assert got[2][:3] == ("model.reserialized", "MEDIUM", "REVIEW")
    assert got[3][:3] == ("low.accept", "INFO", "ACCEPT")
    lax = (risk.Rule("all", "ACCEPT"),)
    assert risk.decide(df.filter("i = 0"), lax).first().guardrails == ["G1"]


def test_plan_negotiates_and_isolates_failures(spark):
    def fail(context):
        raise ValueError("no")

    df = spark.createDataFrame([(1,)], "i int")
    ok = lambda context: engine.Frames(findings=df)
    checks = [
        engine.Check("after", "DATA", ok, depends_on=("bad",)), engine.Check("bad", "DATA", fail), engine.Check("good", "DATA", ok, modes=(engine.Mode("best", ("gpu",)), engine.Mode("plain", degraded=True))),
        engine.Check("denied", "DATA", ok, required=("images",)), engine.Check("deep", "DATA", ok, budget="DEEP"), engine.Check("idle", "DATA", lambda c: engine.Frames(abstained="nothing to do")), engine.Check("late", "DATA", ok, depends_on=("deep",)),
    ]
    log, findings, flags = engine.scan(checks, engine.Context(spark, {}, frozenset({"rows"})))
    states = {r["detector_id"]: r["state"] for r in log}
    assert states == {"after": "ERROR", "bad": "ERROR", "good": "COMPLETED_DEGRADED", "denied": "NOT_RUN", "deep": "NOT_RUN", "idle": "ABSTAINED", "late": "NOT_RUN"}
    assert findings.count() == 1 and flags is None
    s = spark.createDataFrame([(k, "ab"[k % 2], f"c{k % 3}") for k in range(40)], "i int, label string, contributor string")
    assert engine.capabilities(s) == {"dataset.rows", "dataset.labels", "dataset.contributors"}


def test_image_measures(spark):
    rng = np.random.default_rng(7)
    img = rng.integers(0, 256, (48, 64, 3)).astype(np.uint8)
    flat = np.full((16, 16, 3), 128, np.uint8)
    df = spark.createDataFrame([("a", img.tobytes(), 48, 64), ("b", img[:, ::-1].tobytes(), 48, 64), ("c", flat.tobytes(), 16, 16), ("d", b"x", 9, 9)], "id string, data binary, height int, width int")
    got = {r.id: r for r in vision.measure(df, "id").collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].phash_flip == got["b"].phash and got["a"].dhash == got["b"].dhash_flip
    assert got["c"].contrast == 0 and abs(got["c"].brightness - 128 / 255) < 1e-9 and abs(got["c"].entropy) < 1e-12 and got["c"].exposure_clipping == 0
    assert np.allclose(vision.dct_matrix(8) @ vision.dct_matrix(8).T, np.eye(8)) and np.allclose(vision.resize(flat, 5, 7), 128) and np.allclose(vision.resize(flat, 33, 40), 128)
    y = img @ vision.LUMA
    res = (y - vision.gaussian(y, 1.0)) ** 2
    assert np.allclose(vision.window_energy(img)[:2], [res[:8, :8].sum(), res[:8, 4:12].sum()])
    table = bytes([0]) + bytes([16] * 64)
    jpeg = b"\xff\xd8\xff\xdb" + (2 + len(table)).to_bytes(2, "big") + table + b"\xff\xda"
    assert vision.jpeg_quality(jpeg)[0] == 86 and vision.jpeg_quality(b"GIF") == (None, None)
    assert vision.region(0, 0, 9, 9) == "upper left" and vision.photometric(img).shape == img.shape


def test_hot_windows_persist_at_one_place(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(60):
        e = rng.normal(10, 1, 30)
        e[int(rng.integers(0, 30))] += 40 if k % 3 == 0 else 0
        if k < 15:
            e[7] += 60
        rows.append((k, e.tolist()))
    hot = triggers.hot_windows(spark.createDataFrame(rows, "sample_id long, energies array<double>"))
    found = triggers.persistent_positions(hot, 60, 30).collect()
    assert [r.position for r in found] == [7] and found[0].k >= 15


def test_fixtures_are_deterministic(spark):
    s = spark.createDataFrame([(k, "ab"[k % 2], f"c{k % 2}") for k in range(200)], "sample_id long, label string, contributor string")
    flipped = fixtures.flip_labels(s, "c0", "a", "b")
    n = flipped.filter("label <> true_label").count()
    assert 70 < n <= 100 and n == fixtures.flip_labels(s.repartition(7), "c0", "a", "b").filter("label <> true_label").count()
    assert fixtures.flood(s, "c1", 3, 10).count() == 230


def test_split_classes_counts_every_row(spark):
    rng = np.random.default_rng(3)
    far = np.zeros(16)
    far[4] = 9
    planted = {"a": (2400, 400), "b": (60, 0), "c": (1, 0)}
    rows, held = [], {}
    for name, (n, k) in planted.items():
        x = rng.normal(size=(n + k, 16))
        x[n:] += far
        held[name] = x
        rows += [(name, i, v.tolist()) for i, v in enumerate(x)]
    same = [("d", i, [1.0] * 16) for i in range(5)]
    df = spark.createDataFrame([*rows, *same, (None, 1, [0.0] * 16), ("a", 9, None)], "cls string, vec_id long, embedding array<double>")
    got = {r.cls: r for r in split_classes(df).collect()}
    assert {k: r.n for k, r in got.items()} == {"a": 2800, "b": 60, "c": 1, "d": 5}
    assert (got["c"].minority, got["c"].silhouette, got["d"].minority, got["d"].silhouette) == (0, 0, 0, 0)
    x = held["a"] - held["a"].mean(0)
    z = x @ np.linalg.svd(x, full_matrices=False)[2][:10].T
    side = np.arange(2800) >= 2400
    apart = np.sqrt(np.maximum((z**2).sum(1)[:, None] + (z**2).sum(1) - 2 * z @ z.T, 0))
    own = np.where(side, apart[:, side].sum(1) / 399, apart[:, ~side].sum(1) / 2399)
    other = np.where(side, apart[:, ~side].mean(1), apart[:, side].mean(1))
    assert abs(got["a"].minority - 1 / 7) < 1e-12
    assert abs(got["a"].silhouette - ((other - own) / np.maximum(own, other)).mean()) < 0.02
    assert 0 < got["b"].minority <= 0.5 and got["b"].silhouette < 0.25
    assert not split_classes(df.limit(0)).collect()


def test_dealt_probes_are_never_broadcast(spark):
    """A row asks for thousands of keys, but Spark would judge the side by its rows before they are dealt."""
    df = spark.range(100).select("id", F.xxhash64("id").alias("h"))
    assert "BroadcastHashJoin" not in hamming_pairs(df, "id", "h", 8, 64)._jdf.queryExecution().executedPlan().toString()
