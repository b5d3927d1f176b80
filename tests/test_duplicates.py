import numpy as np
import pytest

from proofgrid.operators import duplicates as dup
from proofgrid.operators import pairs as pj

SCHEMA = "sample_id long, phash long, dhash long, phash_flip long, dhash_flip long, embedding array<double>"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def distance(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


def planted(seed, n=150, dims=5):
    rng = np.random.default_rng(seed)
    draw = lambda: int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
    flip = lambda h, k: h ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False))
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.7:
            j = int(rng.integers(0, len(rows)))
            _, p, d, pf, df, v = rows[j]
            p, d, pf, df = (x & ((1 << 64) - 1) for x in (p, d, pf, df))
            kind = rng.integers(0, 4)
            near, far = int(rng.integers(0, 10)), int(rng.integers(0, 12))
            if kind == 1:
                p, d = flip(p, near), flip(d, far)
            elif kind == 2:
                p, d, pf, df = flip(pf, near), flip(df, far), flip(p, near), flip(d, far)
            v = (np.array(v) + rng.normal(size=dims) * rng.choice([0, 0.1, 1])).tolist() if v else v
        else:
            p, d, pf, df, v = draw(), draw(), draw(), draw(), rng.normal(size=dims).tolist()
        rows.append((i, signed(p), signed(d), signed(pf), signed(df), v if rng.random() > 0.03 else None))
    return rows


def classes(rows):
    out = {}
    for r in rows:
        if None not in r[1:5]:
            out.setdefault(r[1:5], []).append(r)
    return {min(x[0] for x in m): (h, max(x[0] for x in m), [x[5] for x in m]) for h, m in out.items()}


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


def brute(rows, max_phash, max_dhash):
    kinds, out = classes(rows), []
    for i, (a, last_a, va) in kinds.items():
        for j, (b, last_b, vb) in kinds.items():
            if i >= j:
                continue
            direct = distance(a[0], b[0]), distance(a[1], b[1])
            ahead = distance(a[0], b[2]), distance(a[1], b[3])
            back = (distance(b[0], a[2]), distance(b[1], a[3])) if j < last_a else (99, 99)
            fit = [(x, m) for x, m in ((direct, False), (ahead, True), (back, True)) if x[0] <= max_phash and x[1] <= max_dhash]
            if fit:
                cos = [cosine(x, y) for x in va for y in vb if x and y and any(x) and any(y)]
                out.append((i, j, *fit[0][0], fit[0][1], round(max(cos), 9) if cos else None))
    return sorted(out)


@pytest.mark.parametrize("seed, max_phash, max_dhash", [(1, 8, 10), (2, 3, 20), (3, 0, 0), (4, 12, 6)])
def test_pairs_against_all_pairs(spark, seed, max_phash, max_dhash):
    rows = planted(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kinds = dup.classes(df)
    pairs = dup.near_pairs(kinds, max_phash, max_dhash)
    got = pairs.join(dup.cosines(pairs, dup.members(df, kinds), "embedding"), ["i", "j"], "left").collect()
    want = brute(rows, max_phash, max_dhash)
    assert sorted((r.i, r.j, r.phash_distance, r.dhash_distance, r.mirrored, None if r.cosine is None else round(r.cosine, 9)) for r in got) == want
    assert seed == 3 or {m for *_, m, _ in want} == {True, False}


def test_components_with_large_classes(spark):
    rows = planted(5, 80)
    first = rows[0]
    rows += [(1_000 + i, *first[1:5], [float(i % 7 - 3), 1.0, 0.0, 0.0, 0.0]) for i in range(300)]
    near = first[1] ^ 0b11111
    rows += [(5_000 + i, near, *first[2:5], [3.0, -1.0, 0.0, 0.0, 1.0 if i < 130 else 40.0]) for i in range(140)] + [(9_000, None, 1, 1, 1, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    kinds = classes(rows)
    for r in rows:
        if None not in r[1:5]:
            i = next(k for k, v in kinds.items() if v[0] == r[1:5])
            parent[max(root(r[0]), root(i))] = min(root(r[0]), root(i))
    for i, j, p, d, _, cos in brute(rows, 8, 10):
        if (cos is not None and cos >= 0.9) or (p <= 2 and d <= 3):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    size = {}
    for x in parent:
        size[root(x)] = size.get(root(x), 0) + 1
    want = {(x, root(x)) for x in parent if size[root(x)] > 1}
    assert {tuple(r) for r in dup.components(df).collect()} == want


def test_candidates_are_few(spark):
    """Hashes at random: what meets in a band stays far below all pairs, for the bounds of the checks."""
    rng = np.random.default_rng(0)
    n = 20_000
    bands = pj.band_plan(64, 8, n)
    h = rng.integers(0, 1 << 63, n)
    met = 0
    for first, bits, radius in bands:
        keys, count = np.unique((h >> first) & ((1 << bits) - 1), return_counts=True)
        at = dict(zip(keys.tolist(), count.tolist()))
        met += sum(at.get((int(x) >> first & ((1 << bits) - 1)) ^ (f >> first), 0) for x in h[:200] for f in pj._ball(first, bits, radius))
    assert met / 200 < n / 100


def test_band_plans_cover_every_split():
    for width, most in ((6, 2), (7, 3), (5, 5), (8, 1)):
        for rows in (10, 10_000, 10**9):
            bands = pj.band_plan(width, most, rows)
            for x in range(1 << width):
                if x.bit_count() <= most:
                    assert any((x >> first & ((1 << bits) - 1)).bit_count() <= r for first, bits, r in bands)


def test_empty(spark):
    assert dup.components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_row_is_sent_a_few_times_however_many_keys_it_asks_for(spark, monkeypatch):
    sent, meet = spark.sparkContext.accumulator(0), pj._meet

    def counted(*how):
        run = meet(*how)
        return lambda batches: run(b for b in batches if sent.add(b.num_rows) is None)

    monkeypatch.setattr(pj, "_meet", counted)
    rng = np.random.default_rng(3)
    h = rng.integers(-(1 << 63), 1 << 63, 12_000)
    h[9_000:] = h[:3_000] ^ np.array([sum(1 << int(b) for b in rng.choice(63, int(k), replace=False)) for k in rng.integers(0, 12, 3_000)])
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(h)], "id long, h long").repartition(5)
    got = {(r.i, r.j, r.distance) for r in pj.hamming_pairs(df, "id", "h", 8, 64).collect()}
    want = set()
    for i in range(len(h)):
        d = np.bitwise_count((h[i + 1 :] ^ h[i]).view(np.uint64))
        want |= {(i, i + 1 + int(j), int(d[j])) for j in np.flatnonzero(d <= 8)}
    assert got == want and len(want) > 1_000
    assert 0 < sent.value <= 6 * len(h)  # three blocks and three groups; probes would be hundreds a row


def test_pairs_that_no_cosine_confirms_are_dropped_where_they_are_found(spark):
    rng, d = np.random.default_rng(7), 16
    rows = planted(6, 150, d)
    for k in range(200):  # few bits each, so all are near by both hashes, and few are alike
        v = rng.normal(size=d).tolist() if k % 10 else [1.0] * (d - 1) + [k / 100]
        p, q, f, g = (sum(1 << int(b) for b in rng.choice(60, 3)) for _ in range(4))
        rows.append((1_000 + k, p, q, f, g, v))
        rows += [(2_000 + 10 * k + n, p, q, f, g, [x + n / 50 for x in v]) for n in range(k % 4)]  # classes of several vectors
    odd = [[0.0] * d, [1.0] * (d - 1) + [None], [1e300] * d, [1.0] * (d - 1), [float("inf")] + [1.0] * (d - 1), [float("nan")] * d, None, []]
    rows += [(9_000 + k, 1 << k, 0, 1 << k, 1, v) for k, v in enumerate(odd)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kinds = dup.classes(df)
    every = dup.near_pairs(kinds)
    whole = {tuple(r) for r in dup.confirmed(every, dup.members(df, kinds), "embedding").drop("cosine").collect()}
    pairs, own = dup.links(df)
    assert {tuple(r) for r in pairs.drop("cosine").collect()} == whole and len(whole) > 200
    first = dup.classes(df, vector="embedding")
    spread = own.filter("centre IS NOT NULL").groupBy("i").agg(dup.F.max(dup._apart("embedding", "centre")).alias("radius"))
    sent = dup.near_pairs(first.join(spread, "i", "left"), alike=(0.9, dup.TIGHT))
    assert sent.count() < every.count() / 4
