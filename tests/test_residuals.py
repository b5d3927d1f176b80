import numpy as np

from proofgrid.operators import residuals as rs

SCHEMA = "id long, v array<double>, copy long"


def planted(seed=0, n=400, d=48):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    wave, other = rng.normal(size=d), rng.normal(size=d)
    x[:30] = 0.6 * x[:30] + 1.1 * wave
    x[30:45] = 0.6 * x[30:45] + 1.1 * other
    x[45:60] = x[45] + 0.01 * rng.normal(size=(15, d))  # copies of one image
    copy = [45 if 45 <= i < 60 else i for i in range(n)]
    return [(i, x[i].tolist(), copy[i]) for i in range(n)] + [(n, None, n), (n + 1, x.mean(0).tolist(), n + 1)]


def brute(rows, threshold, least, share):
    """Components over all pairs, pruned by their mean."""
    ids = [r[0] for r in rows if r[1] is not None]
    x = np.array([r[1] for r in rows if r[1] is not None])
    x = x - x.mean(0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    copy = np.array([r[2] for r in rows if r[1] is not None])
    s = np.where(copy[:, None] == copy[None, :], 0, x @ x.T)
    label = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min(label[i], label[s[i] >= threshold].min(initial=label[i])) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    out = {}
    for c in np.unique(label):
        m = np.flatnonzero(label == c)
        if least <= len(m) <= share * len(x):
            t = x[m].mean(0)
            m = m[x[m] @ t / np.linalg.norm(t) >= np.sqrt(threshold)]
            if len(m) >= least and (v := s[np.ix_(m, m)].sum() / len(m) / (len(m) - 1)) >= threshold:
                out[ids[c]] = len(m), round(float(v), 8), [ids[i] for i in m]
    return out


def test_planted_blends_are_those_of_all_pairs(spark):
    rows = planted()
    units = rs.centred(spark.createDataFrame(rows, SCHEMA).repartition(3), "v", "id", "copy")
    want = brute(rows, 0.5, 6, 0.4)
    assert sorted(v[0] for v in want.values()) == [15, 30]
    for most in (4_096, 64):  # large buckets are split and still join the groups
        found, members = rs.groups(units, 0.5, most=most, recall=0.99)
        assert {r.component: (r.n, round(r.consensus, 8)) for r in found.collect()} == {k: v[:2] for k, v in want.items()}
        assert sorted((r.id, r.component) for r in members.collect()) == sorted((i, k) for k, v in want.items() for i in v[2])


def test_plans_keep_their_recall():
    for t in (0.3, 0.5, 0.8):
        for rows in (100, 10**5, 10**8):
            bits, tables = rs.plan(t, rows)
            agree = 1 - np.arccos(t) / np.pi
            assert 1 - (1 - agree**bits) ** tables >= 0.95 and tables <= 64


def test_no_rows(spark):
    found, members = rs.groups(rs.centred(spark.createDataFrame([], SCHEMA), "v", "id"), 0.5)
    assert found.count() == 0 and members.count() == 0


def test_vectors_are_not_written_for_each_key_and_links_are_made_once(spark, monkeypatch):
    written = []
    table = rs.shared_table
    monkeypatch.setattr(rs, "shared_table", lambda df: written.append(df.columns) or table(df))
    rng = np.random.default_rng(5)
    base = rng.normal(size=8)
    rows = [(i, [float(x) for x in (base if i < 6 else 0) + 0.1 * rng.normal(size=8)]) for i in range(12)]
    units = rs.centred(spark.createDataFrame(rows, "id long, v array<double>"), "v", "id")
    out = rs.links(units, 0.6)
    assert written == [["id", "copy", "u"], ["i", "j"]] and out.inputFiles()
    assert {r.i for r in out.collect()} | {r.j for r in out.collect()} >= set(range(6))


def joined(links):
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for i, j in links:
        a, b = sorted((top(i), top(j)))
        up[b] = a
        up.setdefault(a, a)
    return {x: top(x) for x in up}


def test_no_link_is_lost_however_large_a_bucket(spark):
    """A chain: each row is alike to the next alone, so that any lost link parts it."""
    n = 300
    rows = [(i, i, [1.0 if k in (i, i + 1) else 0.0 for k in range(n + 1)]) for i in range(n)]
    rows = [(i, c, [x / 2**0.5 for x in v]) for i, c, v in rows]
    units = spark.createDataFrame(rows, "id long, copy long, u array<double>").repartition(3)
    for most in (None, 40):
        assert joined((r.i, r.j) for r in rs.links(units, 0.45, most=most).collect()) == {i: 0 for i in range(n)}
    whole, parts = (joined((r.i, r.j) for r in rs.links(units, 0.45, recall=0.8, most=most).collect()) for most in (10**6, 8))
    assert whole == parts and 0.8 * n < len(whole) <= n
