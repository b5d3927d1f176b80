import random
import re

import numpy as np
import pytest

from proofgrid.llm import ngram_join as nj


def sets_of(texts, n=5):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    return out


def brute(sets, percent):
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * (k := len(x & y)) >= percent * (len(x) + len(y) - k):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


def check(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.jaccard_components(df, **options).collect()}
    sets = sets_of(texts)
    want = {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, brute(sets, options.get("percent", 75)), strict=True))}
    assert got == want
    return want


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(25):
        own = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 9)):
            copy = list(own)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    shared = [rng.choice(words) for _ in range(40)]  # a passage in many texts
    texts += [" ".join([rng.choice(words) for _ in range(rng.randint(0, 25))] + shared) for _ in range(40)]
    return [*texts, texts[0].upper(), None, "", " \n", "one", "One", "one two three", "one two three"]


@pytest.mark.parametrize("options", [{}, {"pairwise": 64}, {"pairwise": 1, "star": 3, "block": 2}, {"percent": 50}])
def test_components_match_brute_force(spark, options):
    want = check(spark, corpus(len(str(options))), **options)
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_chain_of_copies_is_one_component(spark):
    words = [f"x{k}" for k in range(140)]
    want = check(spark, [" ".join(words[k : k + 60]) for k in range(0, 80, 6)])
    assert {c for _, c in want.values()} == {0}


def test_suffix_filter_is_a_lower_bound():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(2))
        true = len(set(x) ^ set(y))
        for most in (0, 5, 20, 60):
            low = nj.suffix_apart(x, y, most)
            assert low <= true


def test_parities_bound_the_difference():
    rng = np.random.default_rng(8)
    for _ in range(200):
        x, y = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(2))
        a, b = (np.frombuffer(nj.parities(s), np.uint64) for s in (x, y))
        assert len(a) == nj.PARITY // 64 and np.bitwise_count(a ^ b).sum() <= len(set(x.tolist()) ^ set(y.tolist()))


def test_odd_ids_and_keep_one(spark):
    text = " ".join(f"t{k}" for k in range(30))
    other = " ".join(f"u{k}" for k in range(30))
    rows = [(None, text, 1), (5, text, 2), (5, other, 3), (5, other, 3), (None, "alone here", 4), (9, "x", 5), (9, "x", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in nj.jaccard_components(df).collect())
    assert got == [("5", 26, "5")] * 3 + [("9", 1, "9")] * 2 + [("None", 1, "None"), ("None", 26, "5")]
    kept = sorted((str(r.doc_id), r.text) for r in nj.keep_one(df).collect())
    assert kept == [("5", text), ("5", other), ("9", "x"), ("None", "alone here")]
    assert nj.jaccard_components(df.limit(0)).count() == 0


def linked(sets, percent=75):
    return {(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if x and y and 100 * (k := len(x & y)) >= percent * (len(x) + len(y) - k)}


@pytest.mark.parametrize("options", [{}, {"pairwise": 1, "star": 4, "block": 3}])
def test_every_link_and_their_counts(spark, options):
    texts = corpus(5)[:90] + ["one two three", "one two three", None]
    sets = sets_of(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    pairs = linked(sets)
    first = {frozenset(s): i for i, s in reversed(list(enumerate(sets)))}
    want = {(a, b, len(sets[a]), len(sets[b]), len(sets[a] & sets[b])) for i, j in pairs if sets[i] != sets[j] for a, b in [sorted((first[frozenset(sets[i])], first[frozenset(sets[j])]))]}
    got = [tuple(r) for r in nj.similar_pairs(df, **options).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10
    counts = {r.doc_id: r.n_links for r in nj.link_counts(df, **options).collect()}
    assert counts == {i: sum(i in p for p in pairs) for i in range(len(texts))}


def test_a_chain_through_rows_that_share_an_id(spark):
    words = [f"x{k}" for k in range(140)]
    rows = [(i, " ".join(words[6 * k : 6 * k + 90])) for k, i in enumerate((1, 5, 6, 5, 2))]
    assert {r.component_id for r in nj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1}


def test_columns_of_any_name_go_along(spark):
    text = " ".join(f"t{k}" for k in range(30))
    df = spark.createDataFrame([(1, text, 11, "a", 3, "n"), (2, text, 12, "b", 4, "m")], "doc_id long, text string, _id int, _text string, _row int, node string")
    assert [tuple(r) for r in nj.keep_one(df).collect()] == [(1, text, 11, "a", 3, "n")]


@pytest.mark.parametrize("after", [1, 2, 5])
def test_the_rest_of_a_long_list_stays_with_it(after):
    import pyarrow as pa

    rows = [(6, 70, 100, 0), (6, 71, 100, 0)] + [(7, k, 100, 20 if k == 16 else 0) for k in range(17 + after)] + [(8, 90, 100, 0), (8, 91, 100, 0)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*part, strict=True)], ["h", "node", "size", "place"])
    out = [r for b in nj._candidates(75, 4, 256, held_most=16)(iter([batch(rows[:19]), batch(rows[19:])])) for r in b.to_pylist()]
    pairs = {(r["u"], r["v"]) for r in out if r["v"] is not None}
    assert {(70, 71), (90, 91)} <= pairs and {r["u"] for r in out if r["v"] is None} == set(range(17 + after))
    near = {k: {x for p in pairs if k in p for x in p} for k in range(17 + after)}  # the centre goes on as the next part's first row
    reach = near[0]
    for _ in range(20):
        reach = reach.union(*(near[k] for k in reach))
    assert reach == set(range(17 + after)) - {16}


def test_signatures_bound_the_difference_and_tell_sets_apart():
    rng = np.random.default_rng(9)
    told = 0
    for _ in range(100):
        size = int(rng.integers(50, 3_000))
        x, y = (np.unique(rng.integers(0, 1 << 40, k).astype(np.uint64)) for k in (size, size * 7 // 8))
        z = np.unique(np.concatenate([x[: -len(x) // 9], y[: len(x) // 20]]))
        for a, b in ((x, y), (x, z), (y, x), (x, x)):
            low, true = nj.signatures_apart(nj.signature(a), nj.signature(b)), len(set(a.tolist()) ^ set(b.tolist()))
            assert low <= true and (low - true) % 2 == 0
        most = (len(x) + len(y)) // 7  # 75 % of a union
        told += nj.signatures_apart(nj.signature(x), nj.signature(y)) > most
    assert told > 95


def test_only_sets_that_may_link_are_built(spark):
    rng = random.Random(3)
    texts = [" ".join(f"v{rng.randrange(5_000)}" for _ in range(900)) for _ in range(40)]
    texts += [texts[0] + " x y z", "one two three"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    j = nj._Join(df, "doc_id", "text", 5, 75, 4, 256, 2_048)
    node = {r.doc_id: r.node for r in j.profile.collect()}
    j.pairs = spark.createDataFrame([tuple(sorted((node[a], node[b]))) for a in range(42) for b in range(a)], "u long, v long")
    members = j.members()
    sets = []
    build = j.sets
    j.sets = lambda pairs, own: sets.append(build(pairs, own)) or sets[-1]
    assert [(r.u, r.v) for r in j.verified(j.pairs, members).collect()] == [tuple(sorted((node[0], node[40])))]
    assert members.count() == 42 and sets[0].count() == 2
