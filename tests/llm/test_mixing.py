import hashlib
import re

import numpy as np

from proofgrid.llm import mixing


def fill(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by the rounds of the contract: shares by weight, cut at the limit, the excess shared again."""
    w = {s: weights[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    total, target, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        level = (total - sum(target.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            target |= {s: level * w[s] for s in open_}
            break
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


def test_targets_and_taken_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr)
    source = {r.doc_id: r.source for r in docs.collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    sizes = {}
    for r in rows:
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id]))
        sizes[source[r.doc_id]] = sizes.get(source[r.doc_id], 0) + r.size
    want, taken = fill(sizes), {}
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)
    at = [r.position for r in rows if r.position is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] < 1


def test_positions_invert_the_integral(spark):
    for knots in ((1.5, 0.5), (1.0, 1.0), (0.2, 1.0, 3.0), (2.0, 2.0, 1.0, 0.5)):
        ys = np.linspace(0, 0.999, 21)
        df = spark.createDataFrame([(float(y),) for y in ys], "y double")
        got = [r.t for r in df.select(mixing._when_reached(df["y"], knots).alias("t")).collect()]
        grid = np.linspace(0, 1, 200_001)
        w = np.interp(grid, np.linspace(0, 1, len(knots)), knots)
        area = np.concatenate([[0], np.cumsum((w[1:] + w[:-1]) / 2) / 200_000])
        assert np.allclose(np.interp(got, grid, area / area[-1]), ys, atol=1e-6)


def test_odd_rows_and_occurrences(spark):
    rows = [(1, "a b c", "x", 1), (2, None, "x", 2), (3, " \n", None, 3), (4, "d  e\tf g", None, 4), (4, "d  e\tf g", None, 4), (None, "h i", "y", 5), (6, "j " * 3000, "z", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    want = fill({"x": 3, None: 8, "y": 2, "z": 3000})
    assert len(got) == len(rows) and abs(sum(r.taken for r in got) - sum(want.values())) <= 2
    out = mixing.occurrences(df).collect()
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in out)
    assert out[0].asDict().keys() == {"doc_id", "text", "source", "size"} and words == sum(r.taken for r in got)
    whole = {t for _, t, _, _ in rows}
    assert all(any(w and w.startswith(r.text) for w in whole) for r in out)
    assert mixing.mix(df.limit(0)).count() == 0
    assert hashlib.md5(b"").hexdigest()[:3] == "d41"
