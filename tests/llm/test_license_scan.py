import re
import time

import numpy as np
import pytest

from proofgrid.llm.license_scan import Index, align, scan
from proofgrid.llm.licenses import KEYS, TEMPLATES


def lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def test_alignment_is_a_longest_common_subsequence_in_the_band():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 12))
        pairs = align(a, b, 0, 30)
        assert len(pairs) == lcs(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
        assert all(abs(j - i) <= 2 for i, j in align(a, b, 0, 2))


def words_of(t):
    return re.findall("[a-z0-9]+", t.lower())


def has_key(text, name):
    return f" {' '.join(words_of(KEYS.get(name, '')))} ".replace("  ", " ") in f" {' '.join(words_of(text))} "


def test_every_template_finds_itself_and_edited_copies(spark):
    rows, want = [], set()
    for k, (name, text) in enumerate(TEMPLATES.items()):
        rows.append((2 * k, "été words before it. " + text + " and words after"))
        words = text.split()
        if len(words) > 30:  # an edit in every 12 words, and a word left out
            edited = [w for i, w in enumerate(words) if i != 20]
            edited[::12] = ["changed"] * len(edited[::12])
            rows.append((2 * k + 1, " ".join(edited)))
            if has_key(" ".join(edited), name):
                want.add((2 * k + 1, name))
        want.add((2 * k, name))
    got = scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert want <= {(r.doc_id, r.license) for r in got}
    whole = {(r.doc_id, r.license): r for r in got}
    for k, (name, text) in enumerate(TEMPLATES.items()):
        r = whole[2 * k, name]
        assert r.coverage == 1 and rows_text(rows, 2 * k)[r.start : r.stop] == text.rstrip(".;/")


def rows_text(rows, i):
    return next(t for k, t in rows if k == i)


def test_notices_in_documents_match_plain_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    short = {k: v for k, v in TEMPLATES.items() if len(v) < 80}
    plain = {(r.doc_id, k) for r in docs.collect() for k, v in short.items() if v in r.text}
    got = {(r.doc_id, r.license) for r in scan(docs).filter("coverage = 1").collect()}
    assert plain and plain == got


def test_odd_rows(spark):
    twice = TEMPLATES["mit-notice"] + " x y z " * 3000 + TEMPLATES["mit-notice"]
    df = spark.createDataFrame([(1, None), (2, ""), (3, "?!"), (4, "under the"), (5, twice), (None, TEMPLATES["mit-notice"])], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.license, r.coverage) for r in scan(df.withColumn("license", df.doc_id)).collect())
    assert got == [("5", "mit-notice", 1.0)] * 2 + [("None", "mit-notice", 1.0)]
    assert scan(df.limit(0)).count() == 0
    assert len(Index(TEMPLATES).hash) > len(TEMPLATES)


def test_short_notices_with_changed_and_inserted_words_match_plain_alignment(spark):
    short = {k: words_of(v) for k, v in TEMPLATES.items() if len(v.split()) <= 15}
    rows = []
    for words in short.values():
        edited = []
        for i in range(len(words)):
            changed = [*words[:i], "changed", *words[i + 1 :]]
            edited += [changed, words[:i] + words[i + 1 :]] + [[*words[:j], "inserted", *words[j:]] for j in (i, i + 1)]
            edited += [[*changed[:j], "inserted", *changed[j:]] for j in range(1, len(words))]
            edited += [[*changed[:j], "changed", *changed[j + 1 :]] for j in range(i + 1, len(words))]
        rows += [" ".join(["some", "words", "before", *e, "and", "after", "it"]) for e in edited]
    rows += ["Released under an MIT License", "Released under the permissive MIT License"]
    got = {(r.doc_id, r.license) for r in scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    want = {(i, k) for i, t in enumerate(rows) for k, words in short.items() if lcs(words, words_of(t)) >= 0.75 * len(words) and has_key(t, k)}
    assert {len(rows) - 2, len(rows) - 1} <= {i for i, _ in want}
    assert {x for x in got if x[1] in short} == want


@pytest.mark.parametrize(
    "text",
    [
        "Licensed under CC BY-SA 4.0.", "This work is licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU Lesser General Public License, version 3.",
        "Released under the BSD License.", "Released under the Apache License.", "Licensed under the Apache License, Version 1.1.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC 3.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
)
def test_relatives_are_not_reported(spark, text):
    assert scan(spark.createDataFrame([(1, f"before. {text} after")], "doc_id long, text string")).count() == 0


def test_a_span_has_its_best_template(spark):
    rows = list(enumerate(TEMPLATES.values()))
    got = scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.license) for r in got) == list(enumerate(TEMPLATES))


def test_time_grows_with_the_matches():
    from proofgrid.llm.license_scan import _scan
    import pyarrow as pa

    run, took = _scan(TEMPLATES, 0.75, KEYS), []
    for n in (2_000, 8_000):
        text = " and so on ".join([TEMPLATES["apache-2.0-notice"]] * n)
        began = time.perf_counter()
        assert sum(b.num_rows for b in run(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])]))) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0]
