"""The pipeline against its stages by brute force, and against planted documents."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_line_dedup import brute as lines_brute
from tests.llm.test_mixing import fill
from tests.llm.test_ngram_join import brute as components_brute
from tests.llm.test_ngram_join import sets_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_fails(t):
    w = WORD.findall(t)
    times = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {k for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w) < 50 or 100 * len(hit) > 50 * len(w)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Prose of several sources with copies, near copies, a shared passage and junk."""
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("ban", "cor", "del", "fim", "gor", "hul", "jen", "kol", "lum", "mir") for b in ("a", "e", "i", "o", "u", "an", "en", "is", "or", "um")]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(6, 14))) + "."
    prose = lambda n: "\n".join(line() for _ in range(n))
    passage = " ".join(rng.choice(words) for _ in range(60))
    rows = [(k, prose(rng.randint(9, 20)), f"s{k % 4}") for k in range(60)]
    rows += [(100 + k, rows[k][1], "s0") for k in range(5)]
    near = []
    for k in range(10, 16):
        w = rows[k][1].split(" ")
        w[len(w) // 2] = "changed"
        near.append((200 + k, " ".join(w), "s1"))
    rows += near + [(300 + k, prose(8) + "\n" + passage + "\n" + prose(8), None if k == 2 else "s2") for k in range(4)]
    rows += [(400 + k, " | ".join(rng.choice(words) + "##$" for _ in range(80)), "s3") for k in range(12)] + [(500, None, "s1"), (501, "too short", "s1"), (502, "spam " * 200, "s1")]
    root = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(k, 1, 0) for k in range(0, 60)] + [(400 + k, 0, 0) for k in range(8)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return str(root), {i: t for i, t, _ in rows}, passage, {i: s for i, _, s in rows}


def test_rows_match_brute_force(spark, folder):
    root, texts, passage, source = folder
    docs = spark.read.parquet(f"{root}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality rules"](spark, docs, root)
    got = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == docs.columns and set(got) == {i for i, t in texts.items() if t and i < 400 and not base_fails(t)}

    drop = lines_brute(list(got.items()))
    less = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[i, t]) for i, t in got.items()}
    want = {i: t for i, t in less.items() if WORD.search(t)}
    lined = {r.doc_id: (r.text, r.n_chars) for r in stage["line dedup"](spark, kept, root).collect()}
    assert lined == {i: (t, len(t)) for i, t in want.items()}
    assert sum(passage in t for t, _ in lined.values()) == 1

    ids = sorted(want)
    comps = components_brute(sets_of([want[i] for i in ids]), 75)
    first = {i for k, i in enumerate(ids) if comps[k] == k}
    frame = spark.createDataFrame([(i, t, "en", source[i], len(t)) for i, t in want.items()], docs.schema)
    joined = stage["n-gram Jaccard join"](spark, frame, root)
    assert {r.doc_id for r in joined.collect()} == first
    assert not first & set(range(100, 105)) and not first & set(range(210, 216)) and set(range(300, 304)) <= first

    sizes = Counter()
    for i in first:
        sizes[source[i]] += len(WORD.findall(want[i]))
    target, taken = fill(dict(sizes)), Counter()
    final = corpus_pipeline.run(spark, root).collect()
    for r in final:
        assert r.doc_id in first and want[r.doc_id].startswith(r.text) and len(r.ids) == r.n_tokens and r.n_chars == len(r.text)
        taken[r.source] += len(WORD.findall(r.text))
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    assert max(Counter(r.doc_id for r in final).values()) <= 2


def test_empty_tables(spark, folder, tmp_path):
    root, *_ = folder
    for t in ("documents", "labels"):
        spark.read.parquet(f"{root}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "text", "ids"} <= set(out.columns)


def test_columns_of_any_name_survive(spark, folder, tmp_path):
    root, texts, *_ = folder
    names = ("o", "K", "drop", "_id", "_text", "ids", "n_tokens", "n_dropped", "N_LINES", "row", "node", "size", "taken", "target", "words", "body")
    docs = spark.read.parquet(f"{root}/documents.parquet").filter("doc_id < 40 OR doc_id BETWEEN 400 AND 406")
    docs = docs.select("*", *((F.col("doc_id") * 10 + i).alias(n) for i, n in enumerate(names))).union(docs.filter("doc_id = 3").select("*", *(F.lit(None).cast("long") for _ in names)).withColumn("doc_id", F.lit(None).cast("long")))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{root}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(rows) > 20 and None not in {r.doc_id for r in rows}
    for r in rows:
        assert [r[n] for n in names] == [r.doc_id * 10 + i for i in range(len(names))] and len(r.ids_) == r.n_tokens_
