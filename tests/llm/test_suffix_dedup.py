import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from proofgrid.llm import suffix_dedup as sd
from proofgrid.llm.kernels import prefix_hash


def brute(texts, length):
    """Removed bytes of each text, by a table of all windows."""
    raw = [(t or "").encode() for t in texts]
    times = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append((bytes(x for x, g in zip(b, gone, strict=True) if not g), int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))))
    return out


def check(spark, texts, length=200, gram=32, hot=20_000, ids=None):
    rows = list(zip(ids or range(len(texts)), texts, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, bytes(r.kept), len(r.starts)) for r in sd.remove_repeats(df, length=length, gram=gram, hot=hot).collect()), key=repr)
    want = sorted(((i, len((t or "").encode()), k, n) for (i, t), (k, n) in zip(rows, brute(texts, length), strict=True)), key=repr)
    assert got == want
    return got


def test_documents_match_brute_force(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    got = check(spark, texts)
    assert any(len(k) < n for _, n, k, _ in got)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_random_texts_with_shared_pieces_and_periods(spark, hot):
    random.seed(hot)
    pieces = ["".join(random.choice("abé ") for _ in range(random.randint(5, 60))) for _ in range(12)]
    texts = ["".join(random.choice(pieces) for _ in range(random.randint(0, 12))) for _ in range(60)]
    texts += ["a" * 90, "a" * 39, "ab" * 60, None, "", "short", texts[3], texts[3], "x" + texts[5] + "y"]
    check(spark, texts, length=40, gram=8, hot=hot)


def test_repeated_rows_and_ids_and_empty_table(spark):
    long = "".join(random.Random(1).choice("abcdefgh") for _ in range(500))
    check(spark, [long, long, "z" + long[:250], None, long[:199]], ids=[7, 7, 7, None, None])
    df = spark.createDataFrame([], "doc_id long, text string, h long")
    assert sd.remove_repeats(df).count() == 0


def test_order_falls_back_to_bytes_after_a_collision(monkeypatch):
    arounds = [b"aXbcdefgh", b"aXbcdxfgh", b"bXbcdefgz"]
    offs, first = np.array([1, 1, 1]), np.array([0, 3])
    want = sd.covered(arounds, offs, first, 5)
    monkeypatch.setattr(sd, "_differs", lambda *a: True)
    assert all((x == y).all() for x, y in zip(sd.covered(arounds, offs, first, 5), want, strict=True))


def test_suffix_order_is_lexicographic():
    rng = random.Random(5)
    own = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(200)]
    buf = np.frombuffer(b"".join(own), np.uint8)
    size = np.array([len(x) for x in own])
    start = np.cumsum(size) - size
    order, common = sd.suffix_order(buf, prefix_hash(buf), start, size, np.array([0, 90, 90, 200]))
    for s, e in ((0, 90), (90, 200)):
        ranked = [own[i] for i in order[s:e]]
        assert ranked == sorted(own[s:e])
        assert list(common[s + 1 : e]) == [next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y))) for x, y in zip(ranked, ranked[1:], strict=False)]


def test_query_digests(spark, sf_dir):
    from proofgrid.llm.queries import op1_suffix_array_dedup

    r = op1_suffix_array_dedup(spark, sf_dir).filter("n_removed = 0").first()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").filter(f"doc_id = {r.doc_id}").first().text
    assert r.kept_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_long_texts_have_the_same_anchors_in_pieces_and_other_buffers(monkeypatch):
    rng = random.Random(4)
    text = bytes(rng.randrange(97, 100) for _ in range(6_000)) + b"ab" * 900
    whole = [x.tolist() for x in sd.anchors([text], 200, 32)[1:]]
    beside = sd.anchors([b"x" * 5_000, text, b"y" * 700], 200, 32)
    assert [x[beside[0] == 1].tolist() for x in beside[1:]] == whole
    monkeypatch.setattr(sd, "PIECE", 1_000)
    assert [x.tolist() for x in sd.anchors([text], 200, 32)[1:]] == whole
