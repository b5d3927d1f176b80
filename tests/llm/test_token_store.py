import io
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proofgrid.llm import token_store as ts

TEXTS = [
    "Plain words, with marks... and 12,345 numbers; it's THEY'RE l'eau d'été ÉTÉ ß × ÷ ÿ.", "", "   \t\n", "a" * 5_000, "<|endoftext|> inside<|startoftext|>", "<|ENDOFTEXT|>", "é H̱ İ ΣΣ ẞ", "日本語 and \U0001f600!!",
    "x y z\x1cw\x85v", "a.,;!?b (c) [d] {e} <f> |g| # ## 2 22", "'s 's' don't 'll'D 'RE", "word " * 3_000, "\x00\x01 null", "A­ª² ½", "!" * 300, "naïve façade coöperate",
]


@pytest.fixture(scope="module")
def model():
    return ts.tokenizer_file()


@pytest.fixture(scope="module")
def plain(model):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(model)
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_words_are_those_of_the_library(model, plain):
    enc = ts.Encoder(model)
    for _ in range(2):
        assert [np.frombuffer(c, enc.kind).tolist() for c in enc.encode([t.encode() for t in TEXTS])] == [plain(t) for t in TEXTS]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(max_codepoint=0xFF), st.sampled_from(" .,'sStTlL\n")), max_size=40), max_size=4))
def test_any_latin_text(model, plain, texts):
    enc = ts.encoder(model)
    assert [np.frombuffer(c, enc.kind).tolist() for c in enc.encode([t.encode() for t in texts])] == [plain(t) for t in texts]


def test_little_memory(model, plain, monkeypatch):
    monkeypatch.setattr(ts, "KEPT", 4)
    enc = ts.Encoder(model)
    for t in TEXTS * 2:
        assert np.frombuffer(enc.encode([t.encode()])[0], enc.kind).tolist() == plain(t)


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (7, 2), (1_000, 50_000), (200_000, 300), (70_000, 1)])
def test_shard_access_count_and_find(monkeypatch, n, top):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(0, top).astype(np.uint32) - 1
    docs = pa.table({"id": pa.array([5, 9], pa.int64()), "n_tokens": pa.array([n // 3, n - n // 3], pa.int64())})
    shard = ts.Shard(io.BytesIO(ts.shard_bytes(ids, docs)))
    assert shard.documents().equals(docs) and shard.n_tokens == n
    assert shard.tokens().tolist() == ids.tolist()
    for at in [0, n // 2, n - 1, ts.BLOCK - 1, ts.BLOCK, ts.BLOCK + 1]:
        if 0 <= at < n:
            assert shard.token(at) == ids[at]
    for token in [0, 1, 2, 60_000]:
        for a, b in [(0, n), (n // 4, n // 2), (n, n)]:
            assert shard.count(token, a, b) == int((ids[a:b] == token).sum())
        assert shard.find(token, n - min(n, 500), n) == [i for i in range(n - min(n, 500), n) if ids[i] == token]
    with pytest.raises(IndexError):
        shard.token(n)


def test_one_token_opens_one_block_a_plane():
    ids = np.random.default_rng(0).integers(0, 1_000, 1_000_000)
    shard = ts.Shard(io.BytesIO(ts.shard_bytes(ids, pa.table({"id": [1], "n_tokens": [len(ids)]}))))
    assert shard.token(777_777) == ids[777_777] and shard.blocks_read <= 10


def brute(rows, plain):
    out, start = [], 0
    for i, t in rows:
        ids = np.array([*plain(t or ""), ts.END], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_against_the_library(spark, plain, tmp_path):
    rows = [(i * 7 % 101, TEXTS[i % len(TEXTS)] + f" {i}") for i in range(101)] + [(200, None)]
    df = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, start string").repartition(6)
    for size in (ts.SHARD_TOKENS, 500):
        shards = ts.write_shards(df, shard_tokens=size, folder=f"file://{tmp_path}/t{size}")
        want = brute(sorted(rows), plain)
        assert sorted(map(tuple, ts.documents(shards).collect())) == want
        assert shards.count() == len(list((tmp_path / f"t{size}").iterdir())) and (size > 500 or shards.count() > 10)
    held = [(i, p, x) for (i, t) in sorted(rows) for p, x in enumerate([*plain(t or ""), ts.END])]
    for token in (ts.END, plain("word")[0], 49_000):
        assert sorted((r.doc_id, r.place) for r in ts.occurrences(shards, token).collect()) == [(i, p) for i, p, x in held if x == token]
    got = {r.token: r.n for r in ts.counts(shards, [ts.END, plain("word")[0], 49_000]).collect()}
    assert got == {t: sum(x == t for *_, x in held) for t in got} and len(got) == 3


def test_odd_tables(spark, plain):
    assert ts.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b"), (None, ""), (3, "c"), (3, "c"), (1, None)]
    got = sorted(map(tuple, ts.round_trip(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 1, 3, 3] and sum(r[2] for r in got) == got[-1][1] + got[-1][2]
    words = ts.round_trip(spark.createDataFrame([("b", "x"), ("a", "y z")], "doc_id string, text string")).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in words) == [("a", 0, 3), ("b", 3, 2)]


def test_query_reads_the_whole_table(spark, sf_dir, plain):
    from proofgrid.llm import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = queries.queries()["op12_token_binary_output"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == brute(sorted(map(tuple, docs)), plain)
