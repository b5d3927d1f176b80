import random

import pytest
import sentencepiece

from proofgrid.llm import piece_codec as pc

ODD = ["", " ", "Hello  world", " a\n b\tc  ", "émentre 😀 ﬁ Ａ", "x▁y", "\x00\x01 aa\r\n", "aaaaaaaa" * 40, "   " * 30, "<s> </s> <unk> <0x0A>", "ab" * 1000, "日本語テキスト 한국어", "ẞß" * 70 + "the" * 50, "https://example.com/a?b=c&d=1234567890"]


@pytest.fixture(scope="module")
def own():
    return pc.Codec(pc.default_model())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pc.default_model())


def test_ids_and_texts_are_those_of_the_library(own, library):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcdethin  ▁éñ\n😀1<>.,") for _ in range(rng.randint(0, 120))) for _ in range(1500)]
    ids = own.encode(texts)
    assert ids == [library.encode(t) for t in texts]
    assert own.decode(ids) == [library.decode(i) for i in ids]
    assert own.decode([[0, 1, 2], [200], [35, 200]]) == [library.decode([1, 2]), library.decode([200]), library.decode([35, 200])]


def test_every_batch_stands_alone(own, library):
    for part in (["the cat sat on the mat"], ["a dog and another cat ran " * 5], [f"w{k} x{k}" for k in range(100)], [None, "", None]):
        assert own.encode(part) == [t if t is None else library.encode(t) for t in part]


def test_documents_and_odd_rows(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = pc.decode(pc.encode(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows[::7]:
        assert list(r.ids) == library.encode(r.text) and r.decoded == r.text
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (2, "", 6), (None, "the", 7)], "doc_id long, text string, ids int")
    rows = pc.decode(pc.encode(df), ids_col="ids_").collect()
    got = {(r.doc_id, r.text): (r.ids_, r.decoded) for r in rows}
    assert sorted(r.ids for r in rows) == [5, 6, 6, 7]
    assert got[1, None] == (None, None) and got[2, ""] == ([], "") and got[None, "the"][1] == "the"
    assert pc.encode(df.limit(0)).count() == 0
    assert pc.round_trips(docs).filter("NOT round_trip").count() == 0
