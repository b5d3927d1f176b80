import hashlib
import re
import shutil

from pyspark.sql import functions as F

from proofgrid.llm import exact_dedup as ed

SCHEMA = "doc_id long, text string, digest string, keep int"
ROWS = [(3, "a b", "d", 1), (1, "a \t b", "d", 1), (2, "a\nb ", "d", 1), (7, None, None, None), (5, "", "", 0), (None, "", "e", 0), (8, "x" * 50_000, "f", 0), (9, "a b", "g", 2), (4, "q", "h", 0), (4, "q", "h", 0)]


def check(rows, got):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for r in got:
        same = [i for i, t, *_ in rows if hashlib.sha256(norm(t).encode()).hexdigest() == r.text_sha256]
        ids = [i for i in same if i is not None]
        assert r.group_size == len(same) and r.keep_id == (min(ids) if ids else None)
    groups = {r.text_sha256 for r in got}
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


def test_odd_rows_and_a_digest_that_collides(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(ROWS, SCHEMA).repartition(4).write.parquet(path)
    got = ed.dedup(spark, path).collect()
    assert len(got) == len(ROWS)
    check(ROWS, got)
    weak = ed.dedup(spark, path, digest=lambda t: F.substring(ed.sha256(t), 1, 1)).collect()
    assert sorted(map(tuple, weak), key=repr) == sorted(map(tuple, got), key=repr)


def test_state_goes_on_with_later_files(spark, tmp_path):
    path, state = str(tmp_path / "docs.parquet"), f"file://{tmp_path}/state"
    df = spark.createDataFrame(ROWS, SCHEMA)
    df.filter("doc_id > 2 OR doc_id IS NULL").coalesce(1).write.parquet(path)
    first = {r.digest: r.keep.doc_id for r in ed.stream_state(spark, path, checkpoint=state).collect()}
    df.filter("doc_id <= 2").coalesce(1).write.mode("append").parquet(path)
    later = {r.digest: (r.keep.doc_id, r.group_size) for r in ed.stream_state(spark, path, checkpoint=state).collect()}
    key = hashlib.sha256(b"a b").hexdigest()
    assert first[key] == 3 and later[key] == (1, 3)
    shutil.rmtree(tmp_path / "state")


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "none.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    assert ed.dedup(spark, path).count() == 0
