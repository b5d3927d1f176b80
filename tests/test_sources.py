import hashlib
import json

import pytest

from proofgrid.functions import provenance as pv
from proofgrid.operators import ledger as lg
from proofgrid.sources import datasets, logs, sinks
from proofgrid.streaming import tail


def touch(root, *names):
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_bytes(n.encode())


def test_manifest(spark, tmp_path):
    rows = [{"id": "a", "file": "x/a.png", "label": "truck", "bbox": [1, 2, 3, 4], "contributor": "c"}, {"path": "b.png", "bbox": "1, 2, 3"}, {"file_name": "c.png", "boxes": [{"category": "car", "bbox": [0, 0, 1, 1]}, {"category": "car", "bbox": [1, None, 1, 1]}]}, {"file": "../d.png"}]
    (tmp_path / "manifest.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\nnot json\n")
    touch(tmp_path, "x/a.png")
    ds = datasets.open_dataset(spark, str(tmp_path))
    got = {r.id: r for r in ds.samples.collect()}
    assert ds.format == "manifest" and set(got) == {"a", "b.png", "c.png"}
    assert got["a"].boxes[0].asDict() == {"category": "truck", "x": 1, "y": 2, "w": 3, "h": 4} and got["c.png"].label == "car" and len(got["c.png"].boxes) == 1
    assert ds.issues.count() == 4 and [r.name for r in ds.classes().collect()] == ["car", "truck"]
    index = {r.id: r for r in datasets.index_files(spark, ds, str(tmp_path)).collect()}
    assert index["a"].digest == "sha256:" + hashlib.sha256(b"x/a.png").hexdigest() and index["b.png"].error_kind == "missing"
    assert datasets.dataset_digest(ds.samples).first().digest == datasets.dataset_digest(ds.samples.repartition(5)).first().digest
    (tmp_path / "manifest.jsonl").write_text('{"file": "a"}\n{"file": "a"}\n')
    with pytest.raises(ValueError):
        datasets.open_dataset(spark, str(tmp_path))


def test_coco_and_sidecar(spark, tmp_path):
    doc = {"images": [{"id": 1, "file_name": "a.png", "width": 10, "height": 8}, {"id": 1, "file_name": "z.png"}, {"id": 2, "file_name": "b.png"}], "categories": [{"id": 7, "name": "cat"}], "annotations": [{"image_id": 1, "category_id": 7, "bbox": [1, 1, 2, 2]}, {"image_id": 3, "category_id": 7, "bbox": [1, 1, 2, 2]}, {"image_id": 2, "category_id": 8, "bbox": [1, 1, 2, 2]}, {"image_id": 2, "category_id": 7, "bbox": [1, 1]}]}
    (tmp_path / "annotations.json").write_text(json.dumps(doc))
    (tmp_path / "metadata.csv").write_text("file,contributor,sensor\n./a.png,me,\nq.png,you,s\n")
    ds = datasets.open_dataset(spark, str(tmp_path))
    got = {r.id: r for r in ds.samples.collect()}
    assert got["1"].file == "a.png" and got["1"].label == "cat" and got["1"].contributor == "me" and got["2"].label is None
    assert sorted(r.message for r in ds.issues.collect()) == ["annotation of an unknown category", "annotation of an unknown image", "box is not four finite numbers", "image id occurs twice", "metadata of no sample"]


def test_yolo_voc_and_folders(spark, tmp_path):
    y = tmp_path / "yolo"
    touch(y, "images/train/a.png", "images/train/b.png")
    (y / "data.yaml").write_text("names: {0: cat, 1: dog}\n")
    (y / "labels/train").mkdir(parents=True)
    (y / "labels/train/a.txt").write_text("1 0.5 0.5 0.2 0.4\n5 0 0 1 1\nbad\n")
    ds = datasets.open_dataset(spark, str(y))
    got = {r.file: r for r in ds.samples.collect()}
    assert got["train/a.png"].label == "dog" and got["train/a.png"].split == "train" and got["train/b.png"].boxes == [] and ds.issues.count() == 2
    px = ds.samples.filter("label = 'dog'").selectExpr("boxes", "100D AS w", "50D AS h").select(datasets.yolo_to_pixels("boxes", "w", "h").alias("b")).first().b[0]
    assert (px.x, px.y, px.w, px.h) == (40, 15, 20, 20)
    v = tmp_path / "voc"
    (v / "Annotations").mkdir(parents=True)
    (v / "Annotations/a.xml").write_text("<annotation><filename>a.jpg</filename><size><width>9</width><height>7</height></size><object><name>car</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>4</xmax><ymax>6</ymax></bndbox></object></annotation>")
    r = datasets.open_dataset(spark, str(v)).samples.first()
    assert (r.file, r.label, r.width) == ("a.jpg", "car", 9) and (r.boxes[0].w, r.boxes[0].h) == (3, 4)
    f = tmp_path / "folder"
    touch(f, "cat/1.png", "dog/2.PNG", "dog/note.txt")
    ds = datasets.open_dataset(spark, str(f))
    assert ds.format == "imagefolder" and {(r.file, r.label) for r in ds.samples.collect()} == {("cat/1.png", "cat"), ("dog/2.PNG", "dog")}
    p = tmp_path / "plain"
    touch(p, "1.png")
    assert datasets.detect_format(spark, str(p)) == "plain" and datasets.open_dataset(spark, str(p)).samples.first().id == "1.png"


SECRET = bytes(range(32))
PUBLIC = pv.public_key(SECRET)
KEY = "ed25519:" + hashlib.sha256(__import__("base64").urlsafe_b64encode(PUBLIC).rstrip(b"=") and PUBLIC).hexdigest()[:16]
DOMAIN = "example"


def b64(x):
    import base64

    return base64.urlsafe_b64encode(x).rstrip(b"=").decode()


def record(seq, prev, kind="inference", body=None, key=KEY):
    r = {"v": 1, "ledger": "L", "seq": seq, "prev": prev, "ts": f"2024-01-01T00:00:{seq % 60:02d}Z", "nonce": f"n{seq}", "kind": kind, "body": body or {"model_digest": "m"}, "key_id": key}
    r["sig"] = b64(pv.sign(SECRET, f"{DOMAIN}/ledger/v1".encode() + b"\0" + pv.canonical(r).encode()))
    return r


def entry(r):
    return "sha256:" + hashlib.sha256(f"{DOMAIN}/entry/v1".encode() + b"\0" + pv.canonical(r).encode()).hexdigest()


@pytest.fixture(scope="module")
def chain():
    out, prev, seen = [], lg.GENESIS, []
    for k in range(8):
        body = {"tree_size": 5, "root": "sha256:" + pv.merkle_root([x.encode() for x in seen]).hex()} if k == 5 else None
        out.append(record(k, prev, "checkpoint" if k == 5 else "inference", body))
        prev = entry(out[-1])
        seen.append(prev)
    return out


def statuses(spark, tmp_path, records):
    path = tmp_path / "ledger.jsonl"
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records) + "\n\n")
    keys = spark.createDataFrame([(KEY, b64(PUBLIC), ["ledger"], None, None, False)], "key_id string, public_key string, roles array<string>, not_before string, not_after string, revoked boolean")
    rows = lg.verify(lg.parsed(logs.ledger_lines(spark, str(path)), keys, DOMAIN)).orderBy("line").collect()
    return [r.status for r in rows], [r.classes for r in rows]


def test_ledger_attacks(spark, tmp_path, chain):
    good, none = statuses(spark, tmp_path, chain)
    assert good == ["VALID"] * 8 and none == [[]] * 8
    edited = [dict(r) for r in chain]
    edited[3] = {**edited[3], "body": {"model_digest": "other"}}
    state, classes = statuses(spark, tmp_path, edited)
    assert state[:3] == ["VALID"] * 3 and state[3] == "FAILED" and "record_modification" in classes[3] and state[4] == "UNTRUSTED" and state[5] == "UNTRUSTED"
    state, classes = statuses(spark, tmp_path, chain[:3] + chain[4:])
    assert state[3] == "FAILED" and classes[3] == ["record_deletion"]
    state, classes = statuses(spark, tmp_path, [*chain[:2], chain[3], chain[2], *chain[4:]])
    assert classes[2] == ["record_reorder"] and classes[3] == ["record_reorder"]
    state, classes = statuses(spark, tmp_path, [*chain, chain[2]])
    assert classes[8] == ["record_replay"] and state[:8] == ["VALID"] * 8
    state, classes = statuses(spark, tmp_path, [*chain[:2], record(2, entry(chain[1]), key="ed25519:nobody"), "{broken"])
    assert classes[2] == ["signature_forgery"] and classes[3] == ["record_modification"] and state[3] == "FAILED"


def test_anchors_and_merkle_roots(spark, chain):
    hashes = [entry(r) for r in chain]
    rows = spark.createDataFrame([("f", k, k, h) for k, h in enumerate(hashes)], "ledger_file string, line long, seq long, entry_hash string")
    root = lambda n: "sha256:" + pv.merkle_root([h.encode() for h in hashes[:n]]).hex()
    anchors = spark.createDataFrame([("a", "f", 5, root(5)), ("b", "f", 5, root(4)), ("c", "f", 9, root(8))], "anchor string, ledger_file string, tree_size long, root string")
    assert {r.anchor: r.status for r in lg.check_anchors(anchors, rows).collect()} == {"a": "CONSISTENT", "b": "MISMATCH", "c": "TRUNCATED"}
    for n in range(1, 20):
        leaves = [bytes([k]) for k in range(n)]
        top = pv.merkle_root(leaves)
        assert all(pv.verify_inclusion(leaves[k], pv.inclusion_proof(k, leaves), top) for k in range(n))
        assert not pv.verify_inclusion(b"x", pv.inclusion_proof(0, leaves), top)


def test_signatures_and_canonical_form():
    public = bytes.fromhex("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a")
    sig = bytes.fromhex("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b")
    assert pv.verify_signature(public, b"", sig) and not pv.verify_signature(public, b"x", sig) and not pv.verify_signature(public, b"", sig[:-1] + b"\xff")
    assert pv.canonical({"b": [1, None, True], "a": "é\n", "\U0001f600": {}, "ﬁ": 0}) == '{"a":"é\\n","b":[1,null,true],"\U0001f600":{},"ﬁ":0}'
    for bad in (1.5, 1 << 60, {1: 2}):
        with pytest.raises(pv.CanonicalError):
            pv.canonical(bad)


def test_trust_root_report_and_evidence(spark, tmp_path):
    doc = {"version": 1, "keys": [{"key_id": "ed25519:" + hashlib.sha256(PUBLIC).hexdigest()[:16], "public_key": b64(PUBLIC), "roles": ["ledger"], "revoked": False}], "approved_models": []}
    (tmp_path / "trust.json").write_text(json.dumps(doc))
    keys, models = logs.trust_root(spark, str(tmp_path / "trust.json"))
    assert keys.count() == 1 and models.count() == 0
    root = f"file://{tmp_path}/report"
    sinks.write_report(root, spark, {"report.json": "{}", "coverage.md": "x"})
    assert {(r.file, r.ok) for r in logs.verify_report(spark, root).collect()} == {("report.json", True), ("coverage.md", True)}
    blobs = spark.createDataFrame([(b"a", "text"), (b"a", "text"), (b"b", "text")], "content binary, media_type string")
    for _ in range(2):
        sinks.write_evidence(blobs, f"{tmp_path}/evidence")
    assert [r.ok for r in sinks.verify_evidence(spark, f"{tmp_path}/evidence").collect()] == [True, True]


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [("a" if k % 2 else "b", k, f"h{k}", f"h{k - 2}" if k > 1 else "genesis") for k in range(40)]
    rows[21] = (*rows[21][:3], "broken")
    df = spark.createDataFrame(rows, "ledger string, line long, entry_hash string, prev string")
    df.filter("line < 20").coalesce(1).write.parquet(f"{tmp_path}/in")
    df.filter("line >= 20").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    want = {(r.ledger, r.line, r.linked, r.trusted) for r in lg.links(df, genesis="genesis").collect()}
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = tail.link_stream(tail.read_stream(spark, f"{tmp_path}/in"), "genesis").writeStream.format("memory").queryName("links").trigger(availableNow=True).start()
        q.awaitTermination()
        got = {tuple(r) for r in spark.table("links").collect()}
    except ImportError:
        pytest.skip("stateful Python processors need protobuf")
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert got == want
    q = tail.tail(tail.read_stream(spark, f"{tmp_path}/in"), "line", 30).writeStream.format("memory").queryName("tail").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("tail").count() == 9
