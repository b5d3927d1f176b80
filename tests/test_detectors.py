import random

import numpy as np
from pyspark.sql import functions as F

from proofgrid.operators import pairs
from proofgrid.plans import data, engine
from proofgrid.plans.detectors import CHECKS, present


def test_a_scan_finds_what_was_planted(spark):
    rng = random.Random(5)
    nrg = np.random.default_rng(5)
    rows, hashes, vectors = [], [], []
    base = rng.getrandbits(63)
    for k in range(240):
        who = f"c{k % 4}"
        copy = who == "c3" and k % 8 == 3 and k < 120
        h = base ^ (1 << rng.randrange(63)) if copy else rng.getrandbits(63)
        label = "ab"[k % 2]
        ts = "2024-01-02T00:00:%02dZ" % (k % 60) if who == "c1" and k < 80 else f"2024-01-{1 + k // 10:02d}T{k % 10 + 8:02d}:00:00Z" if k != 50 else "soon"
        box = [("car", 1.0, 1.0, 5.0 + k % 3, 5.0)] if k != 60 else [("car", 1.0, 1.0, -2.0, 5.0)]
        rows.append((k, label, who, "b", "d", "d" if k != 70 else "x", None if k != 71 else "missing", ts, box, 40.0, 40.0))
        hashes.append((k, h, h, rng.getrandbits(63), rng.getrandbits(63)))
        x = nrg.normal(0, 1, 6) + (3 if label == "a" else -3) + (25 if k in (5, 9) else 0)
        vectors.append((k, who, label, x.tolist()))
    samples = spark.createDataFrame(rows, "sample_id long, label string, contributor string, batch string, digest string, declared_digest string, error_kind string, timestamp string, boxes array<struct<category:string,x:double,y:double,w:double,h:double>>, width double, height double")
    emb = spark.createDataFrame(vectors, "sample_id long, contributor string, label string, embedding array<double>")
    axes = [(k < 150, "g", "u", float(nrg.normal(0, 1))) for k in range(300)] + [(k < 150, "g", "v", float(nrg.normal(0 if k < 150 else 2, 1))) for k in range(300)] + [(k < 150, "h", "v", float(nrg.normal(0, 1))) for k in range(300)]
    roles = {
        "samples": samples, "hashes": spark.createDataFrame(hashes, "sample_id long, phash long, dhash long, phash_flip long, dhash_flip long"), "embeddings": emb,
        "axes": spark.createDataFrame(axes, "is_ref boolean, grp string, axis string, value double"),
        "parameters": spark.createDataFrame([("w", k, 1.0 if k else float("nan")) for k in range(9)] + [("v", k, float(k)) for k in range(9)], "tensor string, idx int, value double"),
        "probes": spark.createDataFrame([("p", 1, 2)] * 8 + [("q", 1, 1)] * 8, "variant string, before int, after int"),
        "masks": spark.createDataFrame([(k, 50.0 + k) for k in range(9)] + [(9, 1.0)], "cls int, l1 double"),
        "refused": spark.createDataFrame([("m.pkl",)], "artifact string"),
    }
    log, findings, flags = engine.scan(CHECKS, engine.Context(spark, roles, present(roles), budget="DEEP"))
    states = {r["detector_id"]: (r["state"], r["reason"]) for r in log}
    assert len(states) == 23 and not [x for x in states.items() if x[1][0] == "ERROR"]
    assert states["model.strip"][0] == "NOT_RUN" and states["drift.semantic"][0] == "NOT_RUN" and states["data.ood"][0] == "COMPLETED_DEGRADED"
    got = {(r.detector_id, r.subject): r for r in findings.collect()}
    assert ("data.manifest_integrity", "digest mismatch") in got and ("data.manifest_integrity", "missing") in got
    assert got["data.near_duplicate", "contributor:c3"].contributors == ["c3"]
    assert ("data.annotation_geometry", "degenerate:c0") in got and ("data.metadata_anomaly", "time:unparseable") in got and ("data.metadata_anomaly", "burst:c1") in got
    assert ("model.weight_statistics", "nonfinite:w") in got and ("model.blackbox_stress", "p:2") in got and ("model.trigger_reconstruction", "9") in got and ("model.intake", "m.pkl") in got
    assert got["drift.covariate", "axes"].severity in ("LOW", "MEDIUM", "HIGH") and {r[1] for r in got if r[0] == "drift.interpretation"} <= {"drift:operational", "drift:undetermined"}
    hit = {r.sample_id for r in flags.filter("attack_class = 'ood_injection'").collect()}
    assert {5, 9} <= hit and flags.filter(F.col("attack_class") == "duplicate_flood").count() == 14


def test_samples_far_from_a_reference(spark):
    nrg = np.random.default_rng(2)
    frame = lambda x: spark.createDataFrame([(k, "c1" if k < 3 else "c2", "a", v.tolist()) for k, v in enumerate(x)], "sample_id long, contributor string, label string, embedding array<double>")
    x = nrg.normal(size=(60, 6))
    x[:3] += 30
    (check,) = (k for k in CHECKS if k.id == "data.ood")
    run = lambda n: check.run(engine.Context(spark, roles := {"embeddings": frame(x), "reference": frame(nrg.normal(size=(n, 6)))}, present(roles), mode="reference"))
    assert "99" in run(99).abstained
    out = run(500)
    assert [(r.subject, r.severity, r.affected) for r in out.findings.collect()] == [("c1", "HIGH", 3)]
    assert sorted(r.sample_id for r in out.flags.filter("confidence > 0.9").collect()) == [0, 1, 2]


def test_scores_over_all_pairs_are_not_made_again_by_each_reader(spark, sf_dir, monkeypatch):
    made, solve = spark.sparkContext.accumulator(0), pairs._solve

    def counted(k, metric):
        def run(batches):
            for out in solve(k, metric)(batches):
                made.add(out.num_rows)
                yield out

        return run

    monkeypatch.setattr(pairs, "_solve", counted)
    asked = data.b.vectors(spark, sf_dir).filter("vec_id % 4 > 0").count()
    assert data.ood_conformal(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id % 4 > 1").count()
    assert made.value == 5 * asked
    nrg = np.random.default_rng(3)
    e = spark.createDataFrame([(k, "c1", "a", v.tolist()) for k, v in enumerate(nrg.normal(size=(60, 6)))], "sample_id long, contributor string, label string, embedding array<double>")
    (check,) = (k for k in CHECKS if k.id == "data.ood")
    check.run(engine.Context(spark, {"embeddings": e}, present({"embeddings": e}), mode="self")).flags.count()
    assert made.value == 5 * asked + 5 * 60


def test_errors_while_rows_are_computed_stay_with_their_check(spark):
    rows = spark.range(3).withColumnRenamed("id", "sample_id")
    late = lambda c: engine.Frames(rows.withColumn("x", F.raise_error(F.lit("late"))))
    checks = [engine.Check("bad", "DATA", late), engine.Check("after", "DATA", lambda c: engine.Frames(rows), depends_on=("bad",)), engine.Check("good", "DATA", lambda c: engine.Frames(rows))]
    log, findings, _ = engine.scan(checks, engine.Context(spark, {}, frozenset()))
    assert {r["detector_id"]: r["state"] for r in log} == {"bad": "ERROR", "after": "ERROR", "good": "COMPLETED"}
    assert findings.count() == 3 and "late" in next(r["reason"] for r in log if r["detector_id"] == "bad")


def test_a_source_with_an_artifact_is_suspicious(spark):
    nrg = np.random.default_rng(4)
    axes = spark.createDataFrame([(k < 100, "gh"[k % 2], "v", float(nrg.normal())) for k in range(200)], "is_ref boolean, grp string, axis string, value double")
    windows = [(k, k < 100, "gh"[k % 2], p, float(np.exp(0.2 * nrg.normal() + (9 if k >= 100 and k % 4 == 1 and p == 3 else 0)))) for k in range(200) for p in range(5)]
    roles = {"axes": axes, "windows": spark.createDataFrame(windows, "id int, is_ref boolean, grp string, pos int, energy double")}
    (check,) = (k for k in CHECKS if k.id == "drift.interpretation")
    (r,) = check.run(engine.Context(spark, roles, present(roles))).findings.collect()
    assert (r.attack_class, r.subject, r.severity, r.contributors) == ("drift_manipulation", "h", "HIGH", ["h"])


def test_a_blended_pattern_is_flagged(spark):
    rng = np.random.default_rng(6)
    wave = rng.normal(size=64)
    x = rng.normal(size=(150, 64))
    x[:20] = 0.5 * x[:20] + 1.2 * wave
    roles = {"energies": spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(150)], "sample_id long, energies array<double>"), "residuals": spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "sample_id long, residual array<double>")}
    (check,) = (k for k in CHECKS if k.id == "data.trigger_artifact")
    out = check.run(engine.Context(spark, roles, present(roles), params={"data.trigger_artifact": {"blend_similarity": 0.6}}))
    (r,) = out.findings.filter("attack_class = 'blended_trigger'").collect()
    assert (r.subject, r.affected) == ("blend:0", 20)
    assert {f.sample_id for f in out.flags.filter("attack_class = 'blended_trigger'").collect()} == set(range(20))
