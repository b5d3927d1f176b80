import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from proofgrid.operators import interpretation as ip


def judged(groups, material, low, auc, semantic):
    """The rules, source by source."""
    loud = lambda g: g["artifact"] or (g["auc"] or 0.5) >= 0.7
    found = []
    for g in groups:
        signals = [n for n, v in (("artifact", g["artifact"]), ("semantic shift", (g["auc"] or 0.5) >= 0.7), ("class spike", (g["spike"] or 0) >= 0.15)) if v]
        alone = len(groups) >= 2 and not any(loud(o) for o in groups if o is not g)
        if g["artifact"] or (len(signals) >= 2 and alone):
            found.append((-len(signals), g["q"], g["grp"], signals))
    if found:
        n, _, grp, signals = min(found)
        return "suspicious", grp, signals, None, "HIGH", round(min(0.9, 0.45 - 0.15 * n), 9)
    score = (2 + (low >= 0.33) + (auc is not None and not semantic) + (len(groups) >= 2 and all(g["low"] >= 0.33 for g in groups))) / 5
    if not (material or semantic):
        return "none", None, None, None, "INFO", 0.8
    verdict = "content" if semantic and low < 0.33 else "operational" if score >= 0.6 else "undetermined"
    return verdict, None, None, score, "MEDIUM", score


def test_verdicts_against_the_rules(spark):
    rng, seen = random.Random(3), set()
    for k in range(24):
        quiet = k % 2 == 0
        groups = [{"grp": f"g{i}", "low": rng.choice([0.1, 0.5]), "auc": rng.choice([None, 0.55] if quiet else [None, 0.6, 0.8]), "artifact": not quiet and rng.random() < 0.2, "q": rng.random(), "spike": rng.choice([None, 0.05, 0.3])} for i in range(rng.randrange(0, 4))]
        overall = rng.choice([True, False]), rng.choice([0.1, 0.5]), rng.choice([None, 0.6, 0.9]), rng.choice([True, False])
        sources = spark.createDataFrame([(g["grp"], g["low"], g["auc"], g["artifact"], g["q"], g["spike"]) for g in groups], "grp string, low_level double, auc double, artifact boolean, artifact_q double, spike double")
        (r,) = ip.interpret(sources, spark.createDataFrame([overall], "material boolean, low_level double, auc double, semantic boolean")).collect()
        want = judged(groups, *overall)
        assert (r.verdict, r.grp, r.signals, r.score, r.severity, round(r.confidence, 9)) == want, (groups, overall)
        seen.add(r.verdict)
    assert len(seen) >= 4


def test_a_planted_artifact_and_a_spike(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i, (ref, grp) in enumerate(itertools.chain(itertools.repeat((True, None), 200), itertools.repeat((False, "a"), 60), itertools.repeat((False, "b"), 60), itertools.repeat((False, "few"), 5))):
        for pos in range(9):
            hot = grp == "b" and pos == 4 and i % 2 == 0
            rows.append((i, ref, grp, pos, float(np.exp(rng.normal() * 0.3 + (8 if hot else 0)))))
    got = {r.grp: r for r in ip.artifacts(spark.createDataFrame(rows, "id int, is_ref boolean, grp string, pos int, energy double")).collect()}
    assert set(got) == {"a", "b"} and (got["b"].present, got["b"].pos, got["b"].rate) == (True, 4, 0.5) and not got["a"].present
    cls = [(True, None, "xyz"[i % 3]) for i in range(90)] + [(False, "a", "xyz"[i % 3]) for i in range(30)] + [(False, "b", "x" if i % 2 else "yz"[i % 4 // 2]) for i in range(40)] + [(False, "few", "x")] * 3
    got = {r.grp: (r.n, r.spike_class, round(r.spike, 9)) for r in ip.spikes(spark.createDataFrame(cls, "is_ref boolean, grp string, cls string")).collect()}
    assert got["b"] == (40, "x", round(0.5 - 1 / 3, 9)) and got["a"][0] == 30 and abs(got["a"][2]) < 1e-9 and "few" not in got
