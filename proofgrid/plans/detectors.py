"""The checks of a scan, as compositions of the operators over roles.

Roles (all optional): samples (sample_id, label, contributor, batch, digest, timestamp, sensor, source, boxes, width,
height), hashes (sample_id, phash, dhash, phash_flip, dhash_flip), embeddings (sample_id, contributor, label, embedding), reference
(same), axes (is_ref, grp, axis, value), predictions (grp, candidate, reference), overlays (input_id, role, predicted),
parameters and reference_parameters (tensor, idx, value), models and approved (artifact_digest, param_digest),
operators and reference_operators (op), probes (variant, before, after), masks (cls, l1), energies (sample_id, energies),
residuals (sample_id, residual, copy), windows (id, is_ref, grp, pos, energy), predicted (is_ref, grp, cls), refused (artifact), ledger (parsed lines), keys, approved_models. A check whose roles are absent doesn't run.

Every finding has: detector_id, layer, attack_class, subject, severity, confidence, affected, contributors, deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.functions import special
from proofgrid.operators import duplicates
from proofgrid.operators import interpretation as ip
from proofgrid.operators import labels as lb
from proofgrid.operators import ledger as lg
from proofgrid.operators import residuals, shrinkage, triggers
from proofgrid.operators import statistics as st
from proofgrid.operators.activations import split_classes
from proofgrid.operators.components import shared_table
from proofgrid.operators.pairs import nearest
from proofgrid.plans import data, drift, extras, model
from proofgrid.plans.engine import Check, Context, Frames, Mode


def _findings(df: DataFrame, detector: str, layer: str, attack: str | Column, subject: Column, severity: str | Column, confidence: float | Column, affected: Column, contributors: Column | None = None, deterministic: bool = True) -> DataFrame:
    text = lambda v: F.lit(v) if isinstance(v, str) else v
    return df.select(
        F.lit(detector).alias("detector_id"), F.lit(layer).alias("layer"), text(attack).alias("attack_class"), subject.cast("string").alias("subject"), text(severity).alias("severity"), (confidence if isinstance(confidence, Column) else F.lit(float(confidence))).alias("confidence"),
        affected.cast("long").alias("affected"), (contributors if contributors is not None else F.array()).cast("array<string>").alias("contributors"), F.lit(deterministic).alias("deterministic"),
    )


def _flags(df: DataFrame, attack: str, severity: str, confidence: float) -> DataFrame:
    return df.select("sample_id", F.lit(attack).alias("attack_class"), F.lit(confidence).alias("confidence"), F.lit(severity).alias("severity"))


def manifest_integrity(c: Context) -> Frames:
    s = c.roles["samples"]
    kind = F.when(F.col("error_kind") == "missing", "missing").when(F.col("error_kind") == "unsafe", "unsafe path").when(F.col("declared_digest").isNotNull() & (F.lower("declared_digest") != F.lower("digest")), "digest mismatch")
    bad = s.withColumn("kind", kind).filter("kind IS NOT NULL")
    groups = bad.groupBy("kind").agg(F.count("*").alias("n"), F.collect_set("contributor").alias("who"))
    return Frames(_findings(groups, "data.manifest_integrity", "DATA", "corrupted_samples", F.col("kind"), "HIGH", 1.0, F.col("n"), F.col("who")), _flags(bad, "corrupted_samples", "HIGH", 1.0))


def _duplicates(c: Context, max_phash: int, max_dhash: int, min_cosine: float) -> DataFrame:
    """(node, component) by both hashes, confirmed by cosine where there are embeddings."""
    rows, vector = c.roles["hashes"], None
    if "embeddings" in c.roles:
        rows, vector = rows.join(c.roles["embeddings"].select("sample_id", "embedding"), "sample_id", "left"), "embedding"
    return duplicates.components(rows, vector, max_phash=max_phash, max_dhash=max_dhash, min_cosine=min_cosine)


def near_duplicate(c: Context) -> Frames:
    p = c.params.get("data.near_duplicate", {})
    comp = _duplicates(c, p.get("max_phash", 8), p.get("max_dhash", 10), p.get("min_cosine", 0.9))
    rows = c.roles["samples"].join(comp, F.col("sample_id") == F.col("node"), "left").drop("node")
    first = rows.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.coalesce(F.col("timestamp").cast("string"), F.lit("")).alias("t"), "sample_id")).alias("f"), F.count("*").alias("size"), F.collect_set("contributor").alias("who"))
    rows = rows.join(first, "component", "left").withColumn("redundant", F.col("component").isNotNull() & (F.col("sample_id") != F.col("f.sample_id")))
    least = p.get("min_cluster", 5)
    clusters = _findings(first.filter(F.col("size") >= least), "data.near_duplicate", "DATA", "duplicate_flood", F.concat(F.lit("cluster:"), F.col("component").cast("string")), F.when(F.col("size") >= 2 * least, "HIGH").otherwise("MEDIUM"), 0.9, F.col("size"), F.col("who"))
    tests = data.redundancy_tests(rows).filter((F.col("q") < 0.01) & (F.col("r") >= 5) & (F.col("ratio") >= 3))
    who = _findings(tests, "data.near_duplicate", "DATA", "duplicate_flood", F.concat(F.lit("contributor:"), F.col("contributor")), "HIGH", 0.9, F.col("r"), F.array("contributor"))
    return Frames(clusters.unionByName(who), _flags(rows.filter("redundant"), "duplicate_flood", "MEDIUM", 0.9))


def duplicate_label_conflict(c: Context) -> Frames:
    p = c.params.get("data.duplicate_label_conflict", {})
    comp = _duplicates(c, p.get("max_phash", 6), p.get("max_dhash", 8), p.get("min_cosine", 0.95))
    rows = c.roles["samples"].join(comp, F.col("sample_id") == F.col("node")).filter("label IS NOT NULL")
    n = rows.groupBy("component", "label").agg(F.count("*").alias("n"))
    top = n.groupBy("component").agg(F.max("n").alias("top"), F.count("*").alias("labels"), F.sum("n").alias("size")).filter("labels > 1")
    tied = n.join(top, "component").filter("n = top").groupBy("component").agg(F.count("*").alias("ties"), F.min("label").alias("majority"))
    minority = rows.join(top, "component").join(tied, "component").filter((F.col("ties") > 1) | (F.col("label") != F.col("majority")))
    return Frames(_findings(top, "data.duplicate_label_conflict", "DATA", "duplicate_label_conflict", F.col("component"), "MEDIUM", 0.9, F.col("size")), _flags(minority, "duplicate_label_conflict", "MEDIUM", 0.8))


def ood(c: Context) -> Frames:
    """Distances to the nearest neighbours; with a reference also the shrunk Mahalanobis distance, which corroborates."""
    e, reference, p = c.roles["embeddings"], c.roles.get("reference"), c.params.get("data.ood", {})
    alpha = p.get("alpha", 0.01)
    # written once: scores are read several times, and all pairs are behind them
    mean_of_five = lambda q, base: shared_table(nearest(q, base, "sample_id", "embedding", 5).groupBy(F.col("query").alias("sample_id")).agg(F.avg("distance").alias("score")))
    if c.mode == "reference":
        if (n := reference.count()) < p.get("min_reference", 100):
            return Frames(abstained=f"the reference has {n} samples")
        half = F.pmod(F.xxhash64("sample_id"), F.lit(2))
        base, held = reference.filter(half == 0), reference.filter(half == 1)
        out = st.bh_qvalues_of_rows(extras.tail_pvalues(mean_of_five(held, base), mean_of_five(e, base), "score"), "p")
        model = shrinkage.fit(base, "embedding", p.get("pca_dims", 32))
        far = lambda q: shrinkage.distances(model, q, "sample_id", "embedding").withColumnRenamed("distance", "score")
        second = extras.tail_pvalues(far(held), far(e), "score").select("sample_id", (F.col("p") <= alpha).alias("both"))
        out = out.join(second, "sample_id", "left")
    else:
        own = mean_of_five(e, e).withColumn("score", F.log(F.col("score") + 1e-12)).withColumn("_all", F.lit(1))
        out = st.bh_qvalues_of_rows(st.robust_z(own, "score", ["_all"]).withColumn("p", special.normal_tail("z")), "p").withColumn("both", F.lit(None).cast("boolean"))
    hit = out.filter(F.col("q") < alpha).join(e.select("sample_id", "contributor"), "sample_id")
    sure = F.coalesce("both", F.lit(False)) & (F.col("q") < 1e-4)
    hit = hit.withColumn("severity", F.when(sure, "HIGH").otherwise("MEDIUM")).withColumn("confidence", F.least(F.lit(0.99), 1 - F.col("q")) * F.when(~F.col("both"), 0.85).otherwise(1.0))
    groups = hit.groupBy("contributor").agg(F.count("*").alias("n"), F.min("severity").alias("severity"))  # HIGH sorts before MEDIUM
    flags = hit.select("sample_id", F.lit("ood_injection").alias("attack_class"), "confidence", "severity")
    return Frames(_findings(groups, "data.ood", "DATA", "ood_injection", F.coalesce("contributor", F.lit("unattributed")), F.col("severity"), 0.7, F.col("n"), F.array("contributor"), False), flags)


def label_consistency(c: Context) -> Frames:
    e = c.roles["embeddings"]
    near = nearest(e, e, "sample_id", "embedding", 10, "cosine")
    mine = e.select(F.col("sample_id").alias("query"), F.col("label").alias("mine"))
    agree = near.join(mine, "query").join(e.select(F.col("sample_id").alias("neighbour"), "label"), "neighbour").groupBy(F.col("query").alias("sample_id")).agg(F.avg((F.col("label") == F.col("mine")).cast("int")).alias("agreement"))
    predicted = lb.label_model(e)
    bad = lb.inconsistent(predicted, agree, *((0.85, 0.1) if c.mode == "descriptor" else (0.6, 0.3)))
    groups = bad.groupBy("declared").agg(F.count("*").alias("n"), F.collect_set("contributor").alias("who"))
    return Frames(_findings(groups, "data.label_consistency", "DATA", "label_flip", F.col("declared"), "MEDIUM", 0.7, F.col("n"), F.col("who"), False), _flags(bad, "label_flip", "MEDIUM", 0.7), {"model": predicted})


def systematic_mislabel(c: Context) -> Frames:
    rows = c.upstream["data.label_consistency"].metrics["model"]
    if (seen := c.upstream.get("data.ood")) is not None and seen.flags is not None:  # foreign content isn't relabelled content
        rows = rows.join(seen.flags.select("sample_id", F.lit(True).alias("foreign")).distinct(), "sample_id", "left")
    else:
        rows = rows.withColumn("foreign", F.lit(None).cast("boolean"))
    inferred = F.when((F.col("p_predicted") >= 0.6) & F.col("foreign").isNull(), F.col("predicted"))
    tests = st.bh_qvalues(data.transition_tests(rows.select("contributor", "declared", inferred.alias("inferred")).filter("contributor IS NOT NULL")), "p")
    hit = tests.filter((F.col("q") < 0.01) & (F.col("k") >= 5) & (F.col("k") / F.col("n") / F.col("p0") >= (5 if c.mode == "descriptor" else 3)))
    return Frames(_findings(hit, "data.systematic_mislabel", "DATA", "systematic_mislabel", F.concat_ws(":", "contributor", "declared", "inferred"), "HIGH", 0.9, F.col("k"), F.array("contributor"), False))


def annotation_geometry(c: Context) -> Frames:
    b = c.roles["samples"].select("sample_id", F.coalesce("contributor", F.lit("unattributed")).alias("contributor"), "width", "height", F.explode("boxes").alias("b"))
    v = [F.col(f"b.{k}") for k in "xywh"]
    rows = b.withColumn("kind", data.box_kind(*v, F.col("width"), F.col("height")))
    hard = rows.filter("kind IS NOT NULL").groupBy("kind", "contributor").agg(F.count("*").alias("n"))
    found = _findings(hard, "data.annotation_geometry", "DATA", "annotation_tampering", F.concat_ws(":", "kind", "contributor"), F.when(F.col("kind").isin("degenerate", "outside", "unparseable"), "MEDIUM").otherwise("LOW"), 0.9, F.col("n"), F.array("contributor"))
    ok = rows.filter("(kind IS NULL OR kind IN ('tiny', 'giant', 'clipped')) AND width > 0 AND height > 0 AND b.w > 0 AND b.h > 0").withColumn("category", F.col("b.category")).withColumn("area", F.log(F.col("b.w") * F.col("b.h") / F.col("width") / F.col("height")))
    many = ok.groupBy("category").count().filter("count >= 15").select("category")
    far = st.robust_z(ok.join(many, "category").select("sample_id", "category", "area"), "area", ["category"]).filter(F.abs("z") > 3.5)
    size = _findings(far.groupBy("category").agg(F.count("*").alias("n")), "data.annotation_geometry", "DATA", "annotation_tampering", F.concat(F.lit("size:"), F.col("category")), "LOW", 0.6, F.col("n"), None, False)
    return Frames(found.unionByName(size), _flags(rows.filter("kind IS NOT NULL").select("sample_id").distinct(), "annotation_tampering", "MEDIUM", 0.8))


def metadata_anomaly(c: Context) -> Frames:
    s = c.roles["samples"].filter("timestamp IS NOT NULL")
    kinds = data.timestamp_kinds(s, "timestamp", F.current_timestamp()).filter("kind <> 'ok'")
    found = _findings(kinds.groupBy("kind").agg(F.count("*").alias("n"), F.collect_set("contributor").alias("who")), "data.metadata_anomaly", "DATA", "metadata_manipulation", F.concat(F.lit("time:"), F.col("kind")), F.when(F.col("kind") == "unparseable", "LOW").otherwise("MEDIUM"), 0.8, F.col("n"), F.col("who"), False)
    p = c.params.get("data.metadata_anomaly", {})
    at = s.withColumn("at", F.try_to_timestamp(F.col("timestamp").cast("string"))).filter("at IS NOT NULL").withColumn("who", F.coalesce("contributor", F.lit("unattributed")))
    w = data.burst_windows(at, "who", "at", "sample_id", p.get("window", 300), p.get("least", 12))
    hit = w.filter((F.col("count") >= p.get("least", 12)) & (F.col("p") < p.get("alpha", 1e-4) / F.col("n")))
    burst = _findings(hit.groupBy("who").agg(F.max("count").alias("n")), "data.metadata_anomaly", "DATA", "metadata_manipulation", F.concat(F.lit("burst:"), F.col("who")), "MEDIUM", 0.7, F.col("n"), F.array("who"), False)
    return Frames(found.unionByName(burst), _flags(kinds, "metadata_manipulation", "MEDIUM", 0.8).unionByName(_flags(hit, "metadata_manipulation", "MEDIUM", 0.7)))


def trigger_artifact(c: Context) -> Frames:
    """Windows that are hot at one place in many images, and, with the role residuals, groups that share a faint pattern; who is
    in the former isn't counted for the latter."""
    e, p = c.roles["energies"], c.params.get("data.trigger_artifact", {})
    size = e.agg(F.count("*").alias("n"), F.max(F.size("energies")).alias("m")).first()
    hot = triggers.hot_windows(e)
    places = triggers.persistent_positions(hot, size.n, size.m)
    members = hot.join(places, "position").select("sample_id").distinct()
    found = _findings(places, "data.trigger_artifact", "DATA", "localized_trigger", F.concat(F.lit("window:"), F.col("position").cast("string")), "HIGH", 0.8, F.col("k"), None, False)
    flags = _flags(members, "localized_trigger", "HIGH", 0.8)
    if "residuals" in c.roles:
        rest = c.roles["residuals"].join(members, "sample_id", "left_anti")
        units = residuals.centred(rest, "residual", "sample_id", "copy" if "copy" in rest.columns else None)
        groups, own = residuals.groups(units, p.get("blend_similarity", 0.3), p.get("min_members", 6), p.get("blend_max_fraction", 0.4))
        found = found.unionByName(_findings(groups, "data.trigger_artifact", "DATA", "blended_trigger", F.concat(F.lit("blend:"), F.col("component").cast("string")), "HIGH", 0.7, F.col("n"), None, False))
        flags = flags.unionByName(_flags(own.withColumnRenamed("id", "sample_id"), "blended_trigger", "HIGH", 0.7))
    return Frames(found, flags)


def model_intake(c: Context) -> Frames:
    return Frames(_findings(c.roles["refused"], "model.intake", "MODEL", "malicious_artifact", F.col("artifact"), "HIGH", 1.0, F.lit(1)))


def artifact_digest(c: Context) -> Frames:
    m = model.digest_state(c.roles["models"], c.roles["approved"])
    severity = F.when(F.col("state") == "approved", "INFO").when(F.col("state") == "reserialised", "MEDIUM").otherwise("HIGH")
    return Frames(_findings(m, "model.artifact_digest", "MODEL", "model_substitution", F.col("artifact_digest"), severity, 1.0, F.lit(1)))


def architecture(c: Context) -> Frames:
    a, z = c.roles["reference_operators"].select("op"), c.roles["operators"].select("op")
    d = a.exceptAll(z).select(F.lit("removed").alias("k"), "op").unionByName(z.exceptAll(a).select(F.lit("added").alias("k"), "op")).groupBy("k", "op").agg(F.count("*").alias("n"))
    return Frames(_findings(d, "model.architecture", "MODEL", "model_graph_modification", F.concat_ws(":", "k", "op"), "HIGH", 1.0, F.col("n")))


def weight_statistics(c: Context) -> Frames:
    p = c.roles["parameters"]
    broken = F.isnan("value") | (F.abs("value") == float("inf"))
    s = p.groupBy("tensor").agg(F.count_if(broken).alias("nonfinite"), F.max(F.when(~broken, F.abs("value"))).alias("top"), F.count("*").alias("n"), F.stddev_pop(F.when(~broken, F.col("value"))).alias("sd"))
    kind = F.when(F.col("nonfinite") > 0, "nonfinite").when(F.col("top") > 1e4, "huge").when((F.col("sd") == 0) & (F.col("n") > 1) & ~F.contains("tensor", F.lit("bias")), "constant")
    out = _findings(s.withColumn("kind", kind).filter("kind IS NOT NULL"), "model.weight_statistics", "MODEL", "model_corruption", F.concat_ws(":", "kind", "tensor"), "HIGH", 1.0, F.col("n"))
    if "reference_parameters" in c.roles:
        w = model.weight_changes(c.roles["reference_parameters"], p).filter("state <> 'same'")
        out = out.unionByName(_findings(w, "model.weight_statistics", "MODEL", "model_weight_tampering", F.concat_ws(":", "state", "tensor"), "MEDIUM", 1.0, F.lit(1)))
    return Frames(out)


def behaviour_fingerprint(c: Context) -> Frames:
    g = model.behaviour(c.roles["predictions"]).filter("max_jsd > 1e-6")
    high = (F.col("agreement") < 0.9) | (F.col("mean_jsd") > 0.05)
    return Frames(_findings(g, "model.behaviour_fingerprint", "MODEL", "behavioural_divergence", F.col("grp"), F.when(high, "HIGH").otherwise("MEDIUM"), 0.9, F.col("n")))


def blackbox_stress(c: Context) -> Frames:
    r = model.redirection(c.roles["probes"])
    if "reference_probes" in c.roles:
        base = model.redirection(c.roles["reference_probes"]).select("variant", F.col("share").alias("base"))
        r = r.join(base, "variant", "left").fillna({"base": 0.0}).filter((F.col("share") - F.col("base") >= 0.25) & (F.col("share") >= 2 * F.greatest("base", F.lit(0.05))))
    else:
        r = r.filter("share >= 0.5")
    return Frames(_findings(r, "model.blackbox_stress", "MODEL", "model_backdoor_patch", F.concat_ws(":", F.col("variant").cast("string"), F.col("cls").cast("string")), "HIGH", 0.7, F.col("n"), None, False))


def strip(c: Context) -> Frames:
    low = model.strip(c.roles["overlays"]).filter("p < 0.01")
    return Frames(_findings(low, "model.strip", "MODEL", "runtime_trigger_input", F.col("input_id"), "MEDIUM", 0.7, F.lit(1), None, False))


def activation_analysis(c: Context) -> Frames:
    s = split_classes(c.roles["embeddings"].select(F.col("label").alias("cls"), F.col("sample_id").alias("vec_id"), "embedding")).filter("silhouette >= 0.25 AND minority BETWEEN 0.04 AND 0.35")
    return Frames(_findings(s, "model.activation_analysis", "MODEL", "model_backdoor_patch", F.col("cls"), "MEDIUM", 0.6, F.round(F.col("minority") * F.col("n")), None, False))


def trigger_reconstruction(c: Context) -> Frames:
    m = c.roles["masks"].select("cls", F.log("l1").alias("l")).withColumn("_all", F.lit(1))
    low = st.robust_z(m, "l", ["_all"]).filter("-z > 2")
    return Frames(_findings(low, "model.trigger_reconstruction", "MODEL", "model_backdoor_patch", F.col("cls"), "HIGH", 0.7, F.lit(1), None, False))


def ledger_integrity(c: Context) -> Frames:
    v = lg.verify(c.roles["ledger"])
    bad = v.filter("status = 'FAILED'").select("ledger_file", F.explode("classes").alias("class")).groupBy("ledger_file", "class").agg(F.count("*").alias("n"))
    ok = v.groupBy("ledger_file").agg(F.count("*").alias("n"), F.count_if(F.col("status") != "VALID").alias("bad")).filter("bad = 0")
    out = _findings(bad, "provenance.ledger_integrity", "PROVENANCE", F.col("class"), F.concat_ws(":", "ledger_file", "class"), "HIGH", 1.0, F.col("n"))
    return Frames(out.unionByName(_findings(ok, "provenance.ledger_integrity", "PROVENANCE", "record_modification", F.col("ledger_file"), "INFO", 1.0, F.col("n"))), None, {"verified": v})


def binding(c: Context) -> Frames:
    b = lg.bindings(c.roles["ledger"], c.roles["approved_models"]).groupBy("ledger", "class").agg(F.count("*").alias("n"))
    return Frames(_findings(b, "provenance.binding", "PROVENANCE", F.col("class"), F.concat_ws(":", "ledger", "class"), "HIGH", 1.0, F.col("n")))


def drift_covariate(c: Context) -> Frames:
    r = drift.compare_axes(c.roles["axes"])
    s = drift.severity(r)
    return Frames(_findings(s, "drift.covariate", "DRIFT", "operational_drift", F.lit("axes"), F.col("severity"), 0.8, F.col("material"), None, False), None, {"axes": r})


def drift_semantic(c: Context) -> Frames:
    e, ref = c.roles["embeddings"], c.roles["reference"]
    m = drift.mmd_test(ref, e, "sample_id", "embedding").crossJoin(drift.c2st(ref.select("sample_id", "embedding"), e.select("sample_id", "embedding"), "sample_id", "embedding"))  # one row each
    severity = F.when((F.col("p") < 0.01) & (F.col("auc") >= 0.8), "HIGH").when((F.col("p") < 0.01) & (F.col("auc") >= 0.65), "MEDIUM").otherwise("INFO")
    return Frames(_findings(m, "drift.semantic", "DRIFT", "semantic_drift", F.lit("embedding"), severity, 0.8, F.lit(0), None, False))


def drift_interpretation(c: Context) -> Frames:
    """The verdict over all sources. Roles windows and predicted bring artifacts and class spikes of each source; the axes
    alone can tell an operational shift from none."""
    axes = c.roles["axes"]
    moved = (F.col("q") < 0.01) & (F.abs("delta") >= 0.147)
    nothing = F.lit(None).cast("double")
    overall = drift.compare_axes(axes).agg(F.coalesce(F.max(moved), F.lit(False)).alias("material"), F.coalesce(F.max(F.when(moved, F.abs("delta"))), F.lit(0.0)).alias("low_level"), nothing.alias("auc"), F.lit(False).alias("semantic"))
    sources = drift.compare_axes(axes, ["grp", "axis"]).groupBy("grp").agg(F.max(F.abs("delta")).alias("low_level")).withColumn("auc", nothing)
    if "windows" in c.roles:
        sources = sources.join(ip.artifacts(c.roles["windows"]).select("grp", F.col("present").alias("artifact"), F.col("q").alias("artifact_q")), "grp", "left")
    else:
        sources = sources.withColumn("artifact", F.lit(False)).withColumn("artifact_q", nothing)
    sources = sources.join(ip.spikes(c.roles["predicted"]).select("grp", "spike"), "grp", "left") if "predicted" in c.roles else sources.withColumn("spike", nothing)
    sources = sources.withColumn("artifact", F.coalesce("artifact", F.lit(False))).withColumn("artifact_q", F.coalesce("artifact_q", F.lit(1.0)))
    one = ip.interpret(sources, overall)
    kind = F.when(F.col("verdict") == "suspicious", "drift_manipulation").when(F.col("verdict") == "content", "semantic_drift").otherwise("operational_drift")
    subject = F.coalesce(F.col("grp").cast("string"), F.concat(F.lit("drift:"), "verdict"))
    return Frames(_findings(one, "drift.interpretation", "DRIFT", kind, subject, F.col("severity"), F.col("confidence"), F.lit(0), F.array_compact(F.array(F.col("grp").cast("string"))), False), None, {"verdict": one})


CHECKS = [
    Check("data.manifest_integrity", "DATA", manifest_integrity, ("samples", "samples.digest"), supports={"corrupted_samples": "FULL"}),
    Check("data.near_duplicate", "DATA", near_duplicate, ("samples", "hashes"), supports={"duplicate_flood": "FULL"}),
    Check("data.duplicate_label_conflict", "DATA", duplicate_label_conflict, ("samples", "hashes", "samples.label"), supports={"duplicate_label_conflict": "FULL"}),
    Check("data.ood", "DATA", ood, ("embeddings",), modes=(Mode("reference", ("reference",)), Mode("self", degraded=True)), supports={"ood_injection": "FULL"}),
    Check("data.label_consistency", "DATA", label_consistency, ("embeddings", "embeddings.label"), modes=(Mode("model", ("embeddings.semantic",)), Mode("descriptor", degraded=True)), supports={"label_flip": "FULL"}),
    Check("data.systematic_mislabel", "DATA", systematic_mislabel, ("embeddings", "embeddings.contributor"), modes=(Mode("model", ("embeddings.semantic",)), Mode("descriptor", degraded=True)), depends_on=("data.label_consistency",), supports={"systematic_mislabel": "FULL"}),
    Check("data.annotation_geometry", "DATA", annotation_geometry, ("samples", "samples.boxes"), supports={"annotation_tampering": "FULL"}),
    Check("data.metadata_anomaly", "DATA", metadata_anomaly, ("samples", "samples.timestamp"), supports={"metadata_manipulation": "FULL"}),
    Check("data.trigger_artifact", "DATA", trigger_artifact, ("energies",), supports={"localized_trigger": "FULL", "blended_trigger": "PARTIAL"}),
    Check("model.intake", "MODEL", model_intake, ("refused",), supports={"malicious_artifact": "FULL"}),
    Check("model.artifact_digest", "MODEL", artifact_digest, ("models", "approved"), supports={"model_substitution": "FULL"}),
    Check("model.architecture", "MODEL", architecture, ("operators", "reference_operators"), supports={"model_graph_modification": "FULL"}),
    Check("model.weight_statistics", "MODEL", weight_statistics, ("parameters",), supports={"model_corruption": "FULL", "model_weight_tampering": "PARTIAL"}),
    Check("model.behaviour_fingerprint", "MODEL", behaviour_fingerprint, ("predictions",), supports={"behavioural_divergence": "FULL"}),
    Check("model.blackbox_stress", "MODEL", blackbox_stress, ("probes",), supports={"model_backdoor_patch": "PARTIAL"}, budget="STANDARD"),
    Check("model.strip", "MODEL", strip, ("overlays",), supports={"runtime_trigger_input": "FULL"}, budget="STANDARD"),
    Check("model.activation_analysis", "MODEL", activation_analysis, ("embeddings", "embeddings.label"), supports={"model_backdoor_patch": "PARTIAL"}, budget="STANDARD"),
    Check("model.trigger_reconstruction", "MODEL", trigger_reconstruction, ("masks",), supports={"model_backdoor_patch": "PARTIAL"}, budget="DEEP"),
    Check("provenance.ledger_integrity", "PROVENANCE", ledger_integrity, ("ledger",), supports={"record_modification": "FULL", "record_deletion": "FULL", "record_reorder": "FULL", "record_replay": "FULL", "signature_forgery": "FULL"}),
    Check("provenance.binding", "PROVENANCE", binding, ("ledger", "approved_models"), supports={"model_binding_violation": "FULL", "config_binding_violation": "FULL"}),
    Check("drift.covariate", "DRIFT", drift_covariate, ("axes",), supports={"operational_drift": "FULL"}),
    Check("drift.semantic", "DRIFT", drift_semantic, ("embeddings", "reference"), supports={"semantic_drift": "FULL"}, budget="STANDARD"),
    Check("drift.interpretation", "DRIFT", drift_interpretation, ("axes", "axes.grp"), depends_on=("drift.covariate",), supports={"drift_manipulation": "PARTIAL"}),
]


def present(roles: dict[str, DataFrame]) -> frozenset[str]:
    """Capabilities: the roles that are there, and their columns that hold a value."""
    out = set(roles)
    for name, df in roles.items():
        row = df.agg(*(F.max(F.col(c).isNotNull()).alias(c) for c in df.columns)).first()
        out |= {f"{name}.{c}" for c in df.columns if row[c]}
    return frozenset(out)
