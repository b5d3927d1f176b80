"""From flags and findings to contributor risk, dispositions and coverage."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.functions import special
from proofgrid.functions.columns import DISPOSITIONS, SEVERITIES, name_of, rank_of

# Severity weights, names of signals, classes that count as campaigns or provenance failures, caps.
SEVERITY_WEIGHTS = (0.0, 0.5, 0.75, 1.0, 1.0)
SIGNALS = {
    "label_flip": "label inconsistency", "systematic_mislabel": "systematic label inconsistency",
    "duplicate_flood": "duplicate flooding", "duplicate_label_conflict": "conflicting duplicate labels",
    "localized_trigger": "trigger-pattern correlation", "blended_trigger": "blended-pattern correlation",
    "ood_injection": "out-of-distribution content", "annotation_tampering": "annotation geometry",
    "metadata_manipulation": "metadata anomalies", "corrupted_samples": "corrupted files",
}
CAMPAIGNS = ("systematic_mislabel", "duplicate_flood", "localized_trigger", "blended_trigger", "duplicate_label_conflict", "annotation_tampering", "ood_injection")
PROVENANCE_FAILURES = ("record_modification", "record_deletion", "record_reorder", "record_replay", "record_truncation", "signature_forgery", "model_binding_violation", "input_substitution", "config_binding_violation")
MIN_CAMPAIGN = 3
DEGRADED_CAP = 0.85
MIN_MANIPULATION_SIGNALS = 3


@dataclass(frozen=True)
class Rule:
    """A conjunction of optional conditions, and what follows."""

    id: str
    disposition: str
    attack_classes: tuple[str, ...] | None = None
    layers: tuple[str, ...] | None = None
    detectors: tuple[str, ...] | None = None
    availability: tuple[str, ...] | None = None
    tags: dict[str, str] = field(default_factory=dict)
    deterministic: bool | None = None
    calibrated: bool | None = None
    min_severity: str | None = None
    max_severity: str | None = None
    min_confidence: float | None = None
    max_confidence: float | None = None
    min_corroboration: int | None = None
    severity: str | None = None
    floor: str | None = None
    ceiling: str | None = None

    def matches(self) -> Column:
        rank = rank_of(F.col("severity"))
        out = F.lit(True)
        for column, values in (("attack_class", self.attack_classes), ("layer", self.layers), ("detector_id", self.detectors), ("availability", self.availability)):
            if values is not None:
                out &= F.col(column).isin(*values)
        for k, v in self.tags.items():
            out &= F.coalesce(F.try_element_at("tags", F.lit(k)) == v, F.lit(False))
        for column, value in (("deterministic", self.deterministic), ("calibrated", self.calibrated)):
            if value is not None:
                out &= F.col(column) == value
        if self.min_severity:
            out &= rank >= SEVERITIES.index(self.min_severity)
        if self.max_severity:
            out &= rank <= SEVERITIES.index(self.max_severity)
        if self.min_confidence is not None:
            out &= F.col("confidence") >= self.min_confidence
        if self.max_confidence is not None:
            out &= F.col("confidence") <= self.max_confidence
        if self.min_corroboration is not None:
            out &= F.size("signals") >= self.min_corroboration
        return out


# The baseline policy, first match wins.
BASELINE = (
    Rule("provenance.verified", "ACCEPT", layers=("PROVENANCE",), max_severity="INFO"),
    Rule("provenance.failure", "QUARANTINE", layers=("PROVENANCE",), deterministic=True, min_severity="HIGH", severity="CRITICAL"),
    Rule("model.malicious-artifact", "QUARANTINE", attack_classes=("malicious_artifact",), severity="CRITICAL"),
    Rule("model.approved-match", "ACCEPT", attack_classes=("model_substitution",), max_severity="INFO"),
    Rule("model.identity-and-behaviour", "QUARANTINE", attack_classes=("behavioural_divergence",), min_corroboration=1, min_severity="HIGH", severity="CRITICAL"),
    Rule("model.reserialized", "REVIEW", attack_classes=("model_substitution",), tags={"parameters": "identical"}, ceiling="MEDIUM"),
    Rule("model.unapproved-artifact", "QUARANTINE", attack_classes=("model_substitution",), deterministic=True, floor="HIGH"),
    Rule("model.graph-modified", "QUARANTINE", attack_classes=("model_graph_modification",), deterministic=True, min_severity="HIGH"),
    Rule("model.corruption", "QUARANTINE", attack_classes=("model_corruption",), min_severity="HIGH"),
    Rule("data.corrupted-files", "QUARANTINE", attack_classes=("corrupted_samples",), deterministic=True, min_severity="HIGH"),
    Rule("metadata.review", "REVIEW", attack_classes=("metadata_manipulation",), ceiling="MEDIUM"),
    Rule("drift.review", "REVIEW", layers=("DRIFT",), min_severity="LOW"),
    Rule("ood.review", "REVIEW", attack_classes=("ood_injection",), min_severity="LOW"),
    Rule("corroborated.high", "QUARANTINE", min_severity="HIGH", min_confidence=0.85, min_corroboration=2),
    Rule("high.review", "REVIEW", min_severity="HIGH"),
    Rule("medium.review", "REVIEW", min_severity="MEDIUM"),
    Rule("low.accept", "ACCEPT", max_severity="LOW"),
)


def decide(findings: DataFrame, rules: tuple[Rule, ...] = BASELINE, default: str = "REVIEW") -> DataFrame:
    """``findings`` with rule_id, decided_severity, disposition, decided_confidence and guardrails.

    Needs attack_class, layer, detector_id, availability, tags, deterministic, calibrated, severity, confidence, signals.
    """
    number = F.lit(0)
    for k, r in reversed(list(enumerate(rules, 1))):
        number = F.when(r.matches(), k).otherwise(number)
    # what follows from a rule is looked up by its number, so the conditions stand in the plan once
    look = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("_rule") + 1)
    bound = lambda f, without: look([without, *(without if f(r) is None else SEVERITIES.index(f(r)) for r in rules)])
    severity = F.coalesce(F.nullif(bound(lambda r: r.severity, -1), F.lit(-1)), rank_of(F.col("severity")))
    severity = F.least(F.greatest(severity, bound(lambda r: r.floor, 0)), bound(lambda r: r.ceiling, 4))
    out = findings.withColumn("_rule", number).withColumn("rule_id", look(["default", *(r.id for r in rules)])).withColumn("_rank", severity).withColumn("disposition", look([default, *(r.disposition for r in rules)]))
    quarantined, rank = F.col("disposition") == "QUARANTINE", F.col("_rank")
    failure = (F.col("layer") == "PROVENANCE") & F.col("deterministic") & F.col("attack_class").isin(*PROVENANCE_FAILURES) & (rank_of(F.col("severity")) >= 3)
    raised = failure & ~quarantined  # G1: failed cryptographic checks are quarantined
    capped = [  # each caps a quarantine at REVIEW, the first that applies is the one that is named
        ("G2", ~F.col("deterministic") & ~F.col("calibrated")),
        ("G3", F.col("attack_class") == "metadata_manipulation"),
        ("G4", (F.col("attack_class") == "drift_manipulation") & (F.size("signals") < MIN_MANIPULATION_SIGNALS)),
        ("G6", (rank == 0) & ~raised),
    ]
    cap = F.lit(None).cast("string")
    for name, when in reversed(capped):
        cap = F.when(when, name).otherwise(cap)
    out = out.withColumn("_raised", F.coalesce(raised, F.lit(False)))
    out = out.withColumn("_cap", F.when(F.col("_raised") | quarantined, cap))
    degraded = (F.col("availability") == "DEGRADED") & (F.col("confidence") > DEGRADED_CAP)
    notes = F.array_compact(F.array(F.when(F.col("_raised"), "G1"), F.when(F.col("_cap") != "G6", F.col("_cap")), F.when(degraded, "G5"), F.when(F.col("_cap") == "G6", "G6")))
    disposition = F.when(F.col("_cap").isNotNull(), "REVIEW").when(F.col("_raised"), "QUARANTINE").otherwise(F.col("disposition"))
    severity = name_of(F.when(F.col("_raised"), F.lit(4)).otherwise(rank))
    confidence = F.round(F.when(degraded, DEGRADED_CAP).otherwise(F.col("confidence")), 4)
    return out.withColumns({"decided_severity": severity, "decided_confidence": confidence, "guardrails": notes, "disposition": disposition}).drop("_rank", "_rule", "_raised", "_cap")


def flag_weights(flags: DataFrame, min_confidence: float = 0.5, min_severity: str = "LOW") -> DataFrame:
    """(sample_id, attack_class, weight): the greatest weight of the flags that count."""
    rank = rank_of(F.col("severity"))
    weight = F.least(F.lit(1.0), F.col("confidence") * F.element_at(F.array(*map(F.lit, SEVERITY_WEIGHTS)), rank + 1))
    kept = flags.filter((F.col("confidence") >= min_confidence) & (rank >= SEVERITIES.index(min_severity)))
    return kept.groupBy("sample_id", "attack_class").agg(F.max(weight).alias("weight"))


def contributor_totals(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """(contributor, n, flagged, mass, rate) of attributed samples."""
    own = weights.groupBy("sample_id").agg(F.max("weight").alias("weight"))
    rows = samples.filter(F.col("contributor").isNotNull() & (F.col("contributor") != "")).join(own, "sample_id", "left").fillna({"weight": 0.0})
    out = rows.groupBy("contributor").agg(F.count("*").alias("n"), F.sum((F.col("weight") > 0).cast("long")).alias("flagged"), F.sum("weight").alias("mass"))
    return out.withColumn("rate", (F.col("mass") + 0.5) / (F.col("n") + 1))


def leave_one_out_median(df: DataFrame, value: str, key: str, out: str = "baseline") -> DataFrame:
    """``df`` (one row for each key) with the median of the other rows' values, from ranks alone.

    Without row r, the value at rank k of the rest is the one at k, or at k + 1 if r stands at or before k.
    """
    # one row for each contributor: a single window over them is small, and four of its values are all it takes
    ranked = df.withColumn("_i", F.row_number().over(Window.orderBy(value, key))).withColumn("_n", F.count("*").over(Window.partitionBy()))
    lo, hi = F.floor(F.col("_n") / 2), F.floor((F.col("_n") - 1) / 2) + 1
    at = lambda k: F.max(F.when(F.col("_i") == k, F.col(value)))
    four = ranked.groupBy().agg(at(lo).alias("_a"), at(lo + 1).alias("_b"), at(hi).alias("_c"), at(hi + 1).alias("_d"))
    pick = lambda k, x, y: F.when(k < F.col("_i"), F.col(x)).otherwise(F.col(y))
    return ranked.crossJoin(F.broadcast(four)).withColumn(out, (pick(lo, "_a", "_b") + pick(hi, "_c", "_d")) / 2).drop("_i", "_n", "_a", "_b", "_c", "_d")


def contributor_risk(samples: DataFrame, flags: DataFrame, findings: DataFrame | None = None, prior: float = 60.0, excess: float = 2.0, level: float = 0.9, min_samples: int = 20, high: float = 0.95, medium: float = 0.8) -> DataFrame:
    """One row for each contributor: counts, baseline, posterior, strength, campaigns, tier and action.

    ``findings`` (contributors array, attack_class, affected long, severity) attribute campaigns. Empty with fewer than two contributors.
    """
    totals = leave_one_out_median(contributor_totals(samples, flag_weights(flags)), "rate", "contributor").filter("baseline IS NOT NULL")
    a0, b0 = prior * F.col("baseline"), prior * (1 - F.col("baseline"))
    out = totals.withColumn("a1", a0 + F.col("mass")).withColumn("b1", b0 + F.greatest(F.col("n") - F.col("mass"), F.lit(0.0)))
    tail = (1 - level) / 2
    out = out.withColumn("anomaly", special.beta_tail(F.least(F.lit(0.999), excess * F.col("baseline")), "a1", "b1"))
    out = out.withColumn("credible_low", special.beta_quantile(F.lit(tail), "a1", "b1")).withColumn("credible_high", special.beta_quantile(F.lit(1 - tail), "a1", "b1"))
    out = out.withColumn("expected_low", special.beta_binomial_quantile(F.lit(tail), "n", a0, b0)).withColumn("expected_high", special.beta_binomial_quantile(F.lit(1 - tail), "n", a0, b0))
    strength = (
        F.when(F.col("n") < min_samples, F.when(F.col("anomaly") >= medium, "LOW").otherwise("NONE"))
        .when((F.col("anomaly") >= high) & (F.col("mass") > F.col("expected_high")), "HIGH")
        .when(F.col("anomaly") >= medium, "MEDIUM").when(F.col("anomaly") >= 0.5, "LOW").otherwise("NONE")
    )
    out = out.withColumn("strength", strength).withColumn("posterior_mean", F.col("a1") / (F.col("a1") + F.col("b1")))
    if findings is None:
        out = out.withColumn("campaigns", F.lit(0)).withColumn("high_campaigns", F.lit(0)).withColumn("critical", F.lit(0))
    else:
        rank = rank_of(F.col("severity"))
        own = findings.filter((F.size("contributors") == 1) & F.col("attack_class").isin(*CAMPAIGNS) & (F.col("affected") >= MIN_CAMPAIGN) & (rank >= 2))
        own = own.groupBy(F.col("contributors")[0].alias("contributor")).agg(F.count("*").alias("campaigns"), F.sum((rank >= 3).cast("int")).alias("high_campaigns"), F.sum((rank == 4).cast("int")).alias("critical"))
        out = out.join(own, "contributor", "left").fillna(0, ["campaigns", "high_campaigns", "critical"])
    tier = (
        F.when(((F.col("strength") == "HIGH") & (F.col("high_campaigns") >= 2)) | (F.col("critical") > 0), "CRITICAL")
        .when((F.col("strength") == "HIGH") | (F.col("high_campaigns") > 0), "HIGH")
        .when((F.col("strength") == "MEDIUM") | (F.col("campaigns") > 0), "ELEVATED").otherwise("LOW")
    )
    action = F.when(F.col("tier") == "CRITICAL", "QUARANTINE").when(F.col("tier") == "HIGH", F.when(F.col("high_campaigns") > 0, "QUARANTINE").otherwise("REVIEW")).when(F.col("tier") == "ELEVATED", "REVIEW").otherwise("ACCEPT")
    return out.withColumn("tier", tier).withColumn("action", action).drop("a1", "b1", "critical")


def worst_by(findings: DataFrame, key: str, names: tuple[str, ...] = DISPOSITIONS, column: str = "disposition") -> DataFrame:
    return findings.groupBy(key).agg(name_of(F.max(rank_of(F.col(column), names)), names).alias(column))


def scan_diff(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("detector_id", "subject"), compared: tuple[str, ...] = ("severity", "disposition")) -> DataFrame:
    """(keys, state): new, resolved, changed or same, by a full outer join."""
    a = old.select(*keys, F.struct(*compared).alias("a"))
    b = new.select(*keys, F.struct(*compared).alias("b"))
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "resolved").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return a.join(b, list(keys), "full_outer").select(*keys, state.alias("state"))


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int = 3) -> DataFrame:
    """(node, depth): what lies within ``hops`` undirected edges (source, target) of the start nodes, by iterated joins."""
    both = edges.select("source", "target").union(edges.select("target", "source")).distinct()
    seen = start.select("node").distinct().withColumn("depth", F.lit(0))
    front = seen
    for d in range(1, hops + 1):
        step = both.join(front.select(F.col("node").alias("source")), "source").select(F.col("target").alias("node")).distinct()
        front = step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen
