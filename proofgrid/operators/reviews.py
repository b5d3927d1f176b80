"""Reviews of findings: which requests and approvals the rules let through, and the index of findings that reviews start from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Roles and dispositions in rising order, reason codes, the attack classes of failed proofs, the least justification.
ROLES = ("VIEWER", "ANALYST", "APPROVER", "ADMIN")
DISPOSITIONS = ("ACCEPT", "REVIEW", "QUARANTINE")
REASONS = ("FALSE_POSITIVE", "ACCEPTED_RISK", "REMEDIATED", "DUPLICATE", "NEEDS_INVESTIGATION", "ESCALATION", "OTHER")
PROOF_CLASSES = (
    "record_modification", "record_deletion", "record_reorder", "record_replay", "record_truncation", "signature_forgery",
    "model_binding_violation", "input_substitution", "config_binding_violation",
)
LEAST_JUSTIFICATION = 20


def rank(value: Column, names: Sequence[str]) -> Column:
    """Place of ``value`` in ``names`` from 1, 0 if it isn't there or null."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, names)), value), F.lit(0))


def judge_requests(requests: DataFrame, findings: DataFrame, pending: DataFrame) -> DataFrame:
    """(request_id, finding_id, outcome) of requests (request_id, finding_id, role, target, reason, justification) to move findings
    (finding_id, disposition, deterministic, attack_class, severity); ``pending`` holds the finding_id of open decisions.

    A stricter target is APPLIED, a looser one PENDING a second person; other outcomes name the rule that refuses. The request
    with the least id of each finding is judged against its state; the others are LATER, for the state that it leaves. Requests
    that the request alone refuses, or for no known finding, don't hold up others.
    """
    refused = (
        F.when(rank(F.col("role"), ROLES) < rank(F.lit("ANALYST"), ROLES), "ROLE").when(rank(F.col("reason"), REASONS) == 0, "REASON")
        .when(rank(F.col("target"), DISPOSITIONS) == 0, "TARGET").when(F.length(F.trim(F.coalesce("justification", F.lit("")))) < LEAST_JUSTIFICATION, "JUSTIFICATION")
    )
    state = findings.select("finding_id", "disposition", "deterministic", "attack_class", "severity", F.lit(True).alias("known"))
    rows = requests.withColumn("refused", refused).join(state, "finding_id", "left")
    rows = rows.withColumn("refused", F.coalesce("refused", F.when(F.col("known").isNull(), "UNKNOWN")))
    # the least id by aggregation: a finding with very many requests is no sorted group
    first = rows.filter("refused IS NULL").groupBy("finding_id").agg(F.min("request_id").alias("first"))
    rows = rows.join(first, "finding_id", "left").join(pending.select("finding_id", F.lit(True).alias("open")).distinct(), "finding_id", "left")
    proof = F.col("deterministic") & (rank(F.col("attack_class"), PROOF_CLASSES) > 0) & F.col("severity").isin("HIGH", "CRITICAL")
    move = rank(F.col("target"), DISPOSITIONS) - rank(F.col("disposition"), DISPOSITIONS)
    outcome = (
        F.when(F.col("refused").isNotNull(), F.col("refused")).when(F.col("request_id") > F.col("first"), "LATER").when(move == 0, "SAME")
        .when((F.col("target") == "ACCEPT") & proof, "PROTECTED").when(F.col("open"), "DUPLICATE").when(move < 0, "PENDING").otherwise("APPLIED")
    )
    return rows.select("request_id", "finding_id", outcome.alias("outcome"))


def judge_approvals(answers: DataFrame, decisions: DataFrame) -> DataFrame:
    """(answer_id, decision_id, outcome, disposition) of answers (answer_id, decision_id, actor, role, approve) to decisions
    (decision_id, requested_by, status, from_disposition, to_disposition): nobody answers their own request, approvers alone answer,
    and a decision is answered once, by the least id of those that may. ``disposition`` is the finding's after it, null if the
    decision isn't known."""
    rows = answers.join(decisions.withColumn("known", F.lit(True)), "decision_id", "left")
    refused = (
        F.when(F.col("known").isNull(), "UNKNOWN").when(F.col("actor").eqNullSafe(F.col("requested_by")), "SELF")
        .when(rank(F.col("role"), ROLES) < rank(F.lit("APPROVER"), ROLES), "ROLE").when(F.col("status") != "PENDING", "RESOLVED")
    )
    rows = rows.withColumn("refused", refused)
    may = rows.filter("refused IS NULL").groupBy("decision_id").agg(F.min(F.struct("answer_id", "approve")).alias("won"))
    rows = rows.join(may, "decision_id", "left")
    outcome = F.coalesce("refused", F.when(F.col("answer_id") > F.col("won.answer_id"), "RESOLVED").when(F.col("approve"), "APPROVED").otherwise("REJECTED"))
    applied = (F.col("status") == "APPROVED") | (F.col("status") == "APPLIED") | F.coalesce(F.col("won.approve"), F.lit(False))
    return rows.select("answer_id", "decision_id", outcome.alias("outcome"), F.when(applied, F.col("to_disposition")).otherwise(F.col("from_disposition")).alias("disposition"))


def index_findings(findings: DataFrame, executions: DataFrame, indexed: DataFrame) -> DataFrame:
    """Rows to add to the index: findings that it lacks, with the layer of the check that ran (empty if none did), and the
    recommended disposition both as it was and as it is. A finding that comes twice is added once."""
    layers = executions.groupBy("detector_id").agg(F.min("layer").alias("layer"))
    new = findings.drop("layer").dropDuplicates(["finding_id"]).join(indexed.select("finding_id"), "finding_id", "left_anti").join(layers, "detector_id", "left")
    return new.select("finding_id", "scan_id", "detector_id", "attack_class", F.coalesce("layer", F.lit("")).alias("layer"), "severity", F.col("disposition").alias("original_disposition"), "disposition", "deterministic", F.substring("title", 1, 500).alias("title"), "confidence")
