"""Rules of reviews, majorities, overlaps and rank sums on small tables."""

import math
import random

from proofgrid.operators import activations, duplicates, reviews
from proofgrid.operators import statistics as st

WHY = "compared with the signed record"


def test_requests_meet_each_rule(spark):
    findings = spark.createDataFrame([(1, "REVIEW", False, "ood_injection", "HIGH"), (2, "QUARANTINE", True, "record_replay", "CRITICAL"), (3, "QUARANTINE", True, "record_replay", "LOW"), (4, "REVIEW", False, "ood_injection", "LOW")], "finding_id long, disposition string, deterministic boolean, attack_class string, severity string")
    rows = [
        (1, 1, "VIEWER", "ACCEPT", "OTHER", WHY, "ROLE"), (2, 1, "ANALYST", "ACCEPT", "WHIM", WHY, "REASON"), (3, 1, "ANALYST", "ACCEPT", "OTHER", "  short                 ", "JUSTIFICATION"),
        (4, 1, "ANALYST", "ACCEPT", "OTHER", WHY, "PENDING"), (5, 1, "APPROVER", "QUARANTINE", "OTHER", WHY, "LATER"), (6, 2, "ADMIN", "ACCEPT", "OTHER", WHY, "PROTECTED"), (7, 2, "ADMIN", "REVIEW", "OTHER", WHY, "LATER"),
        (8, 3, "ADMIN", "ACCEPT", "OTHER", WHY, "PENDING"), (9, 9, "ANALYST", "ACCEPT", "OTHER", WHY, "UNKNOWN"), (10, None, "ANALYST", "ACCEPT", "OTHER", WHY, "UNKNOWN"), (11, 4, "ANALYST", "REVIEW", "OTHER", WHY, "SAME"),
        (12, 4, None, None, None, None, "ROLE"), (13, 4, "ANALYST", None, "OTHER", WHY, "TARGET"),
    ]
    requests = spark.createDataFrame([r[:6] for r in rows], "request_id long, finding_id long, role string, target string, reason string, justification string")
    none = spark.createDataFrame([], "finding_id long")
    assert {r.request_id: r.outcome for r in reviews.judge_requests(requests, findings, none).collect()} == {r[0]: r[6] for r in rows}
    stricter = spark.createDataFrame([(1, 1, "ANALYST", "QUARANTINE", "OTHER", WHY)], requests.schema)
    assert [r.outcome for r in reviews.judge_requests(stricter, findings, none).collect()] == ["APPLIED"]
    opened = spark.createDataFrame([(1,), (1,)], "finding_id long")
    assert [r.outcome for r in reviews.judge_requests(stricter, findings, opened).collect()] == ["DUPLICATE"]


def test_answers_need_a_second_person_and_count_once(spark):
    decisions = spark.createDataFrame([(1, "ann", "PENDING", "REVIEW", "ACCEPT"), (2, "ann", "APPROVED", "REVIEW", "ACCEPT"), (3, "ann", "PENDING", "QUARANTINE", "REVIEW")], "decision_id long, requested_by string, status string, from_disposition string, to_disposition string")
    answers = spark.createDataFrame([(1, 1, "ann", "ADMIN", True), (2, 1, "bob", "ANALYST", True), (3, 1, "cyd", "APPROVER", True), (4, 1, "dan", "APPROVER", False), (5, 2, "bob", "ADMIN", False), (6, 3, "bob", "APPROVER", False), (7, 8, "bob", "APPROVER", True)], "answer_id long, decision_id long, actor string, role string, approve boolean")
    got = {r.answer_id: (r.outcome, r.disposition) for r in reviews.judge_approvals(answers, decisions).collect()}
    assert got == {1: ("SELF", "ACCEPT"), 2: ("ROLE", "ACCEPT"), 3: ("APPROVED", "ACCEPT"), 4: ("RESOLVED", "ACCEPT"), 5: ("RESOLVED", "ACCEPT"), 6: ("REJECTED", "QUARANTINE"), 7: ("UNKNOWN", None)}


def test_ties_of_a_cluster_are_told_apart_by_votes(spark):
    rows = [(1, "a", "b"), (1, "b", "b"), (2, "a", "a"), (2, "b", "b"), (3, "a", None), (3, "a", "b"), (3, "b", "b"), (3, None, "b"), (4, "a", "b"), (4, "a", "b"), (5, "a", "c"), (5, "b", None)]
    got = {r.component: (r.n_labels, r.majority, r.n_minority) for r in duplicates.majorities(spark.createDataFrame(rows, "component long, label string, vote string")).collect()}
    assert got == {1: (2, "b", 1), 2: (2, None, 2), 3: (2, "a", 1), 5: (2, None, 2)}


def test_overlap_counts_a_sample_once(spark):
    members = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y")], "sample_id long, cls string")
    flags = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (9, "a")], "sample_id long, attack_class string")
    got = sorted(tuple(r) for r in activations.flag_overlap(members, flags).collect())
    assert got == [("x", 3, 2, 2 / 3, True), ("y", 1, 0, 0.0, False)]


def test_rank_sums_match_ranks(spark):
    dice = random.Random(3)
    groups = {g: [float(dice.randrange(12) + shift) for _ in range(n)] for g, n, shift in (("a", 30, 0), ("b", 41, 3), ("c", 25, 0), ("few", 7, 0))}
    groups["same"], groups["like"] = [1.0] * 9, [1.0] * 8
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("a", math.nan), (None, 1.0)]
    got = {(r.a, r.b): r for r in st.mann_whitney(spark.createDataFrame(rows, "g string, v double").repartition(3), "g", "v").collect()}
    names = sorted(set(groups) - {"few"})
    assert set(got) == {(x, y) for x in names for y in names if x < y}
    for (x, y), r in got.items():
        both = sorted(groups[x] + groups[y])
        at = {v: both.index(v) + (both.count(v) + 1) / 2 for v in both}
        n, m = len(groups[x]), len(groups[y])
        u = sum(at[v] for v in groups[x]) - n * (n + 1) / 2
        var = n * m / 12 * (n + m + 1 - sum(both.count(v) ** 3 - both.count(v) for v in set(both)) / ((n + m) * (n + m - 1)))
        z = max(abs(u - n * m / 2) - 0.5, 0) / math.sqrt(var) if var > 0 else 0.0
        assert (r.n_a, r.n_b, r.u) == (n, m, u) and abs(r.z - z) < 1e-9 and abs(r.p - math.erfc(z / math.sqrt(2))) < 1e-9
    assert got["a", "b"].p < 0.01 < got["a", "c"].p and got["like", "same"].p == 1
    assert not st.mann_whitney(spark.createDataFrame([], "g string, v double"), "g", "v").count()


def test_the_index_grows_by_new_findings(spark):
    rows = [(i, 1, "det-a" if i % 2 else "det-b", "ood_injection", "OLD", "LOW", "REVIEW", False, "t" * 600, 0.5) for i in (1, 2, 3, 3)]
    findings = spark.createDataFrame(rows, "finding_id long, scan_id long, detector_id string, attack_class string, layer string, severity string, disposition string, deterministic boolean, title string, confidence double")
    ran = spark.createDataFrame([("det-a", "DATA"), ("det-a", "DATA")], "detector_id string, layer string")
    got = sorted((r.finding_id, r.layer, len(r.title), r.original_disposition) for r in reviews.index_findings(findings, ran, spark.createDataFrame([(1,)], "finding_id long")).collect())
    assert got == [(2, "", 500, "REVIEW"), (3, "DATA", 500, "REVIEW")]
