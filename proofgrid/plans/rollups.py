"""Rollups: contributor risk, policy, coverage, comparison of scans, and the evidence graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofgrid.functions.columns import name_of, rank_of
from proofgrid.operators import risk
from proofgrid.plans import bindings as b
from proofgrid.plans.catalog import query

_WEIGHTS = f"SELECT sample_id, attack_class, max(least(1.0, confidence * [0.0, 0.5, 0.75, 1.0, 1.0][list_position(['INFO','LOW','MEDIUM','HIGH','CRITICAL'], severity)])) AS weight FROM ({b.FLAGS_SQL}) WHERE confidence >= 0.5 AND severity <> 'INFO' GROUP BY ALL"
_TOTALS = f"SELECT source AS contributor, count(*) AS n, count(*) FILTER (weight > 0) AS flagged, sum(coalesce(weight, 0)) AS mass FROM documents LEFT JOIN (SELECT sample_id, max(weight) AS weight FROM ({_WEIGHTS}) GROUP BY 1) ON doc_id = sample_id GROUP BY 1"


@query(f"SELECT sample_id, attack_class, round(weight::DOUBLE, 6) AS weight FROM ({_WEIGHTS})")
def flag_weights(spark, d):
    return risk.flag_weights(b.flags(spark, d)).select("sample_id", "attack_class", F.round("weight", 6).alias("weight"))


@query(f"WITH r AS (SELECT contributor, n, flagged, mass, (mass + 0.5) / (n + 1) AS rate FROM ({_TOTALS})) SELECT contributor, n, flagged, round(mass::DOUBLE, 6) AS mass, round((SELECT quantile_cont(o.rate, 0.5) FROM r o WHERE o.contributor <> r.contributor)::DOUBLE, 8) AS baseline FROM r")
def contributor_baseline(spark, d):
    t = risk.contributor_totals(b.thin_samples(spark, d), risk.flag_weights(b.flags(spark, d)))
    return risk.leave_one_out_median(t, "rate", "contributor").select("contributor", "n", "flagged", F.round("mass", 6).alias("mass"), F.round("baseline", 8).alias("baseline"))


@query()
def contributor_risk(spark, d):
    """Beta posteriors and their quantiles have no SQL form; tests hold them against integration."""
    f = b.findings(spark, d).select(F.array(F.concat(F.lit("src"), (F.col("finding_id") % 20).cast("string"))).alias("contributors"), "attack_class", (F.col("finding_id") % 9).alias("affected"), "severity")
    r = risk.contributor_risk(b.thin_samples(spark, d), b.flags(spark, d), f)
    return r.select("contributor", "n", "flagged", *(F.round(k, 5).alias(k) for k in ("mass", "baseline", "posterior_mean", "credible_low", "credible_high", "anomaly")), "expected_low", "expected_high", "strength", "campaigns", "tier", "action")


@query(f"SELECT source AS contributor, 'b' || (doc_id % 4) AS batch, count(*) AS samples, count(*) FILTER (weight > 0) AS flagged FROM documents LEFT JOIN (SELECT sample_id, max(weight) AS weight FROM ({_WEIGHTS}) GROUP BY 1) ON doc_id = sample_id GROUP BY ALL")
def batch_rollup(spark, d):
    w = risk.flag_weights(b.flags(spark, d)).groupBy("sample_id").agg(F.max("weight").alias("weight"))
    return b.thin_samples(spark, d).join(w, "sample_id", "left").groupBy("contributor", F.coalesce("batch", F.lit("unbatched")).alias("batch")).agg(F.count("*").alias("samples"), F.count_if(F.col("weight") > 0).alias("flagged"))


@query(f"WITH s AS (SELECT source AS contributor, attack_class, sum(weight) AS mass FROM ({_WEIGHTS}) JOIN documents ON doc_id = sample_id GROUP BY ALL) SELECT contributor, attack_class, round(mass::DOUBLE, 6) AS mass, i FROM (SELECT *, row_number() OVER (PARTITION BY contributor ORDER BY mass DESC, attack_class) AS i FROM s WHERE mass >= 1) WHERE i <= 3")
def signal_breakdown(spark, d):
    s = risk.flag_weights(b.flags(spark, d)).join(b.thin_samples(spark, d), "sample_id").groupBy("contributor", "attack_class").agg(F.sum("weight").alias("mass")).filter("mass >= 1")
    i = F.row_number().over(Window.partitionBy("contributor").orderBy(F.col("mass").desc(), "attack_class"))
    return s.withColumn("i", i).filter("i <= 3").select("contributor", "attack_class", F.round("mass", 6).alias("mass"), "i")


_RANK = "list_position(['INFO','LOW','MEDIUM','HIGH','CRITICAL'], severity)"
_RULES = f"""SELECT *, {_RANK} AS r, CASE
 WHEN layer = 'PROVENANCE' AND {_RANK} <= 1 THEN 'provenance.verified' WHEN layer = 'PROVENANCE' AND deterministic AND {_RANK} >= 4 THEN 'provenance.failure'
 WHEN attack_class = 'model_substitution' AND {_RANK} <= 1 THEN 'model.approved-match' WHEN attack_class = 'behavioural_divergence' AND n_signals >= 1 AND {_RANK} >= 4 THEN 'model.identity-and-behaviour'
 WHEN attack_class = 'model_substitution' AND identical THEN 'model.reserialized' WHEN attack_class = 'model_substitution' AND deterministic THEN 'model.unapproved-artifact'
 WHEN attack_class = 'corrupted_samples' AND deterministic AND {_RANK} >= 4 THEN 'data.corrupted-files' WHEN attack_class = 'metadata_manipulation' THEN 'metadata.review'
 WHEN layer = 'DRIFT' AND {_RANK} >= 2 THEN 'drift.review' WHEN attack_class = 'ood_injection' AND {_RANK} >= 2 THEN 'ood.review'
 WHEN {_RANK} >= 4 AND confidence >= 0.85::DOUBLE AND n_signals >= 2 THEN 'corroborated.high' WHEN {_RANK} >= 4 THEN 'high.review' WHEN {_RANK} >= 3 THEN 'medium.review' ELSE 'low.accept' END AS rule_id FROM ({b.FINDINGS_SQL})"""
_DECIDED = f"""SELECT *, CASE WHEN rule_id IN ('provenance.failure', 'model.identity-and-behaviour') THEN 5 WHEN rule_id IN ('model.reserialized', 'metadata.review') THEN least(r, 3) WHEN rule_id = 'model.unapproved-artifact' THEN greatest(r, 4) ELSE r END AS sr,
 CASE WHEN rule_id IN ('provenance.failure', 'model.identity-and-behaviour', 'model.unapproved-artifact', 'data.corrupted-files', 'corroborated.high') THEN 'QUARANTINE' WHEN rule_id IN ('provenance.verified', 'model.approved-match', 'low.accept') THEN 'ACCEPT' ELSE 'REVIEW' END AS disp FROM ({_RULES})"""


@query(f"SELECT finding_id, rule_id, ['INFO','LOW','MEDIUM','HIGH','CRITICAL'][sr] AS decided_severity FROM ({_DECIDED}) WHERE NOT (layer = 'PROVENANCE' AND deterministic AND r >= 4 AND disp <> 'QUARANTINE')")
def policy_rules(spark, d):
    return risk.decide(b.findings(spark, d)).filter("NOT array_contains(guardrails, 'G1')").select("finding_id", "rule_id", "decided_severity")


@query(f"""SELECT finding_id, CASE WHEN disp = 'QUARANTINE' AND ((NOT deterministic AND NOT calibrated) OR attack_class = 'metadata_manipulation' OR (attack_class = 'drift_manipulation' AND n_signals < 3) OR sr = 1) THEN 'REVIEW' ELSE disp END AS disposition,
 round(CASE WHEN availability = 'DEGRADED' THEN least(confidence, 0.85::DOUBLE) ELSE confidence END, 4) AS decided_confidence, (disp = 'QUARANTINE' AND NOT deterministic AND NOT calibrated)::INT + (availability = 'DEGRADED' AND confidence > 0.85::DOUBLE)::INT AS n_guardrails FROM ({_DECIDED})""")
def guardrails(spark, d):
    out = risk.decide(b.findings(spark, d))
    return out.select("finding_id", "disposition", "decided_confidence", F.size("guardrails").alias("n_guardrails"))


def coverage(catalogue, supports, executions):
    """(attack_class, state): the best of what the supporting detectors achieved."""
    rows = catalogue.join(supports, "attack_class", "left").join(executions, "detector_id", "left")
    states = ("NOT_ASSESSED", "FAILED", "PARTIALLY_ASSESSED", "ASSESSED")
    own = F.when((F.col("status") == "OK") & (F.col("level") == "FULL"), 3).when(F.col("status").isin("OK", "DEGRADED"), 2).when(F.col("status") == "ERROR", 1).otherwise(0)
    return rows.groupBy("attack_class").agg(F.count("detector_id").alias("n"), F.max(own).alias("best")).select("attack_class", F.when(F.col("n") == 0, "UNSUPPORTED").otherwise(name_of(F.col("best"), states)).alias("state"))


@query("""WITH c AS (SELECT DISTINCT p_type AS attack_class FROM part UNION SELECT 'none'), s AS (SELECT DISTINCT p_type AS attack_class, p_brand AS detector_id, CASE WHEN min(p_size) OVER (PARTITION BY p_type, p_brand) < 2 THEN 'FULL' ELSE 'PARTIAL' END AS level FROM part),
e AS (SELECT p_brand AS detector_id, ['OK','DEGRADED','ERROR','ABSTAINED'][(min(p_partkey) % 4 + 1)::INT] AS status FROM part GROUP BY 1)
SELECT attack_class, CASE WHEN count(detector_id) = 0 THEN 'UNSUPPORTED' ELSE ['NOT_ASSESSED','FAILED','PARTIALLY_ASSESSED','ASSESSED'][max(CASE WHEN status = 'OK' AND level = 'FULL' THEN 4 WHEN status IN ('OK','DEGRADED') THEN 3 WHEN status = 'ERROR' THEN 2 ELSE 1 END)] END AS state
FROM c LEFT JOIN s USING (attack_class) LEFT JOIN e USING (detector_id) GROUP BY attack_class""")
def coverage_states(spark, d):
    p = b.read(spark, d, "part")
    cat = p.select(F.col("p_type").alias("attack_class")).union(spark.sql("SELECT 'none'")).distinct()
    sup = p.groupBy(F.col("p_type").alias("attack_class"), F.col("p_brand").alias("detector_id")).agg(F.when(F.min("p_size") < 2, "FULL").otherwise("PARTIAL").alias("level"))
    exe = p.groupBy(F.col("p_brand").alias("detector_id")).agg(F.element_at(F.array(*map(F.lit, ("OK", "DEGRADED", "ERROR", "ABSTAINED"))), (F.min("p_partkey") % 4 + 1).cast("int")).alias("status"))
    return coverage(cat, sup, exe)


_SCAN = "SELECT subject, max_by(severity, finding_id) AS severity FROM ({f}) WHERE scan_id = {k} GROUP BY 1"


@query(f"""WITH a AS (SELECT 's' || (finding_id // 97) AS subject, max_by(severity, finding_id) AS severity FROM ({b.FINDINGS_SQL}) WHERE scan_id = 1 GROUP BY 1), z AS (SELECT 's' || (finding_id // 97) AS subject, max_by(severity, finding_id) AS severity FROM ({b.FINDINGS_SQL}) WHERE scan_id = 2 GROUP BY 1)
SELECT subject, CASE WHEN a.severity IS NULL THEN 'new' WHEN z.severity IS NULL THEN 'resolved' WHEN a.severity = z.severity THEN 'same' ELSE 'changed' END AS state FROM a FULL JOIN z USING (subject)""")
def scan_compare(spark, d):
    f = b.findings(spark, d).withColumn("subject", F.concat(F.lit("s"), F.floor(F.col("finding_id") / 97).cast("string")))
    one = lambda k: f.filter(F.col("scan_id") == k).groupBy("subject").agg(F.max_by("severity", "finding_id").alias("severity"))
    return risk.scan_diff(one(1), one(2), ("subject",), ("severity",))


_EDGES = "SELECT 'order:' || o_orderkey AS source, 'customer:' || o_custkey AS target FROM orders UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer"


def _edges(spark, d):
    o = b.read(spark, d, "orders").select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("source"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("target"))
    k = b.read(spark, d, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("source"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("target"))
    return o.union(k).distinct()


@query(f"SELECT split_part(source, ':', 1) AS kind, count(*) AS edges, count(DISTINCT target) AS targets FROM ({_EDGES}) GROUP BY 1")
def graph_edges(spark, d):
    return _edges(spark, d).groupBy(F.substring_index("source", ":", 1).alias("kind")).agg(F.count("*").alias("edges"), F.count_distinct("target").alias("targets"))


@query(f"""WITH e AS ({_EDGES}), u AS (SELECT source, target FROM e UNION SELECT target, source FROM e), d1 AS (SELECT DISTINCT target AS n FROM u WHERE source = 'nation:3'), d2 AS (SELECT DISTINCT target AS n FROM u JOIN d1 ON source = n WHERE target NOT IN (SELECT n FROM d1) AND target <> 'nation:3')
SELECT 'nation:3' AS node, 0 AS depth UNION ALL SELECT n, 1 FROM d1 UNION ALL SELECT n, 2 FROM d2""")
def graph_neighbourhood(spark, d):
    return risk.neighbourhood(_edges(spark, d), spark.sql("SELECT 'nation:3' AS node"), 2)


@query("""SELECT count(*) FILTER (o_orderstatus <> 'P') AS eligible, round(avg((o_totalprice > 200000)::INT) FILTER (o_orderstatus = 'F'), 8) AS mean_tpr, round(avg(o_totalprice / 1e6) FILTER (o_orderstatus = 'O'), 8) AS alert_rate FROM orders""")
def benchmark_rollup(spark, d):
    o = b.read(spark, d, "orders")
    hit = (F.col("o_totalprice") > 200000).cast("int")
    return o.agg(F.count_if(F.col("o_orderstatus") != "P").alias("eligible"), F.round(F.avg(F.when(F.col("o_orderstatus") == "F", hit)), 8).alias("mean_tpr"), F.round(F.avg(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice") / 1e6)), 8).alias("alert_rate"))


@query("SELECT o_custkey AS subject, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'PENDING' ELSE max_by(o_orderstatus, o_orderkey) END AS state FROM orders GROUP BY 1")
def governance_state(spark, d):
    o = b.read(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("subject")).agg(F.when(F.bool_or(F.col("o_orderstatus") == "P"), "PENDING").otherwise(F.max_by("o_orderstatus", "o_orderkey")).alias("state"))
