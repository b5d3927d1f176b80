"""Queries over reviews of findings, majorities of clusters, overlap of clusters with flags, rank sums and probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.operators import activations, duplicates, reviews
from proofgrid.operators import statistics as st
from proofgrid.plans import bindings as b
from proofgrid.plans.catalog import query


def pick(names, i):
    return F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))


_ROLES = ("ANALYST", "VIEWER", "APPROVER")
_REASONS = ("FALSE_POSITIVE", "REMEDIATED", "OTHER", "WHIM")
_PROOFS = ", ".join(f"'{c}'" for c in reviews.PROOF_CLASSES)


def _requests(spark, d):
    """lineitem as requests on orders' findings, some of which don't exist."""
    i = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    return b.read(spark, d, "lineitem").groupBy(i.alias("request_id")).agg(F.min("l_orderkey").alias("k"), F.min("l_linenumber").alias("line"), F.min("l_suppkey").alias("s")).select(
        "request_id", F.when(F.col("k") % 41 == 0, -F.col("k")).otherwise(F.col("k")).alias("finding_id"), pick(_ROLES, F.col("s") % 3).alias("role"), pick(reviews.DISPOSITIONS, (F.col("s") + F.col("line")) % 3).alias("target"),
        pick(_REASONS, F.col("s") % 4).alias("reason"), F.when(F.col("s") % 11 == 0, "  too short to justify ").when(F.col("s") % 13 == 0, " short ").otherwise("checked against the record").alias("justification"),
    )


@query(f"""WITH q AS (SELECT l_orderkey * 8 + l_linenumber AS request_id, min(l_orderkey) AS k, min(l_linenumber) AS line, min(l_suppkey) AS s FROM lineitem GROUP BY 1),
r AS (SELECT request_id, CASE WHEN k % 41 = 0 THEN -k ELSE k END AS finding_id, (s + line) % 3 AS target, CASE WHEN s % 3 = 1 THEN 'ROLE' WHEN s % 4 = 3 THEN 'REASON' WHEN s % 11 <> 0 AND s % 13 = 0 THEN 'JUSTIFICATION' END AS refused FROM q),
f AS (SELECT finding_id, CASE disposition WHEN 'ACCEPT' THEN 0 WHEN 'REVIEW' THEN 1 ELSE 2 END AS now, deterministic AND severity IN ('HIGH', 'CRITICAL') AND attack_class IN ({_PROOFS}) AS proof FROM ({b.FINDINGS_SQL})),
j AS (SELECT r.*, now, proof, f.finding_id IS NOT NULL AS known, min(request_id) FILTER (refused IS NULL AND f.finding_id IS NOT NULL) OVER (PARTITION BY r.finding_id) AS first FROM r LEFT JOIN f USING (finding_id))
SELECT request_id, finding_id, CASE WHEN refused IS NOT NULL THEN refused WHEN NOT known THEN 'UNKNOWN' WHEN request_id > first THEN 'LATER' WHEN target = now THEN 'SAME' WHEN target = 0 AND proof THEN 'PROTECTED'
  WHEN finding_id % 17 = 0 THEN 'DUPLICATE' WHEN target < now THEN 'PENDING' ELSE 'APPLIED' END AS outcome FROM j""")
def decision_requests(spark, d):
    f = b.findings(spark, d)
    return reviews.judge_requests(_requests(spark, d), f, f.filter("finding_id % 17 = 0"))


@query("""WITH a AS (SELECT event_id AS answer_id, event_id // 3 AS decision_id, user_id % 5 AS actor, user_id % 3 AS role, event_type = 'click' AS approve FROM events),
j AS (SELECT answer_id, decision_id, approve, o_orderstatus AS s, o_custkey % 5 AS by_, CASE WHEN o_orderkey IS NULL THEN 'UNKNOWN' WHEN actor = o_custkey % 5 THEN 'SELF' WHEN role <> 2 THEN 'ROLE' WHEN o_orderstatus = 'F' THEN 'RESOLVED' END AS refused FROM a LEFT JOIN orders ON o_orderkey = decision_id),
w AS (SELECT *, min(answer_id) FILTER (refused IS NULL) OVER (PARTITION BY decision_id) AS first FROM j),
v AS (SELECT *, bool_or(approve AND answer_id = first) OVER (PARTITION BY decision_id) AS yes FROM w)
SELECT answer_id, decision_id, CASE WHEN refused IS NOT NULL THEN refused WHEN answer_id > first THEN 'RESOLVED' WHEN approve THEN 'APPROVED' ELSE 'REJECTED' END AS outcome,
  CASE WHEN refused = 'UNKNOWN' THEN NULL WHEN s = 'F' OR coalesce(yes, false) THEN 'ACCEPT' ELSE 'REVIEW' END AS disposition FROM v""")
def decision_answers(spark, d):
    """events as answers to orders as decisions."""
    e = b.read(spark, d, "events")
    answers = e.select(F.col("event_id").alias("answer_id"), F.floor(F.col("event_id") / 3).alias("decision_id"), (F.col("user_id") % 5).alias("actor"), pick(("VIEWER", "ANALYST", "APPROVER"), F.col("user_id") % 3).alias("role"), (F.col("event_type") == "click").alias("approve"))
    status = F.when(F.col("o_orderstatus") == "F", "APPROVED").otherwise("PENDING")
    decisions = b.read(spark, d, "orders").select(F.col("o_orderkey").alias("decision_id"), (F.col("o_custkey") % 5).alias("requested_by"), status.alias("status"), F.lit("REVIEW").alias("from_disposition"), F.lit("ACCEPT").alias("to_disposition"))
    return reviews.judge_approvals(answers, decisions)


@query(f"""SELECT finding_id, scan_id, detector_id, attack_class, CASE detector_id WHEN 'detector-0' THEN 'DATA' WHEN 'detector-1' THEN 'MODEL' WHEN 'detector-2' THEN 'DRIFT' WHEN 'detector-3' THEN 'PROVENANCE' ELSE '' END AS layer,
  severity, disposition AS original_disposition, disposition, deterministic, subject AS title, confidence FROM ({b.FINDINGS_SQL}) WHERE finding_id % 6 <> 0""")
def index_findings(spark, d):
    f = b.findings(spark, d)
    ran = spark.createDataFrame([(f"detector-{i}", layer) for i, layer in enumerate(("DATA", "MODEL", "DRIFT", "PROVENANCE"))], "detector_id string, layer string")
    return reviews.index_findings(f.withColumn("title", F.col("subject")), ran, f.filter("finding_id % 6 = 0").select("finding_id"))


@query("""WITH r AS (SELECT o_custkey AS component, left(o_orderpriority, 1) AS label, CASE WHEN o_orderkey % 4 > 0 THEN ((o_orderkey // 4) % 5 + 1)::VARCHAR END AS vote FROM orders),
l AS (SELECT component, label, count(*) AS n FROM r GROUP BY ALL), v AS (SELECT component, vote AS label, count(*) AS votes FROM r WHERE vote IS NOT NULL GROUP BY ALL),
t AS (SELECT l.component, l.label, n, coalesce(votes, 0) AS votes FROM l LEFT JOIN v ON v.component = l.component AND v.label = l.label),
k AS (SELECT *, rank() OVER (PARTITION BY component ORDER BY n DESC, votes DESC) AS i, count(*) OVER (PARTITION BY component) AS n_labels, sum(n) OVER (PARTITION BY component) AS total FROM t)
SELECT component, n_labels, CASE WHEN count(*) = 1 THEN min(label) END AS majority, (max(total) - CASE WHEN count(*) = 1 THEN max(n) ELSE 0 END)::BIGINT AS n_minority FROM k WHERE i = 1 AND n_labels > 1 GROUP BY ALL""")
def cluster_majorities(spark, d):
    """orders of one customer as a cluster, priorities as labels, with votes for those that tie."""
    k = F.col("o_orderkey")
    vote = F.when(k % 4 > 0, (F.floor(k / 4) % 5 + 1).cast("string"))
    return duplicates.majorities(b.read(spark, d, "orders").select(F.col("o_custkey").alias("component"), F.substring("o_orderpriority", 1, 1).alias("label"), vote.alias("vote")))


@query("""WITH s AS (SELECT vec_id, label AS cls, embedding[1] > 0 AS side FROM embeddings), n AS (SELECT cls, side, count(*) AS n FROM s GROUP BY ALL),
m AS (SELECT cls, first(side ORDER BY n, side) AS side FROM n GROUP BY 1), f AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)
SELECT s.cls, count(*) AS n_minority, count(f.doc_id) AS n_flagged, count(f.doc_id) / count(*) AS overlap, count(f.doc_id) >= 0.05 * count(*) AS corroborated FROM s JOIN m ON s.cls = m.cls AND s.side = m.side LEFT JOIN f ON f.doc_id = s.vec_id GROUP BY 1""")
def activation_overlap(spark, d):
    """The smaller half of each class by its first component, with flags of other checks."""
    s = b.vectors(spark, d).select(F.col("vec_id").alias("sample_id"), F.col("label").alias("cls"), (F.col("embedding")[0] > 0).alias("side"))
    small = s.groupBy("cls", "side").agg(F.count("*").alias("n")).groupBy("cls").agg(F.min(F.struct("n", "side")).alias("m")).select("cls", F.col("m.side").alias("side"))
    return activations.flag_overlap(s.join(small, ["cls", "side"]), b.flags(spark, d), 0.05)


@query("""WITH r AS (SELECT l_suppkey % 8 AS g, (l_discount * 400 - 4) / (l_quantity * 2 - 6) AS v FROM lineitem WHERE l_discount * 400 - 4 > 0 AND l_quantity * 2 - 6 > 0),
c AS (SELECT g, v, count(*) AS n FROM r GROUP BY ALL), s AS (SELECT g, sum(n)::DOUBLE AS size FROM c GROUP BY 1 HAVING sum(n) >= 8),
u AS (SELECT x.g AS a, y.g AS b, sum(CASE WHEN x.v > y.v THEN x.n * y.n WHEN x.v = y.v THEN x.n * y.n / 2 ELSE 0 END) AS u FROM c x JOIN c y ON x.g < y.g GROUP BY ALL),
t0 AS (SELECT p.g AS a, q.g AS b, c.v, sum(c.n)::DOUBLE AS t FROM s p JOIN s q ON p.g < q.g JOIN c ON c.g = p.g OR c.g = q.g GROUP BY ALL), t AS (SELECT a, b, sum(t * t * t - t) AS ties FROM t0 GROUP BY ALL),
z AS (SELECT a, b, p.size AS n, q.size AS m, u, n * m / 12 * (n + m + 1 - ties / ((n + m) * (n + m - 1))) AS var FROM u JOIN t USING (a, b) JOIN s p ON p.g = a JOIN s q ON q.g = b)
SELECT a, b, n::BIGINT AS n_a, m::BIGINT AS n_b, u::DOUBLE AS u, round(CASE WHEN var <= 0 THEN 0 ELSE greatest(abs(u - n * m / 2) - 0.5, 0) / sqrt(var) END, 6) AS z, CASE WHEN var <= 0 THEN false ELSE greatest(abs(u - n * m / 2) - 0.5, 0) / sqrt(var) > 1.9599639845 END AS apart FROM z""")
def geometry_shift_tests(spark, d):
    """Aspects of boxes, each two contributors by the rank-sum test at 5 %."""
    w, h = F.col("l_discount") * 400 - 4, F.col("l_quantity") * 2 - 6
    rows = b.read(spark, d, "lineitem").filter((w > 0) & (h > 0)).select((F.col("l_suppkey") % 8).alias("g"), (w / h).alias("v"))
    return st.mann_whitney(rows, "g", "v").select("a", "b", "n_a", "n_b", F.col("u").cast("double").alias("u"), F.round("z", 6).alias("z"), (F.col("p") < 0.05).alias("apart"))


@query("SELECT doc_id AS sample_id, sha256(coalesce(text, '')) AS digest FROM documents ORDER BY digest, doc_id LIMIT 64")
def natural_probes(spark, d):
    """The 64 samples with the least digests (the feature's own number): the same ones in any order of rows."""
    return b.samples(spark, d).select("sample_id", "digest").orderBy("digest", "sample_id").limit(64)
