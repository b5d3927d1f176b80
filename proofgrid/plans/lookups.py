"""Filters, pages, counts and latest rows over governance-like tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofgrid.functions.columns import DISPOSITIONS, SEVERITIES, is_unsafe_path, rank_of, safe_text
from proofgrid.operators.risk import worst_by
from proofgrid.plans import bindings as b
from proofgrid.plans.catalog import query


@query(f"SELECT finding_id, severity, disposition FROM ({b.FINDINGS_SQL}) WHERE scan_id = 3 AND severity = 'HIGH' ORDER BY finding_id LIMIT 50 OFFSET 20")
def findings_page(spark, d):
    f = b.findings(spark, d).filter("scan_id = 3 AND severity = 'HIGH'")
    return f.select("finding_id", "severity", "disposition").orderBy("finding_id").offset(20).limit(50)


@query(f"SELECT count(*) AS total FROM ({b.FINDINGS_SQL}) WHERE scan_id = 3 AND severity = 'HIGH'")
def findings_total(spark, d):
    return b.findings(spark, d).filter("scan_id = 3 AND severity = 'HIGH'").agg(F.count("*").alias("total"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderstatus = upper('f') ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 40")
def scans_list(spark, d):
    o = b.read(spark, d, "orders").filter(F.col("o_orderstatus") == F.upper(F.lit("f")))
    return o.orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).limit(40).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error' AND user_id = 8 ORDER BY ts DESC, event_id DESC LIMIT 30")
def jobs_list(spark, d):
    e = b.read(spark, d, "events").filter("event_type = 'error' AND user_id = 8")
    return e.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(30).select("event_id", "event_type")


@query("SELECT event_id, user_id FROM events WHERE user_id = 8 ORDER BY event_id DESC LIMIT 25")
def audit_list(spark, d):
    return b.read(spark, d, "events").filter("user_id = 8").select("event_id", "user_id").orderBy(F.col("event_id").desc()).limit(25)


@query("""SELECT o_custkey AS subject, o_orderkey AS decision, o_orderstatus AS status, pending FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS i, count(*) FILTER (o_orderstatus = 'P') OVER (PARTITION BY o_custkey) AS pending
  FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')) WHERE i = 1""")
def latest_decision(spark, d):
    page = b.read(spark, d, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    o = b.read(spark, d, "orders").join(page, "o_custkey", "left_semi")
    last = o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("x"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"))
    return last.select(F.col("o_custkey").alias("subject"), F.col("x.o_orderkey").alias("decision"), F.col("x.o_orderstatus").alias("status"), "pending")


@query("SELECT event_id AS seq, event_type FROM events WHERE event_id > 900 ORDER BY event_id LIMIT 100")
def events_tail(spark, d):
    return b.read(spark, d, "events").filter("event_id > 900").select(F.col("event_id").alias("seq"), "event_type").orderBy("seq").limit(100)


@query(f"""SELECT scan_id, s.severity, count(f.finding_id) AS n FROM (SELECT DISTINCT scan_id FROM ({b.FINDINGS_SQL})) x
  CROSS JOIN (SELECT unnest(['INFO','LOW','MEDIUM','HIGH','CRITICAL']) AS severity) s LEFT JOIN ({b.FINDINGS_SQL}) f USING (scan_id, severity) GROUP BY ALL""")
def severity_summary(spark, d):
    counts = b.findings(spark, d).groupBy("scan_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    return counts.select("scan_id", F.explode(F.array(*(F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in SEVERITIES))).alias("x")).select("scan_id", "x.*")


@query(f"SELECT subject, ['ACCEPT','REVIEW','QUARANTINE'][max(CASE disposition WHEN 'ACCEPT' THEN 1 WHEN 'REVIEW' THEN 2 ELSE 3 END)] AS disposition FROM ({b.FINDINGS_SQL}) GROUP BY subject")
def asset_max_disposition(spark, d):
    return worst_by(b.findings(spark, d), "subject", DISPOSITIONS)


@query(f"SELECT finding_id, i FROM (SELECT finding_id, row_number() OVER (PARTITION BY scan_id ORDER BY list_position(['INFO','LOW','MEDIUM','HIGH','CRITICAL'], severity) DESC, list_position(['ACCEPT','REVIEW','QUARANTINE'], disposition) DESC, confidence DESC, finding_id) AS i FROM ({b.FINDINGS_SQL})) WHERE i <= 20")
def findings_top(spark, d):
    order = Window.partitionBy("scan_id").orderBy(rank_of(F.col("severity")).desc(), rank_of(F.col("disposition"), DISPOSITIONS).desc(), F.col("confidence").desc(), "finding_id")
    return b.findings(spark, d).withColumn("i", F.row_number().over(order)).filter("i <= 20").select("finding_id", "i")


@query("SELECT lang AS label, count(*) AS n, count(DISTINCT source) AS contributors, round(count(*) FILTER (length(text) > 1000) / count(*), 4) AS long_share FROM documents GROUP BY lang")
def dataset_summary(spark, d):
    return b.read(spark, d, "documents").groupBy(F.col("lang").alias("label")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("contributors"), F.round(F.count_if(F.length("text") > 1000) / F.count("*"), 4).alias("long_share"))


@query("SELECT coalesce(source, 'unattributed') AS contributor, count(*) AS n FROM documents GROUP BY 1")
def contributor_counts(spark, d):
    return b.thin_samples(spark, d).groupBy(F.coalesce("contributor", F.lit("unattributed")).alias("contributor")).agg(F.count("*").alias("n"))


@query("SELECT count(lang) >= 20 AND count(lang) >= 0.5 * count(*) AND count(DISTINCT lang) >= 2 AS has_labels, count(DISTINCT source) >= 2 AS has_contributors, count(*) AS n FROM documents")
def capabilities(spark, d):
    s = b.thin_samples(spark, d)
    return s.agg(((F.count("label") >= 20) & (F.count("label") >= 0.5 * F.count("*")) & (F.count_distinct("label") >= 2)).alias("has_labels"), (F.count_distinct("contributor") >= 2).alias("has_contributors"), F.count("*").alias("n"))


@query("""SELECT conv_id, turn, CASE WHEN turn = prior + 1 THEN 'ok' ELSE 'gap' END AS state FROM (
  SELECT conv_id, turn, coalesce(lag(turn) OVER (PARTITION BY conv_id ORDER BY turn), -1) AS prior FROM conversations WHERE (conv_id + turn) % 11 <> 0)""")
def turn_gaps(spark, d):
    c = b.read(spark, d, "conversations").filter((F.col("conv_id") + F.col("turn")) % 11 != 0)
    prior = F.coalesce(F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(-1))
    return c.select("conv_id", "turn", F.when(F.col("turn") == prior + 1, "ok").otherwise("gap").alias("state"))


@query("SELECT event_id, props->>'$.k' AS k FROM events WHERE (props->>'$.k')::INT > 90")
def json_lookup(spark, d):
    k = F.get_json_object("props", "$.k")
    return b.read(spark, d, "events").select("event_id", k.alias("k")).filter(F.col("k").cast("int") > 90)


@query("SELECT page_id, length(replace(url, '\\', '/')) AS n, url LIKE '%/../%' AS unsafe, substr(url, 1, 128) AS shown FROM pages")
def text_guards(spark, d):
    p = b.read(spark, d, "pages").select("page_id", "url")
    inner = F.substring_index("url", "://", -1)
    return p.select("page_id", F.length(F.translate("url", "\\", "/")).alias("n"), is_unsafe_path(inner).alias("unsafe"), safe_text(F.col("url")).alias("shown"))


@query("SELECT count(*) FILTER (o_orderstatus <> 'F') AS to_fail, max(o_orderkey) + 1 AS next_seq, o_custkey % 7 AS scan_id FROM orders GROUP BY 3")
def crash_reconciliation(spark, d):
    return b.read(spark, d, "orders").groupBy((F.col("o_custkey") % 7).alias("scan_id")).agg(F.count_if(F.col("o_orderstatus") != "F").alias("to_fail"), (F.max("o_orderkey") + 1).alias("next_seq"))


@query("SELECT coalesce(props->>'$.state', 'ACTIVE') AS state, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def asset_status(spark, d):
    return b.read(spark, d, "events").groupBy(F.coalesce(F.get_json_object("props", "$.state"), F.lit("ACTIVE")).alias("state"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
