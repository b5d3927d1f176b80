"""Checks of append-only logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofgrid.operators import ledger as lg
from proofgrid.plans import bindings as b
from proofgrid.plans.catalog import query


@query(f"SELECT ledger, line, linked, min(linked::INT) OVER (PARTITION BY ledger ORDER BY line) = 1 AS trusted FROM (SELECT ledger, line, prev = coalesce(lag(entry_hash) OVER (PARTITION BY ledger ORDER BY line), 'genesis') AS linked FROM ({b.LOG_SQL}))")
def ledger_links(spark, d):
    return lg.links(b.log(spark, d), genesis="genesis").select("ledger", "line", "linked", "trusted")


@query(f"""SELECT * FROM (SELECT ledger, line, CASE WHEN row_number() OVER (PARTITION BY ledger, entry_hash ORDER BY line) > 1 THEN 'entry' WHEN row_number() OVER (PARTITION BY ledger, nonce ORDER BY line) > 1 THEN 'nonce' WHEN row_number() OVER (PARTITION BY ledger, seq ORDER BY line) > 1 THEN 'seq' END AS replay FROM ({b.LOG_SQL})) WHERE replay IS NOT NULL""")
def ledger_replays(spark, d):
    return lg.replays(b.log(spark, d)).filter("replay IS NOT NULL").select("ledger", "line", "replay")


@query(f"""WITH l AS ({b.LOG_SQL}), j AS (SELECT ledger, line, seq, coalesce(max(seq) OVER (PARTITION BY ledger ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS top FROM l),
g AS (SELECT ledger, line, top + 1 AS first_missing, seq - 1 AS last_missing FROM j WHERE seq > top + 1)
SELECT ledger, line, first_missing, last_missing, CASE WHEN (SELECT count(DISTINCT l.seq) FROM l WHERE l.ledger = g.ledger AND l.seq BETWEEN first_missing AND last_missing) = last_missing - first_missing + 1 THEN 'record_reorder' ELSE 'record_deletion' END AS kind FROM g""")
def ledger_gaps(spark, d):
    return lg.gaps(b.log(spark, d))


@query(f"""WITH l AS ({b.LOG_SQL}), c AS (SELECT ledger, line, prev <> coalesce(lag(entry_hash) OVER (PARTITION BY ledger ORDER BY line), 'genesis') AS broken FROM l)
SELECT ledger, CASE WHEN broken THEN 'FAILED' WHEN before THEN 'UNTRUSTED' ELSE 'VALID' END AS status, count(*) AS n FROM (SELECT *, coalesce(bool_or(broken) OVER (PARTITION BY ledger ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before FROM c) GROUP BY ALL""")
def ledger_status(spark, d):
    rows = lg.links(b.log(spark, d), genesis="genesis")
    return rows.groupBy("ledger", F.when(~F.col("linked"), "FAILED").when(~F.col("trusted"), "UNTRUSTED").otherwise("VALID").alias("status")).agg(F.count("*").alias("n"))


#: Every tree goes up to level 62, above the root of any number of rows; a single node moves up unchanged.
@query("""WITH RECURSIVE l AS (SELECT event_type AS ledger, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos, event_id FROM events),
t(ledger, lvl, pos, h) AS (SELECT ledger, 0, pos, unhex(sha256(unhex('00') || encode('e' || event_id))) FROM l
 UNION ALL SELECT a.ledger, a.lvl + 1, a.pos // 2, CASE WHEN b.h IS NULL THEN a.h ELSE unhex(sha256(unhex('01') || a.h || b.h)) END FROM (SELECT * FROM t WHERE pos % 2 = 0 AND lvl < 62) a LEFT JOIN t b ON a.ledger = b.ledger AND a.lvl = b.lvl AND b.pos = a.pos + 1)
SELECT t.ledger, n.size, 'sha256:' || lower(hex(h)) AS root FROM t JOIN (SELECT ledger, count(*) AS size FROM l GROUP BY 1) n ON n.ledger = t.ledger WHERE lvl = 62""")
def merkle_root(spark, d):
    e = b.read(spark, d, "events").select(F.col("event_type").alias("ledger"), F.col("event_id").alias("seq"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("entry_hash"))
    return lg.merkle_roots(e)


@query("SELECT event_type || ':' || s AS anchor, s AS tree_size, CASE WHEN n < s THEN 'TRUNCATED' ELSE 'MISMATCH' END AS status FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1), (SELECT unnest([10::BIGINT, 100000000]) AS s)")
def anchor_check(spark, d):

    i = F.row_number().over(Window.partitionBy("ledger_file").orderBy("event_id"))
    e = b.read(spark, d, "events").select(F.col("event_type").alias("ledger_file"), "event_id").withColumn("line", i.cast("long")).withColumn("seq", F.col("line") - 1).withColumn("entry_hash", F.concat(F.lit("e"), F.col("event_id").cast("string")))
    a = e.select("ledger_file").distinct().select("ledger_file", F.explode(F.array(F.lit(10).cast("long"), F.lit(100000000).cast("long"))).alias("tree_size"))
    a = a.select(F.concat_ws(":", "ledger_file", F.col("tree_size").cast("string")).alias("anchor"), "ledger_file", "tree_size", F.lit("sha256:00").alias("root"))
    return lg.check_anchors(a, e)


@query("SELECT event_type AS ledger, event_id AS line, user_id AS seq, CASE WHEN k = 1 THEN 'model_binding_violation' ELSE 'config_binding_violation' END AS class FROM events, (SELECT unnest([1, 2]) AS k) WHERE event_type <> 'view' AND ((k = 1 AND user_id % 5 > 2) OR (k = 2 AND user_id % 3 > 1))")
def binding_violations(spark, d):
    body = F.to_json(F.struct(F.concat(F.lit("m"), (F.col("user_id") % 5).cast("string")).alias("model_digest"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("preprocess_digest")))
    r = b.read(spark, d, "events").select(F.col("event_type").alias("ledger"), F.col("event_id").alias("line"), F.col("user_id").alias("seq"), F.when(F.col("event_type") == "view", "header").otherwise("inference").alias("kind"), body.alias("body"))
    models = spark.createDataFrame([("m0", "p0"), ("m1", "p1"), ("m2", None)], "artifact_digest string, preprocess_digest string")
    return lg.bindings(r, models)


@query("""SELECT event_id, CASE WHEN user_id % 12 > 9 THEN 'unknown key' WHEN user_id % 12 = 3 THEN 'revoked key' WHEN user_id % 12 = 4 THEN 'key lacks the role' WHEN user_id % 12 < 3 AND ts < TIMESTAMP '2024-01-10' THEN 'before the key is valid' WHEN user_id % 12 > 5 AND ts > TIMESTAMP '2024-01-20' THEN 'after the key is valid' ELSE 'ok' END AS state FROM events""")
def key_validity(spark, d):
    keys = spark.createDataFrame([(f"k{i}", "", ["audit"] if i == 4 else ["ledger"], "2024-01-10T00:00:00Z" if i < 3 else None, "2024-01-20T00:00:00Z" if i > 5 else None, i == 3) for i in range(10)], "key_id string, public_key string, roles array<string>, not_before string, not_after string, revoked boolean")
    e = b.read(spark, d, "events").select("event_id", F.concat(F.lit("k"), (F.col("user_id") % 12).cast("string")).alias("key_id"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"))
    return lg.key_states(e, keys).select("event_id", F.coalesce("key_error", F.lit("ok")).alias("state"))


_CHECKED_SQL = f"""l AS MATERIALIZED (SELECT ledger AS ledger_file, line, seq, entry_hash, nonce, CASE WHEN line % 733 = 0 THEN 'other' ELSE ledger END AS ledger, line % 1009 <> 0 AS complete, line % 1009 <> 0 AND line % 877 <> 0 AS readable, line % 997 = 0 AS bad_key, line % 613 <> 0 AS signed,
  line % 64 = 0 AS checkpoint, CASE WHEN line % 97 = 0 AND line > 150 THEN 'broken' ELSE coalesce(lag(entry_hash) OVER (PARTITION BY ledger ORDER BY line), '{lg.GENESIS}') END AS prev FROM ({b.LOG_SQL})),
n AS (SELECT *, complete AND ledger <> first_value(ledger) OVER (PARTITION BY ledger_file ORDER BY NOT complete, line) AS foreign_ FROM l),
r AS (SELECT *, readable AND row_number() OVER (PARTITION BY ledger_file, readable, entry_hash ORDER BY line) = 1 AND row_number() OVER (PARTITION BY ledger_file, readable, nonce ORDER BY line) = 1 AND NOT foreign_ AS clean FROM n),
a AS (SELECT *, clean AND row_number() OVER (PARTITION BY ledger_file, clean, CASE WHEN complete THEN seq END ORDER BY line) = 1 AS accepted FROM r),
t AS (SELECT *, max(CASE WHEN accepted THEN seq END) OVER w AS top, arg_max(entry_hash, CASE WHEN accepted THEN seq END) OVER w AS tip FROM a WINDOW w AS (PARTITION BY ledger_file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, readable AND NOT accepted AS replay, bad_key AND readable AS forged, NOT readable OR (NOT bad_key AND NOT signed) AS modified, accepted AND seq > coalesce(top, -1) + 1 AS gap, accepted AND seq < coalesce(top, -1) + 1 AS late FROM t),
u AS (SELECT *, foreign_ OR replay OR forged OR modified OR gap OR late AS any_, accepted AND prev <> coalesce(tip, '{lg.GENESIS}') AS unlinked FROM c),
k AS (SELECT *, coalesce(bool_or(forged OR modified OR gap OR late OR (unlinked AND NOT any_)) OVER (PARTITION BY ledger_file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS broken FROM u),
f AS (SELECT *, unlinked AND NOT any_ AND NOT broken AS cut, gap AND (SELECT count(*) FROM a x WHERE x.ledger_file = k.ledger_file AND x.accepted AND x.seq > coalesce(k.top, -1) AND x.seq < k.seq) = k.seq - coalesce(k.top, -1) - 1 AS filled FROM k)"""


@query(f"""WITH {_CHECKED_SQL}
SELECT ledger_file, line, CASE WHEN any_ OR cut OR (NOT broken AND checkpoint) THEN 'FAILED' WHEN broken THEN 'UNTRUSTED' ELSE 'VALID' END AS status,
  array_to_string(list_sort(list_filter([CASE WHEN foreign_ OR replay THEN 'record_replay' END, CASE WHEN forged THEN 'signature_forgery' END, CASE WHEN modified OR cut THEN 'record_modification' END, CASE WHEN gap AND NOT filled THEN 'record_deletion' END, CASE WHEN late OR filled THEN 'record_reorder' END], lambda x: x IS NOT NULL)), ',') AS classes FROM f""")
def ledger_verdicts(spark, d):
    """Whole ledgers, with damage by line number; no checkpoint has the right root."""
    along = Window.partitionBy("ledger").orderBy("line")
    own = F.when((F.col("line") % 97 == 0) & (F.col("line") > 150), "broken").otherwise(F.coalesce(F.lag("entry_hash").over(along), F.lit(lg.GENESIS)))
    nth = lambda n: F.col("line") % n == 0
    rows = b.log(spark, d).withColumn("prev", own).select(
        F.col("ledger").alias("ledger_file"), "line", F.col("seq").cast("string").alias("seq"), "entry_hash", "nonce", "prev", F.when(nth(733), "other").otherwise(F.col("ledger")).alias("ledger"), (~nth(1009)).alias("complete"), F.when(~nth(877), "{}").alias("canonical"),
        F.when(nth(997), "unknown key").alias("key_error"), (~nth(613)).alias("signed"), F.when(nth(64), "checkpoint").otherwise("inference").alias("kind"), F.lit('{"tree_size": 1, "root": "no"}').alias("body"),
    )
    return lg.verify(rows).select("ledger_file", "line", "status", F.array_join(F.array_sort("classes"), ",").alias("classes"))
