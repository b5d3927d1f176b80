"""Profiles over customers, which extend a third of their number, and JSON limits over event texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.operators import documents, profiles
from proofgrid.plans import bindings as b
from proofgrid.plans.catalog import query

_EXTENDS = "CASE WHEN c_custkey % 97 = 5 THEN c_custkey + 1 WHEN c_custkey % 97 = 6 THEN c_custkey - 1 WHEN c_custkey % 101 = 7 THEN c_custkey + 10000000 WHEN c_custkey > 0 THEN {third} END"
_SETTINGS = ("'segment', c_mktsegment", "CASE WHEN c_custkey % 11 = 0 THEN 'limits' ELSE concat('limits.n', cast(c_custkey % 5 AS {text})) END, cast(c_nationkey AS {text})", "CASE WHEN c_custkey % 3 = 1 AND c_custkey % 11 > 0 THEN concat('limits.deep.x', cast(c_custkey % 2 AS {text})) END, c_name")

_SQL = f"""p AS (SELECT c_custkey AS name, {_EXTENDS.format(third="c_custkey // 3")} AS extends FROM customer),
s AS ({" UNION ALL ".join(f"SELECT * FROM (SELECT c_custkey AS source, {x.format(text='VARCHAR')} FROM customer) t(source, path, value)" for x in _SETTINGS)}),
up(name, ancestor, depth, trail, cycle) AS (SELECT name, name, 0, [name], false FROM p UNION ALL
 SELECT u.name, p.extends, u.depth + 1, list_append(u.trail, p.extends), list_contains(u.trail, p.extends) FROM up u JOIN p ON p.name = u.ancestor WHERE p.extends IS NOT NULL AND NOT u.cycle),
e AS (SELECT name, 'cycle: ' || array_to_string(trail, ' -> ') AS error FROM up WHERE cycle UNION ALL SELECT name, 'unknown: ' || array_to_string(trail, ' -> ') FROM up WHERE ancestor NOT IN (SELECT name FROM p)),
r AS (SELECT up.name, depth, source, path, value FROM up JOIN s ON s.source = up.ancestor WHERE path IS NOT NULL AND up.name NOT IN (SELECT name FROM e))"""


def _tables(spark, d):
    rows = b.read(spark, d, "customer")
    own = rows.selectExpr("c_custkey AS name", f"{_EXTENDS.format(third='c_custkey div 3')} AS extends")
    texts = [rows.selectExpr("c_custkey AS name", f"stack(1, {x.format(text='STRING')}) AS (path, value)") for x in _SETTINGS]
    return own, texts[0].unionByName(texts[1]).unionByName(texts[2]).filter("path IS NOT NULL")


@query(f"WITH RECURSIVE {_SQL} SELECT name, path, value, source FROM r WHERE NOT EXISTS (SELECT 1 FROM r q WHERE q.name = r.name AND q.depth < r.depth AND (q.path = r.path OR starts_with(r.path, q.path || '.') OR starts_with(q.path, r.path || '.')))")
def effective_profiles(spark, d):
    return profiles.effective(*_tables(spark, d))[0]


@query(f"WITH RECURSIVE {_SQL} SELECT * FROM e")
def profile_errors(spark, d):
    return profiles.effective(*_tables(spark, d))[1]


@query("""SELECT event_id, CASE WHEN event_id % 8 IN (1, 2, 6) OR (event_id % 8 = 0 AND event_id % 9 > 4) OR (event_id % 8 = 3 AND event_id % 13 > 8) THEN NULL WHEN event_id % 8 = 0 THEN event_id % 9 + 2 WHEN event_id % 8 = 3 THEN 3 WHEN event_id % 8 = 4 THEN 1 ELSE 2 END::BIGINT AS depth,
  CASE WHEN event_id % 8 IN (1, 2, 6) OR (event_id % 8 = 0 AND event_id % 9 > 4) OR (event_id % 8 = 3 AND event_id % 13 > 8) THEN NULL WHEN event_id % 8 = 0 THEN event_id % 9 + 3 WHEN event_id % 8 = 3 THEN 3 + 2 * (event_id % 13) WHEN event_id % 8 = 4 THEN 1 ELSE 1 + len(json_keys(props)) END::BIGINT AS n_values,
  CASE event_id % 8 WHEN 0 THEN CASE WHEN event_id % 9 > 4 THEN 'depth' END WHEN 1 THEN 'malformed' WHEN 2 THEN 'malformed' WHEN 3 THEN CASE WHEN event_id % 13 > 8 THEN 'values' END WHEN 6 THEN 'bytes' END AS error FROM events""")
def json_limits(spark, d):
    """Eight kinds of texts by id: nested arrays, NaN, cut off, an object of pairs, a scalar, the event's own, one too long."""
    i = F.col("event_id")
    nested = F.concat(F.repeat(F.lit("["), (i % 9 + 1).cast("int")), F.lit("1, 2"), F.repeat(F.lit("]"), (i % 9 + 1).cast("int")))
    many = F.concat(F.lit('{"a": [null'), F.repeat(F.lit(', "x", {}'), (i % 13).cast("int")), F.lit("]}"))
    text = F.when(i % 8 == 0, nested).when(i % 8 == 1, '{"a": NaN}').when(i % 8 == 2, '{"a": [1, 2').when(i % 8 == 3, many).when(i % 8 == 4, '"é"').when(i % 8 == 6, F.repeat(F.lit(" 1"), 400)).otherwise(F.col("props"))
    rows = b.read(spark, d, "events").select("event_id", text.alias("t"))
    return documents.measured(rows, "event_id", "t", 500, 6, 20).withColumnRenamed("id", "event_id")
