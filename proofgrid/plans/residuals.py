"""Blended patterns over embeddings as residuals: every tenth vector carries a fixed wave, every fortieth a second one."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.operators import residuals as rs
from proofgrid.plans import bindings as b
from proofgrid.plans.catalog import query

THRESHOLD = 0.6
_WAVE = "CASE WHEN vec_id % 10 = 3 THEN 0.5 * sin(0.9 * {k}) WHEN vec_id % 40 = 7 THEN 0.5 * cos(2.3 * {k}) ELSE 0.0 END"


def _units(spark, d):
    wave = F.expr(f"transform(sequence(0, size(embedding) - 1), k -> cast({_WAVE.format(k='k')} as double))")
    rows = b.vectors(spark, d).select("vec_id", F.zip_with(F.col("embedding").cast("array<double>"), wave, lambda x, y: x + y).alias("v"))
    return rs.centred(rows, "v", "vec_id")


@query(f"""WITH RECURSIVE w AS (SELECT vec_id, list_transform(embedding, lambda x, i: x::DOUBLE + {_WAVE.format(k="(i - 1)")}) AS v FROM embeddings),
m AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(x) AS a FROM (SELECT unnest(v) AS x, unnest(range(len(v))) AS i FROM w) GROUP BY 1)),
c AS (SELECT vec_id, list_transform(v, lambda x, i: x - m[i]) AS v FROM w, m),
u AS MATERIALIZED (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM c),
p AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_inner_product(a.u, b.u) >= {THRESHOLD}),
r AS (SELECT DISTINCT i AS node, i AS seen FROM p UNION SELECT r.node, p.j FROM r JOIN p ON p.i = r.seen),
k AS (SELECT node, min(seen) AS component FROM r GROUP BY 1),
z AS (SELECT component FROM k GROUP BY 1 HAVING count(*) BETWEEN 6 AND 0.4 * (SELECT count(*) FROM u)),
o AS MATERIALIZED (SELECT component, vec_id, u FROM k JOIN z USING (component) JOIN u ON vec_id = node),
t AS (SELECT component, list(x ORDER BY i) AS t FROM (SELECT component, i, avg(x) AS x FROM (SELECT component, unnest(u) AS x, unnest(range(len(u))) AS i FROM o) GROUP BY ALL) GROUP BY 1),
e AS MATERIALIZED (SELECT o.* FROM o JOIN t USING (component) WHERE list_inner_product(u, t) / sqrt(list_inner_product(t, t)) >= sqrt({THRESHOLD})),
s AS (SELECT x.component, count(DISTINCT x.vec_id) AS n, sum(CASE WHEN x.vec_id <> y.vec_id THEN list_inner_product(x.u, y.u) END) AS total FROM e x JOIN e y ON x.component = y.component GROUP BY 1)
SELECT component, n, round(total / (n * (n - 1)), 6) AS consensus FROM s WHERE n >= 6 AND total / (n * (n - 1)) >= {THRESHOLD}""")
def blended_groups(spark, d):
    found, _ = rs.groups(_units(spark, d), THRESHOLD)
    return found.select("component", "n", F.round("consensus", 6).alias("consensus"))
