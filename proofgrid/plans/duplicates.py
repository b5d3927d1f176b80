"""Near duplicates by both hashes with mirrored copies and cosine confirmation, over documents as images."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.operators import duplicates as dup
from proofgrid.operators.components import shared_table
from proofgrid.plans import bindings as b
from proofgrid.plans.catalog import query

#: All pairs of classes, by a theta join.
PAIRS_SQL = f"""{b.IMPRINTS_SQL},
k AS MATERIALIZED (SELECT min(i) AS i, max(i) AS l, p, d, pf, df FROM h GROUP BY p, d, pf, df),
t AS (SELECT a.i AS i, b.i AS j, bit_count(xor(a.p, b.p)) AS p1, bit_count(xor(a.d, b.d)) AS d1, bit_count(xor(a.p, b.pf)) AS p2, bit_count(xor(a.d, b.df)) AS d2,
        CASE WHEN b.i < a.l THEN bit_count(xor(b.p, a.pf)) ELSE 99 END AS p3, bit_count(xor(b.d, a.df)) AS d3 FROM k a JOIN k b ON a.i < b.i),
c AS MATERIALIZED (SELECT i, j, CASE WHEN p1 <= 8 AND d1 <= 10 THEN 1 WHEN p2 <= 8 AND d2 <= 10 THEN 2 ELSE 3 END AS way, p1, d1, p2, d2, p3, d3 FROM t WHERE (p1 <= 8 AND d1 <= 10) OR (p2 <= 8 AND d2 <= 10) OR (p3 <= 8 AND d3 <= 10)),
o AS MATERIALIZED (SELECT h.i AS id, h.v, h.nn, k.i AS i FROM h JOIN k USING (p, d, pf, df)),
s AS (SELECT c.i, c.j, max(CASE WHEN x.nn > 0 AND y.nn > 0 THEN list_inner_product(x.v, y.v) / sqrt(x.nn) / sqrt(y.nn) END) AS cosine FROM c JOIN o x ON x.i = c.i JOIN o y ON y.i = c.j GROUP BY 1, 2),
e AS (SELECT c.i, c.j, CASE way WHEN 1 THEN p1 WHEN 2 THEN p2 ELSE p3 END::INT AS phash_distance, CASE way WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END::INT AS dhash_distance, way > 1 AS mirrored, round(cosine, 8) AS cosine FROM c JOIN s USING (i, j)),
q AS (SELECT * FROM e WHERE cosine >= 0.9 OR (phash_distance <= 2 AND dhash_distance <= 3))"""


@query(f"WITH {PAIRS_SQL} SELECT * FROM q")
def near_duplicate_pairs(spark, d):
    out, _ = dup.links(shared_table(b.imprints(spark, d)))
    return out.select("i", "j", "phash_distance", "dhash_distance", "mirrored", F.round("cosine", 8).alias("cosine"))


@query(f"""WITH RECURSIVE {PAIRS_SQL}, z AS (SELECT i AS a, j AS b FROM q UNION SELECT j, i FROM q UNION SELECT i, id FROM o WHERE id <> i UNION SELECT id, i FROM o WHERE id <> i),
r AS (SELECT DISTINCT a AS node, a AS seen FROM z UNION SELECT r.node, z.b FROM r JOIN z ON z.a = r.seen)
SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def near_duplicate_components(spark, d):
    return dup.components(shared_table(b.imprints(spark, d)))


@query(f"""WITH RECURSIVE {PAIRS_SQL}, z AS (SELECT i AS a, j AS b FROM q UNION SELECT j, i FROM q UNION SELECT i, id FROM o WHERE id <> i UNION SELECT id, i FROM o WHERE id <> i),
r AS (SELECT DISTINCT a AS node, a AS seen FROM z UNION SELECT r.node, z.b FROM r JOIN z ON z.a = r.seen),
n AS (SELECT node, min(seen) AS component FROM r GROUP BY 1),
who0 AS (SELECT component, source, count(*) AS m FROM n JOIN documents ON doc_id = node GROUP BY ALL),
who AS (SELECT component, first(source ORDER BY m DESC, source NULLS LAST) AS dominant, max(m)::BIGINT AS dominant_n, sum(m)::BIGINT AS size FROM who0 GROUP BY 1),
zs AS (SELECT i, count(*) AS n FROM o GROUP BY 1),
w2 AS (SELECT component, sum(x.n * y.n)::DOUBLE AS k, sum(x.n * y.n * phash_distance)::DOUBLE AS s FROM q JOIN n ON n.node = q.i JOIN zs x ON x.i = q.i JOIN zs y ON y.i = q.j GROUP BY 1),
w1 AS (SELECT component, sum(zs.n * (zs.n - 1) // 2)::DOUBLE AS k FROM n JOIN zs ON zs.i = n.node GROUP BY 1)
SELECT component, size, dominant, dominant_n, round(coalesce(w2.s, 0) / (w1.k + coalesce(w2.k, 0)), 8) AS mean_distance FROM who JOIN w1 USING (component) LEFT JOIN w2 USING (component)""")
def near_duplicate_clusters(spark, d):
    """Size, mean hash distance over the linked pairs of rows, and the contributor with most rows, of each cluster."""
    return dup.clusters(shared_table(b.imprints(spark, d)), b.thin_samples(spark, d).select("sample_id", "contributor")).select("component", "size", "dominant", "dominant_n", F.round("mean_distance", 8).alias("mean_distance"))
