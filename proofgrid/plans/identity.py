"""Identity of models: an order is a model with its line items as operators; suppliers' items are the values of tensors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofgrid.operators import architecture as ar
from proofgrid.plans import bindings as b
from proofgrid.plans.catalog import query


_ORDER = "l_partkey, l_suppkey, l_linenumber, l_extendedprice"


def _operators(spark, d):
    """Line items with k, their place in their order."""
    along = Window.partitionBy("l_orderkey").orderBy(*_ORDER.split(", "))
    return b.read(spark, d, "lineitem").withColumn("k", F.row_number().over(along)).withColumn("op", F.concat("l_returnflag", "l_linestatus"))


def _graphs(spark, d):
    """Operators take two names of six, which later operators define anew, and give one; two of the names are parameters."""
    li = _operators(spark, d)
    text = lambda x: F.concat(F.lit("x"), x.cast("string"))
    ops = li.select(F.col("l_orderkey").alias("model"), "k", "op", F.concat(F.lit("tax="), F.floor(F.col("l_tax") * 100 + 0.5).cast("string")).alias("attrs"), F.array(text(F.col("l_partkey") % 6), text(F.col("l_suppkey") % 6)).alias("inputs"), F.array(text(F.col("l_partkey") % 4)).alias("outputs"))
    models = b.read(spark, d, "orders").select(F.col("o_orderkey").alias("model"), (F.col("o_custkey") % 3).alias("s"))
    inputs = models.select("model", F.lit(0).alias("i"), F.lit("x0").alias("name"), F.concat(F.lit("3x"), F.col("s").cast("string")).alias("shape"))
    outputs = models.select("model", F.lit(0).alias("i"), F.lit("10").alias("shape"))
    shapes = models.select("model", F.explode(F.array(F.struct(F.lit("x4").alias("name"), F.lit("3x3").alias("shape")), F.struct(F.lit("x5").alias("name"), F.concat(F.lit("8x"), F.col("s").cast("string")).alias("shape")))).alias("p")).select("model", "p.name", "p.shape")
    return ops, inputs, outputs, shapes


@query(f"""WITH m AS (SELECT o_orderkey AS model, (o_custkey % 3)::VARCHAR AS s FROM orders),
o AS (SELECT l_orderkey AS model, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS k, l_returnflag || l_linestatus AS op, 'tax=' || floor(l_tax * 100 + 0.5)::BIGINT AS attrs, ['x' || (l_partkey % 6), 'x' || (l_suppkey % 6)] AS ins, 'x' || (l_partkey % 4) AS made FROM lineitem),
u AS (SELECT model, k, unnest(ins) AS name, unnest([0, 1]) AS place FROM o),
r AS (SELECT u.model, u.k, u.place, CASE u.name WHEN 'x4' THEN 'p3x3' WHEN 'x5' THEN 'p8x' || m.s ELSE coalesce('t' || (SELECT max(k) FROM o WHERE o.model = u.model AND o.k < u.k AND o.made = u.name) || '.0', CASE u.name WHEN 'x0' THEN 'in0' ELSE '?' END) END AS ref FROM u JOIN m USING (model)),
n AS (SELECT model, k, sha256(op || chr(10) || attrs || chr(10) || string_agg(ref, ' ' ORDER BY place)) AS node FROM r JOIN o USING (model, k) GROUP BY model, k, op, attrs)
SELECT model, count(*) AS n_ops, sha256('3x' || any_value(s) || '|10|' || string_agg(node, '' ORDER BY k)) AS digest FROM n JOIN m USING (model) GROUP BY model""")
def architecture_digest(spark, d):
    return ar.architecture_digests(*_graphs(spark, d))


_CENTS = "floor(l_extendedprice * 100 + 0.5)::BIGINT"


@query(f"""WITH RECURSIVE v AS (SELECT l_suppkey % 7 AS model, 'w' || l_linenumber AS tensor, row_number() OVER (PARTITION BY l_suppkey % 7, l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx, {_CENTS} AS x FROM lineitem),
l AS (SELECT model, tensor, idx // 64 AS pos, count(*) AS n, unhex(sha256(unhex('00') || encode(sha256(string_agg(x::VARCHAR, ',' ORDER BY idx))))) AS h FROM v GROUP BY ALL),
t(model, tensor, lvl, pos, h) AS (SELECT model, tensor, 0, pos, h FROM l
 UNION ALL SELECT a.model, a.tensor, a.lvl + 1, a.pos // 2, CASE WHEN b.h IS NULL THEN a.h ELSE unhex(sha256(unhex('01') || a.h || b.h)) END FROM (SELECT * FROM t WHERE pos % 2 = 0 AND lvl < 20) a LEFT JOIN t b ON a.model = b.model AND a.tensor = b.tensor AND a.lvl = b.lvl AND b.pos = a.pos + 1),
r AS (SELECT model, tensor, s.n, 'sha256:' || lower(hex(h)) AS root FROM t JOIN (SELECT model, tensor, sum(n) AS n FROM l GROUP BY ALL) s USING (model, tensor) WHERE lvl = 20)
SELECT model, count(*) AS n_tensors, sum(n)::BIGINT AS n_values, sha256(string_agg(tensor || chr(10) || 'int' || chr(10) || n || chr(10) || root, chr(10) || chr(10) ORDER BY tensor)) AS digest FROM r GROUP BY model""")
def parameter_digest(spark, d):
    place = Window.partitionBy("model", "tensor").orderBy("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    li = b.read(spark, d, "lineitem").withColumn("model", F.col("l_suppkey") % 7).withColumn("tensor", F.concat(F.lit("w"), F.col("l_linenumber").cast("string")))
    values = li.select("model", "tensor", (F.row_number().over(place) - 1).alias("idx"), F.floor(F.col("l_extendedprice") * 100 + 0.5).cast("long").alias("x"))
    tensors = li.groupBy("model", "tensor").agg(F.lit("int").alias("dtype"), F.count("*").cast("string").alias("shape"))
    return ar.parameter_digests(values, tensors, F.col("x").cast("string"), 64)


@query()
def alignment_of_operators(spark, d):
    """The operators of each order against those of the customer's order before."""
    li = _operators(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "op"))), lambda x: x["op"]).alias("ops"))
    along = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    pairs = b.read(spark, d, "orders").select("o_orderkey", "o_custkey").join(li, "o_orderkey").select("o_orderkey", F.lag("ops").over(along).alias("reference"), F.col("ops").alias("candidate")).filter("reference IS NOT NULL")
    out = ar.differences(ar.aligned(pairs))
    return out.select("o_orderkey", "tag", "i1", "i2", "j1", "j2", "after")
