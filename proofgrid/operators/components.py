"""Connected components of a pair table, by alternating large-star and small-star steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_table(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, which cuts its lineage. On a cluster
    ``spark.checkpoint.dir`` has to be set; only a local session makes a folder of its own."""
    spark: SparkSession = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='proofgrid-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (u, v) with u > v; the result has the same form."""
    up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    low = edges.select("u", "v").union(up).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = up.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    return large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u > v").distinct()


def connected_components(edges: DataFrame, u: str, v: str, most: int = 60) -> DataFrame:
    """(node, component): for every node on an edge, the least node that is reachable from it.

    Edges may be repeated, run either way or be loops; rows with a null end are ignored. Nodes without any
    edge are not in the result. The number of rounds grows with the logarithm of the longest path; each
    round's edges are written to the shared folder, so that a lost executor costs one round at most.
    """
    a, b = F.col(u), F.col(v)
    loops = edges.filter(a == b).select(a.alias("node"), a.alias("component"))
    now = shared_table(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    sign = None
    for _ in range(most):
        seen = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
        if not seen[0] or seen == sign:
            break
        sign = seen
        now = shared_table(_stars(now))
    else:
        raise RuntimeError(f"no fixed point after {most} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v"), F.col("v")))
    return nodes.union(loops).groupBy("node").agg(F.min("component").alias("component"))
