"""Profiles that extend others: lineage by a recursive query, and a deep merge of their settings.

``profiles`` (name, extends) and ``settings`` (name, path, value): a setting's path is dotted, and a map is its settings'
common start. A profile has its parent's settings but where it sets the path itself, a path above it (it replaced the map),
or one below it (it put a map there). What extends itself through others, or a profile that doesn't exist, is an error
of every profile that comes upon it, and has no settings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.operators.components import shared_table

_LINEAGE = """
WITH RECURSIVE up(name, ancestor, depth, trail, cycle) AS (
  SELECT name, name, 0, array(name), false FROM {profiles}
  UNION ALL
  SELECT u.name, p.extends, u.depth + 1, array_append(u.trail, p.extends), array_contains(u.trail, p.extends)
  FROM up u JOIN {profiles} p ON p.name = u.ancestor WHERE p.extends IS NOT NULL AND NOT u.cycle)
SELECT * FROM up"""


def lineage(profiles: DataFrame) -> DataFrame:
    """(name, ancestor, depth, trail, cycle): a profile and all that it extends, as a table; the recursion ends at a name
    that is on its trail already."""
    spark, key = profiles.sparkSession, "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "-1")  # the limit counts rows, not rounds
    try:
        return shared_table(spark.sql(_LINEAGE, profiles=profiles))
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def errors(chain: DataFrame, profiles: DataFrame) -> DataFrame:
    """(name, error): cycle or unknown, with the names on the way."""
    lost = chain.join(profiles.select(F.col("name").alias("ancestor")), "ancestor", "left_anti")
    said = chain.filter("cycle").select("name", F.lit("cycle").alias("kind"), "trail").unionByName(lost.select("name", F.lit("unknown").alias("kind"), "trail"))
    return said.select("name", F.concat("kind", F.lit(": "), F.array_join(F.transform("trail", lambda x: x.cast("string")), " -> ")).alias("error"))


def effective(profiles: DataFrame, settings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, path, value, source) of the profiles that resolve, and the errors of the others."""
    chain = lineage(profiles)
    wrong = shared_table(errors(chain, profiles))
    sound = chain.join(wrong.select("name").distinct(), "name", "left_anti").select("name", F.col("ancestor").alias("source"), "depth")
    rows = shared_table(sound.join(settings.withColumnRenamed("name", "source"), "source"))
    parts = F.split("path", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))
    starts = rows.withColumn("start", F.explode(F.when(F.size(parts) > 1, above)))
    nearest = rows.groupBy("name", "path").agg(F.min("depth").alias("own"))
    below = starts.groupBy("name", F.col("start").alias("path")).agg(F.min("depth").alias("below"))
    over = starts.join(nearest.select("name", F.col("path").alias("start"), F.col("own").alias("over")), ["name", "start"]).groupBy("name", "path", "depth").agg(F.min("over").alias("over"))
    out = rows.join(nearest, ["name", "path"]).join(below, ["name", "path"], "left").join(over, ["name", "path", "depth"], "left")
    kept = out.filter((F.col("depth") == F.col("own")) & (F.col("depth") <= F.coalesce("below", F.col("depth"))) & (F.col("depth") <= F.coalesce("over", F.col("depth"))))
    return kept.select("name", "path", "value", "source"), wrong
