"""JSON within limits: how deep a text nests and how many values it holds, by unfolding it level by level as VARIANT."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.operators.components import shared_table

# The limits of a document.
MAX_BYTES, MAX_DEPTH, MAX_VALUES = 64 << 20, 64, 5_000_000


def measured(rows: DataFrame, id_col: str, text: str, max_bytes: int = MAX_BYTES, max_depth: int = MAX_DEPTH, max_values: int = MAX_VALUES) -> DataFrame:
    """(id, depth, n_values, error) of every row; ids are unique.

    A scalar alone has depth 1. error: ``bytes``, ``malformed`` (what isn't JSON, NaN and infinities, names that occur twice
    in one object, and nulls), ``depth`` or ``values``; rows with one have a null depth and n_values. Each level is one step
    over what is still open; a text beyond a limit is left at once, so the work is bounded whatever it holds.
    """
    own = rows.select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    parsed = shared_table(own.select("id", (F.octet_length("t") > max_bytes).alias("large"), F.when(F.octet_length("t") <= max_bytes, F.try_parse_json("t")).alias("v")))
    level, now, counts = 1, parsed.filter("v IS NOT NULL").select("id", "v"), None
    while True:
        here = now.groupBy("id").agg(F.count("*").alias("n")).withColumn("level", F.lit(level))
        counts = shared_table(here if counts is None else counts.unionByName(here))
        if counts.filter(F.col("level") == level).isEmpty() or level > max_depth:
            break
        open_ = counts.groupBy("id").agg(F.sum("n").alias("n")).filter(F.col("n") <= max_values).select("id")
        inner = now.join(open_, "id", "left_semi").lateralJoin(now.sparkSession.tvf.variant_explode(F.col("v").outer())).select("id", F.col("value").alias("v"))
        now, level = shared_table(inner), level + 1
    size = counts.groupBy("id").agg(F.max("level").alias("depth"), F.sum("n").alias("n_values"))
    out = parsed.select("id", "large", F.col("v").isNull().alias("bad")).join(size, "id", "left")
    error = F.when(F.col("large"), "bytes").when(F.col("bad"), "malformed").when(F.col("n_values") > max_values, "values").when(F.col("depth") > max_depth, "depth")
    out = out.withColumn("error", error)
    return out.select("id", *(F.when(F.col("error").isNull(), F.col(c)).cast("long").alias(c) for c in ("depth", "n_values")), "error")
