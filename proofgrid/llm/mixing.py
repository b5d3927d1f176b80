"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Sources, in code point order with null last, take the weights in turn. Together they take ``share`` times all
words; no source takes more than ``most`` times its words, and what is cut is shared again by weight. That
fixed point has a closed form: with sources by ascending limit over weight, the level is the largest of
(total - limits before) / (weights from here on), and a target is the level times the weight, or the limit.

Each source has a weight schedule over training time 0 to 1: straight lines between knots at equal distances.
Its integral, scaled to the target, is the cumulative demand for the source's words. Documents stand in the
order of a hash of their id; the words before a document (in its pass over the source) are a demand, and the
time at which the integral reaches it is the document's training position. Rows are range-sorted by position.

A source's order is cut into 4,096 buckets by the hash, so running sums are over one bucket and over the
bucket totals of one source; no task holds a source. A null text has size 0; documents of size 0 take part
with taken 0. A null source is a source of its own. Rows that repeat count each; of rows that share an id
and a size, it does not matter which comes first. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.llm.common import SPACE, WORD, row_of

WEIGHTS = (5, 2, 1)
#: Knots of the schedules, taken in turn like the weights: falling, level and rising.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def _when_reached(y: Column, knots: Sequence[float]) -> Column:
    """The time at which the integral of a schedule reaches the fraction ``y`` of its whole."""
    k = len(knots) - 1
    areas = [(a + b) / 2 / k for a, b in zip(knots[:-1], knots[1:], strict=True)]
    need = y * F.lit(float(sum(areas)))
    out, before = None, float(sum(areas[:-1]))
    for j in range(k - 1, -1, -1):
        slope = (knots[j + 1] - knots[j]) * k
        rest = need - F.lit(before)
        if slope:
            step = (F.sqrt(F.greatest(F.lit(knots[j] * knots[j]) + F.lit(2.0 * slope) * rest, F.lit(0.0))) - F.lit(float(knots[j]))) / F.lit(float(slope))
        else:
            step = rest / F.lit(float(knots[j]))
        here = F.lit(j / k) + step
        out = here if out is None else F.when(need < F.lit(before + areas[j]), here).otherwise(out)
        before -= areas[j - 1] if j else 0
    return out


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """``sizes`` (source, source_size), one row a source, with ord (0 for the first source) and target."""
    ord_ = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    out = sizes.withColumn("ord", ord_)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("ord") % len(weights) + 1).cast("int")).cast("long")
    out = out.withColumn("weight", weight).withColumn("limit_", F.lit(most) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("limit_") / F.col("weight"), "ord")
    before = F.coalesce(F.sum("limit_").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    total = F.lit(float(share)) * F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = out.withColumn("level", (total - before) / onward)
    level = F.max("level").over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return out.withColumn("target", F.least(F.col("limit_").cast("double"), level * F.col("weight"))).drop("level", "limit_", "weight")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, share: float = 1.5, most: int = 2, schedules: Sequence[Sequence[float]] = SCHEDULES, whole: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, words_before, taken): see the module.

    words_before: the words of the source before this document. With ``whole``, row holds the columns of ``docs``.
    """
    mark = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    own = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *([row_of(docs).alias("row")] if whole else [])]
    thin = docs.select(*own, size.alias("_size"), F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("_key"), mark.alias("_mark"))
    thin = thin.withColumn("_bucket", F.substring("_mark", 1, 3)).repartition("_key", "_bucket")
    part = thin.groupBy("_key", "_bucket").agg(F.sum("_size").alias("_words"), F.first("source", ignorenulls=True).alias("_source"))
    before = F.coalesce(F.sum("_words").over(Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = part.withColumn("_before", before)
    sized = targets(part.groupBy("_key").agg(F.first("_source", ignorenulls=True).alias("source"), F.sum("_words").alias("source_size")), weights, share, most)
    part = part.join(sized.drop("source"), "_key").drop("_source", "_words")
    inside = Window.partitionBy("_key", "_bucket").orderBy("_mark", "_size").rowsBetween(Window.unboundedPreceding, -1)
    out = thin.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(part, ["_key", "_bucket"])
    out = out.withColumn("words_before", F.col("_before") + F.col("_inside")).withColumnRenamed("_size", "size")
    goal = F.floor(F.col("target") + 0.5)
    passes = [F.least(F.col("size"), F.greatest(F.lit(0), goal - (F.lit(e) * F.col("source_size") + F.col("words_before")))) for e in range(most)]
    out = out.withColumn("takes", F.array(*passes)).withColumn("taken", sum(passes[1:], passes[0]))
    return out.drop("_key", "_bucket", "_mark", "_before", "_inside")


def position(pass_: Column, schedules: Sequence[Sequence[float]] = SCHEDULES) -> Column:
    """Training position of a planned document's occurrence in a pass (0 for the first)."""
    y = (pass_ * F.col("source_size") + F.col("words_before")) / F.col("target")
    out = _when_reached(y, schedules[0])
    for i, knots in enumerate(schedules[1:], 1):
        out = F.when(F.col("ord") % len(schedules) == i, _when_reached(y, knots)).otherwise(out)
    return out


def mix(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, position), range-sorted by the position of the first occurrence (null: none)."""
    out = plan(docs, **options)
    at = F.when(F.col("takes")[0] > 0, F.round(position(F.lit(0), options.get("schedules", SCHEDULES)), 9))
    out = out.withColumn("position", at)
    return out.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    parts = F.split(text, f"(?<=[^{SPACE}])(?=[{SPACE}])")
    return F.array_join(F.slice(parts, F.lit(1), n.cast("int")), "")


def occurrences(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each pass that takes words of a document, its text cut
    after the words taken (only the last document of a source is), in the order of training positions."""
    out = plan(docs, text_col=text_col, whole=True, **options)
    out = out.select("*", F.posexplode("takes").alias("_pass", "_words")).filter(F.col("_words") > 0)
    out = out.withColumn("_at", position(F.col("_pass"), options.get("schedules", SCHEDULES)))
    own = F.col("row")[text_col]
    text = F.when(F.col("_words") == F.col("size"), own).otherwise(first_words(own, F.col("_words")))
    columns = [text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return out.orderBy("_at", "_pass", F.xxhash64("doc_id", own)).select(*columns)


SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^{SPACE}]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS mark
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ord
  FROM d GROUP BY source),
w AS (
  SELECT *, CASE ord % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS limit_ FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(limit_) OVER (ORDER BY limit_::DOUBLE / weight, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(weight) OVER (ORDER BY limit_::DOUBLE / weight, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM w),
t AS (
  SELECT source, source_size, ord, least(limit_::DOUBLE, max(level) OVER () * weight::DOUBLE) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.ord,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY mark, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, least(size, greatest(0, floor(target + 0.5)::BIGINT - b)) AS one,
         least(size, greatest(0, floor(target + 0.5)::BIGINT - (source_size + b))) AS two, b::DOUBLE / target AS y
  FROM p)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken,
       CASE WHEN one > 0 THEN round(CASE ord % 3
         WHEN 0 THEN (sqrt(greatest(2.25 + -2.0 * y, 0.0)) - 1.5) / -1.0
         WHEN 1 THEN y
         ELSE (sqrt(greatest(0.25 + 2.0 * y, 0.0)) - 0.5) / 1.0 END, 9) END AS position
FROM k
"""
