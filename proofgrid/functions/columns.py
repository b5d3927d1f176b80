"""Column builders that stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ranks of severities and dispositions, the normal quantile of 0.975, effect-size bands.
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
DISPOSITIONS = ("ACCEPT", "REVIEW", "QUARANTINE")
Z95 = 1.959963984540054
EFFECT_BANDS = ((0.147, "negligible"), (0.33, "small"), (0.474, "medium"))


def rank_of(c: Column, names: Sequence[str] = SEVERITIES) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), c).cast("int") - 1


def name_of(rank: Column, names: Sequence[str] = SEVERITIES) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (rank + 1).cast("int"))


def wilson(successes: Column, trials: Column, z: float = Z95) -> tuple[Column, Column]:
    """Interval of a rate; (0, 1) without trials."""
    n = trials.cast("double")
    rate = successes / n
    denom = 1 + F.lit(z * z) / n
    centre = (rate + F.lit(z * z) / (2 * n)) / denom
    half = F.lit(z) * F.sqrt(rate * (1 - rate) / n + F.lit(z * z) / (4 * n * n)) / denom
    empty = trials <= 0
    return F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)), F.when(empty, 1.0).otherwise(F.least(F.lit(1.0), centre + half))


def effect_label(delta: Column) -> Column:
    out = F.lit("large")
    for bound, name in reversed(EFFECT_BANDS):
        out = F.when(F.abs(delta) < bound, name).otherwise(out)
    return out


def psi_band(value: Column) -> Column:
    return F.when(value < 0.1, "none").when(value < 0.25, "moderate").otherwise("significant")


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def squared_distance(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def unit(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_bits(vector: Column, first: int = 0, n: int = 63) -> Column:
    """The signs of ``n`` (up to 63) elements from ``first``, packed into a non-negative long."""
    return F.aggregate(F.slice(vector, first + 1, n), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))


def jsd(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in nats of two arrays that are clipped and normalised first."""
    clip = lambda a: F.transform(a, lambda x: F.least(F.lit(1.0), F.greatest(F.lit(1e-12), x.cast("double"))))
    part = lambda x, y: x * F.log(x / ((x + y) / 2))
    a, b = clip(p), clip(q)
    sa, sb = array_sum(a), array_sum(b)
    return array_sum(F.zip_with(a, b, lambda x, y: (part(x / sa, y / sb) + part(y / sb, x / sa)) / 2))


def entropy_bits(counts: Column) -> Column:
    total = array_sum(F.transform(counts, lambda x: x.cast("double")))
    return array_sum(F.transform(counts, lambda x: F.when(x > 0, -(x / total) * F.log2(x / total)).otherwise(0.0)))


def safe_text(c: Column, most: int = 128) -> Column:
    """Printable characters only, cut at ``most``."""
    return F.substring(F.regexp_replace(c, r"\p{C}", ""), 1, most)


def normal_path(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.translate(c, "\\", "/"), r"/(\.?/)+", "/"), r"^\./", "")


def is_unsafe_path(c: Column) -> Column:
    p = F.translate(c, "\\", "/")
    return c.isNull() | (c == "") | p.startswith("/") | p.rlike("^[A-Za-z]:") | F.array_contains(F.split(p, "/"), "..") | F.contains(c, F.lit("\x00"))


def digest_form(c: Column) -> Column:
    """A digest in lower case with its prefix."""
    return F.concat(F.lit("sha256:"), F.regexp_replace(F.lower(F.trim(c)), "^sha256:", ""))


def utc_time(c: Column) -> Column:
    """ISO 8601 text as a timestamp; null if it is none."""
    return F.try_to_timestamp(c)


def hex16(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def finding_id(*parts: Column) -> Column:
    return F.concat(F.lit("F-"), F.upper(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 10)))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x.cast("double") - top))
    return F.transform(e, lambda x: x / array_sum(e))
