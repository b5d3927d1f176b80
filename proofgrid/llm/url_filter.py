"""URL filtering: host and path rules first, gradient-boosted trees on lexical features for the rest.

A rule is a host and a path ("example.org/es/"): it fits its host and all subdomains if the path starts with
its path, and the longest rule that fits decides. URLs that a rule decides are the labelled URLs: from at most
``most_rows`` different ones, the first by a hash of the URL, boosted trees learn length, depth, digit ratio, entropy,
parameter counts and the block rate and frequency of the host's suffix. A labelled URL's own rate comes from the
other folds, so that trees don't read its label there. All other URLs get the trees' verdict.

Everything runs in the JVM. A null URL, or one without ``://``, has an empty host and path and goes to the
trees like others; if the labelled URLs are of one kind, that is the verdict, and without any it is allow.
Equal URLs get equal verdicts; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import cut

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("n_chars", "host_chars", "path_chars", "depth", "host_depth", "digit_ratio", "entropy", "n_params", "n_hyphens", "suffix_rate", "suffix_count")


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: len(x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the URL alone."""
    u = F.coalesce(url, F.lit(""))
    n = F.length(u)
    count = lambda pattern, c=u: F.regexp_count(c, F.lit(pattern)).cast("double")
    chars = F.array_distinct(F.split(u, ""))
    share = lambda c: (n - F.length(F.replace(u, c, F.lit("")))) / n
    entropy = F.aggregate(chars, F.lit(0.0), lambda acc, c: acc - F.when(c == "", 0.0).otherwise(share(c) * F.log2(share(c))))
    return {
        "n_chars": n.cast("double"), "host_chars": F.length(host).cast("double"), "path_chars": F.length(path).cast("double"),
        "depth": count("/[^/]", path), "host_depth": count("[.]", host), "digit_ratio": F.when(n > 0, count("[0-9]") / n).otherwise(0.0),
        "entropy": F.when(n > 0, entropy).otherwise(0.0), "n_params": count("[?&][^&#]"), "n_hyphens": count("-"),
    }


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, most_rows: int = 20_000, trees: int = 12, depth: int = 4, folds: int = 5, seed: int = 7) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; score: the trees' block probability, null where a rule decides."""
    url = F.col(url_col)
    base = pages.select(F.col(id_col).alias("page_id"), url.alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("ruled", ruled).withColumn("suffix", F.substring_index("host", ".", -2))
    own = lexical(F.col("url"), F.col("host"), F.col("path"))

    urls = base.filter("ruled IS NOT NULL").select("url", "host", "path", "ruled", "suffix").distinct().orderBy(F.xxhash64("url"), "url").limit(most_rows)
    fold = F.pmod(F.xxhash64("url", F.lit(1)), F.lit(folds)).alias("fold")
    sample = cut(urls.select("suffix", fold, (F.col("ruled") == "block").cast("double").alias("label"), *(c.alias(k) for k, c in own.items())), "urls")
    kinds = [r.label for r in sample.select("label").distinct().collect()]
    if len(kinds) < 2:
        constant = "block" if kinds == [1.0] else "allow"
        return base.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(constant)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    # at most as many suffixes as sampled rows; rates are drawn to one half as if two more rows had been seen
    rate = lambda blocked, n: [((blocked + 1) / (n + 2)).alias("suffix_rate"), F.log1p(n).alias("suffix_count")]
    seen = sample.groupBy("suffix").agg(F.sum("label").alias("blocked"), F.count("*").alias("n"))
    inside = sample.groupBy("suffix", "fold").agg(F.sum("label").alias("b"), F.count("*").alias("m")).join(seen, "suffix")
    apart = inside.select("suffix", "fold", *rate(F.col("blocked") - F.col("b"), F.col("n") - F.col("m")))
    known = lambda df: df.join(F.broadcast(seen.select("suffix", *rate(F.col("blocked"), F.col("n")))), "suffix", "left").fillna({"suffix_rate": 0.5, "suffix_count": 0.0})
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, maxBins=32).fit(assemble.transform(sample.join(apart, ["suffix", "fold"])).select("features", "label").coalesce(1))

    scored = model.transform(assemble.transform(known(base.select("*", *(c.alias(k) for k, c in own.items())))))
    score = vector_to_array("probability")[1]
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(score > 0.5, "block").otherwise("allow")).alias("verdict"), F.when(F.col("ruled").isNull(), score).alias("score"))
