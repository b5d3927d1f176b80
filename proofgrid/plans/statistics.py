"""The statistical operators, each on a table where it gives rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofgrid.functions import columns as c
from proofgrid.functions import special
from proofgrid.operators import statistics as st
from proofgrid.operators.components import shared_table
from proofgrid.plans import bindings as b
from proofgrid.plans.catalog import query

BINOMIAL = "least(1.0, list_sum(list_transform(range({k}, {n} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p})))))"


@query("""WITH t AS (SELECT l_partkey % 50 AS test, avg(l_discount) AS p FROM lineitem GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY p, test) AS i, count(*) OVER () AS n FROM t)
SELECT test, round(least(1.0, min(p * n / i) OVER (ORDER BY i DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM r""")
def bh_qvalues(spark, d):
    t = b.read(spark, d, "lineitem").groupBy((F.col("l_partkey") % 50).alias("test")).agg(F.avg("l_discount").alias("p"))
    return st.bh_qvalues(t, "p").select("test", F.round("q", 9).alias("q"))


@query("""WITH t AS (SELECT event_type, count(*) FILTER (value > 50) AS k, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, k, n, round(greatest(0, (k / n + 3.8414588206941236 / (2 * n) - 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.8414588206941236 / (4.0 * n * n))) / (1 + 3.8414588206941236 / n)), 9) AS low,
  round(least(1, (k / n + 3.8414588206941236 / (2 * n) + 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.8414588206941236 / (4.0 * n * n))) / (1 + 3.8414588206941236 / n)), 9) AS high FROM t""")
def wilson_interval(spark, d):
    t = b.read(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("k"), F.count("*").alias("n"))
    low, high = c.wilson(F.col("k"), F.col("n"))
    return t.select("event_type", "k", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("""WITH m AS (SELECT event_type, quantile_cont(value, 0.5) AS med FROM events GROUP BY 1),
s AS (SELECT event_type, quantile_cont(abs(value - med), 0.5) * 1.4826 AS mad FROM events JOIN m USING (event_type) GROUP BY 1)
SELECT event_id, round((value - med) / mad, 6) AS z FROM events JOIN m USING (event_type) JOIN s USING (event_type) WHERE abs((value - med) / mad) > 3.5""")
def robust_z(spark, d):
    out = st.robust_z(b.read(spark, d, "events").select("event_id", "event_type", "value"), "value", ["event_type"])
    return out.filter(F.abs("z") > 3.5).select("event_id", F.round("z", 6).alias("z"))


@query(f"""WITH t AS (SELECT user_id, count(*) FILTER (event_type = 'error') AS k, count(*) AS n, (SELECT avg((event_type = 'error')::INT) FROM events) AS p FROM events GROUP BY 1)
SELECT user_id, k, n, round(CASE WHEN k = 0 THEN 1.0 ELSE {BINOMIAL.format(k="k", n="n", p="p")} END, 8) AS tail FROM t""")
def binomial_tail(spark, d):
    e = b.read(spark, d, "events")
    p = e.agg(F.avg((F.col("event_type") == "error").cast("int")).alias("p"))
    t = e.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("k"), F.count("*").alias("n")).crossJoin(F.broadcast(p))  # p is one row
    return t.select("user_id", "k", "n", F.round(special.binomial_tail(F.col("k").cast("double"), F.col("n").cast("double"), "p"), 8).alias("tail"))


@query("""WITH t AS (SELECT user_id, count(*) AS k, (SELECT count(*) / count(DISTINCT user_id) FROM events) AS m FROM events GROUP BY 1)
SELECT user_id, k, round(greatest(0.0, 1 - list_sum(list_transform(range(0, k), lambda i: exp(i * ln(m) - m - lgamma(i + 1))))), 8) AS tail FROM t""")
def poisson_tail(spark, d):
    e = b.read(spark, d, "events")
    m = e.agg((F.count("*") / F.count_distinct("user_id")).alias("m"))
    t = e.groupBy("user_id").agg(F.count("*").alias("k")).crossJoin(F.broadcast(m))  # m is one row
    return t.select("user_id", "k", F.round(special.poisson_tail(F.col("k").cast("double"), "m"), 8).alias("tail"))


@query("""WITH t AS (SELECT source, count(*) FILTER (toxic = 1) AS k, count(*) AS m, (SELECT count(*) FROM labels) AS n, (SELECT sum(toxic) FROM labels) AS w FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT source, k, m, round(k / m / ((w - k + 0.5) / (n - m + 1)), 6) AS enrichment, round(least(1.0, list_sum(list_transform(range(greatest(k, m + w - n)::BIGINT, (least(m, w) + 1)::BIGINT), lambda x:
  exp(lgamma(w + 1) - lgamma(x + 1) - lgamma(w - x + 1) + lgamma(n - w + 1) - lgamma(m - x + 1) - lgamma(n - w - m + x + 1) - lgamma(n + 1) + lgamma(m + 1) + lgamma(n - m + 1))))), 8) AS p FROM t""")
def fisher_enrichment(spark, d):
    rows = b.read(spark, d, "labels").join(b.read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    total = b.read(spark, d, "labels").agg(F.count("*").alias("n"), F.sum("toxic").alias("w"))
    t = rows.groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("k"), F.count("*").alias("m")).crossJoin(F.broadcast(total))  # total is one row
    return t.select("source", "k", "m", F.round(F.col("k") / F.col("m") / ((F.col("w") - F.col("k") + 0.5) / (F.col("n") - F.col("m") + 1)), 6).alias("enrichment"), F.round(special.hypergeometric_tail("k", "m", "w", "n"), 8).alias("p"))


@query("""SELECT event_id, round((1 + above) / (1 + n), 9) AS p FROM (SELECT event_id, count(*) FILTER (event_id % 2 = 0) OVER (ORDER BY value DESC) AS above, count(*) FILTER (event_id % 2 = 0) OVER () AS n FROM events)
WHERE event_id % 2 = 1""")
def conformal_pvalues(spark, d):
    e = b.read(spark, d, "events").select("event_id", "value")
    out = st.conformal_pvalues(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "value")
    return out.select("event_id", F.round("p", 9).alias("p"))


_RANKS = """WITH v AS (SELECT is_ref, axis, value, avg(i) OVER (PARTITION BY axis, value) AS r FROM (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY value) AS i FROM ({src}))),
s AS (SELECT axis, count(*) FILTER (NOT is_ref) AS m, count(*) FILTER (is_ref) AS n, sum(r) FILTER (NOT is_ref) AS rs FROM v GROUP BY axis)"""


@query(_RANKS.format(src=b.AXES_SQL) + " SELECT axis, round(2 * (rs - m * (m + 1) / 2) / (m::DOUBLE * n) - 1, 8) AS delta, CASE WHEN abs(2 * (rs - m * (m + 1) / 2) / (m::DOUBLE * n) - 1) < 0.147 THEN 'negligible' ELSE 'larger' END AS effect FROM s")
def cliffs_delta(spark, d):
    out = st.compare(b.axes(spark, d), ["axis"], "value", F.col("is_ref"))
    return out.select("axis", F.round("delta", 8).alias("delta"), F.when(c.effect_label(F.col("delta")) == "negligible", "negligible").otherwise("larger").alias("effect"))


@query("""WITH v AS (SELECT toxic, avg(i) OVER (PARTITION BY n_chars) AS r FROM (SELECT toxic, n_chars, row_number() OVER (ORDER BY n_chars) AS i FROM labels JOIN documents USING (doc_id)))
SELECT round((sum(r) FILTER (toxic = 1) - count(*) FILTER (toxic = 1) * (count(*) FILTER (toxic = 1) + 1) / 2) / (count(*) FILTER (toxic = 1)::DOUBLE * count(*) FILTER (toxic = 0)), 8) AS auroc FROM v""")
def auroc(spark, d):
    rows = b.read(spark, d, "labels").join(b.read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("all", F.lit(1))
    return st.compare(rows, ["all"], "n_chars", F.col("toxic") == 0, least=1).select(F.round((F.col("delta") + 1) / 2, 8).alias("auroc"))


_ECDF = """WITH g AS (SELECT axis, value, count(*) FILTER (is_ref) AS r, count(*) FILTER (NOT is_ref) AS c FROM ({src}) GROUP BY ALL),
f AS (SELECT axis, value, sum(r) OVER w / sum(r) OVER (PARTITION BY axis) AS fr, sum(c) OVER w / sum(c) OVER (PARTITION BY axis) AS fc, lead(value) OVER (PARTITION BY axis ORDER BY value) AS nxt
  FROM g WINDOW w AS (PARTITION BY axis ORDER BY value ROWS UNBOUNDED PRECEDING))"""


@query(_ECDF.format(src=b.AXES_SQL) + " SELECT axis, round(max(abs(fr - fc)), 9) AS ks FROM f GROUP BY axis")
def ks_statistic(spark, d):
    return st.compare(b.axes(spark, d), ["axis"], "value", F.col("is_ref")).select("axis", F.round("ks", 9).alias("ks"))


@query(_ECDF.format(src=b.AXES_SQL) + ", sd AS (SELECT axis, stddev_pop(value) AS sd FROM (" + b.AXES_SQL + ") WHERE is_ref GROUP BY axis) SELECT axis, round(sum(abs(fr - fc) * coalesce(nxt - value, 0)) / any_value(sd), 8) AS wasserstein_sd FROM f JOIN sd USING (axis) GROUP BY axis")
def wasserstein(spark, d):
    a = b.axes(spark, d)
    sd = a.filter("is_ref").groupBy("axis").agg(F.stddev_pop("value").alias("sd"))
    return st.compare(a, ["axis"], "value", F.col("is_ref")).join(sd, "axis").select("axis", F.round(F.col("wasserstein") / F.col("sd"), 8).alias("wasserstein_sd"))


@query("""WITH a AS (""" + b.AXES_SQL + """), e AS (SELECT axis, list_sort(list_distinct(quantile_cont(value, [0.0,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9,1.0]))) AS edges FROM a WHERE is_ref GROUP BY axis),
p AS (SELECT axis, is_ref, len(list_filter(edges[2:len(edges)-1], lambda x: value >= x)) AS bin FROM a JOIN e USING (axis)),
k AS (SELECT axis, bin, count(*) FILTER (is_ref) AS r, count(*) FILTER (NOT is_ref) AS c FROM p GROUP BY ALL),
n AS (SELECT axis, count(*) FILTER (is_ref) AS nr, count(*) FILTER (NOT is_ref) AS nc FROM a GROUP BY axis),
z AS (SELECT axis, r / nr + 1e-4 AS x, c / nc + 1e-4 AS y FROM k JOIN n USING (axis))
SELECT axis, round(sum((y - x) * ln(y / x)), 8) AS psi FROM z GROUP BY axis""")
def psi(spark, d):
    return st.psi(b.axes(spark, d), ["axis"], "value", F.col("is_ref")).select("axis", F.round("psi", 8).alias("psi"))


@query("""WITH h AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), k AS (SELECT unnest(['de','en','es','fr']) AS lang), s AS (SELECT DISTINCT source FROM documents),
m AS (SELECT source, lang, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY source) AS p FROM s CROSS JOIN k LEFT JOIN h USING (source, lang)),
t AS (SELECT lang, count(*) / (SELECT count(*) FROM documents) AS q FROM documents GROUP BY 1),
z AS (SELECT source, greatest(p, 1e-12) / sum(greatest(p, 1e-12)) OVER (PARTITION BY source) AS p, q FROM m JOIN t USING (lang))
SELECT source, round(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2, 8) AS jsd FROM z GROUP BY source""")
def jsd(spark, d):
    docs = b.read(spark, d, "documents")
    langs = ("de", "en", "es", "fr")
    share = F.array(*(F.count_if(F.col("lang") == k) / F.count("*") for k in langs))
    total = docs.agg(share.alias("q"))
    return docs.groupBy("source").agg(share.alias("p")).crossJoin(F.broadcast(total)).select("source", F.round(c.jsd(F.col("p"), F.col("q")), 8).alias("jsd"))  # total is one row


@query("SELECT user_id, round(sum(-(n / t) * log2(n / t)), 8) AS bits FROM (SELECT user_id, n, sum(n) OVER (PARTITION BY user_id) AS t FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) GROUP BY user_id")
def entropy_bits(spark, d):
    kinds = b.read(spark, d, "events").groupBy("user_id", "event_type").count()
    return kinds.groupBy("user_id").agg(F.round(c.entropy_bits(F.array_sort(F.collect_list("count"))), 8).alias("bits"))


@query("""WITH q AS (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi FROM lineitem)
SELECT bin, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM (SELECT least(23, floor((l_extendedprice - lo) / ((hi - lo) / 24)))::INT AS bin FROM lineitem, q WHERE l_extendedprice BETWEEN lo AND hi) GROUP BY bin""")
def histogram_fixed(spark, d):
    counts = shared_table(b.read(spark, d, "lineitem").filter("l_extendedprice IS NOT NULL").groupBy(F.col("l_extendedprice").alias("v")).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n").alias("all"))
    steps = st.running(counts, [], "v", ["n"]).crossJoin(F.broadcast(total))  # one row
    q = steps.agg(st.quantile(0.01, "cum_n", "all", "v").alias("lo"), st.quantile(0.99, "cum_n", "all", "v").alias("hi"))
    at = F.least(F.lit(23), F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 24))).cast("int")
    bins = counts.crossJoin(F.broadcast(q)).filter(F.col("v").between(F.col("lo"), F.col("hi"))).groupBy(at.alias("bin")).agg(F.sum("n").alias("count"))  # q is one row
    return bins.select("bin", F.round(F.col("count") / F.sum("count").over(Window.partitionBy()), 9).alias("share"))


_PROB = "SELECT least(1.0, n_chars / 4000.0::DOUBLE) AS prob, toxic AS label FROM labels JOIN documents USING (doc_id)"


def _prob(spark, d):
    rows = b.read(spark, d, "labels").join(b.read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.select(F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("prob"), F.col("toxic").alias("label"))


@query(f"SELECT least(9, floor(prob * 10))::INT AS bin, count(*) AS n, round(avg(prob), 8) AS mean_predicted, round(avg(label), 8) AS observed_rate FROM ({_PROB}) GROUP BY 1")
def reliability_bins(spark, d):
    return st.reliability(_prob(spark, d), "prob", "label").select("bin", "n", F.round("mean_predicted", 8).alias("mean_predicted"), F.round("observed_rate", 8).alias("observed_rate"))


@query(f"""SELECT round(avg((prob - label) * (prob - label)), 8) AS brier, (SELECT round(sum(n * abs(c - o)) / sum(n), 8) FROM (SELECT count(*) AS n, avg(prob) AS c, avg(label) AS o FROM ({_PROB}) GROUP BY least(9, floor(prob * 10)))) AS ece FROM ({_PROB})""")
def brier(spark, d):
    rows = _prob(spark, d)
    ece = st.reliability(rows, "prob", "label").agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_predicted") - F.col("observed_rate"))) / F.sum("n"), 8).alias("ece"))
    return rows.agg(F.round(F.avg((F.col("prob") - F.col("label")) * (F.col("prob") - F.col("label"))), 8).alias("brier")).crossJoin(ece)  # both are one row


@query("""WITH r AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) AS i, count(*) OVER () AS n FROM labels JOIN documents USING (doc_id) WHERE toxic = 0)
SELECT max(n_chars) FILTER (i = least(n, n - floor(0.05::DOUBLE * n) + 1)) AS threshold FROM r""")
def threshold_for_fpr(spark, d):
    neg = b.read(spark, d, "labels").filter("toxic = 0").join(b.read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").groupBy("n_chars").agg(F.count("*").alias("n"))
    total = neg.agg(F.sum("n").alias("all"))
    at = F.least(F.col("all"), F.col("all") - F.floor(F.lit(0.05) * F.col("all")) + 1)
    return st.running(neg, [], "n_chars", ["n"]).crossJoin(F.broadcast(total)).filter(F.col("cum_n") >= at).agg(F.min("n_chars").alias("threshold"))  # total is one row


@query("SELECT dim, round(avg(v), 6) AS mean, round(greatest(stddev_pop(v), 1e-8), 6) AS sd FROM (SELECT unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY dim")
def moments_per_dim(spark, d):
    v = b.vectors(spark, d).select(F.posexplode("embedding").alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    return v.groupBy("dim").agg(F.round(F.avg("v"), 6).alias("mean"), F.round(F.greatest(F.stddev_pop("v"), F.lit(1e-8)), 6).alias("sd"))


@query("""SELECT label AS tensor, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS sd, round(avg((abs(v) < 1e-8)::INT), 6) AS sparsity, round(sum(abs(v)), 4) AS l1, round(sqrt(sum(v * v)), 6) AS l2,
  round(kurtosis_pop(v), 5) AS kurtosis, round(max(abs(v)), 6) AS top, round(quantile_cont(v, 0.01), 6) AS q01, round(quantile_cont(v, 0.99), 6) AS q99 FROM (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY label""")
def layer_stats(spark, d):
    v = b.vectors(spark, d).select(F.col("label").alias("tensor"), F.explode("embedding").alias("v")).withColumn("v", F.col("v").cast("double"))
    r = lambda x, n=6: F.round(x, n)
    return v.groupBy("tensor").agg(F.count("*").alias("n"), r(F.avg("v")).alias("mean"), r(F.stddev_pop("v")).alias("sd"), r(F.avg((F.abs("v") < 1e-8).cast("int"))).alias("sparsity"), r(F.sum(F.abs("v")), 4).alias("l1"), r(F.sqrt(F.sum(F.col("v") * F.col("v")))).alias("l2"), r(F.kurtosis("v"), 5).alias("kurtosis"), r(F.max(F.abs("v"))).alias("top"), r(F.percentile("v", 0.01)).alias("q01"), r(F.percentile("v", 0.99)).alias("q99"))
