"""Checks of data: integrity, geometry, metadata, duplicates, neighbours and labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofgrid.functions import columns as c
from proofgrid.functions import special
from proofgrid.operators import ivf
from proofgrid.operators import statistics as st
from proofgrid.operators.components import connected_components, shared_table
from proofgrid.operators.pairs import digest_links, hamming_pairs, nearest
from proofgrid.operators.risk import BASELINE, decide
from proofgrid.plans import bindings as b
from proofgrid.plans.catalog import query
from proofgrid.plans.statistics import BINOMIAL

_REDUNDANT = "SELECT doc_id, source, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS redundant FROM documents"


def redundant(samples):
    """Samples in clusters of equal digests, with the redundant ones marked: all but the first by id."""
    comp = connected_components(digest_links(samples, "sample_id", "digest"), "i", "j")
    rows = samples.join(comp, samples["sample_id"] == comp["node"], "left").drop("node")
    i = F.row_number().over(Window.partitionBy("component").orderBy("sample_id"))
    return rows.withColumn("redundant", F.col("component").isNotNull() & (i > 1))


def redundancy_tests(rows):
    """Contributors against all others: rate, leave-one-out baseline, binomial tail and q."""
    own = rows.filter("contributor IS NOT NULL").groupBy("contributor").agg(F.count_if("redundant").alias("r"), F.count("*").alias("n"))
    all_ = own.agg(F.sum("r").alias("tr"), F.sum("n").alias("tn"))
    t = own.crossJoin(F.broadcast(all_))  # one row
    t = t.withColumn("p0", (F.col("tr") - F.col("r") + 0.5) / (F.col("tn") - F.col("n") + 1)).drop("tr", "tn")
    t = t.withColumn("p", special.binomial_tail(F.col("r").cast("double"), F.col("n").cast("double"), "p0"))
    return st.bh_qvalues(t, "p").withColumn("ratio", F.col("r") / F.col("n") / F.col("p0"))


@query()
def contributor_redundancy(spark, d):
    """The flagship: duplicate clusters, redundant copies, tests, findings and the policy's decisions."""
    tests = redundancy_tests(redundant(b.samples(spark, d)))
    hit = (F.col("q") < 0.01) & (F.col("r") >= 5) & (F.col("ratio") >= 3)
    findings = tests.select(
        F.concat(F.lit("dup:"), "contributor").alias("subject"), "contributor", "r", "n", F.round("p0", 6).alias("p0"), F.round("q", 6).alias("q"), F.lit("duplicate_flood").alias("attack_class"), F.lit("DATA").alias("layer"), F.lit("data.near_duplicate").alias("detector_id"),
        F.lit("FULL").alias("availability"), F.create_map().cast("map<string,string>").alias("tags"), F.lit(True).alias("deterministic"), F.lit(False).alias("calibrated"), F.when(hit, "HIGH").when(F.col("r") > 0, "LOW").otherwise("INFO").alias("severity"), F.when(hit, 0.9).otherwise(0.5).alias("confidence"), F.array().cast("array<string>").alias("signals"),
    )
    return decide(findings, BASELINE).select(c.finding_id(F.lit("scan"), F.col("detector_id"), F.col("subject")).alias("finding_id"), "contributor", "r", "n", "p0", "q", "decided_severity", "disposition", "rule_id")


@query(f"""WITH t AS (SELECT source AS contributor, count(*) FILTER (redundant) AS r, count(*) AS n FROM ({_REDUNDANT}) GROUP BY 1),
z AS (SELECT contributor, r, n, ((SELECT sum(r) FROM t) - r + 0.5) / ((SELECT sum(n) FROM t) - n + 1) AS p0 FROM t)
SELECT contributor, r, n, round(p0, 9) AS p0, round(CASE WHEN r = 0 THEN 1.0 ELSE {BINOMIAL.format(k="r", n="n", p="p0")} END, 7) AS p FROM z""")
def redundancy_rates(spark, d):
    return redundancy_tests(redundant(b.samples(spark, d))).select("contributor", "r", "n", F.round("p0", 9).alias("p0"), F.round("p", 7).alias("p"))


@query("SELECT doc_id AS sample_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS i FROM documents) WHERE i > 1")
def redundant_copies(spark, d):
    return redundant(b.samples(spark, d)).filter("redundant").select("sample_id")


@query("SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY text) AS component FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1")
def duplicate_components(spark, d):
    return connected_components(digest_links(b.samples(spark, d), "sample_id", "digest"), "i", "j")


@query("""WITH k AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS component, count(*) OVER (PARTITION BY text) AS size FROM documents),
l0 AS (SELECT component, size, lang, count(*) AS n FROM k WHERE size > 1 GROUP BY ALL), l AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, lang) AS i FROM l0),
t AS (SELECT lang, count(*) AS nc FROM documents GROUP BY 1)
SELECT component, size, round(100 * (nc / (SELECT count(*) FROM documents) - (nc - n + 1) / ((SELECT count(*) FROM documents) - size + 1)), 8) AS imbalance_pp FROM l JOIN t USING (lang) WHERE i = 1""")
def cluster_imbalance(spark, d):
    s = b.samples(spark, d)
    rows = redundant(s).filter("component IS NOT NULL")
    by = rows.groupBy("component", "label").agg(F.count("*").alias("n"))
    top = by.groupBy("component").agg(F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("top"))
    classes = b.thin_samples(spark, d).groupBy("label").agg(F.count("*").alias("nc"))
    total = classes.agg(F.sum("nc").alias("all"))
    out = top.select("component", "size", F.col("top.label").alias("label"), (-F.col("top.m")).alias("n")).join(classes, "label").crossJoin(F.broadcast(total))  # one row
    pp = 100 * (F.col("nc") / F.col("all") - (F.col("nc") - F.col("n") + 1) / (F.col("all") - F.col("size") + 1))
    return out.select("component", "size", F.round(pp, 8).alias("imbalance_pp"))


@query("""WITH k AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS component FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1),
m0 AS (SELECT component, source, count(*) AS n FROM k GROUP BY ALL), m AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY n DESC, source) AS i FROM m0)
SELECT doc_id AS sample_id, k.component, m.source AS majority FROM k JOIN m ON k.component = m.component AND m.i = 1 WHERE k.source <> m.source""")
def label_conflicts(spark, d):
    """The label here is the source: copies that disagree with their cluster's majority."""
    rows = redundant(b.samples(spark, d)).filter("component IS NOT NULL")
    by = rows.groupBy("component", "contributor").agg(F.count("*").alias("n")).groupBy("component").agg(F.min(F.struct((-F.col("n")).alias("m"), "contributor")).alias("top"))
    return rows.join(by, "component").filter(F.col("contributor") != F.col("top.contributor")).select("sample_id", "component", F.col("top.contributor").alias("majority"))


@query("SELECT a.vec_id AS i, b.vec_id AS j, bit_count(xor(a.h, b.h))::INT AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id AND bit_count(xor(a.h, b.h)) <= 16".replace("FROM h a JOIN h b", "FROM ({h}) a JOIN ({h}) b").format(h="SELECT vec_id, list_reduce(list_prepend(0::BIGINT, list_transform(embedding[1:63], lambda x: (x > 0)::BIGINT)), lambda p, q: p * 2 + q) AS h FROM embeddings"))
def near_pairs(spark, d):
    v = b.vectors(spark, d).select("vec_id", c.sign_bits(F.col("embedding")).alias("h"))
    return hamming_pairs(v, "vec_id", "h", 16).select("i", "j", "distance")


_DIST = "round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))), 5)"


@query(f"SELECT query, neighbour, rank FROM (SELECT a.vec_id AS query, b.vec_id AS neighbour, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))), b.vec_id)::INT AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 5")
def knn_self(spark, d):
    v = b.vectors(spark, d)
    return nearest(v.filter("vec_id % 50 = 0"), v, "vec_id", "embedding", 5).select("query", "neighbour", "rank")


@query(f"SELECT query, max(dist) AS radius FROM (SELECT a.vec_id AS query, {_DIST} AS dist, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND b.vec_id % 2 = 1 WHERE a.vec_id % 50 = 0) WHERE rank <= 5 GROUP BY 1")
def knn_reference(spark, d):
    v = b.vectors(spark, d)
    out = nearest(v.filter("vec_id % 50 = 0"), v.filter("vec_id % 2 = 1"), "vec_id", "embedding", 5)
    return out.groupBy("query").agg(F.round(F.max("distance"), 5).alias("radius"))


@query(f"""WITH n AS (SELECT a.vec_id, b.label = a.label AS same, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))), b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT vec_id AS sample_id, avg(same::INT) AS agreement FROM n WHERE rank <= 10 GROUP BY 1""")
def knn_label_agreement(spark, d):
    v = b.vectors(spark, d)
    near = nearest(v.filter("vec_id % 50 = 0"), v, "vec_id", "embedding", 10)
    own = v.select(F.col("vec_id").alias("query"), F.col("label").alias("mine"))
    return near.join(own, "query").join(v.select(F.col("vec_id").alias("neighbour"), "label"), "neighbour").groupBy(F.col("query").alias("sample_id")).agg(F.avg((F.col("label") == F.col("mine")).cast("int")).alias("agreement"))


@query()
def ood_conformal(spark, d):
    """Distances to the fifth nearest reference vector, conformal p-values against held-out reference ones, and q."""
    v = b.vectors(spark, d)
    ref = v.filter("vec_id % 4 = 0")
    # written once: calibration and test scores are each read twice, and all pairs are behind them
    scores = shared_table(nearest(v.filter("vec_id % 4 > 0"), ref, "vec_id", "embedding", 5).filter("rank = 5").select(F.col("query").alias("sample_id"), F.col("distance").alias("score")))
    out = st.conformal_pvalues(scores.filter("sample_id % 4 = 1"), scores.filter("sample_id % 4 > 1"), "score")
    return st.bh_qvalues_of_rows(out, "p").select("sample_id", F.round("score", 6).alias("score"), F.round("p", 8).alias("p"), F.round("q", 8).alias("q"))


_BOX = "SELECT l_orderkey AS id, l_suppkey % 8 AS contributor, l_quantity - 4 AS x, l_tax * 500 - 3 AS y, l_discount * 400 - 4 AS w, l_quantity * 2 - 6 AS h FROM lineitem"


def _boxes(spark, d):
    q = F.col("l_quantity")
    return b.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 8).alias("contributor"), (q - 4).alias("x"), (F.col("l_tax") * 500 - 3).alias("y"), (F.col("l_discount") * 400 - 4).alias("w"), (q * 2 - 6).alias("h"))


def box_kind(x, y, w, h, width, height, tolerance=2.0, tiny=4.0, giant=0.95):
    """The first hard check that a box fails, or null."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return (
        F.when(~(finite(x) & finite(y) & finite(w) & finite(h)), "unparseable").when((w <= 0) | (h <= 0), "degenerate")
        .when((x >= width) | (y >= height) | (x + w <= 0) | (y + h <= 0), "outside")
        .when((x < -tolerance) | (y < -tolerance) | (x + w > width + tolerance) | (y + h > height + tolerance), "clipped")
        .when((w < tiny) | (h < tiny), "tiny").when(w * h >= giant * width * height, "giant")
    )


@query(f"""SELECT contributor, kind, count(*) AS n FROM (SELECT contributor, CASE WHEN w <= 0 OR h <= 0 THEN 'degenerate' WHEN x >= 40 OR y >= 40 OR x + w <= 0 OR y + h <= 0 THEN 'outside'
  WHEN x < -2 OR y < -2 OR x + w > 42 OR y + h > 42 THEN 'clipped' WHEN w < 4 OR h < 4 THEN 'tiny' WHEN w * h >= 0.95 * 1600 THEN 'giant' END AS kind FROM ({_BOX})) WHERE kind IS NOT NULL GROUP BY ALL""")
def box_hard_checks(spark, d):
    kind = box_kind(*(F.col(k) for k in "xywh"), F.lit(40.0), F.lit(40.0))
    return _boxes(spark, d).withColumn("kind", kind).filter("kind IS NOT NULL").groupBy("contributor", "kind").agg(F.count("*").alias("n"))


@query(f"""WITH v AS (SELECT contributor, id, ln(w * h / 1600) AS v FROM ({_BOX}) WHERE w > 0 AND h > 0), m AS (SELECT contributor, quantile_cont(v, 0.5) AS med FROM v GROUP BY 1),
s AS (SELECT contributor, quantile_cont(abs(v - med), 0.5) * 1.4826 AS mad FROM v JOIN m USING (contributor) GROUP BY 1)
SELECT contributor, count(*) FILTER (abs((v - med) / mad) > 3.5) AS outliers, count(*) AS n FROM v JOIN m USING (contributor) JOIN s USING (contributor) GROUP BY 1""")
def size_outliers(spark, d):
    v = _boxes(spark, d).filter("w > 0 AND h > 0").select("contributor", F.log(F.col("w") * F.col("h") / 1600).alias("v"))
    return st.robust_z(v, "v", ["contributor"]).groupBy("contributor").agg(F.count_if(F.abs("z") > 3.5).alias("outliers"), F.count("*").alias("n"))


@query(f"""WITH m AS (SELECT contributor, quantile_cont(ln(w / h), 0.5) AS med, count(*) AS n FROM ({_BOX}) WHERE w > 0 AND h > 0 GROUP BY 1)
SELECT a.contributor, round(a.med, 6) AS med, count(*) FILTER (abs(a.med - b.med) >= 0.02 AND a.med > b.med) AS above, count(*) FILTER (abs(a.med - b.med) >= 0.02 AND a.med < b.med) AS below FROM m a JOIN m b ON a.contributor <> b.contributor GROUP BY ALL""")
def box_shift_effects(spark, d):
    """Contributors whose median aspect lies apart from the others', by pairs of contributors."""
    m = _boxes(spark, d).filter("w > 0 AND h > 0").groupBy("contributor").agg(F.percentile(F.log(F.col("w") / F.col("h")), 0.5).alias("med"))
    o = m.select(F.col("contributor").alias("other"), F.col("med").alias("theirs"))
    apart = F.abs(F.col("med") - F.col("theirs")) >= 0.02
    pairs = m.join(o, F.col("contributor") != F.col("other"))
    return pairs.groupBy("contributor", F.round("med", 6).alias("med")).agg(F.count_if(apart & (F.col("med") > F.col("theirs"))).alias("above"), F.count_if(apart & (F.col("med") < F.col("theirs"))).alias("below"))


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'unparseable' WHEN o_orderkey % 10 = 0 THEN 'ancient' WHEN o_orderdate > TIMESTAMP '2000-01-01' + INTERVAL 1 DAY THEN 'future' ELSE 'ok' END AS kind FROM orders) GROUP BY 1""")
def timestamp_checks(spark, d):
    o = b.read(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 9 == 0, F.lit("soon")).when(F.col("o_orderkey") % 10 == 0, F.lit("1999-13-01")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    raw = F.when((F.col("o_orderkey") % 9 != 0) & (F.col("o_orderkey") % 10 == 0), F.lit("1969-07-20T00:00:00Z")).otherwise(raw)
    return timestamp_kinds(o.select(raw.alias("timestamp")), "timestamp", F.lit("2000-01-01").cast("timestamp"), 1970).groupBy("kind").agg(F.count("*").alias("n"))


def timestamp_kinds(df, column, now, first_year=2000):
    at = c.utc_time(F.col(column))
    kind = F.when(at.isNull(), "unparseable").when(F.year(at) < first_year, "ancient").when(at > now + F.expr("INTERVAL 1 DAY"), "future").otherwise("ok")
    return df.withColumn("kind", kind)


def burst_windows(df, key, ts, id_col, window_s=3600, least=8):
    """Rows with count (rows from here to the window's end), expected count by the median gap, and p."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    along = Window.partitionBy(key).orderBy(us)
    peers = F.row_number().over(Window.partitionBy(key).orderBy(us, id_col)) - F.rank().over(along)
    n = F.count("*").over(along.rangeBetween(0, window_s * 1_000_000 - 1)) - peers
    rows = df.withColumn("count", n).withColumn("gap", (us - F.lag(us).over(along)) / 1e6)
    stats = rows.groupBy(key).agg(F.percentile(F.when(F.col("gap") > 0, F.col("gap")), 0.5).alias("median_gap"), F.count("*").alias("n"))
    rows = rows.join(stats, key).filter(F.col("n") >= least).withColumn("expected", window_s / F.greatest(F.col("median_gap"), F.lit(1.0)))
    return rows.withColumn("p", special.poisson_tail(F.col("count").cast("double"), "expected"))


@query("""WITH g AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
m AS (SELECT event_type, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 3599999999 MICROSECONDS FOLLOWING) - (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - rank() OVER (PARTITION BY event_type ORDER BY ts)) AS count, event_id FROM events)
SELECT event_id, event_type, count FROM m WHERE count >= 8""")
def upload_bursts(spark, d):
    return burst_windows(b.read(spark, d, "events").select("event_id", "event_type", "ts"), "event_type", "ts", "event_id").filter("count >= 8").select("event_id", "event_type", "count")


@query("""WITH u AS (SELECT event_type AS owner, (user_id * 7 + event_id // 40) % 400 AS value, count(*) AS n FROM events GROUP BY ALL),
v AS (SELECT value, sum(n) AS total, max(n) AS top, min(owner) FILTER (n = m) AS owner FROM (SELECT *, max(n) OVER (PARTITION BY value) AS m FROM u) GROUP BY value),
o AS (SELECT owner, sum(n) AS own FROM u GROUP BY 1)
SELECT value, owner, top AS owned, total::BIGINT AS total FROM v JOIN o USING (owner) WHERE top >= 0.5 * total AND top <= 0.07 * own""")
def exclusive_values(spark, d):
    e = b.read(spark, d, "events").select(F.col("event_type").alias("owner"), ((F.col("user_id") * 7 + F.floor(F.col("event_id") / 40)) % 400).alias("value"))
    u = e.groupBy("owner", "value").agg(F.count("*").alias("n"))
    v = u.groupBy("value").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), "owner")).alias("top"))
    o = u.groupBy("owner").agg(F.sum("n").alias("own"))
    out = v.select("value", F.col("top.owner").alias("owner"), (-F.col("top.m")).alias("owned"), "total").join(o, "owner")
    return out.filter("owned >= 0.5 * total AND owned <= 0.07 * own").select("value", "owner", "owned", "total")


@query("""WITH p AS (SELECT p_brand AS contributor, p_size || '/' || p_type AS key, count(*) AS n FROM part GROUP BY ALL), a AS (SELECT key, sum(n) AS total FROM p GROUP BY 1), c AS (SELECT contributor, sum(n) AS own FROM p GROUP BY 1)
SELECT contributor, key, n FROM p JOIN a USING (key) JOIN c USING (contributor) WHERE total = n AND n < 0.5 * own""")
def unique_profiles(spark, d):
    p = b.read(spark, d, "part").groupBy(F.col("p_brand").alias("contributor"), F.concat_ws("/", F.col("p_size").cast("string"), "p_type").alias("key")).agg(F.count("*").alias("n"))
    a = p.groupBy("key").agg(F.sum("n").alias("total"))
    own = p.groupBy("contributor").agg(F.sum("n").alias("own"))
    return p.join(a, "key").join(own, "contributor").filter("total = n AND n < 0.5 * own").select("contributor", "key", "n")


@query("""SELECT CASE WHEN doc_id % 50 = 7 THEN 'digest mismatch' WHEN n_chars < 300 THEN 'unreadable' ELSE 'ok' END AS kind, source AS contributor, count(*) AS n FROM documents GROUP BY ALL""")
def integrity_groups(spark, d):
    docs = b.read(spark, d, "documents").select("doc_id", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    declared = F.when(F.col("doc_id") % 50 == 7, F.lit("SHA256:00")).otherwise(F.concat(F.lit("sha256:"), F.upper("digest")))
    kind = F.when(c.digest_form(declared) != c.digest_form(F.col("digest")), "digest mismatch").when(F.col("n_chars") < 300, "unreadable").otherwise("ok")
    return docs.groupBy(kind.alias("kind"), F.col("source").alias("contributor")).agg(F.count("*").alias("n"))


_PRED = "SELECT source AS contributor, lang AS declared, CASE WHEN doc_id % 13 = 0 THEN 'en' WHEN doc_id % 17 = 0 THEN NULL WHEN source = 'src3' AND doc_id % 3 = 0 THEN 'fr' ELSE lang END AS inferred FROM documents"


def _predicted(spark, d):
    i = F.col("doc_id")
    inferred = F.when(i % 13 == 0, "en").when(i % 17 == 0, F.lit(None)).when((F.col("source") == "src3") & (i % 3 == 0), "fr").otherwise(F.col("lang"))
    return b.read(spark, d, "documents").select(F.col("source").alias("contributor"), F.col("lang").alias("declared"), inferred.alias("inferred"))


@query(f"SELECT contributor, declared, count(*) FILTER (inferred = 'de') AS de, count(*) FILTER (inferred = 'en') AS en, count(*) FILTER (inferred = 'es') AS es, count(*) FILTER (inferred = 'fr') AS fr, count(*) FILTER (inferred IS NULL) AS uncertain FROM ({_PRED}) GROUP BY ALL")
def confusion_by_contributor(spark, d):
    rows = _predicted(spark, d).fillna({"inferred": "uncertain"})
    return rows.groupBy("contributor", "declared").pivot("inferred", ["de", "en", "es", "fr", "uncertain"]).count().fillna(0)


def transition_tests(rows):
    """(contributor, declared, inferred) with k of n, the others' k and n, difficulty, p0 and the binomial tail.

    Every quantity of "all others" is a total less one's own; error rates count decided rows of other classes.
    """
    r = rows.withColumn("wrong", (F.col("inferred") != F.col("declared")).cast("long")).withColumn("decided", F.col("inferred").isNotNull().cast("long"))
    cell = r.groupBy("contributor", "declared").agg(F.count("*").alias("n"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("w"), F.sum("decided").alias("m"))
    over = lambda *by: Window.partitionBy(*by)
    everyone = cell.agg(F.sum("w").alias("tw"), F.sum("m").alias("tm"))
    cell = cell.withColumn("n_d", F.sum("n").over(over("declared"))).withColumn("w_c", F.sum("w").over(over("contributor"))).withColumn("m_c", F.sum("m").over(over("contributor"))).withColumn("w_d", F.sum("w").over(over("declared"))).withColumn("m_d", F.sum("m").over(over("declared"))).crossJoin(F.broadcast(everyone))  # one row
    e_c = (F.col("w_c") - F.col("w")) / F.greatest(F.col("m_c") - F.col("m"), F.lit(1))
    e_o = (F.col("tw") - F.col("w_c") - F.col("w_d") + F.col("w")) / F.greatest(F.col("tm") - F.col("m_c") - F.col("m_d") + F.col("m"), F.lit(1))
    cell = cell.withColumn("difficulty", F.greatest(F.lit(1.0), e_c / F.greatest(e_o, F.lit(1e-3))))
    k = r.filter("inferred <> declared").groupBy("contributor", "declared", "inferred").agg(F.count("*").alias("k"))
    k = k.withColumn("k_o", F.sum("k").over(over("declared", "inferred")) - F.col("k"))
    out = k.join(cell.select("contributor", "declared", "n", (F.col("n_d") - F.col("n")).alias("n_o"), "difficulty"), ["contributor", "declared"])
    out = out.withColumn("p0", F.least(F.lit(0.95), (F.col("k_o") + 0.5) / (F.col("n_o") + 1) * F.col("difficulty")))
    return out.withColumn("p", special.binomial_tail(F.col("k").cast("double"), F.col("n").cast("double"), "p0"))


@query(f"""WITH r AS ({_PRED}), k AS (SELECT contributor, declared, inferred, count(*) AS k FROM r WHERE inferred <> declared GROUP BY ALL)
SELECT contributor, declared, inferred, k, (SELECT count(*) FROM r WHERE r.contributor = k.contributor AND r.declared = k.declared) AS n,
  (SELECT count(*) FROM r WHERE r.contributor <> k.contributor AND r.declared = k.declared AND r.inferred = k.inferred) AS k_o, (SELECT count(*) FROM r WHERE r.contributor <> k.contributor AND r.declared = k.declared) AS n_o,
  round(greatest(1.0, (SELECT coalesce(sum((r.inferred <> r.declared)::INT), 0) / greatest(count(r.inferred), 1) FROM r WHERE r.contributor = k.contributor AND r.declared <> k.declared)
    / greatest(1e-3, (SELECT coalesce(sum((r.inferred <> r.declared)::INT), 0) / greatest(count(r.inferred), 1) FROM r WHERE r.contributor <> k.contributor AND r.declared <> k.declared))), 6) AS difficulty FROM k""")
def label_transitions(spark, d):
    return transition_tests(_predicted(spark, d)).select("contributor", "declared", "inferred", "k", "n", "k_o", "n_o", F.round("difficulty", 6).alias("difficulty"))


@query()
def systematic_mislabel(spark, d):
    """Transitions that exceed the other contributors' rate: q < 0.01, at least 5, three times the rate."""
    t = st.bh_qvalues(transition_tests(_predicted(spark, d)), "p").filter("q < 0.01 AND k >= 5").filter(F.col("k") / F.col("n") / F.col("p0") >= 3)
    return t.select("contributor", "declared", "inferred", "k", "n", F.round("p0", 6).alias("p0"), F.round("q", 8).alias("q"))


@query("SELECT count(*) * 5 AS n_true, true AS enough FROM embeddings WHERE vec_id % 50 = 0")
def knn_indexed_recall(spark, d):
    """Neighbours by the inverted file over all rows, for ids divisible by 50, against the exact ones: 0.9 or more are found."""
    v = b.vectors(spark, d)
    asked = v.filter("vec_id % 50 = 0")
    found = ivf.search(asked, v, "vec_id", "embedding", 5, ivf.fit(v, "vec_id", "embedding", 5))
    return ivf.recall(found, asked, v, "vec_id", "embedding", 5).select("n_true", (F.col("n_found") >= 0.9 * F.col("n_true")).alias("enough"))
