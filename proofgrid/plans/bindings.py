"""Roles of the library bound to the driver tables; operators never name a table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """documents as samples: contributor = source, label = lang, digest of the text."""
    docs = read(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("label"), F.col("source").alias("contributor"), F.concat(F.lit("b"), (F.col("doc_id") % 4).cast("string")).alias("batch"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))


def thin_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples without the digest, so that texts are not read."""
    return read(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("label"), F.col("source").alias("contributor"), F.concat(F.lit("b"), (F.col("doc_id") % 4).cast("string")).alias("batch"))


def flags(spark: SparkSession, d: str) -> DataFrame:
    """Toxic labels as flags; class, severity and confidence by id arithmetic."""
    i = F.col("doc_id")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (i % n + 1).cast("int"))
    return read(spark, d, "labels").filter("toxic = 1").select(i.alias("sample_id"), pick(FLAG_CLASSES, 3).alias("attack_class"), (F.lit(0.4) + (i % 50) / 100.0).alias("confidence"), pick(("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"), 5).alias("severity"))


FLAG_CLASSES = ("systematic_mislabel", "duplicate_flood", "ood_injection")
FINDING_CLASSES = ("record_modification", "model_substitution", "metadata_manipulation", "ood_injection", "drift_manipulation", "duplicate_flood", "corrupted_samples", "behavioural_divergence")
FINDING_LAYERS = ("PROVENANCE", "MODEL", "DATA", "DATA", "DRIFT", "DATA", "DATA", "MODEL")

FLAGS_SQL = """
SELECT doc_id AS sample_id, ['systematic_mislabel','duplicate_flood','ood_injection'][(doc_id % 3 + 1)::INT] AS attack_class,
       0.4::DOUBLE + (doc_id % 50) / 100.0::DOUBLE AS confidence, ['INFO','LOW','MEDIUM','HIGH','CRITICAL'][(doc_id % 5 + 1)::INT] AS severity
FROM labels WHERE toxic = 1"""


def findings(spark: SparkSession, d: str) -> DataFrame:
    """orders as findings of seven scans."""
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    return o.select(
        k.alias("finding_id"), (F.col("o_custkey") % 7).alias("scan_id"), pick(("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"), 5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("severity"),
        F.when(F.col("o_orderstatus") == "F", "QUARANTINE").when(F.col("o_orderstatus") == "O", "REVIEW").otherwise("ACCEPT").alias("disposition"),
        pick(FINDING_CLASSES, k % 8).alias("attack_class"), pick(FINDING_LAYERS, k % 8).alias("layer"), F.concat(F.lit("detector-"), (k % 5).cast("string")).alias("detector_id"),
        (F.lit(0.3) + (k % 70) / 100.0).alias("confidence"), (k % 2 == 0).alias("deterministic"), (k % 3 == 0).alias("calibrated"),
        F.when(k % 4 == 0, "DEGRADED").otherwise("FULL").alias("availability"), F.slice(F.array(F.lit("s1"), F.lit("s2"), F.lit("s3")), F.lit(1), (k % 4).cast("int")).alias("signals"),
        F.when(k % 6 == 1, F.create_map(F.lit("parameters"), F.lit("identical"))).otherwise(F.create_map().cast("map<string,string>")).alias("tags"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("subject"), F.col("o_orderdate").alias("created_at"),
    )


FINDINGS_SQL = """
SELECT o_orderkey AS finding_id, o_custkey % 7 AS scan_id,
  ['INFO','LOW','MEDIUM','HIGH','CRITICAL'][6 - substr(o_orderpriority, 1, 1)::INT] AS severity,
  CASE o_orderstatus WHEN 'F' THEN 'QUARANTINE' WHEN 'O' THEN 'REVIEW' ELSE 'ACCEPT' END AS disposition,
  ['record_modification','model_substitution','metadata_manipulation','ood_injection','drift_manipulation','duplicate_flood','corrupted_samples','behavioural_divergence'][(o_orderkey % 8 + 1)::INT] AS attack_class,
  ['PROVENANCE','MODEL','DATA','DATA','DRIFT','DATA','DATA','MODEL'][(o_orderkey % 8 + 1)::INT] AS layer,
  'detector-' || (o_orderkey % 5) AS detector_id, 0.3::DOUBLE + (o_orderkey % 70) / 100.0::DOUBLE AS confidence,
  o_orderkey % 2 = 0 AS deterministic, o_orderkey % 3 = 0 AS calibrated,
  CASE WHEN o_orderkey % 4 = 0 THEN 'DEGRADED' ELSE 'FULL' END AS availability, o_orderkey % 4 AS n_signals,
  o_orderkey % 6 = 1 AS identical, 'c' || o_custkey AS subject, o_orderdate AS created_at
FROM orders"""


def log(spark: SparkSession, d: str) -> DataFrame:
    """events as the ledgers of five writers; links and numbers are damaged by id arithmetic."""
    from pyspark.sql import Window

    e = read(spark, d, "events").select("event_id", "event_type", "user_id", F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256).alias("own"))
    along = Window.partitionBy("event_type").orderBy("event_id")
    e = e.withColumn("line", F.row_number().over(along).cast("long"))
    e = e.withColumn("entry_hash", F.when(F.col("line") % 500 == 0, F.lag("own").over(along)).otherwise(F.col("own")))
    e = e.withColumn("seq", F.when(F.col("line") % 211 == 0, F.col("line") + 1).when(F.col("line") % 211 == 1, F.col("line") - 1 - F.when(F.col("line") > 1, 1).otherwise(0)).when(F.col("line") % 307 == 0, F.col("line") + 2).otherwise(F.col("line") - 1))
    prev = F.coalesce(F.lag("entry_hash").over(along), F.lit("genesis"))
    return e.select(F.col("event_type").alias("ledger"), "line", "seq", "entry_hash", F.concat(F.lit("n"), F.when(F.col("line") % 401 == 0, F.col("event_id") - 1).otherwise(F.col("event_id")).cast("string")).alias("nonce"), F.when(F.col("line") % 97 == 0, F.lit("broken")).otherwise(prev).alias("prev"), F.concat(F.lit("k"), (F.col("user_id") % 12).cast("string")).alias("key_id"), "event_id")


LOG_SQL = """
SELECT ledger, line, seq, entry_hash, nonce, CASE WHEN line % 97 = 0 THEN 'broken' ELSE coalesce(lag(entry_hash) OVER (PARTITION BY ledger ORDER BY line), 'genesis') END AS prev, key_id, event_id
FROM (SELECT event_type AS ledger, line, event_id, 'k' || (user_id % 12) AS key_id,
        CASE WHEN line % 500 = 0 THEN lag(own) OVER (PARTITION BY event_type ORDER BY event_id) ELSE own END AS entry_hash,
        CASE WHEN line % 211 = 0 THEN line + 1 WHEN line % 211 = 1 THEN line - 1 - CASE WHEN line > 1 THEN 1 ELSE 0 END
             WHEN line % 307 = 0 THEN line + 2 ELSE line - 1 END AS seq,
        'n' || CASE WHEN line % 401 = 0 THEN event_id - 1 ELSE event_id END AS nonce
      FROM (SELECT event_id, event_type, user_id, sha256(event_id || '|' || event_type) AS own, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS line FROM events))"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings")


def axes(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as drift axes in long form: (is_ref, grp, axis, value); the reference shipped before 1998."""
    names = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    li = read(spark, d, "lineitem")
    pairs = F.explode(F.array(*(F.struct(F.lit(n[2:]).alias("axis"), F.col(n).alias("value")) for n in names)))
    return li.select((F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp")).alias("is_ref"), F.col("l_returnflag").alias("grp"), pairs.alias("p")).select("is_ref", "grp", "p.axis", "p.value")


AXES_SQL = "SELECT l_shipdate < TIMESTAMP '1998-01-01' AS is_ref, l_returnflag AS grp, unnest(['quantity','extendedprice','discount','tax']) AS axis, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem"


def imprints(spark: SparkSession, d: str) -> DataFrame:
    """documents as images: (sample_id, phash, dhash, phash_flip, dhash_flip, embedding). The embedding counts three-word
    strings by a hash in 64 places; the hashes are its places above the median, and above the place before, and those of
    the reversed counts. Each text is counted in its own row, so that none of its strings is sent. A row without an id counts none."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.when(F.col("doc_id").isNotNull(), F.col("text")).cast("binary").alias("text"))
    kind = dict(docs.dtypes)["sample_id"]
    return docs.mapInArrow(_imprinted, f"sample_id {kind}, phash long, dhash long, phash_flip long, dhash_flip long, embedding array<double>")


def _counts(text: bytes | None) -> np.ndarray:
    """How many three-word strings have each of 64 hashes: the last six bits of the first two bytes of their MD5."""
    words = (text or b"").split()  # of bytes: at \x20 and \x09 to \x0D alone
    places = [hashlib.md5(b"%b %b %b" % x, usedforsecurity=False).digest()[1] & 63 for x in zip(words, words[1:], words[2:], strict=False)]
    return np.bincount(np.array(places, np.int64), minlength=64)


def _packed(bits: np.ndarray) -> np.ndarray:
    return (bits * (1 << np.arange(bits.shape[1] - 1, -1, -1, dtype=np.int64))).sum(1)


def _imprinted(batches: Iterator[pa.RecordBatch], step: int = 1_024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for s in range(0, batch.num_rows, step):
            part = batch.slice(s, step)
            v = np.vstack([_counts(x.as_py()) for x in part.column(1)])
            hashes = []
            for c in (v, v[:, ::-1]):
                hashes += [_packed(c[:, :63] > np.sort(c[:, 1:], axis=1)[:, 31:32]), _packed(c[:, 1:] > c[:, :63])]
            embedding = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, 64, dtype=np.int32)), pa.array(v.ravel().astype(np.float64)))
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, hashes), embedding], ["sample_id", "phash", "dhash", "phash_flip", "dhash_flip", "embedding"])


IMPRINTS_SQL = r"""
w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(words) - 1, 1)), lambda i: ('0x' || substr(md5(array_to_string(words[i:i + 2], ' ')), 1, 4))::INT % 64)) AS place FROM w),
m AS (SELECT doc_id, map_from_entries(list({'k': place, 'v': n})) AS m FROM (SELECT doc_id, place, count(*) AS n FROM g GROUP BY ALL) GROUP BY 1),
v AS (SELECT w.doc_id AS i, list_transform(range(0, 64), lambda k: coalesce(map_extract_value(m, k), 0)::BIGINT) AS v FROM w LEFT JOIN m USING (doc_id)),
f AS (SELECT i, v, list_reverse(v) AS r, list_sort(v[2:])[32] AS mv, list_sort(list_reverse(v)[2:])[32] AS mr FROM v),
h AS MATERIALIZED (SELECT i, v::DOUBLE[] AS v, list_inner_product(v::DOUBLE[], v::DOUBLE[]) AS nn,
  list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 64), lambda k: (v[k] > mv)::BIGINT)), lambda p, q: p * 2 + q) AS p,
  list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 64), lambda k: (v[k + 1] > v[k])::BIGINT)), lambda p, q: p * 2 + q) AS d,
  list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 64), lambda k: (r[k] > mr)::BIGINT)), lambda p, q: p * 2 + q) AS pf,
  list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 64), lambda k: (r[k + 1] > r[k])::BIGINT)), lambda p, q: p * 2 + q) AS df FROM f)"""
