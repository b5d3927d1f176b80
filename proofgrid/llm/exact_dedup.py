"""Exact deduplication as a stateful stream, with DataFrame functions only.

Documents stream in as files; texts are normalised (each run of white space becomes one space) and keyed by
the SHA-256 of the result. For each digest, state that is kept on disk (RocksDB) and never expires retains
the stable identifier (the least id so far), the content locator of that row (file and row in it) and the
count. Late files update the state, so the outcome doesn't depend on their order; a stream that starts again
on its checkpoint goes on where it stopped. The state is then read as a table.

A digest hit is checked on full bytes: of the texts that share a digest, the least and the greatest must be
equal, which partial aggregation decides before any shuffle. Should they differ, the rows of that digest are
grouped by the texts themselves.

Null counts as empty. Of rows that repeat with the same id, the first by file and place stays; a row without
an id stays only if no copy has one. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.llm.common import SPACE, shared_dir, text_or_empty

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # files grow as they are written: small stores in many partitions don't reserve disk
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def normalised(text_col: str) -> Column:
    return F.regexp_replace(text_or_empty(text_col), f"[{SPACE}]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def stream_state(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256, checkpoint: str | None = None, files_at_once: int = 10_000) -> DataFrame:
    """(digest, keep, group_size) after all files at ``path``; keep: (no_id, doc_id, file, place). ``checkpoint`` names an
    earlier stream's folder to go on with."""
    folder = checkpoint or f"{shared_dir(spark)}/dedup-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    source = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"  # a pattern may match one file too
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source)
    keyed = rows.select(digest(normalised(text_col)).alias("digest"), _locator(id_col).alias("at"))
    state = keyed.groupBy("digest").agg(F.min("at").alias("keep"), F.count("*").alias("group_size"))
    with _settings(spark, STATE):
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", folder).trigger(availableNow=True).start()
        query.awaitTermination()
    kept = spark.read.format("statestore").option("path", folder).load()
    value = [f"value.`{f.name}`" for f in kept.schema["value"].dataType.fields]
    return kept.select(F.col("key.digest").alias("digest"), F.col(value[0]).alias("keep"), F.col(value[1]).alias("group_size"))


def _locator(id_col: str) -> Column:
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))


def dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of the Parquet files at ``path``."""
    with _settings(spark, STATE):
        state = stream_state(spark, path, id_col, text_col, digest)
        rows = spark.read.parquet(path).select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm"), _locator(id_col).alias("at"))
        rows = rows.withColumn("digest", digest(F.col("norm")))
        apart = rows.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).filter("low <> high").select("digest")
        collided = [r.digest for r in apart.limit(1).collect()]
        thin = rows.select("doc_id", "at", "digest", sha256(F.col("norm")).alias("text_sha256"))
        out = thin.join(state, "digest", "left")
        if collided:  # some digest stands for several texts: those go by the texts
            by_text = rows.join(apart, "digest", "left_semi")
            own = by_text.groupBy("digest", "norm").agg(F.min("at").alias("keep"), F.count("*").alias("group_size"))
            again = by_text.join(own, ["digest", "norm"]).select("doc_id", "at", "digest", sha256(F.col("norm")).alias("text_sha256"), "keep", "group_size")
            out = out.join(apart, "digest", "left_anti").select(again.columns).unionByName(again)
        return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("at") == F.col("keep")).alias("same"), ((F.col("at.file") == F.col("keep.file")) & (F.col("at.place") == F.col("keep.place"))).alias("kept"), "text_sha256").drop("same")


SQL = f"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[{SPACE}]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
