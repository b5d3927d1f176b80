"""Writers: content-addressed evidence, report folders, dataset exports and cached features."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_evidence(blobs: DataFrame, root: str) -> None:
    """Blobs (content, media_type) as Parquet below root/sha256=<two digits>; a digest that is there already isn't written again."""
    rows = blobs.withColumn("digest", F.sha2("content", 256)).dropDuplicates(["digest"]).withColumn("prefix", F.substring("digest", 1, 2))
    try:
        rows = rows.join(blobs.sparkSession.read.parquet(root).select("digest"), "digest", "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    rows.write.mode("append").partitionBy("prefix").parquet(root)


def verify_evidence(spark: SparkSession, root: str) -> DataFrame:
    """(digest, ok) of every stored blob."""
    return spark.read.parquet(root).select("digest", (F.sha2("content", 256) == F.col("digest")).alias("ok"))


def write_report(root: str, spark: SparkSession, parts: dict[str, str]) -> None:
    """Text files and a manifest.json with the digest of each, through the file system that ``root`` names."""
    listed = {}
    manifest = {**parts}
    for name, text in parts.items():
        listed[name] = "sha256:" + hashlib.sha256(text.encode()).hexdigest()
    manifest["manifest.json"] = json.dumps({"files": listed}, sort_keys=True)
    jvm = spark._jvm
    for name, text in manifest.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(text.encode()))
        out.close()


def export_manifest(samples: DataFrame, root: str) -> None:
    """manifest.jsonl as a folder of parts, one object a line."""
    box = F.transform("boxes", lambda b: F.struct(b["category"].alias("category"), F.array(b["x"], b["y"], b["w"], b["h"]).alias("bbox")))
    samples.select(F.to_json(F.struct("id", "file", "label", "contributor", "batch", "source", "sensor", "timestamp", "split", box.alias("boxes"))).alias("value")).write.text(f"{root}/manifest.jsonl")


def export_yolo(samples: DataFrame, root: str, names: list[str]) -> None:
    """Label rows (file stem, class and relative box) as text, partitioned by stem."""
    cls = F.array_position(F.array(*map(F.lit, names)), F.col("b.category")) - 1
    rows = samples.select(F.regexp_replace("file", r"\.[^.]+$", "").alias("stem"), "width", "height", F.explode("boxes").alias("b"))
    line = F.format_string("%d %.6f %.6f %.6f %.6f", cls, (F.col("b.x") + F.col("b.w") / 2) / F.col("width"), (F.col("b.y") + F.col("b.h") / 2) / F.col("height"), F.col("b.w") / F.col("width"), F.col("b.h") / F.col("height"))
    rows.filter(cls >= 0).select("stem", line.alias("value")).write.partitionBy("stem").text(f"{root}/labels")


def cached(df: DataFrame, root: str, *key: str) -> DataFrame:
    """``df``, written once below a digest of the key and read from there afterwards."""
    path = f"{root}/{hashlib.sha256('|'.join(key).encode()).hexdigest()}"
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
