"""Readers of ledgers, anchors and trust roots, and verified report folders."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.functions.provenance import from_base64url

MAX_LINE = 1 << 20


def ledger_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ledger_file, line, raw): lines in file order, blank ones left out; one beyond 1 MiB has a null text.

    A whole file is one record, as line numbers exist only within it; ledgers are many files of moderate size.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("ledger_file"), "value")
    lines = files.select("ledger_file", F.posexplode(F.split("value", "\n")).alias("line", "raw")).filter(F.trim("raw") != "")
    return lines.select("ledger_file", (F.col("line") + 1).cast("long").alias("line"), F.when(F.octet_length("raw") <= MAX_LINE, F.col("raw")).otherwise("{}").alias("raw"))


def anchors(spark: SparkSession, path: str) -> DataFrame:
    """(anchor, ledger, tree_size, root, ts, key_id, sig); lines that are no anchor have a null tree_size."""
    return ledger_lines(spark, path).select(F.concat_ws(":", "ledger_file", F.col("line").cast("string")).alias("anchor"), F.from_json("raw", "ledger string, tree_size long, root string, ts string, key_id string, sig string").alias("a")).select("anchor", "a.*")


def trust_root(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(keys, approved models) of a version 1 trust root. A key id must be derived from its key."""
    schema = "version int, keys array<struct<key_id:string,public_key:string,roles:array<string>,not_before:string,not_after:string,revoked:boolean,comment:string>>, approved_models array<struct<name:string,artifact_digest:string,param_digest:string,preprocess_digest:string,architecture_digest:string>>"
    doc = spark.read.schema(schema).option("multiLine", "true").json(path).first()
    if doc is None or doc.version != 1:
        raise ValueError("not a trust root of version 1")
    for k in doc["keys"] or []:
        if k.key_id != "ed25519:" + hashlib.sha256(from_base64url(k.public_key)).hexdigest()[:16]:
            raise ValueError(f"{k.key_id} is not the id of its key")
    keys = spark.createDataFrame([(k.key_id, k.public_key, k.roles or [], k.not_before, k.not_after, bool(k.revoked)) for k in doc["keys"] or []], "key_id string, public_key string, roles array<string>, not_before string, not_after string, revoked boolean")
    models = spark.createDataFrame([tuple(m) for m in doc.approved_models or []], "name string, artifact_digest string, param_digest string, preprocess_digest string, architecture_digest string")
    return keys, models


def verify_report(spark: SparkSession, root: str) -> DataFrame:
    """(file, ok) for every file that manifest.json lists with its digest."""
    listed = spark.read.option("multiLine", "true").schema("files map<string,string>").json(f"{root}/manifest.json").select(F.explode("files").alias("file", "declared"))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.substring_index("path", "/", -1).alias("file"), F.sha2("content", 256).alias("digest"))
    return listed.join(found, "file", "left").select("file", F.coalesce(F.regexp_replace("declared", "^sha256:", "") == F.col("digest"), F.lit(False)).alias("ok"))
