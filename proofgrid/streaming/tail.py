"""Streams over the same logs: a resumable tail, upload bursts by event time, and link checks line by line.

These go beyond batch queries; their results agree with the batch operators on the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def read_stream(spark: SparkSession, path: str, files_at_once: int = 1_000) -> DataFrame:
    """Parquet files as a stream; the schema is that of the files there now."""
    source = path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once).parquet(source)


def tail(events: DataFrame, seq: str, after: int) -> DataFrame:
    """Rows beyond a sequence number: what a reader that stopped there has not seen."""
    return events.filter(F.col(seq) > after)


def bursts(events: DataFrame, key: str, ts: str, window: str = "1 hour", slide: str = "10 minutes", late: str = "1 hour", least: int = 8) -> DataFrame:
    """(key, start, n): sliding windows with at least ``least`` rows, closed once the watermark has passed."""
    at = events.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    counts = at.groupBy(key, F.window("_at", window, slide)).agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= least).select(key, F.col("window.start").alias("start"), "n")


class _Links(StatefulProcessor):
    """The last hash of each ledger, and whether its chain holds so far."""

    def __init__(self, genesis: str):
        self.genesis = genesis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("chain", "tip string, trusted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("line")
        tip, trusted = self.state.get() if self.state.exists() else (self.genesis, True)
        out = []
        for r in pdf.itertuples():
            linked = r.prev == tip
            trusted = bool(trusted and linked)
            tip = r.entry_hash
            out.append((key[0], r.line, linked, trusted))
        self.state.update((tip, trusted))
        yield pd.DataFrame(out, columns=["ledger", "line", "linked", "trusted"])

    def close(self) -> None:
        pass


def link_stream(records: DataFrame, genesis: str) -> DataFrame:
    """(ledger, line, linked, trusted) as lines arrive, in line order within a batch; needs the RocksDB state store."""
    return records.groupBy("ledger").transformWithStateInPandas(statefulProcessor=_Links(genesis), outputStructType="ledger string, line long, linked boolean, trusted boolean", outputMode="Append", timeMode="None")
