"""Tables in the shared folder, and passes over texts in bounded chunks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word contracts, as an escaped class body for Java and RE2 patterns.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"
#: Bytes of text that a pass over texts handles at once (a longer text is handled alone).
CHUNK_BYTES = 2 << 20
#: Bytes of an Arrow batch that Spark sends to a Python worker, whatever the length of its rows.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a local one only where the setting is unset and the session local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: a cluster needs a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='proofgrid-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written as a table in the shared folder and read again: later steps survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches bounded in bytes: 10,000 long texts would not fit a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_of(df: DataFrame) -> Column:
    """All columns of ``df`` in one struct, whatever their names."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it while ``df`` has a column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_join(rows: DataFrame, few: DataFrame, keys: list[str], times: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``few``, which has one row for each of ``keys`` and the number of ``rows`` that have it.

    Keys with a thousandth of ``total`` or more, of which there are 1,000 at most, go by broadcast; so no task gets all
    rows of such a key. ``few`` is read three times and should be a table.
    """
    hot = F.broadcast(few.filter(F.col(times) * 1000 >= total))
    rest = few.filter(F.col(times) * 1000 < total)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(keys), keys, "left_anti").join(rest, keys))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches whose texts hold at most ``limit`` bytes together, with the texts as UTF-8."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        start = size = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
            if size and size + n > limit:
                yield batch.slice(start, i - start), column.slice(start, i - start).to_pylist()
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start), column.slice(start).to_pylist()


def columns(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a stream that is sorted by ``keys`` (integers, no nulls), each as one table."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        arrays = [columns(batch, k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for a in arrays:
            change[1:] |= a[1:] != a[:-1]
        first = tuple(a[0] for a in arrays)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            if s and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
        last = tuple(a[-1] for a in arrays)
    if held:
        yield pa.Table.from_batches(held)


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, c in zip(columns(batch, "block").to_pylist(), columns(batch, "counts").to_pylist(), strict=True):
            c = np.frombuffer(c, np.int64)
            total[k] = total[k] + c if k in total else c
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["block", "counts"])


def summed(blocks: DataFrame, size: int, n_blocks: int) -> np.ndarray:
    """Sum of count vectors of a fixed ``size`` that tasks sent as ``n_blocks`` rows (block int, counts binary) each."""
    out = np.zeros((n_blocks, size // n_blocks), np.int64)
    for r in blocks.repartition(n_blocks, "block").mapInArrow(_sum_blocks, "block int, counts binary").collect():
        out[r.block] = np.frombuffer(r.counts, np.int64)
    return out.ravel()


def as_blocks(counts: np.ndarray, n_blocks: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(n_blocks), pa.int32()), pa.array([b.tobytes() for b in counts.astype(np.int64).reshape(n_blocks, -1)], pa.binary())], ["block", "counts"])
