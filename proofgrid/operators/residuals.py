"""Groups of samples that share a faint pattern: a cosine join of dense residuals, and components that keep to their template.

1. ``centred``: residuals less their mean at each place (the mean comes from sums by task), as unit vectors.
2. ``links``: all pairs are compared, in matrix products. Rows are dealt into parts of about ``most``, any two parts meet in
   one task, and a task gives a spanning set of its links, not all its pairs. Copies (rows of one ``copy`` class) aren't
   compared with each other. The work grows with the square of the rows; a ``recall`` below 1 compares less: signs of random
   projections then give each vector a key in each of several tables, and only rows that share a key are compared. Bits and
   tables follow from the threshold and the number of rows so that a single pair at the threshold is found with a
   probability of at least ``recall``. A bucket beyond ``most`` rows is dealt into parts too, and loses nothing.
3. ``groups``: components of ``least`` rows and more, up to a share of all; members stay whose cosine with the group's mean
   is at least the root of the threshold; the mean cosine between members, less pairs of copies, must reach it too. Sums
   over vectors give it without pairs.

Rows with a null vector or one without deviation have no links. Vectors have one length. An empty table gives no groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from proofgrid.operators.components import connected_components, shared_table


def plan(threshold: float, rows: int, recall: float = 0.95, bucket: int = 256, most_tables: int = 64) -> tuple[int, int]:
    """(bits, tables): bits for buckets of about ``bucket`` rows, as far as the tables that the recall needs allow."""
    agree = 1 - acos(min(1.0, threshold)) / pi
    for bits in range(max(0, ceil(log2(max(1, rows) / bucket))), -1, -1):
        met = agree**bits
        tables = 1 if met >= recall else ceil(log(1 - recall) / log(1 - met))
        if tables <= most_tables:
            return bits, tables
    return 0, 1


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = None, 0
    for b in batches:
        if b.num_rows:
            x = _vectors(b.column(0))
            total, n = x.sum(0) if total is None else total + x.sum(0), n + len(x)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total))), pa.array(total), pa.array([n] * len(total))], ["pos", "s", "n"])


def centred(rows: DataFrame, vector: str, id_col: str, copy: str | None = None) -> DataFrame:
    """(id, copy, u): unit residuals, as a table."""
    own = rows.filter(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), (F.col(copy) if copy else F.col(id_col)).alias("copy"), F.col(vector).cast("array<double>").alias("v"))
    sums = own.select("v").mapInArrow(_partial, "pos long, s double, n long").groupBy("pos").agg((F.sum("s") / F.sum("n")).alias("m")).orderBy("pos").collect()
    mean = F.expr(f"array({', '.join(f'{r.m!r}D' for r in sums)})") if sums else F.expr("array(0D)")
    out = own.withColumn("v", F.zip_with("v", mean, lambda x, m: x - m))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return shared_table(out.withColumn("_n", norm).filter("_n > 1e-9").select("id", "copy", F.transform("v", lambda x: x / F.col("_n")).alias("u")))


def _keys(width: int, bits: int, tables: int, seed: int, whole_rows: bool = True):
    planes = np.random.default_rng(seed).normal(size=(width, tables * bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            for start in range(0, b.num_rows, 1_024):
                part = b.slice(start, 1_024)
                keys = ((_vectors(part.column(2)) @ planes > 0).reshape(part.num_rows, tables, bits) * weights).sum(2)
                for t in range(tables):
                    own = [pa.array(np.full(part.num_rows, t, np.int32)), pa.array(keys[:, t])]
                    yield pa.RecordBatch.from_arrays(own + part.columns, ["tab", "key", "id", "copy", "u"]) if whole_rows else pa.RecordBatch.from_arrays(own, ["tab", "key"])

    return run


def _forest(x: np.ndarray, copies: np.ndarray, first: int, threshold: float, high: int = 512, wide: int = 4_096) -> Iterator[tuple[int, int]]:
    """Links that span what pairs connect: of all rows, or, with ``first`` rows of a part, of those with the rest."""
    n = len(x)
    label = np.arange(n)
    rows = first if first < n else n
    room = np.empty((high, wide))
    for a in range(0, rows, high):
        for b in range(first if first < n else a, n, wide):
            left, right = x[a : min(a + high, rows)], x[b : b + wide]
            product = np.matmul(left, right.T, out=room if (len(left), len(right)) == room.shape else None)
            r, c = np.divmod(np.flatnonzero(product >= threshold), len(right))
            r, c = r + a, c + b
            new = (label[r] != label[c]) & (copies[r] != copies[c])
            if not new.any():
                continue
            r, c = r[new], c[new]
            _, at = np.unique(label[r] * n + label[c], return_index=True)  # one pair for two labels
            up = {}

            def top(k: int, up: dict = up) -> int:
                while k in up:
                    k = up[k]
                return k

            for i, j in zip(r[at].tolist(), c[at].tolist(), strict=True):
                u, v = top(int(label[i])), top(int(label[j]))
                if u != v:
                    up[max(u, v)] = min(u, v)
                    yield i, j
            root = np.arange(n)
            for k in up:
                root[k] = top(k)
            label = root[label]


def _spanning(threshold: float, id_type: pa.DataType):
    """A spanning set of the links of each bucket; rows (bucket, second, id, copy, u) come sorted by bucket and ``second``,
    which marks those of the second of two parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, vectors = None, [], []

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            x = np.vstack(vectors)
            vectors.clear()
            second = rows["second"].to_numpy()
            copies = rows["copy"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            # of two parts, rows of one only (its partner has none) have no pairs here
            pairs = [] if second.all() or (rows["two"][0].as_py() and not second.any()) else list(_forest(x, copies, int((~second).sum()), threshold))
            ids = rows["id"].combine_chunks()
            return pa.RecordBatch.from_arrays([ids.take(pa.array([p[k] for p in pairs], pa.int64())).cast(id_type) for k in (0, 1)], ["i", "j"])

        for b in batches:
            keys = b.column(0).to_pylist()
            edges = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if s < e:
                    if held and keys[s] != bucket:
                        yield flush()
                        held.clear()
                    bucket = keys[s]
                    part = b.slice(s, e - s)
                    held.append(part.select(["bucket", "two", "second", "id", "copy"]))
                    vectors.append(_vectors(part.column(5)))
        if held:
            yield flush()

    return run


def links(units: DataFrame, threshold: float, recall: float = 1.0, most: int | None = None, seed: int = 0) -> DataFrame:
    """(i, j): links between rows with a cosine of ``threshold`` or more, which span what these connect; with a ``recall`` below 1,
    what those connect that share a key. ``most`` rows make a part (32 MB of doubles, if not given)."""
    first = units.select(F.size("u").alias("w")).first()
    rows, width = units.count(), first.w if first else 1
    most = most or max(1_024, (1 << 22) // max(1, width))
    kind = units.schema["id"].dataType
    rows_of = units.select("id", "copy", "u")
    bits, tables = plan(threshold, rows, recall) if recall < 1 else (0, 1)
    if bits:
        # keys are made twice, so that no table has a vector for each of its keys
        dealt = rows_of.mapInArrow(_keys(width, bits, tables, seed), f"tab int, key long, id {kind.simpleString()}, copy {units.schema['copy'].dataType.simpleString()}, u array<double>")
        size = rows_of.mapInArrow(_keys(width, bits, tables, seed, False), "tab int, key long").groupBy("tab", "key").agg(F.count("*").alias("n")).filter(F.col("n") > most)
        size = F.broadcast(size.select("tab", "key", F.ceil(F.col("n") / most).cast("int").alias("parts")))  # a bucket is a share of all: rows / most at most
        dealt = dealt.join(size, ["tab", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    else:
        # two tasks or more for each core, while a part has 1,024 rows
        parts = max(-(-rows // most), min(ceil(2 * sqrt(units.sparkSession.sparkContext.defaultParallelism)), rows // 1_024), 1)
        dealt = rows_of.select(F.lit(0).alias("tab"), F.lit(0).cast("long").alias("key"), "*", F.lit(parts).alias("parts"))
    own = dealt.withColumn("own", F.pmod(F.xxhash64("id", "tab"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    two = [(low < high).alias("two"), ((low < high) & (F.col("own") == high)).alias("second"), "id", "copy", "u"]
    if bits:
        met = own.select(F.concat_ws(":", "tab", "key", low, high).alias("bucket"), *two).repartition("bucket")
    else:
        met = own.select((F.expr("greatest(own, other) * (greatest(own, other) + 1) div 2").cast("int") + low).alias("bucket"), *two).repartitionById(parts * (parts + 1) // 2, "bucket")
    tagged = met.sortWithinPartitions("bucket", "second", "id")
    # a table, as components read their edges more than once
    return shared_table(tagged.mapInArrow(_spanning(threshold, to_arrow_type(kind)), f"i {kind.simpleString()}, j {kind.simpleString()}"))


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _mean(rows: DataFrame) -> DataFrame:
    """(component, n, total): summed vectors."""
    place = rows.select("component", F.posexplode("u").alias("pos", "x")).groupBy("component", "pos").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return place.groupBy("component").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("total"))


def groups(units: DataFrame, threshold: float, least: int = 6, max_fraction: float = 0.4, **how) -> tuple[DataFrame, DataFrame]:
    """(component, n, consensus) of the groups found, and (id, component) of their members."""
    comp = connected_components(links(units, threshold, **how), "i", "j")
    rows = units.count()
    own = units.join(comp, F.col("id") == F.col("node")).drop("node")
    size = own.groupBy("component").agg(F.count("*").alias("n")).filter((F.col("n") >= least) & (F.col("n") <= max_fraction * rows))
    own = shared_table(own.join(size.select("component"), "component", "left_semi"))
    template = _mean(own).withColumn("t", F.sqrt(_dot(F.col("total"), F.col("total")))).filter("t > 0")
    kept = shared_table(own.join(template.select("component", "total", "t"), "component").filter(_dot(F.col("u"), F.col("total")) / F.col("t") >= sqrt(threshold)).select("id", "copy", "u", "component"))
    # all pairs of members, less those of copies, by the squares of summed vectors
    square = lambda s: s.select("component", "n", _dot(F.col("total"), F.col("total")).alias("sq"))
    alike = square(_mean(kept.withColumn("component", F.struct("component", "copy")))).groupBy(F.col("component.component").alias("component")).agg(F.sum("sq").alias("own"))
    found = square(_mean(kept)).join(alike, "component").withColumn("consensus", (F.col("sq") - F.col("own")) / (F.col("n") * (F.col("n") - 1)))
    found = shared_table(found.filter((F.col("n") >= least) & (F.col("consensus") >= threshold)).select("component", "n", "consensus"))
    return found, kept.join(found.select("component"), "component", "left_semi").select("id", "component")
