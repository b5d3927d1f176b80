"""What a model is: digests of its graph and its parameters that don't depend on names or partitions, and differences of
operator lists.

Tables: ops (model, k, op, attrs, inputs array<string>, outputs array<string>) in execution order k, inputs (model, i, name,
shape), outputs (model, i, shape), shapes (model, name, shape) of parameters; shapes and attrs are text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.operators.ledger import subtrees, tree_roots


def wired(ops: DataFrame, inputs: DataFrame, shapes: DataFrame) -> DataFrame:
    """(model, k, place, ref): every operand of every operator by where it comes from.

    in<i> is a graph input, t<k>.<j> output j of operator k, p<shape> a parameter and ? nothing known. A name means its
    latest definition before the operator, so names may be reused; definitions and uses of a name meet in one ordered
    pass over that name alone.
    """
    kind = "struct<j:int,ref:string>"
    k = F.col("k").cast("long")
    use = lambda x, i: F.struct(x.alias("name"), F.lit(None).cast(kind).alias("d"), F.lit(0).alias("late"), i.cast("int").alias("place"))
    made = lambda x, j: F.struct(x.alias("name"), F.struct(j.cast("int").alias("j"), F.concat(F.lit("t"), k.cast("string"), F.lit("."), j.cast("string")).alias("ref")).alias("d"), F.lit(1).alias("late"), F.lit(None).cast("int").alias("place"))
    named = lambda c, f: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), f)
    rows = ops.select("model", "k", F.explode(F.concat(named("inputs", use), named("outputs", made))).alias("e")).select("model", "e.name", k.alias("k"), "e.d", "e.late", "e.place")
    given = inputs.select("model", "name", F.lit(-1).cast("long").alias("k"), F.struct(F.col("i").cast("int").alias("j"), F.concat(F.lit("in"), F.col("i").cast("string")).alias("ref")).cast(kind).alias("d"), F.lit(1).alias("late"), F.lit(None).cast("int").alias("place"))
    # of equal names of one operator the last counts
    before = Window.partitionBy("model", "name").orderBy("k", "late", "d").rowsBetween(Window.unboundedPreceding, -1)
    found = rows.unionByName(given).withColumn("known", F.last("d", ignorenulls=True).over(before)).filter("late = 0")
    own = shapes.select("model", "name", F.concat(F.lit("p"), F.col("shape")).alias("shape"))
    return found.join(own, ["model", "name"], "left").select("model", "k", "place", F.coalesce("shape", "known.ref", F.lit("?")).alias("ref"))


def architecture_digests(ops: DataFrame, inputs: DataFrame, outputs: DataFrame, shapes: DataFrame) -> DataFrame:
    """(model, n_ops, digest): the shapes of inputs and outputs, and each operator with its attributes and operands."""
    refs = wired(ops, inputs, shapes).groupBy("model", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "ref"))), lambda x: x["ref"]), " ").alias("refs"))
    node = F.unhex(F.sha2(F.concat_ws("\n", "op", F.coalesce("attrs", F.lit("")), F.coalesce("refs", F.lit(""))), 256))
    nodes = ops.select("model", F.col("k").cast("long").alias("k"), "op", "attrs").join(refs, ["model", "k"], "left").select("model", "k", node.alias("node"))
    listed = nodes.groupBy("model").agg(F.count("*").alias("n_ops"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "node"))), lambda x: F.lower(F.hex(x["node"]))), "").alias("nodes"))
    ends = lambda t, name: t.groupBy("model").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "shape"))), lambda x: x["shape"]), ",").alias(name))
    out = listed.join(ends(inputs, "ins"), "model", "left").join(ends(outputs, "outs"), "model", "left")
    return out.select("model", "n_ops", F.sha2(F.concat_ws("|", F.coalesce("ins", F.lit("")), F.coalesce("outs", F.lit("")), "nodes"), 256).alias("digest"))


def parameter_digests(values: DataFrame, tensors: DataFrame, text: Column, chunk: int = 4_096) -> DataFrame:
    """(model, n_tensors, n_values, digest) over values (model, tensor, idx, ...) and tensors (model, tensor, dtype, shape).

    ``text`` gives a value's canonical text. A tensor is cut into chunks of ``chunk`` places; their digests, in order, are the
    leaves of a tree whose root stands for the tensor, so no task holds one, and the result doesn't depend on how rows are
    dealt. A model's digest goes over names, types, shapes and roots in the order of names.
    """
    rows = values.select("model", "tensor", F.floor(F.col("idx") / chunk).alias("pos"), F.struct(F.col("idx"), text.alias("x")).alias("v"))
    leaves = rows.groupBy("model", "tensor", "pos").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("v")), lambda v: v["x"]), ",", "null"), 256).alias("leaf"))
    leaves = leaves.select(F.struct("model", "tensor").alias("ledger"), "pos", "leaf", "n")
    sizes = leaves.groupBy("ledger").agg((F.max("pos") + 1).alias("size"), F.sum("n").alias("n"))
    roots = tree_roots(sizes.select("ledger", "size"), subtrees(leaves)).join(sizes.select("ledger", "n"), "ledger")
    own = tensors.join(roots.select("ledger.*", "root", "n"), ["model", "tensor"], "left")
    line = F.concat_ws("\n", "tensor", "dtype", "shape", F.coalesce("root", F.lit("")))
    whole = own.groupBy("model").agg(F.count("*").alias("n_tensors"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_values"), F.array_sort(F.collect_list(F.struct("tensor", line.alias("line")))).alias("lines"))
    return whole.select("model", "n_tensors", "n_values", F.sha2(F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n"), 256).alias("digest"))


#: Up to so many comparisons plain loops take less time than arrays.
SHORT = 256


def _longest_of_short(a: list, b: list) -> tuple[int, int, int]:
    best, run = (0, 0, 0), [0] * (len(b) + 1)
    for i, x in enumerate(a):
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                now[j + 1] = n = run[j] + 1
                if n > best[2]:
                    best = i + 1 - n, j + 1 - n, n
        run = now
    return best


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(start in a, start in b, length) of the longest common run; of equals the first in a, then in b."""
    if len(a) * len(b) <= SHORT:
        return _longest_of_short(a.tolist(), b.tolist())
    best, run = (0, 0, 0), np.zeros(len(b) + 1, np.int64)
    for i, x in enumerate(a.tolist()):
        now = np.zeros_like(run)
        now[1:] = np.where(b == x, run[:-1] + 1, 0)
        j = int(now.argmax())
        if now[j] > best[2]:
            best = i + 1 - int(now[j]), j - int(now[j]), int(now[j])
        run = now
    return best


def opcodes(a: list, b: list) -> list[tuple[str, int, int, int, int]]:
    """How ``a`` becomes ``b``: equal, replace, delete and insert spans, by longest common runs."""
    known: dict = {}
    x, y = (np.array([known.setdefault(v, len(known)) for v in s], np.int64) for s in (a, b))
    runs, open_ = [], [(0, len(x), 0, len(y))]
    while open_:
        i1, i2, j1, j2 = open_.pop()
        i, j, n = _longest(x[i1:i2], y[j1:j2]) if i1 < i2 and j1 < j2 else (0, 0, 0)
        if n:
            runs.append((i1 + i, j1 + j, n))
            open_ += [(i1, i1 + i, j1, j1 + j), (i1 + i + n, i2, j1 + j + n, j2)]
    out: list[tuple[str, int, int, int, int]] = []
    i = j = 0
    for s, t, n in [*sorted(runs), (len(x), len(y), 0)]:
        if i < s or j < t:
            out.append(("replace" if i < s and j < t else "delete" if i < s else "insert", i, s, j, t))
        if n and out and out[-1][0] == "equal":
            out[-1] = ("equal", out[-1][1], s + n, out[-1][3], t + n)
        elif n:
            out.append(("equal", s, s + n, t, t + n))
        i, j = s + n, t + n
    return out


CODES = "array<struct<tag:string,i1:int,i2:int,j1:int,j2:int>>"
_STEP = pa.struct([("tag", pa.string()), *((k, pa.int32()) for k in ("i1", "i2", "j1", "j2"))])


def aligned(pairs: DataFrame, a: str = "reference", b: str = "candidate", out: str = "codes") -> DataFrame:
    """``pairs`` with the opcodes between two arrays of each row; null arrays count as empty. One row is one task's work."""
    names = pairs.columns
    at = names.index(a), names.index(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist(), strict=True)
            codes = [[dict(zip(("tag", "i1", "i2", "j1", "j2"), c, strict=True)) for c in opcodes(x or [], y or [])] for x, y in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.list_(_STEP))], [*names, out])

    return pairs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields), f"`{out}` {CODES}"]))


def differences(codes: DataFrame, a: str = "reference") -> DataFrame:
    """One row for each span of `aligned` that isn't equal: its tag and spans, and ``after``, the operator before it."""
    rest = [c for c in codes.columns if c != "codes"]
    out = codes.select(*rest, F.explode("codes").alias("c")).filter("c.tag <> 'equal'")
    return out.select(*rest, "c.*", F.when(F.col("c.i1") > 0, F.get(F.col(a), F.col("c.i1") - 1)).otherwise(F.lit("input")).alias("after"))
