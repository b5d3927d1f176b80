import difflib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofgrid.operators import architecture as ar


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
def test_opcodes_are_those_of_the_standard_library(a, b):
    assert ar.opcodes(a, b) == [tuple(c) for c in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes()]


def test_long_lists():
    rng = random.Random(1)
    a = [rng.choice(["conv", "relu", "add", "pool"]) for _ in range(900)]
    b = [x for x in a if rng.random() > 0.05]
    b[300:300] = ["conv"] * 40
    assert ar.opcodes(a, b) == [tuple(c) for c in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes()]


def test_alignment_of_every_order(spark, sf_dir):
    from proofgrid.plans import catalog, identity

    got = {}
    for r in catalog.queries()["alignment_of_operators"](spark, sf_dir).collect():
        got.setdefault(r.o_orderkey, []).append((r.tag, r.i1, r.i2, r.j1, r.j2, r.after))
    lists = {}
    for r in identity._operators(spark, sf_dir).select("l_orderkey", "k", "op").collect():
        lists.setdefault(r.l_orderkey, {})[r.k] = r.op
    lists = {k: [v[i] for i in sorted(v)] for k, v in lists.items()}
    want, last = {}, {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey").collect()):
        if r.o_orderkey in lists:
            if r.o_custkey in last:
                a, b = last[r.o_custkey], lists[r.o_orderkey]
                codes = [(*c, a[c[1] - 1] if c[1] else "input") for c in difflib.SequenceMatcher(a=a, b=b, autojunk=False).get_opcodes() if c[0] != "equal"]
                if codes:
                    want[r.o_orderkey] = codes
            last[r.o_custkey] = lists[r.o_orderkey]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and len(want) > 50


GRAPH = [(0, "conv", "k=3", ["x", "w"], ["a"]), (1, "relu", None, ["a"], ["b"]), (2, "add", None, ["b", "a"], ["a"]), (3, "split", None, ["a"], ["c", "d"]), (4, "add", None, ["c", "lost"], ["y"])]


def digest(spark, ops, rename=None, inputs=(("x", "3x8"),), shape="4x3"):
    name = lambda n: (rename or {}).get(n, n)
    rows = [("m", k, op, attrs, [name(i) for i in ins], [name(o) for o in outs]) for k, op, attrs, ins, outs in ops]
    frame = lambda data, schema: spark.createDataFrame(data, schema).repartition(3)
    out = ar.architecture_digests(frame(rows, "model string, k int, op string, attrs string, inputs array<string>, outputs array<string>"), frame([("m", i, name(n), s) for i, (n, s) in enumerate(inputs)], "model string, i int, name string, shape string"), frame([("m", 0, "10")], "model string, i int, shape string"), frame([("m", name("w"), shape)], "model string, name string, shape string"))
    return out.collect()[0].digest


def test_renamed_graphs_agree_and_rewired_ones_do_not(spark):
    base = digest(spark, GRAPH)
    assert digest(spark, list(reversed(GRAPH)), {n: f"{n}_new" for n in "xwabcdy"}) == base
    swapped = [*GRAPH[:2], (2, "add", None, ["a", "b"], ["a"]), *GRAPH[3:]]
    other = [*GRAPH[:4], (4, "add", None, ["d", "lost"], ["y"])]
    attrs = [(0, "conv", "k=5", ["x", "w"], ["a"]), *GRAPH[1:]]
    changed = [digest(spark, swapped), digest(spark, other), digest(spark, attrs), digest(spark, GRAPH, shape="4x4"), digest(spark, GRAPH, inputs=(("x", "3x9"),)), digest(spark, GRAPH[:4])]
    assert len({base, *changed}) == 7


def test_operands(spark):
    ops = spark.createDataFrame([("m", *r) for r in GRAPH], "model string, k int, op string, attrs string, inputs array<string>, outputs array<string>")
    got = ar.wired(ops, spark.createDataFrame([("m", 0, "x", "3")], "model string, i int, name string, shape string"), spark.createDataFrame([("m", "w", "4x3")], "model string, name string, shape string"))
    assert sorted((r.k, r.place, r.ref) for r in got.collect()) == [(0, 0, "in0"), (0, 1, "p4x3"), (1, 0, "t0.0"), (2, 0, "t1.0"), (2, 1, "t0.0"), (3, 0, "t2.0"), (4, 0, "t3.0"), (4, 1, "?")]


@pytest.mark.parametrize("chunk", [1, 3, 4_096])
def test_parameter_digests_do_not_depend_on_partitions(spark, chunk):
    rows = [("m", t, i, None if i == 5 else i * k) for k, t in enumerate(("w", "b", "conv.1"), 1) for i in range(23)]
    tensors = spark.createDataFrame([("m", t, "f4", "23") for t in ("w", "b", "conv.1")] + [("m", "none", "f4", "0")], "model string, tensor string, dtype string, shape string")
    make = lambda data, parts: ar.parameter_digests(spark.createDataFrame(data, "model string, tensor string, idx long, value long").repartition(parts), tensors, F.col("value").cast("string"), chunk).collect()[0]
    base = make(rows, 1)
    assert make(rows[::-1], 7) == base and (base.n_tensors, base.n_values) == (4, 69)
    moved = [(m, t, (i + 1) % 23, v) for m, t, i, v in rows]
    assert make(moved, 2).digest != base.digest and make(rows[:-1], 2).digest != base.digest


def test_names_meet_in_one_shuffle_and_the_last_of_equal_names_counts(spark):
    ops = spark.createDataFrame([("m", 1, "a", "", ["x"], ["y", "y"]), ("m", 2, "b", "", ["y", "w", "z"], ["z"]), ("m", 3, "c", "", ["z"], None)], "model string, k int, op string, attrs string, inputs array<string>, outputs array<string>")
    inputs = spark.createDataFrame([("m", 0, "x", "3")], "model string, i int, name string, shape string")
    out = ar.wired(ops, inputs, spark.createDataFrame([("m", "w", "8")], "model string, name string, shape string"))
    assert sorted((r.k, r.place, r.ref) for r in out.collect()) == [(1, 0, "in0"), (2, 0, "t1.1"), (2, 1, "p8"), (2, 2, "?"), (3, 0, "t2.0")]
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_short_lists_give_the_same_steps_as_long_ones(monkeypatch):
    rng = np.random.default_rng(4)
    lists = [[f"o{x}" for x in rng.integers(0, 3, rng.integers(0, 12))] for _ in range(200)]
    short = [ar.opcodes(a, b) for a, b in zip(lists, lists[1:])]
    monkeypatch.setattr(ar, "SHORT", 0)
    assert short == [ar.opcodes(a, b) for a, b in zip(lists, lists[1:])]
