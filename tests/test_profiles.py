import json
import random

from proofgrid.operators import documents, profiles


def merged(base, own):
    return {**base, **{k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in own.items()}}


def leaves(tree, start=""):
    for k, v in tree.items():
        if isinstance(v, dict):
            yield from leaves(v, f"{start}{k}.")
        else:
            yield start + k, v


def test_against_merged_trees(spark):
    rng = random.Random(1)

    def tree(depth=0):
        return {k: tree(depth + 1) if depth < 3 and rng.random() < 0.5 else str(rng.randrange(9)) for k in rng.sample("abcd", rng.randint(1, 3))}

    own = {f"p{k}": (f"p{rng.randrange(k)}" if k and rng.random() < 0.9 else None, tree()) for k in range(30)}
    own |= {"x": ("y", {"a": "1"}), "y": ("z", {"a": "1"}), "z": ("y", {"a": "1"}), "self": ("self", {"a": "1"}), "lost": ("nowhere", {"a": "1"}), "late": ("lost", {"a": "1"})}
    names = spark.createDataFrame([(n, e) for n, (e, _) in own.items()], "name string, extends string")
    rows = spark.createDataFrame([(n, p, v) for n, (_, t) in own.items() for p, v in leaves(t)], "name string, path string, value string")
    kept, wrong = profiles.effective(names, rows)
    got = {}
    for r in kept.collect():
        got.setdefault(r.name, {})[r.path] = r.value

    def resolved(n):
        e, t = own[n]
        return merged(resolved(e), t) if e else t

    assert got == {n: dict(leaves(resolved(n))) for n in own if n.startswith("p")}
    assert {r.name: r.error for r in wrong.collect()} == {"x": "cycle: x -> y -> z -> y", "y": "cycle: y -> z -> y", "z": "cycle: z -> y -> z", "self": "cycle: self -> self", "lost": "unknown: lost -> nowhere", "late": "unknown: late -> lost -> nowhere"}


def test_json_limits(spark):
    rng = random.Random(2)

    def value(depth=1):
        kind = rng.random()
        if depth > 5 or kind < 0.4:
            return rng.choice([1, 2.5, "x", None, True])
        return [value(depth + 1) for _ in range(rng.randrange(4))] if kind < 0.7 else {f"k{i}": value(depth + 1) for i in range(rng.randrange(4))}

    def size(v):
        inner = [size(x) for x in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else [])]
        return 1 + max((d for d, _ in inner), default=0), 1 + sum(n for _, n in inner)

    values = [value() for _ in range(200)]
    texts = [json.dumps(v) for v in values] + [None, "", "nul", "[1,", "[NaN]", "[Infinity]", '{"a":1,"a":2}', "[" * 90 + "]" * 90, "[" + "1," * 300 + "1]", " " * 3_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.id: tuple(r)[1:] for r in documents.measured(rows, "i", "t", 2_000, 5, 200).collect()}
    for i, v in enumerate(values):
        depth, n = size(v)
        want = "bytes" if len(texts[i]) > 2_000 else "values" if n > 200 else "depth" if depth > 5 else None
        assert got[i] == ((depth, n, None) if want is None else (None, None, want))
    assert [got[i][2] for i in range(200, 210)] == ["malformed"] * 7 + ["depth", "values", "bytes"]
