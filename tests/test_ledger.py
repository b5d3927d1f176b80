import random

import pytest

from proofgrid.functions import provenance as pv
from proofgrid.operators import ledger as lg

SCHEMA = "ledger_file string, line long, kind string, ledger string, entry_hash string, nonce string, prev string, body string, complete boolean, key_error string, signed boolean, seq string, canonical string"


def made(seed, n, files=2, damage=0.2):
    """Chains with damaged, repeated, moved, lost and foreign lines."""
    rng, rows = random.Random(seed), []
    for f in range(files):
        chain, prev, seen = [], lg.GENESIS, []
        for k in range(n):
            h = f"h{f}-{k}"
            seen.append(h)
            size = rng.randint(1, k + 1)
            root = "sha256:" + pv.merkle_root([x.encode() for x in seen[:size]]).hex()
            body = '{"tree_size": %d, "root": "%s"}' % (size, root if rng.random() < 0.7 else "no") if k % 3 == 0 else None
            chain.append([None, "checkpoint" if k % 3 == 0 else "inference", "L", h, f"n{k}", prev, body, True, None, True, str(k), "{}"])
            prev = h
        start = rng.randint(0, n) if damage else n
        for k in range(start, n):
            if rng.random() < damage:
                kind, r = rng.randrange(9), chain[k]
                if kind == 0:
                    r[9] = False
                elif kind == 1:
                    r[8] = "unknown key"
                elif kind == 2:
                    r[7] = False
                elif kind == 3:
                    r[11] = None
                elif kind == 4:
                    r[10] = rng.choice([None, "x", "-3", str(rng.randrange(n))])
                elif kind == 5:
                    r[2] = "other"
                elif kind == 6:
                    r[4] = f"n{rng.randrange(n)}"
                elif kind == 7:
                    r[5] = "broken"
                else:
                    chain.append(list(chain[rng.randrange(n)]))
        for _ in range(int(damage * 10)):
            i, j = rng.randrange(len(chain)), rng.randrange(len(chain))
            rng.choice([lambda: chain.insert(j, chain.pop(i)), lambda: chain.pop(i)])() if max(i, j) >= start else None
        rows += [(f"f{f}", line, *r[1:]) for line, r in enumerate(chain, 1)]
    return rows


def by_definition(rows):
    """Each line's status from all lines before it, looked up anew."""
    out = []
    for f in sorted({r[0] for r in rows}):
        lines = [dict(zip((x.split()[0] for x in SCHEMA.split(", ")), r)) for r in rows if r[0] == f]
        name = next((x["ledger"] for x in lines if x["complete"]), None)
        accepted, classes, broken = [], [], []
        for i, x in enumerate(lines):
            seq = int(x["seq"]) if x["complete"] and x["seq"] not in (None, "x") else None
            readable = x["complete"] and x["canonical"] is not None
            known = [y for y in lines[:i] if y["complete"] and y["canonical"] is not None]
            fresh = x["entry_hash"] not in {y["entry_hash"] for y in known} and x["nonce"] not in {y["nonce"] for y in known}
            foreign = x["complete"] and x["ledger"] != name
            replay = foreign or readable and (not fresh or seq in {s for s, _ in accepted})
            top = max([a for a in accepted if a[0] >= 0], default=(-1, lg.GENESIS))
            c = set()
            if replay:
                c.add("record_replay")
            if readable and x["key_error"]:
                c.add("signature_forgery")
            if not readable or (not x["key_error"] and not x["signed"]) or seq is None:
                c.add("record_modification")
            if readable and not replay and seq is not None and seq != top[0] + 1:
                c.add("record_deletion" if seq > top[0] + 1 else "record_reorder")
            if readable and not c and x["prev"] != top[1] and not any(broken):
                c.add("record_modification")
            if readable and not replay and seq is not None:
                accepted.append((seq, x["entry_hash"]))
            status = "FAILED" if c else "UNTRUSTED" if any(broken) else "VALID"
            broken.append(bool(c - {"record_replay"}))
            if status == "VALID" and x["kind"] == "checkpoint":
                import json

                claim = json.loads(x["body"])
                leaves = [h.encode() for _, h in sorted(accepted)][: claim["tree_size"]]
                status = "VALID" if "sha256:" + pv.merkle_root(leaves).hex() == claim["root"] else "FAILED"
            classes.append((x["line"], seq, status, c, top[0] + 1))
        have = {s for s, _ in accepted}
        for line, seq, status, c, low in classes:
            if "record_deletion" in c and all(s in have for s in range(low, seq)):
                c = c - {"record_deletion"} | {"record_reorder"}
            out.append((f, line, seq, status, tuple(sorted(c))))
    return sorted(out)


@pytest.mark.parametrize("seed, n, damage, block", [(1, 70, 0.0, 1 << 16), (2, 40, 0.1, 8), (3, 60, 0.3, 16), (4, 50, 0.6, 4), (5, 90, 0.05, 32)])
def test_statuses_by_definition(spark, monkeypatch, seed, n, damage, block):
    monkeypatch.setattr(lg, "BLOCK", block)
    rows = made(seed, n, damage=damage)
    got = lg.verify(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((r.ledger_file, r.line, r.seq, r.status, tuple(sorted(r.classes))) for r in got) == by_definition(rows)
    assert all(len(set(r.classes)) == len(r.classes) for r in got)


def test_tree_roots_of_all_sizes(spark):
    leaves = [f"x{k}" for k in range(77)]
    rows = spark.createDataFrame([("a", k, v) for k, v in enumerate(leaves)], "ledger string, pos long, leaf string")
    sizes = spark.createDataFrame([("a", k) for k in range(0, 80)], "ledger string, size long")
    for wide in (2, 3, 10):
        got = {r.size: r.root for r in lg.tree_roots(sizes, lg.subtrees(rows, wide)).collect()}
        assert got == {n: "sha256:" + pv.merkle_root([x.encode() for x in leaves[:n]]).hex() for n in range(1, 78)}


def test_nothing(spark):
    assert lg.verify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_gaps_count_their_numbers_without_meeting_the_ledger(spark):
    """Brute force over damaged sequences, with repeats and nulls, and no join on a range."""
    rng = random.Random(5)
    rows = [(k, line, None if rng.random() < 0.05 else line + rng.choice([0, 0, 0, 1, 3, -2])) for k in "ab" for line in range(120)] + [("c", 0, 4), ("d", 0, None)]
    df = spark.createDataFrame(rows, "ledger string, line long, seq long")
    want = set()
    for k in "abcd":
        own = {s for x, _, s in rows if x == k and s is not None}
        top = -1
        for _, line, s in sorted(r for r in rows if r[0] == k):
            if s is not None and s > top + 1:
                want.add((k, line, top + 1, s - 1, "record_reorder" if own >= set(range(top + 1, s)) else "record_deletion"))
            top = top if s is None else max(top, s)
    out = lg.gaps(df)
    assert {tuple(r) for r in out.collect()} == want and {r[4] for r in want} == {"record_reorder", "record_deletion"}
    assert "BETWEEN" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and ">=" not in plan


def test_the_sql_of_merkle_root_reaches_the_root_of_more_than_20_levels():
    import duckdb

    from proofgrid.plans import catalog

    n = 2**20 + 3
    con = duckdb.connect()
    con.execute(f"CREATE TABLE events AS SELECT i AS event_id, CASE WHEN i < {n} THEN 'long' ELSE 'short' END AS event_type FROM range({n + 3}) t(i)")
    root = lambda ids: "sha256:" + pv.merkle_root([b"e%d" % i for i in ids]).hex()
    assert sorted(con.execute(catalog.oracle_sql()["merkle_root"]).fetchall()) == [("long", n, root(range(n))), ("short", 3, root(range(n, n + 3)))]
