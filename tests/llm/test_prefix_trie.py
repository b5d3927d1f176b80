import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from proofgrid.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def brute(rows, group=20):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append((turn is not None, turn or 0, mark, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    seqs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % group if c >= 0 else -(-c % group))
        seqs[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    under = {p: [0, 0] for p in members}
    for p, m in members.items():
        for d in range(len(p) + 1):
            under[p[:d]][0] += p not in kids
            under[p[:d]][1] += (len(m) - 1) * words(p)
    ends = {}
    for c, s in sorted(seqs.items()):
        ends.setdefault(s, []).append(str(c))
    sha = lambda p: hashlib.sha256(",".join(ends.get(p, [])).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *under[p], sha(p)) for p, m in members.items()), key=repr)


def got(spark, rows, **options):
    out = prefix_trie.trie(spark.createDataFrame(rows, SCHEMA).repartition(3), **options)
    return sorted(map(tuple, out.collect()), key=repr)


def made(seed, n, alphabet, most, skew=0.0):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.permutation(4 * n)[:n].tolist():
        for turn in range(int(rng.integers(0, most + 1))):
            text = "w " * int(rng.integers(0, alphabet)) if rng.random() > skew else "hot words here"
            rows.append((c, turn, "user" if turn % 2 == 0 else None, text, "x"))
    return rows


@pytest.mark.parametrize("seed, n, alphabet, most, skew, blocks", [(1, 40, 2, 5, 0.0, 1), (2, 60, 2, 6, 0.0, 13), (3, 150, 3, 4, 0.5, 40), (4, 80, 1, 3, 1.0, 29), (5, 120, 2, 12, 0.6, 120), (6, 200, 5, 3, 0.3, 60)])
def test_against_all_prefixes(spark, seed, n, alphabet, most, skew, blocks):
    rows = made(seed, n, alphabet, most, skew)
    assert got(spark, rows, blocks=blocks) == brute(rows)


def test_copies_and_growing_conversations_over_many_blocks(spark):
    rows = [(c, t, "u", f"same {t}", "") for c in range(0, 4_000, 20) for t in range(3)]
    rows += [(c, t, "u", f"long {t}", "") for c in range(10_000, 10_000 + 60 * 20, 20) for t in range((c - 10_000) // 20)]
    for blocks in (7, 50):
        assert got(spark, rows, blocks=blocks) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "u", "lost", ""), (5, None, None, None, ""), (5, 0, "u", "a  b", ""), (5, 0, "u", "a  b", ""), (5, 0, "u", "c", ""), (20, 3, "", "", ""), (20, None, "z", "first", ""), (-7, 1, "u", "neg", ""), (-7, 2, "u", "neg", ""), (0, 9, "u", "base one", ""), (0, 10, "u", "base two", ""), (7, 1, "ab", "c", ""), (47, 1, "a", "bc", ""), (9, 1, "u", "x" * 300_000, "")]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == [] and got(spark, [(None, 1, "u", "x", "")]) == []
    only = [(3, 0, "u", "gone", "")]  # its head comes from conversation 0, which doesn't exist
    assert got(spark, only) == brute(only)


def test_sql(spark, sf_dir):
    from proofgrid.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf_dir}/conversations.parquet')")
    out = con.execute(queries.oracle_sql()["op13_conversation_prefix_trie"])
    names = [d[0] for d in out.description]
    df = queries.queries()["op13_conversation_prefix_trie"](spark, sf_dir)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(out.fetchall(), key=repr)
