"""The prefix trie of conversations, as the Cartesian tree over the LCP array of the sorted conversations.

1. ``rebuilt``: each conversation's turns become digests (128 bits of sha256 over role and text) in the order of ``turn``
   (null first; turns of equal number by their digests); the first h turns come from the conversation that opens its group
   of 20, h being crc32(id) % 4.
2. ``neighbours``: conversations are range-partitioned and sorted by their digests, copies by id, in blocks of about
   ``block_rows``; each row gets its LCP (turns shared with the row before) and that of the row after.
3. A node's members are a run of sorted rows: the LCP values inside are at least its depth, those at both ends smaller.
   ``segments`` cuts each block at its strict prefix minima and strict suffix minima. From the minima of all blocks alone
   (a few numbers a block on the driver) follows which blocks hold the next smaller values that a block can't find in
   itself; those blocks send it their segments, already summed. So each block finds all nearest smaller values, and the
   sums over any run, by a stack over its own rows and a few segments from outside.
4. ``_tree``: going through a block from its end, a row takes from the stack all runs with a larger LCP: these are the
   nodes that begin at this row, one for each distinct LCP (runs of equal LCP are merged on the stack, so a node may have
   many children), and the depths between two of them are nodes with one child. Members, leaves, least ids and shared
   words are sums over runs: with W(i, d) the words of the first d turns of row i, what a subtree saves is the sum of
   W(i, lcp) over its rows but the first, less W(first, depth - 1) for each of these.
5. Ids of copies are hashed block by block; where copies go on in later blocks, each block sends its ids as one text, and
   these are hashed in order as a stream.

Result: one row a node, as (conv_id, depth) with the columns of ``NODE``. A null role or text is empty. Rows without a
conv_id belong to no conversation. Rows that repeat are turns of their own. No conversations give no rows. A
conversation's digests (32 bytes a turn) are one row of a task. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.llm.common import SPACE, WORD, bounded, columns, cut, groups

#: Characters of a digest.
WIDE = 32
BLOCK_ROWS = 1 << 16
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def _head(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % 4).cast("int")


def rebuilt(turns: DataFrame, group: int = 20, most: int = 3) -> DataFrame:
    """(conv_id, key string, words array<bigint>): a conversation's digests, joined, and the words of its turns."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, WIDE)
    thin = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")).alias("x"))
    whole = thin.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("own"))
    opening = whole.filter(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, most).alias("opening"))
    both = whole.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", _head(F.col("conv_id"))).join(opening, "base", "left")
    none = F.slice("own", F.lit(1), F.lit(0))
    seq = F.concat(F.slice(F.coalesce("opening", none), F.lit(1), F.col("h")), F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1))))
    return both.select("conv_id", seq.alias("seq")).select("conv_id", F.array_join(F.transform("seq", lambda x: x["digest"]), "").alias("key"), F.transform("seq", lambda x: x["words"]).alias("words"))


def _common(a: str, b: str) -> int:
    """Turns that two keys share at their start."""
    low, high = 0, min(len(a), len(b)) // WIDE
    if a[: high * WIDE] == b[: high * WIDE]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low * WIDE : mid * WIDE] == b[low * WIDE : mid * WIDE] else (low, mid)
    return low


_ROW = "block int, place bigint, conv_id bigint, len bigint, lcp bigint, after bigint, cum array<bigint>, edge string"
_FIELDS = [("block", pa.int32()), ("place", pa.int64()), ("conv_id", pa.int64()), ("len", pa.int64()), ("lcp", pa.int64()), ("after", pa.int64()), ("cum", pa.list_(pa.int64())), ("edge", pa.string())]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted rows of a block with their LCP values; ``edge`` is the key of its first and last row."""
    block, place = TaskContext.get().partitionId(), 0
    held: tuple | None = None  # the row before, whose ``after`` isn't known yet
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), _FIELDS, strict=True)], [n for n, _ in _FIELDS])
        out.clear()
        return made

    for b in batches:
        for conv_id, key, words in zip(columns(b, "conv_id").to_pylist(), columns(b, "key").to_pylist(), columns(b, "words").to_pylist(), strict=True):
            lcp = _common(held[1], key) if held else None
            if held:
                conv, old, cum, at, before = held
                out.append((block, at, conv, len(old) // WIDE, before, lcp, cum, None if at else old))
            held = conv_id, key, [0, *np.cumsum(words, dtype=np.int64).tolist()], place, lcp
            place += 1
            if len(out) >= 10_000:
                yield batch()
    if held:
        conv, old, cum, at, before = held
        out.append((block, at, conv, len(old) // WIDE, before, None, cum, old))
        yield batch()


def neighbours(convs: DataFrame, blocks: int) -> DataFrame:
    """The sorted conversations, as a table with the columns of ``_ROW``; lcp and after are null at a block's ends."""
    ranged = convs.repartitionByRange(blocks, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    return cut(ranged.mapInArrow(_numbered, _ROW), "neighbours")


def _borders(rows: DataFrame) -> list[tuple[int, int, bool]]:
    """(block, LCP of its first row, whether that row copies the one before) of each block that has rows, in order."""
    ends = rows.filter("edge IS NOT NULL").groupBy("block").agg(F.min_by("edge", "place").alias("first"), F.max_by("edge", "place").alias("last"))
    ends = ends.withColumn("before", F.lag("last").over(Window.orderBy("block")))  # one row a block
    n = (F.least(F.length("first"), F.length("before")) / WIDE).cast("int")
    differs = lambda i: F.substr("first", i * WIDE + 1, F.lit(WIDE)) != F.substr("before", i * WIDE + 1, F.lit(WIDE))
    shared = F.when(n > 0, F.coalesce(F.array_min(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), differs)), n)).otherwise(F.lit(0))
    lcp = F.when(F.col("before").isNull(), F.lit(-1)).otherwise(shared)
    return [(r.block, r.lcp, r.copy) for r in ends.select("block", lcp.alias("lcp"), F.coalesce(F.col("first") == F.col("before"), F.lit(False)).alias("copy")).orderBy("block").collect()]


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums of rows by ``keys`` (lcp, n, conv_id, leaves, a, kids): lcp is the least, kids its rows that go deeper."""
    deeper = F.sum((F.col("len") > F.col("lcp")).cast("long")).alias("deeper")
    by_lcp = rows.groupBy(*keys, "lcp").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.sum("leaf").alias("leaves"), F.sum("a").alias("a"), deeper)
    return by_lcp.groupBy(*keys).agg(F.min("lcp").alias("lcp"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.sum("leaves").alias("leaves"), F.sum("a").alias("a"), F.min_by("deeper", "lcp").alias("kids"))


def _whole(rows: DataFrame, borders: list[tuple[int, int, bool]]) -> DataFrame:
    """``rows`` with the LCP values at the ends of blocks, leaf (0 or 1: no longer row follows) and a, the words shared
    with the row before."""
    after = [b[1] for b in borders[1:]] + [-1]
    known = rows.sparkSession.createDataFrame([(b, lcp, nxt) for (b, lcp, _), nxt in zip(borders, after, strict=True)], "block int, first bigint, last bigint")
    out = rows.join(F.broadcast(known), "block")  # a row a block
    out = out.withColumn("lcp", F.coalesce("lcp", "first")).withColumn("after", F.coalesce("after", "last")).drop("first", "last")
    return out.withColumn("leaf", (F.col("after") < F.col("len")).cast("long")).withColumn("a", F.when(F.col("lcp") > 0, F.element_at("cum", (F.col("lcp") + 1).cast("int"))).otherwise(F.lit(0)))


def segments(rows: DataFrame, forward: bool) -> DataFrame:
    """(target, seg, lcp, n, conv_id, leaves, a, kids): blocks cut at their strict prefix (or suffix) minima, in order from
    that side; kids counts the rows at a segment's minimum that go deeper."""
    along = Window.partitionBy("block").orderBy(F.col("place") if forward else F.col("place").desc())
    least = F.min("lcp").over(along.rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("record", (least.isNull() | (F.col("lcp") < least)).cast("int"))
    if forward:
        seg = F.sum("record").over(along.rowsBetween(Window.unboundedPreceding, 0))
    else:  # from the right, a record ends its segment
        seg = F.coalesce(F.sum("record").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _summed(out.select(F.col("block").alias("target"), seg.alias("seg"), "lcp", "len", "conv_id", "leaf", "a"), "target", "seg")


def _smaller(least: list[int], order: range) -> list[int | None]:
    """For each block, the next one in ``order`` with a smaller minimum."""
    out: list[int | None] = [None] * len(least)
    stack: list[int] = []
    for b in reversed(order):
        while stack and least[stack[-1]] >= least[b]:
            stack.pop()
        out[b] = stack[-1] if stack else None
        stack.append(b)
    return out


def _joined(parts: list[tuple], least: int) -> tuple | None:
    """The sum of runs (lcp, n, conv_id, leaves, a, kids) as one whose LCP is ``least``."""
    if not parts:
        return None
    return least, sum(p[1] for p in parts), min(p[2] for p in parts), sum(p[3] for p in parts), sum(p[4] for p in parts), sum(p[5] for p in parts if p[0] == least)


def _requests(blocks: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """From one (block, lcp, n, conv_id, leaves, a, kids) a block, in order: (block, side, step, target) of the blocks whose
    segments a block needs, and (block, side, step, ...sums) of the whole blocks that follow each of these.

    Side 0 looks right, 1 left. From block to block the minima fall, up to the first that is below the block's own.
    """
    least = [b[1] for b in blocks]
    asks, between = [], []
    for side, order in ((0, range(len(blocks))), (1, range(len(blocks) - 1, -1, -1))):
        nxt = _smaller(least, order)
        # what lies between a block and its next smaller one, from the parts between: each is added once
        tail: list[tuple | None] = [None] * len(blocks)
        stack: list[int] = []
        for b in reversed(order):
            parts = []
            while stack and least[stack[-1]] >= least[b]:
                top = stack.pop()
                parts += [p for p in (blocks[top][1:], tail[top]) if p]
            tail[b] = _joined(parts, min((p[0] for p in parts), default=0))
            stack.append(b)
        for b in range(len(blocks)):
            step, t = 0, b + 1 if side == 0 else b - 1
            t = t if 0 <= t < len(blocks) else None
            while t is not None:
                asks.append((blocks[b][0], side, step, blocks[t][0]))
                if tail[t]:
                    between.append((blocks[b][0], side, step, *tail[t]))
                if least[t] < least[b]:
                    break
                step, t = step + 1, nxt[t]
    return asks, between


class _Run:
    """Sorted rows on the stack that share ``lcp`` with the row before, and the nodes whose parent holds them."""

    __slots__ = ("lcp", "n", "conv_id", "leaves", "a", "kids", "waiting")

    def __init__(self, lcp: int, n: int, conv_id: int, leaves: int, a: int, kids: int):
        self.lcp, self.n, self.conv_id, self.leaves, self.a, self.kids, self.waiting = lcp, n, conv_id, leaves, a, kids, []

    def add(self, other: _Run) -> None:
        self.n += other.n
        self.conv_id = min(self.conv_id, other.conv_id)
        self.leaves += other.leaves
        self.a += other.a
        self.kids += other.kids if other.lcp == self.lcp else 0


def _rightward(runs: list[_Run]) -> list[_Run]:
    """Runs in order from a block's end, joined so that LCP values fall: each with what follows it up to the next."""
    out: list[_Run] = []
    for r in runs:
        if out and r.lcp >= out[-1].lcp:
            out[-1].add(r)
        else:
            out.append(r)
    return out


def _leftward(runs: list[_Run]) -> list[tuple[int, int]]:
    """(lcp, least id) in falling order of LCP from a block's start leftward; ids are those between a value and the start."""
    out: list[tuple[int, int]] = []
    least = None
    for r in runs:
        least = r.conv_id if least is None else min(least, r.conv_id)
        if not out or r.lcp < out[-1][0]:
            out.append((r.lcp, least))
    return out


def _tree(copies: dict[int, tuple[bool, bool]]):
    """Nodes and parts of lists of copies from the rows of a block, with the runs that other blocks sent. ``copies``: for
    each block, whether its first row copies the one before and the row after copies its last."""

    none = hashlib.sha256(b"").hexdigest()

    def nodes(t: pa.Table) -> Iterator[pa.RecordBatch]:
        kind, lcps, ns, convs, leaves, words, kids = (t.column(c).to_pylist() for c in ("kind", "lcp", "n", "conv_id", "leaves", "a", "kids"))
        sent = [[], []]
        first = 0
        while kind[first] < 2:
            sent[kind[first]].append(_Run(lcps[first], ns[first], convs[first], leaves[first], words[first], kids[first]))
            first += 1
        lens, cums, edges = (t.column(c).slice(first).to_pylist() for c in ("len", "cum", "edge"))
        lcps, convs, leaves, words = lcps[first:], convs[first:], leaves[first:], words[first:]
        block = t.column("block")[0].as_py()
        from_before, goes_on = copies[block]
        stack, left = _rightward(sent[0])[::-1], _leftward(sent[1])
        conv, depth, parent, n_convs, n_kids, n_leaves, saved, ends, gid = ([] for _ in range(9))
        parts: list[tuple[str, str]] = []
        ids: list[int] = []  # of the copies that follow
        last = len(lens) - 1
        for i in range(last, -1, -1):
            lcp, deep, cum = lcps[i], lens[i], cums[i]
            now, hi, below, child = _Run(lcp, 1, convs[i], leaves[i], 0, 0), deep, 0, None
            ids.append(convs[i])
            alone = deep > lcp
            if alone or i == 0 and from_before:
                text, open_ = ",".join(map(str, reversed(ids))), goes_on and i + len(ids) > last
                mark = hashlib.sha256((edges[last] if open_ else edges[0]).encode()).hexdigest() if open_ or not alone else None
                if mark:
                    parts.append((mark, text))
                digest = None if open_ else hashlib.sha256(text.encode()).hexdigest()
                ids = []
            while True:
                top = stack[-1].lcp if stack else -1
                low = max(top, lcp)
                if hi > low:
                    if child is not None:
                        parent[child] = now.conv_id
                    for d in range(hi, low, -1):
                        conv.append(now.conv_id)
                        depth.append(d)
                        parent.append(now.conv_id if d > low + 1 else None)
                        n_convs.append(now.n)
                        n_kids.append(below if d == hi else 1)
                        n_leaves.append(now.leaves)
                        saved.append(now.a - (now.n - 1) * (cum[d - 1] if d else 0))
                        own = d == deep
                        ends.append(digest if own else none)
                        gid.append(mark if own and digest is None else None)
                    child = len(conv) - 1
                if not stack or top <= lcp:
                    break
                run = stack.pop()
                below = run.kids + (hi > top)
                run.lcp = lcp  # only its sums count
                now.add(run)
                for x in run.waiting:
                    parent[x] = now.conv_id
                if child is not None:
                    parent[child] = now.conv_id
                child, hi = (None, top) if hi > top else (child, top)
            now.lcp, now.a, now.kids = lcp, now.a + words[i], int(deep > lcp)
            now.waiting = [child] if child is not None else []
            if stack and stack[-1].lcp == lcp:
                run = stack.pop()
                now.add(run)
                now.waiting = run.waiting + now.waiting
            stack.append(now)
        # parents that begin in earlier blocks
        right, k = None, 0
        for run in reversed(stack):
            right = run.conv_id if right is None else min(right, run.conv_id)
            if not run.waiting or run.lcp < 0:
                continue
            while left[k][0] >= run.lcp:
                k += 1
            for x in run.waiting:
                parent[x] = min(right, left[k][1])
        n, p = len(conv), len(parts)
        longs = [pa.array(c + [None] * p, pa.int64()) for c in (conv, depth, parent, n_convs, n_kids, n_leaves, saved)]
        out = pa.RecordBatch.from_arrays([*longs, pa.array(ends + [None] * p, pa.string()), pa.array(gid + [m for m, _ in parts], pa.string()), pa.array([block] * (n + p), pa.int32()), pa.array([None] * n + [x for _, x in parts], pa.string())], [*(c.split()[0] for c in NODE.split(", ")), "gid", "block", "part"])
        for start in range(0, out.num_rows, 10_000):
            yield out.slice(start, 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["block"]):
            yield from nodes(t)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gid, ends_sha256) of texts that come sorted by gid and block."""
    gid, state = None, None
    done: list[tuple[str, str]] = []
    for b in batches:
        for g, x in zip(columns(b, "gid").to_pylist(), columns(b, "part").to_pylist(), strict=True):
            if g != gid:
                if state:
                    done.append((gid, state.hexdigest()))
                gid, state = g, hashlib.sha256(x.encode())
            else:
                state.update(f",{x}".encode())
    if state:
        done.append((gid, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["gid", "ends_sha256"])


def trie(turns: DataFrame, group: int = 20, block_rows: int = BLOCK_ROWS, blocks: int | None = None) -> DataFrame:
    """The nodes of the trie, with the columns of ``NODE``."""
    spark = bounded(turns.sparkSession)
    convs = cut(rebuilt(turns, group), "rebuilt")
    blocks = blocks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-convs.count() // block_rows))
    rows = neighbours(convs, blocks)
    borders = _borders(rows)
    if not borders:
        return spark.createDataFrame([], NODE)
    rows = _whole(rows, borders)
    asks, between = _requests([tuple(r) for r in _summed(rows, "block").orderBy("block").collect()])
    sums = "lcp bigint, n bigint, conv_id bigint, leaves bigint, a bigint, kids bigint"
    asked = spark.createDataFrame(asks, "block int, kind int, step int, target int")
    cuts = segments(rows, True).withColumn("kind", F.lit(0)).unionByName(segments(rows, False).withColumn("kind", F.lit(1)))
    own = [c.split()[0] for c in sums.split(", ")]
    sent = asked.join(cuts, ["kind", "target"]).select("block", "kind", "step", F.col("seg").cast("bigint").alias("place"), *own)
    sent = sent.unionByName(spark.createDataFrame(between, f"block int, kind int, step int, {sums}").withColumn("place", F.lit(2**62)))
    every = rows.select("block", F.lit(2).alias("kind"), F.lit(0).alias("step"), "place", "lcp", F.lit(1).cast("long").alias("n"), "conv_id", F.col("leaf").alias("leaves"), "a", F.lit(0).cast("long").alias("kids"), "len", "cum", "edge")
    every = every.unionByName(sent, allowMissingColumns=True).repartition(blocks, "block").sortWithinPartitions("block", "kind", "step", "place")
    follows = [b[2] for b in borders[1:]] + [False]
    copies = {b: (copy, nxt) for (b, _, copy), nxt in zip(borders, follows, strict=True)}
    made = cut(every.mapInArrow(_tree(copies), f"{NODE}, gid string, block int, part string"), "nodes")
    names = [c.split()[0] for c in NODE.split(", ")]
    whole = made.filter("gid IS NULL").select(names)
    parts = made.filter("part IS NOT NULL").select("gid", "block", "part").repartition("gid").sortWithinPartitions("gid", "block")
    late = made.filter("gid IS NOT NULL AND part IS NULL").drop("ends_sha256").join(parts.mapInArrow(_hashed, "gid string, ends_sha256 string"), "gid")
    return whole.unionByName(late.select(names))


def sql(group: int = 20) -> str:
    """The same rows by grouping all prefixes, for DuckDB."""
    crc = "xor(xor(acc, CASE WHEN i % 8 = 0 THEN ord(c[(i // 8 + 1)::INT]) ELSE 0 END) >> 1, (xor(acc, CASE WHEN i % 8 = 0 THEN ord(c[(i // 8 + 1)::INT]) ELSE 0 END) & 1) * 3988292384)"
    return f"""
WITH t AS (
  SELECT conv_id, turn, substr(sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 1, {WIDE}) AS digest,
         len(regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+'))::BIGINT AS words
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, conv_id::VARCHAR AS c, list({{'d': digest, 'w': words}} ORDER BY turn NULLS FIRST, digest) AS own FROM t GROUP BY conv_id),
k AS (SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * len(c))), lambda acc, i: {crc}), 4294967295) % 4 AS h FROM o),
s AS (
  SELECT k.conv_id, list_concat(coalesce(b.own[1:k.h], []), k.own[k.h + 1:]) AS seq
  FROM k LEFT JOIN o b ON b.conv_id = k.conv_id - k.conv_id % {group}),
p AS (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS depth FROM s),
q AS (SELECT conv_id, depth, list_transform(seq[1:depth], lambda x: x.d) AS prefix, CASE WHEN depth > 0 THEN seq[depth].w ELSE 0 END AS w, len(seq) = depth AS whole FROM p),
n AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (whole), '')) AS ends_sha256
  FROM q GROUP BY prefix, depth),
c AS (SELECT prefix[1:depth - 1] AS prefix, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c USING (prefix, depth)),
u AS (SELECT prefix[1:a] AS prefix, a AS depth, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * w)::BIGINT AS saved_tokens
      FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM m) GROUP BY ALL)
SELECT m.conv_id, m.depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.n_leaves, u.saved_tokens, m.ends_sha256
FROM m JOIN u USING (prefix, depth) LEFT JOIN n up ON up.depth = m.depth - 1 AND up.prefix = m.prefix[1:m.depth - 1]
"""
