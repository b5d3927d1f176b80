"""Append-only logs: links, replays, gaps, the verification of whole ledgers, Merkle roots, anchors and bindings."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofgrid.functions.provenance import CanonicalError, canonical, canonical_json, signature_ok
from proofgrid.operators.components import shared_table
from proofgrid.operators.statistics import running

GENESIS = "sha256:" + "0" * 64
#: Lines or numbers that a task orders at once.
BLOCK = 1 << 16
REQUIRED = ("v", "ledger", "seq", "prev", "ts", "nonce", "kind", "body", "key_id", "sig")


def links(df: DataFrame, ledger: str = "ledger", line: str = "line", entry: str = "entry_hash", prev: str = "prev", genesis: str = GENESIS) -> DataFrame:
    """``df`` with linked (prev is the hash of the line before) and trusted (no line so far breaks its link)."""
    along = Window.partitionBy(ledger).orderBy(line)
    out = df.withColumn("linked", F.col(prev) == F.coalesce(F.lag(entry).over(along), F.lit(genesis)))
    return out.withColumn("trusted", F.min(F.col("linked").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)) == 1)


def replays(df: DataFrame, ledger: str = "ledger", line: str = "line") -> DataFrame:
    """``df`` (entry_hash, nonce, seq) with replay: entry, nonce or seq if that was seen on an earlier line, else null."""
    again = lambda c: F.row_number().over(Window.partitionBy(ledger, c).orderBy(line)) > 1
    return df.withColumn("replay", F.when(again("entry_hash"), "entry").when(again("nonce"), "nonce").when(again("seq"), "seq"))


def gaps(df: DataFrame, ledger: str = "ledger", line: str = "line", seq: str = "seq") -> DataFrame:
    """(ledger, line, first_missing, last_missing, kind): jumps above the greatest sequence number so far; a gap whose
    numbers all turn up later is a reorder, otherwise a deletion.

    The numbers that turn up in a gap are the difference of two running counts of distinct numbers, at its end and before its
    start, so no line meets the others of its ledger. ``line`` is an integer that is unique in its ledger.
    """
    rows = shared_table(df.select(F.col(ledger).alias("_l"), F.col(line).alias("_line"), F.col(seq).alias("_s")))
    first, last = F.coalesce(F.col("_top"), F.lit(-1)) + 1, F.col("_s") - 1
    jumps = shared_table(prefix(rows, "_l", "_line", _top=(F.max, F.col("_s"))).filter(F.col("_s") > first).select("_l", "_line", first.alias("first_missing"), last.alias("last_missing")))
    at = F.explode(F.array(F.col("first_missing") - 1, F.col("last_missing"))).alias("_s")
    points = rows.filter("_s IS NOT NULL").select("_l", "_s", F.lit(1).alias("_n")).unionByName(jumps.select("_l", at, F.lit(0).alias("_n"))).groupBy("_l", "_s").agg(F.max("_n").alias("_n"))
    count = shared_table(running(points, ["_l"], "_s", ["_n"]).select("_l", "_s", "cum__n"))
    below = count.select("_l", (F.col("_s") + 1).alias("first_missing"), F.col("cum__n").alias("_below"))
    upto = count.select("_l", F.col("_s").alias("last_missing"), F.col("cum__n").alias("_upto"))
    counted = jumps.join(below, ["_l", "first_missing"], "left").join(upto, ["_l", "last_missing"], "left")
    kind = F.when(F.col("_upto") - F.col("_below") == F.col("last_missing") - F.col("first_missing") + 1, "record_reorder").otherwise("record_deletion")
    return counted.select(F.col("_l").alias(ledger), F.col("_line").alias(line), "first_missing", "last_missing", kind.alias("kind"))


def prefix(df: DataFrame, key: str, order: str, **values) -> DataFrame:
    """``df`` with aggregates over the earlier rows of the same ``key``: name=(F.max, F.min or F.sum, column).

    ``order`` is an integer that is unique under its key. Rows are cut into blocks of 2^16 of its values; what is before a
    block comes from one row a block, so no task holds a key.
    """
    joined = {"max": F.greatest, "min": F.least, "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}
    out = df.withColumn("_block", F.floor(F.col(order) / BLOCK)).withColumns({f"_v_{n}": c for n, (_, c) in values.items()})
    part = out.groupBy(key, "_block").agg(*(f(f"_v_{n}").alias(f"_p_{n}") for n, (f, _) in values.items()))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(key, "_block", *(f(f"_p_{n}").over(earlier).alias(f"_b_{n}") for n, (f, _) in values.items()))
    inside = Window.partitionBy(key, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = out.join(part, [key, "_block"]).withColumns({n: joined[f.__name__](F.col(f"_b_{n}"), f(f"_v_{n}").over(inside)) for n, (f, _) in values.items()})
    return out.drop("_block", *(f"_{x}_{n}" for n in values for x in "vb"))


def _node(a, b):
    return F.unhex(F.sha2(F.concat(F.unhex(F.lit("01")), a, b), 256))


def subtrees(leaves: DataFrame, wide: int = 10) -> DataFrame:
    """(ledger, level, pos, h): all full subtrees over leaves (ledger, pos from 0 without holes, leaf), ``wide`` levels
    for each shuffle."""
    now = leaves.select("ledger", "pos", F.unhex(F.sha2(F.concat(F.unhex(F.lit("00")), F.col("leaf").cast("binary")), 256)).alias("h"))
    largest = (leaves.agg(F.max("pos")).first()[0] or 0) + 1
    out, base = None, 0
    while True:
        rows = now.groupBy("ledger", F.floor(F.col("pos") / (1 << wide)).alias("b")).agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("a"))
        rows = rows.select("ledger", "b", F.transform("a", lambda x: x["h"]).alias("l0"))
        for k in range(wide):
            rows = rows.withColumn(f"l{k + 1}", _paired(F.col(f"l{k}")))
        made = [F.transform(F.col(f"l{k}"), _placed(base + k, (1 << wide) >> k)) for k in range(wide + 1)]
        nodes = shared_table(rows.select("ledger", F.explode(F.concat(*made)).alias("x")).select("ledger", "x.level", "x.pos", "x.h"))
        top = base + wide
        out = nodes.filter(F.col("level") < top) if out is None else out.unionByName(nodes.filter(F.col("level") < top))
        if largest >> top == 0:
            return out.unionByName(nodes.filter(F.col("level") == top))
        now, base = nodes.filter(F.col("level") == top).select("ledger", "pos", "h"), top


def _paired(below):
    """The level above: an odd last node has no parent yet."""
    return F.transform(F.filter(F.transform(below, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: (p["i"] % 2 == 0) & (p["i"] + 1 < F.size(below))), lambda p: _node(p["x"], F.get(below, p["i"] + 1)))


def _placed(level: int, each: int):
    return lambda h, i: F.struct(F.lit(level).alias("level"), (F.col("b") * each + i).alias("pos"), h.alias("h"))


def tree_roots(sizes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ledger, size, root) of the first ``size`` leaves for each row of ``sizes``: the full subtrees at the bits of the size,
    joined from the smallest. A size beyond the leaves has no row."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(61)), lambda k: F.call_function("getbit", F.col("size"), k) == 1)
    need = sizes.filter("size > 0").select("ledger", "size").distinct().select("ledger", "size", F.explode(bits).alias("level"))
    need = need.withColumn("pos", F.call_function("shiftright", F.col("size"), F.col("level")) - 1)
    have = need.join(nodes, ["ledger", "level", "pos"]).groupBy("ledger", "size").agg(F.sort_array(F.collect_list(F.struct("level", "h"))).alias("a"))
    whole = have.filter(F.size("a") == F.bit_count("size"))
    root = F.aggregate(F.slice("a", 2, 64), F.col("a")[0]["h"], lambda acc, x: _node(x["h"], acc))
    return whole.select("ledger", "size", F.concat(F.lit("sha256:"), F.lower(F.hex(root))).alias("root"))


def merkle_roots(df: DataFrame, ledger: str = "ledger", seq: str = "seq", leaf: str = "entry_hash") -> DataFrame:
    """(ledger, size, root) of each ledger's leaves in ``seq`` order (an integer, unique in its ledger)."""
    rows = shared_table(prefix(df.select(F.col(ledger).alias("ledger"), F.col(seq).alias("seq"), F.col(leaf).alias("leaf")), "ledger", "seq", pos=(F.sum, F.lit(1).cast("long"))))
    return tree_roots(rows.groupBy("ledger").agg(F.count("*").alias("size")), subtrees(rows))


def key_states(records: DataFrame, keys: DataFrame, role: str = "ledger") -> DataFrame:
    """``records`` (key_id, ts text) with key_error: unknown, revoked, lacks the role, or used outside its validity."""
    k = keys.select("key_id", F.lit(True).alias("_known"), "public_key", "roles", "revoked", F.try_to_timestamp("not_before").alias("_from"), F.try_to_timestamp("not_after").alias("_to"))
    out = records.join(k, "key_id", "left").withColumn("_at", F.try_to_timestamp("ts"))
    error = (
        F.when(F.col("_known").isNull(), "unknown key").when(F.col("revoked"), "revoked key").when(~F.array_contains("roles", role), "key lacks the role")
        .when(F.col("_at").isNull(), "unreadable time").when(F.col("_from").isNotNull() & (F.col("_at") < F.col("_from")), "before the key is valid")
        .when(F.col("_to").isNotNull() & (F.col("_at") > F.col("_to")), "after the key is valid")
    )
    return out.withColumn("key_error", error).drop("_known", "_from", "_to", "_at", "roles", "revoked")


def bindings(records: DataFrame, models: DataFrame) -> DataFrame:
    """(line, seq, class): inference records whose model or preprocessing is not approved. Without approved ones nothing is said."""
    own = records.filter("kind = 'inference'").select("ledger", "line", "seq", F.get_json_object("body", "$.model_digest").alias("model"), F.get_json_object("body", "$.preprocess_digest").alias("pre"))
    parts = []
    for column, approved, name in (("model", "artifact_digest", "model_binding_violation"), ("pre", "preprocess_digest", "config_binding_violation")):
        known = models.filter(F.col(approved).isNotNull()).select(F.col(approved).alias("_d")).distinct()
        bad = own.join(known, F.col(column) == F.col("_d"), "left_anti").crossJoin(known.limit(1).select(F.lit(1).alias("_any")))  # one row, or none
        parts.append(bad.select("ledger", "line", "seq", F.lit(name).alias("class")))
    return parts[0].unionByName(parts[1])


def parsed(lines: DataFrame, keys: DataFrame, domain: str) -> DataFrame:
    """Raw lines (ledger_file, line, raw) with what can be told of each alone: fields, hash, key and signature.

    ``domain`` names the signing domain: messages are ``<domain>/ledger/v1`` and entries ``<domain>/entry/v1``, a zero
    byte, and the canonical record.
    """
    schema = "v int, ledger string, seq string, prev string, ts string, nonce string, kind string, key_id string, sig string"
    out = lines.filter(F.trim("raw") != "").withColumn("canonical", canonical_json("raw")).withColumn("r", F.from_json("raw", schema)).select("*", "r.*").drop("r")
    out = out.withColumn("body", F.get_json_object("raw", "$.body")).withColumn("unsigned", _unsigned("canonical"))
    out = out.withColumn("complete", F.coalesce(F.size(F.array_intersect(F.json_object_keys("raw"), F.array(*map(F.lit, REQUIRED)))) == len(REQUIRED), F.lit(False)))
    whole = F.concat(F.lit(f"{domain}/entry/v1").cast("binary"), F.unhex(F.lit("00")), F.col("canonical").cast("binary"))
    out = out.withColumn("entry_hash", F.concat(F.lit("sha256:"), F.sha2(whole, 256)))
    out = key_states(out, keys)
    message = F.concat(F.lit(f"{domain}/ledger/v1").cast("binary"), F.unhex(F.lit("00")), F.col("unsigned").cast("binary"))
    return out.withColumn("signed", signature_ok(F.coalesce("public_key", F.lit("")), message, F.coalesce("sig", F.lit("")))).drop("unsigned", "public_key")


@F.pandas_udf(T.StringType())
def _unsigned(raw: pd.Series) -> pd.Series:
    def one(text):
        try:
            record = json.loads(text)
            record.pop("sig", None)
            return canonical(record)
        except (CanonicalError, ValueError, TypeError, AttributeError):
            return None

    return raw.map(one)


def _earliest(rows: DataFrame, by: str, mark: str) -> DataFrame:
    """(ledger_file, line, ``mark``) of the first line of a file with each value of ``by``."""
    return rows.groupBy("ledger_file", by).agg(F.min("line").alias("line")).select("ledger_file", "line", F.lit(True).alias(mark))


def _marked(rows: DataFrame, first: DataFrame, mark: str) -> DataFrame:
    return rows.join(first, ["ledger_file", "line"], "left").withColumn(mark, F.coalesce(mark, F.lit(False)))


def _filled(accepted: DataFrame, jumps: DataFrame) -> DataFrame:
    """(ledger_file, line) of the ``jumps`` (ledger_file, line, seq, top) whose missing numbers all occur in ``accepted``.

    In the order of numbers, a number less its rank is the same for all of an unbroken run.
    """
    runs = prefix(accepted.filter("seq >= 0").select("ledger_file", "seq"), "ledger_file", "seq", rank=(F.sum, F.lit(1).cast("long")))
    runs = runs.select("ledger_file", "seq", (F.col("seq") - F.col("rank")).alias("run"))
    own = jumps.join(runs, ["ledger_file", "seq"]).withColumnRenamed("run", "own")
    before = runs.select("ledger_file", F.col("seq").alias("top"), "run")
    return own.join(before, ["ledger_file", "top"], "left").filter(F.col("own") == F.coalesce("run", F.lit(0))).select("ledger_file", "line", F.lit(True).alias("filled"))


def verify(checked: DataFrame) -> DataFrame:
    """(ledger_file, line, seq, kind, entry_hash, status, classes) of `parsed` lines; a line has a class once.

    What a line is depends on the lines before through four running values, each a prefix aggregate over blocks of lines:
    the ledger's name (that of its first complete line), first occurrences of hashes, nonces and numbers, the largest
    number so far with its hash, and whether the chain was broken. A line is *accepted* if it is readable, of this ledger,
    and the first with its hash and nonce, and, of those, the first with its number. Accepted lines set the running number;
    one above it leaves a gap, one below it is out of order. The chain breaks at the first line that has a class other
    than replay, or that doesn't name the hash of the largest number before it; only that line fails for its link, and
    later ones are untrusted. Checkpoints are compared with roots over the full subtrees of the unbroken lines. Line
    numbers are unique in a file; no task holds a ledger.
    """
    number = F.when(F.col("complete") & F.col("seq").rlike("^-*[0-9]+$"), F.col("seq").try_cast("long"))
    rows = checked.select("ledger_file", "line", "kind", "ledger", "entry_hash", "nonce", "prev", "body", F.coalesce("complete", F.lit(False)).alias("complete"), "key_error", F.coalesce("signed", F.lit(False)).alias("signed"), number.alias("seq"), (F.col("complete") & F.col("canonical").isNotNull()).alias("readable"))
    named = F.when(F.col("complete") & F.col("ledger").isNotNull(), F.struct("line", "ledger"))
    rows = shared_table(prefix(shared_table(rows), "ledger_file", "line", name=(F.min, named)))  # hashes and signatures once
    rows = rows.withColumn("foreign", F.col("complete") & F.col("name").isNotNull() & ~F.col("ledger").eqNullSafe(F.col("name.ledger")))
    readable = rows.filter("readable")
    rows = _marked(_marked(rows, _earliest(readable, "entry_hash", "new_entry"), "new_entry"), _earliest(readable, "nonce", "new_nonce"), "new_nonce")
    rows = rows.withColumn("clean", F.expr("readable AND NOT foreign AND new_entry AND new_nonce"))
    rows = _marked(rows, _earliest(rows.filter("clean AND seq IS NOT NULL"), "seq", "new_seq"), "new_seq")
    rows = shared_table(rows.withColumn("accepted", F.expr("clean AND new_seq")).withColumn("replay", F.expr("readable AND (NOT clean OR (seq IS NOT NULL AND NOT new_seq))")))
    rows = prefix(rows, "ledger_file", "line", tip=(F.max, F.when(F.expr("accepted AND seq >= 0"), F.struct("seq", "entry_hash"))))
    due = F.coalesce(F.col("tip.seq") + 1, F.lit(0))
    say = lambda when, name: F.when(when, F.lit(name))
    alone = F.array(
        say(F.col("foreign") | F.col("replay"), "record_replay"), say(F.col("readable") & F.col("key_error").isNotNull(), "signature_forgery"),
        say(~F.col("readable") | (F.col("key_error").isNull() & ~F.col("signed")) | F.col("seq").isNull(), "record_modification"),
        say(F.col("accepted") & (F.col("seq") > due), "record_deletion"), say(F.col("accepted") & (F.col("seq") < due), "record_reorder"),
    )
    rows = rows.withColumn("classes", F.array_compact(alone))
    unlinked = F.col("readable") & ~F.col("replay") & (F.size("classes") == 0) & ~F.col("prev").eqNullSafe(F.coalesce("tip.entry_hash", F.lit(GENESIS)))
    rows = rows.withColumn("unlinked", unlinked)
    breaks = F.col("unlinked") | F.exists("classes", lambda x: x != "record_replay")
    rows = prefix(rows, "ledger_file", "line", broken=(F.max, breaks.cast("int"))).withColumn("broken", F.coalesce("broken", F.lit(0)) == 1)
    rows = rows.withColumn("classes", F.when(F.col("unlinked") & ~F.col("broken"), F.array(F.lit("record_modification"))).otherwise(F.col("classes")))
    rows = rows.withColumn("status", F.when(F.size("classes") > 0, "FAILED").when(F.col("broken"), "UNTRUSTED").otherwise("VALID"))
    rows = shared_table(rows.select("ledger_file", "line", "seq", "kind", "entry_hash", "body", "accepted", F.col("tip.seq").alias("top"), "status", "classes"))

    jumps = rows.filter(F.array_contains("classes", "record_deletion")).select("ledger_file", "line", "seq", "top")
    filled = _filled(rows.filter("accepted"), jumps)
    claims = rows.filter("kind = 'checkpoint' AND status = 'VALID'").select(F.col("ledger_file").alias("ledger"), "line", "seq", F.get_json_object("body", "$.tree_size").try_cast("long").alias("size"), F.get_json_object("body", "$.root").alias("claim"))
    sound = rows.filter("accepted AND status = 'VALID'").select(F.col("ledger_file").alias("ledger"), F.col("seq").alias("pos"), F.col("entry_hash").alias("leaf"))
    possible = claims.filter("size > 0 AND size <= seq + 1")
    agreed = possible.join(tree_roots(possible, subtrees(sound)), ["ledger", "size"]).filter("root = claim").select(F.col("ledger").alias("ledger_file"), "line", F.lit(True).alias("agreed"))
    out = rows.join(filled, ["ledger_file", "line"], "left").join(agreed, ["ledger_file", "line"], "left")
    status = F.when(F.expr("kind = 'checkpoint' AND status = 'VALID' AND agreed IS NULL"), "FAILED").otherwise(F.col("status"))
    classes = F.when(F.col("filled"), F.transform("classes", lambda x: F.when(x == "record_deletion", F.lit("record_reorder")).otherwise(x))).otherwise(F.col("classes"))
    return out.select("ledger_file", "line", "seq", "kind", "entry_hash", status.alias("status"), classes.alias("classes"))


def check_anchors(anchors: DataFrame, verified: DataFrame) -> DataFrame:
    """(anchor, tree_size, status) for anchors (anchor, ledger_file, tree_size, root): CONSISTENT, MISMATCH or TRUNCATED."""
    first = verified.filter("seq IS NOT NULL").withColumn("_i", F.row_number().over(Window.partitionBy("ledger_file", "seq").orderBy("line"))).filter("_i = 1")
    own = anchors.join(first.select("ledger_file", "seq", "entry_hash"), "ledger_file").filter("seq < tree_size")
    whole = own.groupBy("anchor", "tree_size").agg(F.count("*").alias("_n"))
    roots = merkle_roots(own.select(F.col("anchor").alias("ledger"), "seq", "entry_hash")).select(F.col("ledger").alias("anchor"), F.col("root").alias("_root"))
    out = anchors.join(whole, ["anchor", "tree_size"], "left").join(roots, "anchor", "left")
    status = F.when(F.coalesce("_n", F.lit(0)) < F.col("tree_size"), "TRUNCATED").when(F.col("_root") == F.col("root"), "CONSISTENT").otherwise("MISMATCH")
    return out.select("anchor", "tree_size", status.alias("status"))
