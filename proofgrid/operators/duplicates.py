"""Near duplicates by two hashes, mirrored copies included, confirmed by cosine.

Rows with the same four hashes form a class and stand for each other: they are all linked, by a star from the least id,
never pair by pair. Classes meet through ``pairs.probe_join`` on the first hash; the second one is checked at once.

Pairs are dropped where a task finds them if their second hashes are apart, or if their cosine can't be great enough.

* ``near_pairs``: pairs of classes whose first *and* second hash are within their bounds, directly or, if not, with the
  later one mirrored. A class counts as later than another if one of its rows is.
* ``confirmed``: of these, the pairs that are tight by hash alone, or of which two members have a cosine of at least
  ``min_cosine``. Large classes meet in blocks, so no task holds a class.
* ``components``: (node, component) over copies and confirmed pairs.

Rows with a null among their hashes are in no pair. A null vector or one of zeros has no cosine. An empty table gives no
pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofgrid.functions.columns import hamming
from proofgrid.operators.components import connected_components, shared_table
from proofgrid.operators.pairs import class_join, probe_join

HASHES = ["phash", "dhash", "phash_flip", "dhash_flip"]
#: Rows of a class that meet those of another in one row of the join.
BLOCK = 64
#: Bounds of the two hashes below which a pair needs no cosine.
TIGHT = (2, 3)


def classes(rows: DataFrame, id_col: str = "sample_id", vector: str | None = None) -> DataFrame:
    """(i, last, n, the four hashes): the distinct hashes, with the least and the greatest id and the number of rows; with a
    vector also centre, one of the class's unit vectors in bytes."""
    whole = rows.filter(" AND ".join(f"{h} IS NOT NULL" for h in HASHES))
    kept = [F.min(id_col).alias("i"), F.max(id_col).alias("last"), F.count("*").alias("n")]
    if vector:
        whole = whole.withColumn("_c", _bytes(F.col(vector).cast("array<double>")))
        kept.append(F.min_by("_c", F.when(F.col("_c").isNotNull(), F.col(id_col))).alias("centre"))
    return whole.groupBy(*HASHES).agg(*kept)


def _norm(v: np.ndarray | None) -> float:
    """0 for no vector or zeros; whatever isn't finite (or null: NaN here) gives NaN, which tells nothing."""
    if v is None:
        return 0.0
    with np.errstate(over="ignore", invalid="ignore"):
        n = float(v @ v) ** 0.5
    return n if np.isfinite(n) else np.nan


@F.pandas_udf(T.BinaryType())
def _bytes(vectors: pd.Series) -> pd.Series:
    def one(v):
        n = _norm(v)
        return None if n == 0 else np.rint(np.nan_to_num(v / n) * 127).clip(-127, 127).astype(np.int8).tobytes()

    return vectors.map(one)


@F.pandas_udf(T.DoubleType())
def _apart(vectors: pd.Series, centres: pd.Series) -> pd.Series:
    """The distance of a unit vector from its class's centre; NaN if it can't be told, null without a vector."""

    def one(v, c):
        n = _norm(v)
        if n == 0:
            return None
        c = np.frombuffer(c, np.int8) / 127
        return float(np.sqrt(np.square(v / n - c).sum())) if len(c) == len(v) else np.nan

    return pd.Series([one(v, c) for v, c in zip(vectors, centres, strict=True)], dtype=object)


class _Fit:
    """Whether a pair found by its first hash is within the bound of the second and, with ``alike`` (the least cosine, and the
    bounds of tight pairs), whether it is tight or its cosine can reach the least: for unit vectors u and v within r and s of
    the centres c and d, u.v <= c.d + r + s + r * s. Nothing that can be alike is dropped."""

    def __init__(self, other: str, bound: int, alike: tuple[float, tuple[int, int]] | None):
        self.other, self.bound, self.alike = other, bound, alike

    def read(self, rows: pa.StructArray, is_probe: bool) -> tuple:
        second = rows.field(self.other if is_probe else "dhash").to_numpy(zero_copy_only=False)
        if not self.alike:
            return second, None, None
        centres = rows.field("centre").to_pylist()
        width = max((len(c) for c in centres if c is not None), default=0)
        # no vector: no cosine is great enough; another length: it can't be told
        radius = np.array([-np.inf if c is None else np.nan if len(c) != width or r is None else r for c, r in zip(centres, rows.field("radius").to_pylist(), strict=True)], float)
        return second, np.frombuffer(b"".join((c or b"").ljust(width, b"\0") for c in centres), np.int8).reshape(len(centres), width), radius

    def __call__(self, mine: tuple, theirs: tuple, row: np.ndarray, query: np.ndarray, distance: np.ndarray, step: int = 4_096) -> np.ndarray:
        second = np.bitwise_count((mine[0][row] ^ theirs[0][query]).view(np.uint64))
        ok = second <= self.bound
        if self.alike:
            least, (first, other) = self.alike
            ask = np.flatnonzero(ok & ~((distance <= first) & (second <= other)))
            for s in range(0, len(ask), step):
                at = ask[s : s + step]
                i, j = row[at], query[at]
                r, t = mine[2][i], theirs[2][j]
                if mine[1].shape[1] == theirs[1].shape[1]:
                    reach = np.einsum("ij,ij->i", mine[1][i], theirs[1][j], dtype=np.int32) / 127**2
                    none = np.isneginf(r) | np.isneginf(t)
                    r, t = np.where(none, 0, r), np.where(none, 0, t)
                    ok[at] = ~none & ~(reach + r + t + r * t < least - 1e-6)
                else:
                    ok[at] = ~(np.isneginf(r) | np.isneginf(t))
        return ok


def near_pairs(kinds: DataFrame, max_phash: int = 8, max_dhash: int = 10, width: int = 64, alike: tuple[float, tuple[int, int]] | None = None) -> DataFrame:
    """(i, j, phash_distance, dhash_distance, mirrored), i < j, of the classes within both bounds. With ``alike`` (the least
    cosine, and the bounds of tight pairs) and the columns centre and radius, most that ``confirmed`` would drop isn't sent."""
    rows = kinds.select("i", "last", *HASHES, *(["centre", "radius"] if alike else []))
    near = lambda a, b, suffix: (hamming(F.col(f"{a}.phash"), F.col(f"{b}.phash{suffix}")) <= max_phash) & (hamming(F.col(f"{a}.dhash"), F.col(f"{b}.dhash{suffix}")) <= max_dhash)
    second = lambda suffix: hamming(F.col("a.dhash"), F.col(f"b.dhash{suffix}")).alias("dhash_distance")
    pair = [F.least("a.i", "b.i").alias("i"), F.greatest("a.i", "b.i").alias("j"), F.col("distance").alias("phash_distance")]
    direct = probe_join(rows, rows, "phash", "phash", max_phash, width, _Fit("dhash", max_dhash, alike)).filter(F.expr("a.i < b.i"))
    mirrored = probe_join(rows, rows, "phash", "phash_flip", max_phash, width, _Fit("dhash_flip", max_dhash, alike))
    mirrored = mirrored.filter(F.expr("a.i <> b.i AND a.i < b.last") & ~near("a", "b", ""))
    mirrored = mirrored.filter(~(F.expr("a.i > b.i") & near("b", "a", "_flip")))  # the pair counts once
    return direct.select(*pair, second(""), F.lit(False).alias("mirrored")).unionByName(mirrored.select(*pair, second("_flip"), F.lit(True).alias("mirrored")))


def members(rows: DataFrame, kinds: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """``rows`` with i, the class's least id, n, its number of rows, and its centre, if ``kinds`` has one."""
    return class_join(rows, kinds.select(*HASHES, "i", "n", *({"centre"} & {*kinds.columns})), HASHES, "n", rows.count())


def _unit(v):
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    # the array of one holds the norm, so that it is summed once and not for every component
    return F.transform(F.array(norm), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)))[0]


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosines(pairs: DataFrame, own: DataFrame, vector: str, id_col: str = "sample_id") -> DataFrame:
    """(i, j, cosine): the greatest cosine between members of two classes; ``own`` is the result of ``members``."""
    unit = own.select("i", F.pmod(F.xxhash64(id_col), F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK))).alias("block"), _unit(F.col(vector)).alias("u")).filter("u IS NOT NULL")
    needed = pairs.select("i").union(pairs.select("j")).distinct()
    blocks = unit.join(needed, "i", "left_semi").groupBy("i", "block").agg(F.collect_list("u").alias("us"))
    met = pairs.select("i", "j").join(blocks.select("i", F.col("us").alias("a")), "i").join(blocks.select(F.col("i").alias("j"), F.col("us").alias("b")), "j")
    best = F.array_max(F.transform("a", lambda x: F.array_max(F.transform("b", lambda y: _dot(x, y)))))
    return met.select("i", "j", best.alias("cosine")).groupBy("i", "j").agg(F.max("cosine").alias("cosine"))


def confirmed(pairs: DataFrame, own: DataFrame, vector: str, min_cosine: float = 0.9, tight: tuple[int, int] = TIGHT, id_col: str = "sample_id") -> DataFrame:
    """``pairs`` with their cosine, of those that are tight by hash or alike by cosine."""
    pairs = shared_table(pairs)
    out = pairs.join(cosines(pairs, own, vector, id_col), ["i", "j"], "left")
    return out.filter((F.col("cosine") >= min_cosine) | ((F.col("phash_distance") <= tight[0]) & (F.col("dhash_distance") <= tight[1])))


def links(rows: DataFrame, vector: str | None = "embedding", max_phash: int = 8, max_dhash: int = 10, min_cosine: float = 0.9, width: int = 64, id_col: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """The confirmed pairs of classes, and the rows with their classes (``members``). Without a vector, the hashes decide."""
    kinds = shared_table(classes(rows, id_col, vector))
    own = shared_table(members(rows, kinds, id_col).drop(*HASHES))
    if not vector:
        return shared_table(near_pairs(kinds, max_phash, max_dhash, width)), own
    spread = own.filter("centre IS NOT NULL").groupBy("i").agg(F.max(_apart(F.col(vector).cast("array<double>"), "centre")).alias("radius"))
    pairs = near_pairs(shared_table(kinds.join(spread, "i", "left")), max_phash, max_dhash, width, (min_cosine, TIGHT))
    return shared_table(confirmed(pairs, own, vector, min_cosine, id_col=id_col)), own


def _components(pairs: DataFrame, own: DataFrame, id_col: str) -> DataFrame:
    copies = own.filter(F.col(id_col) > F.col("i")).select("i", F.col(id_col).alias("j"))
    return connected_components(pairs.select("i", "j").unionByName(copies), "i", "j")


def components(rows: DataFrame, vector: str | None = "embedding", id_col: str = "sample_id", **bounds) -> DataFrame:
    """(node, component) of all rows with a duplicate."""
    return _components(*links(rows, vector, id_col=id_col, **bounds), id_col)


def clusters(rows: DataFrame, contributors: DataFrame, vector: str | None = "embedding", id_col: str = "sample_id", **bounds) -> DataFrame:
    """(component, size, mean_distance, dominant, dominant_n): mean_distance is that of the first hash over all linked
    pairs of rows, copies included, which the classes' sizes give; dominant is the contributor with most rows (the first
    by name of equals), from ``contributors`` (id, contributor)."""
    pairs, own = links(rows, vector, id_col=id_col, **bounds)
    node = shared_table(_components(pairs, own, id_col))
    sizes = own.select("i", "n").distinct().join(node, F.col("i") == F.col("node")).select("i", F.col("n").cast("double").alias("n"), "component")
    inside = sizes.groupBy("component").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("k"), F.lit(0.0).alias("s"))
    a, c = sizes.select("i", "component", F.col("n").alias("na")), sizes.select(F.col("i").alias("j"), F.col("n").alias("nb"))
    across = pairs.join(a, "i").join(c, "j").groupBy("component").agg(F.sum(F.col("na") * F.col("nb")).alias("k"), F.sum(F.col("na") * F.col("nb") * F.col("phash_distance")).alias("s"))
    mean = inside.unionByName(across).groupBy("component").agg((F.sum("s") / F.sum("k")).alias("mean_distance"))
    who = node.join(contributors.withColumnRenamed(id_col, "node"), "node").groupBy("component", "contributor").agg(F.count("*").alias("m"))
    top = F.min(F.struct((-F.col("m")).alias("m"), F.col("contributor").isNull().alias("unknown"), "contributor"))
    best = who.groupBy("component").agg(F.sum("m").alias("size"), top.alias("top")).select("component", "size", F.col("top.contributor").alias("dominant"), (-F.col("top.m")).alias("dominant_n"))
    return best.join(mean, "component")


def majorities(rows: DataFrame) -> DataFrame:
    """(component, n_labels, majority, n_minority) of clusters with two labels or more, from rows (component, label, vote). Labels
    that are tied for most rows are told apart by the votes for them in the cluster; if these tie too, there is no majority and all
    labelled rows are the minority. Rows without a label count as votes only; a null vote is none."""
    both = F.explode(F.array(F.struct(F.col("label").alias("what"), F.lit(1).alias("n"), F.lit(0).alias("votes")), F.struct(F.col("vote").alias("what"), F.lit(0).alias("n"), F.lit(1).alias("votes")))).alias("x")
    by = rows.select("component", both).select("component", "x.*").filter("what IS NOT NULL").groupBy("component", "what").agg(F.sum("n").alias("n"), F.sum("votes").alias("votes")).filter("n > 0")
    # a label more than once at the top shows as a second label with the same two numbers
    top = by.groupBy("component").agg(F.count("*").alias("n_labels"), F.sum("n").alias("all"), F.max(F.struct("n", "votes")).alias("top")).filter("n_labels > 1")
    best = by.join(top, "component").filter((F.col("n") == F.col("top.n")) & (F.col("votes") == F.col("top.votes"))).groupBy("component", "n_labels", "all", "top").agg(F.count("*").alias("ways"), F.min("what").alias("what"))
    one = F.col("ways") == 1
    return best.select("component", "n_labels", F.when(one, F.col("what")).alias("majority"), (F.col("all") - F.when(one, F.col("top.n")).otherwise(0)).alias("n_minority"))
