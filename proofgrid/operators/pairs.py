"""Pair joins: equal digests, Hamming distance by probed bands, and nearest neighbours by blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.functions.columns import hamming


def digest_links(df: DataFrame, id_col: str, digest: str) -> DataFrame:
    """(i, j): a star of links from the least id of each digest to its other rows, which spans the group without
    all its pairs."""
    least = df.groupBy(digest).agg(F.min(id_col).alias("i"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return df.select(digest, F.col(id_col).alias("j")).join(least, digest).filter("i < j").select("i", "j")


def band_plan(width: int, most: int, rows: int, probes: int = 4_096) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of the bands by which hashes within ``most`` bits of each other are found.

    With m bands, most = m * r + a: two such hashes are within r bits on one of the first a + 1 bands or within r - 1 on a
    later one, as they would differ in more than ``most`` bits otherwise. Few wide bands cost probes (all keys within the
    radius), many narrow ones cost chance meetings; the plan with the fewest rows for so many hashes is taken, and every
    plan gives the same pairs.
    """
    rows, best = max(rows, 1), None
    for m in range(1, min(most + 1, width) + 1):
        r, extra = divmod(most, m)
        cuts = [width * k // m for k in range(m + 1)]
        bands = [(lo, hi - lo, r if k <= extra else r - 1) for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
        bands = [x for x in bands if x[2] >= 0]
        balls = [sum(comb(n, k) for k in range(r + 1)) for _, n, r in bands]
        cost = rows * (len(bands) + sum(balls)) + rows * rows * sum(b / 2**n for b, (_, n, _) in zip(balls, bands, strict=True))
        if sum(balls) <= probes and (best is None or cost < best[0]):
            best = cost, bands
    return best[1]


def _ball(first: int, bits: int, radius: int) -> list[int]:
    """What to flip in a band for all keys within the radius, as signed longs."""
    out = [sum(1 << (first + k) for k in at) for n in range(radius + 1) for at in combinations(range(bits), n)]
    return [x - (1 << 64) if x >> 63 else x for x in out]


class _Hashes:
    """The hashes of a block, sorted by each band, of which those within ``most`` bits of a query are found by asking for every
    key within a band's radius. A pair that meets in several bands counts in the first of them."""

    #: Bits of a table of starts.
    WIDEST = 21

    def __init__(self, hashes: np.ndarray, most: int, bands: list[tuple[int, int, int]]):
        self.h, self.most, self.bands = hashes.view(np.uint64), most, []
        for first, bits, radius in bands:
            mask, wide = np.uint64(((1 << bits) - 1) << first), bits > self.WIDEST
            place = self._place(self.h & mask, first, wide)
            n = np.bincount(place, minlength=1 << min(bits, self.WIDEST))
            starts = np.cumsum(np.concatenate([[0], n])).astype(np.int32)
            flips = np.array(_ball(first, bits, radius), np.int64).view(np.uint64)
            self.bands.append((mask, first, wide, radius, flips, n > 0, starts, np.argsort(place, kind="stable").astype(np.int32)))

    def _place(self, keys: np.ndarray, first: int, wide: bool) -> np.ndarray:
        """Where keys stand in the table of starts: at themselves, or at the top bits of a multiple if they are wide."""
        keys = keys >> np.uint64(first)
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.WIDEST) if wide else keys).view(np.int64)

    def near(self, asked: np.ndarray, step: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, query, bits by which they differ), in parts of ``step`` candidates and one bucket more at most."""
        asked = asked.view(np.uint64)
        for k, (mask, first, wide, _, flips, filled, starts, order) in enumerate(self.bands):
            many = max(1, step // len(flips))
            for a in range(0, len(asked), many):
                key = asked[a : a + many] & mask
                if wide:
                    place = self._place((key[:, None] ^ flips).ravel(), first, wide)
                else:  # a flip moves a place as it moves the key
                    place = (self._place(key, first, wide)[:, None] ^ self._place(flips, first, wide)).ravel()
                hit = np.flatnonzero(filled[place])
                low = starts[place[hit]]
                n = starts[place[hit] + 1] - low
                ends = np.cumsum(n)
                for s, e in self._cuts(ends, step):
                    each = n[s:e]
                    at = np.repeat(low[s:e] - np.cumsum(each) + each, each) + np.arange(each.sum())
                    row, probe = order[at], np.repeat(hit[s:e], each)
                    query = a + probe // len(flips)
                    differ = self.h[row] ^ asked[query]
                    ok = np.flatnonzero(np.bitwise_count(differ) <= self.most)
                    row, query, differ, flip = row[ok], query[ok], differ[ok], flips[probe[ok] % len(flips)]
                    own = (differ & mask) == flip
                    for before, _, _, radius, *_ in self.bands[:k]:
                        own &= np.bitwise_count(differ & before) > radius
                    yield row[own], query[own], np.bitwise_count(differ[own]).astype(np.int32)

    @staticmethod
    def _cuts(ends: np.ndarray, step: int) -> Iterator[tuple[int, int]]:
        s = 0
        while s < len(ends):
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + step, side="right")))
            yield s, e
            s = e


def _meet(most: int, bands: list[tuple[int, int, int]], fit, each: int = 65_536):
    """Rows (block, is_base, bits, a, b) sorted by block, base rows first: their hashes are held, probes stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, base = None, [], None
        for batch in batches:
            blocks, is_base = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (is_base[1:] != is_base[:-1])) + 1
            for s, e in zip([0, *edges], [*edges, len(blocks)], strict=True):
                if s == e:
                    continue
                if blocks[s] != block:
                    block, held, base = blocks[s], [], None
                part = batch.slice(s, e - s)
                if is_base[s]:
                    held.append(part)
                    continue
                if base is None and held:
                    table, held = pa.Table.from_batches(held).combine_chunks(), []
                    mine = table["a"].chunk(0)
                    base = _Hashes(table["bits"].to_numpy(), most, bands), mine, fit and fit.read(mine, False)
                if base is None:
                    continue
                asked, theirs = part.column(2).to_numpy(zero_copy_only=False), part.column(4)
                read = fit and fit.read(theirs, True)
                for row, query, distance in base[0].near(asked):
                    for x in range(0, len(row), each):
                        r, q, d = row[x : x + each], query[x : x + each], distance[x : x + each]
                        if fit:
                            ok = fit(base[2], read, r, q, d)
                            r, q, d = r[ok], q[ok], d[ok]
                        if len(r):
                            yield pa.RecordBatch.from_arrays([base[1].take(pa.array(r)), theirs.take(pa.array(q)), pa.array(d)], ["a", "b", "distance"])

    return run


def probe_join(index: DataFrame, probe: DataFrame, index_bits: str, probe_bits: str, most: int, width: int, fit=None, base_block: int = 1 << 19) -> DataFrame:
    """(a, b, distance): the rows of ``index`` and ``probe`` as structs whose hashes are within ``most`` bits, each pair once.

    ``index`` is dealt into blocks and ``probe`` into groups, as many of each, so that there are two tasks or more for each core. A
    task holds one block, sorted by its bands (``band_plan``), and one group streams past it, asking for every key within a band's
    radius: what is asked for is never written, and a row is sent to as many tasks as there are groups or blocks. ``fit`` drops
    pairs where they are found: ``read(rows, is_probe)`` gives what it needs of a batch of structs, and a call with that of both,
    the places of the pairs in them and their distances tells which stay.
    """
    index, probe = index.dropna(subset=[index_bits]), probe.dropna(subset=[probe_bits])
    rows, asks = index.count(), probe.count()
    square = ceil(sqrt(2 * index.sparkSession.sparkContext.defaultParallelism))
    n_blocks = max(-(-rows // base_block), min(square, -(-rows // 4_096)), 1)
    n_groups = max(min(square, -(-asks // 4_096)), 1)
    bands = band_plan(width, most, -(-rows // n_blocks))

    def dealt(df: DataFrame, bits: str, n: int, each: int, is_base: bool) -> DataFrame:
        own, to = F.pmod(F.xxhash64(*df.columns, F.lit(is_base)), F.lit(n)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(each - 1)))
        out = df.select(own.alias("own"), to.alias("to"), F.col(bits).cast("long").alias("bits"), F.struct("*").alias("a" if is_base else "b"))
        return out.select(F.expr(f"own * {n_groups} + to" if is_base else f"to * {n_groups} + own").alias("block"), F.lit(is_base).alias("is_base"), "bits", "a" if is_base else "b")

    met = dealt(index, index_bits, n_blocks, n_groups, True).unionByName(dealt(probe, probe_bits, n_groups, n_blocks, False), allowMissingColumns=True).select("block", "is_base", "bits", "a", "b")
    met = met.repartitionById(n_blocks * n_groups, "block").sortWithinPartitions("block", F.col("is_base").desc())
    kinds = dict(met.dtypes)
    return met.mapInArrow(_meet(most, bands, fit), f"a {kinds['a']}, b {kinds['b']}, distance int")


def hamming_pairs(df: DataFrame, id_col: str, bits: str, most: int, width: int = 63, flip: str | None = None) -> DataFrame:
    """(i, j, distance, mirrored), i < j, of all pairs of rows within ``most`` bits, exactly, by ``probe_join``.

    ``flip`` names the mirrored hash of the later row; a direct match counts before a mirrored one. Rows of equal hash
    are pairs too: where many copies can occur, use ``duplicates.near_pairs``, which takes distinct hashes.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(bits).alias("bits"), *([F.col(flip).alias("flip")] if flip else []))
    plain = rows.select("id", "bits")
    found = probe_join(plain, plain, "bits", "bits", most, width).filter("a.id < b.id")
    direct = found.select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), "distance", F.lit(False).alias("mirrored"))
    if not flip:
        return direct
    other = probe_join(plain, rows, "bits", "flip", most, width).filter((F.col("a.id") < F.col("b.id")) & (hamming(F.col("a.bits"), F.col("b.bits")) > most))
    return direct.unionByName(other.select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), "distance", F.lit(True).alias("mirrored")))


def class_join(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``classes``, which has one row for each of ``keys`` with its number of rows.

    Classes of a thousandth of all rows or more (1,000 at most) go by broadcast, so that no task gets such a class whole.
    """
    hot = F.broadcast(classes.filter(F.col(size) * 1_000 >= total))
    rest = classes.filter(F.col(size) * 1_000 < total)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(keys), keys, "left_anti").join(rest, keys))


def _rows(column: pa.Array) -> np.ndarray:
    """A row of doubles for each vector, none of them null; a null component is NaN."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes != sizes[:1]).any():
        raise ValueError("vectors differ in length")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lowest(values: np.ndarray, k: int) -> np.ndarray:
    """The k lowest of each row, infinite where there are fewer."""
    if values.shape[1] < k:
        values = np.pad(values, ((0, 0), (0, k - values.shape[1])), constant_values=np.inf)
    return np.partition(values, k - 1, axis=1)[:, :k]


class _Block:
    """Base vectors, by which rows near a query are found from matrix products and only those measured.

    A product of centred vectors gives the squared distance less the query's own square (or the negative cosine), up to a
    rounding below ``error`` times the squares of both. What may lie below the k-th lowest upper bound is measured component
    by component, so neighbours, distances and ties are those of measuring all. Of equal vectors only the k + 1 least ids
    can be neighbours (one may be the query), so copies beyond them are dropped. Rows with a component that isn't finite have
    no distance.
    """

    @np.errstate(over="ignore", invalid="ignore")
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, metric: str, width: int = 1_024):
        vectors = self._scaled(vectors, metric)
        keep = np.isfinite(vectors).all(1)
        order = np.argsort(ids[keep], kind="stable")  # ids ascend, so the place of a row settles ties
        ids, v = ids[keep][order], vectors[keep][order]
        if len(ids) and (ids[1:] != ids[:-1]).all():
            _, group = np.unique(v.view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel(), return_inverse=True)
            by = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.diff(group[by], prepend=-1))
            copy = np.empty(len(by), np.int64)
            copy[by] = np.arange(len(by)) - np.repeat(starts, np.diff(starts, append=len(by)))
            ids, v = ids[copy <= k], v[copy <= k]
        self.ids, self.v, self.k, self.metric = ids, v, k, metric
        self.centre = np.median(v, axis=0) if len(v) and metric != "cosine" else np.zeros(v.shape[1])  # a far row doesn't move it
        self.error = 8 * (v.shape[1] + 8) * np.finfo(float).eps
        squares = ((v - self.centre) ** 2).sum(1)
        squares[np.isinf(squares)] = np.nan  # overflowed: no product says anything, all are measured
        lower = np.column_stack([-v, -self.error * squares] if metric == "cosine" else [-2 * (v - self.centre), (1 - self.error) * squares])
        self.tiles = [(s, np.ascontiguousarray(lower[s : s + width].T)) for s in range(0, len(v), width)]
        self.gap = 2 * self.error * squares  # from the lower to the upper bound

    @staticmethod
    def _scaled(x: np.ndarray, metric: str) -> np.ndarray:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x
        return x + 0.0  # no negative zeros, which would tell equal vectors apart

    def _measured(self, x: np.ndarray, r: np.ndarray, c: np.ndarray, step: int = 16_384) -> np.ndarray:
        cut = [(r[a : a + step], c[a : a + step]) for a in range(0, len(r), step)]
        one = (lambda i, j: 1 - (x[i] * self.v[j]).sum(1)) if self.metric == "cosine" else (lambda i, j: np.sqrt(((self.v[j] - x[i]) ** 2).sum(1)))
        return np.concatenate([one(i, j) for i, j in cut]) if cut else np.empty(0)

    @np.errstate(over="ignore", invalid="ignore")
    def nearest(self, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        """(query, neighbour, distance) of the k nearest other rows of each query."""
        x = self._scaled(x, self.metric)
        keep = np.isfinite(x).all(1)
        ids, x = ids[keep], x[keep]
        lefts = np.column_stack([x - self.centre, np.ones(len(x))])
        slack = 2 * self.error * (lefts[:, :-1] ** 2).sum(1) + 1e-300
        first = np.searchsorted(self.ids, ids)
        same = np.searchsorted(self.ids, ids, side="right") - first  # rows of the query's own id
        own_row, own = np.repeat(np.arange(len(ids)), same), np.repeat(first - np.cumsum(same) + same, same) + np.arange(same.sum())
        lowest, most, found, room = None, None, [], np.empty((len(ids), self.tiles[0][1].shape[1] if self.tiles else 0))
        for start, tile in self.tiles:
            n = tile.shape[1]
            product = np.matmul(lefts, tile, out=room if n == room.shape[1] else None)
            here = (own >= start) & (own < start + n)
            product[own_row[here], own[here] - start] = np.inf
            if lowest is None:
                lowest = _lowest(product + self.gap[:n], self.k)
                most = lowest.max(1) + slack
            hit = np.flatnonzero(~(product > most[:, None]))  # also what overflowed
            r, c = np.divmod(hit, n)
            value = product.ravel()[hit]
            found.append((r, c + start, value))
            if start and len(hit):
                each = np.bincount(r, minlength=len(ids))
                more = np.full((len(ids), self.k + each.max()), np.inf)
                more[:, : self.k] = lowest
                more[r, self.k + np.arange(len(r)) - (np.cumsum(each) - each)[r]] = value + self.gap[c + start]
                lowest = _lowest(more, self.k)
                most = lowest.max(1) + slack
        r, c, value = (np.concatenate(part) for part in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        near = (self.ids[c] != ids[r]) & ~(value > most[r]) if found else np.empty(0, bool)
        r, c = r[near], c[near]
        d = self._measured(x, r, c)
        order = np.lexsort((c, d, r))
        r, c, d = r[order], c[order], d[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        take = (place < self.k) & np.isfinite(d)
        return pa.RecordBatch.from_arrays([pa.array(ids[r[take]]), pa.array(self.ids[c[take]]), pa.array(d[take])], ["query", "neighbour", "distance"])


def _solve(k: int, metric: str, step: int = 256):
    """Rows (block, is_base, id, v) sorted by block, base rows first: base vectors are held, queries stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, vectors, base = None, [], [], None
        for batch in batches:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            is_base = batch.column(1).to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (is_base[1:] != is_base[:-1])) + 1
            for s, e in zip([0, *edges], [*edges, len(blocks)], strict=True):
                if s == e:
                    continue
                if blocks[s] != block:
                    block, ids, vectors, base = blocks[s], [], [], None
                if is_base[s]:
                    part = batch.slice(s, e - s)
                    ids.append(part.column(2).to_numpy(zero_copy_only=False))
                    vectors.append(_rows(part.column(3)))
                    continue
                if base is None and ids:
                    base, ids, vectors = _Block(np.concatenate(ids), np.vstack(vectors), k, metric), [], []
                for a in range(s, e if base else s, step):
                    part = batch.slice(a, min(step, e - a))
                    yield base.nearest(part.column(2).to_numpy(zero_copy_only=False), _rows(part.column(3)))

    return run


def nearest(queries: DataFrame, base: DataFrame, id_col: str, vector: str, k: int, metric: str = "euclidean", base_block: int | None = None) -> DataFrame:
    """(query, neighbour, distance, rank) of the k nearest other base rows, ties by id: exact, in blocks.

    The base is dealt into blocks of about ``base_block`` rows (16 MB of doubles, if not given) and the queries into groups,
    of a block's size or smaller while there are fewer tasks than three for each core. A task holds one block and streams one
    group past it, so its memory is bounded by the block; what it returns are its k best for each query, which are ranked over
    all blocks. All pairs meet in a matrix product: the work grows with queries times base. Rows without a vector take no part.
    """
    base, queries = base.filter(F.col(vector).isNotNull()), queries.filter(F.col(vector).isNotNull())
    n_base, size = base.agg(F.count("*"), F.max(F.size(vector))).first()
    n_queries = queries.count()
    base_block = base_block or max(1_024, (1 << 21) // max(1, size or 1))
    n_blocks = max(1, -(-n_base // base_block))
    tasks = 3 * base.sparkSession.sparkContext.defaultParallelism
    n_groups = max(1, -(-n_queries // base_block), min(-(-tasks // n_blocks), n_queries // 1_024))

    def dealt(df: DataFrame, parts: int, seed: int, each: int, is_base: bool) -> DataFrame:
        own, other = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(parts)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(each - 1)))
        rows = df.select(own.alias("own"), other.alias("other"), F.lit(is_base).alias("is_base"), F.col(id_col).alias("id"), F.col(vector).alias("v"))
        return rows.select(F.expr(f"own * {n_groups} + other" if is_base else f"other * {n_groups} + own").alias("block"), "is_base", "id", "v")

    kind = dict(queries.dtypes)[id_col]
    met = dealt(base, n_blocks, 0, n_groups, True).unionByName(dealt(queries, n_groups, 1, n_blocks, False))
    met = met.repartitionById(n_blocks * n_groups, "block").sortWithinPartitions("block", F.col("is_base").desc())
    best = met.mapInArrow(_solve(k, metric), f"query {kind}, neighbour {kind}, distance double")
    last = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    return best.withColumn("rank", last).filter(F.col("rank") <= k)
