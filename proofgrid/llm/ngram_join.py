"""Exact Jaccard similarity join on word n-grams: rare-first prefix filtering, verified once per pair.

Steps, with what each moves:

1. ``profile``: one pass over the texts gives each document's set size, a 128-bit digest and a signature of its set (one
   or two bits a shingle), and a count sketch of all shingles (fixed size, merged on the executors). Equal sets are one
   class from here on.
2. ``postings``: a second pass orders each set rare-first by the sketch and emits the prefix that any
   partner must meet: the inverted lists of the join, one posting a class and prefix shingle.
3. ``candidates``: lists stream through a task, sorted by size. A list of at most ``pairwise`` classes gives its
   pairs that pass the length and positional filters. A longer one gives stars first: of every ``star`` classes the
   one with the least place (the most typical) is paired with the others, and with the next star's.
4. ``verified``: pairs are made distinct and get both signatures, whose bits that differ are a lower bound on the sets'
   difference; this drops nearly all pairs that don't link, and no other. Only classes of the rest have their texts read
   again. These pairs get both sets by joins, and pass the suffix filter and the count of common shingles; each pair
   once. Links make components.
5. In longer lists whose classes lie in several components, each class is paired with a few others of its list in an
   order by hash, if these are in other components. These pairs are verified and their links join components: in a
   group of near copies nearly any pair links, so that few components remain.
6. Longer lists whose classes lie in several components still give all their pairs that pass the filters and run
   across components, dealt out by ``block`` classes, less those that the first ``PARITY`` bits of their signatures tell
   apart, and these are verified too. Pairs inside a component need no look. What remains unlinked is unlinked by a verified pair or a filter, so components are exact.

Nothing about single documents reaches the driver, no task holds a list or a component, and a set is sent once
for each pair that signatures leave. `similar_pairs` gives every link between classes instead, and `link_counts` how many a document has.

Null or empty texts and texts of white space have an empty set, size 0 and themselves as component. Repeated rows
are copies of each other; rows that share an id but not a text are told apart by their texts. Columns other than
the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.llm.common import bounded, chunks, columns, cut, row_of
from proofgrid.llm.kernels import U, mixed, shingle_sets
from proofgrid.operators.components import connected_components

SKETCH_BITS = 20
SKETCH_BLOCKS = 64
#: Bits of a set's parities.
PARITY = 512
#: Stands for a null id where rows are matched by id.
NO_ID = -(1 << 63)
#: Bits of the filter that says which texts aren't read again, in rows of 2^15.
WANTED_BITS = 24


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes, as two signed integers."""
    a = np.add.reduce(mixed(s ^ U(0x5851F42D4C957F2D)))
    b = np.add.reduce(mixed(s + U(0x14057B7EF767814F)) ^ s)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def least_overlap(size: np.ndarray | int, percent: int):
    """Fewest elements that a set of this size shares with any partner."""
    return -(-percent * size // 100)


def parities(s: np.ndarray) -> bytes:
    """For each of PARITY ranges of hashes, whether the set has an odd number of elements there."""
    return np.packbits(np.bincount((mixed(s) >> U(55)).astype(np.int64), minlength=PARITY) & 1).tobytes()


def signature(s: np.ndarray) -> bytes:
    """The parities, and those of finer ranges for a set of more than PARITY elements: one range for each element at least."""
    bits = 1 << max(0, len(s) - 1).bit_length()
    fine = np.packbits(np.bincount((mixed(s) & U(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes() if bits > PARITY else b""
    return parities(s) + fine


def signatures_apart(a: bytes, b: bytes) -> int:
    """Lower bound of the Hamming distance of two sets from their signatures: where one set has an odd number of elements in
    a range and the other an even one, they differ in an element at least."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    short = PARITY // 64
    if min(len(x), len(y)) == short:
        return int(np.bitwise_count(x[:short] ^ y[:short]).sum())
    x, y = x[short:], y[short:]
    if len(x) > len(y):
        x, y = y, x
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), 0)).sum())


def _profile(id_col: str, text_col: str, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for rows, texts in chunks(batches, text_col):
            sets = shingle_sets(texts, n)
            for s in sets:
                counts[(s >> U(64 - SKETCH_BITS)).astype(np.int64)] += U(1).astype(np.uint32)
            digests = [set_digest(s) for s in sets]
            size = len(sets)
            yield pa.RecordBatch.from_arrays(
                [columns(rows, id_col).cast(pa.int64()), columns(rows, "text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()), pa.array([signature(s) for s in sets], pa.binary()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "node", "check", "sign", "block", "counts"],
            )
        if counts.any():
            blocks = counts.reshape(SKETCH_BLOCKS, -1)
            nulls = pa.nulls(SKETCH_BLOCKS, pa.int64())
            yield pa.RecordBatch.from_arrays([nulls, nulls, nulls, nulls, nulls, pa.nulls(SKETCH_BLOCKS, pa.binary()), pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], ["doc_id", "text_key", "n_shingles", "node", "check", "sign", "block", "counts"])

    return run


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, c in zip(columns(batch, "block").to_pylist(), columns(batch, "counts").to_pylist(), strict=True):
            c = np.frombuffer(c, np.uint32).astype(np.uint64)
            total[k] = total[k] + c if k in total else c
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.minimum(c, U(0xFFFFFFFF)).astype(np.uint32).tobytes() for c in total.values()], pa.binary())], ["block", "counts"])


def sketch_of(blocks: DataFrame) -> np.ndarray:
    """The merged sketch, 4 MB whatever the corpus: partial sums by task first, then by block."""
    merged = blocks.select("block", "counts").repartition(SKETCH_BLOCKS, "block").mapInArrow(_merge_blocks, "block int, counts binary")
    out = np.zeros((SKETCH_BLOCKS, (1 << SKETCH_BITS) // SKETCH_BLOCKS), np.uint32)
    for r in merged.collect():
        out[r.block] = np.frombuffer(r.counts, np.uint32)
    return out.ravel()


def _postings(sketch, text_col: str, n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        sent: set[int] = set()
        for _, texts in chunks(batches, text_col):
            hashes, nodes, sizes, places = [], [], [], []
            for s in shingle_sets(texts, n):
                if not len(s) or (node := set_digest(s)[0]) in sent:
                    continue
                if len(sent) < 1_000_000:
                    sent.add(node)
                prefix = len(s) - least_overlap(len(s), percent) + 1
                order = np.argsort(counts[(s >> U(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")[:prefix]
                hashes.append(s[order])
                nodes.append(np.full(prefix, node, np.int64))
                sizes.append(np.full(prefix, len(s), np.int32))
                places.append(np.arange(prefix, dtype=np.int32))
            if hashes:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (nodes, sizes, places))], ["h", "node", "size", "place"])

    return run


def _passes(percent: int, sx, px, sy, py):
    """The length filter, and what the rest after a first common shingle at these places can still hold."""
    sx, sy = sx.astype(np.int64), sy.astype(np.int64)
    need = -(-percent * (sx + sy) // (100 + percent))
    return (100 * np.minimum(sx, sy) >= percent * np.maximum(sx, sy)) & (np.minimum(sx - px, sy - py) >= need)


def _few_pairs(percent: int, most: int, h, node, size, place, many):
    """Pairs of the lists of at most ``most`` rows; ``many``: rows of each row's list."""
    us, vs = [], []
    at = np.flatnonzero((many > 1) & (many <= most))
    d = 1
    while len(at):
        at = at[at + d < len(h)]
        at = at[h[at] == h[at + d]]
        ok = at[_passes(percent, size[at], place[at], size[at + d], place[at + d])]
        us.append(node[ok])
        vs.append(node[ok + d])
        d += 1
    return us, vs


def _stars(percent: int, star: int, h, node, size, place):
    """Pairs of each row with the row of least place among ``star`` in a row of its list, and of these with the next."""
    if not len(h):
        return [], [], 0
    at = np.arange(len(h))
    begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    inside = at - np.repeat(begin, np.diff(np.append(begin, len(h))))
    first = np.flatnonzero(inside % star == 0)
    centre = (np.minimum.reduceat((place.astype(np.int64) << 32) | at, first) & 0xFFFFFFFF).astype(np.int64)
    mine = np.repeat(centre, np.diff(np.append(first, len(h))))
    next_ = np.flatnonzero(h[centre[1:]] == h[centre[:-1]])
    x, y = np.concatenate([mine, centre[next_]]), np.concatenate([at, centre[next_ + 1]])
    ok = (x != y) & _passes(percent, size[x], place[x], size[y], place[y])
    return [node[x[ok]]], [node[y[ok]]], int(centre[-1])


def _pair_columns(us: list[np.ndarray], vs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, v = np.concatenate(us), np.concatenate(vs)
    uv = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
    uv = uv[uv[:, 0] != uv[:, 1]]
    return uv[:, 0], uv[:, 1]


def _candidates(percent: int, pairwise: int, star: int, held_most: int = 50_000):
    """Rows (u, v, h, size, place) of postings that are sorted by (h, size, node): pairs, and with v null the postings of
    lists of more than ``pairwise`` rows. A list may span batches; one of more than ``held_most`` rows goes in parts, each
    in stars, with the last star's centre as the first row of the next part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = parted = None

        def take(h, node, size, place) -> pa.RecordBatch:
            new = np.ones(len(h), bool)  # tasks may have sent the same class
            new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
            h, node, size, place = h[new], node[new], size[new], place[new]
            begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            count = np.diff(np.append(begin, len(h)))
            many = np.repeat(count, count)
            if parted is not None:  # the tail of a parted list, however short
                many[h == parted] = pairwise + 1
            us, vs = _few_pairs(percent, pairwise, h, node, size, place, many)
            hot = np.flatnonzero(many > pairwise)
            more_u, more_v, _ = _stars(percent, star, h[hot], node[hot], size[hot], place[hot])
            u, v = _pair_columns([*us, *more_u, np.zeros(0, np.int64)], [*vs, *more_v, np.zeros(0, np.int64)])
            blank = pa.nulls(len(u), pa.int64())
            short = pa.nulls(len(u), pa.int32())
            out = [[pa.array(u, pa.int64()), pa.array(node[hot], pa.int64())], [pa.array(v, pa.int64()), pa.nulls(len(hot), pa.int64())], [blank, pa.array(h[hot], pa.int64())], [short, pa.array(size[hot], pa.int32())], [short, pa.array(place[hot], pa.int32())]]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in out], ["u", "v", "h", "size", "place"])

        for batch in batches:
            now = [columns(batch, k).to_numpy(zero_copy_only=False) for k in ("h", "node", "size", "place")]
            if held is not None:
                now = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            last = int(np.searchsorted(now[0], now[0][-1]))
            if len(now[0]) - last > max(4 * pairwise, held_most):
                own = [x[last:] for x in now]
                parted_before, parted = parted, now[0][-1]
                if last:
                    parted, mark = parted_before, parted
                    yield take(*(x[:last] for x in now))
                    parted = mark
                yield take(*own)
                centre = _stars(percent, star, *own)[2]
                held = [x[centre : centre + 1] for x in own]
            else:
                if last:
                    yield take(*(x[:last] for x in now))
                held = [x[last:] for x in now]
        if held is not None:
            yield take(*held)

    return run


def _nearby(percent: int, reach: int = 4):
    """Pairs (u, v) across components of rows (h, node, size, place, component) that follow each other in a list, at most
    ``reach`` rows apart. A batch's border parts pairs, which `_across` gives then if it has to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, node, size, place, component = (columns(batch, k).to_numpy(zero_copy_only=False) for k in ("h", "node", "size", "place", "component"))
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d in range(1, reach + 1):
                at = np.flatnonzero((h[d:] == h[:-d]) & (component[d:] != component[:-d]))
                at = at[_passes(percent, size[at], place[at], size[at + d], place[at + d])]
                us.append(node[at])
                vs.append(node[at + d])
            u, v = _pair_columns(us, vs)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def _across(percent: int):
    """Pairs (u, v) across components from rows (h, block, left, node, size, place, component, odd) that are sorted by
    (h, block, left descending): left rows of a block are held, the list's rows stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, wall = None, [], None
        for batch in batches:
            h, block, left, node, size, place, component = (columns(batch, k).to_numpy(zero_copy_only=False) for k in ("h", "block", "left", "node", "size", "place", "component"))
            edges = np.flatnonzero((h[1:] != h[:-1]) | (block[1:] != block[:-1]) | (left[1:] != left[:-1])) + 1
            us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for s, e in zip([0, *edges], [*edges, len(h)], strict=True):
                if s == e:
                    continue
                if (h[s], block[s]) != key:
                    key, held, wall = (h[s], block[s]), [], None
                odd = np.frombuffer(b"".join(columns(batch, "odd").slice(s, e - s).to_pylist()), np.uint64).reshape(e - s, -1)
                own = (node[s:e], size[s:e], place[s:e], component[s:e], odd)
                if left[s]:
                    held.append(own)
                    continue
                if wall is None:
                    if not held:
                        continue
                    *wall, odds = (np.concatenate(x) for x in zip(*held, strict=True))
                    wall = [x[:, None] for x in wall]
                for a in range(0, e - s, 512):
                    n, z, p, c, o = (x[a : a + 512] for x in own)
                    x, y = np.nonzero((wall[3] != c) & _passes(percent, wall[1], wall[2], z, p))
                    both = wall[1][x, 0].astype(np.int64) + z[y]
                    ok = np.bitwise_count(odds[x] ^ o[y]).sum(1) <= both - 2 * (-(-percent * both // (100 + percent)))
                    x, y = x[ok], y[ok]
                    us.append(wall[0][x, 0])
                    vs.append(n[y])
                    if sum(map(len, us)) > 500_000:
                        u, v = _pair_columns(us, vs)
                        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            u, v = _pair_columns(us, vs)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return run


def suffix_apart(x: np.ndarray, y: np.ndarray, most: int, depth: int = 2) -> int:
    """Lower bound of the Hamming distance of two sorted sets: split y at x's middle and compare sizes, recursively."""
    if not depth or len(x) < 8 or len(y) < 8:
        return abs(len(x) - len(y))
    mid = len(x) // 2
    w = x[mid]
    cut_at = int(np.searchsorted(y, w))
    same = cut_at < len(y) and y[cut_at] == w
    xl, xr, yl, yr = x[:mid], x[mid + 1 :], y[:cut_at], y[cut_at + same :]
    low = abs(len(xl) - len(yl)) + abs(len(xr) - len(yr)) + (not same)
    if low > most:
        return low
    left = suffix_apart(xl, yl, most - abs(len(xr) - len(yr)) - (not same), depth - 1)
    low = left + abs(len(xr) - len(yr)) + (not same)
    if low > most:
        return low
    return left + suffix_apart(xr, yr, most - left - (not same), depth - 1) + (not same)


def _sets(n: int):
    """(vertex, items): the sorted set of each text, as bytes, if it is the one that the row names by node and check."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            sets = shingle_sets(texts, n)
            named = zip(columns(rows, "node").to_pylist(), columns(rows, "check").to_pylist(), strict=True)
            own = [k for k, (s, d) in enumerate(zip(sets, named, strict=True)) if set_digest(s) == d]
            yield pa.RecordBatch.from_arrays([columns(rows, "vertex").take(pa.array(own, pa.int64())), pa.array([sets[k].tobytes() for k in own], pa.binary())], ["vertex", "items"])

    return run


def _alike(percent: int):
    """The pairs (u, v, m, n, a, b), with sizes and signatures, that may link by these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = columns(batch, "m").to_numpy() + columns(batch, "n").to_numpy()
            most = both - 2 * (-(-percent * both // (100 + percent)))
            signs = zip(columns(batch, "a").to_pylist(), columns(batch, "b").to_pylist(), strict=True)
            at = pa.array([k for k, (x, y) in enumerate(signs) if signatures_apart(x, y) <= most[k]], pa.int64())
            yield pa.RecordBatch.from_arrays([columns(batch, "u").take(at), columns(batch, "v").take(at)], ["u", "v"])

    return run


def _verify(percent: int):
    """(u, v, common) of the pairs (u, v, a, b) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, common = [], []
            for k, (x, y) in enumerate(zip(columns(batch, "a"), columns(batch, "b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                need = -(-percent * (len(x) + len(y)) // (100 + percent))
                most = len(x) + len(y) - 2 * need
                if need > len(x) or (len(x) > 64 and suffix_apart(x, y, most) > most):
                    continue
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                same = int(np.count_nonzero(y[at] == x))
                if same >= need:
                    keep.append(k)
                    common.append(same)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([columns(batch, "u").take(at), columns(batch, "v").take(at), pa.array(common, pa.int64())], ["u", "v", "common"])

    return run


class _Join:
    """The tables that the steps of one join share."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, pairwise: int, star: int, block: int):
        self.spark = bounded(docs.sparkSession)
        self.n, self.percent, self.block = n, percent, block
        self.texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        seen = cut(self.texts.withColumn("text_key", F.xxhash64("text")).mapInArrow(_profile("doc_id", "text", n), "doc_id long, text_key long, n_shingles long, node long, check long, sign binary, block int, counts binary"), "profile")
        self.profile = seen.filter("block IS NULL").select("doc_id", "text_key", "n_shingles", "node", "check", "sign")
        sketch = self.spark.sparkContext.broadcast(sketch_of(seen.filter("block IS NOT NULL")))
        # one row for each distinct set, with the row that gives its text
        self.kinds = self._kinds(self.profile, "doc_id", "text_key")
        postings = self.texts.select("text").mapInArrow(_postings(sketch, "text", n, percent), "h long, node long, size int, place int")
        found = postings.repartition("h").sortWithinPartitions("h", "size", "node").mapInArrow(_candidates(percent, pairwise, star), "u long, v long, h long, size int, place int")
        found = cut(found, "candidates")
        self.lists = found.filter("v IS NULL").select("h", F.col("u").alias("node"), "size", "place")
        self.pairs = cut(found.filter("v IS NOT NULL").select("u", "v").distinct(), "pairs")

    @staticmethod
    def _kinds(profile: DataFrame, *names: str) -> DataFrame:
        at = F.struct(F.col("doc_id").isNull().alias("no_id"), *names)
        return profile.filter("n_shingles > 0").groupBy("node", "check", "n_shingles").agg(F.min(at).alias("at"))

    def members(self) -> DataFrame:
        """(vertex, node, check, n_shingles, rep, sign, _id, _text) of the classes that have a pair or are in a longer list.
        Should two sets share 64 bits of their digests, both go under these in the lists, and are told apart here."""
        wanted = self.pairs.select(F.col("u").alias("node")).union(self.pairs.select("v")).union(self.lists.select("node")).distinct()
        kinds = self._kinds(self.profile.join(wanted, "node", "left_semi"), "doc_id", "text_key", "sign")
        own = kinds.select("node", "check", "n_shingles", F.col("at.doc_id").alias("rep"), F.col("at.sign").alias("sign"), F.coalesce("at.doc_id", F.lit(NO_ID)).alias("_id"), F.col("at.text_key").alias("_text"))
        nth = F.row_number().over(Window.partitionBy("node").orderBy("check", "n_shingles"))
        return cut(own.withColumn("vertex", F.when(nth == 1, F.col("node")).otherwise(F.xxhash64("node", "check", "n_shingles"))), "classes")

    def sets(self, pairs: DataFrame, members: DataFrame) -> DataFrame:
        """(vertex, items) of the members in ``pairs``, by their texts. A bitmap of a fixed size (2 MB) over hashes of their ids
        keeps nearly all other texts from being sent."""
        wanted = pairs.select(F.col("u").alias("vertex")).union(pairs.select("v")).distinct()
        own = cut(members.join(wanted, "vertex", "left_semi").select("_id", "_text", "node", "check", "vertex"), "wanted")
        at = F.xxhash64("_id").bitwiseAND((1 << WANTED_BITS) - 1)
        row, bit = F.shiftright(at, 15).alias("row"), at.bitwiseAND((1 << 15) - 1)
        bits = own.select(row, bit.alias("bit")).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits"))
        texts = self.texts.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), "text").withColumns({"row": row, "bit": bit.cast("int")})
        byte = F.conv(F.hex(F.expr("substring(bits, shiftright(bit, 3) + 1, 1)")), 16, 10).cast("int")
        texts = texts.join(F.broadcast(bits), "row").filter(F.call_function("getbit", byte, F.col("bit").bitwiseAND(7)) == 1)
        texts = texts.select("_id", F.xxhash64("text").alias("_text"), "text").join(own, ["_id", "_text"]).dropDuplicates(["_id", "_text", "vertex"])
        return cut(texts.select("node", "check", "vertex", "text").mapInArrow(_sets(self.n), "vertex long, items binary"), "sets")

    def verified(self, pairs: DataFrame, members: DataFrame) -> DataFrame:
        """(u, v, common) by vertices: the pairs whose sets link, each looked at once."""
        x = members.select(F.col("node").alias("u"), F.col("vertex").alias("x"), F.col("n_shingles").alias("m"), F.col("sign").alias("a"))
        y = members.select(F.col("node").alias("v"), F.col("vertex").alias("y"), F.col("n_shingles").alias("n"), F.col("sign").alias("b"))
        both = pairs.join(x.hint("merge"), "u").join(y.hint("merge"), "v").select(F.col("x").alias("u"), F.col("y").alias("v"), "m", "n", "a", "b")
        alike = cut(both.mapInArrow(_alike(self.percent), "u long, v long"), "alike")
        sets = self.sets(alike, members)
        x, y = (sets.select(F.col("vertex").alias(k), F.col("items").alias(name)).hint("merge") for k, name in (("u", "a"), ("v", "b")))
        return alike.join(x, "u").join(y, "v").select("u", "v", "a", "b").mapInArrow(_verify(self.percent), "u long, v long, common long")

    def parted(self, component: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """The longer lists with the component of each class (node, component; without any, each is its own), and of each
        list with several components: its number of rows n, and the largest component top.component with top.n rows."""
        if component is None:
            rows = self.lists.withColumn("component", F.col("node"))
        else:
            rows = self.lists.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
        by = rows.groupBy("h", "component").agg(F.count("*").alias("n"))
        return rows, by.groupBy("h").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("kinds")).filter("kinds > 1")

    def nearby(self, component: DataFrame) -> DataFrame:
        """Pairs of longer lists that run across components, a few for each row."""
        rows, many = self.parted(component)
        rows = rows.join(many.select("h", F.ceil(F.col("n") / self.block).cast("int").alias("blocks")), "h").withColumn("block", F.pmod(F.hash("node"), "blocks"))
        dealt = rows.repartition("h", "block").sortWithinPartitions("h", "block", F.xxhash64("h", "node"))
        return dealt.mapInArrow(_nearby(self.percent), "u long, v long").distinct().join(self.pairs, ["u", "v"], "left_anti")

    def across(self, members: DataFrame, component: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
        """Pairs of longer lists that run across components (node, component) and aren't ``seen`` yet; without any
        components, all pairs that pass the filters."""
        seen = self.pairs if seen is None else self.pairs.union(seen)
        rows, many = self.parted(component)
        many = many.select("h", F.col("top.component").alias("most"), F.ceil((F.col("n") - F.col("top.n")) / self.block).cast("int").alias("blocks"))
        odd = members.filter(F.col("vertex") == F.col("node")).select("node", F.substring("sign", 1, PARITY // 8).alias("odd"))
        rows = rows.join(many, "h").join(odd, "node")
        left = rows.filter("component <> most").select("h", F.pmod(F.hash("node"), "blocks").alias("block"), F.lit(True).alias("left"), "node", "size", "place", "component", "odd")
        right = rows.select("h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("left"), "node", "size", "place", "component", "odd")
        dealt = left.unionByName(right).repartition("h", "block").sortWithinPartitions("h", "block", F.col("left").desc())
        return dealt.mapInArrow(_across(self.percent), "u long, v long").distinct().join(seen, ["u", "v"], "left_anti")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_shingles, component_id): see the module. Options: ``n`` words of a shingle; ``percent``, the least 100 *
    Jaccard of a link; ``pairwise``, ``star`` and ``block``, which decide the work and not the result.

    A null id takes part in links but is never the least id of a component unless all its ids are null.
    """
    return _components(docs, id_col, text_col, **options).drop("text_key")


def _components(docs: DataFrame, id_col: str, text_col: str, n: int = 5, percent: int = 75, pairwise: int = 4, star: int = 256, block: int = 2_048) -> DataFrame:
    """The same, with a hash of the text that tells rows with the same id apart."""
    j = _Join(docs, id_col, text_col, n, percent, pairwise, star, block)
    members = j.members()
    links = cut(j.verified(j.pairs, members), "links")
    labels = cut(connected_components(links, "u", "v"), "labels")
    # lists hold digests, labels vertices: they differ only where two sets share 64 bits, and then nothing is left out
    near = cut(j.nearby(labels), "near")
    close = cut(j.verified(near, members), "close")
    labels = cut(connected_components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).union(close.select("u", "v")), "u", "v"), "labels")
    more = cut(j.across(members, labels, near), "across")
    again = cut(j.verified(more, members), "further")
    own = lambda k: labels.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    bridges = again.join(own("u"), "u", "left").join(own("v"), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    joined = connected_components(bridges, "u", "v").select(F.col("node").alias("component"), F.col("component").alias("whole"))
    linked = members.drop("sign", "_id", "_text").join(labels.withColumnRenamed("node", "vertex"), "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    linked = linked.join(joined, "component", "left").withColumn("component", F.coalesce("whole", "component"))
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "component").select("node", "check", "n_shingles", "least")
    whole = j.kinds.select("node", "check", "n_shingles", F.col("at.doc_id").alias("rep")).join(linked, ["node", "check", "n_shingles"], "left")
    whole = whole.select("node", "check", "n_shingles", F.coalesce("least", "rep").alias("class_id"))
    return (
        j.profile.join(whole, ["node", "check", "n_shingles"], "left")
        .select("doc_id", "text_key", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("class_id")).alias("component_id"))
    )


def _links(docs: DataFrame, id_col: str, text_col: str, n: int = 5, percent: int = 75, pairwise: int = 4, star: int = 256, block: int = 2_048) -> tuple[_Join, DataFrame, DataFrame]:
    j = _Join(docs, id_col, text_col, n, percent, pairwise, star, block)
    members = j.members()
    pairs = cut(j.pairs.union(j.across(members)), "pairs")
    return j, members, cut(j.verified(pairs, members), "links")


def similar_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_a, id_b, n_a, n_b, common): every link between two different sets, each set by the least id that has it. Its
    size, unlike that of the components, can grow with the square of a group of near copies."""
    _, members, links = _links(docs, id_col, text_col, **options)
    a = members.select(F.col("vertex").alias("u"), F.col("rep").alias("id_a"), F.col("n_shingles").alias("n_a"))
    b = members.select(F.col("vertex").alias("v"), F.col("rep").alias("id_b"), F.col("n_shingles").alias("n_b"))
    out = links.join(a, "u").join(b, "v")
    turn = F.col("id_b") < F.col("id_a")
    pick = lambda x, y: F.when(turn, F.col(y)).otherwise(F.col(x))
    return out.select(pick("id_a", "id_b").alias("id_a"), pick("id_b", "id_a").alias("id_b"), pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"), "common")


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_shingles, n_links): the other rows that each row links to, copies included."""
    j, members, links = _links(docs, id_col, text_col, **options)
    size = j.profile.filter("n_shingles > 0").groupBy("node", "check", "n_shingles").agg(F.count("*").alias("copies"))
    sized = members.select("vertex", "node", "check", "n_shingles").join(size, ["node", "check", "n_shingles"])
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    far = both.join(sized.select(F.col("vertex").alias("v"), "copies"), "v").groupBy("u").agg(F.sum("copies").alias("far"))
    far = sized.join(far, F.col("vertex") == F.col("u")).select("node", "check", "n_shingles", "far")
    out = j.profile.join(size, ["node", "check", "n_shingles"], "left").join(far, ["node", "check", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, 0).otherwise(F.col("copies") - 1 + F.coalesce("far", F.lit(0))).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their component. Of rows that share id and text one stays; rows
    without an id stay unless a row with one is linked to them. All columns of ``docs`` go along as they are."""
    comps = _components(docs, id_col, text_col, **options)
    ids = comps.filter("doc_id <=> component_id").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("text_key").alias("_text")).distinct()
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text_col).alias("_text"), row_of(docs).alias("_row"))
    return keyed.join(ids, ["_id", "_text"], "left_semi").dropDuplicates(["_id", "_text"]).select("_row.*")
