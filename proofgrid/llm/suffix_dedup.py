"""Exact removal of repeated byte strings, by hash-compared suffix sorting of synchronised suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the same text or
another one. Every window of that length holds an anchor: the place of the least hash of its ``gram``-byte
strings, which depends on the window's bytes alone. So two equal windows hold equal anchors at equal
offsets, and only suffixes at anchors (about 1 in 85 bytes) need to meet:

1. ``anchors``: rows of an anchor's hash and a digest of its surroundings (the bytes that windows with it can
   hold); hashes that occur once are dropped after a count with partial sums. Where hash and digest (128 bits
   together) agree, all surroundings are covered whole, and one of them stands for the others. These bytes are not
   compared again: digests of 128 bits are taken for the bytes.
2. Texts send the bytes around their other anchors whose hash has surroundings of several kinds.
3. Surroundings that share an anchor are suffix-sorted rightwards and leftwards from it: prefix polynomial
   hashes and binary search give common extensions, so a comparison in the mergesort takes a logarithmic
   number of steps. Extensions between neighbours are verified byte by byte; if a hash collided, the group
   is sorted by its bytes instead. Classes of equal windows follow from the two orders.

An anchor whose hash more than ``hot`` places share is split first: into one row for every ``STEP`` window
starts, keyed by a hash of the bytes that those windows have in common (all but STEP - 1 of ``length``).

A null text is empty, with no spans; texts shorter than ``length`` are kept whole. Repeated rows are texts
of their own (they cover each other); the id may be null or repeated; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import bounded, chunks, columns, cut, shared_join
from proofgrid.llm.kernels import U, mixed, prefix_hash, span_hash

STEP = 8
#: A text beyond this many bytes is searched for anchors in pieces.
PIECE = 8 << 20
#: Bits of a place in a buffer, which holds fewer than 2 * PIECE + 1,000 bytes.
PLACE_BITS = U(25)


def _slide_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row."""
    n = len(v)
    rows = -(-n // w)
    pad = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = v
    block = pad.reshape(rows, w)
    left = np.minimum.accumulate(block, axis=1).ravel()
    right = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(texts: list[bytes | None], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, place in the text, hash) of every anchor, in order."""
    whos, places, hashes = [], [], []
    pieces: list[tuple[int, int, bytes]] = []

    def search() -> None:
        if not pieces:
            return
        buf = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
        ends = np.cumsum([len(p[2]) for p in pieces])
        begins = ends - [len(p[2]) for p in pieces]
        prefix = prefix_hash(buf)
        at = np.arange(len(buf) - gram + 1)
        h = mixed(span_hash(prefix, at, at + gram))
        # ties of the leading bits go by place: as many bits for every buffer, so that equal windows choose alike
        low = (U(1) << PLACE_BITS) - U(1)
        least = _slide_min((h & ~low) | at.astype(np.uint64), length - gram + 1)
        keep = np.zeros(len(buf), bool)
        for b, e in zip(begins, ends, strict=True):
            keep[(least[b : e - length + 1] & low).astype(np.int64)] = True
        found = np.flatnonzero(keep)
        piece = np.searchsorted(ends, found, side="right")
        whos.append(np.array([p[0] for p in pieces])[piece])
        places.append(found - begins[piece] + np.array([p[1] for p in pieces])[piece])
        hashes.append(h[found])
        pieces.clear()

    size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        for s in range(0, n - length + 1, PIECE):
            part = t[s : s + PIECE + length - 1]
            pieces.append((i, s, part))
            size += len(part)
            if size >= PIECE:
                search()
                size = 0
    search()
    if not whos:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    who, place, h = np.concatenate(whos), np.concatenate(places), np.concatenate(hashes)
    new = np.ones(len(who), bool)  # an anchor in the overlap of two pieces is found twice
    new[1:] = (who[1:] != who[:-1]) | (place[1:] != place[:-1])
    return who[new], place[new], h[new]


def around(t: bytes, place: int, length: int, gram: int) -> tuple[int, int]:
    """The bytes that any window with the anchor at ``place`` can hold."""
    return max(0, place + gram - length), min(len(t), place + length)


def digest(part: bytes) -> int:
    return int.from_bytes(blake2b(part, digest_size=8).digest(), "little", signed=True)


def _send_anchors(length: int, gram: int):
    """Rows (h, d, k1, k2, n): a hash of an anchor, a digest of its surroundings, and how often the text has both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            who, place, h = anchors(texts, length, gram)
            if not len(who):
                continue
            spans = [around(texts[i], a, length, gram) for i, a in zip(who.tolist(), place.tolist(), strict=True)]
            d = [digest(texts[i][s:e]) for i, (s, e) in zip(who.tolist(), spans, strict=True)]
            # anchors near both ends of a short text can have the same surroundings: these are one
            times = Counter((i, x, y) for i, x, y, _ in {(i, x, y, s) for i, x, y, (s, _) in zip(who.tolist(), h.view(np.int64).tolist(), d, spans, strict=True)})
            i, x, y = (np.array(c, np.int64) for c in zip(*times, strict=True))
            ids = [columns(rows, k).to_numpy(zero_copy_only=False)[i] for k in ("k1", "k2")]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (x, y, *ids, np.array(list(times.values()), np.int32)))], ["h", "d", "k1", "k2", "n"])

    return run


def _send_surroundings(length: int, gram: int):
    """Rows (key, around, off, k1, k2, start, known): the bytes around each wanted anchor; known: already covered.

    A row without ``around`` is a span that needs no more work: ``start`` to ``off``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            wanted = columns(rows, "wanted").to_pylist()
            k1, k2 = (columns(rows, k).to_pylist() for k in ("k1", "k2"))
            who, place, h = anchors([t if w else None for t, w in zip(texts, wanted, strict=True)], length, gram)
            h = h.view(np.int64).tolist()
            place = place.tolist()
            seen: dict[tuple[int, bytes], list] = {}
            bounds = np.searchsorted(who, np.arange(len(texts) + 1)).tolist()
            spans: list[tuple] = []
            sent: set[tuple[int, int, int, int]] = set()

            def add(key: int, i: int, start: int, end: int, off: int, known: bool, seen=seen, spans=spans, sent=sent, texts=texts, k1=k1, k2=k2) -> None:
                if (own := (key, i, start, end)) in sent:  # another anchor of the text, with the same hash, near its ends or a STEP away
                    return
                sent.add(own)
                part = texts[i][start:end]
                if (old := seen.get((key, part))) is None:
                    seen[key, part] = [off, k1[i], k2[i], start, known]
                    return
                if not old[4]:
                    old[4] = True
                    spans.append((old[1], old[2], old[3], old[3] + len(part)))
                if not known:
                    spans.append((k1[i], k2[i], start, end))

            for i, want in enumerate(wanted):
                if not want:
                    continue
                modes: dict[int, dict[int, dict]] = {}
                for w in want:
                    modes.setdefault(w["h"], {})[w["d"]] = w
                t = texts[i]
                whole: list[list[int]] = []
                for x in range(bounds[i], bounds[i + 1]):
                    own = modes.get(h[x])
                    if own is None:
                        continue
                    a = place[x]
                    s, e = around(t, a, length, gram)
                    mode = own.get(digest(t[s:e]))
                    if mode is None:
                        continue
                    if mode["known"]:
                        if whole and s <= whole[-1][1]:
                            whole[-1][1] = max(e, whole[-1][1])
                        else:
                            whole.append([s, e])
                    if mode["send"] and not mode["hot"]:
                        add(h[x], i, s, e, a - s, mode["known"])
                    elif mode["send"]:
                        for back in range(0, length - gram + 1, STEP):
                            s, e = a - back, a - back + length - STEP + 1
                            if s >= 0 and e <= len(t):
                                part = np.frombuffer(t[s:e], np.uint8)
                                key = int(mixed(prefix_hash(part)[-1:] ^ U(h[x] & 0xFFFFFFFFFFFFFFFF)).view(np.int64)[0])
                                first = max(0, s - STEP + 1)
                                if (last := min(len(t), s + length)) - first >= length:
                                    add(key, i, first, last, s - first, mode["known"])
                spans.extend((k1[i], k2[i], s, e) for s, e in whole)
            made = [(key, part, *rest) for (key, part), rest in seen.items() if len(part) >= length]
            made += [(0, None, e, a, b, s, True) for a, b, s, e in spans]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*made, strict=True), (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()), strict=True)], ["key", "around", "off", "k1", "k2", "start", "known"])

    return run


def extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Lengths of the common extensions of suffixes a and b, at most ``most``, by binary search over hashes."""
    got = np.zeros(len(a), np.int64)
    step = 1 << (int(most.max()).bit_length() - 1) if len(most) and most.max() > 0 else 0
    while step:
        at = np.flatnonzero(got + step <= most)
        x, y = a[at] + got[at], b[at] + got[at]
        same = span_hash(prefix, x, x + step) == span_hash(prefix, y, y + step)
        got[at[same]] += step
        step >>= 1
    return got


def suffix_order(buf: np.ndarray, prefix: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mergesort of the suffixes of each group, all groups at once.

    Suffix i is buf[start[i] : start[i] + size[i]]; group g has suffixes first[g] to first[g + 1]. Returns the
    order and, at each place of it, the extension in common with the place before (-1 at a group's start).
    """
    n = len(start)
    count = np.diff(first)
    base = np.repeat(first[:-1], count)
    total = np.repeat(count, count)
    order = np.arange(n)
    run = 1
    while run < (count.max() if len(count) else 0):
        at = np.flatnonzero(total > run)
        place = at - base[at]
        mine = place // run
        other = (mine ^ 1) * run
        lo = np.minimum(other, total[at]) + base[at]
        end = np.minimum(other + run, total[at]) + base[at]
        begin, hi, item = lo.copy(), end.copy(), order[at]
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            x, y = item[open_], order[mid]
            most = np.minimum(size[x], size[y])
            e = extension(prefix, start[x], start[y], most)
            last = len(buf) - 1
            bx = np.where(e < size[x], buf[np.minimum(start[x] + e, last)].astype(np.int16), -1)
            by = np.where(e < size[y], buf[np.minimum(start[y] + e, last)].astype(np.int16), -1)
            after = (by < bx) | ((by == bx) & (mine[open_] % 2 == 1))  # equal ones of the left run go first
            lo[open_[after]] = mid[after] + 1
            hi[open_[~after]] = mid[~after]
        to = base[at] + np.minimum(mine, mine ^ 1) * run + (place - mine * run) + (lo - begin)
        fresh = order.copy()
        fresh[to] = item
        order = fresh
        run *= 2
    common = np.full(n, -1, np.int64)
    at = np.flatnonzero(np.arange(n) != base)
    x, y = order[at], order[at - 1]
    common[at] = extension(prefix, start[x], start[y], np.minimum(size[x], size[y]))
    return order, common


def _differs(buf: np.ndarray, order: np.ndarray, common: np.ndarray, start: np.ndarray) -> bool:
    """Whether bytes contradict a common extension: a hash collision."""
    at = np.flatnonzero(common > 0)
    for k in range(int(common.max()) if len(at) else 0):
        at = at[common[at] > k]
        if (buf[start[order[at]] + k] != buf[start[order[at - 1]] + k]).any():
            return True
    return False


def _by_bytes(buf: np.ndarray, start: np.ndarray, size: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same order and extensions from the bytes themselves, for groups with a hash collision."""
    own = [buf[s : s + n].tobytes() for s, n in zip(start, size, strict=True)]
    order, common = [], []
    for s, e in zip(first[:-1], first[1:], strict=True):
        ranked = sorted(range(s, e), key=own.__getitem__)
        for k, i in enumerate(ranked):
            order.append(i)
            common.append(next((m for m, (x, y) in enumerate(zip(own[i], own[ranked[k - 1]], strict=False)) if x != y), min(len(own[i]), len(own[ranked[k - 1]]))) if k else -1)
    return np.array(order, np.int64), np.array(common, np.int64)


def covered(arounds: list[bytes], offs: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of the distinct surroundings of each group: the span [from, to) of its bytes that windows which
    another one of the group has too cover (from = to: none). All such windows hold the anchor, so it is one span."""
    size = np.array([len(a) for a in arounds], np.int64)
    end = np.cumsum(size)
    begin = end - size
    buf = np.frombuffer(b"".join(arounds), np.uint8)
    back = buf[::-1]
    start = begin + offs
    left_start, left_size = len(buf) - start, offs.astype(np.int64)
    n, count = len(arounds), np.diff(first)
    group = np.repeat(np.arange(len(count)), count)
    classes = []
    for b, s, z in ((buf, start, size - offs), (np.ascontiguousarray(back), left_start, left_size)):
        prefix = prefix_hash(b)
        order, common = suffix_order(b, prefix, s, z, first)
        if _differs(b, order, common, s):
            order, common = _by_bytes(b, s, z, first)
        near = np.append(common[1:], -1)
        best = np.empty(n, np.int64)
        best[order] = np.maximum(common, near)
        classes.append((order, common, best))
    (r_order, r_common, r_best), (l_order, l_common, l_best) = classes
    least, most = np.full(n, length, np.int64), np.full(n, -1, np.int64)
    live = l_best + r_best >= length
    two = np.flatnonzero(live & (count[group] == 2))
    least[two], most[two] = length - r_best[two], l_best[two]
    rest = np.unique(group[live & (count[group] > 2)])
    if len(rest):
        at = np.flatnonzero(np.isin(group, rest))
        for back_by in range(int((length - r_best[at]).clip(0).min()), int(l_best[at].max()) + 1):
            # equal windows that start back_by bytes before the anchor: equal right and left classes
            right, left = np.empty(n, np.int64), np.empty(n, np.int64)
            right[r_order] = np.cumsum(r_common < length - back_by)
            left[l_order] = np.cumsum(l_common < back_by)
            own = at[(l_best[at] >= back_by) & (r_best[at] >= length - back_by)]
            pair = right[own] * (n + 1) + left[own]
            _, same, times = np.unique(pair, return_inverse=True, return_counts=True)
            hit = own[times[same] > 1]
            least[hit] = np.minimum(least[hit], back_by)
            most[hit] = np.maximum(most[hit], back_by)
    some = most >= least
    return np.where(some, offs - most, 0), np.where(some, offs - least + length, 0)


def _resolve(length: int, batch_bytes: int = 2 << 20):
    """Spans (k1, k2, start, stop) from surroundings that are sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: dict[bytes, list[tuple]] = {}
        ready: list[tuple[list[bytes], list[list[tuple]]]] = []
        key_now, size = None, 0

        def close() -> None:
            """The current key's surroundings: copies are covered as they are, distinct ones wait for the sort."""
            nonlocal size
            for around, rows in held.items():
                if len(rows) > 1:
                    out.extend((k1, k2, s, s + len(around)) for _, k1, k2, s, known in rows if not known)
            if len(held) > 1:
                ready.append((list(held), list(held.values())))
                size += sum(map(len, held))
            held.clear()

        def work() -> None:
            nonlocal size
            if ready:
                arounds = [a for g, _ in ready for a in g]
                rows = [r for _, g in ready for r in g]
                first = np.append(0, np.cumsum([len(g) for g, _ in ready]))
                lo, hi = covered(arounds, np.array([r[0][0] for r in rows], np.int64), first, length)
                for k in np.flatnonzero(hi > lo):
                    if len(rows[k]) == 1 and not rows[k][0][4]:
                        _, k1, k2, s, _ = rows[k][0]
                        out.append((k1, k2, s + int(lo[k]), s + int(hi[k])))
            ready.clear()
            size = 0

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["k1", "k2", "start", "stop"])
            out.clear()
            return rows

        for batch in batches:
            for key, around, *row in zip(*(columns(batch, c).to_pylist() for c in ("key", "around", "off", "k1", "k2", "start", "known")), strict=True):
                if around is None:
                    out.append((row[1], row[2], row[3], row[0]))
                    continue
                if key != key_now:
                    close()
                    if size >= batch_bytes:
                        work()
                    key_now = key
                held.setdefault(around, []).append(tuple(row))
            if len(out) > 50_000:
                yield flush()
        close()
        work()
        yield flush()

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the spans of each text and take them out."""
    for rows, texts in chunks(batches):
        starts, stops, kept = [], [], []
        for t, spans in zip(texts, columns(rows, "spans").to_pylist(), strict=True):
            t, s0, e0 = t or b"", [], []
            for s, e in sorted((x["start"], x["stop"]) for x in spans or ()):
                if e0 and s <= e0[-1]:
                    e0[-1] = max(e, e0[-1])
                else:
                    s0.append(s)
                    e0.append(e)
            starts.append(s0)
            stops.append(e0)
            kept.append(b"".join(t[a:b] for a, b in zip([0, *e0], [*s0, len(t)], strict=True)))
        yield pa.RecordBatch.from_arrays([columns(rows, "doc_id"), pa.array([len(t) if t else 0 for t in texts], pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(stops, pa.list_(pa.int32())), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "starts", "stops", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 32, hot: int = 20_000) -> DataFrame:
    """(doc_id, n_bytes, starts, stops, kept): the removed runs of each text and the bytes that stay (binary,
    as a run may end inside a character). See the module for the method and for odd inputs."""
    bounded(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("k1"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("k2"))
    found = cut(texts.select("text", "k1", "k2").mapInArrow(_send_anchors(length, gram), "h long, d long, k1 long, k2 long, n int"), "anchors")
    # counts by hash, then by hash and digest, all with partial sums; what many rows share joins by broadcast
    times = found.groupBy("h").agg(F.sum("n").alias("times")).filter("times > 1")
    total = found.agg(F.sum("n")).first()[0] or 0
    live = cut(shared_join(found, cut(times, "times"), ["h"], "times", total).drop("times"), "live")
    kinds = cut(live.groupBy("h", "d").agg(F.sum("n").alias("times"), F.min(F.struct("k1", "k2")).alias("first")), "kinds")
    several = cut(kinds.groupBy("h").agg(F.count("*").alias("kinds")), "several")
    kinds = shared_join(kinds, several, ["h"], "kinds", kinds.count()).filter("times > 1 OR kinds > 1")
    kinds = cut(kinds.select("h", "d", "times", "first", (F.col("kinds") > 1).alias("several"), (F.col("kinds") > hot).alias("hot")), "kinds")
    known = shared_join(live, kinds.filter("times > 1"), ["h", "d"], "times", total)
    known = known.select("k1", "k2", "h", "d", F.lit(True).alias("known"), (F.col("several") & (F.struct("k1", "k2") == F.col("first"))).alias("send"), "hot")
    alone = kinds.filter("times = 1").select("first.k1", "first.k2", "h", "d", F.lit(False).alias("known"), F.lit(True).alias("send"), "hot")
    wanted = known.unionByName(alone).groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "d", "known", "send", "hot")).alias("wanted"))
    # doc_id goes along unused, so that both joins of the texts read one exchange
    around = texts.join(wanted, ["k1", "k2"], "left").select("doc_id", "text", "k1", "k2", "wanted").mapInArrow(_send_surroundings(length, gram), "key long, around binary, off int, k1 long, k2 long, start int, known boolean")
    # a span has no key of its own: any partition will do
    dealt = around.withColumn("key", F.when(F.col("around").isNull(), F.xxhash64("k1", "k2", "start")).otherwise(F.col("key")))
    spans = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_resolve(length), "k1 long, k2 long, start int, stop int")
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return texts.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(_apply, f"doc_id {dict(docs.dtypes)[id_col]}, n_bytes long, starts array<int>, stops array<int>, kept binary")
