"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

A batch's texts (2 MB) are split where no piece can cross; of segments that repeat in the batch one stands for
all, and the batch's segments are concatenated and indexed by a suffix array (sorted as far as the longest piece
reaches). Every piece is
binary-searched for its range of occurrences; the ranges give edges (start, length, rank), which are sorted
by position. The edges are then relaxed as the BPE model asks: in each round, every segment contracts its
edge of best rank (the leftmost of equals) that joins two neighbouring symbols, until none is left. Results
are those of the model's own library; characters that are no piece fall back to their bytes.

The vocabulary's file is a parameter; it must have an identity normaliser, escaped white space, a dummy
prefix and byte fallback. Null texts give null ids, empty ones none; decoding gives null back for null.
All other columns go along; rows may repeat.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofgrid.llm.common import bounded, chunks, columns, free_name

MARK = "▁"
#: Segments of more characters than this are contracted with a heap rather than in rounds.
LONG = 64
_SPAN = 64  # above the longest piece in bytes


def _words(buf: np.ndarray) -> np.ndarray:
    """At each byte, the next 8 bytes as a big-endian number."""
    pad = np.append(buf, np.zeros(8, np.uint8)).astype(np.uint64)
    out = np.zeros(len(buf), np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | pad[i : i + len(buf)]
    return out


def suffix_array(buf: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that start at ``at``, sorted by their first ``most`` bytes (in eights), and the eights of the buffer."""
    eight = np.append(_words(buf), np.zeros(most + 8, np.uint64))
    order = at[np.argsort(eight[at], kind="stable")]
    same = np.append(eight[order][1:] == eight[order][:-1], False)
    for k in range(8, most, 8):
        tied = same.copy()
        tied[1:] |= same[:-1]
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group = np.cumsum(~np.append(False, same[:-1]))[where]
        key = eight[order[where] + k]
        by = np.lexsort((key, group))
        order[where] = order[where[by]]
        key = key[by]
        still = np.zeros(len(order), bool)
        still[where[:-1]] = (key[1:] == key[:-1]) & (group[1:] == group[:-1]) & (np.diff(where) == 1)
        same = still
    return order, eight


class Codec:
    """A vocabulary, and its encoder and decoder."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        special = {i for i in range(len(self.pieces)) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.blank = special
        self.as_bytes = [b"" if i in special else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]
        plain = [i for i in range(len(self.pieces)) if i not in special and not sp.is_byte(i)]
        self.single = {self.pieces[i]: i for i in plain if len(self.pieces[i]) == 1}
        many = sorted((i for i in plain if len(self.pieces[i]) > 1), key=lambda i: (-sp.get_score(i), i))
        if any(MARK in self.pieces[i].lstrip(MARK) for i in many):
            raise ValueError("a piece has white space inside")
        self.ids = np.array(many, np.int64)  # by rank
        self.own = list(range(len(self.pieces)))  # one object for each id
        # pieces of equal score differ by rank here; the model ranks them by place, which `tie` restores
        self.tie = np.unique([-sp.get_score(i) for i in many], return_inverse=True)[1].astype(np.int64)
        raw = [self.pieces[i].encode() for i in many]
        self.size = np.array([len(r) for r in raw], np.int64)
        self.most = int(self.size.max())
        if self.most >= _SPAN:
            raise ValueError("a piece is too long")
        wide = -(-self.most // 8)
        table = lambda fill: np.frombuffer(b"".join(r + fill * (8 * wide - len(r)) for r in raw), ">u8").astype(np.uint64).reshape(len(raw), wide)
        self.low, self.high = table(b"\x00"), table(b"\xff")
        inner = "".join(sorted({c for i in many for c in self.pieces[i]} - {MARK}))
        own = f"[{re.escape(inner)}]"
        self.split = re.compile(f"{MARK}+{own}*|{own}+|[^{MARK}]")

    @staticmethod
    def _bound(order: np.ndarray, eight: np.ndarray, key: np.ndarray, after: bool, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each key, the first place from lo to hi whose suffix doesn't sort before it (or sorts after it)."""
        lo, hi = lo.copy(), hi.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            at = order[mid]
            less, equal = np.zeros(len(open_), bool), np.ones(len(open_), bool)
            for k in range(key.shape[1]):
                s, p = eight[at + 8 * k], key[open_, k]
                less |= equal & (s < p)
                equal &= s == p
                if not equal.any():
                    break
            go = less | (equal if after else False)
            lo[open_[go]] = mid[go] + 1
            hi[open_[~go]] = mid[~go]
        return lo

    def edges(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start * _SPAN + length, rank) of every occurrence of a piece of several characters, by position."""
        at = np.flatnonzero((buf & 0xC0) != 0x80)
        order, eight = suffix_array(buf, at, 8 * self.low.shape[1])
        first = eight[order]
        lo, hi = np.searchsorted(first, self.low[:, 0], side="left"), np.searchsorted(first, self.high[:, 0], side="right")
        wide = np.flatnonzero((self.size > 8) & (hi > lo))  # pieces that the first 8 bytes don't decide
        lo[wide], hi[wide] = self._bound(order, eight, self.low[wide], False, lo[wide], hi[wide]), self._bound(order, eight, self.high[wide], True, lo[wide], hi[wide])
        n = hi - lo
        some = np.flatnonzero(n)
        n = n[some]
        place = order[np.repeat(lo[some] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]
        edge = ((place * _SPAN + np.repeat(self.size[some], n)) << 20) | np.repeat(some, n)
        edge.sort()
        return edge >> 20, edge & ((1 << 20) - 1)

    def _learn(self, segments: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of each segment."""
        known: dict[str, tuple[int, ...]] = {}
        if not segments:
            return known
        raw = [s.encode() for s in segments]
        buf = np.frombuffer(b"\xff".join(raw) + b"\xff", np.uint8)
        key, rank = self.edges(buf)
        begin = np.append(0, np.cumsum([len(r) + 1 for r in raw]))
        chars = np.flatnonzero(((buf & 0xC0) != 0x80) & (buf != 0xFF))
        seg = np.searchsorted(begin, chars, side="right") - 1
        far = np.iinfo(np.int64).max

        def ranks(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            size = end - start
            own = start * _SPAN + np.minimum(size, _SPAN - 1)
            k = np.minimum(np.searchsorted(key, own), len(key) - 1)
            return np.where((key[k] == own) & (size < _SPAN - 1), rank[k], far) if len(key) else np.full(len(start), far)

        start, end = chars, np.append(chars[1:], len(buf))
        end = np.minimum(end, begin[seg + 1] - 1)
        count = np.bincount(seg, minlength=len(raw))
        slow = count > LONG
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for s in np.flatnonzero(slow):
            own = np.flatnonzero(seg == s)
            a, b = self._by_heap(start[own], end[own], ranks)
            done.append((np.full(len(a), s), a, b))
        live = ~slow[seg]
        seg, start, end = seg[live], start[live], end[live]
        pair = np.full(len(seg), far)
        inner = np.flatnonzero(seg[:-1] == seg[1:])
        pair[inner] = ranks(start[inner], end[inner + 1])
        while len(seg):
            first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
            best = np.minimum.reduceat(np.where(pair == far, far, self._tied(pair)), first)
            size = np.diff(np.append(first, len(seg)))
            over = np.repeat(best == far, size)
            if over.any():
                done.append((seg[over], start[over], end[over]))
                seg, start, end, pair = seg[~over], start[~over], end[~over], pair[~over]
                best, size = best[best != far], size[best != far]
                if not len(seg):
                    break
            hit = np.flatnonzero((pair != far) & (self._tied(pair) == np.repeat(best, size)))
            hit = hit[np.append(True, seg[hit][1:] != seg[hit][:-1])]  # the leftmost of each segment
            end[hit] = end[hit + 1]
            pair[hit] = pair[hit + 1]
            keep = np.ones(len(seg), bool)
            keep[hit + 1] = False
            now = hit - np.arange(len(hit))  # places after the compaction
            seg, start, end, pair = seg[keep], start[keep], end[keep], pair[keep]
            fresh = np.concatenate([now, now[now > 0] - 1])
            fresh = fresh[fresh + 1 < len(seg)]
            apart = seg[fresh] != seg[fresh + 1]
            pair[fresh[apart]] = far
            fresh = fresh[~apart]
            pair[fresh] = ranks(start[fresh], end[fresh + 1])
        seg, start, end = (np.concatenate(x) for x in zip(*done, strict=True))
        by = np.argsort(seg, kind="stable")
        seg, start, end = seg[by], start[by], end[by]
        found = ranks(start, end)
        ids = np.where(found != far, self.ids[np.where(found != far, found, 0)], -1)
        bounds = np.searchsorted(seg, np.arange(len(raw) + 1)).tolist()
        data = buf.tobytes()
        spelled: dict[int, list[int]] = {}
        for k in np.flatnonzero(ids < 0).tolist():
            char = data[start[k] : end[k]]
            if (own := self.single.get(char.decode())) is not None:
                ids[k] = own
            else:
                spelled.setdefault(int(seg[k]), []).append(k)
        flat = list(map(self.own.__getitem__, ids.tolist()))
        for i, s in enumerate(segments):
            if i not in spelled:
                known[s] = tuple(flat[bounds[i] : bounds[i + 1]])
                continue
            out: list[int] = []
            for k in range(bounds[i], bounds[i + 1]):
                out.extend([flat[k]] if ids[k] >= 0 else [self.bytes[b] for b in data[start[k] : end[k]]])
            known[s] = tuple(out)
        return known

    def _tied(self, rank: np.ndarray) -> np.ndarray:
        return self.tie[np.where(rank < len(self.tie), rank, 0)]

    def _by_heap(self, start: np.ndarray, end: np.ndarray, ranks) -> tuple[np.ndarray, np.ndarray]:
        """The same contraction for one long segment."""
        n = len(start)
        end = end.copy()
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        gone = [False] * n
        first = ranks(start[:-1], end[1:])
        heap = [(int(self.tie[r]), i, int(end[i + 1])) for i, r in enumerate(first) if r < len(self.tie)]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            r = ranks(start[i : i + 1], end[j : j + 1])[0]
            if r < len(self.tie):
                heapq.heappush(heap, (int(self.tie[r]), i, int(end[j])))

        while heap:
            _, i, stop = heapq.heappop(heap)
            if gone[i] or (j := right[i]) >= n or end[j] != stop:
                continue
            end[i] = end[j]
            gone[j] = True
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                offer(i, right[i])
            if left[i] >= 0:
                offer(left[i], i)
        stay = np.flatnonzero(~np.array(gone))
        return start[stay], end[stay]

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        """Ids of each text. The batch is indexed anew: no ids are kept from one call to the next."""
        tracked = gc.isenabled()
        gc.disable()  # millions of strings and tuples without cycles
        try:
            parts = [self.split.findall(MARK + t.replace(" ", MARK)) if t else () for t in texts]
            known = self._learn(sorted(set(chain.from_iterable(parts))))
            return [None if t is None else list(chain.from_iterable(map(known.__getitem__, p))) for t, p in zip(texts, parts, strict=True)]
        finally:
            if tracked:
                gc.enable()

    def decode(self, ids: list[list[int] | None]) -> list[str | None]:
        """Texts of ids: the dummy prefix goes, bytes that form no character become U+FFFD."""
        out: list[str | None] = []
        for own in ids:
            if own is None:
                out.append(None)
                continue
            text = b"".join(map(self.as_bytes.__getitem__, own)).decode("utf-8", "replace")
            first = next((i for i in own if i not in self.blank), None)
            out.append(text[1:] if first is not None and self.pieces[first].startswith(MARK) else text)
        return out


_codecs: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    """The codec of a file, built once in each worker."""
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def default_model() -> str:
    """The installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _encode(model_file: str, text_col: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for rows, texts in chunks(batches, text_col):
            ids = own.encode([t if t is None else t.decode("utf-8", "replace") for t in texts])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ids, pa.list_(pa.int32()))], [*rows.schema.names, name])

    return run


def _decode(model_file: str, ids_col: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                rows = batch.slice(s, 512)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(own.decode(columns(rows, ids_col).to_pylist()), pa.string())], [*rows.schema.names, name])

    return run


def encode(docs: DataFrame, text_col: str = "text", model_file: str | None = None) -> DataFrame:
    """``docs`` with the column ids (array of int; null for a null text), named ids_ if ``docs`` has ids of its own."""
    bounded(docs.sparkSession)
    name = free_name(docs, "ids")
    return docs.mapInArrow(_encode(model_file or default_model(), text_col, name), T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, model_file: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``encoded``, which has the column ``ids_col``, with the column decoded (decoded_ if it has one of its own)."""
    name = free_name(encoded, "decoded")
    return encoded.mapInArrow(_decode(model_file or default_model(), ids_col, name), T.StructType([*encoded.schema.fields, T.StructField(name, T.StringType())]))


def _digest(model_file: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_file)
        for rows, texts in chunks(batches):
            plain = [t if t is None else t.decode("utf-8", "replace") for t in texts]
            ids = own.encode(plain)
            back = own.decode(ids)
            same = [None if t is None else b == t.replace(MARK, " ") for t, b in zip(plain, back, strict=True)]
            yield pa.RecordBatch.from_arrays([columns(rows, "doc_id"), pa.array([None if i is None else len(i) for i in ids], pa.int64()), pa.array([None if i is None else hashlib.sha256(np.array(i, "<i4").tobytes()).hexdigest() for i in ids], pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_sha256", "round_trip"])

    return run


def round_trips(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256 of little-endian 32-bit ids, round_trip) of every whole text, in one pass."""
    bounded(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_digest(model_file or default_model()), f"doc_id {kind}, n_tokens long, ids_sha256 string, round_trip boolean")
