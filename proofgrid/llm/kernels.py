"""Vectorised kernels over UTF-8 bytes: prefix polynomial hashes, words and shingles.

Hashes are polynomials modulo 2**64 with an odd base, so that a substring's hash follows from two prefix
sums and an inverse power; `mixed` spreads them before they order or bucket anything.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd base of the polynomial hash, its inverse modulo 2**64, and the multiplier that joins word hashes.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
JOIN = U(0xD6E8FEB86659FD93)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n; kept between calls."""
    global _powers, _inverses
    while len(_powers) < n:
        step = U(pow(BASE, len(_powers), 1 << 64))
        back = U(pow(INVERSE, len(_powers), 1 << 64))
        _powers = np.concatenate([_powers, _powers * step])
        _inverses = np.concatenate([_inverses, _inverses * back])
    return _powers[:n], _inverses[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the word."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of (buf[k] + 1) * BASE**k for i <= k < j."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + U(1)) * powers(len(buf))[0], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans, equal for equal strings wherever they start."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


class Words:
    """The words of several texts: spans in one buffer, the text each belongs to, and 64-bit hashes."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        lengths = np.array([len(t) if t else 0 for t in texts], np.int64)
        self.offset = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(lengths + 1, out=self.offset[1:])
        buf = np.frombuffer(b"\n".join([t or b"" for t in texts]) + b"\n", np.uint8)
        self.buf = _LOWER[buf] if lower else buf
        space = _IS_SPACE[self.buf]
        edge = np.diff(space.astype(np.int8), prepend=1)
        self.start = np.flatnonzero(edge == -1)
        self.end = np.flatnonzero(edge == 1)
        if len(space) and space[0]:
            self.end = self.end[self.end > 0]
        self.prefix = prefix_hash(self.buf)
        self.hash = mixed(span_hash(self.prefix, self.start, self.end))
        #: words first[i] to first[i + 1] belong to text i
        self.first = np.searchsorted(self.start, self.offset)
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-word windows that lie in one text, and the index of each one's first word."""
        if len(self.hash) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        m = len(self.hash) - n + 1
        h = np.zeros(m, np.uint64)
        for k in range(n):
            h = h * JOIN + self.hash[k : k + m]
        at = np.flatnonzero(self.text[:m] == self.text[n - 1 :])
        return mixed(h[at]), at


def shingle_sets(texts: list[bytes | None], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-word shingles, A-Z lower-cased; a text of fewer words gives its whole sequence as one."""
    w = Words(texts, lower=True)
    h, at = w.grams(n)
    bounds = np.searchsorted(at, w.first)
    out = []
    for i in range(len(texts)):
        s, e = bounds[i], bounds[i + 1]
        if e > s:
            out.append(np.unique(h[s:e]))
        elif w.first[i + 1] > w.first[i]:
            own = U(w.first[i + 1] - w.first[i])
            for x in w.hash[w.first[i] : w.first[i + 1]]:
                own = U((int(own) * int(JOIN) + int(x)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mixed(np.array([own], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
