"""License scans: winnowed fingerprints pick candidates, banded alignment confirms them.

Words are runs of ASCII letters, digits and other bytes above 127, A-Z lower-cased. Of each template's hashed
``GRAM``-word windows, the least of every ``WINNOW`` in a row is a fingerprint; of a template of at most ``SHORT``
words every window is one, of so few words that one survives as many changed words as a match may have and an
inserted word besides. An inverted index leads from a fingerprint to (template, place). Every window of a text is looked up; hits on near diagonals make a candidate,
which is aligned with its template in a band around the diagonal (longest common subsequence of words). A match
is reported if it covers enough of the template (its share of the template's words, with its span in the text) and
its span holds the template's key: the words that tell it from its relatives (a version, a variant), in a row and
unchanged. A template without a key has no such words. Of matches whose spans overlap, the one with the most words
stays, then the one with the larger coverage, then the first, so that a span has its best template only.

The index is built from the templates alone and goes to each task with the code; texts are scanned whole, in
one pass without a shuffle. Null texts and texts without words have no rows. A text that repeats is reported
for each row. The id may be null or repeated; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import bounded, chunks, columns
from proofgrid.llm.kernels import Words
from proofgrid.llm.licenses import KEYS, TEMPLATES

GRAM = 3
WINNOW = 4
#: Words of a template that is indexed without winnowing.
SHORT = 30
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def _words(texts: list[bytes | None]) -> Words:
    return Words([t.translate(_PLAIN) if t else t for t in texts], lower=True)


class Index:
    """Templates' words and their fingerprints."""

    def __init__(self, templates: dict[str, str], least: float = 0.75, keys: dict[str, str] | None = None):
        self.names = list(templates)
        own = _words([(keys or {}).get(n, "").encode() for n in self.names])
        self.keys = [own.hash[a:b] for a, b in zip(own.first[:-1], own.first[1:], strict=True)]
        w = _words([templates[n].encode() for n in self.names])
        self.words = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        if any(len(x) < GRAM for x in self.words):
            raise ValueError(f"a template has fewer than {GRAM} words")
        parts = []
        for g, own in self._by_gram(least).items():
            h, at = w.grams(g)
            who = w.text[at]
            chosen = set()
            for t in own:
                windows = np.flatnonzero(who == t)
                step = 1 if len(self.words[t]) <= SHORT else WINNOW
                for s in range(max(1, len(windows) - step + 1)):
                    part = windows[s : s + step]
                    chosen.add(int(part[np.argmin(h[part])]))
            pick = np.array(sorted(chosen))
            parts.append((h[pick], who[pick], at[pick] - w.first[who[pick]]))
        self.hash, self.who, self.place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.who, self.place = self.hash[order], self.who[order], self.place[order]

    def _by_gram(self, least: float) -> dict[int, list[int]]:
        """The templates by the words of their windows: the longest run of words that changes can't break up."""
        self.grams: dict[int, list[int]] = {}
        for t, words in enumerate(self.words):
            kept = math.ceil(least * len(words))
            runs = len(words) - kept + 2
            self.grams.setdefault(min(GRAM, -(-kept // runs)) if len(words) <= SHORT else GRAM, []).append(t)
        return self.grams

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of h, which fingerprint) of every agreement."""
        lo = np.searchsorted(self.hash, h, side="left")
        n = np.searchsorted(self.hash, h, side="right") - lo
        at = np.flatnonzero(n)
        which = np.repeat(at, n[at])
        return which, np.repeat(lo[at], n[at]) + np.arange(len(which)) - np.repeat(np.cumsum(n[at]) - n[at], n[at])


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> list[tuple[int, int]]:
    """(template word, text word) pairs of a longest common subsequence within ``band`` of the diagonal."""
    m, width = len(template), 2 * band + 1
    table = np.zeros((m + 1, width + 1), np.int32)  # column c of row i is text word i + diagonal - band + c
    base = diagonal - band
    for i in range(m):
        j = i + base + np.arange(width)
        inside = (j >= 0) & (j < len(text))
        same = np.zeros(width, bool)
        same[inside] = text[j[inside]] == template[i]
        # the band moves by one word a row: up is column c + 1 of the row before, up-left is column c
        table[i + 1, :width] = np.maximum.accumulate(np.maximum(table[i, :width] + same, table[i, 1:]))
    pairs, i, c = [], m - 1, width - 1
    while i >= 0 and c >= 0:
        now, j = table[i + 1, c], i + base + c
        if c and table[i + 1, c - 1] == now:
            c -= 1
        elif table[i, c + 1] == now and c + 1 < width:
            i, c = i - 1, c + 1
        elif 0 <= j < len(text) and text[j] == template[i]:
            pairs.append((i, j))
            i -= 1
        else:
            i, c = i - 1, min(c + 1, width - 1)
    return pairs[::-1]


def holds(text: np.ndarray, key: np.ndarray) -> bool:
    """Whether the words of ``key`` stand in a row in ``text``."""
    n = len(text) - len(key) + 1
    if n <= 0:
        return not len(key)
    hit = np.ones(n, bool)
    for k, w in enumerate(key):
        hit &= text[k : k + n] == w
    return bool(hit.any())


def find(index: Index, text: np.ndarray, hits: list[tuple[int, int, int]], least: float) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first and last matched text word) of each match in a text's words."""
    by_template: dict[int, set[int]] = {}
    for t, at, place in hits:
        by_template.setdefault(t, set()).add(at - place)
    found = []
    for t, own in by_template.items():
        words = index.words[t]
        band = 4 + len(words) // 10
        diagonals = np.array(sorted(own))
        s = 0
        while s < len(diagonals):
            e = int(np.searchsorted(diagonals, diagonals[s] + band, side="right"))
            mid = int(diagonals[(s + e) // 2])
            s = e
            near = text[max(0, mid - band) : max(0, mid + band + len(words))]
            if np.isin(words, near).sum() < least * len(words) or not holds(near, index.keys[t]):
                continue  # too few of its words stand there, or not its key
            if (pairs := align(words, text, mid, band)) and len(pairs) >= least * len(words) and holds(text[pairs[0][1] : pairs[-1][1] + 1], index.keys[t]):
                found.append((len(pairs), t, pairs[0][1], pairs[-1][1]))
    out, begins, ends = [], [], []  # the spans that stay are apart: sorted by begin they are sorted by end
    for n, t, a, b in sorted(found, key=lambda x: (-x[0], -x[0] / len(index.words[x[1]]), x[2], x[1])):
        k = bisect_left(begins, a)
        if (k == 0 or ends[k - 1] < a) and (k == len(begins) or begins[k] > b):
            begins.insert(k, a)
            ends.insert(k, b)
            out.append((t, n, a, b))
    return sorted(out, key=lambda x: (x[2], x[0]))


def _scan(templates: dict[str, str], least: float, keys: dict[str, str]):
    index = Index(templates, least, keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            w = _words(texts)
            by_text: dict[int, list[tuple[int, int, int]]] = {}
            for g in index.grams:
                h, at = w.grams(g)
                which, print_ = index.hits(h)
                for x, f in zip(at[which].tolist(), print_.tolist(), strict=True):
                    i = int(w.text[x])
                    by_text.setdefault(i, []).append((int(index.who[f]), x - int(w.first[i]), int(index.place[f])))
            out = []
            for i, hits in by_text.items():
                s = w.first[i]
                for t, n, a, b in find(index, w.hash[s : w.first[i + 1]], hits, least):
                    begin, end = int(w.start[s + a] - w.offset[i]), int(w.end[s + b] - w.offset[i])
                    begin, end = len(texts[i][:begin].decode("utf-8", "replace")), len(texts[i][:end].decode("utf-8", "replace"))
                    out.append((i, index.names[t], n, len(index.words[t]), begin, end))
            if out:
                i, *rest = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([columns(rows, "doc_id").take(pa.array(i)), *(pa.array(c, k) for c, k in zip(rest, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True))], ["doc_id", "license", "matched_words", "template_words", "start", "stop"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, least: float = 0.75, keys: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, matched_words, template_words, start, stop, coverage) of every match that covers ``least`` of
    its template; start and stop count characters. ``keys``: of ``templates``; those of the own ones without any."""
    bounded(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan(templates or TEMPLATES, least, KEYS if keys is None else keys), f"doc_id {kind}, license string, matched_words long, template_words long, start long, stop long")
    return out.withColumn("coverage", F.col("matched_words") / F.col("template_words"))
