"""Language identification with string kernels.

Each text becomes the presence vector of its byte n-grams (1 to 4 bytes of UTF-8, A-Z lower-cased, ASCII other
than letters read as a space), hashed into ``WIDTH`` places: the blended spectrum. The kernel of two texts is
their count of common places over the geometric mean of their counts. Landmark texts give a Nyström map, and
kernel ridge regression with one output for each language (+1 or -1) is solved on it. A block of texts is then
scored by two matrix products: presence times landmarks, and kernel times weights.

Bounds: at most ``most_rows`` labelled texts of each language are learned from, the first by a hash of id and text, and
at most ``most_total`` of all: of many languages fewer each, but every language keeps one at least. They reach the
driver as bitmaps of 2 KB, and are unpacked a block at a time. A threshold on the hash, from the languages' counts, leaves a few times as many texts before any is made a bitmap,
so no task sees all of a language. Every text is scored whole. Nothing but the text enters a prediction.

Null texts and texts without a letter get ``und`` and score 0; so do all if there is nothing to learn from.
Equal texts get equal results. Rows without an id are scored, never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.llm.common import bounded, chunks, columns, cut
from proofgrid.llm.kernels import U, mixed, powers

WIDTH = 1 << 14
ORDERS = (1, 2, 3, 4)
#: Texts whose presence vectors are held at once.
BLOCK = 256

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:65] = 32
_FOLD[91:97] = 32
_FOLD[123:128] = 32


def presence(texts: list[bytes | None]) -> np.ndarray:
    """One row of 0 and 1 for each text."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    flat = out.ravel()
    size = np.array([len(t) if t else 0 for t in texts])
    buf = _FOLD[np.frombuffer(b"".join(t or b"" for t in texts), np.uint8)]
    if not len(buf):
        return out
    who = np.repeat(np.arange(len(texts)), size)
    row = who * WIDTH
    value = buf.astype(np.uint64) + U(1)
    h = np.zeros(len(buf), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(buf) - n + 1
        if m <= 0:
            break
        h = h[:m] * powers(2)[0][1] + value[n - 1 :]
        if n in ORDERS:
            at = row[:m] + (mixed(h) >> U(50)).astype(np.int64)
            flat[at if n == 1 else at[who[:m] == who[n - 1 :]]] = 1
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


class Model:
    """Landmarks (unit rows, transposed) and the weights of each language."""

    def __init__(self, names: list[str], marks: np.ndarray, weights: np.ndarray):
        self.names, self.marks, self.weights = names, marks, weights

    @classmethod
    def fit(cls, bits: np.ndarray, y: list[str], landmarks: int = 256, ridge: float = 1e-2) -> Model:
        """Learns from rows of packed bits, whose order decides which become landmarks: the first of each language. Of more
        languages than ``landmarks``, each has one."""
        names, own = np.unique(np.array(y, object), return_inverse=True)
        names = names.tolist()
        share = max(1, landmarks // len(names))
        order = np.argsort(own, kind="stable")
        begin = np.searchsorted(own[order], np.arange(len(names) + 1))
        chosen = np.concatenate([order[s : min(s + share, e)] for s, e in zip(begin[:-1], begin[1:], strict=True)])
        rows = lambda b: unit(np.unpackbits(b, axis=1).astype(np.float32))
        marks = rows(bits[chosen])
        k = np.vstack([rows(bits[s : s + BLOCK]) @ marks.T for s in range(0, len(bits), BLOCK)]).astype(np.float64)
        value, vector = np.linalg.eigh(k[chosen])
        keep = value > 1e-6 * value.max()
        back = vector[:, keep] / np.sqrt(value[keep])  # the Nyström map of a kernel row
        phi = np.hstack([k @ back, np.ones((len(k), 1))])
        target = np.where(own[:, None] == np.arange(len(names)), 1.0, -1.0)
        each = 1 / np.bincount(own, minlength=len(names))[own]  # languages count alike
        w = np.linalg.solve((phi * each[:, None]).T @ phi + ridge * np.eye(phi.shape[1]) / len(names), (phi * each[:, None]).T @ target)
        return cls(names, np.ascontiguousarray(marks.T), np.vstack([back @ w[:-1], w[-1:]]).astype(np.float32))

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
        names, score = [], []
        for s in range(0, len(texts), BLOCK):
            out = unit(presence(texts[s : s + BLOCK])) @ self.marks @ self.weights[:-1] + self.weights[-1]
            best = out.argmax(1)
            names += [self.names[b] for b in best]
            score.append(np.clip((out[np.arange(len(best)), best] + 1) / 2, 0, 1))
        return names, np.concatenate(score).astype(np.float64) if score else np.zeros(0)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in chunks(batches, limit=1 << 20):
        for s in range(0, len(texts), BLOCK):
            bits = np.packbits(presence(texts[s : s + BLOCK]).astype(bool), axis=1)
            part = rows.slice(s, BLOCK)
            yield pa.RecordBatch.from_arrays([*(columns(part, k) for k in ("doc_id", "lang", "u")), pa.array([b.tobytes() for b in bits], pa.binary())], ["doc_id", "lang", "u", "bits"])


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for rows, texts in chunks(batches, limit=1 << 20):
            names, score = m.predict(texts)
            letter = columns(rows, "letter").to_pylist()
            yield pa.RecordBatch.from_arrays([columns(rows, "doc_id"), columns(rows, "held_out"), pa.array([n if ok else "und" for n, ok in zip(names, letter, strict=True)]), pa.array(np.where(letter, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def _sample(docs: DataFrame, counts: DataFrame, most_rows: int, spare: int = 4) -> DataFrame:
    """(doc_id, lang, text, u) of labelled texts (doc_id, lang, text): about ``spare`` times ``most_rows`` of each language, but
    64 at least, and all of those that have fewer."""
    span = 1 << 40
    level = counts.select("lang", F.least(F.lit(float(span)), F.lit(float(max(64, spare * most_rows) * span)) / F.col("n")).alias("level"))
    rows = docs.withColumn("u", F.pmod(F.xxhash64("doc_id", "text"), F.lit(span)))
    return rows.join(level, "lang").filter("u < level").drop("level")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_rows: int = 1_000, most_total: int = 20_000, landmarks: int = 256, ridge: float = 1e-2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned where crc32 of the id as text, modulo 3, is not 1."""
    spark = bounded(docs.sparkSession)
    held = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), letter.alias("letter"), F.col(text_col).alias("text"))
    known = docs.filter(~held & F.col(lang_col).isNotNull() & letter).select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = cut(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    most_rows = max(1, min(most_rows, most_total // max(1, counts.count())))
    bits = _sample(known, counts, most_rows).mapInArrow(_bitmaps, f"doc_id {kind}, lang string, u long, bits binary").dropDuplicates(["lang", "u", "doc_id"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id"))
    rows = sorted(bits.withColumn("rank", rank).filter(F.col("rank") <= most_rows).collect(), key=lambda r: (r.lang, r.rank))
    if not rows:
        return base.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    packed = np.frombuffer(b"".join(r.bits for r in rows), np.uint8).reshape(len(rows), -1)
    model = spark.sparkContext.broadcast(Model.fit(packed, [r.lang for r in rows], landmarks, ridge))
    return base.mapInArrow(_predict(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
