"""Quality rules: counts over words and lines, and a log-likelihood ratio of hashed n-grams.

The method: the words and word pairs of a text are hashed into ``BUCKETS`` buckets. Two multinomials, one of
texts trusted as a target and one of the whole raw corpus, give each bucket a log ratio; a text's score is the
mean ratio of its n-grams. A text is kept when its score reaches a threshold that depends on the tables alone,
so every run decides alike: it lies in the widest gap with the least balanced error on labelled texts, a quarter
of the way from the worse side, as a good text lost weighs more than a bad one kept.

Bounds: labels are those of at most ``most_labels`` ids of each class, taken by the order of a hash of the id.
Half of the trusted ones (label 1) make the target, all others place the threshold. The raw counts cover every
text. Model and ids have fixed sizes and are broadcast.

Null texts have no words, and fail the base rules. Without a trusted text (labels empty, or none of them in
the corpus) all ratios are 0 and the base rules decide alone. Texts that repeat count as often as they occur;
the id may be null, or text (labels then find it if it is a number); columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.common import as_blocks, bounded, chunks, columns, summed
from proofgrid.llm.kernels import JOIN, U, Words, mixed

BUCKETS = 1 << 16
BLOCKS = 32
SMOOTH = 1.0
#: N-grams by which the target is drawn to the raw corpus, so that what a small target lacks is no verdict.
PRIOR = 20_000.0
SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_CONTINUES = (np.arange(256) & 0xC0) == 0x80


def buckets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs, and the text of each."""
    pair = np.flatnonzero(w.text[:-1] == w.text[1:]) if len(w.hash) else np.zeros(0, np.int64)
    two = mixed(w.hash[pair] * JOIN + w.hash[pair + 1]) if len(pair) else np.zeros(0, np.uint64)
    return (np.concatenate([w.hash, two]) >> U(48)).astype(np.int64), np.concatenate([w.text, w.text[pair]])


def _count(trusted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = trusted.value
        total = np.zeros((2, BUCKETS), np.int64)
        for rows, texts in chunks(batches):
            own, text = buckets(Words(texts))
            total[0] += np.bincount(own, minlength=BUCKETS)
            if len(ids):
                own_id = columns(rows, "doc_id")
                hit = np.isin(own_id.fill_null(-1).to_numpy(zero_copy_only=False), ids) & own_id.is_valid().to_numpy(zero_copy_only=False)
                total[1] += np.bincount(own[hit[text]], minlength=BUCKETS)
        yield as_blocks(total.ravel(), 2 * BLOCKS)

    return run


def scores(texts: list[bytes | None], ratio: np.ndarray, w: Words | None = None) -> np.ndarray:
    own, text = buckets(w or Words(texts))
    n = np.bincount(text, minlength=len(texts))
    return np.bincount(text, ratio[own], minlength=len(texts)) / np.maximum(n, 1)


def base_counts(texts: list[bytes | None], w: Words) -> dict[str, np.ndarray]:
    """The counts of the base rules for each text."""
    total = lambda per_byte: np.diff(np.append(0, np.cumsum(per_byte))[w.offset])
    h, at = w.grams(3)
    own = mixed(h + w.text[at].astype(np.uint64) * JOIN)
    _, same, times = np.unique(own, return_inverse=True, return_counts=True)
    first = at[times[same] > 1]
    hit = np.zeros(len(w.hash), bool)
    for k in range(3):
        hit[first + k] = True
    repeated = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip(SPACES)] if t else []
        repeated.append(len(lines) - len(set(lines)))
    return {
        "n_words": np.diff(w.first),
        "word_chars": total(~_SPACE[w.buf] & ~_CONTINUES[w.buf]),
        "n_symbols": total(_SYMBOL[w.buf]),
        "n_dup_lines": np.array(repeated, np.int64),
        "n_repeat_words": np.bincount(w.text[hit], minlength=len(texts)),
    }


def _judge(ratio, threshold: float, least_words: int, most_repeated: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            w = Words(texts)
            c = base_counts(texts, w)
            score = scores(texts, ratio.value, w)
            failed = (c["n_words"] < least_words) | (100 * c["n_repeat_words"] > most_repeated * c["n_words"])
            yield pa.RecordBatch.from_arrays([columns(rows, "doc_id"), *(pa.array(x.astype(np.int64)) for x in c.values()), pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))], ["doc_id", *c, "base_failed", "score", "kept"])

    return run


def _score(ratio):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches):
            w = Words(texts)
            c = base_counts(texts, w)
            yield pa.RecordBatch.from_arrays([columns(rows, "good"), pa.array(scores(texts, ratio.value, w)), pa.array(c["n_words"].astype(np.int64)), pa.array(c["n_repeat_words"].astype(np.int64))], ["good", "score", "n_words", "n_repeat_words"])

    return run


def gap(scores: np.ndarray, good: np.ndarray) -> float:
    """The threshold: a quarter into the widest gap between scores at which the balanced error is least."""
    if not good.any():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order]
    lost = np.append(0, np.cumsum(g)) / g.sum()
    passed = 1 - np.append(0, np.cumsum(~g)) / (~g).sum() if (~g).any() else np.zeros(len(s) + 1)
    edge = np.append(s[0] - 1, s)
    width = np.append(s, s[-1] + 1) - edge
    error = np.where(width > 0, lost + passed, np.inf)
    best = np.flatnonzero(error <= error.min() + 1e-12)
    at = best[np.argmax(width[best])]
    return float(edge[at] + width[at] / 4)


def _keep(ratio, threshold: float, least_words: int, most_repeated: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches, text_col):
            w = Words(texts)
            c = base_counts(texts, w)
            failed = (c["n_words"] < least_words) | (100 * c["n_repeat_words"] > most_repeated * c["n_words"])
            yield rows.filter(pa.array(~failed & (scores(texts, ratio.value, w) >= threshold)))

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_labels: int = 10_000, least_words: int = 50, most_repeated: int = 50):
    """The broadcast log ratios of all buckets, and the threshold."""
    spark = bounded(docs.sparkSession)
    number = F.expr(f"try_cast(`{id_col}` AS long)").alias("doc_id")
    texts = docs.select(number, F.col(text_col).alias("text"))
    marked = labels.select(number, label_col).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(label_col).alias("label"))
    take = lambda v: [r.doc_id for r in marked.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels).collect()]
    good, bad = take(1), take(0)
    trusted = spark.sparkContext.broadcast(np.sort(np.array(good[::2], np.int64)))
    counts = summed(texts.mapInArrow(_count(trusted), "block int, counts binary"), 2 * BUCKETS, 2 * BLOCKS).reshape(2, BUCKETS)
    ratio, threshold = np.zeros(BUCKETS), -np.inf
    if counts[1].any():
        raw = (counts[0] + SMOOTH) / (counts[0].sum() + SMOOTH * BUCKETS)
        ratio = np.log((counts[1] + PRIOR * raw) / (counts[1].sum() + PRIOR)) - np.log(raw)
    model = spark.sparkContext.broadcast(ratio)
    if counts[1].any():
        rows = [(int(i), True) for i in good[1::2]] + [(int(i), False) for i in bad]
        placed = F.broadcast(spark.createDataFrame(rows, "doc_id long, good boolean"))  # at most 1.5 * most_labels rows
        known = texts.join(placed, "doc_id").select("doc_id", "text", "good").mapInArrow(_score(model), "good boolean, score double, n_words long, n_repeat_words long")
        found = known.filter((F.col("n_words") >= least_words) & (100 * F.col("n_repeat_words") <= most_repeated * F.col("n_words"))).groupBy("score", "good").count().collect()
        threshold = gap(np.array([r.score for r in found]), np.array([r.good for r in found], bool)) if found else -np.inf
    return model, threshold


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, most_repeated: int = 50, **options) -> DataFrame:
    """One row for each document: the base counts, base_failed, score and kept. See the module."""
    model, threshold = fit(docs, labels, id_col, text_col, least_words=least_words, most_repeated=most_repeated, **options)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = ", ".join(f"{k} long" for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return texts.mapInArrow(_judge(model, threshold, least_words, most_repeated), f"doc_id {dict(texts.dtypes)['doc_id']}, {kinds}, base_failed boolean, score double, kept boolean")


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, most_repeated: int = 50, **options) -> DataFrame:
    """The rows of ``docs`` that `judge` keeps, with all their columns."""
    model, threshold = fit(docs, labels, id_col, text_col, least_words=least_words, most_repeated=most_repeated, **options)
    return docs.mapInArrow(_keep(model, threshold, least_words, most_repeated, text_col), docs.schema)
