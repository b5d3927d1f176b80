"""From raw documents to a mixed and encoded corpus, in five stages over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.llm import line_dedup, mixing, ngram_join, piece_codec, quality_rules
from proofgrid.llm.common import WORD, cut, free_name, table


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars as its texts are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.keep(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without recurring lines; a document that consisted of such lines alone goes."""
    out = line_dedup.dedup_lines(docs, link=line_dedup.LINK, least_words=1)
    return _measured(out.filter((F.col(out.columns[-1]) == 0) | F.col("text").rlike(WORD)).select(*docs.columns))


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id."""
    return ngram_join.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: a row for each pass over a document."""
    return _measured(mixing.occurrences(docs))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids and how many these are (ids and n_tokens; with an underscore after a name that
    is taken)."""
    out = piece_codec.encode(docs)
    return out.withColumn(free_name(out, "n_tokens"), F.size(out.columns[-1]).cast("long"))


STAGES = [
    ("quality rules", quality_rules_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_join_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", sentencepiece_stage),
]

#: SQL can't express the n-gram models, the components or the tokenizer; a test holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
