"""Corpus pipeline: each stage works on all that its predecessor kept, written as Parquet and read again between stages.

All stages but the last return the columns of their input, in order, whatever further columns it has and however they are
named. An empty table gives an empty result at every stage. Very long texts are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barflow.llm import decontaminate, line_dedup, ngram_join, quality, registry, sentencepiece_viterbi
from barflow.llm.common import load, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.3 stay.

    Null and empty texts are scored as empty ones. A null id is never held out and has no label. Repeated rows and ties are
    scored alike, so they stay or go together. Without labels or with fewer than two texts every score is 0.5: all stay.
    """
    return quality.score(docs, quality.fit(docs, load(spark, sf_dir, "labels")), keep=True)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines leave the texts; no row goes.

    Null texts stay null, empty ones empty; a text that loses all lines becomes empty. First is the smallest id, null ids before
    all, then the text's hash. Rows that agree in id and text come out alike.
    """
    return line_dedup.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the smallest id, rows without id last, then by the text's hash.

    Null texts and texts without words are groups of their own and stay. Of rows that agree in id and text one stays; rows that
    share an id alone are told apart by their texts.
    """
    return ngram_join.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go.

    Null and empty texts hold no passage and stay. Rows that share the id of a contaminated text go with it, a null id being an
    id. Repeated rows stay or go together. An empty benchmark keeps all.
    """
    return decontaminate.clean(docs, load(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with the check that they decode to its text: ``doc_id, ids, n_tokens, decoded_ok``.

    Null and empty texts have no ids. Null ids and repeated rows are rows like all others.
    """
    return sentencepiece_viterbi.encode(docs, registry.tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", sentencepiece),
]

#: Fitting, groups of near copies and encoding are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
