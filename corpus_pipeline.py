"""Corpus preparation: quality filter, line deduplication, near-deduplication, mixing, packing.

Each stage but the last returns the columns of documents and works on all that the one before kept; other
columns, of any name, ride along. Defined cases: a null or empty text has no words, and the classifier
decides on it like on any other; null ids are kept, and of rows alike in all but a null id one stays after
near-deduplication; repeated rows go through every stage like different ones, and near-deduplication leaves one
of them; an empty table gives an empty table from each stage. n_chars follows the text where lines are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oredock.llm import line_dedup, mixing, packing, quality_model, simhash
from oredock.llm.common import fold, materialize, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labelled ones among docs."""
    return quality_model.accepted(docs, read(spark, sf_dir, "labels"))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; n_chars is that of the text that is left."""
    return line_dedup.clean(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, or left out, to reach the target weights; then all are shuffled."""
    folded, unfold = fold(docs, "doc_id", "text", "source")
    return unfold(mixing.mix(folded), {})


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece, with its ids and its place. The order of sequence_id is a shuffle of the sequences."""
    return packing.pack(docs, *packing.public_tokens(), scatter=True)


STAGES = [("quality", quality_stage), ("line_dedup", lines_stage), ("simhash", near_stage), ("mixing", mix_stage), ("packing", pack_stage)]
#: Fitted and iterative stages have no SQL; tests/llm/test_pipeline.py checks each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
