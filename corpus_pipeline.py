"""The corpus pipeline: documents in, packed sequences out, in five stages over written tables.

Edge cases, stage by stage (tests/llm/test_pipeline.py): a null text counts as empty and goes with the first stage, as do
empty and wordless texts; a null doc_id or lang is carried along. Repeated rows are judged alike by the first two stages, and
one of them stays after the third; of ties there the smallest doc_id stays. Very long texts are read whole by every stage.
All but the last stage keep the columns of documents, other ones and those of clashing names included. Empty tables give no
rows; empty labels let the second stage keep all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from abacora.llm import near_copies, packing, quality_classifier, quality_rules, suffix_dedup
from abacora.llm.common import discard, materialise, scratch, table

#: Bytes of a repeated passage that the fourth stage removes: 51 short words reach it, which operator 9's own 400 bytes would miss.
PASSAGE = 208


def good_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that the rules or their language's perplexity band reject go."""
    return quality_rules.keep_good(docs)


def good_by_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the model of trusted text finds too unlikely go."""
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each group of near copies stays."""
    return near_copies.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: passages that occur elsewhere too are cut out of the texts; n_chars follows."""
    return suffix_dedup.cut_repeats(docs, PASSAGE)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: the texts' pieces in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", good_by_rules),
    ("quality_classifier", good_by_model),
    ("simhash_near_dedup", one_of_copies),
    ("suffix_array_dedup", without_repeats),
    ("packing", packed),
]

#: SQL can express none of the stages' models, so tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch():
            after = materialise(stage(spark, docs, sf_dir), name, stays=True)
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
