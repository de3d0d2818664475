"""A corpus pipeline of five stages; each works on all that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from blockflow.llm import lines, near, packing, passages, quality_model
from blockflow.llm.common import cut, scope, table
from blockflow.llm.queries import fold


#: Passages of over 50 words have about 300 bytes or more.
PASSAGE_BYTES = 300


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier predicts to be good, as keep_good defines it: null and empty texts are scored like any others, repeated rows alike; an empty table stays empty."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"), fold(4) == 2)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand earlier in the corpus, as without_repeated_lines defines it; null and empty texts stay, an empty table stays empty."""
    return lines.without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8), as one_of_each_group defines it; null, empty and blank texts and null ids are in no group and stay, of equal rows one does."""
    return near.one_of_each_group(docs, words=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that also stand elsewhere, as without_repeats defines it; null and short texts stay, equal long texts go."""
    return passages.without_repeats(docs, PASSAGE_BYTES)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, as pack_documents defines it; a null or empty text is its end mark alone, repeated rows are documents of their own."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("pack", pack)]

#: SQL has neither the trained classifier nor the tokenizer; tests/llm/test_pipeline.py holds run()'s rows against a plain form of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again by the next, which frees it when it is done."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scope() as outlive:
            docs = outlive(cut(stage(spark, docs, sf_dir), docs))
    return STAGES[-1][1](spark, docs, sf_dir)
