"""Corpus pipeline: quality, line dedup, near duplicates, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All but the last keep the
columns of ``documents``. SQL cannot express the stages, so the tests hold them
against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import lines, mixing, packing, quality, similar
from veilspark.llm.common import materialize

TOKENIZER = "byte_bpe_50k.json"

ORACLE_SQL = None


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts; the rest go.

    Nulls count as empty values, repeated rows are judged alike, a probability of one half keeps, and all of an empty table or one
    without labels of both kinds stays.
    """
    scored = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("_vs_quality >= 0.5").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with chunks of lines and passages that occurred before cut from their texts.

    The occurrence of the least id stays, null ids first; null and empty texts stay as they are; rows of one id and text
    share a decision; an empty table stays empty.
    """
    return lines.dedup(docs).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, a similarity of 0.8 or more).

    The least id stays; texts without words, nulls among them, are alike; of repeated rows one stays; rows with null
    ids stay; an empty table stays empty.
    """
    return similar.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to the target weights takes them, three times at most.

    Null sources are a source of their own; repeated rows share a decision; documents without words are taken like
    others of their source; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids; null texts give their end id, every row is packed."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixture),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
