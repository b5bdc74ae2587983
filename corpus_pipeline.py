"""A training corpus from raw documents: each stage takes what the one before kept.

Toxic documents go, then those of low quality; of each group of near copies one document stays; documents that hold a
benchmark item go; what is left is encoded and decoded. All but the last stage return whole rows of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardwalk.llm import bpe, decontaminate, ngram_join, quality, toxicity
from boardwalk.llm.common import Scratch, read
from boardwalk.llm.ship import ship


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted chance of a toxic grade is below one half; fitted on the labelled ones among ``docs``."""
    ship(spark)
    return toxicity.accepted(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least one half; fitted on the labelled ones among ``docs``.

    A text without words has nothing to judge and stays.
    """
    ship(spark)
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    bare = F.coalesce(F.length(F.regexp_replace("text", "[ \\t-\\r]+", "")), F.lit(0)) == 0
    return quality.accepted(docs.where(~bare), model).union(docs.where(bare))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more on shingles of five words, the one with the smallest id."""
    ship(spark)
    return ngram_join.one_of_each(docs, ngram_join.Similarity(k=5, num=80, den=100))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens, and digests of the token ids and of the bytes that they decode to."""
    ship(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written as Parquet and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
