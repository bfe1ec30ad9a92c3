"""Training-data pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's input.

toxicity drops what it rejects; near-duplicates keep one document of each group; decontamination drops documents that hold
benchmark items; mixing repeats and drops documents towards the source targets; the last stage writes token shards and
returns what they hold.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import contamination, mixing, neardup, tokens, toxicity
from tablewright.llm.common import small_batches
from tablewright.queries.base import table
from tablewright.session import durable


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the grammar, learned from the labels, does not score as toxic. Null and empty texts stay; repeated rows share a verdict; without
    labels the seeds decide; further columns ride along under any name; an empty table stays empty."""
    grammar = toxicity.learn(toxicity.labelled(docs, table(spark, sf_dir, "labels")))
    with small_batches(spark):  # whole texts go to Python: written here, while the bound on a batch holds
        return durable(docs.where(toxicity.accepts(F.col("text"), grammar)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the smallest doc_id, null last. Null and empty texts are one group; repeated rows become one; further columns ride
    along; an empty table stays empty."""
    return neardup.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark item. Null and empty texts stay; repeated rows share a verdict; without benchmark rows all stay; further columns ride
    along; an empty table stays empty."""
    return contamination.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, 0 to 2 times. Rows without words are taken once; a null source is a source; of repeated rows k of n are
    taken; further columns ride along; an empty table stays empty."""
    return mixing.mixed(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document, as ``tokens.report`` returns it: null and empty texts have the end id only, repeated rows follow each other, further
    columns are ignored, an empty table gives an empty result."""
    return tokens.report(docs, public_tokenizers.path("word_bpe_49k.json"), share=0.4)  # the workers live on into other stages


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", source_mixing),
    ("token_shards", token_shards),
]

ORACLE_SQL = None  # fitted grammar, SimHash and tokenizer are beyond SQL; tests/llm checks the stages by brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
