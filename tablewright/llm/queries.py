"""One registered query for each operator, over the whole of its table, and the pipeline.

SQL twins stand in twins.py. Hashes, fitted trees, tokenizers, parsers and iterations are beyond SQL: those queries have none and are tested
against brute force in tests/llm.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import alignment, contamination, language, mixing, neardup, pages, periodic, pii, quality, tokens, toxicity, twins, urls, vectors
from tablewright.queries.base import query, table

TOKENIZER = "word_bpe_49k.json"
PAIR = "byte_bpe_50k.json", "piece_bpe_32k.model"


@query("op1_quality_ratio")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_pii_boosting")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@query("op4_url_ratio", twins.URLS)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@query("op5_wavelet_tokens")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.report(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query("op6_language_ranks", twins.LANGUAGE)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query("op7_toxicity_grammar")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.learn(toxicity.labelled(docs, table(spark, sf_dir, "labels"))))


@query("op8_simhash_groups")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(table(spark, sf_dir, "documents"))


@query("op9_entropy_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


@query("op10_host_extraction")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, PAIR))


@query("op12_embedding_codes")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.report(table(spark, sf_dir, "embeddings"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
