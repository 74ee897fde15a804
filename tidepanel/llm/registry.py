"""The registered corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import (
    backoff, decontaminate, jaccard, licences, lines, mixing, negatives, personal, quality, quantised, search, sharding,
    sql, texts, tokens,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_frequency(_table(spark, folder, "documents")).drop(*texts.KEY)


def op2_longest_first_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, folder, "documents"))


def op3_jaccard_components(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard.similar_documents(_table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op4_source_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture_report(_table(spark, folder, "documents"))


def op5_personal_spans(spark: SparkSession, folder: str) -> DataFrame:
    return personal.span_report(_table(spark, folder, "documents"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = tokens.count_tokens(_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op7_licence_lines(spark: SparkSession, folder: str) -> DataFrame:
    return licences.licence_report(_table(spark, folder, "documents"))


def op8_benchmark_overlap(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.drop(*texts.KEY)


def op9_quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op10_backoff_scores(spark: SparkSession, folder: str) -> DataFrame:
    return backoff.scores(_table(spark, folder, "documents")).drop(*texts.KEY)


def op11_accumulator_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.hard_negatives(_table(spark, folder, "embeddings"))


def op13_similar_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return quantised.similar_vectors(_table(spark, folder, "embeddings"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_line_frequency, op2_longest_first_shards, op3_jaccard_components, op4_source_mixture, op5_personal_spans,
        op6_token_counts, op7_licence_lines, op8_benchmark_overlap,
        op9_quality_scores, op10_backoff_scores, op11_accumulator_search, op12_hard_negatives, op13_similar_vectors,
        pipeline,
    )
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
