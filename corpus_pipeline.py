"""A corpus pipeline of five stages: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), decides over all rows of ``docs`` and returns what goes on, in
the columns of ``docs``; the last one returns where each row of the mix lies.  ``run`` writes each
stage's rows to the shared folder and reads them again for the next, so a lost executor repeats a stage
and not the pipeline.

Edge cases follow the operators: null and empty texts fail the quality rules; of repeated rows one
stays after the near duplicates, the one with the smallest id (null last); an empty table passes
through all stages.  Columns besides doc_id, text and source are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import decontaminate, jaccard, lines, mixing, sharding
from tidepanel.llm.texts import KEY, original, with_keys, without
from tidepanel.session import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted by the removal of boilerplate lines.

    Exact copies count once, so a copy group goes on whole and the next stage keeps one of it.
    """
    rows = with_keys(docs)
    return original(without(rows, lines.line_frequency(rows, distinct=True).where(~F.col("kept"))), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents, and all documents without words."""
    rows = with_keys(docs)
    found = jaccard.similar_documents(rows).where("n_shingles > 0")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *KEY)
    first = found.groupBy("root").agg(F.min(place).alias("first"))
    copies = found.join(first, "root").where(place != F.col("first"))
    return original(without(rows, copies), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    rows = with_keys(docs)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return original(without(rows, decontaminate.contamination(rows, benchmark).where("contaminated")), docs.columns)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as their source's target asks."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of the mix."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixture", source_mixture),
    ("shards", shards),
]

#: A longest-first schedule is not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each to the written rows of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
