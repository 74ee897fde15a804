"""Writers.  Spark's commit protocol makes each table appear whole or not at all."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version string, written long, table string, rows long"


def write_by_symbol(df: DataFrame, root: str, keep_other_symbols: bool = False) -> None:
    """Partition by symbol.  A full overwrite also removes symbols that are gone; with
    ``keep_other_symbols`` only the partitions present in ``df`` are replaced.

    Rows are spread over (symbol, trading month) first, so a large symbol is written by many
    tasks and a small one does not leave thousands of files.
    """
    spread = ["symbol"]
    for name in ("trading_date", "timestamp_utc"):
        if name in df.columns:
            spread.append(F.date_trunc("month", name))
            break
    (
        df.repartition(*spread)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if keep_other_symbols else "static")
        .option("compression", "zstd")
        .partitionBy("symbol")
        .parquet(root)
    )


def write_split(df: DataFrame, root: str) -> None:
    """Development and holdout in separate directories; embargo rows go to neither."""
    (
        df.filter(F.col("split").isin("development", "holdout"))
        .write.mode("overwrite")
        .option("compression", "zstd")
        .partitionBy("split", "symbol")
        .parquet(root)
    )


def catalog_summary(files: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: files, symbols, issues and the count per severity."""
    per_symbol = files.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    left = per_symbol.agg(
        F.sum("n").alias("files"),
        F.count_if(F.col("symbol") != "").alias("symbols"),
    )
    right = issues.agg(
        F.count(F.lit(1)).alias("issues"),
        F.count_if(F.col("severity").isin("critical", "high")).alias("blocking_issues"),
        *[
            F.count_if(F.col("severity") == s).alias(s)
            for s in ("critical", "high", "medium", "low")
        ],
    )
    row = right.select(F.struct(*right.columns).alias("r")).scalar()
    return left.select("files", "symbols", *[row[c].alias(c) for c in right.columns])


def write_catalog(files: DataFrame, issues: DataFrame, root: str) -> None:
    write_swapped({"manifest": files, "issues": issues, "summary": catalog_summary(files, issues)}, root)


def write_variants(df: DataFrame, root: str, *partitions: str) -> None:
    """One directory per variant holding its gross, net and sides: a series on the calendar, written by one task."""
    write_swapped({"variants": df.repartition(*partitions)}, root, partitions={"variants": partitions})


def write_swapped(tables: Mapping[str, DataFrame], root: str, partitions: Mapping[str, Sequence[str]] | None = None) -> None:
    """Write tables as one version that readers see whole or not at all.

    Each version has a folder of its own.  A manifest row with its number, and the rows of each table as read
    back, is appended last; readers take the newest manifest row, so a writer that dies leaves the
    version before it in place, and versions in use are never overwritten.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    counts = []
    for name, df in tables.items():
        writer = df.write.option("compression", "zstd")
        wanted = (partitions or {}).get(name)
        (writer.partitionBy(*wanted) if wanted else writer).parquet(f"{root}/{version}/{name}")
        counts.append((version, time.time_ns(), name, spark.read.parquet(f"{root}/{version}/{name}").count()))
    spark.createDataFrame(counts, MANIFEST).coalesce(1).write.mode("append").json(f"{root}/versions")


def read_swapped(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the newest whole version; a count that no longer fits its manifest ends the query."""
    row = spark.read.schema(MANIFEST).json(f"{root}/versions").where(F.col("table") == name).orderBy(F.desc("written")).first()
    if row is None:
        raise FileNotFoundError(f"{root} has no version of {name}")
    df = spark.read.parquet(f"{root}/{row['version']}/{name}")
    if df.count() != row["rows"]:
        raise ValueError(f"{name} of version {row['version']} is not what its manifest says")
    return df
