"""Joins with key checks, and the instrument dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators.calendar import contract_parts


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Fail if a key repeats.  Counting is map-side combined; at most one row reaches the driver."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if repeated.limit(1).count():
        raise ValueError(f"keys are not unique: {keys}")
    return df


def unique_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows; a repeated key ends the query.  The check is a window on the keys inside the plan,
    so a join on them uses its shuffle and nothing runs while the query is built."""
    repeated = F.raise_error(F.lit(f"keys are not unique: {keys}")).cast("boolean")
    seen = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return (
        df.withColumn("rows_of_key", seen)
        .filter(F.when(F.col("rows_of_key") > 1, repeated).otherwise(True))
        .drop("rows_of_key")
    )


def merge_unique(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """1:1 join; a key repeated on either side ends the query."""
    return unique_rows(left, keys).join(unique_rows(right, keys), keys, how)


def merge_many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join onto a table with unique keys; Spark broadcasts it when its size allows."""
    return left.join(unique_rows(right, keys), keys, "left")


def reconcile_instruments(symbols: DataFrame, master: DataFrame) -> DataFrame:
    """Root of each symbol and whether the dimension knows it."""
    part = contract_parts("symbol", 2026)["root_symbol"]
    known = master.select(F.col("root").alias("symbol"), F.lit(True).alias("is_root"))
    df = symbols.join(known, "symbol", "left")
    df = df.withColumn("root", F.coalesce(part, F.when(F.col("is_root"), F.col("symbol"))))
    out = df.join(master.withColumn("known", F.lit(True)), "root", "left")
    return out.select(
        "symbol", "root",
        F.when(F.col("known"), "configured").otherwise("missing").alias("metadata_status"),
        "tick_value", "multiplier",
    )


def tick_economics(master: DataFrame) -> DataFrame:
    """Per root: repeats, nonpositive values and tick values that do not match the multiplier."""
    gap = F.abs(F.col("multiplier") * F.col("tick_size") - F.col("tick_value"))
    return master.groupBy("root").agg(
        (F.count(F.lit(1)) - 1).alias("duplicate_roots"),
        F.count_if((F.col("multiplier") <= 0) | (F.col("margin") <= 0)).alias("nonpositive_values"),
        F.count_if(gap > 1e-9).alias("broken_tick_values"),
    )


def keep_last(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Last row of each key.  A mergeable maximum, so a hot key is reduced before the shuffle."""
    newest = F.max(F.struct(*order, *values)).alias("m")
    return df.groupBy(*keys).agg(newest).select(*keys, *[F.col(f"m.{v}").alias(v) for v in values])
