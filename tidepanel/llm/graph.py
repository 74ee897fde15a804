"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.session import cut_lineage

TASK_ROWS = 100_000


def tasks(rows: int, each: int = TASK_ROWS) -> int:
    """Tasks for a table of known size, so that small tables do not become many tiny files."""
    return max(1, -(-rows // each))


def compact(df: DataFrame, each: int = TASK_ROWS) -> DataFrame:
    """A checkpoint of the table with about ``each`` rows a task."""
    held = cut_lineage(df)
    return held.coalesce(tasks(held.count(), each))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b): the smallest node that links reach.

    Each round joins the edges with the smallest neighbour of a node; no list of neighbours is
    gathered, so a node with many links is a skewed join and not a large group.  The rounds end when
    the edges are stars around their smallest node, after a number of rounds that grows with the
    logarithm of the number of nodes.
    """
    stars = compact(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    n = tasks(2 * stars.count())
    state = None
    while True:
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")).coalesce(n)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct().coalesce(n)
        least = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(n)
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = cut_lineage(moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct().coalesce(n))
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
