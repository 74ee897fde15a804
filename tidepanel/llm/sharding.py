"""Shards of near-equal bytes by longest-processing-time scheduling.

Rows with equal texts form a group that must stay together.  Groups sorted by size go to the
least-loaded shard through a heap.  One heap over all groups would be one task, so the schedule is a
tree: groups fall into buckets by hash, each bucket is scheduled onto ``BINS`` bins, and the bins of
``FAN`` buckets are scheduled together as the groups of the next level, until one bucket is left, which
is scheduled onto the shards.  Groups above a ``HEAVY``-th of a shard, of which there are at most
``HEAVY`` times the shards, skip the tree and meet the last level as they are, where the largest come
first.  A bin then is a thousandth of a shard at most, so shards come out equal to far less than that.
Small inputs have few groups a bucket, so bins hold single groups and the result is the plain schedule.

Slots number a shard's rows from 0.  Rows are counted by shard and range of a hash, ranges are offset
by the counts before them, and only a range is ordered.

Groups are told apart by the SHA-256 of the text.  Edge cases: a null text has size 1 and forms a
group with other nulls; repeated rows get a slot each; an empty table gives an empty result; columns
besides the named ones are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.session import cut_lineage

SHARDS = 16
BINS = 256
HEAVY = 1024
FAN = 64
GROUPS_A_BUCKET = 20_000
LEAST_BUCKETS = 64
ROWS_A_RANGE = 20_000


def schedule(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each group: largest first, to the least-loaded shard, ties to the lower number."""
    heap = [(0, s) for s in range(shards)]
    out = np.empty(len(sizes), np.int32)
    for i in np.argsort(-sizes, kind="stable"):
        load, shard = heapq.heappop(heap)
        out[i] = shard
        heapq.heappush(heap, (load + int(sizes[i]), shard))
    return out


def _level(items: DataFrame, bins: int) -> DataFrame:
    """Schedule each bucket's items (bucket, item, size) onto its bins; adds ``bin``."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "item"], ascending=[False, True], ignore_index=True)
        frame["bin"] = schedule(frame["size"].to_numpy(), bins)
        return frame

    return items.groupBy("bucket").applyInPandas(one, "bucket long, item string, size long, bin int")


def assign_groups(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``item, shard`` for groups (item, size)."""
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    heavy = F.col("size") * (shards * HEAVY) > total
    buckets = max(LEAST_BUCKETS, -(-n // GROUPS_A_BUCKET))
    level = groups.where(~heavy).select(F.pmod(F.xxhash64("item"), F.lit(buckets)).alias("bucket"), "item", "size")
    large = groups.where(heavy).select(F.lit(0).cast("long").alias("bucket"), "item", "size")
    steps = []
    while buckets > 1:
        placed = cut_lineage(_level(level, BINS))
        steps.append(placed)
        level = (
            placed.groupBy("bucket", "bin").agg(F.sum("size").alias("size"))
            .select(F.floor(F.col("bucket") / FAN).alias("bucket"),
                    F.concat_ws(":", F.lit("bin"), "bucket", "bin").alias("item"), "size")
        )
        buckets = -(-buckets // FAN)
    top = cut_lineage(_level(level.unionByName(large), shards)).select("item", F.col("bin").alias("shard"))
    known = top
    for placed in reversed(steps):
        inner = placed.select("item", F.concat_ws(":", F.lit("bin"), "bucket", "bin").alias("__bin"))
        below = inner.join(known.select(F.col("item").alias("__bin"), "shard"), "__bin").select("item", "shard")
        known = below
    return known.unionByName(top.where(~F.col("item").startswith("bin:")))


def with_slots(rows: DataFrame, n_rows: int) -> DataFrame:
    """Add ``slot``, a number from 0 without gaps inside each ``shard``, in the order of ``place``."""
    ranges = max(8, -(-n_rows // (SHARDS * ROWS_A_RANGE)))
    ranged = rows.withColumn("__range", F.pmod(F.xxhash64("place.doc_id", "place.item"), F.lit(ranges)))
    counts = ranged.groupBy("shard", "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("shard", "__range").orderBy("place")
    return (
        ranged.withColumn("__at", F.row_number().over(inside)).join(offsets, ["shard", "__range"])
        .withColumn("slot", (F.col("__offset") + F.col("__at") - 1).cast("long")).drop("__range", "__at", "__offset")
    )


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """Per row: size, checksum, shard and slot; equal texts share a shard and shards are near equal."""
    value = F.col(text)
    rows = cut_lineage(docs.select(
        F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(value), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(value, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.sha2(value, 256), F.lit("null")).alias("item"),
    ))
    groups = cut_lineage(rows.groupBy("item").agg(F.sum("size").alias("size")))
    placed = assign_groups(groups, shards)
    sharded = cut_lineage(
        rows.join(placed, "item").withColumn(
            "place", F.struct("doc_id", "item", F.monotonically_increasing_id().alias("n")))
    )
    return with_slots(sharded, sharded.count()).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
