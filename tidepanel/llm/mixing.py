"""Mix sources to target weights by capped water-filling.

The target of all sources together is a share of all words.  A source never gives more than a
maximum number of epochs; what it cannot give goes to the open sources by weight, until no source
is above its limit.  The fixed point is ``min(limit, level * weight)``, found from one ordered pass
over the table of sources instead of a loop.

A source's target is then taken as whole repetitions of all its documents and, for the rest, one
more repetition of the documents that come first in a seeded order.  The order is cut where the
running size reaches the rest, so the taken size misses the target by half a document at most.  The
cut is found from sums over hash ranges and one ordered range per source, never from an ordered
source.  It is one hash value per source, so the decision about a row needs that row alone.

Edge cases: a null text has size 0; null is a source, last in order; repeated rows with the same id
and text share a place in the order and are taken together; rows of size 0 follow the same cut; an
empty table gives an empty result; columns besides the named ones pass through untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.texts import WORD
from tidepanel.session import cut_lineage

#: Hex digits of the seeded hash that name a range; 4,096 ranges for each source.
RANGE_DIGITS = 3
#: A table of sources up to this many rows (under 200 MB) is sent to all executors.
BROADCAST_SOURCES = 1_000_000


def word_count(text: Column) -> Column:
    """Words between ASCII white space; none in null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_place(seed: str, doc_id: Column, text: Column) -> Column:
    """Where a row stands in the seeded order of its source."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("|"),
                          F.coalesce(F.md5(text), F.lit("null"))))


def water_fill(sources: DataFrame, weights: Sequence[int], share: tuple[int, int], epochs: int) -> DataFrame:
    """Add ``target`` to (source, source_size), which has one row for each source."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumns({
        "weight": F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")),
        "limit_size": F.col("source_size") * epochs,
    })
    tight = Window.orderBy(F.col("limit_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    num, den = share
    levelled = ranked.withColumns({
        "wanted": F.sum("source_size").over(everything) * num,
        "spent": F.coalesce(F.sum("limit_size").over(before), F.lit(0)),
        "left": F.sum("weight").over(tight.rowsBetween(0, Window.unboundedFollowing)),
    }).withColumn(
        "open", F.col("limit_size") * F.col("left") * den > F.col("weight") * (F.col("wanted") - F.col("spent") * den)
    )
    held = F.sum(F.when(F.col("open"), F.lit(0)).otherwise(F.col("limit_size"))).over(everything)
    free = F.sum(F.when(F.col("open"), F.col("weight")).otherwise(F.lit(0.0))).over(everything)
    target = F.col("weight") * (F.col("wanted") - held * den) / (free * den)
    return levelled.select(
        "source", "source_size",
        F.when(F.col("open"), target).otherwise(F.col("limit_size").cast("double")).alias("target"),
    )


def plan_mixture(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2),
                 epochs: int = 2) -> DataFrame:
    """One row for each source: target, whole repetitions and the place that ends the last one.

    ``sized`` has source, size and place.
    """
    ranges = cut_lineage(
        sized.groupBy("source", F.substring("place", 1, RANGE_DIGITS).alias("range")).agg(F.sum("size").alias("size"))
    )
    sources = water_fill(ranges.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    sources = sources.withColumn("whole", whole.cast("long")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )
    running = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.withColumn("start", F.coalesce(F.sum("size").over(running), F.lit(0))).alias("r")
    s = sources.alias("s")
    cuts = (
        starts.join(s, F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.start") <= F.col("s.rest")))
        .where(F.col("s.rest") > 0)
        .groupBy(F.col("s.source").alias("source"))
        .agg(F.max_by("range", "range").alias("range"), F.max_by("start", "range").alias("start"),
             F.first("rest").alias("rest"))
    )
    cuts = _small(cut_lineage(cuts)).alias("c")
    ends = (
        sized.select("source", "place", "size").alias("d")
        .join(cuts, F.col("d.source").eqNullSafe(F.col("c.source"))
              & (F.substring("d.place", 1, RANGE_DIGITS) == F.col("c.range")))
        .groupBy(F.col("c.source").alias("source"), "place")
        .agg(F.sum("size").alias("size"), F.first("start").alias("start"), F.first("rest").alias("rest"))
    )
    inner = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    taken = (
        ends.withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
        .where(2 * F.col("before") + F.col("size") <= 2 * F.col("rest"))
        .groupBy("source").agg(F.max("place").alias("last"))
    )
    c, t = cuts, taken.alias("t")
    plan = (
        s.join(c, F.col("s.source").eqNullSafe(F.col("c.source")), "left")
        .join(t, F.col("s.source").eqNullSafe(F.col("t.source")), "left")
        .select("s.source", "s.source_size", "s.target", "s.whole",
                F.coalesce(F.col("t.last"), F.col("c.range")).alias("last"))
    )
    return cut_lineage(plan)


def _small(table: DataFrame) -> DataFrame:
    """Send a table of sources to all executors only when its size is known to be small."""
    return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table


def with_repetitions(docs: DataFrame, plan: DataFrame, source: str, place: Column) -> DataFrame:
    """Add ``__size`` of the plan's source, ``__target`` and ``__times``, how often a row is in the mix."""
    p = _small(plan.select(F.col("source").alias("__source"), F.col("source_size").alias("__size"),
                           F.col("target").alias("__target"), "whole", F.col("last").alias("__last")))
    p = p.withColumnRenamed("whole", "__whole")
    more = F.coalesce((F.col("__place") <= F.col("__last")).cast("long"), F.lit(0))
    return (
        docs.withColumn("__place", place).join(p, F.col(source).eqNullSafe(F.col("__source")), "left")
        .withColumn("__times", (F.col("__whole") + more).cast("int"))
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[int] = (5, 2, 1), share: tuple[int, int] = (3, 2), epochs: int = 2,
        seed: str = "mix") -> DataFrame:
    """The mixed corpus: every row as often as its source's target asks, in the columns of ``docs``."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(source).alias("source"), F.col(text).alias("text"),
                       seeded_place(seed, F.col(doc_id), F.col(text)).alias("place"))
    sized = cut_lineage(rows.select("source", word_count(F.col("text")).alias("size"), "place"))
    plan = plan_mixture(sized, weights, share, epochs)
    mixed = with_repetitions(rows.drop("text"), plan, "source", F.col("place"))
    return (
        mixed.where(F.col("__times") > 0)
        .withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__times"))))
        .select("row.*")
    )


def mixture_report(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix takes of it."""
    sized = cut_lineage(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        seeded_place(seed, F.col("doc_id"), F.col("text")).alias("place"),
    ))
    plan = plan_mixture(sized)
    return with_repetitions(sized, plan, "source", F.col("place")).select(
        "doc_id", "size", F.col("__size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("size") * F.col("__times")).alias("taken"), "source", F.col("__times").alias("times"),
    )
