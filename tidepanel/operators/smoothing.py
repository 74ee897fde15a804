"""Recursive averages without a per-row loop."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.frames import ordered
from tidepanel.functions.scalars import col


def emas(
    df: DataFrame,
    wanted: dict[str, tuple[str | Column, float, int]],
    key: str,
    order: str,
) -> DataFrame:
    """Several averages y = (1-a) y[-1] + a x, seeded with the first value, in three windows.

    ``wanted`` maps a name to (input, a, least rows).  Rows are cut into blocks short enough
    that (1-a)^-i stays inside double range, so a value is its block's scaled prefix sum plus
    what earlier blocks ended with.  Blocks older than the ones kept weigh less than 1e-18.
    No Python and no recursion; all averages share the row numbering, the prefix-sum window and
    the carry window.
    """
    keep = {n: 1.0 - a for n, (_, a, _) in wanted.items()}
    fast, slow = min(keep.values()), max(keep.values())
    size = max(2, min(4096, int(200.0 * math.log(10.0) / -math.log(max(fast, 1e-30)))))
    back = max(1, math.ceil(18.0 * math.log(10.0) / (-math.log(slow) * size)))
    w = ordered(key, order)
    df = df.withColumn("__rn", F.row_number().over(w) - 1)
    rn = F.col("__rn")
    df = df.withColumns(
        {"__block": F.floor(rn / size).cast("int"), "__pos": (rn % size).cast("double")}
    )
    pos = F.col("__pos")
    inside = (
        Window.partitionBy(key, "__block")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    prefix = {}
    for n, (x, a, _) in wanted.items():
        weight = F.when(rn == 0, 1.0).otherwise(a)
        scaled = col(x) * weight * F.pow(F.lit(keep[n]), -pos)
        prefix[f"__c_{n}"] = F.pow(F.lit(keep[n]), pos) * F.sum(scaled).over(inside)
    df = df.withColumns(prefix)
    end = F.struct(F.col("__block").alias("b"), *[F.col(c) for c in prefix])
    frame = Window.partitionBy(key).orderBy(F.col("__block")).rangeBetween(-back, -1)
    df = df.withColumn(
        "__ends", F.collect_list(F.when(pos == size - 1, end)).over(frame)
    )
    out = {}
    for n, (_, _, least) in wanted.items():
        carried = F.aggregate("__ends", F.lit(0.0), _decayed(f"__c_{n}", keep[n], size))
        value = F.col(f"__c_{n}") + F.pow(F.lit(keep[n]), pos + 1.0) * carried
        out[n] = F.when(rn >= least - 1, value)
    return df.withColumns(out).drop("__rn", "__block", "__pos", "__ends", *prefix)


def _decayed(column: str, q: float, size: int):
    """Fold step adding one block end, decayed by the blocks since."""

    def step(total: Column, block_end: Column) -> Column:
        gap = (F.col("__block") - 1 - block_end["b"]) * float(size)
        return total + block_end[column] * F.pow(F.lit(q), gap)

    return step


def ema(
    df: DataFrame,
    name: str,
    x: str | Column,
    key: str,
    order: str,
    *,
    span: int | None = None,
    alpha: float | None = None,
    least: int = 1,
) -> DataFrame:
    a = alpha if alpha is not None else 2.0 / (span + 1.0)
    return emas(df, {name: (x, a, least)}, key, order)


def tema(df: DataFrame, name: str, x: str, key: str, order: str, period: int) -> DataFrame:
    one, two, three = (f"__{name}{i}" for i in (1, 2, 3))
    df = ema(df, one, x, key, order, span=period)
    df = ema(df, two, one, key, order, span=period)
    df = ema(df, three, two, key, order, span=period)
    return df.withColumn(
        name, 3.0 * F.col(one) - 3.0 * F.col(two) + F.col(three)
    ).drop(one, two, three)


def macd_signal(
    df: DataFrame, name: str, x: str, key: str, order: str, fast: int, slow: int, smooth: int
) -> DataFrame:
    f, s, d = (f"__{name}_{i}" for i in ("fast", "slow", "gap"))
    wanted = {f: (x, 2.0 / (fast + 1.0), 1), s: (x, 2.0 / (slow + 1.0), 1)}
    df = emas(df, wanted, key, order)
    df = df.withColumn(d, F.col(f) - F.col(s))
    return ema(df, name, d, key, order, span=smooth).drop(f, s, d)


def true_range(key: str, order: str) -> Column:
    """Greatest of the bar's range and both distances to the previous close."""
    previous = F.lag("close").over(ordered(key, order))
    return F.greatest(
        F.col("high") - F.col("low"),
        F.abs(F.col("high") - previous),
        F.abs(F.col("low") - previous),
    )


def wilder_atr(df: DataFrame, name: str, key: str, order: str, period: int) -> DataFrame:
    t = f"__{name}_tr"
    df = df.withColumn(t, true_range(key, order))
    return ema(df, name, t, key, order, alpha=1.0 / period).drop(t)
