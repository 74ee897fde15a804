"""Panel-shaped inputs derived from the supplied star-schema and event tables.

Prices are whole ticks.  A print's position inside its bucket and its tick count share one
64-bit key, so first and last price are the plain minimum and maximum of a long.  That keeps
the largest aggregation of every job a hash aggregate with map-side combine; ordering by a
struct would fall back to sorting the raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.operators import calendar as cal
from tidepanel.session import cut_lineage

TICK_BITS = 21
POSITION_BITS = 42
TICK_MASK = (1 << TICK_BITS) - 1
TICKS_PER_POINT = 100_000.0
BASE_PRICE = 100.0

#: Minutes of the local day between which the prints of a session lie in ``release_tape``.
TAPE_START, TAPE_END = 600, 930


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tick_count(value: Column) -> Column:
    """A positive amount as ticks above the base price (log scale keeps it below 2**21)."""
    return F.floor(F.log1p(value) * TICKS_PER_POINT).cast("long")


def tick_price(ticks: Column) -> Column:
    return BASE_PRICE + ticks / TICKS_PER_POINT


def print_key(position: Column, ticks: Column) -> Column:
    """Position and price in one long; values that would not fit end the query instead of mixing."""
    fits = position.between(0, (1 << POSITION_BITS) - 1) & ticks.between(0, TICK_MASK)
    return (
        F.when(fits, F.shiftleft(position, TICK_BITS).bitwiseOR(ticks))
        .when(fits.isNull(), F.lit(None).cast("long"))
        .otherwise(F.raise_error(F.lit("print position or price is beyond the packed key")).cast("long"))
    )


def key_price(key: Column) -> Column:
    return tick_price(key.bitwiseAND(F.lit(TICK_MASK)))


def quotes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line item: symbol, trading date, position key, price and volume."""
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("symbol")
    )
    ticks = tick_count(F.col("l_extendedprice") / F.col("l_quantity"))
    return (
        table(spark, folder, "lineitem")
        .join(part, "l_partkey")
        .select(
            "symbol",
            F.to_date("l_shipdate").alias("trading_date"),
            print_key(F.col("l_orderkey") * 8 + F.col("l_linenumber"), ticks).alias("key"),
            tick_price(ticks).alias("price"),
            F.col("l_quantity").alias("volume"),
        )
    )


def session_bars(prints: DataFrame, *keys: str) -> DataFrame:
    """OHLCV per group from keyed prints; every aggregate is mergeable."""
    return (
        prints.groupBy(*keys)
        .agg(
            F.min("key").alias("first_key"),
            F.max("key").alias("last_key"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("observations"),
            F.sqrt(F.avg(F.pow(F.col("price") / 107.5 - 1.0, 2))).alias("realized_volatility_1m"),
        )
        .select(
            *keys,
            key_price(F.col("first_key")).alias("open"),
            "high",
            "low",
            key_price(F.col("last_key")).alias("close"),
            "volume",
            "observations",
            "realized_volatility_1m",
        )
    )


def session_panel(spark: SparkSession, folder: str) -> DataFrame:
    """(symbol, trading_date) panel with the close-to-close return of the symbol's own rows."""
    bars = session_bars(quotes(spark, folder), "symbol", "trading_date")
    w = Window.partitionBy("symbol").orderBy("trading_date")
    return bars.withColumns(
        {
            "close_to_close_return": F.col("close") / F.lag("close").over(w) - 1.0,
            "session_close_utc": F.col("trading_date").cast("timestamp")
            + F.expr("INTERVAL 22 HOURS"),
        }
    )


def session_returns(spark: SparkSession, folder: str) -> DataFrame:
    """Returns from print to print inside each session of the panel.

    The given prints carry a position and no time of day; the position's remainder stands for the
    minute, so a session is at most 1440 rows before any window sees it.
    """
    minute = F.pmod(F.shiftright("key", TICK_BITS), F.lit(1440))
    bars = quotes(spark, folder).groupBy("symbol", "trading_date", minute.alias("minute")).agg(
        F.max("key").alias("last_key"), F.sum("volume").alias("volume")
    )
    w = Window.partitionBy("symbol", "trading_date").orderBy("minute")
    close = key_price(F.col("last_key"))
    return bars.select(
        "symbol", "trading_date", "minute", "volume", (close / F.lag(close).over(w) - 1.0).alias("return_1m")
    )


def release_tape(spark: SparkSession, folder: str) -> DataFrame:
    """Open and close per minute of the local day in which the panel printed, between ``TAPE_START`` and ``TAPE_END``.

    As in ``session_returns`` the position's remainder stands for the minute.
    """
    minute = TAPE_START + F.pmod(F.shiftright("key", TICK_BITS), F.lit(TAPE_END - TAPE_START)).cast("int")
    bars = quotes(spark, folder).groupBy("symbol", "trading_date", minute.alias("minute")).agg(
        F.min("key").alias("first_key"), F.max("key").alias("last_key")
    )
    return bars.select(
        "symbol", "trading_date", "minute", key_price(F.col("first_key")).alias("open"), key_price(F.col("last_key")).alias("close")
    )


def week_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Session panel whose sessions are calendar weeks: every symbol prints in each of them."""
    weekly = quotes(spark, folder).withColumn("trading_date", F.trunc("trading_date", "week"))
    return session_bars(weekly, "symbol", "trading_date")


def settled_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The session panel, checkpointed: for plans that read it along several branches."""
    return cut_lineage(session_panel(spark, folder))


def settled_bars(spark: SparkSession, folder: str, minutes: int) -> DataFrame:
    return cut_lineage(clock_bars(spark, folder, minutes))


def order_panel(spark: SparkSession, folder: str) -> DataFrame:
    """Thin second panel: order priority as symbol, total price as price."""
    ticks = tick_count(F.col("o_totalprice"))
    prints = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        F.to_date("o_orderdate").alias("trading_date"),
        print_key(F.col("o_orderkey"), ticks).alias("key"),
        tick_price(ticks).alias("price"),
        F.lit(1.0).alias("volume"),
    )
    return session_bars(prints, "symbol", "trading_date")


def minute_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical one-minute bars per event type with the New York trading date."""
    ticks = tick_count(F.col("value"))
    stamp = F.col("ts").cast("timestamp")
    micros = F.unix_micros(stamp)
    prints = table(spark, folder, "events").select(
        F.col("event_type").alias("symbol"),
        F.date_trunc("minute", stamp).alias("timestamp_utc"),
        print_key(F.pmod(micros, F.lit(60_000_000)), ticks).alias("key"),
        tick_price(ticks).alias("price"),
        (F.pmod(F.col("user_id"), F.lit(100)) + 1).alias("volume"),
    )
    bars = (
        prints.groupBy("symbol", "timestamp_utc")
        .agg(
            F.min("key").alias("first_key"),
            F.max("key").alias("last_key"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.sum("volume").alias("volume"),
        )
        .select(
            "symbol",
            "timestamp_utc",
            key_price(F.col("first_key")).alias("open"),
            "high",
            "low",
            key_price(F.col("last_key")).alias("close"),
            "volume",
        )
    )
    return bars.withColumn("trading_date", cal.trading_date("timestamp_utc"))


def minute_returns(spark: SparkSession, folder: str) -> DataFrame:
    return cal.minute_returns(minute_bars(spark, folder))


def clock_bars(spark: SparkSession, folder: str, minutes: int) -> DataFrame:
    return cal.session_clock_bars(minute_bars(spark, folder), minutes)
