"""Time zones, sessions, bars and shared calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalars import clip, col, ratio

NEW_YORK = "America/New_York"
SESSION_OPEN_HOUR = 18
SESSION_MINUTES = 23 * 60


def strict_utc(local: str | Column, zone: str | Column = NEW_YORK) -> dict[str, Column]:
    """UTC of a local wall time plus flags for the two wall times DST makes impossible.

    ``to_utc_timestamp`` never fails, so a skipped time is one that does not come back and a
    repeated time is one whose UTC plus an hour reads the same.
    """
    local = col(local)
    utc = F.to_utc_timestamp(local, zone)
    return {
        "utc": utc,
        "nonexistent": F.from_utc_timestamp(utc, zone) != local,
        "ambiguous": (F.from_utc_timestamp(utc + F.expr("INTERVAL 1 HOUR"), zone) == local)
        | (F.from_utc_timestamp(utc - F.expr("INTERVAL 1 HOUR"), zone) == local),
    }


def assert_strict_utc(df: DataFrame, local: str, zone: str = NEW_YORK) -> DataFrame:
    """Add ``timestamp_utc``; a skipped or repeated wall time fails the job."""
    parts = strict_utc(local, zone)
    checked = F.when(
        parts["nonexistent"] | parts["ambiguous"],
        F.raise_error(F.concat(F.lit("impossible local time: "), col(local).cast("string"))),
    ).otherwise(parts["utc"])
    return df.withColumn("timestamp_utc", checked)


def local_time(utc: str | Column, zone: str = NEW_YORK) -> Column:
    return F.from_utc_timestamp(col(utc), zone)


def local_minutes(utc: str | Column, zone: str = NEW_YORK) -> Column:
    local = local_time(utc, zone)
    return F.hour(local) * 60 + F.minute(local)


def trading_date(
    utc: str | Column, zone: str = NEW_YORK, open_hour: int = SESSION_OPEN_HOUR
) -> Column:
    local = local_time(utc, zone)
    return F.date_add(F.to_date(local), (F.hour(local) >= open_hour).cast("int"))


CONTRACT_PATTERN = r"^(.+)([FGHJKMNQUVXZ])([0-9]{1,2})$"


def contract_parts(symbol: str | Column, as_of_year: int) -> dict[str, Column]:
    """Root, month code and year of a futures-style symbol; NULL parts when it is not one."""
    symbol = col(symbol)
    digits = F.regexp_extract(symbol, CONTRACT_PATTERN, 3)
    found = F.length(digits) > 0
    number = digits.try_cast("int")
    in_decade = number + (as_of_year - as_of_year % 10)
    one_digit = F.when(in_decade < as_of_year - 5, in_decade + 10).otherwise(in_decade)
    return {
        "root_symbol": F.when(found, F.regexp_extract(symbol, CONTRACT_PATTERN, 1)),
        "contract_month_code": F.when(found, F.regexp_extract(symbol, CONTRACT_PATTERN, 2)),
        "contract_year": F.when(found, F.when(F.length(digits) == 1, one_digit).otherwise(number)),
    }


def minute_returns(bars: DataFrame) -> DataFrame:
    """Gap-aware one-minute return and the length of the gap before each row.

    Partitioned by symbol and trading date: a return never crosses a session, so a hot symbol
    still spreads over its sessions.
    """
    w = Window.partitionBy("symbol", "trading_date").orderBy("timestamp_utc")
    elapsed = F.unix_timestamp("timestamp_utc") - F.unix_timestamp(
        F.lag("timestamp_utc").over(w)
    )
    return bars.withColumns(
        {
            "return_1m": F.when(
                elapsed == 60, F.col("close") / F.lag("close").over(w) - 1.0
            ),
            "missing_minutes_before": F.coalesce(
                F.floor(elapsed / 60) - 1, F.lit(0)
            ).cast("long"),
        }
    )


def session_from_minutes(minutes: DataFrame) -> DataFrame:
    """Session bar with first/last by time, gap sums, root of squared returns, close return."""
    bars = minutes.groupBy("symbol", "trading_date").agg(
        F.min("timestamp_utc").alias("session_open_utc"),
        F.max("timestamp_utc").alias("session_close_utc"),
        F.min_by("open", "timestamp_utc").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "timestamp_utc").alias("close"),
        F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("observed_minutes"),
        F.sum("missing_minutes_before").alias("missing_minutes"),
        F.sqrt(F.coalesce(F.sum(F.pow("return_1m", F.lit(2))), F.lit(0.0))).alias(
            "realized_volatility_1m"
        ),
    )
    w = Window.partitionBy("symbol").orderBy("trading_date")
    return bars.withColumn(
        "close_to_close_return", F.col("close") / F.lag("close").over(w) - 1.0
    )


def session_anchor(date: str | Column, zone: str = NEW_YORK) -> Column:
    """UTC instant six hours before the trading date's local midnight."""
    return F.to_utc_timestamp(col(date).cast("timestamp"), zone) - F.expr("INTERVAL 6 HOURS")


def session_clock_bars(minutes: DataFrame, timeframe: int) -> DataFrame:
    """Tumbling bars on the session clock; the label comes from the clock, not from prints."""
    anchor = F.unix_timestamp(session_anchor("trading_date"))
    bucket = F.floor((F.unix_timestamp("timestamp_utc") - anchor) / (timeframe * 60))
    bars = (
        minutes.withColumn("session_bucket", bucket.cast("int"))
        .groupBy("symbol", "trading_date", "session_bucket")
        .agg(
            F.min_by("open", "timestamp_utc").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "timestamp_utc").alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("minute_count"),
        )
    )
    w = Window.partitionBy("symbol", "trading_date").orderBy("session_bucket")
    return bars.withColumns(
        {
            "timestamp_utc": F.timestamp_seconds(
                anchor + F.col("session_bucket") * (timeframe * 60)
            ),
            "return": F.col("close") / F.lag("close").over(w) - 1.0,
            "bar_return": F.col("close") / F.col("open") - 1.0,
        }
    )


def hour_bars(minutes: DataFrame) -> DataFrame:
    """UTC hour bars inside (symbol, trading date); known once their last minute is."""
    return (
        minutes.withColumn("hour_start_utc", F.date_trunc("hour", "timestamp_utc"))
        .groupBy("symbol", "trading_date", "hour_start_utc")
        .agg(
            F.min_by("open", "timestamp_utc").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "timestamp_utc").alias("close"),
            F.sum("volume").alias("volume"),
            F.count(F.lit(1)).alias("observed_minutes"),
            F.max("timestamp_utc").alias("feature_available_at_utc"),
        )
    )


def plain_hour_bars(minutes: DataFrame) -> DataFrame:
    """Left-labelled hour bars over all sessions, empty hours dropped."""
    return (
        minutes.groupBy("symbol", F.window("timestamp_utc", "1 hour").alias("w"))
        .agg(
            F.min_by("open", "timestamp_utc").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "timestamp_utc").alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select(
            "symbol", F.col("w.start").alias("timestamp_utc"), "open", "high", "low", "close",
            "volume",
        )
    )


def session_minute(utc: str | Column) -> Column:
    return F.pmod(local_minutes(utc) - 18 * 60, F.lit(24 * 60))


def time_quartile(minute: Column) -> Column:
    return (clip(F.floor(minute / (SESSION_MINUTES / 4)), 0, 3) + 1).cast("int")


def window_summary(
    bars: DataFrame, masks: dict[str, tuple[Column, int]], value: str = "bar_return"
) -> DataFrame:
    """Compounded return, deviation and volume of several clock windows in one pass.

    A window with fewer bars than its minimum is blank.
    """
    aggregates = []
    for name, (mask, _) in masks.items():
        x = F.when(mask, F.col(value))
        aggregates += [
            F.product(x + 1.0).alias(f"{name}_growth"),
            F.stddev_samp(x).alias(f"{name}_deviation"),
            F.sum(F.when(mask, F.col("volume"))).alias(f"{name}_total"),
            F.count_if(mask).alias(f"{name}_bars"),
        ]
    grouped = bars.groupBy("symbol", "trading_date").agg(*aggregates)
    out = [F.col("symbol"), F.col("trading_date")]
    for name, (_, least) in masks.items():
        enough = F.col(f"{name}_bars") >= least
        out += [
            F.when(enough, F.col(f"{name}_growth") - 1.0).alias(f"{name}_return"),
            F.when(enough, F.col(f"{name}_deviation")).alias(f"{name}_volatility"),
            F.when(enough, F.col(f"{name}_total")).alias(f"{name}_volume"),
            F.when(enough, F.col(f"{name}_bars")).alias(f"{name}_bars"),
        ]
    return grouped.select(*out)


def number_calendar(df: DataFrame, time: str, name: str = "cal") -> DataFrame:
    """Add the position of ``time`` among all distinct times of the panel.

    Distinct times are one row per session or bar, whatever the number of symbols or raw rows,
    so the one ordered pass over them stays small; the panel itself is never sorted globally.
    """
    times = df.select(time).distinct().withColumn(
        name, F.row_number().over(Window.orderBy(time)).cast("int")
    )
    return df.join(times, time)


def densify(df: DataFrame, key: str = "symbol", time: str = "trading_date", name: str = "cal") -> DataFrame:
    """One row per key and calendar position, values NULL where the key did not print.

    Used where a result is defined on every calendar row of every series (zero-filled returns).
    The calendar is one sorted array from a scalar subquery, exploded per distinct key.
    """
    times = df.agg(F.array_sort(F.collect_set(time)).alias("times")).scalar()
    grid = df.select(key).distinct().select(key, F.posexplode(times).alias(name, time))
    return grid.withColumn(name, F.col(name) + 1).join(df, [key, time], "left")


def in_session_lag(x: str | Column, order: str = "timestamp_utc", k: int = 1) -> Column:
    """Value k bars back when that bar belongs to the same session."""
    w = Window.partitionBy("symbol", "trading_date").orderBy(order)
    return F.lag(col(x), k).over(w)


def bar_ordinals(df: DataFrame, order: str = "timestamp_utc") -> DataFrame:
    """Ordinal and reverse ordinal (from zero) of each bar inside its session."""
    w = Window.partitionBy("symbol", "trading_date")
    return df.withColumns(
        {
            "ordinal": F.row_number().over(w.orderBy(order)) - 1,
            "reverse_ordinal": F.row_number().over(w.orderBy(F.col(order).desc())) - 1,
        }
    )


def preclose_flag(order: str = "timestamp_utc") -> Column:
    """Third-to-last bar of the session on the product's own clock."""
    w = Window.partitionBy("symbol", "trading_date").orderBy(F.col(order).desc())
    return F.row_number().over(w) == 3


def daily_value(
    bars: DataFrame, column: str, reducer: str, shift_days: int, name: str
) -> DataFrame:
    """Attach the daily first/max/min of calendar day minus k; a missing day stays NULL."""
    fn = {
        "first": F.min_by(column, "timestamp_utc"),
        "max": F.max(column),
        "min": F.min(column),
    }[reducer]
    day = F.to_date("timestamp_utc")
    daily = (
        bars.groupBy("symbol", day.alias("source_day"))
        .agg(fn.alias(name))
        .select("symbol", F.date_add("source_day", shift_days).alias("day"), name)
    )
    return bars.withColumn("day", day).join(daily, ["symbol", "day"], "left").drop("day")


def fill_calendar(
    daily: DataFrame, calendar: DataFrame, value: str, key: str = "symbol"
) -> DataFrame:
    """Zero-filled value on every calendar date for every key.

    The sorted calendar is a scalar subquery (one array, one entry per session) exploded per
    distinct key; only keys x dates rows are ever made.
    """
    dates = calendar.agg(F.array_sort(F.collect_set("trading_date")).alias("dates")).scalar()
    grid = daily.select(key).distinct().select(key, F.explode(dates).alias("trading_date"))
    return grid.join(daily, [key, "trading_date"], "left").withColumn(
        value, F.coalesce(F.col(value), F.lit(0.0))
    )


def running_session_state(minutes: DataFrame) -> DataFrame:
    """Running high/low midpoint, range location, VWAP and in-session returns."""
    w = Window.partitionBy("symbol", "trading_date").orderBy("timestamp_utc")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    minute = session_minute("timestamp_utc")
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    out = minutes.withColumns(
        {
            "session_minute": minute,
            "time_quartile": time_quartile(minute),
            "running_high": F.max("high").over(run),
            "running_low": F.min("low").over(run),
            "cumulative_volume": F.sum("volume").over(run),
            "cumulative_amount": F.sum(typical * F.col("volume")).over(run),
            "session_open": F.first("open").over(run),
            "return_5m": F.col("close") / F.lag("close", 5).over(w) - 1.0,
        }
    )
    span = F.col("running_high") - F.col("running_low")
    span = F.when(span != 0, span)
    middle = (F.col("running_high") + F.col("running_low")) / 2.0
    location = (F.col("close") - F.col("running_low")) / span
    vwap = ratio("cumulative_amount", F.col("cumulative_volume").cast("double"))
    return out.withColumns(
        {
            "running_midpoint": middle,
            "range_location": location,
            "range_quartile": clip(F.ceil(clip(location, 0.0, 1.0) * 4.0), 1, 4).cast("int"),
            "running_vwap": vwap,
            "midpoint_displacement": (F.col("close") - middle) / span,
            "vwap_deviation": F.col("close") / vwap - 1.0,
            "open_deviation": F.col("close") / F.col("session_open") - 1.0,
            "running_range_fraction": span / F.col("session_open"),
        }
    )
