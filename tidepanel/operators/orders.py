"""Stop-order candidates from completed hour bars: price, protective levels and expiry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import frames
from tidepanel.operators import smoothing
from tidepanel.operators.calendar import daily_value
from tidepanel.operators.stateful import parabolic_sar

KEY, ORDER = "symbol", "timestamp_utc"


@dataclass(frozen=True)
class OrderRule:
    name: str
    bars_valid: int
    target_multiple: float
    target_period: int
    stop_multiple: float
    stop_period: int
    tick: float


# Validity, protective ATR multiples and periods, tick size of the seven rules.
RULES = {
    "bollinger_breakout": OrderRule("bollinger_breakout", 55, 2.6, 15, 2.1, 15, 0.00005),
    "dual_macd": OrderRule("dual_macd", 177, 1.2, 30, 3.1, 40, 0.0000005),
    "keltner_reversal": OrderRule("keltner_reversal", 43, 2.9, 10, 3.5, 50, 0.01),
    "bollinger_open": OrderRule("bollinger_open", 122, 4.7, 40, 3.1, 30, 0.25),
    "day_open_atr": OrderRule("day_open_atr", 113, 5.5, 40, 1.1, 40, 0.1),
    "prior_day_range": OrderRule("prior_day_range", 198, 2.4, 25, 3.9, 25, 0.0005),
    "volatility_offset": OrderRule("volatility_offset", 99, 4.0, 20, 3.0, 20, 0.001),
}


def lag(x: str, k: int = 1) -> Column:
    return F.lag(x, k).over(frames.ordered(KEY, ORDER))


def to_tick(price: Column, tick: float) -> Column:
    """Nearest tick, halves to the even one."""
    return F.bround(price / tick) * tick


def bollinger(x: str, n: int, k: float) -> tuple[Column, Column]:
    f = frames.rows(KEY, ORDER, n, 1)
    width = F.coalesce(f.std0(x), F.lit(0.0)) * k
    return f.mean(x) + width, f.mean(x) - width


def keltner(n: int, k: float) -> tuple[Column, Column]:
    f = frames.rows(KEY, ORDER, n, 1)
    middle = f.mean((F.col("high") + F.col("low") + F.col("close")) / 3.0)
    offset = f.mean(F.col("high") - F.col("low")) * k
    return middle + offset, middle - offset


def finish(df: DataFrame, rule: OrderRule, long: Column, short: Column, buy: Column, sell: Column) -> DataFrame:
    """Candidates with a side and a price; known one hour after the bar opens."""
    no = F.lit(False)
    df = df.withColumns({"long": F.coalesce(long, no), "buy": buy, "sell": sell})
    df = df.withColumn("short", F.coalesce(short, no) & ~F.col("long"))
    if rule.target_period == rule.stop_period:
        df = smoothing.wilder_atr(df, "target_atr", KEY, ORDER, rule.target_period)
        df = df.withColumn("stop_atr", F.col("target_atr"))
    else:
        df = smoothing.wilder_atr(df, "target_atr", KEY, ORDER, rule.target_period)
        df = smoothing.wilder_atr(df, "stop_atr", KEY, ORDER, rule.stop_period)
    side = F.when(F.col("long"), "BUY").when(F.col("short"), "SELL")
    price = F.when(F.col("long"), F.col("buy")).when(F.col("short"), F.col("sell"))
    df = df.withColumns({"side": side, "stop_price": to_tick(price, rule.tick)})
    sign = F.when(F.col("side") == "BUY", 1.0).otherwise(-1.0)
    target = F.col("target_atr") * rule.target_multiple
    stop = F.col("stop_atr") * rule.stop_multiple
    decision = F.timestamp_seconds(F.unix_timestamp(ORDER) + 3600)
    return df.filter(F.col("side").isNotNull() & F.col("stop_price").isNotNull()).select(
        KEY,
        F.lit(rule.name).alias("rule"),
        decision.alias("decision_time"),
        "side",
        "stop_price",
        target.alias("profit_target_distance"),
        to_tick(F.col("stop_price") + sign * target, rule.tick).alias("profit_target_price"),
        stop.alias("stop_loss_distance"),
        to_tick(F.col("stop_price") - sign * stop, rule.tick).alias("stop_loss_price"),
        F.timestamp_seconds(F.unix_timestamp(ORDER) + 3600 * (1 + rule.bars_valid)).alias(
            "valid_until_utc"
        ),
    )


def _channel(bars: DataFrame, n: int, k: float, tag: str = "") -> DataFrame:
    up, down = keltner(n, k)
    return bars.withColumns({f"upper{tag}": up, f"lower{tag}": down})


def bollinger_breakout_rule(bars: DataFrame, rule: OrderRule) -> DataFrame:
    up, down = bollinger("close", 10, 2.6)
    df = bars.withColumns(
        {"upper": up, "lower": down, "span": F.col("high") - F.col("low")}
    )
    df = df.withColumn("tightest", frames.rows(KEY, ORDER, 25, 1).min("span"))
    df = parabolic_sar(df, "sar", KEY, ORDER, 0.02, 0.2)
    room = 2.8 * lag("tightest", 3)
    return finish(
        df, rule, lag("close") > lag("upper"), lag("close") < lag("lower"),
        lag("sar") + room, lag("sar") - room,
    )


def dual_macd_rule(bars: DataFrame, rule: OrderRule) -> DataFrame:
    df = smoothing.macd_signal(bars, "one", "close", KEY, ORDER, 24, 17, 9)
    df = smoothing.macd_signal(df, "two", "close", KEY, ORDER, 3, 26, 9)
    df = smoothing.tema(df, "level", "close", KEY, ORDER, 14)
    one = F.col("one")
    return finish(
        df, rule,
        (one > lag("one")) & (lag("two") > lag("two", 2)),
        (one < lag("one")) & (lag("two") < lag("two", 2)),
        lag("level"), lag("level"),
    )


def keltner_reversal_rule(bars: DataFrame, rule: OrderRule) -> DataFrame:
    df = _channel(_channel(_channel(bars, 30, 1.5, "30"), 20, 2.0, "20"), 20, 2.25, "e")
    df = df.withColumn("span", F.col("high") - F.col("low"))
    long = (
        (lag("upper30") < lag("upper30", 2)) & (lag("open") < lag("lower20"))
        & (lag("open", 2) > lag("lower20", 2))
    )
    short = (
        (lag("lower30") > lag("lower30", 2)) & (lag("open") > lag("upper20"))
        & (lag("open", 2) < lag("upper20", 2))
    )
    room = 0.3 * lag("span")
    return finish(df, rule, long, short, lag("uppere", 2) + room, lag("lowere", 2) - room)


def bollinger_open_rule(bars: DataFrame, rule: OrderRule) -> DataFrame:
    df = bars.withColumns({"upper": bollinger("high", 20, 1.9)[0], "lower": bollinger("low", 20, 1.9)[1]})
    df = daily_value(df, "open", "first", 3, "level")
    return finish(
        df, rule, F.col("open") < F.col("upper"), F.col("open") > F.col("lower"),
        F.col("level"), F.col("level"),
    )


def day_open_atr_rule(bars: DataFrame, rule: OrderRule, width: float = 2.5) -> DataFrame:
    df = _channel(bars, 20, width)
    df = smoothing.wilder_atr(df, "atr20", KEY, ORDER, 20)
    df = daily_value(df, "open", "first", 0, "level")
    room = 2.1 * lag("atr20")
    return finish(
        df, rule, lag("upper") > lag("upper", 2), lag("lower") < lag("lower", 2),
        F.col("level") + room, F.col("level") - room,
    )


def prior_day_range_rule(bars: DataFrame, rule: OrderRule, width: float = 2.0) -> DataFrame:
    df = _channel(bars, 20, width).withColumn("span", F.col("high") - F.col("low"))
    df = daily_value(df, "high", "max", 2, "day_high")
    df = daily_value(df, "low", "min", 2, "day_low")
    room = 1.4 * lag("span")
    return finish(
        df, rule, lag("lower") < lag("lower", 2), lag("upper") > lag("upper", 2),
        F.col("day_high") + room, F.col("day_low") - room,
    )


def volatility_offset_rule(bars: DataFrame, rule: OrderRule) -> DataFrame:
    df = _channel(bars, 20, 1.5).withColumn("span", F.col("high") - F.col("low"))
    df = df.withColumn("widest", frames.rows(KEY, ORDER, 14, 1).max("span"))
    df = parabolic_sar(df, "sar", KEY, ORDER, 0.01, 0.2)
    room = 0.7 * lag("widest")
    return finish(
        df, rule, F.col("lower") < lag("lower"), F.col("upper") > lag("upper"),
        lag("sar") - room, lag("sar") + room,
    )


BUILDERS = {
    "bollinger_breakout": bollinger_breakout_rule,
    "dual_macd": dual_macd_rule,
    "keltner_reversal": keltner_reversal_rule,
    "bollinger_open": bollinger_open_rule,
    "day_open_atr": day_open_atr_rule,
    "prior_day_range": prior_day_range_rule,
    "volatility_offset": volatility_offset_rule,
}


def all_rules(bars: DataFrame) -> DataFrame:
    out = None
    for name, build in BUILDERS.items():
        part = build(bars, RULES[name])
        out = part if out is None else out.unionByName(part)
    return out
