"""Scores and rule grids as table transforms."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tidepanel.functions import frames
from tidepanel.functions.scalars import clip, complete, normal_cdf, ratio
from tidepanel.operators import calendar as cal
from tidepanel.operators.labels import earlier_quantiles
from tidepanel.operators.smoothing import emas


def clock_masks(utc: str) -> dict[str, Column]:
    """New York clock windows of a session, in minutes after local midnight."""
    m = cal.local_minutes(utc)
    half_nine = 9 * 60 + 30
    return {
        "overnight": (m >= 18 * 60) | (m < half_nine),
        "eu_open": (m >= 23 * 60 + 30) | (m < 3 * 60 + 30),
        "pre_open": (m >= 3 * 60 + 30) & (m < half_nine),
        "open_30": (m >= half_nine) & (m < 10 * 60),
        "target": (m >= 10 * 60) & (m < 16 * 60),
    }


# --- session grid ------------------------------------------------------------------------

# The session grid.
SESSION_FAMILIES = ("session_momentum", "session_reversal")
SESSION_LOOKBACKS = (1, 2, 3, 5, 10, 20, 40, 60)
SESSION_THRESHOLDS = (0.0, 0.5, 1.0, 1.5)


def session_scores(panel, lookbacks=SESSION_LOOKBACKS):
    """Trailing session return over its earlier risk, one column per lookback."""
    x = F.col("session_return")
    out = {}
    for n in lookbacks:
        trailing = frames.steps("symbol", "cal", n).sum(x)
        risk = frames.steps("symbol", "cal", max(20, 2 * n), 20, end=-1).std(x)
        out[f"score_{n}"] = clip(ratio(trailing, risk * float(n) ** 0.5), -8.0, 8.0)
    return panel.withColumns(out)


def session_grid_returns(
    panel, one_way_bps: float, lookbacks=SESSION_LOOKBACKS, thresholds=SESSION_THRESHOLDS
):
    """Every rule of the grid on every session: position from the previous session's score.

    ``panel`` is the dense (symbol, cal) panel with ``session_return``.  Scores are computed
    once per lookback; families and thresholds are exploded from literals afterwards.
    """
    w = frames.ordered("symbol", "cal")
    scored = session_scores(panel, lookbacks)
    prior = [
        F.struct(F.lit(n).alias("lookback"), F.lag(f"score_{n}").over(w).alias("observed"))
        for n in lookbacks
    ]
    long = scored.select(
        "symbol", "trading_date", F.coalesce("session_return", F.lit(0.0)).alias("target"),
        F.array(*prior).alias("prior"),
    )
    long = long.select("symbol", "trading_date", "target", F.inline("prior"))
    rules = F.array(
        *[
            F.struct(F.lit(f).alias("family"), F.lit(s).alias("side"), F.lit(t).alias("threshold"))
            for f, s in zip(SESSION_FAMILIES, (1.0, -1.0))
            for t in thresholds
        ]
    )
    long = long.select("*", F.inline(rules))
    position = F.coalesce(
        F.when(F.abs("observed") >= F.col("threshold"), F.signum(F.col("side") * F.col("observed"))),
        F.lit(0.0),
    )
    out = long.withColumn("position", position).withColumns(
        {
            "gross": F.col("position") * F.col("target"),
            "sides": F.abs("position") * 2.0,
            "entries": (F.col("position") != 0).cast("int"),
            "strategy": F.concat_ws(
                "|", "symbol", "family", F.col("lookback").cast("string"),
                F.format_number("threshold", 1),
            ),
        }
    )
    return out.withColumn("net", F.col("gross") - F.col("sides") * one_way_bps / 10_000.0).drop(
        "target", "observed", "side"
    )


# --- bar scores on the shared calendar ---------------------------------------------------

BAR = "timestamp_utc"


def steps(n, least=None, end=0):
    return frames.steps("symbol", "cal", n, least, end)


def earlier_z(x, bound=5.0, history=160, least=40):
    """Distance from the mean of the earlier calendar positions, in their deviations."""
    x = F.col(x) if isinstance(x, str) else x
    f = steps(history, least, end=-1)
    z = ratio(x - f.mean(x), f.std(x))
    return z if bound is None else clip(z, -bound, bound)


def bar_themes(bars, lookbacks=(2, 4, 8)):
    """Mean-reversion, relative-value and lead-lag scores; ``bars`` carries ``cal``."""
    move = {n: F.col("close") / frames.step_lag("close", "symbol", "cal", n) - 1.0 for n in lookbacks}
    df = bars.withColumns({f"m{n}": m for n, m in move.items()})
    market = F.avg("return").over(Window.partitionBy("cal"))
    df = df.withColumn("behind", market - F.col("return"))
    df = df.withColumns({f"l{n}": steps(n, 1).sum("behind") for n in lookbacks})
    out = {}
    for n in lookbacks:
        out[f"mean_reversion_{n}"] = -earlier_z(f"m{n}")
        out[f"relative_value_{n}"] = -(frames.pct_rank(f"m{n}", "cal") - 0.5) * 2.0
        out[f"lead_lag_{n}"] = earlier_z(f"l{n}")
    return df.withColumns(out).drop("behind", *[f"{p}{n}" for p in "ml" for n in lookbacks])


# The generic product score families.
PRODUCT_FAMILIES = (
    "momentum", "mean_reversion", "cross_sectional_momentum", "cross_sectional_reversal",
    "residual_reversion", "volatility_scaled_momentum", "breakout", "trend", "lead_lag",
    "volume_confirmation",
)


def product_scores(bars, lookback):
    """Ten generic scores of one lookback.  ``return`` is NULL at each session start, so a full
    window never spans two sessions."""
    n, r = lookback, F.col("return")
    df = bars.withColumns(
        {
            "momentum_raw": steps(n).sum(r),
            "peer": frames.leave_one_out("return", "cal"),
            "high_n": steps(n).max("high"),
            "low_n": steps(n).min("low"),
            "log_volume": F.log1p(clip(F.col("volume").cast("double"), 0.0, None)),
        }
    )
    df = emas(
        df,
        {"fast": ("close", 2.0 / (n + 1.0), n), "slow": ("close", 2.0 / (4 * n + 1.0), 4 * n)},
        "symbol", "cal",
    )
    df = df.withColumns(
        {
            "residual_raw": steps(n).sum(r - F.col("peer")),
            "scaled_raw": ratio("momentum_raw", steps(4 * n, n, end=-1).std(r)),
            "location_raw": ratio(
                F.col("close") - F.col("low_n"), F.col("high_n") - F.col("low_n")
            ) - 0.5,
            "trend_raw": F.col("fast") / F.col("slow") - 1.0,
            "peer_raw": steps(n, 1).sum("peer"),
        }
    )
    rank = (frames.pct_rank("momentum_raw", "cal") - 0.5) * 2.0
    z = earlier_z("momentum_raw")
    return df.withColumns(
        {
            "momentum": z,
            "mean_reversion": -z,
            "cross_sectional_momentum": rank,
            "cross_sectional_reversal": -rank,
            "residual_reversion": -earlier_z("residual_raw"),
            "volatility_scaled_momentum": earlier_z("scaled_raw"),
            "breakout": earlier_z("location_raw"),
            "trend": earlier_z("trend_raw"),
            "lead_lag": earlier_z("peer_raw"),
            "volume_confirmation": z * clip(earlier_z("log_volume"), -2.0, 2.0),
        }
    )


# The session-aware families.
SESSION_AWARE = (
    "intraday_close_momentum", "opening_range_continuation", "opening_range_reversal",
    "session_vwap_reversion", "range_breakout", "range_expansion_reversal",
    "paired_spread_reversion", "regime_switch",
)


def session_aware_scores(bars, lookback, peers):
    """Eight scores built on session state, each then standardized on earlier positions."""
    n, r = lookback, F.col("return")
    day = Window.partitionBy("symbol", "trading_date").orderBy(BAR)
    run = day.rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3.0
    f = frames.rows(["symbol", "trading_date"], BAR, n, n, end=-1)
    df = bars.withColumns(
        {
            "cumulative": F.when(r.isNotNull(), F.sum(r).over(run)),
            "first_bar": F.first(F.col("close") / F.col("open") - 1.0).over(run),
            "is_first": F.row_number().over(day) == 1,
            "vwap": ratio(
                F.sum(typical * F.col("volume")).over(run), F.sum("volume").over(run).cast("double")
            ),
            "top": f.max("high"),
            "bottom": f.min("low"),
            "span": (F.col("high") - F.col("low")) / F.col("close"),
        }
    )
    # Scale of the opening bar: one value per session, from the 40 sessions before.
    first = Window.partitionBy("symbol").orderBy("trading_date").rowsBetween(-40, -1)
    opening = (
        df.filter("is_first")
        .withColumn(
            "scale",
            F.when(F.count("first_bar").over(first) >= 20, F.stddev_samp("first_bar").over(first)),
        )
        .select("symbol", "trading_date", "scale")
    )
    df = df.join(opening, ["symbol", "trading_date"])
    pairs = F.create_map(*[F.lit(x) for s, p in peers.items() for x in (s, p)])
    other = df.select(
        F.col("symbol").alias("peer_symbol"), "cal", F.col("cumulative").alias("peer_cumulative")
    )
    df = df.withColumn("peer_symbol", pairs[F.col("symbol")]).join(
        other, ["peer_symbol", "cal"], "left"
    )
    risk = steps(40, 20, end=-1).std(r)
    df = df.withColumns({"risk": risk, "momentum_raw": steps(n).sum(r)})
    calm = steps(160, 40, end=-1).median("risk")
    middle, half = (F.col("top") + F.col("bottom")) / 2.0, (F.col("top") - F.col("bottom")) / 2.0
    opened = ratio("first_bar", "scale")
    raw = {
        "intraday_close_momentum": F.col("cumulative"),
        "opening_range_continuation": opened,
        "opening_range_reversal": -opened,
        "session_vwap_reversion": -(F.col("close") / F.col("vwap") - 1.0),
        "range_breakout": ratio(F.col("close") - middle, half),
        "range_expansion_reversal": -r
        * ratio("span", frames.steps("symbol", "cal", 4 * n, end=-1).mean("span")),
        "paired_spread_reversion": -(F.col("cumulative") - F.col("peer_cumulative")),
        "regime_switch": F.col("momentum_raw")
        * F.when(F.col("risk") <= calm, 1.0).otherwise(-1.0),
    }
    df = df.withColumns({f"raw_{k}": c for k, c in raw.items()})
    return df.withColumns({k: earlier_z(f"raw_{k}", bound=None) for k in raw})


def entry_eligibility(bars):
    """Flags per volatility filter and clock rule; all need a return on the bar."""
    r = F.col("return")
    df = bars.withColumn("risk", steps(40, 20, end=-1).std(r))
    df = df.withColumn("calm", steps(160, 40, end=-1).median("risk"))
    hour = F.hour(cal.local_time(BAR))
    core = hour.between(8, 15)
    no = F.lit(False)
    return df.withColumns(
        {
            "eligible_all": r.isNotNull(),
            "eligible_below_median": r.isNotNull() & F.coalesce(F.col("risk") <= F.col("calm"), no),
            "eligible_above_median": r.isNotNull() & F.coalesce(F.col("risk") > F.col("calm"), no),
            "in_us_core": core,
            "in_overnight": ~core,
            "is_preclose": cal.preclose_flag(),
        }
    )


def edge_signals(df, score, allowed, threshold, exit_level, hold):
    """Rising edges of a threshold, acted on one bar later inside the same session.

    Exits: the score was calm one bar earlier, or ``hold`` bars passed since an entry.
    """
    w = frames.ordered("symbol", BAR)
    no = F.lit(False)
    x = F.col(score)
    same = F.coalesce(F.lag("trading_date").over(w) == F.col("trading_date"), no)
    df = df.withColumns(
        {
            "long_now": F.coalesce(x >= threshold, no) & allowed,
            "short_now": F.coalesce(x <= -threshold, no) & allowed,
            "calm": F.coalesce(F.abs(x) <= exit_level, no),
        }
    )
    df = df.withColumns(
        {
            f"{side}_edge": F.col(f"{side}_now") & ~F.coalesce(F.lag(f"{side}_now").over(w), no)
            for side in ("long", "short")
        }
    )
    df = df.withColumns(
        {
            f"enter_{side}": F.coalesce(F.lag(f"{side}_edge").over(w), no) & same
            for side in ("long", "short")
        }
    )
    df = df.withColumn("entered", F.col("enter_long") | F.col("enter_short"))
    timed = F.coalesce(F.lag("entered", hold).over(w), no)
    return df.withColumn("exit", F.coalesce(F.lag("calm").over(w), no) | timed).drop(
        "long_now", "short_now", "calm", "long_edge", "short_edge", "entered"
    )


# The sixteen intraday variants
# (entry, exit, hold, volatility filter, clock rule, stop).
INTRADAY_VARIANTS = (
    (0.75, 0.10, 4, "all", "all", None), (0.75, 0.10, 8, "all", "all", None),
    (0.75, 0.10, 16, "all", "all", None), (0.75, 0.10, 24, "all", "all", None),
    (1.25, 0.10, 4, "all", "all", None), (1.25, 0.10, 8, "all", "all", None),
    (1.25, 0.10, 16, "all", "all", None), (1.25, 0.10, 24, "all", "all", None),
    (1.00, 0.10, 16, "below_median", "all", None), (1.00, 0.10, 16, "above_median", "all", None),
    (1.00, 0.10, 16, "all", "us_core", None), (1.00, 0.10, 16, "all", "overnight", None),
    (1.00, 0.10, 16, "all", "all", 0.005), (1.00, 0.10, 16, "all", "all", 0.010),
    (1.00, 0.25, 16, "all", "all", None), (1.00, 0.40, 16, "all", "all", None),
)


def intraday_rules():
    """Theme, lookback and variant of the 144 rules each timeframe runs, as one array."""
    variants = F.array(
        *[
            F.struct(
                F.lit(e).alias("entry"), F.lit(x).alias("exit"), F.lit(h).alias("hold"),
                F.lit(v).alias("volatility_filter"), F.lit(t).alias("time_rule"),
                F.lit(s).cast("double").alias("stop"), F.lit(i).alias("variant"),
            )
            for i, (e, x, h, v, t, s) in enumerate(INTRADAY_VARIANTS, 1)
        ]
    )
    return variants


def intraday_grid_activity(bars, lookbacks=(2, 4, 8)):
    """Bars on which each rule of the grid may enter, long and short, per symbol."""
    df = entry_eligibility(bar_themes(bars, lookbacks))
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("theme"), F.lit(n).alias("lookback"), F.col(f"{t}_{n}").alias("score"))
            for t in ("mean_reversion", "relative_value", "lead_lag")
            for n in lookbacks
        ]
    )
    keep = ["symbol", BAR, "eligible_all", "eligible_below_median", "eligible_above_median",
            "in_us_core", "in_overnight"]
    df = df.select(*keep, F.inline(rows)).select("*", F.inline(intraday_rules()))
    risk = F.col("volatility_filter")
    clock = F.col("time_rule")
    allowed = (
        F.when(risk == "below_median", F.col("eligible_below_median"))
        .when(risk == "above_median", F.col("eligible_above_median"))
        .otherwise(F.col("eligible_all"))
    ) & (
        F.when(clock == "us_core", F.col("in_us_core"))
        .when(clock == "overnight", F.col("in_overnight"))
        .otherwise(F.lit(True))
    )
    return df.groupBy("symbol", "theme", "lookback", "variant").agg(
        F.count_if(allowed & (F.col("score") >= F.col("entry"))).alias("long_bars"),
        F.count_if(allowed & (F.col("score") <= -F.col("entry"))).alias("short_bars"),
    )


def intraday_rule_returns(bars, lookbacks=(2, 4, 8)):
    """Daily gross return and traded sides of every intraday rule.

    A rising edge of the entry level opens a stretch one bar later in the same session; a later edge
    opens the next one.  A stretch ends after ``hold`` bars, one bar after a calm score, one bar after
    its own return fell to the stop, or with the session.  Weights share one unit of exposure per bar.
    All windows lie within (session, theme, lookback), so one shuffle before the variants serves them.
    """
    df = entry_eligibility(bar_themes(bars, lookbacks))
    scores = F.array(
        *[
            F.struct(F.lit(t).alias("theme"), F.lit(n).alias("lookback"), F.col(f"{t}_{n}").alias("score"))
            for t in ("mean_reversion", "relative_value", "lead_lag")
            for n in lookbacks
        ]
    )
    keep = ["symbol", "trading_date", BAR, "return", "eligible_all", "eligible_below_median",
            "eligible_above_median", "in_us_core", "in_overnight"]
    df = df.select(*keep, F.inline(scores)).repartition("trading_date", "theme", "lookback")
    df = df.select("*", F.inline(intraday_rules()))
    no, rule = F.lit(False), ["theme", "lookback", "variant"]
    own = ["trading_date", *rule, "symbol"]
    w = frames.ordered(own, BAR)
    allowed = (
        F.when(F.col("volatility_filter") == "below_median", F.col("eligible_below_median"))
        .when(F.col("volatility_filter") == "above_median", F.col("eligible_above_median"))
        .otherwise(F.col("eligible_all"))
    ) & (
        F.when(F.col("time_rule") == "us_core", F.col("in_us_core"))
        .when(F.col("time_rule") == "overnight", F.col("in_overnight"))
        .otherwise(F.lit(True))
    )
    up = F.coalesce(F.col("score") >= F.col("entry"), no)
    down = F.coalesce(F.col("score") <= -F.col("entry"), no)
    df = df.withColumns(
        {
            "now": F.when(allowed & up, 1).when(allowed & down, -1).otherwise(0),
            "calm_before": F.coalesce(F.lag(F.abs("score") <= F.col("exit")).over(w), no),
        }
    )
    df = df.withColumn("edge", F.when(F.col("now") != F.coalesce(F.lag("now").over(w), F.lit(0)), F.col("now")).otherwise(0))
    side = F.lag("edge").over(w)
    df = df.withColumn("side", F.when(side != 0, side))
    so_far = w.rowsBetween(frames.Window.unboundedPreceding, 0)
    df = df.withColumns(
        {"stretch": F.count("side").over(so_far), "direction": F.last("side", ignorenulls=True).over(so_far)}
    )
    v = frames.ordered([*own, "stretch"], BAR)
    df = df.withColumn("age", F.row_number().over(v) - 1)
    before = v.rowsBetween(frames.Window.unboundedPreceding, -1)
    made = F.sum(F.col("direction") * F.coalesce("return", F.lit(0.0))).over(before)
    df = df.withColumns(
        {
            "left": F.max(F.col("calm_before") & (F.col("age") > 0)).over(v.rowsBetween(frames.Window.unboundedPreceding, 0)),
            "made": made,
        }
    )
    df = df.withColumn("lowest", F.min("made").over(v.rowsBetween(frames.Window.unboundedPreceding, 0)))
    stopped = F.coalesce(F.col("lowest") <= -F.col("stop"), no)
    held = (F.col("stretch") > 0) & (F.col("age") < F.col("hold")) & ~F.col("left") & ~stopped
    df = df.withColumn("position", F.when(held, F.col("direction")).otherwise(0).cast("double"))
    everyone = F.sum(F.abs("position")).over(frames.Window.partitionBy("trading_date", *rule, BAR))
    df = df.withColumn("weight", F.coalesce(ratio("position", everyone), F.lit(0.0)))
    moved = F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(w), F.lit(0.0)))
    closing = F.when(F.lead("weight").over(w).isNull(), F.abs("weight")).otherwise(0.0)
    df = df.withColumns({"sides": moved + closing, "gross": F.col("weight") * F.coalesce("return", F.lit(0.0))})
    return df.groupBy(*rule, "trading_date").agg(F.sum("gross").alias("gross"), F.sum("sides").alias("sides"))


def parameter_grid(symbols, grid):
    """Every parameter combination per symbol; values come from literals, exploded in turn."""
    for name, values in grid.items():
        symbols = symbols.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return symbols


def sampled_population(df, grid_keys, per_key, family, seed=20260823):
    """Deterministic sample of a rule grid, the quota spread evenly over families.

    The draw order is a seeded hash of the rule itself, so it does not depend on partitioning
    and never repeats a rule.
    """
    draw = F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns])
    families = df.select(family).distinct().withColumn(
        "family_no", F.row_number().over(Window.orderBy(family)) - 1
    )
    n = families.count()
    quota = F.floor(F.lit(per_key) / n) + (F.col("family_no") < per_key % n).cast("int")
    w = Window.partitionBy(*grid_keys, family).orderBy(draw, *df.columns)
    return (
        df.join(families, family)
        .withColumn("rn", F.row_number().over(w))
        .filter(F.col("rn") <= quota)
        .drop("rn", "family_no")
    )


# --- forecasts from the feature table ----------------------------------------------------

TREND_FEATURES = (
    "standardized_return_20s", "standardized_return_60s", "price_to_sma_20s", "price_to_sma_60s",
    "ema_gap_5_20s", "ema_gap_10_60s", "trend_slope_20s", "trend_slope_60s",
)


def trend_forecast(features):
    """Mean of bounded features, each over its rolling median size; NULL if any is missing."""
    w = frames.rows("symbol", "trading_date", 60, 20)
    parts = []
    for c in TREND_FEATURES:
        scale = w.median(F.abs(F.col(c)))
        parts.append(F.tanh(clip(ratio(c, scale), -5.0, 5.0)))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return features.select("symbol", "trading_date", (total / len(parts)).alias("score"))


def breakout_forecast():
    where = (
        F.col("close_percentile_20s") + F.col("close_percentile_60s") + F.col("close_percentile_120s")
    ) / 3.0
    activity = 0.5 + 0.25 * F.col("range_percentile_60s") + 0.25 * F.col("volume_percentile_60s")
    return clip(F.tanh((where - 0.5) * 3.0) * activity, -1.0, 1.0)


# The reversion registry, rule ids and feature names in rule order.
REVERSION_RULES = {
    ("return_reversal", "return_reversal"): (
        "log_return_1s", "momentum_2s", "momentum_5s", "momentum_10s", "momentum_20s",
        "standardized_return_5s", "standardized_return_20s", "standardized_return_60s",
        "close_return_lag_2s", "close_return_lag_5s",
    ),
    ("moving_average", "moving_average_deviation"): (
        "price_to_sma_5s", "price_to_sma_10s", "price_to_sma_20s", "price_to_sma_30s",
        "price_to_sma_60s", "price_to_sma_120s", "sma_gap_5_20s", "sma_gap_20_60s",
        "sma_gap_30_120s", "price_to_ema_30s",
    ),
    ("residual", "regression_residual"): ("trend_residual_zscore_20s", "trend_residual_zscore_60s"),
    ("exhaustion", "range_exhaustion"): (
        "close_location", "overnight_gap_fraction", "intraday_tail_imbalance",
        "return_sign_imbalance", "range_zscore_20s", "range_percentile_20s",
        "range_percentile_60s", "volume_zscore_20s", "trend_slope_acceleration_20s",
        "upside_downside_volatility_ratio_20s",
    ),
    ("cross_sectional", "cross_sectional_contrarian"): (
        "log_return_1s", "momentum_2s", "momentum_5s", "momentum_10s", "momentum_20s",
    ),
}
RESIDUAL_THRESHOLDS = (0.0, 0.5, 1.0, 1.5, 2.0)


def _reversion_variants(prefix: str, number: int, feature: str):
    """(id, threshold, ranked) of the rules that one feature gives in a block."""
    if prefix == "residual":
        return [(f"{prefix}_{feature[-3:]}_t{t}", t, False) for t in RESIDUAL_THRESHOLDS]
    if prefix == "cross_sectional":
        return [(f"{prefix}_{feature}_{'rank' if ranked else 'scaled'}", 0.0, ranked) for ranked in (False, True)]
    return [(f"{prefix}_{number:02d}", 0.0, False)]


def reversion_registry():
    """(name, family, feature, threshold, ranked) of the 50 reversion rules."""
    return [
        (name, family, feature, threshold, ranked)
        for (prefix, family), features in REVERSION_RULES.items()
        for number, feature in enumerate(features, 1)
        for name, threshold, ranked in _reversion_variants(prefix, number, feature)
    ]


# The six-theme registry.  (feature, direction, hold, other feature, mode)
THEME_RULES = {
    "momentum": [
        ("log_return_1s", 1, 1), ("momentum_2s", 1, 1), ("momentum_5s", 1, 1),
        ("momentum_10s", 1, 2), ("momentum_20s", 1, 3), ("momentum_60s", 1, 5),
        ("standardized_return_5s", 1, 1), ("standardized_return_20s", 1, 2),
        ("standardized_return_60s", 1, 3), ("return_zscore_20s", 1, 1),
    ],
    "trend": [
        ("price_to_sma_10s", 1, 1), ("price_to_sma_20s", 1, 2), ("price_to_sma_60s", 1, 3),
        ("price_to_sma_120s", 1, 5), ("ema_gap_5_20s", 1, 1), ("ema_gap_10_60s", 1, 3),
        ("trend_slope_20s", 1, 1), ("trend_slope_30s", 1, 2), ("trend_slope_60s", 1, 3),
        ("trend_slope_120s", 1, 5),
    ],
    "mean_reversion": [
        ("log_return_1s", -1, 1), ("momentum_2s", -1, 1), ("momentum_5s", -1, 2),
        ("momentum_10s", -1, 3), ("standardized_return_5s", -1, 1),
        ("standardized_return_20s", -1, 2), ("price_to_sma_5s", -1, 1),
        ("price_to_sma_20s", -1, 3), ("trend_residual_zscore_20s", -1, 1),
        ("trend_residual_zscore_60s", -1, 3),
    ],
    "breakout": [
        ("close_percentile_20s", 1, 1, "range_percentile_20s", "activity"),
        ("close_percentile_20s", 1, 1, "volume_percentile_20s", "activity"),
        ("close_percentile_60s", 1, 2, "range_percentile_60s", "activity"),
        ("close_percentile_60s", 1, 2, "volume_percentile_60s", "activity"),
        ("close_percentile_120s", 1, 3, "range_percentile_120s", "activity"),
        ("close_percentile_120s", 1, 3, "volume_percentile_120s", "activity"),
        ("close_percentile_20s", 1, 1, "volume_zscore_20s", "activity"),
        ("close_percentile_60s", 1, 2, "range_zscore_20s", "activity"),
        ("price_to_sma_20s", 1, 2, "range_percentile_60s", "activity"),
        ("price_to_sma_60s", 1, 3, "volume_percentile_60s", "activity"),
    ],
    "relative_value": [
        ("log_return_1s", -1, 1), ("momentum_2s", -1, 1), ("momentum_5s", -1, 2),
        ("momentum_10s", 1, 2), ("momentum_20s", 1, 3), ("momentum_60s", 1, 5),
        ("price_to_sma_20s", -1, 2), ("price_to_sma_60s", 1, 3),
        ("close_percentile_20s", -1, 1), ("close_percentile_60s", 1, 3),
    ],
    "lead_lag": [
        ("peer_return_lag1s", 1, 1), ("peer_momentum_5s_lag1s", 1, 2), ("peer_breadth_lag1s", 1, 1),
        ("peer_return_lag1s", 1, 1, "leadlag_correlation_20s", "signed"),
        ("peer_return_lag1s", 1, 2, "leadlag_correlation_60s", "signed"),
        ("peer_return_lag1s", 1, 2, "leadlag_beta_60s", "signed"),
        ("peer_momentum_5s_lag1s", 1, 2, "leadlag_correlation_20s", "signed"),
        ("peer_momentum_5s_lag1s", 1, 3, "leadlag_correlation_60s", "signed"),
        ("peer_return_lag1s", -1, 1, "leadlag_correlation_20s", "signed"),
        ("peer_momentum_5s_lag1s", -1, 3, "leadlag_beta_60s", "signed"),
    ],
}


def theme_registry():
    """(name, theme, feature, direction, hold, ranked, other, mode) of the 60 theme rules."""
    out = []
    for theme, rules in THEME_RULES.items():
        for i, rule in enumerate(rules, 1):
            feature, direction, hold, *rest = rule
            other, mode = rest if rest else (None, None)
            out.append(
                (f"{theme}_{i:02d}", theme, feature, float(direction), hold,
                 theme == "relative_value", other, mode)
            )
    return out


def centred(name):
    """Percentiles and close location are centred on one half before scoring."""
    return F.col(name) - 0.5 if "percentile" in name or name == "close_location" else F.col(name)


def scaled_long(features, names, centre):
    """(symbol, date, feature, x, scaled, ranked): each feature once, scaled and ranked once.

    The scale is the median size of all earlier values (at least 60); rules join to this table
    by feature name, so a feature used by ten rules is scaled a single time.
    """
    wide = features.select("symbol", "trading_date", *[centre(n).alias(n) for n in names])
    long = wide.unpivot(["symbol", "trading_date"], list(names), "feature", "x")
    long = long.filter(F.col("x").isNotNull()).withColumn("size", F.abs("x"))
    scale = earlier_quantiles(
        long, ["symbol", "feature"], "trading_date", "size", {"scale": 0.5}, 60
    ).select("symbol", "trading_date", "feature", "scale")
    long = long.join(scale, ["symbol", "trading_date", "feature"])
    return long.withColumns(
        {
            "scaled": ratio("x", "scale"),
            "ranked": frames.pct_rank("x", "feature", "trading_date") - 0.5,
        }
    ).drop("size", "scale")


def _reversion_input(name):
    """Ratio features are read on a log scale, bounded locations are centred on one half."""
    if name == "upside_downside_volatility_ratio_20s":
        return F.log(clip(name, 1e-8, None))
    if name in ("close_location", "range_percentile_20s", "range_percentile_60s"):
        return F.col(name) - 0.5
    return F.col(name)


def reversion_inputs(rules=None):
    """The features that the reversion rules read."""
    return sorted({rule[2] for rule in (reversion_registry() if rules is None else rules)})


def reversion_scores(features, rules=None):
    """Contrarian score of every reversion rule, (strategy, symbol, trading_date, score)."""
    rules = reversion_registry() if rules is None else rules
    names = reversion_inputs(rules)
    long = scaled_long(features, names, _reversion_input)
    spark = features.sparkSession
    registry = spark.createDataFrame(
        rules, "strategy string, family string, feature string, threshold double, is_ranked boolean"
    )
    df = long.join(registry, "feature")
    x = F.when(F.col("is_ranked"), F.col("ranked")).otherwise(F.col("scaled"))
    score = F.when(
        (F.col("threshold") > 0) & ~F.coalesce(F.abs(x) >= F.col("threshold"), F.lit(False)), 0.0
    ).otherwise(-F.tanh(clip(x, -5.0, 5.0)))
    return df.select("strategy", "family", "symbol", "trading_date", score.alias("score"))


def theme_inputs(rules=None):
    """The features that the theme rules read."""
    rules = theme_registry() if rules is None else rules
    return sorted({r[2] for r in rules} | {r[6] for r in rules if r[6]})


def theme_scores(features, rules=None):
    """Score of every theme rule with its activity or signed modulation and hold smoothing."""
    rules = theme_registry() if rules is None else rules
    names = theme_inputs(rules)
    long = scaled_long(features, names, centred)
    spark = features.sparkSession
    registry = spark.createDataFrame(
        rules,
        "strategy string, theme string, feature string, direction double, hold int, "
        "is_ranked boolean, other string, mode string",
    )
    second = long.select(
        "symbol", "trading_date", F.col("feature").alias("other"), F.col("x").alias("other_x"),
        F.col("scaled").alias("other_scaled"),
    )
    df = long.join(registry, "feature").join(second, ["symbol", "trading_date", "other"], "left")
    base = F.when(F.col("is_ranked"), F.col("ranked")).otherwise(F.col("scaled"))
    activity = F.when(
        F.col("other").contains("percentile"), clip(F.col("other_x") + 0.5, 0.0, 1.0)
    ).otherwise(clip(F.abs("other_scaled"), 0.0, 2.0) / 2.0)
    raw = (
        F.when(F.col("mode") == "activity", base * (0.5 + 0.5 * activity))
        .when(F.col("mode") == "signed", base * clip("other_x", -2.0, 2.0))
        .otherwise(base)
    )
    df = df.withColumn("bounded", F.tanh(clip(raw, -5.0, 5.0)) * F.col("direction"))
    df = cal.number_calendar(df, "trading_date")
    smooth = F.lit(None).cast("double")
    for hold in sorted({r[4] for r in rules}):
        mean = frames.steps(["strategy", "symbol"], "cal", hold, 1).mean("bounded")
        smooth = F.when(F.col("hold") == hold, mean).otherwise(smooth)
    return df.select("strategy", "theme", "symbol", "trading_date", smooth.alias("score"))


# --- intraday combined score -------------------------------------------------------------

# Component weights (midpoint, vwap, open move, short return).
INTRADAY_WEIGHTS = {
    "balanced": (0.40, 0.25, 0.20, 0.15),
    "midpoint_dominant": (0.65, 0.15, 0.10, 0.10),
    "fast_reversal_dominant": (0.20, 0.10, 0.10, 0.60),
    "vwap_dominant": (0.20, 0.60, 0.10, 0.10),
}
SAME_TIME = (
    "vwap_deviation", "open_deviation", "return_5m", "running_range_fraction", "cumulative_volume",
)


def same_time_z(x, least=60):
    """Against the symbol's earlier sessions at the same session minute."""
    f = frames.before(["symbol", "session_minute"], "trading_date", least)
    return ratio(F.col(x) - f.mean(x), f.std(x))


def intraday_scores(state, least=60):
    """Component and combined reversal scores from the running session state."""
    df = state.withColumns({f"{c}_z": same_time_z(c, least) for c in SAME_TIME})
    df = df.withColumns(
        {
            "range_pace": normal_cdf(F.col("running_range_fraction_z")),
            "volume_pace": normal_cdf(F.col("cumulative_volume_z")),
            "midpoint_score": clip(-2.0 * F.col("midpoint_displacement"), -1.0, 1.0),
            "vwap_score": -F.tanh(clip("vwap_deviation_z", -5.0, 5.0) / 2.0),
            "open_move_score": -F.tanh(clip("open_deviation_z", -5.0, 5.0) / 2.0),
            "short_return_score": -F.tanh(clip("return_5m_z", -5.0, 5.0) / 2.0),
        }
    )
    activity = (0.5 + 0.5 * F.col("range_pace")) * (0.75 + 0.25 * F.col("volume_pace"))
    ready = complete(
        ["vwap_deviation_z", "open_deviation_z", "return_5m_z", "range_pace", "volume_pace"]
    )
    last = F.signum(F.coalesce("return_1m", F.lit(0.0)))
    parts = ("midpoint_score", "vwap_score", "open_move_score", "short_return_score")
    out = {}
    for name, weights in INTRADAY_WEIGHTS.items():
        raw = F.lit(0.0)
        for weight, part in zip(weights, parts):
            raw = raw + weight * F.col(part)
        sure = F.when(last == F.signum(raw), 1.15).otherwise(0.85)
        value = clip(raw * activity * sure, -1.0, 1.0)
        out[f"score_{name}"] = F.when(ready, value).otherwise(0.0)
    return df.withColumns(out).withColumn("ready", ready)


# --- pooled learning frame ---------------------------------------------------------------

LEARNING_FEATURES = (
    "overnight_return", "eu_open_return", "pre_open_return", "open_30_return",
    "overnight_volatility", "observed_volume_surprise", "prior_target_return",
    "prior_session_momentum_5", "prior_target_volatility_20", "overnight_cross_rank",
    "open_30_cross_rank", "cross_market_overnight", "weekday_sin", "weekday_cos",
)


def learning_frame(windows, history=20, momentum=5):
    """Features known at ten o'clock and a strictly later target, per (symbol, session)."""
    key, order = "symbol", "trading_date"

    def known(c):
        return F.coalesce(F.col(c).cast("double"), F.lit(0.0))

    df = windows.withColumn(
        "observed_volume", known("overnight_volume") + known("pre_open_volume") + known("open_30_volume")
    )
    w = frames.ordered(key, order)
    day = F.weekday(order).cast("double")
    angle = 2.0 * math.pi * day / 5.0
    df = df.withColumns(
        {
            "observed_volume_surprise": ratio(
                "observed_volume", frames.rows(key, order, history, end=-1).mean("observed_volume")
            ),
            "prior_target_return": F.lag("target_return").over(w),
            "prior_session_momentum_5": frames.rows(key, order, momentum, end=-1).sum("target_return"),
            "prior_target_volatility_20": frames.rows(key, order, history, end=-1).std("target_return"),
            "overnight_cross_rank": frames.pct_rank("overnight_return", order),
            "open_30_cross_rank": frames.pct_rank("open_30_return", order),
            "cross_market_overnight": F.avg("overnight_return").over(Window.partitionBy(order)),
            "weekday_sin": F.sin(angle),
            "weekday_cos": F.cos(angle),
        }
    )
    return df.filter(F.col("target_return").isNotNull()).select(
        key, order, *LEARNING_FEATURES, "target_return"
    )
