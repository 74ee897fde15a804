"""Point-in-time session features; key (symbol, trading_date).

Every column is a built-in aggregate over a per-symbol frame.  All frames share one partitioning
and one ordering, so the whole table costs a single shuffle on ``symbol`` plus the cross-section
step for the peer columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import frames
from tidepanel.functions.scalars import clip, complete, ratio
from tidepanel.operators.calendar import number_calendar
from tidepanel.operators.smoothing import emas
from tidepanel.schema import require_columns

KEY, ORDER = "symbol", "trading_date"


def R(n: int, least: int | None = None, end: int = 0) -> frames.Frame:
    return frames.rows(KEY, ORDER, n, least, end)


def lag(x: str | Column, k: int = 1) -> Column:
    return F.lag(x, k).over(frames.ordered(KEY, ORDER))


def slope(y: str, n: int) -> Column:
    """OLS slope of the last n values against their position."""
    f = R(n)
    return f._guard(F.col(y), F.regr_slope(F.col(y), F.col("rn")).over(f.window))


def efficiency(x: str, n: int) -> Column:
    """Net move over path length inside n values (n-1 steps)."""
    path = R(n - 1).sum(F.abs(F.col(f"{x}_step")))
    return ratio(F.abs(F.col(x) - lag(x, n - 1)), path)


def r_squared(y: str, n: int) -> Column:
    f = R(n)
    flat = F.min(y).over(f.window) == F.max(y).over(f.window)
    return f._guard(F.col(y), F.when(~flat, F.regr_r2(F.col(y), F.col("rn")).over(f.window)))


def residual_zscore(y: str, n: int) -> Column:
    """Last OLS residual over the sample deviation of the window's residuals."""
    f = R(n)
    w = f.window
    yc, x = F.col(y), F.col("rn")
    b = F.regr_slope(yc, x).over(w)
    fit = F.avg(yc).over(w) + b * (x - F.avg(x).over(w))
    spread = F.regr_syy(yc, x).over(w) - b * F.regr_sxy(yc, x).over(w)
    scale = F.sqrt(F.greatest(spread, F.lit(0.0)) / (n - 1))
    return f._guard(yc, ratio(yc - fit, scale))


MOMENTUM = (2, 5, 10, 20, 60, 120)


def return_features() -> dict[str, Column]:
    """Own-row return, volatility, range and volume columns."""
    r = F.col("log_return_1s")
    out: dict[str, Column] = {"reversal_1s": -r}
    for n in MOMENTUM:
        out[f"momentum_{n}s"] = F.expm1(R(n).sum(r))
    for n in (5, 20, 60):
        out[f"standardized_return_{n}s"] = ratio(R(n).sum(r), R(n).std(r) * math.sqrt(n))
    out["return_zscore_20s"] = R(20).zscore(r)
    for n in (10, 20, 60):
        out[f"price_to_sma_{n}s"] = F.col("close") / R(n).mean("close") - 1.0
    for n in (20, 60):
        out[f"trend_slope_{n}s"] = ratio(slope("close", n), R(n).mean("close"))
        out[f"trend_efficiency_{n}s"] = efficiency("close", n)
    for n in (5, 20):
        out[f"realized_volatility_{n}s"] = R(n).mean("realized_volatility_1m")
    for n in (5, 20, 60):
        out[f"return_volatility_{n}s"] = R(n).std(r)
    out["volatility_ratio_5_20s"] = ratio(R(5).std(r), R(20).std(r))
    out["volatility_ratio_20_60s"] = ratio(R(20).std(r), R(60).std(r))
    down, up = clip(r, None, 0.0), clip(r, 0.0, None)
    out["downside_volatility_20s"] = R(20).std(down)
    out["upside_downside_volatility_ratio_20s"] = ratio(R(20).std(up), R(20).std(down))
    for n in (20, 60):
        out[f"drawdown_{n}s"] = F.col("close") / R(n).max("close") - 1.0
    out["range_zscore_20s"] = R(20).zscore("range_fraction")
    out["close_location"] = ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low"))
    out["volume_zscore_20s"] = R(20).zscore("log_volume")
    for n in (20, 60):
        out[f"return_autocorrelation_{n}s"] = F.when(
            R(n).count(r) >= n, R(n - 1).corr(r, F.col("return_before"))
        )
    return out


def structure_features() -> dict[str, Column]:
    """Range, percentile, lag and regression columns."""
    c, before = F.col("close"), F.col("close_before")
    out: dict[str, Column] = {
        "true_range_fraction": ratio("true_range", before),
        "overnight_gap_fraction": F.col("open") / before - 1.0,
        "open_to_previous_close": F.col("open") / before - 1.0,
        "high_to_previous_close": F.col("high") / before - 1.0,
        "low_to_previous_close": F.col("low") / before - 1.0,
    }
    for n in (5, 14, 30):
        out[f"atr_{n}s_fraction"] = ratio(R(n).mean("true_range"), c)
    spread = F.pow(F.log(F.col("high") / F.col("low")), 2)
    body = F.pow(F.log(c / F.col("open")), 2)
    for n in (5, 20, 30):
        out[f"parkinson_volatility_{n}s"] = F.sqrt(
            clip(R(n).mean(spread / (4.0 * math.log(2.0))), 0.0, None)
        )
        out[f"garman_klass_volatility_{n}s"] = F.sqrt(
            clip(R(n).mean(0.5 * spread - (2.0 * math.log(2.0) - 1.0) * body), 0.0, None)
        )
    for n in (20, 60, 120):
        out[f"range_percentile_{n}s"] = R(n).share_at_most_last("range_fraction")
        out[f"volume_percentile_{n}s"] = R(n).share_at_most_last("volume")
        out[f"close_percentile_{n}s"] = R(n).share_at_most_last("close")
    for name in ("range", "volume"):
        out[f"{name}_quartile_60s"] = F.ceil(out[f"{name}_percentile_60s"] * 4.0).cast("double")
    for k in (1, 2, 5, 10, 20, 30):
        out[f"close_return_lag_{k}s"] = lag("simple_return", k)
    for k in (1, 5, 20):
        out[f"volume_change_{k}s"] = ratio("volume", lag("volume", k)) - 1.0
    for n in (5, 30, 120):
        out[f"price_to_sma_{n}s"] = c / R(n).mean(c) - 1.0
    for a, b in ((5, 20), (20, 60), (30, 120)):
        out[f"sma_gap_{a}_{b}s"] = R(a).mean(c) / R(b).mean(c) - 1.0
    for n in (30, 120):
        out[f"trend_slope_{n}s"] = ratio(slope("close", n), R(n).mean(c))
    for n in (20, 60, 120):
        out[f"trend_r_squared_{n}s"] = r_squared("close", n)
    for n in (20, 60):
        out[f"trend_residual_zscore_{n}s"] = residual_zscore("close", n)
    return out


EMA_SPANS = (5, 10, 20, 30, 60, 120)


def ema_features(df: DataFrame) -> DataFrame:
    df = emas(
        df, {f"ema_{n}": ("close", 2.0 / (n + 1.0), n) for n in EMA_SPANS}, KEY, ORDER
    )
    out = {
        "ema_gap_5_20s": F.col("ema_5") / F.col("ema_20") - 1.0,
        "ema_gap_10_60s": F.col("ema_10") / F.col("ema_60") - 1.0,
    }
    for n in (10, 30, 60, 120):
        out[f"price_to_ema_{n}s"] = F.col("close") / F.col(f"ema_{n}") - 1.0
    return df.withColumns(out).drop(*[f"ema_{n}" for n in EMA_SPANS])


def with_inputs(panel: DataFrame) -> DataFrame:
    """Row-level inputs the frames read."""
    require_columns(
        panel,
        (KEY, ORDER, "session_close_utc", "open", "high", "low", "close", "volume",
         "close_to_close_return", "realized_volatility_1m"),
    )
    c = F.col("close")
    df = panel.withColumns(
        {
            "rn": F.row_number().over(frames.ordered(KEY, ORDER)),
            "log_return_1s": F.log1p("close_to_close_return"),
            "close_before": lag("close"),
            "range_fraction": ratio(F.col("high") - F.col("low"), c),
            "log_volume": F.log1p(clip("volume", 0.0, None)),
        }
    )
    before = F.col("close_before")
    return df.withColumns(
        {
            "return_before": lag("log_return_1s"),
            "close_step": c - before,
            "simple_return": c / before - 1.0,
            "true_range": F.greatest(
                F.col("high") - F.col("low"),
                F.abs(F.col("high") - before),
                F.abs(F.col("low") - before),
            ),
        }
    )


def peer_features(df: DataFrame) -> DataFrame:
    """Other symbols' previous calendar row, and rolling relation of own return to it.

    Date totals are one row per session.  A symbol's own share is taken out of the totals of
    the previous calendar position, so nothing is pivoted and no pair of symbols is formed.
    """
    df = number_calendar(df, ORDER)
    x = F.col("close_to_close_return")
    five = frames.steps(KEY, "cal", 5).product(x + 1.0) - 1.0
    df = df.withColumn("momentum_5", five)
    members = df.agg(F.count_distinct(KEY).alias("n")).scalar()
    totals = df.groupBy((F.col("cal") + 1).alias("cal")).agg(
        F.coalesce(F.sum(x), F.lit(0.0)).alias("all_return"),
        F.count(x).alias("n_return"),
        F.coalesce(F.sum("momentum_5"), F.lit(0.0)).alias("all_momentum"),
        F.count("momentum_5").alias("n_momentum"),
        F.count_if(x > 0).alias("n_up"),
    )
    df = df.withColumns(
        {
            "own_return": frames.step_lag(x, KEY, "cal"),
            "own_momentum": frames.step_lag("momentum_5", KEY, "cal"),
        }
    ).join(totals, "cal", "left")

    def others(total: str, count: str, own: str) -> Column:
        left = F.col(count) - F.when(F.col(own).isNotNull(), 1).otherwise(0)
        return ratio(
            F.col(total) - F.coalesce(F.col(own), F.lit(0.0)), left.cast("double")
        )

    up = F.when(F.col("own_return") > 0, 1).otherwise(0)
    df = df.withColumns(
        {
            "peer_return_lag1s": others("all_return", "n_return", "own_return"),
            "peer_momentum_5s_lag1s": others("all_momentum", "n_momentum", "own_momentum"),
            "peer_breadth_lag1s": (F.col("n_up") - up) / (members - 1),
        }
    )
    r, peer = "log_return_1s", "peer_return_lag1s"
    return df.withColumns(
        {
            "leadlag_correlation_20s": R(20).corr(r, peer),
            "leadlag_correlation_60s": R(60).corr(r, peer),
            "leadlag_beta_60s": ratio(R(60).cov(r, peer), R(60).var(peer)),
        }
    )


PEER_COLUMNS = (
    "peer_return_lag1s", "peer_momentum_5s_lag1s", "peer_breadth_lag1s",
    "leadlag_correlation_20s", "leadlag_correlation_60s", "leadlag_beta_60s",
)
EMA_COLUMNS = (
    "ema_gap_5_20s", "ema_gap_10_60s", "price_to_ema_10s", "price_to_ema_30s",
    "price_to_ema_60s", "price_to_ema_120s",
)


FAMILIES = ("return", "structure", "ema", "peer")


def session_features(panel: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """The feature table with a completeness flag; ask only for the families in use."""
    df = with_inputs(panel)
    names = ["log_return_1s"]
    own: dict[str, Column] = {}
    if "return" in families:
        names += ["range_fraction", "log_volume"]
        own.update(return_features())
    if "structure" in families:
        own.update(structure_features())
    if own:
        df = df.withColumns(own)
        names += list(own)
    if "structure" in families:
        base = "trend_slope_20s" if "return" in families else "__slope"
        if base == "__slope":
            df = df.withColumn(base, ratio(slope("close", 20), R(20).mean("close")))
        df = df.withColumn(
            "trend_slope_acceleration_20s", F.col(base) - lag(base, 5)
        )
        names.append("trend_slope_acceleration_20s")
    if "ema" in families:
        df = ema_features(df)
        names += EMA_COLUMNS
    if "peer" in families:
        df = peer_features(df)
        names += PEER_COLUMNS
    return df.select(
        KEY, ORDER, F.col("session_close_utc").alias("feature_available_at_utc"), *names
    ).withColumn("feature_set_complete", complete(names))


def realized_measures(minutes: DataFrame) -> DataFrame:
    """Daily variance, semivariance, bipower, jump and quarticity of one-minute log returns."""
    w = Window.partitionBy(KEY, ORDER).orderBy("timestamp_utc")
    r = F.log1p("return_1m")
    df = minutes.withColumn("r", r).withColumn("pair", F.abs("r") * F.abs(F.lag("r").over(w)))
    square = F.pow(F.col("r"), 2)
    zero = F.lit(0.0)
    rv = F.coalesce(F.sum(square), zero)
    bv = F.sum("pair") * (math.pi / 2.0)
    return df.groupBy(KEY, ORDER).agg(
        rv.alias("realized_variance"),
        F.sqrt(rv).alias("realized_volatility"),
        F.coalesce(F.sum(F.when(F.col("r") < 0, square)), zero).alias("downside_semivariance"),
        F.coalesce(F.sum(F.when(F.col("r") >= 0, square)), zero).alias("upside_semivariance"),
        bv.alias("bipower_variation"),
        F.when(bv.isNotNull(), F.greatest(rv - bv, zero)).alias("jump_variation"),
        (F.count("r") / 3.0 * F.sum(square * square)).alias("realized_quarticity"),
    )


def tape_pace(minutes: DataFrame) -> DataFrame:
    """Activity and distribution of the session's minute returns (at most 1440 per group)."""
    x = F.col("return_1m")
    q = F.percentile(x, F.array(*[F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    out = minutes.groupBy(KEY, ORDER).agg(
        (F.sum("volume") / F.count(F.lit(1))).alias("volume_per_observed_minute"),
        (F.coalesce(F.sum(F.abs(x)), F.lit(0.0)) / F.count(F.lit(1))).alias(
            "absolute_return_per_observed_minute"
        ),
        F.avg(F.when(x.isNotNull(), (x == 0).cast("double"))).alias("zero_return_fraction"),
        F.avg(F.when(x.isNotNull(), (x > 0).cast("double"))).alias("positive_return_fraction"),
        F.avg(F.signum(x)).alias("return_sign_imbalance"),
        q.alias("q"),
    )
    names = ("q10", "q25", "median", "q75", "q90")
    out = out.withColumns({f"intraday_return_{n}": F.col("q")[i] for i, n in enumerate(names)})
    return out.withColumns(
        {
            "intraday_return_iqr": F.col("intraday_return_q75") - F.col("intraday_return_q25"),
            "intraday_tail_imbalance": F.abs("intraday_return_q90")
            - F.abs("intraday_return_q10"),
        }
    ).drop("q")


def assemble(base: DataFrame, *more: DataFrame) -> DataFrame:
    """1:1 left joins on (symbol, trading_date); completeness over all joined columns.

    Keys of the added tables are grouped keys of their builders, hence unique.
    """
    df = base.drop("feature_set_complete")
    for extra in more:
        df = df.join(extra, [KEY, ORDER], "left")
    names = [c for c in df.columns if c not in (KEY, ORDER, "feature_available_at_utc")]
    return df.withColumn("feature_set_complete", complete(names))
