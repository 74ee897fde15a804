"""Rolling regression state of hourly bars, its targets and conditional statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import frames
from tidepanel.functions.scalars import clip, complete, ratio
from tidepanel.operators.calendar import number_calendar

KEY, ORDER = "symbol", "hour_start_utc"
# Label horizons in hours, and those that are modelled.
TARGET_HORIZONS = (1, 2, 4, 8, 23, 46, 69, 115)
MODEL_HORIZONS = (8, 23, 115)
BANDS = ((1.0, "under_1"), (2.0, "1_to_2"), (3.0, "2_to_3"), (None, "over_3"))


def R(n: int, least: int | None = None, end: int = 0) -> frames.Frame:
    return frames.rows(KEY, ORDER, n, least, end)


def lag(x: str, k: int = 1) -> Column:
    return F.lag(x, k).over(frames.ordered(KEY, ORDER))


def linear_state(y: str, n: int) -> dict[str, Column]:
    """Slope, endpoint, fit and errors of the line through the last n values."""
    f = R(n)
    w = f.window
    yc, x = F.col(y), F.col("rn")
    middle = (n - 1) / 2.0
    sxx = n * (n * n - 1) / 12.0
    slope = F.regr_slope(yc, x).over(w)
    total = F.greatest(F.regr_syy(yc, x).over(w), F.lit(0.0))
    fit = slope * slope * sxx
    error = F.sqrt(F.greatest(total - fit, F.lit(0.0)) / max(n - 2, 1))
    reach = math.sqrt(1.0 + 1.0 / n + (n - 1 - middle) ** 2 / sxx)
    out = {
        "fitted": F.avg(yc).over(w) + slope * (n - 1 - middle),
        "slope": slope,
        "r_squared": clip(ratio(fit, total), 0.0, 1.0),
        "residual_error": error,
        "prediction_error": error * reach,
    }
    return {k: f._guard(yc, v) for k, v in out.items()}


def run_length(outside: Column, rn: str = "rn") -> Column:
    """Consecutive rows for which the condition holds: distance to the last row it did not."""
    w = frames.ordered(KEY, ORDER).rowsBetween(frames.Window.unboundedPreceding, 0)
    last_inside = F.coalesce(F.max(F.when(~outside, F.col(rn))).over(w), F.lit(0))
    return F.when(outside, F.col(rn) - last_inside).otherwise(0).cast("double")


def own_features(bars: DataFrame) -> DataFrame:
    """Single-asset columns: displacement from the line, its scale, persistence and activity."""
    df = bars.withColumns(
        {
            "rn": F.row_number().over(frames.ordered(KEY, ORDER)),
            "log_price": F.log("close"),
        }
    )
    df = df.withColumn("log_return_1h", F.col("log_price") - lag("log_price"))
    short, long = linear_state("log_price", 24), linear_state("log_price", 120)
    df = df.withColumns(
        {
            "fitted_log_price_24h": short["fitted"],
            "prediction_error_24h": short["prediction_error"],
            "regression_slope_24h": short["slope"],
            "regression_r_squared_24h": short["r_squared"],
            "fitted_log_price_120h": long["fitted"],
            "regression_slope_120h": long["slope"],
            "regression_r_squared_120h": long["r_squared"],
        }
    )
    df = df.withColumns(
        {
            "regression_displacement_24h": F.col("log_price") - F.col("fitted_log_price_24h"),
            "regression_displacement_120h": F.col("log_price") - F.col("fitted_log_price_120h"),
        }
    )
    d = "regression_displacement_24h"
    r = "log_return_1h"
    df = df.withColumn("displacement_before", lag(d))
    hourly = R(24).std(r)
    span = (F.col("high") - F.col("low")) / F.col("close")
    df = df.withColumn("hourly_range", span)
    volume = F.col("volume").cast("double")
    df = df.withColumns(
        {
            "regression_residual_zscore_24h": ratio(d, R(120, 48).std(d)),
            "prediction_interval_position_24h": ratio(d, "prediction_error_24h"),
            "regression_slope_change_4h": F.col("regression_slope_24h")
            - lag("regression_slope_24h", 4),
            "residual_volatility_24h": R(24).std(d),
            "residual_to_asset_volatility_24h": ratio(R(24).std(d), hourly),
            "residual_autocorrelation_120h": R(120, 48).corr(d, "displacement_before"),
            "regression_residual_zscore_120h": ratio(
                "regression_displacement_120h", R(240, 120).std("regression_displacement_120h")
            ),
            "realized_volatility_24h": hourly * math.sqrt(23.0 * 252.0),
            "volatility_ratio_24h_120h": ratio(hourly, R(120, 48).std(r)),
            "range_expansion_24h": ratio("hourly_range", R(120, 48).median("hourly_range")),
            "volume_zscore_24h": ratio(
                volume - R(120, 48).mean(volume), R(120, 48).std(volume)
            ),
            "trend_efficiency_24h": ratio(
                F.abs(F.col("log_price") - lag("log_price", 24)), R(24).sum(F.abs(r))
            ),
        }
    )
    ac = F.col("residual_autocorrelation_120h")
    half = F.when(ac == 0, 1.0).otherwise(clip(-math.log(2.0) / F.log(ac), 1.0, 240.0))
    z = "regression_residual_zscore_24h"
    far = F.coalesce(F.abs(z) >= 2.0, F.lit(False))
    df = df.withColumns(
        {
            "residual_half_life_120h": F.when(ac.between(0.0, 0.999999), half),
            "outside_two_sigma_run": run_length(far),
            "displacement_speed_1h": F.col(z) - lag(z),
        }
    )
    return df.withColumn(
        "displacement_acceleration_1h",
        F.col("displacement_speed_1h") - lag("displacement_speed_1h"),
    )


def peer_features(df: DataFrame) -> DataFrame:
    """Relation to the other symbols' hourly mean on the shared hour calendar."""
    df = number_calendar(df, ORDER)
    r, peer = "log_return_1h", "peer_return_1h"

    def C(n: int, least: int | None = None) -> frames.Frame:
        return frames.steps(KEY, "cal", n, least)

    df = df.withColumn(peer, F.when(F.col(r).isNotNull(), frames.leave_one_out(r, "cal")))
    beta = ratio(C(120, 48).cov(r, peer), C(120, 48).var(peer))
    df = df.withColumn("factor_residual", F.col(r) - beta * F.col(peer))
    scale = C(120, 48).std("factor_residual") * math.sqrt(24.0)
    return df.withColumns(
        {
            "factor_residual_zscore_24h": ratio(C(24).sum("factor_residual"), scale),
            "cross_asset_correlation_120h": C(120, 48).corr(r, peer),
        }
    )


OWN_COLUMNS = (
    "regression_displacement_24h", "regression_residual_zscore_24h",
    "prediction_interval_position_24h", "regression_slope_24h", "regression_slope_change_4h",
    "regression_r_squared_24h", "residual_volatility_24h", "residual_to_asset_volatility_24h",
    "residual_autocorrelation_120h", "residual_half_life_120h", "outside_two_sigma_run",
    "displacement_speed_1h", "displacement_acceleration_1h", "regression_residual_zscore_120h",
    "regression_slope_120h", "regression_r_squared_120h", "realized_volatility_24h",
    "volatility_ratio_24h_120h", "range_expansion_24h", "volume_zscore_24h",
    "trend_efficiency_24h",
)
PEER_COLUMNS = ("peer_return_1h", "factor_residual_zscore_24h", "cross_asset_correlation_120h")
REGIME_COLUMNS = ("prior_trend_probability", "prior_stress_probability")
FEATURES = (*OWN_COLUMNS, *PEER_COLUMNS, *REGIME_COLUMNS)


def regression_features(bars: DataFrame, regimes: DataFrame | None = None) -> DataFrame:
    """All hourly columns; regime shares are those of the previous day in the regime table."""
    df = peer_features(own_features(bars))
    if regimes is None:
        df = df.withColumns({c: F.lit(None).cast("double") for c in REGIME_COLUMNS})
    else:
        w = frames.Window.orderBy("trading_date")
        trend = F.col("ensemble_low_volatility_trend") + F.col("ensemble_high_volatility_trend")
        prior = regimes.select(
            "trading_date",
            F.lag(trend).over(w).alias("prior_trend_probability"),
            F.lag("ensemble_stress_transition").over(w).alias("prior_stress_probability"),
        )
        df = df.join(prior, "trading_date", "left")
    return df.withColumn("regression_feature_set_complete", complete(list(FEATURES)))


def first_passage(h: int) -> dict[str, Column]:
    """Half reversion before a half extension within the next h bars, and its first step.

    The path is measured from the line projected from the current bar.  Bars without h later
    ones, and bars on the line, have no label.
    """
    w = frames.ordered(KEY, ORDER).rowsBetween(1, h)
    path = F.transform(
        F.collect_list("log_price").over(w),
        lambda p, i: p
        - (F.col("fitted_log_price_24h") + F.col("regression_slope_24h") * (i + 1)),
    )
    size = F.abs("regression_displacement_24h")
    near = F.array_position(F.transform(path, lambda p: F.abs(p) <= 0.5 * size), True)
    far = F.array_position(F.transform(path, lambda p: F.abs(p) >= 1.5 * size), True)
    known = (F.count(F.lit(1)).over(w) == h) & (size >= 1e-12)
    hit = (near > 0) & ((far == 0) | (near < far))
    return {
        f"target_before_stop_{h}h": F.when(known, hit.cast("double")),
        f"time_to_half_reversion_{h}h": F.when(known & (near > 0), near.cast("double")),
    }


def regression_targets(features: DataFrame, horizons: tuple[int, ...] = TARGET_HORIZONS) -> DataFrame:
    """Future return, displacement change, partial and complete reversion, first passage."""
    if any(h < 1 for h in horizons):
        raise ValueError("target horizons must be positive")
    w = frames.ordered(KEY, ORDER)
    d = F.col("regression_displacement_24h")
    out: dict[str, Column] = {}
    for h in horizons:
        ahead = F.lead("log_price", h).over(w)
        line = F.col("fitted_log_price_24h") + F.col("regression_slope_24h") * h
        later = ahead - line
        no = F.lit(False)
        out[f"future_log_return_{h}h"] = ahead - F.col("log_price")
        out[f"label_available_at_{h}h_utc"] = F.lead("feature_available_at_utc", h).over(w)
        out[f"future_displacement_change_{h}h"] = later - d
        out[f"partial_reversion_at_{h}h"] = F.when(
            ahead.isNotNull(), F.coalesce(F.abs(later) <= 0.5 * F.abs(d), no).cast("double")
        )
        out[f"complete_reversion_at_{h}h"] = F.when(
            ahead.isNotNull(), F.coalesce(later * d <= 0, no).cast("double")
        )
        out.update(first_passage(h))
    return features.select(KEY, "trading_date", ORDER, *[c.alias(n) for n, c in out.items()])


def displacement_band(z: str) -> Column:
    """Right-closed bands of the absolute score; zero falls in the first."""
    x = F.abs(z)
    out = None
    for edge, label in BANDS:
        test = x.isNotNull() if edge is None else x <= edge
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def conditional_reversion(df: DataFrame, keys: list[str], horizons: tuple[int, ...] = TARGET_HORIZONS) -> DataFrame:
    """Rates and median time per band and horizon; horizons are unpivoted from one row."""
    rows = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon_hours"),
                F.col(f"target_before_stop_{h}h").alias("hit"),
                F.col(f"partial_reversion_at_{h}h").alias("partial"),
                F.col(f"complete_reversion_at_{h}h").alias("complete"),
                F.col(f"time_to_half_reversion_{h}h").alias("time"),
            )
            for h in horizons
        ]
    )
    long = df.withColumn(
        "displacement_band", displacement_band("regression_residual_zscore_24h")
    ).filter(F.col("displacement_band").isNotNull())
    long = long.select(*keys, "displacement_band", F.inline(rows))
    return long.groupBy(*keys, "displacement_band", "horizon_hours").agg(
        F.count("hit").alias("observations"),
        F.avg("hit").alias("target_before_stop_rate"),
        F.avg("partial").alias("partial_reversion_rate"),
        F.avg("complete").alias("complete_reversion_rate"),
        F.percentile("time", F.lit(0.5)).alias("median_time_to_half_reversion"),
    )
