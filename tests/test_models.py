"""Matrix studies, fits and selection against brute force on small seeded frames."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import displacement as D
from tidepanel.operators import models as M
from tidepanel.operators import network as G
from tidepanel.operators import orders as O
from tidepanel.operators import selection as K

NAMES = list("abcd")


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(11)
    rows = []
    for day in range(26):
        for bar in range(8):
            t = dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=bar)
            common = rng.normal()
            for n in NAMES:
                rows.append((n, t, t.date(), common + rng.normal(), rng.normal()))
    return spark.createDataFrame(
        rows, "symbol string, timestamp_utc timestamp, trading_date date, x double, y double"
    )


def wide(bars, column):
    return bars.toPandas().pivot(index="timestamp_utc", columns="symbol", values=column).sort_index()


def test_component_residuals(bars):
    got = G.component_residuals(bars, "x", (20,), block=3).toPandas()
    x = wide(bars, "x")
    day = x.index.normalize()
    target = sorted(day.unique())[22]
    past = x[(day < target) & (day >= sorted(day.unique())[2])]
    scale = past.std()
    z = (past / scale).to_numpy()
    axis = np.linalg.eigh(np.cov(z, rowvar=False))[1][:, -1]
    noise = (z - np.outer(z @ axis, axis)).std(axis=0, ddof=1)
    now = (x[day == target] / scale).to_numpy()
    want = (now - np.outer(now @ axis, axis)) / noise
    part = got[pd.to_datetime(got["trading_date"]) == target].pivot(
        index="timestamp_utc", columns="symbol", values="score"
    )
    np.testing.assert_allclose(part.to_numpy(), want, atol=1e-9)
    assert got["trading_date"].nunique() == 6


def test_component_residuals_ignore_later_sessions(bars):
    cut = dt.date(2024, 1, 23)
    full = G.component_residuals(bars, "x", (20,)).filter(F.col("trading_date") <= F.lit(cut)).toPandas()
    short = G.component_residuals(bars.filter(F.col("trading_date") <= F.lit(cut)), "x", (20,)).toPandas()
    key = ["timestamp_utc", "symbol"]
    np.testing.assert_allclose(full.sort_values(key)["score"], short.sort_values(key)["score"])


def test_var_forecasts(bars):
    got = G.var_forecasts(bars, "x", "y", (20,), (10.0,), block=5).toPandas()
    x, y = wide(bars, "x"), wide(bars, "y")
    day = x.index.normalize()
    days = sorted(day.unique())
    target = days[21]
    span = (day < target) & (day >= days[1])
    zx, zy = ((v[span] - v[span].mean()) / v[span].std() for v in (x, y))
    beta = np.linalg.solve(zx.T.to_numpy() @ zx.to_numpy() + 10 * np.eye(4), zx.T.to_numpy() @ zy.to_numpy())
    want = ((x[day == target] - x[span].mean()) / x[span].std()).to_numpy() @ beta
    part = got[pd.to_datetime(got["trading_date"]) == target].pivot(
        index="timestamp_utc", columns="symbol", values="score"
    )
    np.testing.assert_allclose(part.to_numpy(), want, atol=1e-9)


def test_pooled_ridge_equals_dense_solve(spark):
    rng = np.random.default_rng(4)
    n = 200
    x = rng.normal(size=(n, 2))
    x[rng.random(n) < 0.2, 0] = np.nan
    y = rng.normal(size=n)
    symbols = np.where(np.arange(n) % 2 == 0, "a", "b")
    rows = [
        (1, symbols[i], None if np.isnan(x[i, 0]) else float(x[i, 0]), float(x[i, 1]), float(y[i])) for i in range(n)
    ]
    df = spark.createDataFrame(rows, "fold int, symbol string, p double, q double, target double")
    forecast, _ = M.pooled_ridge(df, df, ["p", "q"], ["a", "b"], alpha=10.0)
    got = forecast.toPandas()["forecast"].to_numpy()
    filled = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    gap = np.isnan(x[:, 0]).astype(float)
    cols = [filled[:, 0], filled[:, 1], gap]
    scaled = []
    for c in cols:
        q1, q2, q3 = np.quantile(c, [0.25, 0.5, 0.75])
        scaled.append((c - q2) / ((q3 - q1) or 1.0))
    z = np.column_stack([*scaled, symbols == "a", symbols == "b"]).astype(float)
    zc = z - z.mean(axis=0)
    beta = np.linalg.solve(zc.T @ zc + 10 * np.eye(z.shape[1]), zc.T @ (y - y.mean()))
    want = y.mean() + zc @ beta
    np.testing.assert_allclose(np.sort(got), np.sort(want), atol=1e-9)


def test_greedy_pass_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(3, 80))
    series = {f"s{i:02d}": base[i % 3] + 0.3 * rng.normal(size=80) for i in range(12)}
    rows = [
        ("all", n, f"y{i % 4}", float(rng.random()), [float(v) for v in s]) for i, (n, s) in enumerate(series.items())
    ]
    df = spark.createDataFrame(rows, "key string, strategy string, symbol string, score double, series array<double>")
    got = [
        r.strategy
        for r in K.greedy_pruned(df, ["key"], "score", target=5, per_symbol=2, maximum_correlation=0.65)
        .orderBy("pick").collect()
    ]
    want, used = [], {}
    for _, n, sym, _, s in sorted(rows, key=lambda r: -r[3]):
        if used.get(sym, 0) >= 2 or any(abs(np.corrcoef(s, series[w])[0, 1]) > 0.65 for w in want):
            continue
        want.append(n)
        used[sym] = used.get(sym, 0) + 1
        if len(want) == 5:
            break
    assert got == want


def test_displacement_is_zero_on_a_line_and_orders_are_causal(spark):
    rows = []
    for i in range(160):
        t = dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
        p = float(np.exp(0.001 * i))
        rows.append(("a", t, t.date(), t, p, p * 1.01, p * 0.99, p, 10))
    df = spark.createDataFrame(
        rows,
        "symbol string, hour_start_utc timestamp, trading_date date, feature_available_at_utc timestamp, "
        "open double, high double, low double, close double, volume long",
    )
    out = D.own_features(df).filter("regression_displacement_24h IS NOT NULL")
    assert out.agg(F.max(F.abs("regression_displacement_24h"))).first()[0] < 1e-9


def test_orders_do_not_change_when_bars_are_appended(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(220):
        t = dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
        c = 100 + 5 * np.sin(i / 9) + 0.02 * i + rng.normal(0, 0.2)
        rows.append(("a", t, float(c - 0.1), float(c + 0.6), float(c - 0.6), float(c), 10))
    df = spark.createDataFrame(
        rows, "symbol string, timestamp_utc timestamp, open double, high double, low double, close double, volume long"
    )
    cut = dt.datetime(2024, 1, 7)
    for name in ("bollinger_breakout", "dual_macd", "prior_day_range"):
        build, rule = O.BUILDERS[name], O.RULES[name]
        short = build(df.filter(F.col("timestamp_utc") < F.lit(cut)), rule).toPandas()
        full = build(df, rule).filter(F.col("decision_time") <= F.lit(cut)).toPandas()
        order = ["decision_time"]
        pd.testing.assert_frame_equal(
            short.sort_values(order).reset_index(drop=True), full.sort_values(order).reset_index(drop=True)
        )
