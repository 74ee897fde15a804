import datetime as dt

import numpy as np
import pandas as pd


def seeded_panel(spark, days=150, symbols=("A", "B", "C"), seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, days)))
        for i in range(days):
            day = dt.date(2020, 1, 1) + dt.timedelta(days=i)
            span = abs(rng.normal(0, 0.5)) + 0.1
            prior = close[i - 1] if i else None
            numbers = (
                close[i] * (1 + rng.normal(0, 0.002)), close[i] + span, close[i] - span, close[i],
                rng.integers(10, 100),
            )
            rows.append(
                (s, day, dt.datetime.combine(day, dt.time(22)), *[float(v) for v in numbers],
                 None if prior is None else float(close[i] / prior - 1.0), float(abs(rng.normal(0, 0.01))))
            )
    return spark.createDataFrame(
        rows,
        "symbol string, trading_date date, session_close_utc timestamp, open double, high double, "
        "low double, close double, volume double, close_to_close_return double, "
        "realized_volatility_1m double",
    )


def assert_prefix_invariant(fn, df, cutoff, keys=("symbol", "trading_date"), time="trading_date"):
    """Rows up to the cutoff must not change when later rows are appended."""
    short = fn(df.filter(df[time] <= cutoff)).toPandas()
    full = fn(df)
    full = full.filter(full[time] <= cutoff).toPandas()
    short = short.sort_values(list(keys)).reset_index(drop=True)
    full = full.sort_values(list(keys)).reset_index(drop=True)
    assert len(short) == len(full) > 0
    pd.testing.assert_frame_equal(short[full.columns], full, rtol=1e-9, atol=1e-12)
