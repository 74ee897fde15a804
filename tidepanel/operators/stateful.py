"""Keyed folds that are sequential by nature; every group is one session or one series."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SESSION_MINUTES = 23 * 60


def hysteresis_walk(
    score: np.ndarray, minute: np.ndarray, entry: float, leave: float, cap: int,
    state: float = 0.0, age: int = 0,
) -> tuple[np.ndarray, float, int]:
    """On/off state of one session's ordered scores, continuing from (state, age)."""
    out = np.zeros(len(score))
    for i, (x, m) in enumerate(zip(score, minute)):
        if m >= SESSION_MINUTES - 5:
            state, age = 0.0, 0
        if state == 0.0:
            if abs(x) >= entry:
                state, age = float(np.sign(x)), 0
        else:
            age += 1
            if abs(x) <= leave or np.sign(x) != state or age >= cap:
                state, age = 0.0, 0
        out[i] = state
    return out, state, age


def hysteresis(
    df: DataFrame, score: str, entry: float = 0.55, leave: float = 0.15, cap: int = 60
) -> DataFrame:
    """Alert state per (symbol, trading date): on beyond entry, off inside leave, on a sign
    flip or after ``cap`` minutes; switched off in the last five minutes before the entry test.

    Sessions are independent and hold at most one row per minute, so groups are small and a hot
    symbol is spread over its sessions.
    """
    slim = df.select("symbol", "trading_date", "timestamp_utc", "session_minute", score)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp_utc", ignore_index=True)
        states, _, _ = hysteresis_walk(
            pdf[score].fillna(0.0).to_numpy(float), pdf["session_minute"].to_numpy(), entry, leave, cap
        )
        return pdf[["symbol", "trading_date", "timestamp_utc"]].assign(position_signal=states)

    return slim.groupBy("symbol", "trading_date").applyInPandas(
        run, "symbol string, trading_date date, timestamp_utc timestamp, position_signal double"
    )


class Trail(NamedTuple):
    """A stop that trails a run of bars, in coordinates that grow in the run's direction.

    ``side`` is 1 for a rising run and -1 for a falling one; ``level``, ``ahead`` (the furthest the run has
    come) and ``behind`` (the furthest against it) are prices times the side.  ``high`` and ``low`` are the last bar.
    """

    side: float
    level: float
    factor: float
    ahead: float
    behind: float
    high: float
    low: float

    @classmethod
    def first(cls, high: float, low: float, step: float) -> Trail:
        return cls(-1.0, -high, step, -low, -high, high, low)

    def advance(self, high: float, low: float, step: float, limit: float) -> Trail:
        """The trail after one more bar.

        A bar that reaches the level turns the trail: the run that ends gives the new level, its furthest
        price, and the bar alone is the new run.  Otherwise a bar that goes further raises the factor.  The
        level then goes the factor's part of the way ahead, but never beyond the last two bars.
        """
        side, level, factor = self.side, self.level, self.factor
        ahead, behind = max(self.ahead, _ahead(side, high, low)), min(self.behind, -_ahead(-side, high, low))
        if -_ahead(-side, high, low) <= level:
            side, level, factor = -side, -ahead, step
            ahead, behind = _ahead(side, high, low), -_ahead(-side, high, low)
        elif ahead > self.ahead:
            factor = min(factor + step, limit)
        level += factor * (ahead - level)
        level = min(level, -_ahead(-side, high, low), -_ahead(-side, self.high, self.low))
        return Trail(side, level, factor, ahead, behind, high, low)


def _ahead(side: float, high: float, low: float) -> float:
    """How far a bar comes in the direction of a side."""
    return high if side > 0 else -low


def parabolic_sar(df: DataFrame, name: str, key: str, order: str, step: float, limit: float) -> DataFrame:
    """One series per key; series are hourly bars, bounded by the calendar."""
    slim = df.select(key, order, "high", "low")
    schema = f"{key} string, {order} timestamp, {name} double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        trail, levels = None, []
        for high, low in zip(pdf["high"].astype(float), pdf["low"].astype(float), strict=True):
            trail = Trail.first(high, low, step) if trail is None else trail.advance(high, low, step, limit)
            levels.append(trail.side * trail.level)
        return pdf[[key, order]].assign(**{name: np.array(levels, float)})

    return df.join(slim.groupBy(key).applyInPandas(run, schema), [key, order])
