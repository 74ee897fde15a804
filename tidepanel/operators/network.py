"""Cross-asset structure: correlations, dependency networks, factor and VAR scores.

A panel row becomes one vector per time.  Rolling matrix work runs in grouped pandas over
blocks of consecutive times, each block carrying the earlier rows its windows need (a halo), so
blocks are independent tasks of bounded size and no row is made per pair of symbols.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import frames
from tidepanel.functions.scalars import entropy_confidence, mean_of, ratio, softmax


def vectors(df: DataFrame, time: list[str], name: str, values: list[str]) -> DataFrame:
    """One row per time: the sorted member names and an aligned array per value column."""
    names = df.agg(F.array_sort(F.collect_set(name)).alias("names")).scalar()
    packed = df.groupBy(*time).agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.col(name).alias("k"), F.struct(*values).alias("v")))
        ).alias("cells")
    )
    packed = packed.withColumn("names", names)
    return packed.select(
        *time,
        "names",
        *[
            F.transform("names", _cell(v)).alias(v)
            for v in values
        ],
    )


def _cell(field: str):
    """Lookup of one member's value in the packed map."""

    def at(member: Column) -> Column:
        return F.element_at(F.col("cells"), member).getField(field)

    return at


def pairwise_correlation(
    df: DataFrame, time: list[str], name: str, value: str, least: int
) -> DataFrame:
    """Pairwise-complete correlation of every pair of members with enough common rows.

    Each task reduces its rows to masked sums of one small matrix per statistic; only those are
    shuffled, so the rows of the panel are never joined with themselves.
    """
    wide = vectors(df, time, name, [value]).select("names", F.col(value).alias("x"))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, sums = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            names = list(pdf["names"].iloc[0])
            x = np.array([np.asarray(v, dtype=float) for v in pdf["x"]])
            m = (~np.isnan(x)).astype(float)
            x = np.where(m > 0, x, 0.0)
            parts = np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
            sums = parts if sums is None else sums + parts
        if names is None:
            return
        i, j = np.triu_indices(len(names), 1)
        label = np.array(names, dtype=object)
        yield pd.DataFrame(
            {
                "a": label[i], "b": label[j], "n": sums[0][i, j],
                "sa": sums[1][i, j], "sb": sums[1][j, i],
                "saa": sums[2][i, j], "sbb": sums[2][j, i], "sab": sums[3][i, j],
            }
        )

    schema = "a string, b string, n double, sa double, sb double, saa double, sbb double, sab double"
    sums = (
        wide.mapInPandas(partial, schema)
        .groupBy("a", "b")
        .agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    )
    n = F.col("n")
    va = n * F.col("saa") - F.pow("sa", F.lit(2))
    vb = n * F.col("sbb") - F.pow("sb", F.lit(2))
    rho = (n * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(va * vb)
    return sums.select(
        F.col("a").alias("member_a"),
        F.col("b").alias("member_b"),
        n.cast("long").alias("observations"),
        F.when((n >= least) & (va > 0) & (vb > 0), rho).alias("correlation"),
    )


def with_halo(df: DataFrame, number: str, block: int, halo: int) -> DataFrame:
    """Copy each row into every block whose windows reach it; ``owned`` marks its own block."""
    own = F.floor(F.col(number) / block)
    return df.withColumn(
        "block", F.explode(F.sequence(own, F.floor((F.col(number) + halo) / block)))
    ).withColumn("owned", F.col("block") == own)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=float) for v in column])


def correlation_concentration(
    panel: DataFrame, value: str = "close_to_close_return", window: int = 60, least: int = 20,
    block: int = 256,
) -> DataFrame:
    """Mean absolute pair correlation of the trailing rows, scaled by its earlier range."""
    from tidepanel.operators.calendar import number_calendar

    numbered = number_calendar(panel, "trading_date")
    wide = vectors(numbered, ["cal", "trading_date"], "symbol", [value])
    wide = with_halo(wide, "cal", block, window - 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cal", ignore_index=True)
        x = _matrix(pdf[value])
        out = []
        for t in np.flatnonzero(pdf["owned"].to_numpy()):
            first = np.searchsorted(pdf["cal"].to_numpy(), pdf["cal"].iloc[t] - window + 1)
            c = pd.DataFrame(x[first : t + 1]).corr(min_periods=least).to_numpy()
            upper = np.abs(c[np.triu_indices(x.shape[1], 1)])
            upper = upper[~np.isnan(upper)]
            out.append((pdf["trading_date"].iloc[t], upper.mean() if len(upper) else np.nan))
        return pd.DataFrame(out, columns=["trading_date", "concentration"])

    daily = wide.groupBy("block").applyInPandas(run, "trading_date date, concentration double")
    w = Window.orderBy("trading_date").rowsBetween(Window.unboundedPreceding, -1)
    enough = F.count("concentration").over(w) >= 120
    low, high = F.min("concentration").over(w), F.max("concentration").over(w)
    return daily.select(
        "trading_date",
        "concentration",
        F.when(enough, ratio(F.col("concentration") - low, high - low)).alias(
            "correlation_concentration"
        ),
    )


def neighbour_weights(edges: DataFrame, k: int) -> DataFrame:
    """Row-stochastic weights of the k strongest positive neighbours (ties kept).

    ``edges`` holds both directions: (key, i, j, rho).  A node without a positive neighbour
    spreads evenly over all nodes, itself included.
    """
    keys = ["key", "i"]
    rho = F.greatest(F.col("rho"), F.lit(0.0))
    df = edges.filter(F.col("i") != F.col("j")).withColumn("rho", rho)
    order = Window.partitionBy(*keys).orderBy(F.col("rho").desc())
    df = df.withColumn("kept", F.when(F.rank().over(order) <= k, F.col("rho")).otherwise(0.0))
    w = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(w) + 1
    total = F.sum("kept").over(w)
    linked = df.select(
        *keys, "j", F.when(total > 0, F.col("kept") / total).otherwise(1.0 / n).alias("weight")
    )
    loops = (
        df.groupBy(*keys)
        .agg(F.sum("kept").alias("total"), (F.count(F.lit(1)) + 1).alias("n"))
        .select(
            *keys, F.col("i").alias("j"),
            F.when(F.col("total") > 0, 0.0).otherwise(1.0 / F.col("n")).alias("weight"),
        )
    )
    return linked.unionByName(loops)


def _neighbours(c: np.ndarray, k: int) -> np.ndarray:
    v = np.where(c > 0, c, 0.0)
    np.fill_diagonal(v, 0.0)
    if k < v.shape[1]:
        cut = -np.sort(-v, axis=1)[:, k - 1 : k]
        v = np.where(v >= cut, v, 0.0)
    total = v.sum(axis=1, keepdims=True)
    return np.where(total > 0, v / np.where(total > 0, total, 1.0), 1.0 / v.shape[1])


def network_residuals(
    panel: DataFrame, settings: list[tuple[int, int]], k: int = 4, value: str = "ret",
    least_members: int = 6, block: int = 128,
) -> DataFrame:
    """Own standardized momentum minus its neighbours', for each (window, momentum) setting.

    Everything is measured on sessions strictly before the scored one.  ``panel`` is
    (cal, trading_date, symbol, value).
    """
    longest = max(max(w, m) for w, m in settings)
    wide = with_halo(
        vectors(panel, ["cal", "trading_date"], "symbol", [value]), "cal", block, longest
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cal", ignore_index=True)
        x, cal = _matrix(pdf[value]), pdf["cal"].to_numpy()
        names = np.array(list(pdf["names"].iloc[0]), dtype=object)
        out = []
        for t in np.flatnonzero(pdf["owned"].to_numpy()):
            for window, momentum in settings:
                if cal[t] - 1 < momentum:
                    continue
                past = x[np.searchsorted(cal, cal[t] - window) : t]
                if len(past) < max(30, window // 2):
                    continue
                whole = ~np.isnan(past).any(axis=0)
                deviation = np.full(len(names), np.nan)
                deviation[whole] = past[:, whole].std(axis=0, ddof=1)
                use = whole & (deviation > 0)
                if use.sum() < least_members:
                    continue
                weights = _neighbours(np.corrcoef(past[:, use], rowvar=False), k)
                recent = past[-momentum:, use]
                own = (recent / deviation[use]).sum(axis=0)
                residual = own - weights @ own
                spread = residual.std(ddof=1)
                if not spread > 0:
                    continue
                out.append(
                    pd.DataFrame(
                        {
                            "cal": cal[t], "trading_date": pdf["trading_date"].iloc[t],
                            "symbol": names[use], "window": window, "momentum": momentum,
                            "score": residual / spread,
                        }
                    )
                )
        columns = ["cal", "trading_date", "symbol", "window", "momentum", "score"]
        return pd.concat(out) if out else pd.DataFrame(columns=columns)

    return wide.groupBy("block").applyInPandas(
        run,
        "cal int, trading_date date, symbol string, window int, momentum int, score double",
    )


def balanced_entries(score: str, threshold: Column, keys: list[str], least: int = 6) -> Column:
    """Half the book on each tail of a date's scores; low scores get the negative half.

    The sign follows the behaviour being reproduced: entries lean with the dislocation.
    """
    w = Window.partitionBy(*keys)
    s = F.col(score)
    low, high = s <= -threshold, s >= threshold
    n_low = F.sum(F.when(low, 1).otherwise(0)).over(w)
    n_high = F.sum(F.when(high, 1).otherwise(0)).over(w)
    open_book = (F.count(s).over(w) >= least) & (n_low > 0) & (n_high > 0)
    return F.when(
        open_book, F.when(high, 0.5 / n_high).when(low, -0.5 / n_low).otherwise(0.0)
    ).otherwise(0.0)


def tail_weights(score: Column, threshold: Column, keys: list[str]) -> Column:
    """Against the sign of scores beyond the threshold, half the book per side, both needed."""
    w = Window.partitionBy(*keys)
    far = F.coalesce(F.abs(score) >= threshold, F.lit(False))
    up, down = far & (score < 0), far & (score > 0)
    n_up = F.sum(F.when(up, 1).otherwise(0)).over(w)
    n_down = F.sum(F.when(down, 1).otherwise(0)).over(w)
    return F.when(
        (n_up > 0) & (n_down > 0),
        F.when(up, 0.5 / n_up).when(down, -0.5 / n_down).otherwise(0.0),
    ).otherwise(0.0)


def cohort_positions(entered: str, held: Column, lengths: tuple[int, ...], keys: list[str]) -> Column:
    """Mean of the last K entries (lags 1..K); the first rows average the lags that exist."""
    w = frames.ordered(keys, "cal")
    value = F.lit(0.0)
    for n in lengths:
        mean = F.coalesce(F.avg(entered).over(w.rowsBetween(-n, -1)), F.lit(0.0))
        value = F.when(held == n, mean).otherwise(value)
    return value


def _complete(x: np.ndarray) -> np.ndarray:
    return x[~np.isnan(x).any(axis=1)]


def _session_blocks(bars: DataFrame, values: list[str], sessions: int, block: int) -> DataFrame:
    """Bar vectors keyed by session number, each block with the sessions before it."""
    from tidepanel.operators.calendar import number_calendar

    wide = vectors(bars, ["timestamp_utc", "trading_date"], "symbol", values)
    return with_halo(number_calendar(wide, "trading_date", "session"), "session", block, sessions)


def component_residuals(
    bars: DataFrame, value: str, sessions: tuple[int, ...] = (20, 40), block: int = 16
) -> DataFrame:
    """Residual to the first principal component fitted on the previous sessions' bars."""
    wide = _session_blocks(bars, [value], max(sessions), block)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp_utc", ignore_index=True)
        x, number = _matrix(pdf[value]), pdf["session"].to_numpy()
        names = np.array(list(pdf["names"].iloc[0]), dtype=object)
        out = []
        for day in np.unique(number[pdf["owned"].to_numpy()]):
            today = number == day
            for n in sessions:
                if day <= n:
                    continue
                past = _complete(x[(number >= day - n) & (number < day)])
                if len(past) < max(80, 3 * n):
                    continue
                scale = past.std(axis=0, ddof=1)
                if not (scale > 0).all():
                    continue
                z = past / scale
                axis = np.linalg.eigh(np.cov(z, rowvar=False))[1][:, -1]
                noise = (z - np.outer(z @ axis, axis)).std(axis=0, ddof=1)
                noise = np.where(noise > 0, noise, np.nan)
                current = x[today] / scale
                score = (current - np.outer(current @ axis, axis)) / noise
                out.append(_unstack(pdf.loc[today], names, score, train=n))
        return _stack(out, "train")

    return wide.groupBy("block").applyInPandas(
        run, "timestamp_utc timestamp, trading_date date, symbol string, train int, score double"
    ).filter(F.col("score").isNotNull() & ~F.isnan("score"))


def var_forecasts(
    bars: DataFrame, x: str, y: str, sessions: tuple[int, ...] = (20, 40),
    penalties: tuple[float, ...] = (10.0, 100.0), block: int = 16,
) -> DataFrame:
    """Multi-output ridge from this bar's returns to the next bar's, refit for every session."""
    wide = _session_blocks(bars, [x, y], max(sessions), block)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("timestamp_utc", ignore_index=True)
        a, b, number = _matrix(pdf[x]), _matrix(pdf[y]), pdf["session"].to_numpy()
        names = np.array(list(pdf["names"].iloc[0]), dtype=object)
        n_in = a.shape[1]
        out = []
        for day in np.unique(number[pdf["owned"].to_numpy()]):
            today = number == day
            for n in sessions:
                if day <= n:
                    continue
                span = (number >= day - n) & (number < day)
                past = _complete(np.hstack([a[span], b[span]]))
                if len(past) < max(80, 3 * n):
                    continue
                centre, scale = past.mean(axis=0), past.std(axis=0, ddof=1)
                if not (scale > 0).all():
                    continue
                z = (past - centre) / scale
                zx, zy = z[:, :n_in], z[:, n_in:]
                now = (a[today] - centre[:n_in]) / scale[:n_in]
                for penalty in penalties:
                    beta = np.linalg.solve(zx.T @ zx + penalty * np.eye(n_in), zx.T @ zy)
                    frame = _unstack(pdf.loc[today], names, now @ beta, train=n)
                    out.append(frame.assign(penalty=penalty))
        return _stack(out, "train", "penalty")

    return wide.groupBy("block").applyInPandas(
        run,
        "timestamp_utc timestamp, trading_date date, symbol string, train int, penalty double, "
        "score double",
    ).filter(F.col("score").isNotNull() & ~F.isnan("score"))


def _unstack(rows: pd.DataFrame, names: np.ndarray, score: np.ndarray, **extra) -> pd.DataFrame:
    n = len(names)
    return pd.DataFrame(
        {
            "timestamp_utc": np.repeat(rows["timestamp_utc"].to_numpy(), n),
            "trading_date": np.repeat(rows["trading_date"].to_numpy(), n),
            "symbol": np.tile(names, len(rows)),
            **extra,
            "score": score.ravel(),
        }
    )


def _stack(frames_: list[pd.DataFrame], *extra: str) -> pd.DataFrame:
    columns = ["timestamp_utc", "trading_date", "symbol", *extra, "score"]
    return pd.concat(frames_)[columns] if frames_ else pd.DataFrame(columns=columns)


# The four regimes.
REGIMES = (
    "low_volatility_trend", "high_volatility_trend", "mean_reverting_choppy", "stress_transition",
)
REGIME_INPUTS = {
    "trend": ("standardized_return_20s", "trend_efficiency_20s", "trend_efficiency_60s",
              "ema_gap_5_20s", "ema_gap_10_60s"),
    "volatility": ("realized_volatility_20s", "atr_14s_fraction", "return_volatility_20s"),
    "acceleration": ("volatility_ratio_5_20s", "range_zscore_20s"),
    "expansion": ("range_percentile_60s", "true_range_fraction"),
    "reversion": ("return_autocorrelation_20s", "standardized_return_5s"),
    "liquidity": ("volume_zscore_20s", "volume_per_observed_minute"),
}


def regime_probabilities(scaled: DataFrame, concentration: DataFrame) -> DataFrame:
    """Soft regime shares from the daily cross-symbol medians of scaled features."""
    present = [c for group in REGIME_INPUTS.values() for c in group if c in scaled.columns]
    daily = scaled.groupBy("trading_date").agg(
        *[F.percentile(c, F.lit(0.5)).alias(c) for c in present]
    )
    daily = daily.join(
        concentration.select("trading_date", "correlation_concentration"), "trading_date", "left"
    )

    def part(name: str, absolute: bool = False) -> Column:
        cols = [F.col(c) for c in REGIME_INPUTS[name] if c in scaled.columns]
        return mean_of([F.abs(c) if absolute else c for c in cols])

    daily = daily.withColumns(
        {
            "trend": part("trend", True), "volatility": part("volatility"),
            "acceleration": part("acceleration"), "expansion": part("expansion"),
            "reversion": -part("reversion"), "stress": -part("liquidity"),
        }
    )
    trend, vol, acc = F.col("trend"), F.col("volatility"), F.col("acceleration")
    link = F.coalesce("correlation_concentration", F.lit(0.0))
    scores = [
        trend - 0.75 * vol - 0.25 * acc,
        trend + 0.5 * vol + 0.5 * acc,
        F.col("reversion") - 0.5 * trend - 0.25 * F.col("expansion"),
        vol + acc + F.col("expansion") + link + 0.5 * F.col("stress"),
    ]
    daily = daily.withColumns({f"s{i}": s for i, s in enumerate(scores)})
    valid = F.lit(True)
    for i in range(4):
        valid = valid & F.col(f"s{i}").isNotNull()
    shares = softmax([F.col(f"s{i}") for i in range(4)])
    daily = daily.withColumns(
        {n: F.when(valid, p) for n, p in zip(REGIMES, shares)}
    )
    return daily.select(
        "trading_date", *REGIMES,
        entropy_confidence([F.col(n) for n in REGIMES]).alias("observable_confidence"),
        "correlation_concentration",
    )


def blend_regimes(observable: DataFrame, model: DataFrame, weight: float = 0.25) -> DataFrame:
    """Mix a model's regime table into the observable one where the model has a row."""
    if not 0.0 <= weight <= 0.5:
        raise ValueError("the model weight must be between 0 and 0.5")
    other = model.select(
        "trading_date", *[F.col(n).alias(f"model_{n}") for n in REGIMES], "model_confidence"
    )
    df = observable.join(other, "trading_date", "left")
    there = F.col("model_confidence").isNotNull()
    df = df.withColumns(
        {
            f"ensemble_{n}": F.when(
                there, (1.0 - weight) * F.col(n) + weight * F.col(f"model_{n}")
            ).otherwise(F.col(n))
            for n in REGIMES
        }
    )
    return df.withColumns(
        {
            "ensemble_confidence": entropy_confidence([F.col(f"ensemble_{n}") for n in REGIMES]),
            "model_available": there,
        }
    )


def exposure_multiplier() -> Column:
    """Risk multiplier from the blended regimes, pulled to one by low confidence; NULL is one."""
    trend = F.col("ensemble_low_volatility_trend") + F.col("ensemble_high_volatility_trend")
    raw = 0.65 + 0.70 * trend - 0.35 * F.col("ensemble_stress_transition")
    raw = F.when(raw.isNotNull(), F.greatest(F.least(raw, F.lit(1.15)), F.lit(0.35)))
    sure = F.greatest(F.least(F.coalesce("ensemble_confidence", F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return F.coalesce(1.0 + sure * (raw - 1.0), F.lit(1.0))


def complementary_weights(
    series: DataFrame, name: str, value: str, window: int = 60, least: int = 20, cap: float = 0.35,
    block: int = 256,
) -> DataFrame:
    """Causal inverse-volatility and correlation-adjusted weights of dense return series.

    Both look at the rows before the date only; until enough exist the weights are equal.
    """
    from tidepanel.operators.calendar import number_calendar

    wide = vectors(number_calendar(series, "trading_date"), ["cal", "trading_date"], name, [value])
    wide = with_halo(wide, "cal", block, window)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cal", ignore_index=True)
        x, cal = _matrix(pdf[value]), pdf["cal"].to_numpy()
        names = np.array(list(pdf["names"].iloc[0]), dtype=object)
        n = len(names)
        out = []
        for t in np.flatnonzero(pdf["owned"].to_numpy()):
            past = x[np.searchsorted(cal, cal[t] - window) : t]
            inverse = np.full(n, 1.0 / n)
            adjusted = np.full(n, 1.0 / n)
            if len(past) >= least:
                cov = np.cov(past, rowvar=False)
                sigma = np.sqrt(np.diag(cov))
                raw = np.where(sigma > 0, 1.0 / np.where(sigma > 0, sigma, 1.0), np.nan)
                share = raw / np.nansum(raw)
                inverse = np.where(np.isnan(share), 1.0 / n, share)
                sigma = np.maximum(sigma, 1e-8)
                rho = cov / np.outer(sigma, sigma)
                penalty = 1.0 + np.abs(rho - np.eye(n)).mean(axis=1)
                raw = 1.0 / (sigma * penalty)
                raw = np.minimum(raw / raw.sum(), cap)
                adjusted = raw / raw.sum()
            out.append(
                pd.DataFrame(
                    {
                        "trading_date": pdf["trading_date"].iloc[t], name: names,
                        "equal_weight": 1.0 / n, "causal_inverse_volatility": inverse,
                        "causal_correlation_adjusted": adjusted,
                    }
                )
            )
        return pd.concat(out)

    return wide.groupBy("block").applyInPandas(
        run,
        f"trading_date date, {name} string, equal_weight double, "
        "causal_inverse_volatility double, causal_correlation_adjusted double",
    )


ALLOCATIONS = ("equal_weight", "causal_inverse_volatility", "causal_correlation_adjusted")


def complementary_portfolios(series: DataFrame, weights: DataFrame, name: str) -> DataFrame:
    """Gross and turnover of each allocation; reweighting is charged as turnover too."""
    df = series.join(weights, ["trading_date", name])
    w = frames.ordered(name, "trading_date")
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("allocation"), F.col(a).alias("weight"),
                F.abs(F.col(a) - F.coalesce(F.lag(a).over(w), F.lit(0.0))).alias("change"),
            )
            for a in ALLOCATIONS
        ]
    )
    long = df.withColumn("rows", rows).select("trading_date", "gross", "sides", F.inline("rows"))
    return long.groupBy("allocation", "trading_date").agg(
        F.sum(F.col("gross") * F.col("weight")).alias("gross"),
        (F.sum(F.col("sides") * F.col("weight")) + F.sum("change")).alias("turnover"),
    )
