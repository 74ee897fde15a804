"""Session features, realized measures, smoothing and their SQL."""

from pyspark.sql import functions as F

from tidepanel.functions.scalars import tidy
from tidepanel.operators import features as X
from tidepanel.operators import smoothing
from tidepanel.registry.base import query, r, shared
from tidepanel.sources import tables as src


def guard(expr: str, n: int, x: str, window: str) -> str:
    return f"CASE WHEN count({x}) OVER {window} >= {n} THEN {expr} END"


def rolled(fn: str, x: str, n: int) -> str:
    return guard(f"{fn}({x}) OVER w{n}", n, x, f"w{n}")


def _named_windows(sizes, key="symbol", order="trading_date") -> str:
    return "WINDOW w AS (PARTITION BY {k} ORDER BY {o}), ".format(k=key, o=order) + ", ".join(
        f"w{n} AS (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND "
        "CURRENT ROW)"
        for n in sizes
    )


SIZES = (2, 4, 5, 10, 14, 19, 20, 30, 59, 60, 120)
WINDOWS = _named_windows(SIZES)

shared(
    t_in1="""
SELECT *, row_number() OVER w AS rn, ln(1 + close_to_close_return) AS lr, lag(close) OVER w AS pc,
       (high - low) / close AS rf, ln(1 + greatest(volume, 0)) AS lv
FROM t_panel WINDOW w AS (PARTITION BY symbol ORDER BY trading_date)
""",
    t_in2="""
SELECT *, lag(lr) OVER w AS lr1, close - pc AS step, close / pc - 1 AS sr,
       greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
       pow(ln(high / low), 2) AS hl2, pow(ln(close / open), 2) AS co2
FROM t_in1 WINDOW w AS (PARTITION BY symbol ORDER BY trading_date)
""",
)

RETURN_SQL = {
    "reversal_1s": "-lr",
    **{f"momentum_{n}s": f"exp({rolled('sum', 'lr', n)}) - 1" for n in X.MOMENTUM},
    **{
        f"standardized_return_{n}s": f"({rolled('sum', 'lr', n)}) / nullif(({rolled('stddev_samp', 'lr', n)}) * sqrt({n}.0), 0)"
        for n in (5, 20, 60)
    },
    "return_zscore_20s": f"(lr - ({rolled('avg', 'lr', 20)})) / nullif({rolled('stddev_samp', 'lr', 20)}, 0)",
    **{f"price_to_sma_{n}s": f"close / ({rolled('avg', 'close', n)}) - 1" for n in (5, 10, 20, 30, 60, 120)},
    **{
        f"trend_slope_{n}s": guard(
            f"(covar_pop(close, rn) OVER w{n}) / (({n * n}.0 - 1) / 12) / avg(close) OVER w{n}",
            n, "close", f"w{n}",
        )
        for n in (20, 30, 60, 120)
    },
    **{
        f"trend_efficiency_{n}s": f"CASE WHEN rn >= {n} THEN abs(close - lag(close, {n - 1}) OVER w) / nullif(sum(abs(step)) OVER w{n - 1}, 0) END"
        for n in (20, 60)
    },
    **{f"realized_volatility_{n}s": rolled("avg", "realized_volatility_1m", n) for n in (5, 20)},
    **{f"return_volatility_{n}s": rolled("stddev_samp", "lr", n) for n in (5, 20, 60)},
    "volatility_ratio_5_20s": f"({rolled('stddev_samp', 'lr', 5)}) / nullif({rolled('stddev_samp', 'lr', 20)}, 0)",
    "volatility_ratio_20_60s": f"({rolled('stddev_samp', 'lr', 20)}) / nullif({rolled('stddev_samp', 'lr', 60)}, 0)",
    "downside_volatility_20s": guard(
        "stddev_samp(CASE WHEN lr IS NOT NULL THEN least(lr, 0) END) OVER w20", 20, "lr", "w20"
    ),
    "upside_downside_volatility_ratio_20s": guard(
        "(stddev_samp(CASE WHEN lr IS NOT NULL THEN greatest(lr, 0) END) OVER w20) / "
        "nullif(stddev_samp(CASE WHEN lr IS NOT NULL THEN least(lr, 0) END) OVER w20, 0)",
        20, "lr", "w20",
    ),
    **{f"drawdown_{n}s": f"close / ({rolled('max', 'close', n)}) - 1" for n in (20, 60)},
    "range_zscore_20s": f"(rf - ({rolled('avg', 'rf', 20)})) / nullif({rolled('stddev_samp', 'rf', 20)}, 0)",
    "close_location": "(close - low) / nullif(high - low, 0)",
    "volume_zscore_20s": f"(lv - ({rolled('avg', 'lv', 20)})) / nullif({rolled('stddev_samp', 'lv', 20)}, 0)",
    **{
        f"return_autocorrelation_{n}s": f"CASE WHEN rn > {n} THEN corr(lr, lr1) OVER w{n - 1} END"
        for n in (20, 60)
    },
}
STRUCTURE_SQL = {
    "true_range_fraction": "tr / pc",
    "overnight_gap_fraction": "open / pc - 1",
    "open_to_previous_close": "open / pc - 1",
    "high_to_previous_close": "high / pc - 1",
    "low_to_previous_close": "low / pc - 1",
    **{f"atr_{n}s_fraction": f"({rolled('avg', 'tr', n)}) / close" for n in (5, 14, 30)},
    **{
        f"parkinson_volatility_{n}s": f"sqrt(({rolled("avg", "hl2", n)}) / (4 * ln(2)))"
        for n in (5, 20, 30)
    },
    **{
        f"garman_klass_volatility_{n}s": f"CASE WHEN rn >= {n} THEN sqrt(greatest(avg(0.5 * hl2 - (2 * ln(2) - 1) * co2) OVER w{n}, 0)) END"
        for n in (5, 20, 30)
    },
    **{
        f"{label}_percentile_{n}s": f"CASE WHEN rn >= {n} THEN len(list_filter(list({x}) OVER w{n}, lambda v: v <= {x})) / {n}.0 END"
        for n in (20, 60, 120)
        for label, x in (("range", "rf"), ("volume", "volume"), ("close", "close"))
    },
    **{f"close_return_lag_{k}s": f"lag(sr, {k}) OVER w" for k in (1, 2, 5, 10, 20, 30)},
    **{f"volume_change_{k}s": f"volume / nullif(lag(volume, {k}) OVER w, 0) - 1" for k in (1, 5, 20)},
    **{
        f"sma_gap_{a}_{b}s": f"({rolled('avg', 'close', a)}) / ({rolled('avg', 'close', b)}) - 1"
        for a, b in ((5, 20), (20, 60), (30, 120))
    },
    **{
        f"trend_r_squared_{n}s": f"CASE WHEN rn >= {n} AND max(close) OVER w{n} > min(close) OVER w{n} THEN pow(corr(close, rn) OVER w{n}, 2) END"
        for n in (20, 60, 120)
    },
    **{
        f"trend_residual_zscore_{n}s": f"CASE WHEN rn >= {n} THEN (close - avg(close) OVER w{n} - (covar_pop(close, rn) OVER w{n}) / (({n * n}.0 - 1) / 12) * (({n} - 1) / 2.0)) / nullif(sqrt(greatest(var_pop(close) OVER w{n} - pow(covar_pop(close, rn) OVER w{n}, 2) / (({n * n}.0 - 1) / 12), 0) * {n} / ({n} - 1)), 0) END"
        for n in (20, 60)
    },
}
shared(
    t_feat0="SELECT symbol, trading_date, session_close_utc, lr AS log_return_1s, "
    "rf AS range_fraction, lv AS log_volume, "
    + ", ".join(f"{e} AS {n}" for n, e in {**RETURN_SQL, **STRUCTURE_SQL}.items())
    + f" FROM t_in2 {WINDOWS}",
    t_ema="SELECT b.symbol, b.trading_date, "
    + ", ".join(
        f"CASE WHEN any_value(b.rn) >= {n} THEN sum(a.close * CASE WHEN a.rn = 1 THEN 1 ELSE 2.0 / ({n} + 1) END * pow(1 - 2.0 / ({n} + 1), b.rn - a.rn)) END AS ema_{n}"
        for n in X.EMA_SPANS
    )
    + " FROM t_in1 b JOIN t_in1 a ON a.symbol = b.symbol AND a.rn <= b.rn "
    "GROUP BY b.symbol, b.trading_date",
    t_union="""
SELECT s.symbol, d.trading_date, d.cal, p.close_to_close_return AS ret,
       p.symbol IS NOT NULL AS printed
FROM (SELECT DISTINCT symbol FROM t_panel) s
CROSS JOIN (SELECT trading_date, CAST(row_number() OVER (ORDER BY trading_date) AS INTEGER) AS cal
            FROM (SELECT DISTINCT trading_date FROM t_panel)) d
LEFT JOIN t_panel p ON p.symbol = s.symbol AND p.trading_date = d.trading_date
""",
    t_union5="""
SELECT *, CASE WHEN count(ret) OVER f = 5 THEN product(1 + ret) OVER f - 1 END AS m5
FROM t_union WINDOW f AS (PARTITION BY symbol ORDER BY cal ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
""",
    t_peer0="""
SELECT a.symbol, a.trading_date, a.cal, avg(b.ret) AS pr, avg(b.m5) AS pm,
       avg(CASE WHEN b.ret > 0 THEN 1.0 ELSE 0 END) AS pb
FROM t_union5 a JOIN t_union5 b ON a.cal = b.cal AND a.symbol <> b.symbol
GROUP BY a.symbol, a.trading_date, a.cal
""",
    t_peer="""
SELECT symbol, trading_date, lag(pr) OVER w AS peer_return_lag1s,
       lag(pm) OVER w AS peer_momentum_5s_lag1s, lag(pb) OVER w AS peer_breadth_lag1s
FROM t_peer0 WINDOW w AS (PARTITION BY symbol ORDER BY cal)
""",
    t_leadlag="""
SELECT symbol, trading_date,
       CASE WHEN count(y) OVER w20 >= 20 THEN corr(x, y) OVER w20 END AS leadlag_correlation_20s,
       CASE WHEN count(y) OVER w60 >= 60 THEN corr(x, y) OVER w60 END AS leadlag_correlation_60s,
       CASE WHEN count(y) OVER w60 >= 60 THEN covar_samp(x, y) OVER w60 END
         / CASE WHEN count(p) OVER w60 >= 60 THEN nullif(var_samp(p) OVER w60, 0) END
         AS leadlag_beta_60s
FROM (SELECT i.symbol, i.trading_date, peer_return_lag1s AS p,
             CASE WHEN peer_return_lag1s IS NOT NULL THEN lr END AS x,
             CASE WHEN lr IS NOT NULL THEN peer_return_lag1s END AS y
      FROM t_in1 i JOIN t_peer USING (symbol, trading_date))
"""
    + _named_windows((20, 60)),
    t_feat="""
SELECT f.*, CASE WHEN range_percentile_60s IS NOT NULL THEN ceil(range_percentile_60s * 4) END
         AS range_quartile_60s,
       CASE WHEN volume_percentile_60s IS NOT NULL THEN ceil(volume_percentile_60s * 4) END
         AS volume_quartile_60s,
       trend_slope_20s - lag(trend_slope_20s, 5) OVER w AS trend_slope_acceleration_20s,
       ema_5 / ema_20 - 1 AS ema_gap_5_20s, ema_10 / ema_60 - 1 AS ema_gap_10_60s,
       close / ema_10 - 1 AS price_to_ema_10s, close / ema_30 - 1 AS price_to_ema_30s,
       close / ema_60 - 1 AS price_to_ema_60s, close / ema_120 - 1 AS price_to_ema_120s,
       peer_return_lag1s, peer_momentum_5s_lag1s, peer_breadth_lag1s, leadlag_correlation_20s,
       leadlag_correlation_60s, leadlag_beta_60s
FROM t_feat0 f JOIN t_ema USING (symbol, trading_date) JOIN t_peer USING (symbol, trading_date)
JOIN t_leadlag USING (symbol, trading_date)
JOIN (SELECT symbol, trading_date, close FROM t_panel) USING (symbol, trading_date)
WINDOW w AS (PARTITION BY symbol ORDER BY trading_date)
""",
)
GROUPS = {
    "return_features": ["log_return_1s", "range_fraction", "log_volume"]
    + [n for n in RETURN_SQL if n not in ("price_to_sma_5s", "price_to_sma_30s", "price_to_sma_120s",
                                          "trend_slope_30s", "trend_slope_120s")],
    "structure_features": list(STRUCTURE_SQL)
    + ["price_to_sma_5s", "price_to_sma_30s", "price_to_sma_120s", "trend_slope_30s",
       "trend_slope_120s", "range_quartile_60s", "volume_quartile_60s",
       "trend_slope_acceleration_20s"],
    "ema_features": list(X.EMA_COLUMNS),
    "peer_features": list(X.PEER_COLUMNS),
}
ALL_FEATURES = [n for names in GROUPS.values() for n in names]


def features(spark, folder, families=X.FAMILIES):
    return X.session_features(src.settled_panel(spark, folder), families)


def _group_query(name, columns):
    @query(
        name,
        "SELECT symbol, trading_date, " + ", ".join(r(c, c) for c in columns) + " FROM t_feat",
    )
    def run(spark, folder):
        family = (name.removesuffix("_features"),)
        return tidy(features(spark, folder, family).select("symbol", "trading_date", *columns))


for _name, _columns in GROUPS.items():
    _group_query(_name, _columns)


@query(
    "realized_measures",
    f"""SELECT symbol, trading_date, {r('rv', 'realized_variance', 9)},
        {r('sqrt(rv)', 'realized_volatility', 9)},
        {r('coalesce(dn, 0)', 'downside_semivariance', 9)},
        {r('coalesce(up, 0)', 'upside_semivariance', 9)}, {r('bv', 'bipower_variation', 9)},
        {r('CASE WHEN bv IS NOT NULL THEN greatest(rv - bv, 0) END', 'jump_variation', 9)},
        {r('rq', 'realized_quarticity', 9)}
        FROM (SELECT symbol, trading_date, coalesce(sum(x * x), 0) AS rv,
                     sum(x * x) FILTER (x < 0) AS dn, sum(x * x) FILTER (x >= 0) AS up,
                     pi() / 2 * sum(abs(x) * abs(px)) AS bv,
                     count(x) / 3.0 * sum(pow(x, 4)) AS rq
              FROM (SELECT *, lag(x) OVER (PARTITION BY symbol, trading_date ORDER BY timestamp_utc)
                              AS px
                    FROM (SELECT *, ln(1 + return_1m) AS x FROM t_returns))
              GROUP BY symbol, trading_date)""",
)
def realized_measures(spark, folder):
    return tidy(X.realized_measures(src.minute_returns(spark, folder)), 9)


shared(
    t_tape="""
SELECT symbol, trading_date, sum(volume) / count(*) AS volume_per_observed_minute,
       coalesce(sum(abs(return_1m)), 0) / count(*) AS absolute_return_per_observed_minute,
       avg((return_1m = 0)::INT) AS zero_return_fraction,
       avg((return_1m > 0)::INT) AS positive_return_fraction,
       avg(sign(return_1m)) AS return_sign_imbalance,
       quantile_cont(return_1m, 0.1) AS intraday_return_q10,
       quantile_cont(return_1m, 0.25) AS intraday_return_q25,
       quantile_cont(return_1m, 0.5) AS intraday_return_median,
       quantile_cont(return_1m, 0.75) AS intraday_return_q75,
       quantile_cont(return_1m, 0.9) AS intraday_return_q90
FROM t_returns GROUP BY symbol, trading_date
"""
)
TAPE = ["volume_per_observed_minute", "absolute_return_per_observed_minute",
        "zero_return_fraction", "positive_return_fraction", "return_sign_imbalance",
        "intraday_return_q10", "intraday_return_q25", "intraday_return_median",
        "intraday_return_q75", "intraday_return_q90"]


@query(
    "tape_pace_features",
    "SELECT symbol, trading_date, "
    + ", ".join(r(c, c) for c in TAPE)
    + f""", {r('intraday_return_q75 - intraday_return_q25', 'intraday_return_iqr')},
    {r('abs(intraday_return_q90) - abs(intraday_return_q10)', 'intraday_tail_imbalance')}
    FROM t_tape""",
)
def tape_pace_features(spark, folder):
    return tidy(X.tape_pace(src.minute_returns(spark, folder)))


@query(
    "feature_assembly",
    f"""SELECT symbol, trading_date, {r('log_return_1s', 'log_return_1s')},
        {r('observed', 'observed')}, {r('dispersion', 'dispersion')},
        log_return_1s IS NOT NULL AND momentum_20s IS NOT NULL AND observed IS NOT NULL
          AND dispersion IS NOT NULL AS feature_set_complete
        FROM t_feat0
        LEFT JOIN (SELECT symbol, trading_date, CAST(observations AS DOUBLE) AS observed
                   FROM t_session) USING (symbol, trading_date)
        LEFT JOIN (SELECT symbol, trading_date, realized_volatility_1m AS dispersion
                   FROM t_session) USING (symbol, trading_date)""",
)
def feature_assembly(spark, folder):
    panel = src.session_panel(spark, folder)
    base = X.session_features(panel, ("return",)).select(
        "symbol", "trading_date", "feature_available_at_utc", "log_return_1s", "momentum_20s"
    )
    a = panel.select(
        "symbol", "trading_date", F.col("observations").cast("double").alias("observed")
    )
    b = panel.select(
        "symbol", "trading_date", F.col("realized_volatility_1m").alias("dispersion")
    )
    return tidy(X.assemble(base, a, b).drop("feature_available_at_utc", "momentum_20s"))


@query(
    "smoothing_indicators",
    f"""SELECT symbol, epoch(timestamp_utc)::BIGINT AS ts,
        {r('close / bb_mid - 1', 'bollinger_position')}, {r('bb_sd * 2.6 / close', 'bollinger_width')},
        {r('(typ_avg + 1.5 * rng_avg) / close', 'keltner_upper')},
        {r('(typ_avg - 1.5 * rng_avg) / close', 'keltner_lower')},
        {r('e14 / close', 'ema_14')}, {r('atr20 / close', 'atr_20')}
        FROM (SELECT *, avg(close) OVER w10 AS bb_mid, stddev_pop(close) OVER w10 AS bb_sd,
                     avg((high + low + close) / 3) OVER w30 AS typ_avg,
                     avg(high - low) OVER w30 AS rng_avg
              FROM t_hour_rn
              WINDOW w10 AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW),
                     w30 AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
        JOIN (SELECT b.symbol, b.rn,
                     sum(a.close * CASE WHEN a.rn = 1 THEN 1 ELSE 2 / 15.0 END
                         * pow(13 / 15.0, b.rn - a.rn)) AS e14,
                     sum(a.tr * CASE WHEN a.rn = 1 THEN 1 ELSE 1 / 20.0 END
                         * pow(19 / 20.0, b.rn - a.rn)) AS atr20
              FROM t_hour_rn b JOIN t_hour_rn a ON a.symbol = b.symbol AND a.rn <= b.rn
              GROUP BY b.symbol, b.rn) USING (symbol, rn)""",
)
def smoothing_indicators(spark, folder):
    from tidepanel.functions import frames
    from tidepanel.operators import calendar as cal

    bars = cal.plain_hour_bars(src.minute_bars(spark, folder))
    key, order = "symbol", "timestamp_utc"
    bars = smoothing.ema(bars, "e14", "close", key, order, span=14)
    bars = smoothing.wilder_atr(bars, "atr20", key, order, 20)
    ten, thirty = frames.rows(key, order, 10, 1), frames.rows(key, order, 30, 1)
    c = F.col("close")
    typical = thirty.mean((F.col("high") + F.col("low") + c) / 3.0)
    offset = thirty.mean(F.col("high") - F.col("low")) * 1.5
    return tidy(
        bars.select(
            key, F.unix_timestamp(order).alias("ts"),
            (c / ten.mean(c) - 1.0).alias("bollinger_position"),
            (ten.std0(c) * 2.6 / c).alias("bollinger_width"),
            ((typical + offset) / c).alias("keltner_upper"),
            ((typical - offset) / c).alias("keltner_lower"),
            (F.col("e14") / c).alias("ema_14"), (F.col("atr20") / c).alias("atr_20"),
        )
    )


shared(
    t_hour_rn="""
SELECT *, row_number() OVER w AS rn,
       greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr
FROM t_plain_hour WINDOW w AS (PARTITION BY symbol ORDER BY timestamp_utc)
"""
)




shared(
    t_macd="""
WITH RECURSIVE step AS (
  SELECT symbol, rn, close, close AS fast, close AS slow, 0.0::DOUBLE AS sig, close AS t1,
         close AS t2, close AS t3
  FROM t_hour_rn WHERE rn = 1
  UNION ALL
  SELECT h.symbol, h.rn, h.close, f, s, (1 - 0.2) * sig + 0.2 * (f - s), a1, a2,
         (1 - 2 / 15.0) * t3 + 2 / 15.0 * a2
  FROM (SELECT h.symbol, h.rn, h.close, p.sig, p.t3,
               p.fast + 2 / 25.0 * (h.close - p.fast) AS f,
               p.slow + 2 / 18.0 * (h.close - p.slow) AS s, a1,
               p.t2 + 2 / 15.0 * (a1 - p.t2) AS a2
        FROM (SELECT p.*, p.t1 + 2 / 15.0 * (h.close - p.t1) AS a1
              FROM step p JOIN t_hour_rn h ON h.symbol = p.symbol AND h.rn = p.rn + 1) p
        JOIN t_hour_rn h ON h.symbol = p.symbol AND h.rn = p.rn + 1) h
)
SELECT symbol, rn, close, sig, 3 * t1 - 3 * t2 + t3 AS tema FROM step
"""
)


@query(
    "chained_smoothing",
    f"""SELECT symbol, CAST(rn AS INTEGER) AS bar, {r('sig', 'macd_signal')},
        {r('tema / close', 'tema_14')} FROM t_macd""",
)
def chained_smoothing(spark, folder):
    from tidepanel.functions import frames
    from tidepanel.operators import calendar as cal

    bars = cal.plain_hour_bars(src.minute_bars(spark, folder))
    key, order = "symbol", "timestamp_utc"
    bars = smoothing.macd_signal(bars, "macd_signal", "close", key, order, 24, 17, 9)
    bars = smoothing.tema(bars, "tema_14", "close", key, order, 14)
    return tidy(
        bars.select(
            key, F.row_number().over(frames.ordered(key, order)).alias("bar"), "macd_signal",
            (F.col("tema_14") / F.col("close")).alias("tema_14"),
        )
    )
