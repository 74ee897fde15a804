"""Hourly regression displacement, keyed folds, stop-order rules and streaming bars."""

from pyspark.sql import functions as F

from tidepanel.functions.scalars import tidy
from tidepanel.operators import calendar as cal
from tidepanel.operators import displacement as D
from tidepanel.operators import signals as N
from tidepanel.operators import smoothing
from tidepanel.operators import stateful as U
from tidepanel.registry.base import query, r, shared
from tidepanel.session import cut_lineage
from tidepanel.sources import tables as src


def own(n: int, end: str = "CURRENT ROW") -> str:
    return f"(PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND {end})"


def g(fn: str, x: str, w: str, least: int) -> str:
    return f"CASE WHEN count({x}) OVER {w} >= {least} THEN {fn}({x}) OVER {w} END"


shared(
    t_d1="""
SELECT *, lp - lag(lp) OVER (PARTITION BY symbol ORDER BY rn) AS lr
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY hour_start_utc) AS rn, ln(close) AS lp,
             (high - low) / close AS hr FROM t_hour)
""",
    t_d2="SELECT *, "
    + ", ".join(
        f"""CASE WHEN c{n} >= {n} THEN a{n} + b{n} * ({n} - 1) / 2.0 END AS fit{n}, CASE WHEN c{n} >= {n} THEN b{n} END AS slope{n},
        CASE WHEN c{n} >= {n} THEN least(b{n} * b{n} * {n * (n * n - 1) / 12.0} / nullif(v{n} * {n}, 0), 1) END AS rsq{n},
        CASE WHEN c{n} >= {n} THEN sqrt(greatest(v{n} * {n} - b{n} * b{n} * {n * (n * n - 1) / 12.0}, 0) / {n - 2})
          * sqrt(1 + 1.0 / {n} + pow(({n} - 1) / 2.0, 2) / {n * (n * n - 1) / 12.0}) END AS perr{n}"""
        for n in (24, 120)
    )
    + " FROM (SELECT *, "
    + ", ".join(
        f"count(lp) OVER w{n} AS c{n}, avg(lp) OVER w{n} AS a{n}, var_pop(lp) OVER w{n} AS v{n}, covar_pop(lp, rn) OVER w{n} / {(n * n - 1) / 12.0} AS b{n}"
        for n in (24, 120)
    )
    + f" FROM t_d1 WINDOW w24 AS {own(24)}, w120 AS {own(120)})",
    t_d3="SELECT *, lp - fit24 AS d, lp - fit120 AS d120 FROM t_d2",
    t_d4="SELECT *, lag(d) OVER (PARTITION BY symbol ORDER BY rn) AS d1 FROM t_d3",
    t_d5=f"""
SELECT *, d / nullif({g('stddev_samp', 'd', 'w120', 48)}, 0) AS z, d / nullif(perr24, 0) AS pos,
  slope24 - lag(slope24, 4) OVER w AS dslope, {g('stddev_samp', 'd', 'w24', 24)} AS rv,
  ({g('stddev_samp', 'd', 'w24', 24)}) / nullif({g('stddev_samp', 'lr', 'w24', 24)}, 0) AS rel,
  CASE WHEN count(CASE WHEN d IS NOT NULL THEN d1 END) OVER w120 >= 48 THEN corr(d, d1) OVER w120 END AS ac,
  d120 / nullif({g('stddev_samp', 'd120', 'w240', 120)}, 0) AS z120,
  ({g('stddev_samp', 'lr', 'w24', 24)}) * sqrt(23.0 * 252) AS vol24,
  ({g('stddev_samp', 'lr', 'w24', 24)}) / nullif({g('stddev_samp', 'lr', 'w120', 48)}, 0) AS vr,
  hr / nullif(CASE WHEN count(hr) OVER w120 >= 48 THEN quantile_cont(hr, 0.5) OVER w120 END, 0) AS rx,
  (volume - ({g('avg', 'volume', 'w120', 48)})) / nullif({g('stddev_samp', 'volume', 'w120', 48)}, 0) AS vz,
  abs(lp - lag(lp, 24) OVER w) / nullif(CASE WHEN count(lr) OVER w24 >= 24 THEN sum(abs(lr)) OVER w24 END, 0) AS te
FROM t_d4 WINDOW w AS (PARTITION BY symbol ORDER BY rn), w24 AS {own(24)}, w120 AS {own(120)}, w240 AS {own(240)}
""",
    t_d6="""
SELECT *, z - lag(z) OVER w AS speed,
  CASE WHEN ac BETWEEN 0 AND 0.999999 THEN CASE WHEN ac = 0 THEN 1 ELSE greatest(least(-ln(2) / ln(ac), 240), 1) END END AS half,
  CASE WHEN coalesce(abs(z) >= 2, false) THEN row_number() OVER (PARTITION BY symbol, resets ORDER BY rn) - (resets > 0)::INT ELSE 0 END AS outside
FROM (SELECT *, sum((NOT coalesce(abs(z) >= 2, false))::INT) OVER (PARTITION BY symbol ORDER BY rn ROWS UNBOUNDED PRECEDING) AS resets FROM t_d5)
WINDOW w AS (PARTITION BY symbol ORDER BY rn)
""",
    t_dcal="SELECT hour_start_utc, row_number() OVER (ORDER BY hour_start_utc) AS cal FROM (SELECT DISTINCT hour_start_utc FROM t_d1)",
    t_dpeer="""
SELECT *, CASE WHEN lr IS NOT NULL THEN (sum(lr) OVER c - lr) / nullif(count(lr) OVER c - 1, 0) END AS peer
FROM t_d6 JOIN t_dcal USING (hour_start_utc) WINDOW c AS (PARTITION BY cal)
""",
    t_dres="""
SELECT *, x - b * peer AS fr, CASE WHEN n >= 48 THEN rho END AS xcorr
FROM (SELECT *, CASE WHEN count(x) OVER w >= 48 THEN covar_samp(x, peer) OVER w END
               / nullif(CASE WHEN count(peer) OVER w >= 48 THEN var_samp(peer) OVER w END, 0) AS b,
             corr(x, peer) OVER w AS rho, count(x) OVER w AS n
      FROM (SELECT *, CASE WHEN peer IS NOT NULL THEN lr END AS x FROM t_dpeer)
      WINDOW w AS (PARTITION BY symbol ORDER BY cal RANGE BETWEEN 119 PRECEDING AND CURRENT ROW))
""",
    t_dall="""
SELECT *, speed - lag(speed) OVER (PARTITION BY symbol ORDER BY rn) AS accel,
  CASE WHEN count(fr) OVER w24 >= 24 THEN sum(fr) OVER w24 END
    / nullif(CASE WHEN count(fr) OVER w120 >= 48 THEN stddev_samp(fr) OVER w120 END * sqrt(24.0), 0) AS fz
FROM t_dres WINDOW w24 AS (PARTITION BY symbol ORDER BY cal RANGE BETWEEN 23 PRECEDING AND CURRENT ROW),
  w120 AS (PARTITION BY symbol ORDER BY cal RANGE BETWEEN 119 PRECEDING AND CURRENT ROW)
""",
)
NAMES = dict(
    zip(
        (*D.OWN_COLUMNS, *D.PEER_COLUMNS),
        ("d", "z", "pos", "slope24", "dslope", "rsq24", "rv", "rel", "ac", "half", "outside", "speed",
         "accel", "z120", "slope120", "rsq120", "vol24", "vr", "rx", "vz", "te", "peer", "fz", "xcorr"),
    )
)


def hours(spark, folder):
    return cut_lineage(cal.hour_bars(src.minute_bars(spark, folder)))


@query(
    "regression_displacement_features",
    "SELECT symbol, epoch(hour_start_utc)::BIGINT AS ts, " + ", ".join(r(e, n) for n, e in NAMES.items()) + " FROM t_dall",
)
def regression_displacement_features(spark, folder):
    out = D.regression_features(hours(spark, folder))
    return tidy(out.select("symbol", F.unix_timestamp("hour_start_utc").alias("ts"), *NAMES))


HORIZONS = D.TARGET_HORIZONS
shared(
    t_targets="SELECT symbol, trading_date, hour_start_utc, z, "
    + ", ".join(
        f"""f{h} - lp AS future_log_return_{h}h, label{h} AS label_{h}h, f{h} - (fit24 + slope24 * {h}) - d AS future_displacement_change_{h}h,
        CASE WHEN f{h} IS NOT NULL THEN coalesce(abs(f{h} - (fit24 + slope24 * {h})) <= 0.5 * abs(d), false)::INT::DOUBLE END AS partial_reversion_at_{h}h,
        CASE WHEN f{h} IS NOT NULL THEN coalesce((f{h} - (fit24 + slope24 * {h})) * d <= 0, false)::INT::DOUBLE END AS complete_reversion_at_{h}h,
        CASE WHEN f{h} IS NOT NULL AND abs(d) >= 1e-12 THEN coalesce(near{h} < coalesce(far{h}, 1000), false)::INT::DOUBLE END AS target_before_stop_{h}h,
        CASE WHEN f{h} IS NOT NULL AND abs(d) >= 1e-12 THEN near{h}::DOUBLE END AS time_to_half_reversion_{h}h"""
        for h in HORIZONS
    )
    + " FROM (SELECT *, "
    + ", ".join(f"lead(lp, {h}) OVER w AS f{h}, lead(available, {h}) OVER w AS label{h}" for h in HORIZONS)
    + " FROM t_d6 WINDOW w AS (PARTITION BY symbol ORDER BY rn)) "
    + " ".join(
        f"""LEFT JOIN (SELECT a.symbol, a.rn, min(b.rn - a.rn) FILTER (abs(b.lp - a.fit24 - a.slope24 * (b.rn - a.rn)) <= 0.5 * abs(a.d)) AS near{h},
             min(b.rn - a.rn) FILTER (abs(b.lp - a.fit24 - a.slope24 * (b.rn - a.rn)) >= 1.5 * abs(a.d)) AS far{h}
           FROM t_d6 a JOIN t_d6 b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn + 1 AND a.rn + {h} GROUP BY a.symbol, a.rn) p{h}
           USING (symbol, rn)"""
        for h in HORIZONS
    ),
)
TARGETS = [
    f"{n}_{h}h" for h in HORIZONS
    for n in ("future_log_return", "future_displacement_change", "partial_reversion_at",
              "complete_reversion_at", "target_before_stop", "time_to_half_reversion")
]


def targets(spark, folder, base=None):
    base = D.own_features(hours(spark, folder)) if base is None else base
    return D.regression_targets(base, HORIZONS)


@query(
    "regression_targets",
    "SELECT symbol, epoch(hour_start_utc)::BIGINT AS ts, " + ", ".join(r(c, c) for c in TARGETS) + ", "
    + ", ".join(f"epoch(label_{h}h)::BIGINT AS label_{h}h" for h in HORIZONS) + " FROM t_targets",
)
def regression_targets(spark, folder):
    out = targets(spark, folder)
    return tidy(
        out.select(
            "symbol", F.unix_timestamp("hour_start_utc").alias("ts"), *TARGETS,
            *[F.unix_timestamp(f"label_available_at_{h}h_utc").alias(f"label_{h}h") for h in HORIZONS],
        )
    )


@query(
    "conditional_reversion",
    " UNION ALL ".join(
        f"""SELECT symbol, CASE WHEN abs(z) <= 1 THEN 'under_1' WHEN abs(z) <= 2 THEN '1_to_2' WHEN abs(z) <= 3 THEN '2_to_3' ELSE 'over_3' END AS displacement_band,
        {h} AS horizon_hours, CAST(count(target_before_stop_{h}h) AS BIGINT) AS observations,
        {r(f'avg(target_before_stop_{h}h)', 'target_before_stop_rate')}, {r(f'avg(partial_reversion_at_{h}h)', 'partial_reversion_rate')},
        {r(f'avg(complete_reversion_at_{h}h)', 'complete_reversion_rate')},
        {r(f'quantile_cont(time_to_half_reversion_{h}h, 0.5)', 'median_time_to_half_reversion')}
        FROM t_targets WHERE z IS NOT NULL GROUP BY ALL"""
        for h in HORIZONS
    ),
)
def conditional_reversion(spark, folder):
    base = cut_lineage(D.own_features(hours(spark, folder)))
    z = base.select("symbol", "hour_start_utc", "regression_residual_zscore_24h")
    df = targets(spark, folder, base).join(z, ["symbol", "hour_start_utc"])
    return tidy(D.conditional_reversion(df, ["symbol"], HORIZONS))


def intraday(spark, folder):
    state = cal.running_session_state(src.minute_returns(spark, folder))
    return N.intraday_scores(state, least=2)


shared(
    t_hys="""
WITH RECURSIVE base AS (
  SELECT symbol, trading_date, timestamp_utc, session_minute, score_balanced AS x,
         row_number() OVER (PARTITION BY symbol, trading_date ORDER BY timestamp_utc) AS rn FROM t_intraday
), walk AS (
  SELECT symbol, trading_date, 0::BIGINT AS rn, NULL::TIMESTAMP AS timestamp_utc, 0.0::DOUBLE AS state, 0::BIGINT AS age FROM (SELECT DISTINCT symbol, trading_date FROM base)
  UNION ALL
  SELECT symbol, trading_date, rn, timestamp_utc,
         CASE WHEN s0 = 0 THEN CASE WHEN abs(x) >= 0.3 THEN sign(x)::DOUBLE ELSE 0 END
              WHEN abs(x) <= 0.1 OR sign(x) <> s0 OR a0 + 1 >= 8 THEN 0 ELSE s0 END,
         CASE WHEN s0 = 0 THEN 0 WHEN abs(x) <= 0.1 OR sign(x) <> s0 OR a0 + 1 >= 8 THEN 0 ELSE a0 + 1 END
  FROM (SELECT b.*, CASE WHEN b.session_minute >= 1375 THEN 0 ELSE w.state END AS s0, CASE WHEN b.session_minute >= 1375 THEN 0 ELSE w.age END AS a0
        FROM walk w JOIN base b ON b.symbol = w.symbol AND b.trading_date = w.trading_date AND b.rn = w.rn + 1)
)
SELECT * FROM walk WHERE rn > 0
"""
)


@query(
    "hysteresis_states",
    "SELECT symbol, epoch(timestamp_utc)::BIGINT AS ts, state + 0.0 AS position_signal FROM t_hys",
)
def hysteresis_states(spark, folder):
    out = U.hysteresis(intraday(spark, folder), "score_balanced", 0.3, 0.1, 8)
    return tidy(out.select("symbol", F.unix_timestamp("timestamp_utc").alias("ts"), "position_signal"))


shared(
    t_sar="""
WITH RECURSIVE walk AS (
  SELECT symbol, rn, timestamp_utc, false AS up, high AS sar, high AS eh, low AS el, 0.02::DOUBLE AS acc, high AS ph, low AS pl FROM t_hour_rn WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, timestamp_utc, CASE WHEN hit THEN NOT up ELSE up END,
    CASE WHEN up AND hit THEN greatest(eh1 + 0.02 * (low - eh1), high, ph)
         WHEN up THEN least(sar + acc1 * (eh1 - sar), low, pl)
         WHEN hit THEN least(el1 + 0.02 * (high - el1), low, pl)
         ELSE greatest(sar + acc1 * (el1 - sar), high, ph) END,
    CASE WHEN hit THEN high ELSE eh1 END, CASE WHEN hit THEN low ELSE el1 END,
    CASE WHEN hit THEN 0.02 ELSE acc1 END, high, low
  FROM (SELECT h.symbol, h.rn, h.timestamp_utc, h.high, h.low, w.up, w.sar, w.ph, w.pl,
               greatest(w.eh, h.high) AS eh1, least(w.el, h.low) AS el1,
               CASE WHEN w.up THEN h.low <= w.sar ELSE h.high >= w.sar END AS hit,
               CASE WHEN (w.up AND greatest(w.eh, h.high) > w.eh) OR (NOT w.up AND least(w.el, h.low) < w.el) THEN least(w.acc + 0.02, 0.2) ELSE w.acc END AS acc1
        FROM walk w JOIN t_hour_rn h ON h.symbol = w.symbol AND h.rn = w.rn + 1)
)
SELECT symbol, rn, timestamp_utc, sar FROM walk
"""
)


@query("parabolic_sar", f"SELECT symbol, epoch(timestamp_utc)::BIGINT AS ts, {r('sar', 'sar', 7)} FROM t_sar")
def parabolic_sar(spark, folder):
    bars = cut_lineage(cal.plain_hour_bars(src.minute_bars(spark, folder)))
    out = U.parabolic_sar(bars, "sar", "symbol", "timestamp_utc", 0.02, 0.2)
    return tidy(out.select("symbol", F.unix_timestamp("timestamp_utc").alias("ts"), "sar"), 7)


def _stop_hour_sql(n: int, k: float, up: bool) -> str:
    sign = "+" if up else "-"
    return f"avg((high + low + close) / 3) OVER k{n} {sign} avg(high - low) OVER k{n} * {k}"


shared(
    t_orders_base=f"""
SELECT *, lag(ku) OVER w AS ku1, lag(ku, 2) OVER w AS ku2, lag(kl) OVER w AS kl1, lag(kl, 2) OVER w AS kl2,
       lag(high - low) OVER w AS r1, lag(atr20) OVER w AS atr1
FROM (SELECT *, {_stop_hour_sql(20, 2.0, True)} AS ku, {_stop_hour_sql(20, 2.0, False)} AS kl
      FROM t_hour_rn JOIN (SELECT b.symbol AS symbol, b.rn AS rn,
             sum(a.tr * CASE WHEN a.rn = 1 THEN 1 ELSE 1 / 20.0 END * pow(19 / 20.0, b.rn - a.rn)) AS atr20,
             sum(a.tr * CASE WHEN a.rn = 1 THEN 1 ELSE 1 / 25.0 END * pow(24 / 25.0, b.rn - a.rn)) AS atr25
           FROM t_hour_rn b JOIN t_hour_rn a ON a.symbol = b.symbol AND a.rn <= b.rn GROUP BY b.symbol, b.rn) USING (symbol, rn)
      WINDOW k20 AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
WINDOW w AS (PARTITION BY symbol ORDER BY rn)
"""
)


def _tick(x: str) -> str:
    return f"round_even(({x}) / 0.0005, 0) * 0.0005"


@query(
    "stop_order_candidates",
    f"""SELECT symbol, rule, epoch(timestamp_utc)::BIGINT + 3600 AS decision_ts, side, {r('stop', 'stop_price')},
        {r('pt', 'profit_target_distance')}, {r(_tick("stop + CASE side WHEN 'BUY' THEN 1 ELSE -1 END * pt"), 'profit_target_price')},
        {r(_tick("stop - CASE side WHEN 'BUY' THEN 1 ELSE -1 END * sl"), 'stop_loss_price')},
        epoch(timestamp_utc)::BIGINT + 3600 * (1 + bars_valid) AS valid_until_ts
        FROM (SELECT *, {_tick("CASE side WHEN 'BUY' THEN buy ELSE sell END")} AS stop FROM (
          SELECT symbol, timestamp_utc, 'prior_day_range' AS rule, 198 AS bars_valid, b.h + 1.4 * r1 AS buy, b.l - 1.4 * r1 AS sell,
                 CASE WHEN kl1 < kl2 THEN 'BUY' WHEN ku1 > ku2 THEN 'SELL' END AS side, atr25 * 2.4 AS pt, atr25 * 3.9 AS sl
          FROM t_orders_base LEFT JOIN (SELECT symbol AS s, day, h, l FROM t_daily) b ON b.s = symbol AND b.day = CAST(timestamp_utc AS DATE) - 2
          UNION ALL
          SELECT symbol, timestamp_utc, 'day_open_atr', 113, b.o + 2.1 * atr1, b.o - 2.1 * atr1,
                 CASE WHEN ku1 > ku2 THEN 'BUY' WHEN kl1 < kl2 THEN 'SELL' END, atr25 * 5.5, atr25 * 1.1
          FROM t_orders_base LEFT JOIN (SELECT symbol AS s, day, o FROM t_daily) b ON b.s = symbol AND b.day = CAST(timestamp_utc AS DATE)))
        WHERE side IS NOT NULL AND stop IS NOT NULL""",
)
def stop_order_candidates(spark, folder):
    from tidepanel.operators import orders as O

    bars = cut_lineage(cal.plain_hour_bars(src.minute_bars(spark, folder)))
    a = O.prior_day_range_rule(bars, O.OrderRule("prior_day_range", 198, 2.4, 25, 3.9, 25, 0.0005), 2.0)
    b = O.day_open_atr_rule(bars, O.OrderRule("day_open_atr", 113, 5.5, 25, 1.1, 25, 0.0005), 2.0)
    out = a.unionByName(b)
    return tidy(
        out.select(
            "symbol", "rule", F.unix_timestamp("decision_time").alias("decision_ts"), "side", "stop_price",
            "profit_target_distance", "profit_target_price", "stop_loss_price",
            F.unix_timestamp("valid_until_utc").alias("valid_until_ts"),
        )
    )


@query("stop_order_rules_all")
def stop_order_rules_all(spark, folder):
    """All seven rules on every symbol; the SQL check covers two of them value by value."""
    from tidepanel.operators import orders as O

    bars = cut_lineage(cal.plain_hour_bars(src.minute_bars(spark, folder)))
    return tidy(
        O.all_rules(bars).groupBy("symbol", "rule", "side").agg(
            F.count(F.lit(1)).alias("orders"), F.avg("stop_price").alias("mean_stop_price")
        )
    )


@query(
    "live_alert_states",
    "SELECT symbol, epoch(timestamp_utc)::BIGINT AS ts, state + 0.0 AS position_signal FROM t_hys",
)
def live_alert_states(spark, folder):
    """The alerts as a stream whose files come in another order than their rows' times."""
    from tidepanel.streaming import bars as live

    rows = intraday(spark, folder).select("symbol", "trading_date", "timestamp_utc", "session_minute", "score_balanced")
    stream, lateness = live.replay(spark, rows, "timestamp_utc", F.xxhash64("timestamp_utc", "symbol"), 4, "scores")
    with live.timer_store(spark):
        out = live.run_available(live.live_alerts(stream, "timestamp_utc", "score_balanced", 0.3, 0.1, 8, lateness), "live-alerts")
    return tidy(out.where("symbol is not null").select("symbol", F.floor(F.col("at_ms") / 1000).alias("ts"), "position_signal"))


@query("live_sar_levels", f"SELECT symbol, epoch(timestamp_utc)::BIGINT AS ts, {r('sar', 'sar', 7)} FROM t_sar")
def live_sar_levels(spark, folder):
    """The stop-and-reverse level as a stream whose files come in another order than their bars' times."""
    from tidepanel.streaming import bars as live

    rows = cal.plain_hour_bars(src.minute_bars(spark, folder)).select("symbol", "timestamp_utc", "high", "low")
    stream, lateness = live.replay(spark, rows, "timestamp_utc", F.xxhash64("timestamp_utc", "symbol"), 4, "bars")
    with live.timer_store(spark):
        out = live.run_available(live.live_sar(stream, "timestamp_utc", 0.02, 0.2, lateness), "live-sar")
    return tidy(out.where("symbol is not null").select("symbol", F.floor(F.col("at_ms") / 1000).alias("ts"), "sar"), 7)
