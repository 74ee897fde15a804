"""Bar scores, forecasts and rule registries."""

from pyspark.sql import functions as F

from tidepanel.functions.scalars import tidy
from tidepanel.operators import calendar as cal
from tidepanel.operators import features as X
from tidepanel.operators import signals as N
from tidepanel.registry.base import query, r, shared
from tidepanel.registry.time_queries import MINIMUM_BARS
from tidepanel.session import cut_lineage
from tidepanel.sources import tables as src

# Paired symbols.
PEERS = {"click": "view", "view": "click", "purchase": "signup", "signup": "purchase", "error": "click"}

shared(
    t_bc="SELECT b.*, cal FROM t_bars60 b JOIN t_hcal USING (timestamp_utc)",
)


def numbered(spark, folder, minutes=60):
    return cal.number_calendar(src.settled_bars(spark, folder, minutes), "timestamp_utc")


def rng(n: int, end: str = "CURRENT ROW", key: str = "symbol") -> str:
    return f"(PARTITION BY {key} ORDER BY cal RANGE BETWEEN {n} PRECEDING AND {end})"


def zc(x: str, bound: str | None = "5", w: str = "zw") -> str:
    z = f"({x} - avg({x}) OVER {w}) / nullif(stddev_samp({x}) OVER {w}, 0)"
    if bound:
        z = f"greatest(least({z}, {bound}), -{bound})"
    return f"CASE WHEN count({x}) OVER {w} >= 40 AND {x} IS NOT NULL THEN {z} END"


def prank(x: str, key: str = "cal") -> str:
    return f"""CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {key} ORDER BY {x} NULLS LAST)
        + (count(*) OVER (PARTITION BY {key}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {key}) END"""


shared(
    t_theme="SELECT *, "
    + ", ".join(
        f"-({zc(f'm{n}')}) AS mean_reversion_{n}, -(({prank(f'm{n}')}) - 0.5) * 2 AS relative_value_{n}, {zc(f'l{n}')} AS lead_lag_{n}"
        for n in (2, 4, 8)
    )
    + " FROM (SELECT *, "
    + ", ".join(
        f"close / max(close) OVER (PARTITION BY symbol ORDER BY cal RANGE BETWEEN {n} PRECEDING AND {n} PRECEDING) - 1 AS m{n}, "
        f"sum(behind) OVER {rng(n - 1)} AS l{n}"
        for n in (2, 4, 8)
    )
    + f""" FROM (SELECT *, avg("return") OVER (PARTITION BY cal) - "return" AS behind FROM t_bc))
    WINDOW zw AS {rng(160, '1 PRECEDING')}""",
)
THEMES = [f"{t}_{n}" for n in (2, 4, 8) for t in ("mean_reversion", "relative_value", "lead_lag")]


@query(
    "bar_theme_scores",
    "SELECT symbol, epoch(timestamp_utc)::BIGINT AS ts, " + ", ".join(r(t, t) for t in THEMES) + " FROM t_theme",
)
def bar_theme_scores(spark, folder):
    out = N.bar_themes(numbered(spark, folder))
    return tidy(out.select("symbol", F.unix_timestamp("timestamp_utc").alias("ts"), *THEMES))


shared(
    t_product1=f"""
SELECT *, ln(1 + volume) AS lv, CASE WHEN count("return") OVER w4 >= 4 THEN sum("return") OVER w4 END AS mom,
       (sum("return") OVER c - coalesce("return", 0)) / nullif(count("return") OVER c - ("return" IS NOT NULL)::INT, 0) AS peer,
       CASE WHEN count(high) OVER w4 >= 4 THEN (close - min(low) OVER w4) / nullif(max(high) OVER w4 - min(low) OVER w4, 0) - 0.5 END AS loc,
       CASE WHEN count("return") OVER v16 >= 4 THEN stddev_samp("return") OVER v16 END AS sd16,
       row_number() OVER (PARTITION BY symbol ORDER BY cal) AS rn
FROM t_bc WINDOW w4 AS {rng(3)}, v16 AS {rng(16, '1 PRECEDING')}, c AS (PARTITION BY cal)
""",
    t_product_ema="""
SELECT b.symbol, b.rn,
       CASE WHEN b.rn >= 4 THEN sum(a.close * CASE WHEN a.rn = 1 THEN 1 ELSE 0.4 END * pow(0.6, b.rn - a.rn)) END AS fast,
       CASE WHEN b.rn >= 16 THEN sum(a.close * CASE WHEN a.rn = 1 THEN 1 ELSE 2 / 17.0 END * pow(15 / 17.0, b.rn - a.rn)) END AS slow
FROM t_product1 b JOIN t_product1 a ON a.symbol = b.symbol AND a.rn <= b.rn GROUP BY b.symbol, b.rn
""",
    t_product2=f"""
SELECT *, CASE WHEN count(res) OVER w4 >= 4 THEN sum(res) OVER w4 END AS res4,
       CASE WHEN count(peer) OVER w4 >= 1 THEN sum(peer) OVER w4 END AS peer4,
       mom / nullif(sd16, 0) AS scaled, fast / slow - 1 AS tr
FROM (SELECT *, "return" - peer AS res FROM t_product1 JOIN t_product_ema USING (symbol, rn))
WINDOW w4 AS {rng(3)}
""",
    t_product=f"""
SELECT symbol, timestamp_utc, {zc('mom')} AS momentum, -({zc('mom')}) AS mean_reversion,
       (({prank('mom')}) - 0.5) * 2 AS cross_sectional_momentum,
       -(({prank('mom')}) - 0.5) * 2 AS cross_sectional_reversal,
       -({zc('res4')}) AS residual_reversion, {zc('scaled')} AS volatility_scaled_momentum,
       {zc('loc')} AS breakout, {zc('tr')} AS trend, {zc('peer4')} AS lead_lag,
       ({zc('mom')}) * CASE WHEN ({zc('lv')}) IS NOT NULL THEN greatest(least({zc('lv')}, 2), -2) END AS volume_confirmation
FROM t_product2 WINDOW zw AS {rng(160, '1 PRECEDING')}
""",
)


@query(
    "product_scores",
    "SELECT symbol, epoch(timestamp_utc)::BIGINT AS ts, " + ", ".join(r(t, t) for t in N.PRODUCT_FAMILIES) + " FROM t_product",
)
def product_scores(spark, folder):
    out = N.product_scores(numbered(spark, folder), 4)
    return tidy(out.select("symbol", F.unix_timestamp("timestamp_utc").alias("ts"), *N.PRODUCT_FAMILIES))


shared(
    t_aware1=f"""
SELECT *, CASE WHEN "return" IS NOT NULL THEN sum("return") OVER run END AS cum,
       first_value(close / open - 1) OVER run AS ob, row_number() OVER o = 1 AS is_first,
       close / (sum((high + low + close) / 3 * volume) OVER run / sum(volume) OVER run) - 1 AS dev,
       CASE WHEN count(high) OVER p4 >= 4 THEN max(high) OVER p4 END AS top,
       CASE WHEN count(low) OVER p4 >= 4 THEN min(low) OVER p4 END AS bottom, (high - low) / close AS span,
       CASE WHEN count("return") OVER v40 >= 20 THEN stddev_samp("return") OVER v40 END AS risk,
       CASE WHEN count("return") OVER w4 >= 4 THEN sum("return") OVER w4 END AS mom
FROM t_bc WINDOW o AS (PARTITION BY symbol, trading_date ORDER BY timestamp_utc),
  run AS (PARTITION BY symbol, trading_date ORDER BY timestamp_utc ROWS UNBOUNDED PRECEDING),
  p4 AS (PARTITION BY symbol, trading_date ORDER BY timestamp_utc ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING),
  v40 AS {rng(40, '1 PRECEDING')}, w4 AS {rng(3)}
""",
    t_aware2=f"""
SELECT a.*, b.cum AS pcum, s.scale,
       CASE WHEN count(a.risk) OVER z >= 40 THEN quantile_cont(a.risk, 0.5) OVER z END AS calm,
       CASE WHEN count(a.span) OVER w16 >= 16 THEN avg(a.span) OVER w16 END AS atr
FROM t_aware1 a
JOIN (VALUES {', '.join(f"('{k}', '{v}')" for k, v in PEERS.items())}) m(symbol, peer) USING (symbol)
LEFT JOIN t_aware1 b ON b.symbol = m.peer AND b.cal = a.cal
JOIN (SELECT symbol, trading_date, CASE WHEN count(ob) OVER f >= 20 THEN stddev_samp(ob) OVER f END AS scale
      FROM t_aware1 WHERE is_first WINDOW f AS (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)) s
  ON s.symbol = a.symbol AND s.trading_date = a.trading_date
WINDOW z AS (PARTITION BY a.symbol ORDER BY a.cal RANGE BETWEEN 160 PRECEDING AND 1 PRECEDING),
       w16 AS (PARTITION BY a.symbol ORDER BY a.cal RANGE BETWEEN 16 PRECEDING AND 1 PRECEDING)
""",
    t_aware3="""
SELECT *, cum AS intraday_close_momentum, ob / nullif(scale, 0) AS opening_range_continuation,
       -ob / nullif(scale, 0) AS opening_range_reversal, -dev AS session_vwap_reversion,
       (close - (top + bottom) / 2) / nullif((top - bottom) / 2, 0) AS range_breakout,
       -"return" * span / nullif(atr, 0) AS range_expansion_reversal,
       -(cum - pcum) AS paired_spread_reversion,
       mom * CASE WHEN risk <= calm THEN 1 ELSE -1 END AS regime_switch
FROM t_aware2
""",
)


@query(
    "session_aware_scores",
    "SELECT symbol, epoch(timestamp_utc)::BIGINT AS ts, "
    + ", ".join(r(zc(t, None), t) for t in N.SESSION_AWARE)
    + f" FROM t_aware3 WINDOW zw AS {rng(160, '1 PRECEDING')}",
)
def session_aware_scores(spark, folder):
    out = N.session_aware_scores(numbered(spark, folder), 4, PEERS)
    return tidy(out.select("symbol", F.unix_timestamp("timestamp_utc").alias("ts"), *N.SESSION_AWARE))


shared(
    t_eligible=f"""
SELECT *, "return" IS NOT NULL AS e_all,
       "return" IS NOT NULL AND coalesce(risk <= calm, false) AS e_below,
       "return" IS NOT NULL AND coalesce(risk > calm, false) AS e_above,
       hour(timezone('America/New_York', timezone('UTC', timestamp_utc))) BETWEEN 8 AND 15 AS core,
       count(*) OVER (PARTITION BY symbol, trading_date)
         - row_number() OVER (PARTITION BY symbol, trading_date ORDER BY timestamp_utc) = 2 AS preclose
FROM (SELECT *, CASE WHEN count(risk) OVER z >= 40 THEN quantile_cont(risk, 0.5) OVER z END AS calm
      FROM (SELECT *, CASE WHEN count("return") OVER v >= 20 THEN stddev_samp("return") OVER v END AS risk
            FROM t_theme WINDOW v AS {rng(40, '1 PRECEDING')})
      WINDOW z AS {rng(160, '1 PRECEDING')})
"""
)


@query(
    "entry_eligibility",
    """SELECT symbol, epoch(timestamp_utc)::BIGINT AS ts, e_all AS eligible_all, e_below AS eligible_below_median,
       e_above AS eligible_above_median, core AS in_us_core, NOT core AS in_overnight, preclose AS is_preclose FROM t_eligible""",
)
def entry_eligibility(spark, folder):
    out = N.entry_eligibility(numbered(spark, folder))
    return out.select(
        "symbol", F.unix_timestamp("timestamp_utc").alias("ts"), "eligible_all",
        "eligible_below_median", "eligible_above_median", "in_us_core", "in_overnight", "is_preclose",
    )


@query(
    "edge_triggered_signals",
    """SELECT symbol, epoch(timestamp_utc)::BIGINT AS ts, enter_long, enter_short,
         coalesce(lag(calm) OVER w, false) OR coalesce(lag(enter_long OR enter_short, 4) OVER w, false) AS "exit"
       FROM (SELECT *, coalesce(lag(le) OVER w, false) AND coalesce(lag(trading_date) OVER w = trading_date, false) AS enter_long,
                    coalesce(lag(se) OVER w, false) AND coalesce(lag(trading_date) OVER w = trading_date, false) AS enter_short
             FROM (SELECT *, ln AND NOT coalesce(lag(ln) OVER w, false) AS le, sn AND NOT coalesce(lag(sn) OVER w, false) AS se
                   FROM (SELECT symbol, timestamp_utc, trading_date, coalesce(mean_reversion_4 >= 0.75, false) AND e_all AS ln,
                                coalesce(mean_reversion_4 <= -0.75, false) AND e_all AS sn,
                                coalesce(abs(mean_reversion_4) <= 0.1, false) AS calm FROM t_eligible)
                   WINDOW w AS (PARTITION BY symbol ORDER BY timestamp_utc))
             WINDOW w AS (PARTITION BY symbol ORDER BY timestamp_utc))
       WINDOW w AS (PARTITION BY symbol ORDER BY timestamp_utc)""",
)
def edge_triggered_signals(spark, folder):
    df = N.bar_themes(numbered(spark, folder), (4,))
    out = N.edge_signals(df, "mean_reversion_4", F.col("return").isNotNull(), 0.75, 0.1, 4)
    return out.select(
        "symbol", F.unix_timestamp("timestamp_utc").alias("ts"), "enter_long", "enter_short", "exit"
    )


@query(
    "intraday_rule_grid",
    """SELECT symbol, theme, lookback, variant, CAST(count(*) FILTER (ok AND score >= entry) AS BIGINT) AS long_bars,
         CAST(count(*) FILTER (ok AND score <= -entry) AS BIGINT) AS short_bars
       FROM (SELECT *, CASE vol WHEN 'below_median' THEN e_below WHEN 'above_median' THEN e_above ELSE e_all END
                    AND CASE clock WHEN 'us_core' THEN core WHEN 'overnight' THEN NOT core ELSE true END AS ok
             FROM ("""
    + " UNION ALL ".join(
        f"SELECT symbol, e_all, e_below, e_above, core, '{t}' AS theme, {n} AS lookback, {t}_{n} AS score FROM t_eligible"
        for n in (2, 4, 8) for t in ("mean_reversion", "relative_value", "lead_lag")
    )
    + ") CROSS JOIN (VALUES "
    + ", ".join(f"({i}, {v[0]}, '{v[3]}', '{v[4]}')" for i, v in enumerate(N.INTRADAY_VARIANTS, 1))
    + ") v(variant, entry, vol, clock)) GROUP BY ALL",
)
def intraday_rule_grid(spark, folder):
    return N.intraday_grid_activity(numbered(spark, folder))


shared(
    t_rule_days="""
WITH long AS (
  SELECT *, CASE WHEN allowed AND coalesce(score >= entry, false) THEN 1 WHEN allowed AND coalesce(score <= -entry, false) THEN -1 ELSE 0 END AS now,
         coalesce(lag(abs(score) <= leave) OVER w, false) AS calm_before
  FROM (SELECT *, CASE vol WHEN 'below_median' THEN e_below WHEN 'above_median' THEN e_above ELSE e_all END
               AND CASE clock WHEN 'us_core' THEN core WHEN 'overnight' THEN NOT core ELSE true END AS allowed
        FROM ("""
    + " UNION ALL ".join(
        f"SELECT symbol, trading_date, timestamp_utc, \"return\" AS x, e_all, e_below, e_above, core, '{t}' AS theme, {n} AS lookback, {t}_{n} AS score FROM t_eligible"
        for n in (2, 4, 8) for t in ("mean_reversion", "relative_value", "lead_lag")
    )
    + ") CROSS JOIN (VALUES "
    + ", ".join(
        f"({i}, {v[0]}, {v[1]}, {v[2]}, '{v[3]}', '{v[4]}', {'NULL::DOUBLE' if v[5] is None else v[5]})"
        for i, v in enumerate(N.INTRADAY_VARIANTS, 1)
    )
    + """) v(variant, entry, leave, hold, vol, clock, stop))
  WINDOW w AS (PARTITION BY symbol, trading_date, theme, lookback, variant ORDER BY timestamp_utc)
), edges AS (
  SELECT *, CASE WHEN now <> coalesce(lag(now) OVER w, 0) THEN now ELSE 0 END AS edge FROM long
  WINDOW w AS (PARTITION BY symbol, trading_date, theme, lookback, variant ORDER BY timestamp_utc)
), entered AS (
  SELECT *, nullif(lag(edge) OVER w, 0) AS side, row_number() OVER w AS rn FROM edges
  WINDOW w AS (PARTITION BY symbol, trading_date, theme, lookback, variant ORDER BY timestamp_utc)
), stretches AS (
  SELECT *, max(CASE WHEN side IS NOT NULL THEN rn END) OVER w AS opened FROM entered
  WINDOW w AS (PARTITION BY symbol, trading_date, theme, lookback, variant ORDER BY timestamp_utc ROWS UNBOUNDED PRECEDING)
), directed AS (
  SELECT *, rn - opened AS age, max(side) OVER (PARTITION BY symbol, trading_date, theme, lookback, variant, opened) AS direction
  FROM stretches WHERE opened IS NOT NULL
), paths AS (
  SELECT *, sum(direction * coalesce(x, 0)) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS made,
         bool_or(calm_before AND age > 0) OVER (v ROWS UNBOUNDED PRECEDING) AS gone FROM directed
  WINDOW v AS (PARTITION BY symbol, trading_date, theme, lookback, variant, opened ORDER BY timestamp_utc)
), placed AS (
  SELECT e.symbol, e.trading_date, e.theme, e.lookback, e.variant, e.timestamp_utc, e.x, coalesce(p.position, 0.0) AS position
  FROM entered e LEFT JOIN (
    SELECT *, CASE WHEN age < hold AND NOT gone AND NOT coalesce(min(made) OVER v <= -stop, false) THEN direction::DOUBLE ELSE 0.0 END AS position FROM paths
    WINDOW v AS (PARTITION BY symbol, trading_date, theme, lookback, variant, opened ORDER BY timestamp_utc ROWS UNBOUNDED PRECEDING)) p
  USING (symbol, trading_date, theme, lookback, variant, timestamp_utc)
), weighed AS (
  SELECT *, coalesce(position / nullif(sum(abs(position)) OVER (PARTITION BY theme, lookback, variant, timestamp_utc), 0), 0) AS weight FROM placed
)
SELECT theme, lookback, variant, trading_date, sum(weight * coalesce(x, 0)) AS gross, sum(moved) AS sides
FROM (SELECT *, abs(weight - coalesce(lag(weight) OVER w, 0)) + CASE WHEN lead(weight) OVER w IS NULL THEN abs(weight) ELSE 0 END AS moved FROM weighed
      WINDOW w AS (PARTITION BY symbol, trading_date, theme, lookback, variant ORDER BY timestamp_utc))
GROUP BY ALL
"""
)


@query(
    "intraday_rule_returns",
    f"""SELECT theme, lookback, variant, trading_date, {r('gross', 'gross')}, {r('sides', 'sides')},
        {r('gross - sides * 1.75 / 10000', 'net_1_75')}, {r('gross - sides * 3.5 / 10000', 'net_3_5')}, {r('gross - sides * 7.0 / 10000', 'net_7')}
        FROM t_rule_days""",
)
def intraday_rule_returns(spark, folder):
    df = N.intraday_rule_returns(numbered(spark, folder))
    costs = {"net_1_75": 1.75, "net_3_5": 3.5, "net_7": 7.0}
    return tidy(df.withColumns({n: F.col("gross") - F.col("sides") * c / 10_000.0 for n, c in costs.items()}))


@query("intraday_rule_search")
def intraday_rule_search(spark, folder):
    """All 576 rules over four bar lengths, totals before cost; hour bars have their own SQL check."""
    out = None
    for minutes in (15, 30, 60, 240):
        part = N.intraday_rule_returns(numbered(spark, folder, minutes)).withColumn("timeframe", F.lit(minutes))
        out = part if out is None else out.unionByName(part)
    return tidy(
        out.groupBy("timeframe", "theme", "lookback", "variant").agg(
            F.count(F.lit(1)).alias("sessions"), F.sum("gross").alias("gross"), F.sum("sides").alias("sides"),
            F.count_if(F.col("sides") > 0).alias("active_sessions"),
        )
    )


@query("sampled_rule_population")
def sampled_rule_population(spark, folder):
    """Seeded balanced draw of rules per symbol: Spark's hash order has no SQL form."""
    symbols = src.table(spark, folder, "events").select(F.col("event_type").alias("symbol")).distinct()
    grid = N.parameter_grid(
        symbols,
        {
            "family": N.PRODUCT_FAMILIES, "timeframe": (15, 30, 60, 240), "lookback": (2, 4, 8, 16),
            "entry_threshold": (0.5, 0.75, 1.0, 1.25), "volatility_filter": ("all", "below_median", "above_median"),
            "time_rule": ("all", "us_core", "overnight"),
        },
    )
    return N.sampled_population(grid, ["symbol"], 80, "family")


def _tanh_part(c: str) -> str:
    m = f"CASE WHEN count({c}) OVER f >= 20 THEN quantile_cont(abs({c}), 0.5) OVER f END"
    return f"CASE WHEN {c} IS NOT NULL AND ({m}) IS NOT NULL THEN tanh(greatest(least({c} / nullif({m}, 0), 5), -5)) END"


@query(
    "trend_forecast",
    "SELECT symbol, trading_date, "
    + r("(" + " + ".join(_tanh_part(c) for c in N.TREND_FEATURES) + ") / 8", "score")
    + " FROM t_feat WINDOW f AS (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)",
)
def trend_forecast(spark, folder):
    feats = X.session_features(src.settled_panel(spark, folder), ("return", "ema"))
    return tidy(N.trend_forecast(feats))


@query(
    "breakout_forecast",
    f"""SELECT symbol, trading_date, {r('''CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(least(a * b, 1), -1) END''', 'score')}
        FROM (SELECT symbol, trading_date, tanh(((close_percentile_20s + close_percentile_60s + close_percentile_120s) / 3 - 0.5) * 3) AS a,
                     0.5 + 0.25 * range_percentile_60s + 0.25 * volume_percentile_60s AS b FROM t_feat0)""",
)
def breakout_forecast(spark, folder):
    feats = X.session_features(src.settled_panel(spark, folder), ("structure",))
    return tidy(feats.select("symbol", "trading_date", N.breakout_forecast().alias("score")))


TAPE_INPUTS = ("intraday_tail_imbalance", "return_sign_imbalance", "volume_per_observed_minute")


def full_features(spark, folder, panel=None, names=None):
    """Session features with the tape columns that the rules and regimes read; ``names`` keeps those alone.

    A caller that reads the settled panel as well hands it over, so the prints are scanned once for both;
    the tape needs a scan of its own, which is made only where one of its columns is asked for.
    """
    panel = src.settled_panel(spark, folder) if panel is None else panel
    out = X.session_features(panel)
    if names is None or set(names) & set(TAPE_INPUTS):
        tape = X.tape_pace(src.session_returns(spark, folder)).select("symbol", "trading_date", *TAPE_INPUTS)
        out = out.join(tape, ["symbol", "trading_date"], "left")
    return out if names is None else out.select("symbol", "trading_date", *names)


shared(
    t_session_returns="""
SELECT *, close / lag(close) OVER (PARTITION BY symbol, trading_date ORDER BY minute) - 1 AS return_1m
FROM (SELECT symbol, trading_date, (k1 * 8 + k2) % 1440 AS minute, last(price ORDER BY k1, k2, price) AS close, sum(volume) AS volume
      FROM t_quotes GROUP BY 1, 2, 3)
""",
    t_feat_all="""
SELECT * FROM t_feat LEFT JOIN (
  SELECT symbol, trading_date, abs(quantile_cont(return_1m, 0.9)) - abs(quantile_cont(return_1m, 0.1)) AS intraday_tail_imbalance,
         avg(sign(return_1m)) AS return_sign_imbalance, sum(volume) / count(*) AS volume_per_observed_minute
  FROM t_session_returns GROUP BY symbol, trading_date) USING (symbol, trading_date)
""",
)


def _reversion_sql_input(n: str) -> str:
    if n == "upside_downside_volatility_ratio_20s":
        return f"CASE WHEN {n} IS NOT NULL THEN ln(greatest({n}, 1e-8)) END"
    return f"{n} - 0.5" if n in ("close_location", "range_percentile_20s", "range_percentile_60s") else n


def _scaled_sql(names, expr) -> str:
    return f"""SELECT symbol, trading_date, feature, x, x / nullif(CASE WHEN count(x) OVER w >= 60 THEN quantile_cont(abs(x), 0.5) OVER w END, 0) AS scaled,
       {prank('x', 'feature, trading_date')} - 0.5 AS ranked
       FROM ({" UNION ALL ".join(f"SELECT symbol, trading_date, '{n}' AS feature, CAST({expr(n)} AS DOUBLE) AS x FROM t_feat_all" for n in names)})
       WHERE x IS NOT NULL
       WINDOW w AS (PARTITION BY symbol, feature ORDER BY trading_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    return f"'{v}'" if isinstance(v, str) else (f"{v}::DOUBLE" if isinstance(v, float) else str(v))


REV = N.reversion_registry()
THEME = N.theme_registry()
shared(
    t_rev_scaled=_scaled_sql(sorted({x[2] for x in REV}), _reversion_sql_input),
    t_rev="SELECT strategy, family, symbol, trading_date, CASE WHEN threshold > 0 AND NOT coalesce(abs(v) >= threshold, false) THEN 0 "
    "WHEN v IS NOT NULL THEN -tanh(greatest(least(v, 5), -5)) END AS score FROM (SELECT *, CASE WHEN is_ranked THEN ranked ELSE scaled END AS v "
    "FROM t_rev_scaled JOIN (VALUES " + ", ".join("(" + ", ".join(_lit(v) for v in x) + ")" for x in REV)
    + ") g(strategy, family, feature, threshold, is_ranked) USING (feature))",
    t_theme_scaled=_scaled_sql(
        sorted({x[2] for x in THEME} | {x[6] for x in THEME if x[6]}),
        lambda n: f"{n} - 0.5" if "percentile" in n or n == "close_location" else n,
    ),
    t_theme_rules="SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_lit(v) for v in x) + ")" for x in THEME)
    + ") g(strategy, theme, feature, direction, hold, is_ranked, other, mode)",
    t_theme_bounded="""
SELECT strategy, theme, symbol, trading_date, hold, n AS cal,
       CASE WHEN raw IS NOT NULL THEN tanh(greatest(least(raw, 5), -5)) * direction END AS bounded
FROM (SELECT *, CASE mode WHEN 'activity' THEN v * (0.5 + 0.5 * act) WHEN 'signed' THEN v * sg ELSE v END AS raw
      FROM (SELECT a.*, g.*, c.n, CASE WHEN g.is_ranked THEN a.ranked ELSE a.scaled END AS v,
              CASE WHEN g.other LIKE '%percentile%' THEN CASE WHEN b.x IS NOT NULL THEN least(greatest(b.x + 0.5, 0), 1) END
                   WHEN b.scaled IS NOT NULL THEN least(abs(b.scaled), 2) / 2 END AS act,
              CASE WHEN b.x IS NOT NULL THEN greatest(least(b.x, 2), -2) END AS sg
            FROM t_theme_scaled a JOIN t_theme_rules g USING (feature) JOIN t_cal c USING (trading_date)
            LEFT JOIN t_theme_scaled b ON b.symbol = a.symbol AND b.trading_date = a.trading_date AND b.feature = g.other))
""",
    t_themes=" UNION ALL ".join(
        f"""SELECT strategy, theme, symbol, trading_date, avg(bounded) OVER (PARTITION BY strategy, symbol ORDER BY cal
            RANGE BETWEEN {h - 1} PRECEDING AND CURRENT ROW) AS score FROM t_theme_bounded WHERE hold = {h}"""
        for h in (1, 2, 3, 5)
    ),
)


def _score_profile(df, *keys):
    return tidy(
        df.groupBy(*keys, "symbol").agg(
            F.count("score").alias("scores"), F.avg("score").alias("mean_score"),
            F.stddev_samp("score").alias("deviation"), F.min("score").alias("lowest"),
            F.max("score").alias("highest"),
            F.corr("score", F.datediff("trading_date", F.lit("1995-01-01").cast("date"))).alias("drift"),
        )
    )


PROFILE_SQL = (
    "CAST(count(score) AS BIGINT) AS scores, " + r("avg(score)", "mean_score") + ", "
    + r("stddev_samp(score)", "deviation") + ", " + r("min(score)", "lowest") + ", "
    + r("max(score)", "highest") + ", "
    + r("corr(score, date_diff('day', DATE '1995-01-01', trading_date))", "drift")
)


@query(
    "reversion_rule_scores",
    f"SELECT strategy, family, symbol, {PROFILE_SQL} FROM t_rev GROUP BY strategy, family, symbol",
)
def reversion_rule_scores(spark, folder):
    return _score_profile(N.reversion_scores(cut_lineage(full_features(spark, folder, names=N.reversion_inputs()))), "strategy", "family")


@query(
    "theme_rule_scores",
    f"SELECT strategy, theme, symbol, {PROFILE_SQL} FROM t_themes GROUP BY strategy, theme, symbol",
)
def theme_rule_scores(spark, folder):
    return _score_profile(N.theme_scores(cut_lineage(full_features(spark, folder, names=N.theme_inputs()))), "strategy", "theme")


def _phi(x: str) -> str:
    """Alternating Taylor series of the normal CDF, enough below six deviations."""
    terms = []
    fact = 1.0
    for k in range(70):
        if k:
            fact *= 2.0 * k
        terms.append(f"{(-1) ** k} * pow({x}, {2 * k + 1}) / {fact * (2 * k + 1)!r}")
    series = "0.5 + 0.3989422804014327 * (" + " + ".join(terms) + ")"
    return f"CASE WHEN abs({x}) >= 6 THEN CASE WHEN {x} > 0 THEN 1.0 ELSE 0.0 END ELSE {series} END"


shared(
    t_state="""
SELECT *, (close - (hi + lo) / 2) / nullif(hi - lo, 0) AS midpoint_displacement, close / vwap - 1 AS vwap_deviation,
       close / session_open - 1 AS open_deviation, nullif(hi - lo, 0) / session_open AS running_range_fraction
FROM (SELECT *, sum((high + low + close) / 3 * volume) OVER run / sum(volume) OVER run AS vwap,
             max(high) OVER run AS hi, min(low) OVER run AS lo, CAST(sum(volume) OVER run AS BIGINT) AS cumulative_volume,
             first_value(open) OVER run AS session_open, close / lag(close, 5) OVER w - 1 AS return_5m
      FROM (SELECT *, (hour(local_time) * 60 + minute(local_time) + 360) % 1440 AS session_minute FROM t_returns)
      WINDOW w AS (PARTITION BY symbol, trading_date ORDER BY timestamp_utc),
             run AS (PARTITION BY symbol, trading_date ORDER BY timestamp_utc ROWS UNBOUNDED PRECEDING))
""",
    t_state_z="SELECT *, "
    + ", ".join(
        f"CASE WHEN count({c}) OVER q >= 2 AND {c} IS NOT NULL THEN ({c} - avg({c}) OVER q) / nullif(stddev_samp({c}) OVER q, 0) END AS {c}_z"
        for c in N.SAME_TIME
    )
    + " FROM t_state WINDOW q AS (PARTITION BY symbol, session_minute ORDER BY trading_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    t_intraday="SELECT *, ready, "
    + ", ".join(
        f"""CASE WHEN ready THEN greatest(least(({w[0]} * mp + {w[1]} * vs + {w[2]} * os + {w[3]} * rs) * act
            * CASE WHEN sign(coalesce(return_1m, 0)) = sign({w[0]} * mp + {w[1]} * vs + {w[2]} * os + {w[3]} * rs) THEN 1.15 ELSE 0.85 END, 1), -1) ELSE 0 END AS score_{n}"""
        for n, w in N.INTRADAY_WEIGHTS.items()
    )
    + f""" FROM (SELECT *, (0.5 + 0.5 * rp) * (0.75 + 0.25 * vp) AS act,
        greatest(least(-2 * midpoint_displacement, 1), -1) AS mp, -tanh(greatest(least(vwap_deviation_z, 5), -5) / 2) AS vs,
        -tanh(greatest(least(open_deviation_z, 5), -5) / 2) AS os, -tanh(greatest(least(return_5m_z, 5), -5) / 2) AS rs,
        vwap_deviation_z IS NOT NULL AND open_deviation_z IS NOT NULL AND return_5m_z IS NOT NULL AND rp IS NOT NULL AND vp IS NOT NULL AS ready
      FROM (SELECT *, {_phi('running_range_fraction_z')} AS rp, {_phi('cumulative_volume_z')} AS vp FROM t_state_z))""",
)
INTRADAY = [f"score_{n}" for n in N.INTRADAY_WEIGHTS]


@query(
    "intraday_combined_score",
    "SELECT symbol, epoch(timestamp_utc)::BIGINT AS ts, ready, " + ", ".join(r(c, c, 5) for c in INTRADAY) + " FROM t_intraday",
)
def intraday_combined_score(spark, folder):
    state = cal.running_session_state(src.minute_returns(spark, folder))
    out = N.intraday_scores(state, least=2)
    return tidy(out.select("symbol", F.unix_timestamp("timestamp_utc").alias("ts"), "ready", *INTRADAY), 5)


def learn_sql(history, momentum):
    return f"""
SELECT symbol, trading_date, overnight_return, eu_open_return, pre_open_return, open_30_return, overnight_volatility,
       ov / nullif(CASE WHEN count(ov) OVER p >= {history} THEN avg(ov) OVER p END, 0) AS observed_volume_surprise,
       lag(target_return) OVER w AS prior_target_return,
       CASE WHEN count(target_return) OVER p3 >= {momentum} THEN sum(target_return) OVER p3 END AS prior_session_momentum_5,
       CASE WHEN count(target_return) OVER p >= {history} THEN stddev_samp(target_return) OVER p END AS prior_target_volatility_20,
       {prank('overnight_return', 'trading_date')} AS overnight_cross_rank,
       {prank('open_30_return', 'trading_date')} AS open_30_cross_rank,
       avg(overnight_return) OVER (PARTITION BY trading_date) AS cross_market_overnight,
       sin(2 * pi() * (isodow(trading_date) - 1) / 5) AS weekday_sin, cos(2 * pi() * (isodow(trading_date) - 1) / 5) AS weekday_cos,
       target_return
FROM (SELECT *, coalesce(overnight_volume, 0) + coalesce(pre_open_volume, 0) + coalesce(open_30_volume, 0) AS ov FROM t_learn0)
WINDOW w AS (PARTITION BY symbol ORDER BY trading_date),
       p AS (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN {history} PRECEDING AND 1 PRECEDING),
       p3 AS (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN {momentum} PRECEDING AND 1 PRECEDING)
"""


shared(
    t_learn0="SELECT symbol, trading_date, "
    + ", ".join(
        f"CASE WHEN {n}_n >= {m} THEN {n}_p - 1 END AS {n}_return, CASE WHEN {n}_n >= {m} THEN {n}_s END AS {n}_volatility, "
        f"CASE WHEN {n}_n >= {m} THEN {n}_v END AS {n}_volume"
        for n, m in MINIMUM_BARS.items()
    )
    + " FROM t_clock_windows",
    t_learn=learn_sql(20, 5),
)


def learning(spark, folder, **windows_of):
    """The learning frame, by default with the reference's 20 and 5 sessions of history."""
    masks = {n: (m, MINIMUM_BARS[n]) for n, m in N.clock_masks("timestamp_utc").items()}
    windows = cal.window_summary(src.clock_bars(spark, folder, 15), masks)
    return N.learning_frame(windows, **windows_of)


@query(
    "learning_frame",
    "SELECT symbol, trading_date, " + ", ".join(r(c, c) for c in (*N.LEARNING_FEATURES, "target_return"))
    + " FROM t_learn WHERE target_return IS NOT NULL",
)
def learning_frame(spark, folder):
    return tidy(learning(spark, folder))


@query(
    "learning_frame_whole_history",
    "SELECT symbol, trading_date, " + ", ".join(r(c, c) for c in (*N.LEARNING_FEATURES, "target_return"))
    + " FROM t_learn WHERE target_return IS NOT NULL",
)
def learning_frame_whole_history(spark, folder):
    return tidy(learning(spark, folder))
