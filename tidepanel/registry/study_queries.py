"""Composed jobs and the joins that feed them."""

from pyspark.sql import functions as F

from tidepanel.functions.scalars import tidy
from tidepanel.operators import calendar as cal
from tidepanel.operators import displacement as D
from tidepanel.operators import evaluate as E
from tidepanel.operators import labels as L
from tidepanel.operators import models as M
from tidepanel.operators import network as G
from tidepanel.operators import quality as Q
from tidepanel.operators import signals as N
from tidepanel.plans import studies as P
from tidepanel.registry.allocation_queries import week_returns
from tidepanel.registry.base import query, r, shared
from tidepanel.registry.displacement_queries import hours
from tidepanel.registry.evaluate_queries import dd, metric_sql
from tidepanel.registry.hypothesis_queries import LEADERS, TOTAL, dense
from tidepanel.registry.signal_queries import PEERS, full_features, numbered
from tidepanel.session import cut_lineage
from tidepanel.sources import tables as src

# Bar lengths of the studies, in minutes.
TIMEFRAMES = (15, 30, 60, 240)


def variant_totals(df, *variant):
    return tidy(
        df.groupBy(*variant).agg(
            F.sum("gross").alias("gross_sum"), F.sum("sides").alias("sides_sum"),
            F.count_if(F.col("sides") > 0).alias("active_rows"),
        )
    )


def per_timeframe(spark, folder, study, *variant):
    """Totals of a bar study at every bar length."""
    out = None
    for minutes in TIMEFRAMES:
        part = study(src.settled_bars(spark, folder, minutes)).withColumn("timeframe", F.lit(minutes))
        out = part if out is None else out.unionByName(part)
    return variant_totals(out, "timeframe", *variant)


@query("component_residual_grid")
def component_residual_grid(spark, folder):
    """First-component rules, 48 variants; the tests refit one session by hand."""
    return per_timeframe(spark, folder, P.component_grid, "train", "threshold", "confirmation", "symbol")


@query("ridge_var_grid")
def ridge_var_grid(spark, folder):
    """Ridge VAR rules, 32 variants; the tests refit one session by hand."""
    return per_timeframe(spark, folder, P.var_grid, "train", "penalty", "threshold", "symbol")


@query("network_rule_grid")
def network_rule_grid(spark, folder):
    panel = cut_lineage(week_returns(spark, folder).withColumn("ret", F.col("sret")))
    return variant_totals(P.network_grid(panel), "window", "momentum", "threshold", "hold")


def pass_one(spark, folder):
    bars = {m: src.settled_bars(spark, folder, m) for m in TIMEFRAMES}
    return P.hypothesis_pass_one(bars, LEADERS, least=10)


def pass_two(spark, folder):
    bars = {m: src.settled_bars(spark, folder, m) for m in TIMEFRAMES}
    return P.hypothesis_pass_two(bars, cut_lineage(dense(spark, folder)))


def pass_three(spark, folder):
    return P.hypothesis_pass_three(
        src.settled_bars(spark, folder, 15), cut_lineage(dense(spark, folder)), least=10
    )


@query("hypothesis_pass_one")
def hypothesis_pass_one(spark, folder):
    """Families H002-H006 on bars of every length, each checked on its own as well."""
    return variant_totals(pass_one(spark, folder), "hypothesis_id", "timeframe", "symbol")


@query("hypothesis_pass_two")
def hypothesis_pass_two(spark, folder):
    return variant_totals(pass_two(spark, folder), "hypothesis_id", "timeframe", "symbol")


@query("hypothesis_pass_three")
def hypothesis_pass_three(spark, folder):
    return variant_totals(pass_three(spark, folder), "hypothesis_id", "timeframe", "symbol")


@query("study_tail")
def study_tail(spark, folder):
    """Chained selection over the network grid replayed at every cost level."""
    panel = cut_lineage(week_returns(spark, folder).withColumn("ret", F.col("sret")))
    grid = P.network_grid(panel)
    return tidy(P.study_tail(grid, ["window", "momentum", "threshold", "hold"]))


@query("theme_search")
def theme_search(spark, folder):
    panel = src.settled_panel(spark, folder)
    feats = cut_lineage(full_features(spark, folder, panel, N.theme_inputs()))
    out = P.theme_search(feats, panel)
    return tidy(out)


@query("theme_book_search")
def theme_book_search(spark, folder):
    """Fold evidence of the theme books; the tests form them by hand."""
    panel = src.settled_panel(spark, folder)
    feats = cut_lineage(full_features(spark, folder, panel, N.theme_inputs()))
    return tidy(P.book_summary(P.theme_books(P.theme_daily(feats, panel))))


@query("theme_rule_correlation")
def theme_rule_correlation(spark, folder):
    """Every pair of theme rules on the validation rows."""
    panel = src.settled_panel(spark, folder)
    feats = cut_lineage(full_features(spark, folder, panel, N.theme_inputs()))
    return tidy(P.validation_correlation(P.theme_daily(feats, panel), "strategy"))


@query("candidate_books")
def candidate_books(spark, folder):
    """Trend, breakout and reversion families, gated and balanced, with fold evidence of the books."""
    panel = src.settled_panel(spark, folder)
    feats = cut_lineage(full_features(spark, folder, panel))
    regimes = cut_lineage(P.regime_table(feats, panel))
    sleeves = P.candidate_sleeves(feats, panel, regimes)
    return tidy(P.book_summary(P.sleeve_books(sleeves)))


@query("reversion_tournament")
def reversion_tournament(spark, folder):
    panel = src.settled_panel(spark, folder)
    feats = cut_lineage(full_features(spark, folder, panel, N.reversion_inputs()))
    return tidy(P.reversion_tournament(feats, panel))


@query("candidate_portfolio")
def candidate_portfolio(spark, folder):
    panel = src.settled_panel(spark, folder)
    feats = cut_lineage(full_features(spark, folder, panel))
    sleeves = P.forecast_sleeves(feats, panel)
    return tidy(P.candidate_portfolio(sleeves))


@query("trend_baseline_with_regimes")
def trend_baseline_with_regimes(spark, folder):
    panel = src.settled_panel(spark, folder)
    feats = cut_lineage(full_features(spark, folder, panel))
    regimes = cut_lineage(P.regime_table(feats, panel))
    out = P.trend_baseline(feats, panel, regimes)
    return tidy(E.summarize(out, ["strategy"], "net"))


def _median_mean(cols, absolute=False):
    parts = [f"abs(m_{c})" if absolute else f"m_{c}" for c in cols]
    return (
        "(" + " + ".join(f"coalesce({p}, 0)" for p in parts) + ") / nullif("
        + " + ".join(f"({p} IS NOT NULL)::INT" for p in parts) + ", 0)"
    )


REGIME_NAMES = [c for group in G.REGIME_INPUTS.values() for c in group]


def _scale_sql(c: str) -> str:
    return f"""CASE WHEN count({c}) OVER w >= 120 AND {c} IS NOT NULL THEN
        (greatest(least({c}, quantile_cont({c}, 0.99) OVER w), quantile_cont({c}, 0.01) OVER w) - quantile_cont({c}, 0.5) OVER w)
        / nullif(CASE WHEN quantile_cont({c}, 0.75) OVER w <> quantile_cont({c}, 0.25) OVER w THEN quantile_cont({c}, 0.75) OVER w - quantile_cont({c}, 0.25) OVER w
                 ELSE stddev_samp({c}) OVER w END, 0) END"""


shared(
    t_reg0="SELECT symbol, trading_date, " + ", ".join(f"{_scale_sql(c)} AS {c}" for c in REGIME_NAMES)
    + " FROM t_feat_all WINDOW w AS (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
    t_reg1="SELECT trading_date, " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in REGIME_NAMES) + " FROM t_reg0 GROUP BY trading_date",
    t_conc="""
SELECT trading_date, CASE WHEN count(c) OVER w >= 120 THEN (c - min(c) OVER w) / nullif(max(c) OVER w - min(c) OVER w, 0) END AS cc
FROM (SELECT trading_date, avg(abs(rho)) AS c FROM (
        SELECT a.trading_date, CASE WHEN count(a.x + b.x) OVER w >= 20 THEN corr(a.x, b.x) OVER w END AS rho
        FROM (SELECT symbol, trading_date, cal, ret AS x FROM t_union) a
        JOIN (SELECT symbol, trading_date, cal, ret AS x FROM t_union) b ON a.cal = b.cal AND a.symbol < b.symbol
        WINDOW w AS (PARTITION BY a.symbol, b.symbol ORDER BY a.cal ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) GROUP BY trading_date)
WINDOW w AS (ORDER BY trading_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""",
    t_reg2=f"""
SELECT trading_date, cc, tr - 0.75 * vo - 0.25 * ac AS s0, tr + 0.5 * vo + 0.5 * ac AS s1, -me - 0.5 * tr - 0.25 * ex AS s2,
       vo + ac + ex + coalesce(cc, 0) - 0.5 * li AS s3
FROM (SELECT trading_date, cc, {_median_mean(G.REGIME_INPUTS['trend'], True)} AS tr, {_median_mean(G.REGIME_INPUTS['volatility'])} AS vo,
        {_median_mean(G.REGIME_INPUTS['acceleration'])} AS ac, {_median_mean(G.REGIME_INPUTS['expansion'])} AS ex,
        {_median_mean(G.REGIME_INPUTS['reversion'])} AS me, {_median_mean(G.REGIME_INPUTS['liquidity'])} AS li FROM t_reg1 LEFT JOIN t_conc USING (trading_date))
""",
    t_reg3=f"""
SELECT trading_date, cc, {", ".join(f"exp(s{i}) / (exp(s0) + exp(s1) + exp(s2) + exp(s3)) AS p{i}" for i in range(4))} FROM t_reg2
""",
)


@query(
    "regime_table",
    "SELECT trading_date, " + ", ".join(r(f"p{i}", n) for i, n in enumerate(G.REGIMES)) + ", "
    + r("1 + (" + " + ".join(f"p{i} * ln(greatest(p{i}, 1e-12))" for i in range(4)) + ") / ln(4)", "ensemble_confidence")
    + ", " + r("CASE WHEN p0 IS NOT NULL THEN 1 + least(greatest(1 + (" + " + ".join(f"p{i} * ln(greatest(p{i}, 1e-12))" for i in range(4))
                + ") / ln(4), 0), 1) * (greatest(least(0.65 + 0.7 * (p0 + p1) - 0.35 * p3, 1.15), 0.35) - 1) ELSE 1 END", "multiplier")
    + " FROM t_reg3",
)
def regime_table(spark, folder):
    panel = src.settled_panel(spark, folder)
    feats = cut_lineage(full_features(spark, folder, panel))
    out = P.regime_table(feats, panel)
    return tidy(
        out.select("trading_date", *[F.col(f"ensemble_{n}").alias(n) for n in G.REGIMES],
                   "ensemble_confidence", G.exposure_multiplier().alias("multiplier"))
    )


@query("saved_rule_replay")
def saved_rule_replay(spark, folder):
    saved = ["momentum_05", "trend_02", "lead_lag_01"]
    panel = src.settled_panel(spark, folder)
    names = N.theme_inputs([rule for rule in N.theme_registry() if rule[0] in saved])
    feats = cut_lineage(full_features(spark, folder, panel, names))
    out = P.saved_rule_replay(feats, panel, saved)
    return tidy(E.performance_snapshot(out.withColumn("portfolio", F.lit("saved")), ["portfolio"], "net"))


shared(
    t_iw1="""
SELECT s.*, h.state, CASE WHEN count(s.return_1m) OVER w >= 120 THEN h.state / nullif(stddev_samp(s.return_1m) OVER w, 0) END AS rs
FROM t_intraday s JOIN t_hys h USING (symbol, trading_date, timestamp_utc)
WINDOW w AS (PARTITION BY symbol ORDER BY timestamp_utc ROWS BETWEEN 239 PRECEDING AND CURRENT ROW)
"""
)


@query("intraday_sleeve")
def intraday_sleeve(spark, folder):
    """Minute alerts to balanced weights to daily accounting; each step has its own SQL check."""
    return tidy(P.intraday_sleeve(src.minute_returns(spark, folder), 2, 0.3, 0.1, 8), 9)


@query("displacement_study")
def displacement_study(spark, folder):
    """Hourly features, label-aware ridge per block and horizon, information coefficients of the forecasts.

    The prior-day regime shares stay out: the given hour bars and sessions share no dates.
    """
    names = [c for c in D.FEATURES if c not in D.REGIME_COLUMNS]
    base = cut_lineage(D.regression_features(hours(spark, folder)))
    labels = D.regression_targets(base, D.MODEL_HORIZONS).drop("trading_date")
    df = cut_lineage(E.date_blocks(base.join(labels, ["symbol", "hour_start_utc"]), 3))
    symbols = sorted(row.symbol for row in df.select("symbol").distinct().collect())
    edge = df.groupBy(F.col("block").alias("fold")).agg(F.min("trading_date").alias("cutoff"))
    out = None
    for h in D.MODEL_HORIZONS:
        scaled = df.withColumn("target", M.scaled_label(f"future_log_return_{h}h", "realized_volatility_24h", h))
        train = scaled.filter("target IS NOT NULL").withColumn("fold", F.explode(F.sequence(F.lit(2), F.lit(3))))
        train = train.join(edge, "fold").filter(
            (F.col("block") < F.col("fold"))
            & (F.to_date(f"label_available_at_{h}h_utc") < F.col("cutoff"))
        )
        apply = scaled.filter("block > 1").withColumn("fold", F.col("block"))
        forecast, _ = M.pooled_ridge(train.drop("cutoff"), apply, names, symbols)
        part = E.information_coefficients(forecast, ["fold", "symbol"], "forecast", f"future_log_return_{h}h")
        part = part.withColumn("horizon_hours", F.lit(h))
        out = part if out is None else out.unionByName(part)
    return tidy(out)


@query("prepared_rule_scores")
def prepared_rule_scores(spark, folder):
    """Every family and lookback with the bars each entry filter allows."""
    long = P.rule_scores_prepared(numbered(spark, folder), (2, 4, 8, 16), PEERS)
    allowed = F.col("eligible_all") & F.col("score").isNotNull()
    return tidy(
        long.groupBy("family", "lookback", "symbol").agg(
            F.count("score").alias("scores"), F.avg("score").alias("mean_score"),
            F.count_if(allowed & (F.abs("score") >= 1)).alias("entry_bars"),
            F.count_if(allowed & F.col("is_preclose")).alias("preclose_bars"),
        )
    )


# --- joins and the instrument dimension -----------------------------------------------------


@query(
    "unique_key_merge",
    f"""SELECT a.symbol, a.trading_date, {r('a.close / a.open - 1', 'session_return')}, {r('b.y', 'label')}
        FROM t_panel a JOIN (SELECT symbol, trading_date, ln(lead(close, 5) OVER (PARTITION BY symbol ORDER BY trading_date) / close) AS y
                             FROM t_panel) b USING (symbol, trading_date) WHERE b.y IS NOT NULL""",
)
def unique_key_merge(spark, folder):
    from tidepanel.operators.joins import merge_unique

    panel = src.settled_panel(spark, folder)
    left = panel.select("symbol", "trading_date", (F.col("close") / F.col("open") - 1.0).alias("session_return"))
    right = L.forward_labels(panel, (5,)).select(
        "symbol", "trading_date", F.col("forward_log_return_5s").alias("label")
    ).filter("label IS NOT NULL")
    return tidy(merge_unique(left, right, ["symbol", "trading_date"], "inner"))


@query(
    "instrument_reconcile",
    """SELECT s.symbol, s.root, CASE WHEN d.root IS NOT NULL THEN 'configured' ELSE 'missing' END AS metadata_status,
              d.tick_value, d.multiplier
       FROM (SELECT DISTINCT symbol, CASE WHEN digits <> '' THEN substr(symbol, 1, length(symbol) - length(digits) - 1)
                    WHEN symbol IN (SELECT DISTINCT upper(substr(p_type, 1, 2)) FROM part) THEN symbol END AS root
             FROM (SELECT symbol, regexp_extract(symbol, '[FGHJKMNQUVXZ]([0-9]{1,2})$', 1) AS digits
                   FROM (SELECT CASE WHEN p_size % 2 = 0 THEN upper(substr(p_type, 1, 2)) ELSE upper(substr(p_type, 1, 2)) || 'U' || CAST(p_size % 30 AS VARCHAR) END AS symbol FROM part))) s
       LEFT JOIN (SELECT upper(substr(p_type, 1, 2)) AS root, CAST(max(p_size) AS DOUBLE) AS multiplier, CAST(max(p_size) * 0.25 AS DOUBLE) AS tick_value
                  FROM part GROUP BY 1) d USING (root)""",
)
def instrument_reconcile(spark, folder):
    from tidepanel.operators.joins import reconcile_instruments

    part = src.table(spark, folder, "part")
    root = F.upper(F.substring("p_type", 1, 2))
    symbols = part.select(
        F.when(F.col("p_size") % 2 == 0, root)
        .otherwise(F.concat(root, F.lit("U"), (F.col("p_size") % 30).cast("string")))
        .alias("symbol")
    ).distinct()
    master = part.groupBy(root.alias("root")).agg(
        F.max("p_size").cast("double").alias("multiplier"), (F.max("p_size") * 0.25).cast("double").alias("tick_value")
    )
    return reconcile_instruments(symbols, master)


@query(
    "tick_economics",
    """SELECT p_type AS root, CAST(count(*) - 1 AS BIGINT) AS duplicate_roots,
              CAST(count(*) FILTER (p_size <= 0 OR p_retailprice <= 0) AS BIGINT) AS nonpositive_values,
              CAST(count(*) FILTER (abs(p_size * 0.25 - CASE WHEN p_partkey % 7 = 0 THEN p_size ELSE p_size * 0.25 END) > 1e-9) AS BIGINT) AS broken_tick_values
       FROM part GROUP BY p_type""",
)
def tick_economics(spark, folder):
    from tidepanel.operators.joins import tick_economics as check

    master = src.table(spark, folder, "part").select(
        F.col("p_type").alias("root"), F.col("p_size").cast("double").alias("multiplier"),
        F.lit(0.25).alias("tick_size"), F.col("p_retailprice").alias("margin"),
        F.when(F.col("p_partkey") % 7 == 0, F.col("p_size")).otherwise(F.col("p_size") * 0.25).cast("double").alias("tick_value"),
    )
    return check(master)


@query(
    "set_operations",
    """SELECT 'both' AS kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT CAST(l_shipdate AS DATE) FROM lineitem INTERSECT SELECT CAST(o_orderdate AS DATE) FROM orders)
       UNION ALL SELECT 'shipped_only', count(*) FROM (SELECT CAST(l_shipdate AS DATE) FROM lineitem EXCEPT SELECT CAST(o_orderdate AS DATE) FROM orders)
       UNION ALL SELECT 'either', count(*) FROM (SELECT CAST(l_shipdate AS DATE) FROM lineitem UNION SELECT CAST(o_orderdate AS DATE) FROM orders)""",
)
def set_operations(spark, folder):
    a = src.table(spark, folder, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    b = src.table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    parts = {"both": a.intersect(b), "shipped_only": a.subtract(b), "either": a.union(b).distinct()}
    out = None
    for kind, part in parts.items():
        row = part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "keep_last_per_key",
    f"""SELECT user_id, event_type, {r('value', 'value')} FROM (
          SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def keep_last_per_key(spark, folder):
    from tidepanel.operators.joins import keep_last

    return tidy(
        keep_last(src.table(spark, folder, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["value"])
    )


@query(
    "wide_panel_pivot",
    "SELECT trading_date, " + ", ".join(r(f"max(close / open - 1) FILTER (symbol = '{s}')", s) for s in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
    + " FROM t_session GROUP BY trading_date",
)
def wide_panel_pivot(spark, folder):
    names = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    panel = src.session_panel(spark, folder)
    return tidy(
        panel.withColumn("x", F.col("close") / F.col("open") - 1.0)
        .groupBy("trading_date").pivot("symbol", names).agg(F.max("x"))
    )
