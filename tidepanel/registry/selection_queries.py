"""Selection, models, streaming and their SQL."""

from pyspark.sql import functions as F

from tidepanel.functions import frames
from tidepanel.functions.scalars import tidy
from tidepanel.operators import accounting as B
from tidepanel.operators import displacement as D
from tidepanel.operators import evaluate as E
from tidepanel.operators import features as X
from tidepanel.operators import labels as L
from tidepanel.operators import models as M
from tidepanel.operators import selection as K
from tidepanel.operators import signals as N
from tidepanel.plans import studies as P
from tidepanel.registry.base import query, r, shared
from tidepanel.registry.displacement_queries import hours
from tidepanel.registry.evaluate_queries import dd, dense_panel, few, grid, sharpe_sql
from tidepanel.registry.signal_queries import learning
from tidepanel.session import cut_lineage
from tidepanel.sources import tables as src
from tidepanel.streaming import bars as S

shared(
    t_summary=f"""
SELECT strategy, symbol, family, avg(net) FILTER (research_window = 'build') * 252 AS build_annualized_return,
  avg(net) FILTER (research_window = 'selection') * 252 AS selection_annualized_return,
  sum(entries) FILTER (research_window = 'build') AS build_trades, sum(entries) FILTER (research_window = 'selection') AS selection_trades,
  least(({sharpe_sql('net', "FILTER (research_window = 'build')")}), ({sharpe_sql('net', "FILTER (research_window = 'selection')")}))
  + 0.25 * (({sharpe_sql('net', "FILTER (research_window = 'build')")}) + ({sharpe_sql('net', "FILTER (research_window = 'selection')")})) / 2 AS robust_score
FROM t_grid_window GROUP BY strategy, symbol, family
"""
)


def summary(spark, folder):
    panel = dense_panel(spark, folder)
    df = N.session_grid_returns(panel, 1.0)
    df = df.join(L.research_windows(panel, "2000-06-01"), "trading_date")
    return cut_lineage(E.window_metrics(df, ["strategy", "symbol", "family"], "net", "entries"))


@query(
    "top_rules_with_supplements",
    f"""WITH q AS (SELECT *, true AS qualified FROM t_summary WHERE build_annualized_return > 0 AND selection_annualized_return > 0
              AND build_trades >= 3 AND selection_trades >= 3 ORDER BY robust_score DESC, strategy LIMIT 100),
       o AS (SELECT *, false AS qualified, row_number() OVER (ORDER BY robust_score DESC, strategy) AS rk FROM t_summary
             WHERE strategy NOT IN (SELECT strategy FROM q))
       SELECT strategy, qualified, {r('robust_score', 'robust_score')} FROM (
         SELECT strategy, qualified, robust_score FROM q UNION ALL
         SELECT strategy, qualified, robust_score FROM o WHERE rk <= 20 - (SELECT count(*) FROM q))""",
)
def top_rules_with_supplements(spark, folder):
    out = K.with_supplements(summary(spark, folder), K.eligible(3, 3), "robust_score")
    return tidy(out.select("strategy", "qualified", "robust_score"))


@query(
    "best_rule_per_symbol",
    f"""SELECT symbol, strategy, {r('robust_score', 'robust_score')} FROM (
         SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY robust_score DESC, strategy) AS rk FROM t_summary)
       WHERE rk = 1 ORDER BY robust_score DESC, strategy LIMIT 4""",
)
def best_rule_per_symbol(spark, folder):
    out = K.best_per_key(summary(spark, folder), "symbol", "robust_score", 4)
    return tidy(out.select("symbol", "strategy", "robust_score"))


@query(
    "family_champions",
    f"""SELECT family, strategy, rk AS "rank", rk = 1 AS champion, {r('robust_score', 'robust_score')} FROM (
         SELECT *, CAST(row_number() OVER (PARTITION BY family ORDER BY robust_score DESC, strategy) AS INTEGER) AS rk FROM t_summary)
       WHERE rk <= 3""",
)
def family_champions(spark, folder):
    out = K.champions(summary(spark, folder), "family", "robust_score")
    return tidy(out.select("family", "strategy", "rank", "champion", "robust_score"))


@query(
    "parameter_ensembles",
    f"""SELECT symbol || '_' || family AS sleeve, CAST(any_value(n) AS BIGINT) AS members, g.trading_date, {r('avg(net)', 'net', 10)}
        FROM t_grid g JOIN (SELECT *, count(*) OVER (PARTITION BY symbol, family) AS n FROM t_summary
                            WHERE build_trades >= 20 AND selection_trades >= 8 AND robust_score > -1.0) s USING (strategy, symbol, family)
        WHERE n >= 2 GROUP BY symbol, family, g.trading_date""",
)
def parameter_ensembles(spark, folder):
    from pyspark.sql import Window

    s = summary(spark, folder).filter(
        "build_trades >= 20 AND selection_trades >= 8 AND robust_score > -1.0"
    )
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol", "family"))
    s = s.withColumn("members", n).filter("members >= 2").select("strategy", "members")
    df = grid(spark, folder).join(s, "strategy")
    out = df.groupBy(
        F.concat_ws("_", "symbol", "family").alias("sleeve"), "members", "trading_date"
    ).agg(F.avg("net").alias("net"))
    return tidy(out, 10)


@query(
    "parameter_neighbours",
    f"""SELECT c.strategy AS selected_strategy, a.strategy, {r('a.full_sharpe', 'full_sharpe')}
        FROM (SELECT *, CAST(list_position([1, 2, 3, 5, 10, 20, 40, 60], lookback) AS INT) AS i, CAST(threshold * 2 AS INT) AS j FROM t_stability) a
        JOIN (SELECT *, CAST(list_position([1, 2, 3, 5, 10, 20, 40, 60], lookback) AS INT) AS i, CAST(threshold * 2 AS INT) AS j FROM t_stability) c
          ON a.symbol = c.symbol AND a.family = c.family AND abs(a.i - c.i) <= 1 AND abs(a.j - c.j) <= 1 AND a.strategy <> c.strategy
        WHERE c.full_sharpe > 0""",
)
def parameter_neighbours(spark, folder):
    audit = cut_lineage(
        E.stability_audit(
            grid(spark, folder), ["strategy", "symbol", "family", "lookback", "threshold"], "net"
        )
    )
    out = K.parameter_neighbours(
        audit, audit.filter("full_sharpe > 0"), N.SESSION_LOOKBACKS, N.SESSION_THRESHOLDS
    )
    return tidy(out.select("selected_strategy", "strategy", "full_sharpe"))


#: A series (with its mean and deviation beside it) as a unit vector, NULL when constant.
UNIT = "CASE WHEN sd > 0 THEN list_transform(series, lambda x: (x - m) / (sqrt(len(series)) * sd)) END AS unit"
SERIES = "list({0} ORDER BY trading_date) AS series, avg({0}) AS m, stddev_pop({0}) AS sd"


def greedy_sql(candidates: str, keys: str, target: int, per_symbol: int, maximum: float) -> str:
    """Recursive statement: one rank a step, with the ranks that a candidate resembles found before."""
    on = " AND ".join(f"w.{k} = c.{k}" for k in keys.split(", "))
    named = ", ".join(f"w.{k}" for k in keys.split(", "))
    pair = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    free = (f"len(picks) < {target} AND len(list_filter(picks, lambda p: p.symbol = c.symbol)) < {per_symbol} AND "
            f"NOT list_has_any(list_transform(picks, lambda p: p.rk), c.alike)")
    return f"""
WITH RECURSIVE ranked AS MATERIALIZED (
  SELECT a.* EXCLUDE (unit), coalesce(alike, CAST([] AS BIGINT[])) AS alike
  FROM {candidates} a LEFT JOIN (
    SELECT {', '.join(f"a.{k}" for k in keys.split(', '))}, a.rk, list(b.rk) AS alike
    FROM {candidates} a JOIN {candidates} b ON {pair} AND b.rk < a.rk AND abs(list_inner_product(a.unit, b.unit)) > {maximum}
    GROUP BY ALL) b ON {pair} AND a.rk = b.rk
), walk AS (
  SELECT {keys}, CAST(0 AS BIGINT) AS rk, CAST([] AS STRUCT(rk BIGINT, symbol VARCHAR)[]) AS picks
  FROM (SELECT DISTINCT {keys} FROM {candidates})
  UNION ALL
  SELECT {named}, w.rk + 1, CASE WHEN {free} THEN list_append(picks, {{'rk': c.rk, 'symbol': c.symbol}}) ELSE picks END
  FROM walk w JOIN ranked c ON {on} AND c.rk = w.rk + 1
)
SELECT {', '.join(f"c.{k}" for k in keys.split(', '))}, c.strategy, c.symbol, c.score, CAST(pick AS INTEGER) AS pick
FROM (SELECT {keys}, unnest(range(1, len(picks) + 1)) AS pick, unnest(picks).rk AS chosen
      FROM walk QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY rk DESC) = 1) w
JOIN ranked c ON {on} AND c.rk = w.chosen
"""


shared(
    t_pruned_candidates=f"""
SELECT 'all' AS key, strategy, symbol, score, row_number() OVER (ORDER BY score DESC NULLS LAST, strategy) AS rk, {UNIT}
FROM (SELECT strategy, symbol, round(robust_score, 9) AS score FROM t_summary)
JOIN (SELECT strategy, {SERIES.format('net')} FROM t_grid WHERE trading_date < DATE '2000-06-01' GROUP BY strategy)
USING (strategy)
""",
)


@query(
    "correlation_pruned_selection",
    "SELECT * FROM (SELECT key, strategy, symbol, round(score, 6) + 0.0 AS robust_score, pick FROM ("
    + greedy_sql("t_pruned_candidates", "key", 12, 2, 0.65)
    + ") QUALIFY count(*) OVER () >= 3)",
)
def correlation_pruned_selection(spark, folder):
    """Greedy picks from the ranked list.  Scores are rounded first, so equal rules tie in every engine."""
    s = summary(spark, folder)
    arrays = K.series_arrays(
        grid(spark, folder), "strategy", "net", F.col("trading_date") < F.lit("2000-06-01")
    )
    rows = s.join(arrays, "strategy").withColumn("key", F.lit("all")).withColumn("robust_score", F.round("robust_score", 9))
    return tidy(K.greedy_pruned(rows, ["key"], "robust_score", target=12, per_symbol=2, maximum_correlation=0.65, least=3))


shared(
    t_prior4=f"""
SELECT strategy, symbol, family, e AS evaluation_fold, avg(s) - 0.25 * stddev_pop(s) AS training_score, min(s) AS worst, sum(a) AS training_trades
FROM (SELECT strategy, symbol, family, block, {sharpe_sql('net')} AS s, count(*) FILTER (sides > 0) AS a
      FROM t_grid JOIN t_block4 USING (trading_date) GROUP BY ALL)
JOIN (VALUES (2), (3), (4)) v(e) ON block < e GROUP BY ALL HAVING count(s) = e - 1
""",
    t_chain=f"""
SELECT p.*, least(2.0, 0.10 / v) AS leverage
FROM (SELECT *, row_number() OVER (PARTITION BY evaluation_fold ORDER BY training_score DESC, strategy DESC) AS rk
      FROM t_prior4 WHERE training_trades >= greatest(12, 6 * (evaluation_fold - 1))) p
JOIN (SELECT strategy, e AS evaluation_fold, stddev_samp(net) * sqrt(252) AS v FROM t_grid JOIN t_block4 USING (trading_date)
      JOIN (VALUES (2), (3), (4)) w(e) ON block < e GROUP BY ALL) USING (strategy, evaluation_fold) WHERE rk = 1
""",
)


@query(
    "prior_fold_scores",
    f"""SELECT strategy, evaluation_fold, {r('training_score', 'training_score')}, {r('worst', 'worst_prior_sharpe')},
        CAST(training_trades AS BIGINT) AS training_trades FROM t_prior4""",
)
def prior_fold_scores(spark, folder):
    out = K.prior_fold_scores(grid(spark, folder), ["strategy"], "net", "sides")
    return tidy(out.drop("prior_fold_sharpes"))


def chained(spark, folder, returns):
    need = F.greatest(F.lit(12), 6 * (F.col("evaluation_fold") - 1))
    return K.chained_selection(returns, ["strategy"], "net", "sides", need)


@query(
    "chained_selection",
    f"""SELECT evaluation_fold, strategy, {r('training_score', 'training_score')}, {r('leverage', 'leverage')} FROM t_chain""",
)
def chained_selection(spark, folder):
    out = chained(spark, folder, grid(spark, folder))
    return tidy(out.select("evaluation_fold", "strategy", "training_score", "leverage"))


@query(
    "selection_cost_replay",
    " UNION ALL ".join(
        f"""SELECT trading_date, {c}::DOUBLE AS cost_bps, {r(f'(gross - sides * {c} / 10000) * leverage', 'portfolio_return')}
        FROM t_grid JOIN t_block4 USING (trading_date) JOIN t_chain t ON t.strategy = t_grid.strategy AND t.evaluation_fold = block"""
        for c in (0.0, 2.0, 5.0)
    ),
)
def selection_cost_replay(spark, folder):
    returns = cut_lineage(
        grid(spark, folder).select("strategy", "trading_date", "gross", "sides", "net")
    )
    picked = cut_lineage(chained(spark, folder, returns))
    stressed = E.with_costs(returns.drop("net"), (0.0, 2.0, 5.0))
    out = K.replay(stressed, picked, ["strategy"], "net")
    return tidy(out.select("trading_date", "cost_bps", "portfolio_return"))


@query(
    "chained_selection_per_symbol",
    f"""SELECT evaluation_fold, symbol, strategy, {r('training_score', 'training_score')} FROM (
          SELECT *, row_number() OVER (PARTITION BY evaluation_fold, symbol ORDER BY training_score DESC, strategy DESC, symbol DESC) AS rk
          FROM t_prior4 WHERE training_trades >= 3) WHERE rk = 1""",
)
def chained_selection_per_symbol(spark, folder):
    out = K.chained_selection(
        grid(spark, folder), ["strategy", "symbol"], "net", "sides", F.lit(3), within=["symbol"]
    )
    return tidy(out.select("evaluation_fold", "symbol", "strategy", "training_score"))


FOLDS = "(VALUES (2), (3), (4)) v(e)"
shared(
    t_family_scores=f"""
SELECT strategy, symbol, family, e AS evaluation_fold, round(avg(s) - 0.25 * stddev_pop(s), 9) AS score, min(s) AS worst, sum(a) AS training_trades
FROM (SELECT strategy, symbol, family, block, {sharpe_sql('gross')} AS s, count(*) FILTER (sides > 0) AS a
      FROM t_grid JOIN t_block4 USING (trading_date) GROUP BY ALL)
JOIN {FOLDS} ON block < e GROUP BY strategy, symbol, family, e
HAVING count(s) = e - 1 AND sum(a) >= greatest(12, 6 * (e - 1)) AND min(s) > -0.5
""",
    t_family_candidates=f"""
SELECT evaluation_fold, family, strategy, symbol, score,
       row_number() OVER (PARTITION BY evaluation_fold, family ORDER BY score DESC NULLS LAST, strategy) AS rk, {UNIT}
FROM t_family_scores JOIN (
  SELECT strategy, e AS evaluation_fold, {SERIES.format('gross')}
  FROM t_grid JOIN t_block4 USING (trading_date) JOIN {FOLDS} ON block < e GROUP BY strategy, e) USING (strategy, evaluation_fold)
""",
    t_family_picks="SELECT * FROM (" + greedy_sql("t_family_candidates", "evaluation_fold, family", 3, 1, 0.75) + ")",
    t_family_sleeves="""
SELECT evaluation_fold, family, trading_date, block, avg(gross) AS sleeve
FROM t_family_picks JOIN t_grid USING (strategy, family) JOIN t_block4 USING (trading_date) WHERE block <= evaluation_fold GROUP BY ALL
""",
    t_family_weights="""
SELECT evaluation_fold, family, 1 / vol / sum(1 / vol) OVER (PARTITION BY evaluation_fold) AS w0
FROM (SELECT evaluation_fold, family, stddev_samp(sleeve) AS vol FROM t_family_sleeves WHERE block < evaluation_fold GROUP BY ALL)
QUALIFY count(*) OVER (PARTITION BY evaluation_fold) >= 2
""",
)


def _family_weights_sql(cap: float, passes: int) -> str:
    sql = "SELECT evaluation_fold, family, w0 AS w FROM t_family_weights"
    for _ in range(passes):
        sql = f"""SELECT evaluation_fold, family, CASE WHEN w > {cap} THEN {cap} WHEN u > 0 THEN w + e * w / u ELSE w END AS w
            FROM (SELECT *, coalesce(sum(w - {cap}) FILTER (w > {cap}) OVER (PARTITION BY evaluation_fold), 0) AS e,
                         coalesce(sum(w) FILTER (w <= {cap}) OVER (PARTITION BY evaluation_fold), 0) AS u FROM ({sql}))"""
    return f"SELECT evaluation_fold, family, w / sum(w) OVER (PARTITION BY evaluation_fold) AS weight FROM ({sql})"


shared(
    t_family_portfolio=f"""
SELECT m.trading_date, m.evaluation_fold, m.r * least(2.0, 0.10 / l.v) AS portfolio_return
FROM (SELECT trading_date, evaluation_fold, block, sum(sleeve * weight) AS r
      FROM t_family_sleeves JOIN ({_family_weights_sql(0.4, 2)}) USING (evaluation_fold, family) GROUP BY ALL) m
JOIN (SELECT evaluation_fold, stddev_samp(r) * sqrt(252) AS v
      FROM (SELECT trading_date, evaluation_fold, block, sum(sleeve * weight) AS r
            FROM t_family_sleeves JOIN ({_family_weights_sql(0.4, 2)}) USING (evaluation_fold, family) GROUP BY ALL)
      WHERE block < evaluation_fold GROUP BY evaluation_fold) l USING (evaluation_fold)
WHERE m.block = m.evaluation_fold
""",
)


def family_study(spark, folder):
    returns = cut_lineage(
        grid(spark, folder, 0.0).select("strategy", "symbol", "family", "trading_date", "net", "sides")
    )
    return K.walk_forward_families(returns, "family", "net", "sides", minimum_score=None, folds=4, digits=9)


@query("walk_forward_family_members",
       f"SELECT evaluation_fold, family, strategy, symbol, {r('score', 'training_score')}, pick FROM t_family_picks")
def walk_forward_family_members(spark, folder):
    picked, _ = family_study(spark, folder)
    return tidy(picked)


@query("walk_forward_family_selection",
       f"SELECT trading_date, evaluation_fold, {r('portfolio_return', 'portfolio_return')} FROM t_family_portfolio")
def walk_forward_family_selection(spark, folder):
    """Greedy members per family and fold, capped weights, leverage."""
    _, portfolio = family_study(spark, folder)
    return tidy(portfolio)


# --- models ------------------------------------------------------------------------------

MODEL_FEATURES = ["momentum_5s", "momentum_20s", "standardized_return_20s", "price_to_sma_20s",
                  "trend_slope_20s", "return_volatility_20s", "range_zscore_20s", "close_location"]
TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


def ridge_inputs(spark, folder, validation=504):
    panel = src.settled_panel(spark, folder)
    feats = X.session_features(panel, ("return",)).select("symbol", "trading_date", *MODEL_FEATURES)
    labels = L.forward_labels(panel, (5,))
    df = cut_lineage(feats.join(labels, ["symbol", "trading_date"]))
    df = df.withColumn(
        "target", L.volatility_scaled_target("forward_log_return_5s", "return_volatility_20s", 5)
    )
    train = L.training_folds(
        df.filter("target IS NOT NULL"), df, "label_available_at_5s_utc", validation=validation
    )
    apply = L.fold_of_session(df, validation=validation).filter("fold IS NOT NULL")
    return train, apply


@query("pooled_ridge_forecasts")
def pooled_ridge_forecasts(spark, folder):
    """Exact penalized fits per fold; the tests refit them with dense linear algebra."""
    train, apply = ridge_inputs(spark, folder)
    forecast, _ = M.pooled_ridge(train, apply, MODEL_FEATURES, TYPES)
    return tidy(forecast.select("symbol", "trading_date", "fold", "forecast"))


@query("ridge_coefficient_stability")
def ridge_coefficient_stability(spark, folder):
    train, apply = ridge_inputs(spark, folder)
    _, table = M.pooled_ridge(train, apply, MODEL_FEATURES, TYPES)
    return tidy(M.coefficient_stability(table))


@query(
    "single_feature_ridge",
    f"""WITH f AS (SELECT f.fold, f.train_end, x.symbol, x.trading_date, x.x, x.y, x.label_date FROM t_ridge x
                   JOIN t_folds4 f ON x.trading_date <= f.train_end AND x.label_date <= f.train_end WHERE y IS NOT NULL AND x IS NOT NULL),
            m AS (SELECT fold, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my FROM f GROUP BY fold),
            b AS (SELECT fold, any_value(mx) AS mx, any_value(sx) AS sx, any_value(my) AS my,
                         sum((x - mx) / sx * (y - my)) / (sum(pow((x - mx) / sx, 2)) + 10) AS beta FROM f JOIN m USING (fold) GROUP BY fold)
       SELECT v.symbol, v.trading_date, v.fold, {r('my + beta * (x - mx) / sx', 'forecast')}
       FROM (SELECT x.*, f.fold FROM t_ridge x JOIN t_folds4 f ON x.trading_date BETWEEN f.validation_start AND f.validation_end) v
       JOIN b USING (fold) WHERE x IS NOT NULL""",
)
def single_feature_ridge(spark, folder):
    """One-feature form of the Gram solve, small enough to state in SQL."""
    train, apply = ridge_inputs(spark, folder)
    names = ["momentum_5s"]
    forecast, _ = M.pooled_ridge(
        train.filter("momentum_5s IS NOT NULL"), apply.filter("momentum_5s IS NOT NULL"), names, [],
        robust=False,
    )
    return tidy(forecast.select("symbol", "trading_date", "fold", "forecast"))


shared(
    t_folds4="""
SELECT CAST(f + 1 AS INTEGER) AS fold, a.trading_date AS train_end, d.trading_date AS validation_start, e.trading_date AS validation_end
FROM (SELECT unnest(range(0, 40)) AS f) k JOIN t_cal a ON a.n = 503 + 504 * f JOIN t_cal d ON d.n = 509 + 504 * f
JOIN t_cal e ON e.n = least(1012 + 504 * f, (SELECT max(n) FROM t_cal))
""",
    t_ridge="""
SELECT symbol, trading_date, label_date, CASE WHEN n5 >= 5 THEN exp(s5) - 1 END AS x,
       CASE WHEN y IS NOT NULL AND n20 >= 20 AND sd <> 0 THEN greatest(least(y / (sd * sqrt(5.0)), 5), -5) END AS y
FROM (SELECT symbol, trading_date, lead(trading_date, 5) OVER w AS label_date, ln(lead(close, 5) OVER w / close) AS y,
             sum(lr) OVER w5 AS s5, count(lr) OVER w5 AS n5, stddev_samp(lr) OVER w20 AS sd, count(lr) OVER w20 AS n20
      FROM t_in2 WINDOW w AS (PARTITION BY symbol ORDER BY trading_date),
      w5 AS (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
      w20 AS (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
""",
)


def learning_folds(spark, folder):
    from tidepanel.operators.evaluate import date_blocks

    frame = cut_lineage(date_blocks(learning(spark, folder), 4))
    train = frame.withColumn(
        "fold", F.explode(F.sequence(F.lit(2), F.lit(4)))
    ).filter(F.col("block") < F.col("fold"))
    apply = frame.filter("block > 1").withColumn("fold", F.col("block"))
    return train.withColumn("target", F.col("target_return")), apply


@query("learning_ridge_and_trees")
def learning_ridge_and_trees(spark, folder):
    """Ridge, boosted trees and their mean on the learning frame, three evaluation blocks."""
    train, apply = learning_folds(spark, folder)
    names = list(N.LEARNING_FEATURES)
    ridge, _ = M.pooled_ridge(train, apply, names, [], robust=False)
    keep = ["symbol", "trading_date", "fold"]
    ridge = ridge.select(*keep, "target_return", F.col("forecast").alias("ridge_prediction"))
    trees = M.boosted_by_fold(train, apply, names, [2, 3, 4])
    out = ridge.join(trees.select(*keep, F.col("nonlinear").alias("nonlinear_prediction")), keep)
    return tidy(
        out.withColumn(
            "ensemble_prediction", (F.col("ridge_prediction") + F.col("nonlinear_prediction")) / 2.0
        )
    )


@query(
    "conviction_portfolio",
    f"""SELECT trading_date, {r('coalesce(sum(p * coalesce(y, 0) - abs(p) * 2 * 1.0 / 10000) / nullif(sum(abs(p)), 0), 0)', 'net')}, {r('sum(abs(p))', 'active_legs')}
        FROM (SELECT *, CASE WHEN abs(f) >= 0.002 AND rk <= 4 THEN sign(f) ELSE 0 END AS p
              FROM (SELECT *, row_number() OVER (PARTITION BY trading_date ORDER BY abs(f) DESC, symbol) AS rk
                    FROM (SELECT symbol, trading_date, -close_to_close_return AS f,
                                 lead(close_to_close_return) OVER (PARTITION BY symbol ORDER BY trading_date) AS y FROM t_panel)
                    WHERE f IS NOT NULL)) GROUP BY trading_date""",
)
def conviction_portfolio(spark, folder):
    w = frames.ordered("symbol", "trading_date")
    df = src.session_panel(spark, folder).select(
        "symbol", "trading_date", (-F.col("close_to_close_return")).alias("f"),
        F.lead("close_to_close_return").over(w).alias("ret"),
    ).filter("f IS NOT NULL")
    return tidy(B.active_leg_portfolio(M.conviction_positions(df, "f", 10.0), [], 1.0))


# Instrument and horizon of the leads.
LEADS = [("view", 23), ("click", 115), ("view", 115)]
BASELINE = ["absolute_regression_zscore_24h", "absolute_prediction_interval_position_24h"]
STATES = {
    "displacement_only": BASELINE,
    "full_state": [c for c in D.FEATURES if c not in D.REGIME_COLUMNS] + BASELINE,
}
EXTREME = 1.0


def reversion_inputs(spark, folder):
    """Hourly features, first-passage labels of both horizons and three blocks of dates."""
    base = cut_lineage(D.regression_features(hours(spark, folder)))
    df = base.withColumns({
        BASELINE[0]: F.abs("regression_residual_zscore_24h"), BASELINE[1]: F.abs("prediction_interval_position_24h"),
    })
    labels = D.regression_targets(base, tuple(sorted({h for _, h in LEADS}))).drop("trading_date")
    return cut_lineage(E.date_blocks(df.join(labels, ["symbol", "hour_start_utc"]), 3))


def reversion_study(spark, folder):
    df = reversion_inputs(spark, folder)
    found = cut_lineage(P.probability_predictions(df, LEADS, STATES, EXTREME))
    return found, *P.probability_sleeve(df, found, LEADS, list(STATES))


@query("reversion_probability_sleeve")
def reversion_probability_sleeve(spark, folder):
    """Costed daily returns of the logistic reversion probabilities, per fold, feature set and scope."""
    return tidy(reversion_study(spark, folder)[1])


@query("reversion_probability_folds")
def reversion_probability_folds(spark, folder):
    """Return, risk, cost, entries and active hours of every fold, feature set and scope."""
    return tidy(reversion_study(spark, folder)[2])


@query("reversion_probability_diagnostics")
def reversion_probability_diagnostics(spark, folder):
    """Calibration and discrimination of every lead, fold and feature set."""
    found = P.probability_predictions(reversion_inputs(spark, folder), LEADS, STATES, EXTREME)
    return tidy(E.probability_diagnostics(found, ["lead", "fold", "model_variant"], "reversion_probability", "target"))


@query(
    "hourly_weight_accounting",
    f"""SELECT hour_start_utc_ts, {r('sum(held * ret)', 'gross_return')}, {r('sum(turn)', 'turnover')},
        {r('sum(turn) * 3.5 / 10000', 'cost', 9)}, {r('sum(abs(held))', 'gross_exposure')}
        FROM (SELECT *, abs(held - coalesce(lag(held) OVER w, 0)) / 2 + CASE WHEN lead(rn) OVER w IS NULL THEN abs(held) / 2 ELSE 0 END AS turn
              FROM (SELECT symbol, rn, epoch(hour_start_utc)::BIGINT AS hour_start_utc_ts, coalesce(exp(lr) - 1, 0) AS ret,
                      coalesce(lag(wt) OVER (PARTITION BY symbol ORDER BY rn), 0) AS held
                    FROM (SELECT *, coalesce(CASE WHEN vol24 IS NOT NULL AND z IS NOT NULL THEN greatest(least(-sign(d) * least(abs(z) / 4, 1) * 0.1 / sqrt(2.0) / nullif(vol24, 0), 0.25), -0.25) END, 0) AS wt FROM t_d6))
              WINDOW w AS (PARTITION BY symbol ORDER BY rn)) GROUP BY hour_start_utc_ts""",
)
def hourly_weight_accounting(spark, folder):
    df = D.own_features(hours(spark, folder))
    p = F.least(F.abs("regression_residual_zscore_24h") / 4.0, F.lit(1.0)) * 0.45 + 0.55
    known = F.col("regression_residual_zscore_24h").isNotNull()
    df = df.withColumn("p", F.when(known, p)).withColumn(
        "wt", B.probability_weight("p", "regression_displacement_24h", "realized_volatility_24h")
    )
    df = df.withColumn("ret", F.expm1("log_return_1h"))
    out = B.hourly_pnl(df, [], "hour_start_utc", "wt", "ret", 3.5)
    return tidy(
        out.select(
            F.unix_timestamp("hour_start_utc").alias("hour_start_utc_ts"), "gross_return", "turnover",
            "cost", "gross_exposure",
        ),
        cost=9,
    )


# --- streaming ---------------------------------------------------------------------------


@query(
    "streaming_hour_bars",
    f"""SELECT event_type AS symbol, epoch(date_trunc('hour', ts))::BIGINT AS hour_ts,
        {r('first(p ORDER BY ts, p)', 'open')}, {r('max(p)', 'high')}, {r('min(p)', 'low')}, {r('last(p ORDER BY ts, p)', 'close')},
        CAST(sum(user_id % 100 + 1) AS BIGINT) AS volume, CAST(count(*) AS BIGINT) AS prints
        FROM (SELECT *, 100.0 + floor(ln(1 + value) * 100000) / 100000.0 AS p FROM events)
        GROUP BY 1, date_trunc('hour', ts)""",
)
def streaming_hour_bars(spark, folder):
    out = S.run_backfill(S.live_bars(S.event_stream(spark, folder)), "hour-bars", "symbol", "timestamp_utc")
    return tidy(
        out.withColumn("hour_ts", F.unix_timestamp("timestamp_utc")).drop("timestamp_utc")
    )
