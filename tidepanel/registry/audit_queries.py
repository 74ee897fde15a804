"""Audits of walk-forward studies: choices, folds, cost levels, stresses and gates."""

from pyspark.sql import functions as F

from tidepanel.functions.scalars import tidy
from tidepanel.operators import evaluate as E
from tidepanel.operators import selection as K
from tidepanel.plans import audit as A
from tidepanel.plans import studies as P
from tidepanel.registry.allocation_queries import week_returns
from tidepanel.registry.base import query, r, shared
from tidepanel.registry.evaluate_queries import dd, grid, sharpe_sql
from tidepanel.registry.selection_queries import _family_weights_sql, learning_ridge_and_trees, single_feature_ridge
from tidepanel.registry.study_queries import pass_one, pass_three, pass_two
from tidepanel.session import cut_lineage
from tidepanel.sources import tables as src

LEVELS = "(VALUES " + ", ".join(f"({c}::DOUBLE)" for c in A.COSTS) + ") costs(cost_bps)"


def extended_sql(source: str, key: str, x: str = "portfolio_return") -> str:
    """Daily, calendar-period and weekly figures of each series."""
    periods = " ".join(
        f"""JOIN (SELECT {key}, avg((v > 0)::INT) AS win_{p}s, CAST(count(*) FILTER (v > 0) AS BIGINT) AS positive_{p}s,
                         CAST(count(*) AS BIGINT) AS {p}s
                  FROM (SELECT {key}, date_trunc('{p}', trading_date) AS k, product(1 + {x}) - 1 AS v FROM {source} GROUP BY ALL)
                  GROUP BY {key}) {p}_table USING ({key})"""
        for p in E.PERIODS
    )
    return f"""SELECT d.*, {', '.join(f'{r(f"win_{p}s", f"win_{p}s")}, positive_{p}s, {p}s' for p in E.PERIODS)},
        weeks, positive_weeks, {r('positive_weeks / weeks', 'win_weeks')}
        FROM (SELECT {key}, CAST(count(*) AS BIGINT) AS observations, min(trading_date) AS "start", max(trading_date) AS "end",
                     {r('max_by(wealth, trading_date) - 1', 'total_return')}, {r(f'avg({x}) * 252', 'annualized_return')},
                     {r(f'stddev_samp({x}) * sqrt(252)', 'annualized_volatility')}, {r(sharpe_sql(x), 'sharpe')},
                     {r('min(drawdown)', 'maximum_drawdown')}, {r(f'avg(({x} > 0)::INT)', 'win_days')},
                     CAST(count(*) FILTER ({x} > 0) AS BIGINT) AS positive_days
              FROM {dd(source, key, x)} GROUP BY {key}) d {periods}
        JOIN (SELECT {key}, CAST((max(k) - min(k)) / 7 + 1 AS BIGINT) AS weeks, CAST(count(*) FILTER (v > 0) AS BIGINT) AS positive_weeks
              FROM (SELECT {key}, CAST(trading_date + CAST((12 - isodow(trading_date)) % 7 AS INTEGER) AS DATE) AS k,
                           product(1 + {x}) - 1 AS v FROM {source} GROUP BY 1, 2) GROUP BY {key}) week_table USING ({key})"""


shared(
    t_family_plan=f"""
SELECT w.evaluation_fold, w.family, w.weight, least(2.0, 0.10 / l.v) AS leverage FROM ({_family_weights_sql(0.4, 2)}) w
JOIN (SELECT evaluation_fold, stddev_samp(r) * sqrt(252) AS v
      FROM (SELECT trading_date, evaluation_fold, sum(sleeve * weight) AS r
            FROM t_family_sleeves JOIN ({_family_weights_sql(0.4, 2)}) USING (evaluation_fold, family)
            WHERE block < evaluation_fold GROUP BY ALL) GROUP BY evaluation_fold) l USING (evaluation_fold)
""",
    t_family_costs=f"""
SELECT cost_bps, trading_date, sum(sleeve * weight * leverage) AS portfolio_return
FROM (SELECT evaluation_fold, family, trading_date, cost_bps, avg(gross - sides * cost_bps / 10000) AS sleeve
      FROM t_family_picks JOIN t_grid USING (strategy, family) JOIN t_block4 USING (trading_date) CROSS JOIN {LEVELS}
      WHERE block = evaluation_fold GROUP BY ALL)
JOIN t_family_plan USING (evaluation_fold, family) GROUP BY ALL
""",
    t_chain_costs=f"""
SELECT evaluation_fold, cost_bps, trading_date, (gross - sides * cost_bps / 10000) * leverage AS portfolio_return
FROM (SELECT g.trading_date, g.gross, g.sides, t.leverage, t.evaluation_fold FROM t_grid g JOIN t_block4 USING (trading_date)
      JOIN t_chain t ON t.strategy = g.strategy AND t.evaluation_fold = block) CROSS JOIN {LEVELS}
""",
)


def family_audit(spark, folder):
    """The session grid by family; members are chosen before costs, where no two rules' costs tie."""
    return A.family_audit(grid(spark, folder, 0.0), "family", 0.0, None, digits=9)


def snapshots_sql(whole: str, folds: str, costs: str) -> str:
    parts = (("whole", whole, "portfolio", "0.0::DOUBLE"), ("fold", folds, "evaluation_fold", "evaluation_fold::DOUBLE"), ("cost", costs, "cost_bps", "cost_bps"))
    return " UNION ALL BY NAME ".join(
        f"SELECT '{section}' AS section, {level} AS level, * EXCLUDE ({key}) FROM ({extended_sql(source, key)})"
        for section, source, key, level in parts
    )


@query(
    "family_study_snapshots",
    snapshots_sql("(SELECT 1 AS portfolio, * FROM t_family_portfolio)", "t_family_portfolio", "t_family_costs"),
)
def family_study_snapshots(spark, folder):
    """Families chosen fold by fold: whole series, folds, and the saved choice at six cost levels."""
    return tidy(family_audit(spark, folder).snapshots())


@query(
    "family_study_stress",
    " UNION ALL ".join(
        f"""SELECT 'best_days_removed' AS section, {k} AS level, {r(f'product(1 + x) FILTER (rn > {k}) - 1', 'total_return')},
        {r(f"coalesce({sharpe_sql('x', f'FILTER (rn > {k})')}, 0)", 'sharpe')}
        FROM (SELECT portfolio_return AS x, row_number() OVER (ORDER BY portfolio_return DESC, trading_date) AS rn FROM t_family_portfolio)"""
        for k in A.REMOVED
    )
    + f""" UNION ALL SELECT 'subperiod', CAST(subperiod AS INTEGER), {r('product(1 + portfolio_return) - 1', 'total_return')},
        {r(f"coalesce({sharpe_sql('portfolio_return')}, 0)", 'sharpe')}
        FROM (SELECT *, ntile(4) OVER (ORDER BY trading_date) AS subperiod FROM t_family_portfolio) GROUP BY subperiod""",
)
def family_study_stress(spark, folder):
    return tidy(family_audit(spark, folder).stress())


@query(
    "family_study_records",
    f"""SELECT p.evaluation_fold, p.family, p.strategy, p.symbol, {r('p.score', 'training_score')}, CAST(s.training_trades AS BIGINT) AS training_trades,
               CAST(b.block AS INTEGER) AS fold_no, {r('b.s', 'evidence')}
        FROM t_family_picks p JOIN t_family_scores s USING (strategy, evaluation_fold)
        JOIN (SELECT strategy, block, {sharpe_sql('gross')} AS s FROM t_grid JOIN t_block4 USING (trading_date) GROUP BY ALL) b
          ON b.strategy = p.strategy AND b.block < p.evaluation_fold
        UNION ALL SELECT evaluation_fold, family, '{K.FAMILY_WEIGHT}', '', {r('weight', 'training_score')}, 0, 0, {r('leverage', 'evidence')} FROM t_family_plan""",
)
def family_study_records(spark, folder):
    """Saved records with evidence as JSON, read back: a row per earlier fold of a member, one per weight."""
    records = cut_lineage(family_audit(spark, folder).records)
    members, weights = K.read_selection_records(records, "family")
    chosen = members.select(
        "evaluation_fold", "family", "strategy", "symbol", "training_score", "training_trades",
        F.posexplode("prior_fold_sharpes").alias("fold_no", "evidence"),
    ).withColumn("fold_no", F.col("fold_no") + 1)
    weighed = weights.select(
        "evaluation_fold", "family", F.lit(K.FAMILY_WEIGHT).alias("strategy"), F.lit("").alias("symbol"),
        F.col("weight").alias("training_score"), F.lit(0).cast("long").alias("training_trades"),
        F.lit(0).alias("fold_no"), F.col("leverage").alias("evidence"),
    )
    return tidy(chosen.unionByName(weighed))


@query("family_study_gates")
def family_study_gates(spark, folder):
    """Every gate of the study; one of them is on resampled returns, so there is no SQL."""
    return family_audit(spark, folder).gates


def chain_audit(spark, folder):
    return A.chain_audit(grid(spark, folder))


@query(
    "chain_study_snapshots",
    snapshots_sql("(SELECT 1 AS portfolio, * FROM t_chain_costs WHERE cost_bps = 1.0)", "(SELECT * FROM t_chain_costs WHERE cost_bps = 1.0)", "t_chain_costs"),
)
def chain_study_snapshots(spark, folder):
    """The best rule of earlier folds: whole series, folds, and the saved choice at six cost levels."""
    return tidy(chain_audit(spark, folder).snapshots())


@query("network_study_gates")
def network_study_gates(spark, folder):
    """The network grid chosen rule by rule, with every gate."""
    panel = cut_lineage(week_returns(spark, folder).withColumn("ret", F.col("sret")))
    rules = A.rule_totals(P.network_grid(panel), ["window", "momentum", "threshold", "hold"], [])
    return A.chain_audit(rules).gates


def pass_audit(found, minimum_score):
    """Each hypothesis is a family whose rules are its parameters, bar lengths and symbols."""
    rules = found.withColumn("direction", F.coalesce("direction", F.lit(0)))
    parts = ["hypothesis_id", "timeframe", "symbol", "lookback", "threshold", "direction"]
    totals = A.rule_totals(rules.fillna(0.0, ["threshold"]).fillna(0, ["lookback"]), parts, ["symbol", "hypothesis_id"])
    return A.family_audit(totals, "hypothesis_id", minimum_score=minimum_score, digits=9)


@query("hypothesis_pass_one_audit")
def hypothesis_pass_one_audit(spark, folder):
    """Gates of the first pass, which asks no positive score of its members."""
    return pass_audit(pass_one(spark, folder), None).gates


@query("hypothesis_pass_two_audit")
def hypothesis_pass_two_audit(spark, folder):
    return pass_audit(pass_two(spark, folder), 0.0).gates


@query("hypothesis_pass_three_audit")
def hypothesis_pass_three_audit(spark, folder):
    return pass_audit(pass_three(spark, folder), 0.0).gates


# --- studies of models -----------------------------------------------------------------------


def next_returns(spark, folder):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("trading_date")
    panel = src.settled_panel(spark, folder)
    return panel.select("symbol", "trading_date", F.lead("close_to_close_return").over(w).alias("target_return"))


shared(
    t_model_costs=f"""
SELECT trading_date, fold AS evaluation_fold, cost_bps,
       coalesce(sum(p * coalesce(y, 0) - abs(p) * 2 * cost_bps / 10000) / nullif(sum(abs(p)), 0), 0) AS portfolio_return
FROM (SELECT *, CASE WHEN abs(f) >= 0.0002 AND rk <= 4 THEN sign(f) ELSE 0 END AS p
      FROM (SELECT *, row_number() OVER (PARTITION BY trading_date ORDER BY abs(f) DESC, symbol) AS rk FROM (
        SELECT s.symbol, s.trading_date, s.fold, s.forecast AS f, n.y FROM t_model_forecast s
        JOIN (SELECT symbol, trading_date, lead(close_to_close_return) OVER (PARTITION BY symbol ORDER BY trading_date) AS y FROM t_panel) n
          USING (symbol, trading_date)))) CROSS JOIN {LEVELS} GROUP BY ALL
""",
    t_model_forecast="""
SELECT v.symbol, v.trading_date, v.fold, round(CAST(my + beta * (x - mx) / sx AS DOUBLE), 6) + 0.0 AS forecast
FROM (SELECT x.*, f.fold FROM t_ridge x JOIN t_folds4 f ON x.trading_date BETWEEN f.validation_start AND f.validation_end) v
JOIN (SELECT fold, any_value(mx) AS mx, any_value(sx) AS sx, any_value(my) AS my, sum((x - mx) / sx * (y - my)) / (sum(pow((x - mx) / sx, 2)) + 10) AS beta
      FROM (SELECT f.fold, x.x, x.y, avg(x.x) OVER w AS mx, stddev_pop(x.x) OVER w AS sx, avg(x.y) OVER w AS my
            FROM t_ridge x JOIN t_folds4 f ON x.trading_date <= f.train_end AND x.label_date <= f.train_end
            WHERE y IS NOT NULL AND x IS NOT NULL WINDOW w AS (PARTITION BY f.fold)) GROUP BY fold) b USING (fold)
WHERE x IS NOT NULL
""",
)


def ridge_audit(spark, folder):
    """Forecasts of the one-feature fit, traded on the next session's return."""
    forecasts = single_feature_ridge(spark, folder).withColumnRenamed("fold", "evaluation_fold")
    df = cut_lineage(forecasts.join(next_returns(spark, folder), ["symbol", "trading_date"]))
    return A.model_audit(df, {"ridge": "forecast"}, "ridge")


@query(
    "ridge_study_snapshots",
    snapshots_sql("(SELECT 1 AS portfolio, * FROM t_model_costs WHERE cost_bps = 1.0)", "(SELECT * FROM t_model_costs WHERE cost_bps = 1.0)", "t_model_costs"),
)
def ridge_study_snapshots(spark, folder):
    """A walk-forward fit traded by conviction and charged six cost levels, its entries held fixed."""
    return tidy(ridge_audit(spark, folder)[1].snapshots())


@query("learning_study")
def learning_study(spark, folder):
    """Ridge, trees and their mean at the study's cost, and the mean at every cost level."""
    predictions = cut_lineage(learning_ridge_and_trees(spark, folder).withColumnRenamed("fold", "evaluation_fold"))
    models = {m: f"{m}_prediction" for m in ("ridge", "nonlinear", "ensemble")}
    daily, audit = A.model_audit(predictions, models, "ensemble")
    own = A.extended_snapshot(daily, ["model"], "portfolio_return").withColumn("cost_bps", F.lit(1.0))
    stressed = audit.costs.withColumn("model", F.lit("ensemble at every cost"))
    return tidy(own.unionByName(stressed))
