"""Performance metrics, walk-forward summaries, stress tables and the ledger."""

from pyspark.sql import functions as F

from tidepanel.functions import frames
from tidepanel.functions.scalars import tidy
from tidepanel.operators import calendar as cal
from tidepanel.operators import evaluate as E
from tidepanel.operators import features as X
from tidepanel.operators import labels as L
from tidepanel.operators import signals as N
from tidepanel.registry.base import query, r, shared
from tidepanel.sources import tables as src

LOOKBACKS = N.SESSION_LOOKBACKS


def dense_panel(spark, folder):
    panel = src.settled_panel(spark, folder).select(
        "symbol", "trading_date", (F.col("close") / F.col("open") - 1.0).alias("session_return")
    )
    return cal.densify(panel)


def grid(spark, folder, bps=1.0):
    return N.session_grid_returns(dense_panel(spark, folder), bps)


def few(spark, folder, bps=1.0):
    """The two-session, threshold 0.5 rules: 12 full-length return series."""
    return N.session_grid_returns(dense_panel(spark, folder), bps, (2,), (0.5,))


shared(
    t_dense="""
SELECT u.symbol, u.trading_date, u.cal, p.close / p.open - 1 AS sret
FROM t_union u LEFT JOIN t_panel p USING (symbol, trading_date)
""",
    t_score="SELECT symbol, trading_date, cal, sret, "
    + ", ".join(
        f"""CASE WHEN count(sret) OVER a{n} = {n} AND count(sret) OVER b{n} >= 20 THEN
        greatest(least(sum(sret) OVER a{n} / nullif(stddev_samp(sret) OVER b{n} * sqrt({n}.0), 0), 8), -8)
        END AS s{n}"""
        for n in LOOKBACKS
    )
    + " FROM t_dense WINDOW "
    + ", ".join(
        f"a{n} AS (PARTITION BY symbol ORDER BY cal ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), "
        f"b{n} AS (PARTITION BY symbol ORDER BY cal ROWS BETWEEN {max(20, 2 * n)} PRECEDING AND 1 PRECEDING)"
        for n in LOOKBACKS
    ),
    t_prior="SELECT symbol, trading_date, coalesce(sret, 0) AS target, lookback, observed FROM ("
    + " UNION ALL ".join(
        f"SELECT symbol, trading_date, sret, {n} AS lookback, lag(s{n}) OVER (PARTITION BY symbol ORDER BY cal) AS observed FROM t_score"
        for n in LOOKBACKS
    )
    + ")",
    t_grid="""
SELECT symbol, trading_date, family, lookback, threshold, position, position * target AS gross,
       abs(position) * 2 AS sides, CAST(position <> 0 AS INTEGER) AS entries,
       position * target - abs(position) * 2 * 1.0 / 10000 AS net,
       concat_ws('|', symbol, family, CAST(lookback AS VARCHAR), format('{:.1f}', threshold))
         AS strategy
FROM (SELECT *, CASE WHEN abs(observed) >= threshold THEN sign(side * observed) ELSE 0 END AS position
      FROM t_prior
      CROSS JOIN (VALUES ('session_momentum', 1), ('session_reversal', -1)) f(family, side)
      CROSS JOIN (VALUES (0.0::DOUBLE), (0.5), (1.0), (1.5)) h(threshold))
""",
    t_few="SELECT * FROM t_grid WHERE lookback = 2 AND threshold = 0.5",
    t_grid_fold="""
SELECT g.*, f.fold FROM t_grid g LEFT JOIN t_folds f
  ON g.trading_date BETWEEN f.validation_start AND f.validation_end
""",
)


def dd(source: str, keys: str, x: str, where: str = "true") -> str:
    """Sub-select adding a drawdown column."""
    return f"""(SELECT *, wealth / max(wealth) OVER (PARTITION BY {keys} ORDER BY trading_date
                 ROWS UNBOUNDED PRECEDING) - 1 AS drawdown
      FROM (SELECT *, product(1 + {x}) OVER (PARTITION BY {keys} ORDER BY trading_date
                 ROWS UNBOUNDED PRECEDING) AS wealth FROM {source} WHERE {where}))"""


def metric_sql(x: str, prefix: str = "", only: str = "true") -> str:
    f = f"FILTER ({only})"
    return f"""CAST(count({x}) {f} AS BIGINT) AS {prefix}sessions,
      {r(f'avg({x}) {f} * 252', f'{prefix}annualized_return')},
      {r(f'stddev_samp({x}) {f} * sqrt(252)', f'{prefix}annualized_volatility')},
      {r(f'avg({x}) {f} / nullif(stddev_samp({x}) {f}, 0) * sqrt(252)', f'{prefix}sharpe')},
      {r(f'min(drawdown) {f}', f'{prefix}maximum_drawdown')}"""


def sharpe_sql(x: str, f: str = "") -> str:
    return f"avg({x}) {f} / nullif(stddev_samp({x}) {f}, 0) * sqrt(252)"


@query(
    "flagship_fold_summary",
    f"""SELECT symbol, f.fold, CAST(count(ret) AS BIGINT) AS sessions,
        {r('avg(ret) * 252', 'annualized_return')},
        {r('stddev_samp(ret) * sqrt(252)', 'annualized_volatility')},
        {r(sharpe_sql('ret'), 'sharpe')}, {r('min(drawdown)', 'maximum_drawdown')},
        {r('avg(m20)', 'average_momentum_20s')}, {r('avg(v20)', 'average_volatility_20s')}
        FROM (SELECT *, wealth / max(wealth) OVER (PARTITION BY symbol, fold ORDER BY trading_date
                     ROWS UNBOUNDED PRECEDING) - 1 AS drawdown
              FROM (SELECT p.*, f.fold, product(1 + ret) OVER (PARTITION BY symbol, f.fold
                           ORDER BY trading_date ROWS UNBOUNDED PRECEDING) AS wealth
                    FROM (SELECT symbol, trading_date, close_to_close_return AS ret,
                                 exp(sum(lr) OVER w20) - 1 AS m20, stddev_samp(lr) OVER w20 AS v20
                          FROM t_in2 WINDOW w20 AS (PARTITION BY symbol ORDER BY trading_date
                                                    ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) p
                    JOIN t_folds f ON p.trading_date BETWEEN f.validation_start AND f.validation_end)) f
        GROUP BY symbol, f.fold""",
)
def flagship_fold_summary(spark, folder):
    """Scan, join, session bars, guarded windows, fold assignment, grouped metrics."""
    panel = src.settled_panel(spark, folder)
    lr = F.log1p("close_to_close_return")
    df = panel.select(
        "symbol", "trading_date", F.col("close_to_close_return").alias("ret"),
        F.expm1(X.R(20).sum(lr)).alias("m20"), X.R(20).std(lr).alias("v20"),
    )
    out = E.fold_metrics(
        L.fold_of_session(df), ["symbol"], "ret",
        F.avg("m20").alias("average_momentum_20s"), F.avg("v20").alias("average_volatility_20s"),
    )
    return tidy(out)


@query(
    "session_rule_grid",
    f"""SELECT strategy, {metric_sql('net')},
        CAST(sum(entries) AS BIGINT) AS active_sessions, {r('sum(gross)', 'gross_sum')}
        FROM {dd('t_grid', 'strategy', 'net')} GROUP BY strategy""",
)
def session_rule_grid(spark, folder):
    """All 64 rules per symbol over every session."""
    out = E.summarize(
        grid(spark, folder), ["strategy"], "net", "trading_date",
        F.sum("entries").alias("active_sessions"), F.sum("gross").alias("gross_sum"),
    )
    return tidy(out)


@query(
    "session_scores",
    "SELECT symbol, trading_date, "
    + ", ".join(r(f"s{n}", f"score_{n}") for n in LOOKBACKS)
    + " FROM t_score",
)
def session_scores(spark, folder):
    out = N.session_scores(dense_panel(spark, folder))
    return tidy(out.select("symbol", "trading_date", *[f"score_{n}" for n in LOOKBACKS]))


@query(
    "fold_and_pooled_metrics",
    f"""SELECT p.*, positive_folds, worst_fold_sharpe,
        CASE WHEN annualized_return > 0 AND positive_folds >= 2 THEN 'candidate'
             WHEN annualized_return > 0 OR positive_folds >= 2 THEN 'research_further'
             ELSE 'reject' END AS research_status,
        CASE WHEN sharpe >= 1.5 AND positive_folds >= 3 THEN 'A_promising'
             WHEN sharpe >= 0.75 AND positive_folds >= 2 THEN 'B_candidate'
             WHEN sharpe > 0 THEN 'C_exploratory_positive'
             ELSE 'D_exploratory_negative' END AS research_tier
        FROM (SELECT strategy, {metric_sql('net')},
                     {r('avg(sides)', 'average_daily_sides')}
              FROM {dd('t_grid_fold', 'strategy', 'net', 'fold IS NOT NULL')} GROUP BY strategy) p
        JOIN (SELECT strategy, CAST(count(*) FILTER (m > 0) AS BIGINT) AS positive_folds,
                     {r('min(s)', 'worst_fold_sharpe')}
              FROM (SELECT strategy, fold, avg(net) AS m, {sharpe_sql('net')} AS s FROM t_grid_fold
                    WHERE fold IS NOT NULL GROUP BY strategy, fold) GROUP BY strategy)
          USING (strategy)""",
)
def fold_and_pooled_metrics(spark, folder):
    df = L.fold_of_session(grid(spark, folder))
    out = E.fold_and_pooled(df, ["strategy"], "net", F.avg("sides").alias("average_daily_sides"))
    out = out.withColumns(
        {
            "research_status": E.candidate_status("annualized_return", "positive_folds"),
            "research_tier": E.research_tier("sharpe", "positive_folds"),
        }
    )
    return tidy(out)


@query(
    "cost_stress_grid",
    f"""SELECT strategy, cost_bps, {metric_sql('stressed')}
        FROM {dd('''(SELECT strategy, trading_date, c.cost_bps, gross - sides * c.cost_bps / 10000 AS stressed
                     FROM t_grid CROSS JOIN (VALUES (0.0::DOUBLE), (0.5), (1.0), (2.0), (3.5), (5.0)) c(cost_bps))''',
                 'strategy, cost_bps', 'stressed')}
        GROUP BY strategy, cost_bps""",
)
def cost_stress_grid(spark, folder):
    df = E.with_costs(grid(spark, folder).drop("net"), (0.0, 0.5, 1.0, 2.0, 3.5, 5.0))
    return tidy(E.summarize(df, ["strategy", "cost_bps"], "net"))


@query(
    "build_selection_summary",
    f"""SELECT strategy, symbol, family, {metric_sql('net', 'build_', "research_window = 'build'")},
        CAST(coalesce(sum(entries) FILTER (research_window = 'build'), 0) AS BIGINT) AS build_trades,
        {metric_sql('net', 'selection_', "research_window = 'selection'")},
        CAST(coalesce(sum(entries) FILTER (research_window = 'selection'), 0) AS BIGINT)
          AS selection_trades,
        {r(f'''least({sharpe_sql('net', "FILTER (research_window = 'build')")},
                     {sharpe_sql('net', "FILTER (research_window = 'selection')")})
               + 0.25 * (({sharpe_sql('net', "FILTER (research_window = 'build')")})
                         + ({sharpe_sql('net', "FILTER (research_window = 'selection')")})) / 2''',
           'robust_score')}
        FROM {dd("t_grid_window", 'strategy, research_window', 'net', "research_window <> 'test'")}
        GROUP BY strategy, symbol, family""",
)
def build_selection_summary(spark, folder):
    panel = dense_panel(spark, folder)
    df = N.session_grid_returns(panel, 1.0)
    df = df.join(L.research_windows(panel, "2000-06-01"), "trading_date")
    return tidy(E.window_metrics(df, ["strategy", "symbol", "family"], "net", "entries"))


shared(
    t_windows="""
SELECT trading_date, CASE WHEN trading_date >= DATE '2000-06-01' THEN 'test'
       WHEN n < floor(k * 0.7) THEN 'build' ELSE 'selection' END AS research_window
FROM t_cal, (SELECT count(*) AS k FROM t_cal WHERE trading_date < DATE '2000-06-01')
""",
    t_grid_window="SELECT * FROM t_grid JOIN t_windows USING (trading_date)",
    t_block4="SELECT trading_date, ntile(4) OVER (ORDER BY trading_date) AS block FROM t_cal",
    t_stability=f"""
SELECT strategy, symbol, family, lookback, threshold, {sharpe_sql('net')} AS full_sharpe,
       {', '.join(f"{sharpe_sql('net', f'FILTER (block = {i})')} AS fold_{i}_sharpe" for i in range(1, 5))}
FROM t_grid JOIN t_block4 USING (trading_date) GROUP BY ALL
""",
)
FOLD4 = [f"fold_{i}_sharpe" for i in range(1, 5)]


@query(
    "temporal_stability_audit",
    f"""SELECT strategy, {r('full_sharpe', 'full_sharpe')}, {', '.join(r(f, f) for f in FOLD4)},
        {' + '.join(f'CAST(coalesce({f} > 0, false) AS INTEGER)' for f in FOLD4)} AS positive_folds,
        {r(f"least({', '.join(FOLD4)})", 'worst_fold_sharpe')} FROM t_stability""",
)
def temporal_stability_audit(spark, folder):
    return tidy(E.stability_audit(grid(spark, folder), ["strategy"], "net"))


@query(
    "subperiod_table",
    f"""SELECT strategy, CAST(subperiod AS INTEGER) AS subperiod, min(trading_date) AS "start",
        max(trading_date) AS "end", {r('product(1 + net) - 1', 'total_return')},
        {r(f"coalesce({sharpe_sql('net')}, 0)", 'sharpe')}
        FROM (SELECT *, ntile(4) OVER (PARTITION BY strategy ORDER BY trading_date) AS subperiod
              FROM t_grid) GROUP BY strategy, subperiod""",
)
def subperiod_table(spark, folder):
    return tidy(E.subperiods(grid(spark, folder), ["strategy"], "net"))


@query(
    "best_days_removed",
    " UNION ALL ".join(
        f"""SELECT strategy, {k} AS best_days_removed,
        {r(f'product(1 + net) FILTER (rn > {k}) - 1', 'total_return')},
        {r(f"coalesce({sharpe_sql('net', f'FILTER (rn > {k})')}, 0)", 'sharpe')},
        {r(f'CASE WHEN sum(net) > 0 THEN coalesce(sum(net) FILTER (rn <= {k}), 0) / sum(net) END', 'share_of_net_sum_removed')}
        FROM (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY net DESC, trading_date) AS rn
              FROM t_grid) GROUP BY strategy"""
        for k in (0, 1, 3, 5, 10)
    ),
)
def best_days_removed(spark, folder):
    return tidy(E.best_days_removed(grid(spark, folder), ["strategy"], "net"))


@query(
    "performance_snapshot",
    f"""SELECT d.*, {', '.join(f'{r(f"win_{p}s", f"win_{p}s")}, positive_{p}s, {p}s' for p in E.PERIODS)}
        FROM (SELECT strategy, CAST(count(*) AS BIGINT) AS observations,
                     min(trading_date) AS "start", max(trading_date) AS "end",
                     {r('max_by(wealth, trading_date) - 1', 'total_return')},
                     {r('avg(net) * 252', 'annualized_return')},
                     {r('stddev_samp(net) * sqrt(252)', 'annualized_volatility')},
                     {r(sharpe_sql('net'), 'sharpe')}, {r('min(drawdown)', 'maximum_drawdown')},
                     {r('avg((net > 0)::INT)', 'win_days')},
                     CAST(count(*) FILTER (net > 0) AS BIGINT) AS positive_days
              FROM {dd('t_grid', 'strategy', 'net')} GROUP BY strategy) d
        {' '.join(f'''JOIN (SELECT strategy, avg((x > 0)::INT) AS win_{p}s,
                 CAST(count(*) FILTER (x > 0) AS BIGINT) AS positive_{p}s,
                 CAST(count(*) AS BIGINT) AS {p}s
          FROM (SELECT strategy, date_trunc('{p}', trading_date) AS k, product(1 + net) - 1 AS x
                FROM t_grid GROUP BY ALL) GROUP BY strategy) {p}_table USING (strategy)'''
                for p in E.PERIODS)}""",
)
def performance_snapshot(spark, folder):
    return tidy(E.performance_snapshot(grid(spark, folder), ["strategy"], "net"))


@query(
    "calendar_period_returns",
    " UNION ALL ".join(
        f"""SELECT strategy, '{p}' AS period_type,
        CAST(date_trunc('{p}', trading_date) AS DATE) AS period_start,
        {r('product(1 + net) - 1', 'period_return')} FROM t_grid GROUP BY ALL"""
        for p in E.PERIODS
    ),
)
def calendar_period_returns(spark, folder):
    return tidy(E.period_returns(grid(spark, folder), ["strategy"], "net"))


@query(
    "weekly_hit_rate",
    f"""SELECT strategy, CAST((max(k) - min(k)) / 7 + 1 AS BIGINT) AS weeks,
        CAST(count(*) FILTER (x > 0) AS BIGINT) AS positive_weeks,
        {r('count(*) FILTER (x > 0) / ((max(k) - min(k)) / 7 + 1)', 'win_weeks')}
        FROM (SELECT strategy, CAST(trading_date + CAST((12 - isodow(trading_date)) % 7 AS INTEGER) AS DATE) AS k,
                     product(1 + net) - 1 AS x FROM t_grid GROUP BY 1, 2) GROUP BY strategy""",
)
def weekly_hit_rate(spark, folder):
    return tidy(E.weekly_hits(grid(spark, folder), ["strategy"], "net"))


@query(
    "expected_shortfall",
    f"""SELECT symbol, {r('-avg(x) FILTER (x <= q)', 'expected_shortfall')}
        FROM (SELECT symbol, close_to_close_return AS x,
                     quantile_cont(close_to_close_return, 0.05) OVER (PARTITION BY symbol) AS q
              FROM t_panel) GROUP BY symbol""",
)
def expected_shortfall(spark, folder):
    return tidy(
        E.expected_shortfall(src.session_panel(spark, folder), ["symbol"], "close_to_close_return")
    )


@query("block_bootstrap_summary")
def block_bootstrap_summary(spark, folder):
    """Seeded draws of Spark's own hash: no SQL form; checked by distribution in the tests."""
    return tidy(E.block_bootstrap(grid(spark, folder), "strategy", "net"))


shared(
    t_ic="""
SELECT symbol, trading_date, m20 AS forecast, y, f.fold
FROM (SELECT symbol, trading_date, exp(sum(lr) OVER w20) - 1 AS m20, count(lr) OVER w20 AS n,
             ln(lead(close, 5) OVER w / close) AS y
      FROM t_in2 WINDOW w AS (PARTITION BY symbol ORDER BY trading_date),
      w20 AS (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) i
JOIN t_folds f ON i.trading_date BETWEEN f.validation_start AND f.validation_end
WHERE n >= 20 AND y IS NOT NULL
"""
)


def forecasts(spark, folder):
    panel = src.session_panel(spark, folder)
    df = panel.withColumn("forecast", F.expm1(X.R(20).sum(F.log1p("close_to_close_return"))))
    df = df.withColumn("y", F.log(F.lead("close", 5).over(frames.ordered("symbol", "trading_date")) / F.col("close")))
    return L.fold_of_session(df).filter("fold IS NOT NULL")


@query(
    "information_coefficients",
    f"""SELECT fold, symbol, CAST(count(*) AS BIGINT) AS observations,
        {r('corr(forecast, y)', 'pearson_ic')}, {r('corr(rf, ry)', 'spearman_ic')},
        {r('avg((sign(forecast) = sign(y))::INT)', 'directional_accuracy')}
        FROM (SELECT *, rank() OVER (PARTITION BY fold, symbol ORDER BY forecast)
                     + (count(*) OVER (PARTITION BY fold, symbol, forecast) - 1) / 2.0 AS rf,
                     rank() OVER (PARTITION BY fold, symbol ORDER BY y)
                     + (count(*) OVER (PARTITION BY fold, symbol, y) - 1) / 2.0 AS ry FROM t_ic)
        GROUP BY fold, symbol""",
)
def information_coefficients(spark, folder):
    return tidy(
        E.information_coefficients(forecasts(spark, folder), ["fold", "symbol"], "forecast", "y")
    )


@query(
    "probability_diagnostics",
    f"""SELECT symbol, CAST(count(*) AS BIGINT) AS observations, {r('avg(y)', 'base_rate')},
        {r('avg(p)', 'mean_probability')}, {r('avg((p - y) * (p - y))', 'brier_score')},
        {r('-avg(y * ln(p) + (1 - y) * ln(1 - p))', 'log_loss')}, {r('any_value(auc)', 'roc_auc')},
        {r('avg((CAST(p >= 0.55 AS INT) = y)::INT)', 'accuracy_at_55pct')}
        FROM (SELECT symbol, 1 / (1 + exp(-20 * forecast)) AS p, (y > 0)::INT AS y FROM t_ic)
        JOIN (SELECT a.symbol, sum(CASE WHEN a.forecast > b.forecast THEN 1.0
                       WHEN a.forecast = b.forecast THEN 0.5 ELSE 0 END) / count(*) AS auc
              FROM t_ic a JOIN t_ic b ON a.symbol = b.symbol AND a.y > 0 AND b.y <= 0
              GROUP BY a.symbol) USING (symbol) GROUP BY symbol""",
)
def probability_diagnostics(spark, folder):
    df = forecasts(spark, folder).withColumns(
        {
            "p": 1.0 / (1.0 + F.exp(-20.0 * F.col("forecast"))),
            "hit": F.when(F.col("y").isNotNull(), (F.col("y") > 0).cast("int")),
        }
    ).filter("forecast IS NOT NULL")
    return tidy(E.probability_diagnostics(df, ["symbol"], "p", "hit"))


@query(
    "audit_gates",
    f"""SELECT strategy, g.gate, g.passed FROM (
          SELECT strategy, unnest([{{'gate': 'positive_return', 'passed': a}},
                 {{'gate': 'positive_sharpe', 'passed': b}}, {{'gate': 'shallow_drawdown', 'passed': c}},
                 {{'gate': 'all_gates', 'passed': a AND b AND c}}]) AS g
          FROM (SELECT strategy, avg(net) * 252 > 0 AS a,
                       {sharpe_sql('net')} >= 0.5 AS b, min(drawdown) > -0.15 AS c
                FROM {dd('t_grid', 'strategy', 'net')} GROUP BY strategy))""",
)
def audit_gates(spark, folder):
    summary = E.summarize(grid(spark, folder), ["strategy"], "net")
    return E.gates(
        summary,
        {
            "positive_return": F.col("annualized_return") > 0,
            "positive_sharpe": F.col("sharpe") >= 0.5,
            "shallow_drawdown": F.col("maximum_drawdown") > -0.15,
        },
        ["strategy"],
    )


CAPITAL = 1_000_000.0


def ledger(spark, folder):
    return src.table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("strategy"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ticket0"),
        F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
        F.col("l_shipdate").cast("timestamp").alias("close_time"),
        (F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax")) / 1000.0).alias("pnl"),
        F.col("l_linestatus").alias("close_type"),
    )


shared(
    t_ledger="""
SELECT l_returnflag AS strategy, l_orderkey * 8 + l_linenumber AS ticket0, l_partkey AS p,
       l_suppkey AS s, CAST(l_shipdate AS DATE) AS day,
       l_extendedprice * (l_discount - l_tax) / 1000.0 AS pnl, l_linestatus AS close_type
FROM lineitem
""",
    t_ledger_daily="""
SELECT *, equity - high_water_mark AS drawdown_dollars, equity / high_water_mark - 1 AS drawdown_pct
FROM (SELECT *, max(equity) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS high_water_mark
      FROM (SELECT day, daily_pnl, 1000000.0 + sum(daily_pnl) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS equity
            FROM (SELECT d.day, coalesce(sum(pnl), 0) AS daily_pnl
                  FROM (SELECT CAST(unnest(generate_series((SELECT min(day) FROM t_ledger),
                               (SELECT max(day) FROM t_ledger), INTERVAL 1 DAY)) AS DATE) AS day) d
                  LEFT JOIN t_ledger l ON l.day = d.day GROUP BY d.day)))
""",
)


@query(
    "ledger_kpis",
    f"""SELECT coalesce(strategy, 'all') AS strategy, CAST(count(*) AS BIGINT) AS trades,
        {r('sum(pnl)', 'net_profit', 7)},
        {r('sum(pnl) FILTER (pnl > 0) / nullif(-sum(pnl) FILTER (pnl < 0), 0)', 'profit_factor')},
        {r('avg((pnl > 0)::INT)', 'win_rate')}, {r('avg(pnl)', 'average_trade')},
        {r('sum(pnl) / (SELECT sum(pnl) FROM t_ledger)', 'contribution_share')}
        FROM t_ledger GROUP BY ROLLUP (strategy)""",
)
def ledger_kpis(spark, folder):
    return tidy(E.ledger_kpis(ledger(spark, folder)), net_profit=7)


@query(
    "ledger_daily_equity",
    f"""SELECT day, {r('daily_pnl', 'daily_pnl', 7)}, {r('equity', 'equity', 7)},
        {r('high_water_mark', 'high_water_mark', 7)}, {r('drawdown_dollars', 'drawdown_dollars', 7)},
        {r('drawdown_pct', 'drawdown_pct')} FROM t_ledger_daily""",
)
def ledger_daily_equity(spark, folder):
    out = E.ledger_daily(ledger(spark, folder), CAPITAL)
    return tidy(out, 7, drawdown_pct=6)


@query(
    "ledger_sharpes",
    f"""SELECT {r(sharpe_sql('daily_pnl / 1000000'), 'calendar_sharpe')},
        {r(sharpe_sql('daily_pnl / 1000000', 'FILTER (isodow(day) < 6)'), 'weekday_sharpe')},
        {r('min(drawdown_pct)', 'worst_drawdown_pct')} FROM t_ledger_daily""",
)
def ledger_sharpes(spark, folder):
    return tidy(E.ledger_sharpes(E.ledger_daily(ledger(spark, folder), CAPITAL), CAPITAL))


@query(
    "trade_sequence_drawdown",
    f"""SELECT {r('min(e - peak)', 'trade_max_drawdown', 7)}
        FROM (SELECT e, max(e) OVER (ORDER BY day, strategy, ticket0, p, s ROWS UNBOUNDED PRECEDING) AS peak
                     , day FROM (SELECT *, 1000000 + sum(pnl) OVER (ORDER BY day, strategy, ticket0, p, s
                                            ROWS UNBOUNDED PRECEDING) AS e FROM t_ledger))""",
)
def trade_sequence_drawdown(spark, folder):
    trades = ledger(spark, folder).withColumn("ticket", F.struct("ticket0", "p", "s"))
    return tidy(E.trade_drawdown(trades, 20_000, "ticket0"), 7)


@query(
    "ledger_monthly",
    f"""SELECT CAST(date_trunc('month', day) AS DATE) AS month, {r('sum(daily_pnl)', 'monthly_pnl', 7)},
        CASE WHEN sum(daily_pnl) >= 0 THEN 'Positive' ELSE 'Negative' END AS sign
        FROM t_ledger_daily GROUP BY 1""",
)
def ledger_monthly(spark, folder):
    return tidy(E.ledger_monthly(E.ledger_daily(ledger(spark, folder), CAPITAL)), 7)


@query(
    "ledger_histogram",
    f"""SELECT CAST(bin AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS trade_count,
        {r('any_value(lo) + bin * any_value(step)', 'bin_start')},
        {r('any_value(lo) + (bin + 1) * any_value(step)', 'bin_end')}
        FROM (SELECT *, least(floor((greatest(least(pnl, hi), lo) - lo) / step), 23) AS bin
              FROM (SELECT pnl, lo, hi, (hi - lo) / 24 AS step FROM t_ledger,
                    (SELECT quantile_cont(pnl, 0.01) AS lo, quantile_cont(pnl, 0.99) AS hi FROM t_ledger)))
        GROUP BY bin""",
)
def ledger_histogram(spark, folder):
    return tidy(E.histogram(ledger(spark, folder), "pnl"))


@query(
    "close_type_counts",
    f"""SELECT close_type, strategy, CAST(count(*) AS BIGINT) AS trades,
        {r('sum(pnl)', 'net_profit', 7)} FROM t_ledger GROUP BY close_type, strategy""",
)
def close_type_counts(spark, folder):
    out = ledger(spark, folder).groupBy("close_type", "strategy").agg(
        F.count(F.lit(1)).alias("trades"), F.sum("pnl").alias("net_profit")
    )
    return tidy(out, 7)


@query(
    "family_crosstab",
    """SELECT symbol, CAST(count(*) FILTER (family = 'session_momentum' AND full_sharpe > 0) AS BIGINT)
         AS session_momentum, CAST(count(*) FILTER (family = 'session_reversal' AND full_sharpe > 0)
         AS BIGINT) AS session_reversal FROM t_stability GROUP BY symbol""",
)
def family_crosstab(spark, folder):
    audit = E.stability_audit(grid(spark, folder), ["strategy", "symbol", "family"], "net")
    return (
        audit.groupBy("symbol")
        .pivot("family", list(N.SESSION_FAMILIES))
        .agg(F.count_if(F.col("full_sharpe") > 0))
    )


@query(
    "coverage_profile",
    f"""SELECT symbol, min(trading_date) AS first_session, max(trading_date) AS last_session,
        CAST(count(*) AS BIGINT) AS sessions, {r('median(n)', 'median_minutes')},
        CAST(sum(g) AS BIGINT) AS missing_minutes
        FROM (SELECT symbol, trading_date, count(*) AS n, sum(missing_minutes_before) AS g
              FROM t_returns GROUP BY ALL) GROUP BY symbol""",
)
def coverage_profile(spark, folder):
    sessions = src.minute_returns(spark, folder).groupBy("symbol", "trading_date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("missing_minutes_before").alias("g")
    )
    return tidy(
        sessions.groupBy("symbol").agg(
            F.min("trading_date").alias("first_session"),
            F.max("trading_date").alias("last_session"),
            F.count(F.lit(1)).alias("sessions"),
            F.percentile("n", F.lit(0.5)).alias("median_minutes"),
            F.sum("g").alias("missing_minutes"),
        )
    )


@query(
    "describe_returns",
    f"""SELECT symbol, CAST(count(x) AS BIGINT) AS observations, {r('avg(x)', 'mean')},
        {r('stddev_samp(x)', 'deviation')}, {r('min(x)', 'minimum')}, {r('max(x)', 'maximum')},
        {', '.join(r(f'quantile_cont(x, {int(n[1:]) / 100})', n) for n in ('p01', 'p05', 'p25', 'p50', 'p75', 'p95', 'p99'))},
        {r('stddev_samp(x) * sqrt(252)', 'annualized_volatility')}
        FROM (SELECT symbol, close_to_close_return AS x FROM t_panel) GROUP BY symbol""",
)
def describe_returns(spark, folder):
    return tidy(E.describe(src.session_panel(spark, folder), ["symbol"], "close_to_close_return"))


AUDITED = ("log_return_1s", "range_fraction", "log_volume", "true_range", "return_before")
AUDIT_SQL = {"log_return_1s": "lr", "range_fraction": "rf", "log_volume": "lv", "true_range": "tr",
             "return_before": "lr1"}
shared(
    t_long="WITH p AS (SELECT *, ntile(2) OVER (ORDER BY trading_date) AS half FROM t_cal) "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, {e} AS x, rn, half FROM t_in2 JOIN p USING (trading_date)"
        for n, e in AUDIT_SQL.items()
    )
)


@query(
    "feature_quality_profile",
    f"""SELECT f.feature, {r('100.0 * avg((x IS NULL)::INT)', 'missing_pct')},
        {r('100.0 * avg((x IS NULL)::INT) FILTER (rn > 120)', 'missing_after_warmup_pct')},
        CAST(count(DISTINCT x) AS BIGINT) AS distinct_values, {r('any_value(m)', 'median')},
        {r('any_value(a)', 'p01')}, {r('any_value(b)', 'p99')},
        {r('100.0 * avg((abs(x - m) > 5 * w)::INT)', 'robust_outlier_pct')}
        FROM t_long f JOIN (SELECT feature, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.01) AS a,
               quantile_cont(x, 0.99) AS b, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS w
               FROM t_long GROUP BY feature) USING (feature) GROUP BY f.feature""",
)
def feature_quality_profile(spark, folder):
    return tidy(E.feature_quality(X.with_inputs(src.session_panel(spark, folder)), list(AUDITED)))


@query(
    "feature_drift_profile",
    f"""SELECT feature, {r('a', 'early_median')}, {r('b', 'late_median')},
        {r('(b - a) / nullif(w, 0)', 'median_shift_iqr')}
        FROM (SELECT feature, quantile_cont(x, 0.5) FILTER (half = 1) AS a,
                     quantile_cont(x, 0.5) FILTER (half = 2) AS b,
                     quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS w
              FROM t_long GROUP BY feature)""",
)
def feature_drift_profile(spark, folder):
    return tidy(E.feature_drift(X.with_inputs(src.session_panel(spark, folder)), list(AUDITED)))
