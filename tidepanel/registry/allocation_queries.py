"""Return accounting, allocation and cross-asset structure."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions import frames
from tidepanel.functions.scalars import tidy
from tidepanel.operators import accounting as B
from tidepanel.operators import calendar as cal
from tidepanel.operators import network as G
from tidepanel.registry.base import query, r, shared
from tidepanel.registry.evaluate_queries import few, grid, sharpe_sql  # noqa: F401
from tidepanel.session import cut_lineage
from tidepanel.sources import tables as src

shared(
    t_week="""
SELECT symbol, trading_date, first(price ORDER BY k1, k2, price) AS open,
       last(price ORDER BY k1, k2, price) AS close
FROM (SELECT * REPLACE (CAST(date_trunc('week', trading_date) AS DATE) AS trading_date) FROM t_quotes)
GROUP BY symbol, trading_date
""",
    t_wcal="""
SELECT trading_date, CAST(row_number() OVER (ORDER BY trading_date) AS INTEGER) AS cal
FROM (SELECT DISTINCT trading_date FROM t_week)
""",
    t_wret="""
SELECT s.symbol, c.trading_date, c.cal,
       w.close / lag(w.close) OVER (PARTITION BY s.symbol ORDER BY c.cal) - 1 AS ret,
       w.close / w.open - 1 AS sret
FROM (SELECT DISTINCT symbol FROM t_week) s CROSS JOIN t_wcal c
LEFT JOIN t_week w ON w.symbol = s.symbol AND w.trading_date = c.trading_date
""",
)


def week_returns(spark, folder):
    df = cal.densify(cut_lineage(src.week_panel(spark, folder)))
    w = frames.ordered("symbol", "cal")
    return df.select(
        "symbol", "trading_date", "cal",
        (F.col("close") / F.lag("close").over(w) - 1.0).alias("ret"),
        (F.col("close") / F.col("open") - 1.0).alias("sret"),
    )


shared(
    t_ww="""
SELECT strategy, symbol, trading_date, cal, ret, side * (rk - 0.5) AS weight
FROM (SELECT *, (rank() OVER (PARTITION BY trading_date ORDER BY ret)
             + (count(*) OVER (PARTITION BY trading_date, ret) - 1) / 2.0)
             / count(*) OVER (PARTITION BY trading_date) AS rk FROM t_wret WHERE ret IS NOT NULL)
CROSS JOIN (VALUES ('fade', -1.0), ('follow', 1.0)) v(strategy, side)
"""
)


@query(
    "net_return_accounting",
    f"""SELECT strategy, trading_date, {r('sum(held * ret)', 'gross')},
        {r('coalesce(sum(abs(held - prior)), 0) / 2', 'turnover')},
        {r('sum(abs(held))', 'gross_exposure')}, {r('sum(held)', 'net_exposure')},
        {r('coalesce(sum(abs(held - prior)), 0) / 2 * 3.5 / 10000', 'cost', 9)},
        {r('sum(held * ret) - coalesce(sum(abs(held - prior)), 0) / 2 * 3.5 / 10000', 'net')}
        FROM (SELECT *, lag(held) OVER (PARTITION BY strategy, symbol ORDER BY cal) AS prior
              FROM (SELECT *, coalesce(lag(weight) OVER (PARTITION BY strategy, symbol ORDER BY cal), 0)
                              AS held FROM t_ww))
        GROUP BY strategy, trading_date""",
)
def net_return_accounting(spark, folder):
    rets = week_returns(spark, folder).filter("ret IS NOT NULL")
    sides = F.array(
        F.struct(F.lit("fade").alias("strategy"), F.lit(-1.0).alias("side")),
        F.struct(F.lit("follow").alias("strategy"), F.lit(1.0).alias("side")),
    )
    weights = rets.withColumn("rk", frames.pct_rank("ret", "trading_date")).select(
        "trading_date", "symbol", "rk", F.inline(sides)
    )
    weights = weights.withColumn("weight", F.col("side") * (F.col("rk") - 0.5))
    return tidy(B.net_returns(rets, weights, ["strategy"], 3.5), cost=9)


shared(
    t_wscore="SELECT symbol, trading_date, cal, -ret AS score FROM t_wret WHERE ret IS NOT NULL",
    t_wcov="""
SELECT trading_date, i, j, (sxy / w - sx / w * sy / w) * w * w / (w * w - ww)
       * CASE WHEN i = j THEN 1 ELSE 0.8 END AS c
FROM (SELECT k.trading_date, a.symbol AS i, b.symbol AS j, sum(q) AS w, sum(q * q) AS ww,
             sum(q * a.ret) AS sx, sum(q * b.ret) AS sy, sum(q * a.ret * b.ret) AS sxy
      FROM t_wcal k JOIN (SELECT *, 1 AS one FROM t_wret WHERE ret IS NOT NULL) a
        ON a.cal BETWEEN k.cal - 59 AND k.cal
      JOIN t_wret b ON b.cal = a.cal AND b.ret IS NOT NULL,
      LATERAL (SELECT pow(0.5, (k.cal - a.cal) / 20.0) AS q)
      WHERE k.cal >= 60 GROUP BY ALL)
""",
    t_wbook="""
SELECT trading_date, symbol, CASE WHEN lt > 0 AND st > 0 THEN
         (1 + net) / 2 * up / lt - (1 - net) / 2 * dn / st ELSE 0 END AS book
FROM (SELECT *, greatest(least((lt - st) / nullif(lt + st, 0), 0.25), -0.25) AS net
      FROM (SELECT *, sum(up) OVER (PARTITION BY trading_date) AS lt,
                   sum(dn) OVER (PARTITION BY trading_date) AS st
            FROM (SELECT *, greatest(x, 0) AS up, -least(x, 0) AS dn
                  FROM (SELECT *, CASE WHEN np = 0 OR nn = 0
                               THEN rs - median(rs) OVER (PARTITION BY trading_date) ELSE rs END AS x
                        FROM (SELECT *, count(*) FILTER (rs > 0) OVER (PARTITION BY trading_date) AS np,
                                     count(*) FILTER (rs < 0) OVER (PARTITION BY trading_date) AS nn
                              FROM (SELECT s.trading_date, s.symbol,
                                           score / greatest(sqrt(c), 1e-8) AS rs
                                    FROM t_wscore s JOIN t_wcov v ON v.trading_date = s.trading_date
                                      AND v.i = s.symbol AND v.j = s.symbol))))))
""",
    t_wneutral="""
SELECT trading_date, symbol, 0.5 * up / lt - 0.5 * dn / st AS book
FROM (SELECT *, sum(up) OVER (PARTITION BY trading_date) AS lt,
             sum(dn) OVER (PARTITION BY trading_date) AS st
      FROM (SELECT *, greatest(x, 0) AS up, -least(x, 0) AS dn
            FROM (SELECT s.trading_date, s.symbol,
                         score - median(score) OVER (PARTITION BY s.trading_date) AS x
                  FROM t_wscore s WHERE s.cal >= 60)))
WHERE lt > 0 AND st > 0
""",
)


def _weights_sql(book: str, capped: bool) -> str:
    levered = f"""SELECT b.trading_date, b.symbol, b.book * CASE WHEN s.sd > 0
        THEN least(0.10 / s.sd, 2.0) ELSE 0 END AS w
      FROM {book} b JOIN (SELECT x.trading_date, sqrt(sum(x.book * y.book * c) * 252) AS sd
        FROM {book} x JOIN {book} y ON x.trading_date = y.trading_date
        JOIN t_wcov v ON v.trading_date = x.trading_date AND v.i = x.symbol AND v.j = y.symbol
        GROUP BY x.trading_date) s USING (trading_date)"""
    if not capped:
        return f"SELECT trading_date, symbol, {r('w', 'weight')} FROM ({levered})"
    return f"""SELECT trading_date, symbol, {r('''CASE WHEN abs(net) > 0.25
          THEN greatest(w, 0) / up * (g + sign(net) * 0.25) / 2 - -least(w, 0) / dn * (g - sign(net) * 0.25) / 2
          ELSE w END''', 'weight')}
        FROM (SELECT *, sum(w) OVER d AS net, sum(abs(w)) OVER d AS g, sum(greatest(w, 0)) OVER d AS up,
                     sum(-least(w, 0)) OVER d AS dn FROM ({levered}) WINDOW d AS (PARTITION BY trading_date))"""


def _history(spark, folder):
    rets = week_returns(spark, folder)
    return rets, B.history_variance(B.trailing_history(rets))


@query("covariance_target_weights", _weights_sql("t_wbook", True))
def covariance_target_weights(spark, folder):
    rets, history = _history(spark, folder)
    scores = rets.select("trading_date", "symbol", (-F.col("ret")).alias("score"))
    return tidy(B.covariance_target_weights(scores, history.drop("cal"), []))


@query("market_neutral_weights", _weights_sql("t_wneutral", False))
def market_neutral_weights(spark, folder):
    rets, history = _history(spark, folder)
    scores = rets.select("trading_date", "symbol", (-F.col("ret")).alias("score"))
    return tidy(B.covariance_target_weights(scores, history.drop("cal"), [], neutral=True))


@query(
    "family_mean_sleeves",
    f"""SELECT family, trading_date, {r('avg(net)', 'net')} FROM t_grid GROUP BY family, trading_date""",
)
def family_mean_sleeves(spark, folder):
    return tidy(B.mean_sleeve(grid(spark, folder), ["family"]))


@query(
    "causal_volatility_balance",
    f"""SELECT trading_date, {r('equal_weight', 'equal_weight', 9)},
        {r('balanced * CASE WHEN n >= 20 AND sd > 0 THEN greatest(least(0.1 / (sd * sqrt(252)), 2), 0.25) ELSE 1 END',
           'causal_volatility_balanced', 9)}
        FROM (SELECT *, count(balanced) OVER w AS n, stddev_samp(balanced) OVER w AS sd
              FROM (SELECT trading_date, avg(net) AS equal_weight, avg(net * scale) AS balanced
                    FROM (SELECT *, CASE WHEN count(net) OVER w >= 20 AND stddev_samp(net) OVER w > 0
                                 THEN greatest(least(0.1 / (stddev_samp(net) OVER w * sqrt(252)), 2), 0.25)
                                 ELSE 1 END AS scale FROM t_grid
                          WINDOW w AS (PARTITION BY strategy ORDER BY trading_date
                                       ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
                    GROUP BY trading_date)
              WINDOW w AS (ORDER BY trading_date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))""",
)
def causal_volatility_balance(spark, folder):
    return tidy(B.causal_volatility_balance(grid(spark, folder), "strategy"), 9)


shared(
    t_two="""
SELECT trading_date, avg(net) FILTER (family = 'session_momentum') AS a,
       avg(net) FILTER (family = 'session_reversal') AS b
FROM t_grid GROUP BY trading_date
"""
)


@query(
    "two_sleeve_mix",
    " UNION ALL ".join(
        f"""SELECT trading_date, {n} AS lookback, {r('coalesce(ia / (coalesce(ia, 0) + coalesce(ib, 0)), 0.5) * a + coalesce(ib / (coalesce(ia, 0) + coalesce(ib, 0)), 0.5) * b', 'mixed')}
        FROM (SELECT *, CASE WHEN count(a) OVER w >= {max(10, n // 3)} THEN 1 / nullif(stddev_samp(a) OVER w, 0) END AS ia,
                     CASE WHEN count(b) OVER w >= {max(10, n // 3)} THEN 1 / nullif(stddev_samp(b) OVER w, 0) END AS ib
              FROM t_two WINDOW w AS (ORDER BY trading_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING))"""
        for n in (20, 40, 60, 90, 120)
    ),
)
def two_sleeve_mix(spark, folder):
    two = grid(spark, folder).groupBy("trading_date").agg(
        F.avg(F.when(F.col("family") == "session_momentum", F.col("net"))).alias("a"),
        F.avg(F.when(F.col("family") == "session_reversal", F.col("net"))).alias("b"),
    )
    return tidy(B.two_sleeve_mix(two, "a", "b"))


@query(
    "static_allocations",
    f"""SELECT trading_date, {r('sum(net * e)', 'equal_weight', 9)}, {r('sum(net * v)', 'inverse_volatility', 9)}
        FROM t_grid JOIN (SELECT strategy, 1.0 / count(*) OVER () AS e, (1 / nullif(s, 0)) / sum(1 / nullif(s, 0)) OVER () AS v
                         FROM (SELECT strategy, stddev_samp(net) AS s FROM t_grid
                               WHERE trading_date < DATE '1999-01-01' GROUP BY strategy))
        USING (strategy) GROUP BY trading_date""",
)
def static_allocations(spark, folder):
    f = cut_lineage(grid(spark, folder).select("strategy", "trading_date", "net"))
    weights = B.static_weights(f, "strategy", "net", F.col("trading_date") < F.lit("1999-01-01"))
    return tidy(
        B.weighted_portfolio(f, weights, "strategy", "net", ("equal_weight", "inverse_volatility")), 9
    )


@query(
    "expectancy_top_k_portfolio",
    f"""SELECT trading_date, {r('avg(net) FILTER (k <= 5)', 'top_5')}, {r('sum(net * e)', 'expectancy')}
        FROM t_grid JOIN (SELECT strategy, row_number() OVER (ORDER BY round(s, 9) DESC NULLS LAST, strategy) AS k,
                                greatest(m, 0) / nullif(sum(greatest(m, 0)) OVER (), 0) AS e
                         FROM (SELECT strategy, avg(net) AS m, {sharpe_sql('net')} AS s FROM t_grid
                               WHERE trading_date < DATE '1999-01-01' GROUP BY strategy))
        USING (strategy) GROUP BY trading_date""",
)
def expectancy_top_k_portfolio(spark, folder):
    from tidepanel.operators.evaluate import sharpe

    f = cut_lineage(grid(spark, folder).select("strategy", "trading_date", "net"))
    early = F.when(F.col("trading_date") < F.lit("1999-01-01"), F.col("net"))
    fitted = f.groupBy("strategy").agg(F.avg(early).alias("m"), sharpe(early).alias("s"))
    up = F.greatest("m", F.lit(0.0))
    total = F.sum(up).over(Window.partitionBy())
    weights = fitted.select(
        "strategy",
        F.row_number().over(Window.orderBy(F.round("s", 9).desc_nulls_last(), "strategy")).alias("k"),
        (up / F.when(total != 0, total)).alias("e"),
    )
    return tidy(
        f.join(weights, "strategy").groupBy("trading_date").agg(
            F.avg(F.when(F.col("k") <= 5, F.col("net"))).alias("top_5"),
            F.sum(F.col("net") * F.col("e")).alias("expectancy"),
        )
    )


shared(
    t_vol="""
SELECT symbol, stddev_samp(close_to_close_return) * pow(length(symbol) - 4, 2) AS vol
FROM t_panel GROUP BY symbol
"""
)


def volatilities(spark, folder):
    return (
        src.session_panel(spark, folder)
        .groupBy("symbol")
        .agg(F.stddev_samp("close_to_close_return").alias("s"))
        .select("symbol", (F.col("s") * F.pow(F.length("symbol") - 4, F.lit(2))).alias("vol"))
    )


def _unrolled_fill(cap: float, steps: int) -> str:
    sql = "SELECT symbol, 1 / vol AS s, NULL::DOUBLE AS w FROM t_vol"
    for _ in range(steps):
        sql = f"""SELECT symbol, s, CASE WHEN w IS NULL AND p > {cap} THEN {cap} ELSE w END AS w, p
            FROM (SELECT symbol, s, w, s / sum(s) FILTER (w IS NULL) OVER ()
                         * (1 - coalesce(sum(w) OVER (), 0)) AS p FROM ({sql}))"""
    return f"SELECT symbol, {r('coalesce(w, p)', 'weight')} FROM ({sql})"


@query("water_filled_weights", _unrolled_fill(0.25, 6))
def water_filled_weights(spark, folder):
    return tidy(
        B.water_fill(volatilities(spark, folder), [], "vol", 0.25).select("symbol", "weight")
    )


def _unrolled_excess(cap: float, steps: int) -> str:
    sql = "SELECT symbol, (1 / vol) / sum(1 / vol) OVER () AS w FROM t_vol"
    for _ in range(steps):
        sql = f"""SELECT symbol, CASE WHEN w > {cap} THEN {cap}
              WHEN u > 0 THEN w + e * w / u ELSE w END AS w
            FROM (SELECT symbol, w, coalesce(sum(w - {cap}) FILTER (w > {cap}) OVER (), 0) AS e,
                         coalesce(sum(w) FILTER (w <= {cap}) OVER (), 0) AS u FROM ({sql}))"""
    return f"SELECT symbol, {r('w / sum(w) OVER ()', 'weight')} FROM ({sql})"


@query("excess_redistributed_weights", _unrolled_excess(0.25, 6))
def excess_redistributed_weights(spark, folder):
    df = volatilities(spark, folder).withColumn("portfolio", F.lit("all"))
    return tidy(B.redistribute_excess(df, ["portfolio"], "vol", 0.25).select("symbol", "weight"))


@query(
    "leveraged_portfolio",
    f"""SELECT trading_date, {r('net * l', 'portfolio_return', 9)}
        FROM (SELECT trading_date, avg(net) AS net FROM t_grid GROUP BY trading_date),
             (SELECT least(0.10 / (stddev_samp(net) * sqrt(252)), 2.0) AS l
              FROM (SELECT trading_date, avg(net) AS net FROM t_grid GROUP BY trading_date)
              WHERE trading_date < DATE '1999-01-01')""",
)
def leveraged_portfolio(spark, folder):
    daily = cut_lineage(grid(spark, folder).groupBy("trading_date").agg(F.avg("net").alias("net")))
    early = F.when(F.col("trading_date") < F.lit("1999-01-01"), F.col("net"))
    lever = daily.agg(
        B.leverage_for(F.stddev_samp(early) * 252.0**0.5).alias("l")
    ).scalar()
    return tidy(daily.select("trading_date", (F.col("net") * lever).alias("portfolio_return")), 9)


@query(
    "dollar_pnl",
    f"""SELECT symbol, trading_date, {r('change', 'change')}, {r('change * multiplier * 3', 'dollar_pnl')}
        FROM (SELECT symbol, trading_date,
                     close - lag(close) OVER (PARTITION BY symbol ORDER BY trading_date) AS change
              FROM t_panel)
        LEFT JOIN (SELECT p_type AS symbol, CAST(max(p_size) AS DOUBLE) AS multiplier FROM part
                   GROUP BY p_type) USING (symbol)""",
)
def dollar_pnl(spark, folder):
    master = (
        src.table(spark, folder, "part")
        .groupBy(F.col("p_type").alias("symbol"))
        .agg(F.max("p_size").cast("double").alias("multiplier"))
    )
    out = B.dollar_change(src.session_panel(spark, folder), master, F.lit(3.0))
    return tidy(out.select("symbol", "trading_date", "change", "dollar_pnl"))


@query(
    "active_leg_portfolio",
    f"""SELECT trading_date, {r('coalesce(sum(p * x - abs(p) * 7.0 / 10000) / nullif(sum(abs(p)), 0), 0)', 'net')},
        {r('sum(abs(p))', 'active_legs')}
        FROM (SELECT trading_date, sret AS x, CASE WHEN abs(sret) > 0.02 THEN -sign(sret) ELSE 0 END AS p
              FROM t_wret) GROUP BY trading_date""",
)
def active_leg_portfolio(spark, folder):
    legs = week_returns(spark, folder).select(
        "trading_date", F.col("sret").alias("ret"),
        F.when(F.abs("sret") > 0.02, -F.signum("sret")).otherwise(0.0).alias("position"),
    )
    return tidy(B.active_leg_portfolio(legs, [], 3.5))


@query(
    "complementary_portfolios",
    f"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY trading_date) AS cal FROM t_few),
       v AS (SELECT *, CASE WHEN count(gross) OVER w >= 20 THEN stddev_samp(gross) OVER w END AS sd FROM s
             WINDOW w AS (PARTITION BY strategy ORDER BY cal ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
       p AS (SELECT a.strategy AS i, b.strategy AS j, a.cal,
                    covar_samp(a.gross, b.gross) OVER (PARTITION BY a.strategy, b.strategy ORDER BY a.cal
                      ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS c
             FROM s a JOIN s b ON a.cal = b.cal),
       q AS (SELECT p.i, p.cal, 1 + avg(abs(c / (greatest(x.sd, 1e-8) * greatest(y.sd, 1e-8))
                                       - CASE WHEN p.i = p.j THEN 1 ELSE 0 END)) AS penalty
             FROM p JOIN v x ON x.strategy = p.i AND x.cal = p.cal JOIN v y ON y.strategy = p.j AND y.cal = p.cal
             WHERE x.sd IS NOT NULL GROUP BY p.i, p.cal),
       w0 AS (SELECT v.*, 1 / greatest(sd, 1e-8) / penalty AS raw FROM v LEFT JOIN q ON q.i = v.strategy AND q.cal = v.cal),
       w1 AS (SELECT *, coalesce(1 / nullif(sd, 0) / sum(1 / nullif(sd, 0)) OVER d, 1 / 12.0) AS wi,
                     least(raw / sum(raw) OVER d, 0.35) AS capped FROM w0 WINDOW d AS (PARTITION BY cal)),
       w2 AS (SELECT *, CASE WHEN sd IS NULL THEN 1 / 12.0 ELSE capped / sum(capped) OVER (PARTITION BY cal) END AS wc FROM w1),
       l AS (SELECT strategy, trading_date, cal, gross, sides, 'equal_weight' AS allocation, 1 / 12.0 AS w FROM w2
             UNION ALL SELECT strategy, trading_date, cal, gross, sides, 'causal_inverse_volatility', wi FROM w2
             UNION ALL SELECT strategy, trading_date, cal, gross, sides, 'causal_correlation_adjusted', wc FROM w2)
       SELECT allocation, trading_date, {r('sum(gross * w)', 'gross')},
              {r('sum(sides * w) + sum(abs(w - pw))', 'turnover')}
       FROM (SELECT *, coalesce(lag(w) OVER (PARTITION BY allocation, strategy ORDER BY cal), 0) AS pw FROM l)
       GROUP BY allocation, trading_date""",
)
def complementary_portfolios(spark, folder):
    f = cut_lineage(few(spark, folder).select("strategy", "trading_date", "gross", "sides"))
    weights = G.complementary_weights(f, "strategy", "gross")
    return tidy(G.complementary_portfolios(f, weights, "strategy"))


@query(
    "pairwise_correlation",
    f"""SELECT a.symbol AS member_a, b.symbol AS member_b,
        CAST(count(*) FILTER (a.x IS NOT NULL AND b.x IS NOT NULL) AS BIGINT) AS observations,
        {r('corr(a.x, b.x)', 'correlation')}
        FROM (SELECT symbol, trading_date, close_to_close_return AS x FROM t_panel) a
        JOIN (SELECT symbol, trading_date, close_to_close_return AS x FROM t_panel) b
          ON a.trading_date = b.trading_date AND a.symbol < b.symbol
        GROUP BY a.symbol, b.symbol""",
)
def pairwise_correlation(spark, folder):
    panel = src.settled_panel(spark, folder)
    return tidy(
        G.pairwise_correlation(panel, ["trading_date"], "symbol", "close_to_close_return", 60)
    )


@query(
    "correlation_concentration",
    f"""SELECT trading_date, {r('c', 'concentration')},
        {r('CASE WHEN count(c) OVER w >= 120 THEN (c - min(c) OVER w) / nullif(max(c) OVER w - min(c) OVER w, 0) END',
           'correlation_concentration')}
        FROM (SELECT trading_date, avg(abs(rho)) AS c FROM (
                SELECT a.trading_date, CASE WHEN count(a.x + b.x) OVER w >= 20 THEN corr(a.x, b.x) OVER w END AS rho
                FROM (SELECT symbol, trading_date, cal, ret AS x FROM t_union) a
                JOIN (SELECT symbol, trading_date, cal, ret AS x FROM t_union) b
                  ON a.cal = b.cal AND a.symbol < b.symbol
                WINDOW w AS (PARTITION BY a.symbol, b.symbol ORDER BY a.cal
                             ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)) GROUP BY trading_date)
        WINDOW w AS (ORDER BY trading_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def correlation_concentration(spark, folder):
    return tidy(G.correlation_concentration(src.settled_panel(spark, folder)))


@query(
    "neighbour_network",
    f"""SELECT CAST(NULL AS VARCHAR) AS "key", i, j, {r('CASE WHEN total > 0 THEN kept / total ELSE 1.0 / n END', 'weight')}
        FROM (SELECT *, sum(kept) OVER (PARTITION BY i) AS total, count(*) OVER (PARTITION BY i) AS n
              FROM (SELECT i, j, CASE WHEN i <> j AND rk <= 2 THEN v ELSE 0 END AS kept
                    FROM (SELECT *, rank() OVER (PARTITION BY i ORDER BY CASE WHEN i = j THEN -1 ELSE v END DESC) AS rk
                          FROM (SELECT a.symbol AS i, b.symbol AS j, greatest(corr(a.ret, b.ret), 0) AS v
                                FROM t_wret a JOIN t_wret b ON a.cal = b.cal GROUP BY 1, 2))))""".replace(
        'CAST(NULL AS VARCHAR) AS "key"', "'all' AS \"key\""
    ),
)
def neighbour_network(spark, folder):
    rho = G.pairwise_correlation(
        week_returns(spark, folder), ["trading_date"], "symbol", "ret", 60
    )
    both = rho.select(
        F.inline(
            F.array(
                F.struct(F.col("member_a").alias("i"), F.col("member_b").alias("j"), "correlation"),
                F.struct(F.col("member_b").alias("i"), F.col("member_a").alias("j"), "correlation"),
            )
        ).alias("i", "j", "rho")
    )
    return tidy(G.neighbour_weights(both.withColumn("key", F.lit("all")), 2))


@query(
    "feature_redundancy_pairs",
    """SELECT a.feature AS member_a, b.feature AS member_b,
       CAST(count(*) FILTER (a.x IS NOT NULL AND b.x IS NOT NULL) AS BIGINT) AS observations,
       round(corr(a.x, b.x), 6) + 0.0 AS correlation
       FROM t_long2 a JOIN t_long2 b ON a.symbol = b.symbol AND a.trading_date = b.trading_date
         AND a.feature < b.feature
       GROUP BY a.feature, b.feature HAVING abs(corr(a.x, b.x)) >= 0.5""",
)
def feature_redundancy_pairs(spark, folder):
    from tidepanel.operators import features as X
    from tidepanel.registry.evaluate_queries import AUDITED

    long = X.with_inputs(src.settled_panel(spark, folder)).unpivot(
        ["symbol", "trading_date"], list(AUDITED), "feature", "x"
    )
    rho = G.pairwise_correlation(long, ["symbol", "trading_date"], "feature", "x", 200)
    return tidy(rho.filter(F.abs("correlation") >= 0.5))


shared(
    t_long2=" UNION ALL ".join(
        f"SELECT symbol, trading_date, '{n}' AS feature, {e} AS x FROM t_in2"
        for n, e in {"log_return_1s": "lr", "range_fraction": "rf", "log_volume": "lv",
                     "true_range": "tr", "return_before": "lr1"}.items()
    ),
    t_wpair="""
SELECT a.cal, a.symbol AS i, b.symbol AS j, corr(a.sret, b.sret) OVER w AS rho, count(*) OVER w AS n
FROM t_wret a JOIN t_wret b ON a.cal = b.cal
WINDOW w AS (PARTITION BY a.symbol, b.symbol ORDER BY a.cal ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)
""",
    t_wown="""
SELECT symbol, trading_date, cal,
       sum(sret) OVER (PARTITION BY symbol ORDER BY cal ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
       / stddev_samp(sret) OVER (PARTITION BY symbol ORDER BY cal ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING) AS m
FROM t_wret
""",
    t_wresidual="""
SELECT o.trading_date, o.cal, o.symbol, (m - implied) / stddev_samp(m - implied) OVER (PARTITION BY o.cal) AS score
FROM t_wown o JOIN (
  SELECT w.cal, w.i, sum(CASE WHEN total > 0 THEN kept / total ELSE 1 / 6.0 END * m) AS implied
  FROM (SELECT *, sum(kept) OVER (PARTITION BY cal, i) AS total
        FROM (SELECT *, CASE WHEN i <> j AND v > 0 AND (rk <= 4) THEN v ELSE 0 END AS kept
              FROM (SELECT *, rank() OVER (PARTITION BY cal, i ORDER BY CASE WHEN i = j THEN -2 ELSE v END DESC) AS rk
                    FROM (SELECT *, greatest(rho, 0) AS v FROM t_wpair WHERE n >= 30)))) w
  JOIN t_wown o ON o.cal = w.cal AND o.symbol = w.j GROUP BY w.cal, w.i) x
ON x.cal = o.cal AND x.i = o.symbol
""",
)


@query(
    "network_residual_scores",
    f"SELECT trading_date, symbol, {r('score', 'score')} FROM t_wresidual",
)
def network_residual_scores(spark, folder):
    panel = week_returns(spark, folder).withColumn("ret", F.col("sret"))
    out = G.network_residuals(panel, [(40, 5)])
    return tidy(out.select("trading_date", "symbol", "score"))


@query(
    "network_balanced_positions",
    f"""SELECT symbol, trading_date, {r('entered', 'entered')},
        {r('coalesce(avg(entered) OVER (PARTITION BY symbol ORDER BY cal ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0)', 'position')}
        FROM (SELECT u.symbol, u.trading_date, u.cal, CASE WHEN nl > 0 AND nh > 0 AND ns >= 6 THEN
                CASE WHEN score >= 1 THEN 0.5 / nh WHEN score <= -1 THEN -0.5 / nl ELSE 0 END ELSE 0 END AS entered
              FROM t_wret u LEFT JOIN (SELECT *, count(*) FILTER (score <= -1) OVER d AS nl,
                       count(*) FILTER (score >= 1) OVER d AS nh, count(score) OVER d AS ns
                       FROM t_wresidual WINDOW d AS (PARTITION BY cal)) s USING (symbol, cal))""",
)
def network_balanced_positions(spark, folder):
    panel = week_returns(spark, folder).withColumn("ret", F.col("sret"))
    scores = G.network_residuals(panel, [(40, 5)]).select("cal", "symbol", "score")
    df = panel.join(scores, ["cal", "symbol"], "left")
    df = df.withColumn("entered", G.balanced_entries("score", F.lit(1.0), ["cal"]))
    position = G.cohort_positions("entered", F.lit(3), (3,), ["symbol"])
    return tidy(df.select("symbol", "trading_date", "entered", position.alias("position")))


@query(
    "cross_section_ranks",
    f"""SELECT symbol, trading_date, {r('CASE WHEN ret IS NOT NULL THEN rk / n END', 'percentile_rank')},
        {r('CASE WHEN n = 6 THEN (rk - 3.5) / 2.5 END', 'centred_rank')},
        {r('(total - coalesce(ret, 0)) / nullif(n - (ret IS NOT NULL)::INT, 0)', 'peer_mean')}
        FROM (SELECT *, rank() OVER (PARTITION BY trading_date ORDER BY ret NULLS LAST)
                     + (count(*) OVER (PARTITION BY trading_date, ret) - 1) / 2.0 AS rk,
                     count(ret) OVER (PARTITION BY trading_date) AS n,
                     sum(ret) OVER (PARTITION BY trading_date) AS total
              FROM (SELECT symbol, trading_date, round(close_to_close_return, 3) AS ret FROM t_panel))""",
)
def cross_section_ranks(spark, folder):
    x = "ret"
    df = src.session_panel(spark, folder).select(
        "symbol", "trading_date", F.round("close_to_close_return", 3).alias(x)
    )
    n = F.count(x).over(Window.partitionBy("trading_date"))
    return tidy(
        df.select(
            "symbol", "trading_date",
            frames.pct_rank(x, "trading_date").alias("percentile_rank"),
            F.when(n == 6, (frames.mean_rank(x, "trading_date") - 3.5) / 2.5).alias("centred_rank"),
            frames.leave_one_out(x, "trading_date").alias("peer_mean"),
        )
    )
