"""Minute weights, daily accounting and attribution of the intraday sleeve; regime summaries."""

from pyspark.sql import functions as F

from tidepanel.functions import frames
from tidepanel.functions.scalars import tidy
from tidepanel.operators import accounting as B
from tidepanel.operators import calendar as cal
from tidepanel.operators import evaluate as E
from tidepanel.operators import network as G
from tidepanel.operators import signals as N
from tidepanel.operators.stateful import hysteresis
from tidepanel.registry.base import query, r, shared
from tidepanel.session import cut_lineage
from tidepanel.sources import tables as src

shared(
    t_mw1="""
SELECT s.symbol, s.trading_date, s.timestamp_utc, s.session_minute, s.return_1m, s.score_balanced, s.mp, s.vs, s.os, s.rs AS short_score, s.vwap_deviation_z, s.open_deviation_z, s.return_5m_z,
       s.close, s.hi, s.lo, h.state,
       CASE WHEN count(s.return_1m) OVER w >= 2 THEN h.state / nullif(stddev_samp(s.return_1m) OVER w, 0) END AS risk
FROM t_intraday s JOIN t_hys h USING (symbol, trading_date, timestamp_utc)
WINDOW w AS (PARTITION BY s.symbol ORDER BY s.timestamp_utc ROWS BETWEEN 239 PRECEDING AND CURRENT ROW)
""",
    t_mw2="""
SELECT *, CASE WHEN coalesce(l0, 0) = 0 OR coalesce(s0, 0) = 0 THEN risk - m0 ELSE risk END AS x
FROM (SELECT *, sum(CASE WHEN risk IS NOT NULL THEN greatest(risk, 0) END) OVER t AS l0, sum(CASE WHEN risk IS NOT NULL THEN -least(risk, 0) END) OVER t AS s0,
             median(risk) OVER t AS m0 FROM t_mw1 WINDOW t AS (PARTITION BY timestamp_utc))
""",
    t_mw3="""
SELECT *, CASE WHEN session_minute % 15 = 0 OR session_minute >= 1375 THEN coalesce(
    CASE WHEN x IS NOT NULL AND lt <> 0 AND st <> 0 THEN (1 + net) / 2 * greatest(x, 0) / lt - (1 - net) / 2 * -least(x, 0) / st END, 0) END AS decided
FROM (SELECT *, CASE WHEN lt <> 0 AND st <> 0 THEN greatest(least((lt - st) / (lt + st), 0.25), -0.25) END AS net
      FROM (SELECT *, sum(CASE WHEN x IS NOT NULL THEN greatest(x, 0) END) OVER t AS lt, sum(CASE WHEN x IS NOT NULL THEN -least(x, 0) END) OVER t AS st
            FROM t_mw2 WINDOW t AS (PARTITION BY timestamp_utc)))
""",
    t_mw="""
SELECT *, coalesce(CASE WHEN date_diff('second', lag(timestamp_utc) OVER w, timestamp_utc) = 60 AND lag(trading_date) OVER w = trading_date
                        THEN lag(target) OVER w END, 0) AS held
FROM (SELECT *, coalesce(last_value(decided IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY timestamp_utc ROWS UNBOUNDED PRECEDING), 0) AS target FROM t_mw3)
WINDOW w AS (PARTITION BY symbol ORDER BY timestamp_utc)
""",
)


def minute_book(spark, folder):
    state = cal.running_session_state(src.minute_returns(spark, folder))
    scored = cut_lineage(N.intraday_scores(state, least=2))
    states = hysteresis(scored, "score_balanced", 0.3, 0.1, 8)
    return scored.join(states, ["symbol", "trading_date", "timestamp_utc"])


@query(
    "minute_portfolio_weights",
    f"""SELECT symbol, epoch(timestamp_utc)::BIGINT AS ts, {r('target', 'target_weight')}, {r('held', 'implemented_weight')} FROM t_mw""",
)
def minute_portfolio_weights(spark, folder):
    out = B.minute_weights(minute_book(spark, folder), "position_signal", least=2)
    return tidy(
        out.select("symbol", F.unix_timestamp("timestamp_utc").alias("ts"), "target_weight", "implemented_weight")
    )


@query(
    "volatility_scaled_daily",
    f"""WITH b AS (SELECT trading_date, sum(held * coalesce(return_1m, 0)) AS g FROM t_mw GROUP BY trading_date),
       s AS (SELECT trading_date, coalesce(greatest(least(CASE WHEN count(g) OVER w >= 5 THEN 0.1 / nullif(stddev_samp(g) OVER w * sqrt(252), 0) ELSE 1 END, 2), 0.25), 1) AS k
             FROM b WINDOW w AS (ORDER BY trading_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
       a AS (SELECT m.*, held * k AS act FROM t_mw m JOIN s USING (trading_date)),
       t AS (SELECT *, abs(act - coalesce(lag(act) OVER (PARTITION BY symbol ORDER BY timestamp_utc), 0)) / 2 AS turn FROM a),
       m AS (SELECT trading_date, timestamp_utc, sum(act * coalesce(return_1m, 0)) AS g, sum(turn) AS t, sum(abs(act)) AS e FROM t GROUP BY ALL)
       SELECT trading_date, {r('sum(g)', 'gross_return', 8)}, {r('sum(t)', 'turnover', 8)}, {r('avg(e)', 'gross_exposure', 8)},
              {r('sum(t) * 3.5 / 10000', 'cost', 10)}, {r('sum(g) - sum(t) * 3.5 / 10000', 'net_return', 8)}
       FROM m GROUP BY trading_date""",
)
def volatility_scaled_daily(spark, folder):
    out = B.volatility_scaled_daily(
        B.minute_weights(minute_book(spark, folder), "position_signal", least=2), history=5
    )
    return tidy(out, 8, cost=10)


@query(
    "component_information",
    " UNION ALL ".join(
        f"""SELECT '{n}' AS component, CAST(count(*) AS BIGINT) AS observations, {r(f'corr({e}, a)', 'next_return_ic', 5)}
        FROM (SELECT *, lead(return_1m) OVER (PARTITION BY symbol, trading_date ORDER BY timestamp_utc) AS a FROM t_mw1)
        WHERE {z}_z IS NOT NULL AND a IS NOT NULL"""
        for n, e, z in (("vwap_score", "vs", "vwap_deviation"), ("open_move_score", "os", "open_deviation"),
                        ("short_return_score", "short_score", "return_5m"))
    ),
)
def component_information(spark, folder):
    df = minute_book(spark, folder).withColumns(
        {
            c: F.when(F.col(f"{z}_z").isNotNull(), F.col(c))
            for c, z in (("vwap_score", "vwap_deviation"), ("open_move_score", "open_deviation"),
                         ("short_return_score", "return_5m"))
        }
    )
    names = ["vwap_score", "open_move_score", "short_return_score"]
    return tidy(E.component_information(df, names, "return_1m"), 5)


@query(
    "quartile_attribution",
    f"""SELECT CAST(least(session_minute // 345, 3) + 1 AS INTEGER) AS time_quartile,
        CAST(CASE WHEN hi > lo THEN least(greatest(ceil(least(greatest((close - lo) / (hi - lo), 0), 1) * 4), 1), 4) END AS INTEGER) AS range_quartile,
        CAST(count(*) AS BIGINT) AS observations, {r('avg((state <> 0)::INT)', 'active_share')}, {r('avg(abs(score_balanced))', 'mean_absolute_score', 5)},
        {r('coalesce(sum(held * coalesce(return_1m, 0)), 0)', 'contribution', 8)} FROM t_mw GROUP BY 1, 2""",
)
def quartile_attribution(spark, folder):
    df = B.minute_weights(minute_book(spark, folder), "position_signal", least=2)
    df = df.withColumn("contribution", F.col("implemented_weight") * F.coalesce("return_1m", F.lit(0.0)))
    out = E.quartile_attribution(df, "score_balanced", "position_signal", "contribution")
    return tidy(out, 6, mean_absolute_score=5, contribution=8)


@query(
    "symbol_day_attribution",
    f"""SELECT symbol, trading_date, {r('avg(score_balanced)', 'mean_score', 5)}, CAST(count(*) FILTER (state <> 0) AS BIGINT) AS active_minutes,
        {r('avg(abs(held))', 'mean_absolute_weight')}, {r('sum(held * coalesce(return_1m, 0))', 'contribution', 8)} FROM t_mw GROUP BY symbol, trading_date""",
)
def symbol_day_attribution(spark, folder):
    df = B.minute_weights(minute_book(spark, folder), "position_signal", least=2)
    df = df.withColumn("contribution", F.col("implemented_weight") * F.coalesce("return_1m", F.lit(0.0)))
    out = E.symbol_day_attribution(
        df, "score_balanced", "position_signal", "implemented_weight", "contribution"
    )
    return tidy(out, 6, mean_score=5, contribution=8)


def order_shares(spark, folder):
    """Daily shares of four order priorities: a stand-in probability table."""
    day = F.to_date("o_orderdate").alias("trading_date")
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
    total = F.sum(F.when(F.col("o_orderpriority").isin(*names), F.col("o_totalprice")))
    return (
        src.table(spark, folder, "orders").groupBy(day)
        .agg(*[
            F.coalesce(F.sum(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice"))) / total, F.lit(0.25)).alias(n)
            for p, n in zip(names, G.REGIMES)
        ])
    )


shared(
    t_shares="SELECT CAST(o_orderdate AS DATE) AS trading_date, "
    + ", ".join(
        f"coalesce(sum(o_totalprice) FILTER (o_orderpriority = '{p}') / sum(o_totalprice) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')), "
        f"0.25) AS {n}"
        for p, n in zip(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"), G.REGIMES)
    )
    + " FROM orders GROUP BY 1",
    t_blend="SELECT a.trading_date, "
    + ", ".join(
        f"CASE WHEN b.trading_date IS NOT NULL THEN 0.75 * a.{n} + 0.25 * b.{n} ELSE a.{n} END AS e{i}, a.{n} AS a{i}" for i, n in enumerate(G.REGIMES)
    )
    + ", b.trading_date IS NOT NULL AS there FROM t_shares a LEFT JOIN t_shares b ON b.trading_date = a.trading_date - 7",
)


@query(
    "regime_blend",
    "SELECT trading_date, " + ", ".join(r(f"e{i}", f"ensemble_{n}") for i, n in enumerate(G.REGIMES)) + ", "
    + r("1 + (" + " + ".join(f"e{i} * ln(greatest(e{i}, 1e-12))" for i in range(4)) + ") / ln(4)", "ensemble_confidence")
    + ", there AS model_available FROM t_blend",
)
def regime_blend(spark, folder):
    base = order_shares(spark, folder)
    model = base.withColumns(
        {"trading_date": F.date_add("trading_date", 7), "model_confidence": F.lit(1.0)}
    )
    out = G.blend_regimes(base, model)
    return tidy(
        out.select("trading_date", *[f"ensemble_{n}" for n in G.REGIMES], "ensemble_confidence", "model_available")
    )


@query(
    "dominant_regime_counts",
    "SELECT CASE " + " ".join(
        f"WHEN a{i} = greatest(a0, a1, a2, a3) THEN '{n}'" for i, n in enumerate(G.REGIMES)
    ) + " END AS dominant, CAST(count(*) AS BIGINT) AS rows_seen FROM t_blend GROUP BY 1",
)
def dominant_regime_counts(spark, folder):
    return E.dominant_counts(order_shares(spark, folder), list(G.REGIMES))


@query(
    "rolling_peer_correlation",
    f"""SELECT symbol, trading_date, {r('CASE WHEN count(x) OVER v >= 20 THEN stddev_samp(x) OVER v * sqrt(252) END', 'annualized_volatility_20')},
        {r('CASE WHEN count(CASE WHEN p IS NOT NULL THEN x END) OVER w >= 48 THEN corr(x, p) OVER w END', 'peer_correlation_120')}
        FROM (SELECT symbol, trading_date, x, CASE WHEN x IS NOT NULL THEN q END AS p
              FROM (SELECT a.symbol, a.trading_date, a.ret AS x, avg(b.ret) AS q
                    FROM t_union a JOIN t_union b ON a.cal = b.cal AND a.symbol <> b.symbol WHERE a.printed GROUP BY ALL))
        WINDOW v AS (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
               w AS (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)""",
)
def rolling_peer_correlation(spark, folder):
    x = "close_to_close_return"
    df = src.session_panel(spark, folder).withColumn(
        "peer", F.when(F.col(x).isNotNull(), frames.leave_one_out(x, "trading_date"))
    )
    return tidy(
        df.select(
            "symbol", "trading_date",
            (frames.rows("symbol", "trading_date", 20).std(x) * 252.0**0.5).alias("annualized_volatility_20"),
            frames.rows("symbol", "trading_date", 120, 48).corr(x, "peer").alias("peer_correlation_120"),
        )
    )
