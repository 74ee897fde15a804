"""Rule families H002-H022 with their SQL, summed per symbol and variant."""

from pyspark.sql import functions as F

from tidepanel.functions.scalars import tidy
from tidepanel.operators import calendar as cal
from tidepanel.operators import hypotheses as H
from tidepanel.operators.signals import clock_masks
from tidepanel.registry.base import query, r, shared
from tidepanel.session import cut_lineage
from tidepanel.sources import tables as src

# Which event type leads which.
LEADERS = {"click": "view", "view": "click", "purchase": "click", "signup": "view", "error": "signup"}

TOTAL = (
    "SELECT symbol, lookback, threshold, direction, "
    + r("sum(gross)", "gross_sum") + ", " + r("sum(sides)", "sides_sum")
    + ", CAST(count(*) FILTER (sides > 0) AS BIGINT) AS active_days FROM ({}) "
    "GROUP BY symbol, lookback, threshold, direction"
)


def totals(df):
    return tidy(
        df.groupBy("symbol", "lookback", "threshold", "direction").agg(
            F.sum("gross").alias("gross_sum"), F.sum("sides").alias("sides_sum"),
            F.count_if(F.col("sides") > 0).alias("active_days"),
        )
    )


def bars(spark, folder, minutes=60):
    return src.clock_bars(spark, folder, minutes)


def sessions(spark, folder, minutes=60):
    return H.sessions_of(cal.bar_ordinals(bars(spark, folder, minutes)))


def dense(spark, folder):
    panel = src.settled_panel(spark, folder).select(
        "symbol", "trading_date", "close", "volume",
        (F.col("close") / F.col("open") - 1.0).alias("session_return"),
    )
    return cal.densify(panel)


def rules(source: str, sign: str, test: str, thresholds, directions=(1,)) -> str:
    """Cross a (…, observed) source with thresholds and directions."""
    values_t = ", ".join(f"({float(t)}::DOUBLE)" for t in thresholds)
    values_d = ", ".join(f"({d})" for d in directions)
    return f"""SELECT *, coalesce(CASE WHEN {test} THEN {sign} END, 0) AS position
      FROM {source} CROSS JOIN (VALUES {values_t}) t(threshold) CROSS JOIN (VALUES {values_d}) d(direction)"""


def session_sum(inner: str, target: str = "target") -> str:
    return TOTAL.format(
        f"SELECT *, position * coalesce({target}, 0) AS gross, abs(position) * 2 AS sides FROM ({inner})"
    )


def bar_sum(inner: str) -> str:
    """Sides of bar positions: changes inside the session plus the final close."""
    return TOTAL.format(
        f"""SELECT symbol, trading_date, lookback, threshold, direction, sum(position * coalesce(bar_return, 0)) AS gross,
              sum(abs(position - coalesce(p, 0)) + CASE WHEN n IS NULL THEN abs(position) ELSE 0 END) AS sides
        FROM (SELECT *, lag(position) OVER v AS p, lead(position) OVER v AS n FROM ({inner})
              WINDOW v AS (PARTITION BY symbol, trading_date, lookback, threshold, direction ORDER BY timestamp_utc))
        GROUP BY ALL"""
    )


STD = "sign(observed) * direction"
FAR = "abs(observed) >= threshold"


def union(parts) -> str:
    return "(" + " UNION ALL ".join(parts) + ")"


shared(
    t_hs="""
SELECT *, close / open - 1 AS session_return, (high - low) / open AS range_fraction
FROM (SELECT symbol, trading_date, first(open ORDER BY timestamp_utc) AS open, max(high) AS high,
             min(low) AS low, last(close ORDER BY timestamp_utc) AS close, sum(volume) AS volume,
             sum(pow(greatest(bar_return, 0), 2)) AS uv, sum(pow(least(bar_return, 0), 2)) AS dv,
             first(close ORDER BY timestamp_utc) AS first_close,
             last(open ORDER BY timestamp_utc) AS last_open,
             list(open ORDER BY timestamp_utc)[2] AS second_open
      FROM t_bars60 GROUP BY symbol, trading_date)
""",
    t_hd="""
SELECT u.symbol, u.trading_date, u.cal, p.close, p.volume, p.close / p.open - 1 AS session_return
FROM t_union u LEFT JOIN t_panel p USING (symbol, trading_date)
""",
    t_hcal="SELECT timestamp_utc, row_number() OVER (ORDER BY timestamp_utc) AS cal "
    "FROM (SELECT DISTINCT timestamp_utc FROM t_bars60)",
    t_hu="""
SELECT s.symbol, c.timestamp_utc, c.cal, b.trading_date, b.bar_return, b.volume,
       b.close / lag(b.close) OVER w - 1 AS cr,
       coalesce(b.trading_date = lag(b.trading_date) OVER w, false) AS same,
       coalesce(b.trading_date = lead(b.trading_date) OVER w, false) AS followed
FROM (SELECT DISTINCT symbol FROM t_bars60) s CROSS JOIN t_hcal c
LEFT JOIN t_bars60 b ON b.symbol = s.symbol AND b.timestamp_utc = c.timestamp_utc
WINDOW w AS (PARTITION BY s.symbol ORDER BY c.cal)
""",
)


def z_sql(x: str, history: int, least: int, w: str) -> str:
    return f"""CASE WHEN count({x}) OVER {w} >= {least} AND {x} IS NOT NULL THEN greatest(least(
        ({x} - avg({x}) OVER {w}) / nullif(stddev_samp({x}) OVER {w}, 0), 6), -6) END"""


def own(n: int, end: str = "CURRENT ROW", order: str = "trading_date") -> str:
    return f"(PARTITION BY symbol ORDER BY {order} ROWS BETWEEN {n} PRECEDING AND {end})"


@query(
    "h002_semivariance_concentration",
    session_sum(rules(
        union(
            f"""SELECT symbol, trading_date, target, {n} AS lookback,
                lag(o) OVER (PARTITION BY symbol ORDER BY trading_date) AS observed
                FROM (SELECT symbol, trading_date, session_return AS target,
                      CASE WHEN count(session_return) OVER w >= {n} THEN sign(sum(session_return) OVER w) END
                      * CASE WHEN count(lean) OVER w >= {n} THEN avg(lean) OVER w END AS o
                      FROM (SELECT *, abs(uv - dv) / nullif(uv + dv, 0) AS lean FROM t_hs)
                      WINDOW w AS {own(n - 1)})"""
            for n in (2, 5, 10, 20)
        ), STD, FAR, (0.25, 0.5, 0.75), (-1, 1))),
)
def h002(spark, folder):
    return totals(H.h002_semivariance(sessions(spark, folder)))


@query(
    "h003_opening_closing_window",
    session_sum(rules(
        union(
            f"""SELECT symbol, trading_date, close / last_open - 1 AS target, {n} AS lookback,
                {z_sql('x', 2 * n, 10, 'w')} AS observed
                FROM (SELECT *, first_close / open - 1 AS x FROM t_hs)
                WINDOW w AS {own(2 * n, '1 PRECEDING')}"""
            for n in (20, 60)
        ), STD, FAR, (0.0, 0.5, 1.0), (-1, 1))),
)
def h003(spark, folder):
    return totals(H.h003_opening_window(sessions(spark, folder), least=10))


@query(
    "h004_compressed_breakout",
    TOTAL.format(
        """SELECT *, raw * direction * coalesce(target, 0) AS gross, abs(raw * direction) * 2 AS sides FROM (
        """ + " UNION ALL ".join(
            f"""SELECT symbol, trading_date, close / second_open - 1 AS target, {n} AS lookback, {q}::DOUBLE AS threshold,
                CASE WHEN lag(range_fraction) OVER o <= CASE WHEN count(range_fraction) OVER w >= {n}
                          THEN quantile_cont(range_fraction, {q}) OVER w END
                     THEN CASE WHEN first_close > lag(high) OVER o THEN 1.0
                               WHEN first_close < lag(low) OVER o THEN -1.0 ELSE 0 END ELSE 0 END AS raw
                FROM t_hs WINDOW o AS (PARTITION BY symbol ORDER BY trading_date), w AS {own(n, '1 PRECEDING')}"""
            for n in (10, 20, 40) for q in (0.2, 0.35)
        ) + ") CROSS JOIN (VALUES (-1), (1)) d(direction)"
    ),
)
def h004(spark, folder):
    return totals(H.h004_compressed_breakout(sessions(spark, folder)))


def union_sum(source: str) -> str:
    return TOTAL.format(
        f"""SELECT symbol, trading_date, lookback, threshold, direction, sum(position * coalesce(bar_return, 0)) AS gross,
              sum(abs(position - CASE WHEN same THEN coalesce(p, 0) ELSE 0 END)
                  + CASE WHEN NOT followed THEN abs(position) ELSE 0 END) AS sides
        FROM (SELECT *, lag(position) OVER (PARTITION BY symbol, lookback, threshold, direction ORDER BY cal) AS p
              FROM ({source})) WHERE trading_date IS NOT NULL GROUP BY ALL"""
    )


@query(
    "h005_declared_leader",
    union_sum(rules(
        union(
            f"""SELECT f.symbol, f.trading_date, f.cal, f.bar_return, f.same, f.followed, {n} AS lookback,
                CASE WHEN f.same THEN lag(z) OVER (PARTITION BY f.symbol ORDER BY f.cal) END AS observed
                FROM t_hu f JOIN (VALUES {', '.join(f"('{a}', '{b}')" for a, b in LEADERS.items())}) m(follower, leader)
                  ON m.follower = f.symbol
                JOIN (SELECT symbol, cal, {z_sql('x', 160, 40, 'w')} AS z
                      FROM (SELECT symbol, cal, CASE WHEN count(cr) OVER v >= {n} THEN sum(cr) OVER v END AS x
                            FROM t_hu WINDOW v AS {own(n - 1, order='cal')})
                      WINDOW w AS {own(160, '1 PRECEDING', 'cal')}) l ON l.symbol = m.leader AND l.cal = f.cal"""
            for n in (1, 2, 4)
        ), STD, FAR, (0.5, 1.0), (-1, 1))),
)
def h005(spark, folder):
    return totals(H.h005_declared_leader(cut_lineage(bars(spark, folder)), LEADERS))


@query(
    "h006_momentum_volume",
    union_sum(rules(
        union(
            f"""SELECT symbol, trading_date, cal, bar_return, same, followed, {n} AS lookback,
                CASE WHEN same THEN lag(zm * greatest(zv, 0)) OVER (PARTITION BY symbol ORDER BY cal) END AS observed
                FROM (SELECT *, {z_sql('x', 160, 40, 'w')} AS zm, {z_sql('lv', 160, 40, 'w')} AS zv
                      FROM (SELECT *, CASE WHEN volume IS NOT NULL THEN ln(1 + greatest(volume, 0)) END AS lv,
                                   CASE WHEN count(cr) OVER v >= {n} THEN sum(cr) OVER v END AS x
                            FROM (SELECT * FROM t_hu) WINDOW v AS {own(n - 1, order='cal')})
                      WINDOW w AS {own(160, '1 PRECEDING', 'cal')})
                WHERE true"""
            for n in (2, 4, 8)
        ), STD, FAR, (0.5, 1.0), (-1, 1))),
)
def h006(spark, folder):
    return totals(H.h006_momentum_volume(cut_lineage(bars(spark, folder))))


def pct_sql(x: str) -> str:
    return f"""CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY trading_date ORDER BY {x} NULLS LAST)
        + (count(*) OVER (PARTITION BY trading_date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY trading_date) END"""


@query(
    "h007_high_to_price_rank",
    session_sum(rules(
        union(
            f"""SELECT symbol, trading_date, session_return AS target, {n} AS lookback,
                lag((k - 0.5) * 2) OVER (PARTITION BY symbol ORDER BY trading_date) AS observed
                FROM (SELECT *, {pct_sql('h')} AS k
                      FROM (SELECT *, close / CASE WHEN count(close) OVER w >= {n} THEN max(close) OVER w END - 1 AS h
                            FROM t_hd WINDOW w AS {own(n - 1)}))"""
            for n in (5, 10, 20, 40)
        ), STD, FAR, (0.2, 0.4))),
)
def h007(spark, folder):
    return totals(H.h007_high_to_price(dense(spark, folder)))


@query(
    "h008_clock_bucket_drift",
    bar_sum(rules(
        union(
            f"""SELECT *, {n} AS lookback, CASE WHEN count(bar_return) OVER w >= 5 THEN greatest(least(
                  avg(bar_return) OVER w / nullif(stddev_samp(bar_return) OVER w, 0), 6), -6) END AS observed
                FROM t_bars60 WINDOW w AS (PARTITION BY symbol, session_bucket ORDER BY trading_date
                                           ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"""
            for n in (20, 60)
        ), STD, FAR, (0.0, 0.1, 0.2))),
)
def h008(spark, folder):
    return totals(H.h008_clock_drift(bars(spark, folder), least_of=5))


def in_session(x: str) -> str:
    return f"lag({x}) OVER (PARTITION BY symbol, trading_date ORDER BY timestamp_utc)"


@query(
    "h009_jump_response",
    bar_sum(rules(
        union(
            f"""SELECT * REPLACE ({in_session('observed')} AS observed) FROM (
                SELECT *, {n} AS lookback, CASE WHEN c IS NOT NULL THEN greatest(least(sign(bar_return) * sqrt(greatest(bar_return * bar_return - c, 0) / c), 10), -10) END AS observed
                FROM (SELECT *, CASE WHEN count(pair) OVER w >= {max(20, n // 2)} THEN nullif(avg(pair) OVER w * pi() / 2, 0) END AS c
                      FROM (SELECT *, abs(lag(bar_return) OVER o) * abs(lag(bar_return, 2) OVER o) AS pair FROM t_bars60
                            WINDOW o AS (PARTITION BY symbol ORDER BY timestamp_utc))
                      WINDOW w AS {own(n - 1, order='timestamp_utc')}) WHERE true)"""
            for n in (40, 160)
        ), STD, FAR + " AND observed IS NOT NULL", (1.0, 2.0), (-1, 1))),
)
def h009(spark, folder):
    return totals(H.h009_jump(bars(spark, folder)))


@query(
    "h010_price_impact_fade",
    bar_sum(rules(
        union(
            f"""SELECT * REPLACE ({in_session('observed')} AS observed) FROM (
                SELECT *, {n} AS lookback, {z_sql('x', n, 40, 'w')} AS observed
                FROM (SELECT *, bar_return / nullif(close * volume, 0) AS x FROM t_bars60)
                WINDOW w AS {own(n, '1 PRECEDING', 'timestamp_utc')})"""
            for n in (80, 160)
        ), STD, FAR, (1.0, 2.0), (-1,))),
)
def h010(spark, folder):
    return totals(H.h010_price_impact(bars(spark, folder)))


@query(
    "h011_sign_entropy",
    bar_sum(rules(
        union(
            f"""SELECT * REPLACE ({in_session('observed')} AS observed, {in_session('trend')} AS trend) FROM (
                SELECT *, {n} AS lookback, CASE WHEN c >= {n} THEN sign(s) END AS trend,
                  CASE WHEN c >= {n} THEN 1 + CASE WHEN f > 0 THEN f * log2(f) ELSE 0 END
                    + CASE WHEN f < 1 THEN (1 - f) * log2(1 - f) ELSE 0 END END AS observed
                FROM (SELECT *, count(*) OVER w AS c, avg(CASE WHEN bar_return > 0 THEN 1.0 ELSE 0 END) OVER w AS f,
                             sum(bar_return) OVER w AS s FROM t_bars60 WINDOW w AS {own(n - 1, order='timestamp_utc')}))"""
            for n in (8, 16, 32)
        ), "trend", "observed >= threshold", (0.1, 0.25, 0.5))),
)
def h011(spark, folder):
    return totals(H.h011_sign_entropy(bars(spark, folder)))


@query(
    "h012_weekday_position",
    session_sum("""SELECT symbol, trading_date, session_return AS target, 1 AS lookback, 0.0::DOUBLE AS threshold,
        1 AS direction, CASE isodow(trading_date) WHEN 5 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0 END AS position FROM t_hd"""),
)
def h012(spark, folder):
    return totals(H.h012_weekday(dense(spark, folder)))


@query(
    "h013_volume_conditional_reversal",
    session_sum(rules(
        union(
            f"""SELECT symbol, trading_date, x AS target, {n} AS lookback, growth,
                CASE WHEN count(x) OVER w >= {n} THEN sum(x) OVER w END AS observed
                FROM (SELECT *, coalesce(session_return, 0) AS x,
                             CASE WHEN count(volume) OVER s >= 5 THEN avg(volume) OVER s END
                             / CASE WHEN count(volume) OVER l >= 20 THEN nullif(avg(volume) OVER l, 0) END AS growth
                      FROM t_hd WINDOW s AS {own(5, '1 PRECEDING')}, l AS {own(20, '1 PRECEDING')})
                WINDOW w AS {own(n, '1 PRECEDING')}"""
            for n in (3, 5)
        ), "-sign(observed)", "growth >= threshold AND growth <= 3", (1.0, 1.25), (-1,))),
)
def h013(spark, folder):
    return totals(H.h013_volume_reversal(dense(spark, folder)))


def overnight_core(spark, folder):
    masks = clock_masks("timestamp_utc")
    core = masks["open_30"] | masks["target"]
    out = cal.window_summary(
        bars(spark, folder, 15), {"overnight": (masks["overnight"], 1), "core": (core, 1)}
    )
    return out.select(
        "symbol", "trading_date",
        F.coalesce("overnight_return", F.lit(0.0)).alias("overnight"),
        F.coalesce("core_return", F.lit(0.0)).alias("core"),
    )


@query(
    "h014_overnight_fade",
    session_sum(rules(
        f"""(SELECT *, 80 AS lookback, {z_sql('o', 80, 10, 'w')} AS observed
            FROM (SELECT symbol, trading_date, coalesce(product(1 + bar_return) FILTER (lm >= 1080 OR lm < 570) - 1, 0) AS o,
                         coalesce(product(1 + bar_return) FILTER (lm >= 570 AND lm < 960) - 1, 0) AS target
                  FROM t_clock15 GROUP BY symbol, trading_date)
            WINDOW w AS {own(80, '1 PRECEDING')})""",
        STD, FAR, (0.0, 0.5, 1.0), (-1,))),
)
def h014(spark, folder):
    return totals(H.h014_overnight_fade(overnight_core(spark, folder), least=10))


@query(
    "h015_variance_ratio_switch",
    session_sum(
        "SELECT *, CASE WHEN abs(observed) >= threshold THEN trend * sign(observed) ELSE 0 END AS position FROM ("
        + " UNION ALL ".join(
            f"""SELECT symbol, trading_date, x AS target, {n} AS lookback, {h} AS direction, lag(o) OVER q AS observed, lag(t) OVER q AS trend
                FROM (SELECT symbol, trading_date, x, sign(s) AS t,
                        CASE WHEN count(s) OVER w >= {n} THEN var_samp(s) OVER w END
                        / nullif(CASE WHEN count(x) OVER w >= {n} THEN var_samp(x) OVER w END * {h}, 0) - 1 AS o
                      FROM (SELECT symbol, trading_date, x, CASE WHEN count(x) OVER v >= {h} THEN sum(x) OVER v END AS s
                            FROM (SELECT *, coalesce(session_return, 0) AS x FROM t_hd) WINDOW v AS {own(h - 1)})
                      WINDOW w AS {own(n - 1)})
                WINDOW q AS (PARTITION BY symbol ORDER BY trading_date)"""
            for n in (40, 80) for h in (2, 5)
        ) + ") CROSS JOIN (VALUES (0.1::DOUBLE), (0.25)) t(threshold)"),
)
def h015(spark, folder):
    return totals(H.h015_variance_ratio(dense(spark, folder)))


@query(
    "h016_realized_skew_rank",
    session_sum(rules(
        union(
            f"""SELECT symbol, trading_date, target, {n} AS lookback,
                lag((k - 0.5) * -2) OVER (PARTITION BY symbol ORDER BY trading_date) AS observed
                FROM (SELECT *, {pct_sql('m')} AS k FROM (
                      SELECT *, CASE WHEN count(skew) OVER w >= {n} THEN avg(skew) OVER w END AS m
                      FROM (SELECT g.symbol, g.trading_date, s.skew, s.target
                            FROM (SELECT * FROM (SELECT DISTINCT symbol FROM t_bars15),
                                               (SELECT DISTINCT trading_date FROM t_bars15)) g
                            LEFT JOIN (SELECT symbol, trading_date, skewness(bar_return) AS skew,
                                  last(close ORDER BY timestamp_utc) / first(open ORDER BY timestamp_utc) - 1 AS target
                                  FROM t_bars15 GROUP BY ALL) s USING (symbol, trading_date))
                      WINDOW w AS {own(n - 1)}))"""
            for n in (1, 3, 5)
        ), STD, FAR, (0.2, 0.4))),
)
def h016(spark, folder):
    return totals(H.h016_skew_rank(bars(spark, folder, 15)))


# --- reports and events ------------------------------------------------------------------

shared(
    t_reports="""
SELECT symbol, CAST(week + 4 AS DATE) AS report_date, CAST(week + 7 AS DATE) AS release_date, share
FROM (SELECT o_orderpriority AS symbol, CAST(date_trunc('week', o_orderdate) AS DATE) AS week,
             sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE -o_totalprice END)
             / nullif(sum(o_totalprice), 0) AS share FROM orders GROUP BY 1, 2)
""",
    t_report_scores="""
SELECT symbol, report_date, release_date, (rk - 3) / 2 AS score
FROM (SELECT *, count(share) OVER (PARTITION BY report_date) AS n,
             rank() OVER (PARTITION BY report_date ORDER BY share)
             + (count(*) OVER (PARTITION BY report_date, share) - 1) / 2.0 AS rk FROM t_reports)
WHERE n = 5
""",
)


def reports(spark, folder):
    week = F.trunc(F.to_date("o_orderdate"), "week")
    signed = F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    out = (
        src.table(spark, folder, "orders")
        .groupBy(F.col("o_orderpriority").alias("symbol"), week.alias("week"))
        .agg((F.sum(signed) / F.sum("o_totalprice")).alias("share"))
    )
    return out.select(
        "symbol", F.date_add("week", 4).alias("report_date"),
        F.date_add("week", 7).alias("release_date"), "share",
    )


@query(
    "report_rank_next_session",
    f"""SELECT symbol, report_date, {r('score', 'score')}, CAST(min(trading_date) AS DATE) AS trading_date
        FROM t_report_scores s JOIN t_cal c ON c.trading_date > s.release_date GROUP BY ALL""",
)
def report_rank_next_session(spark, folder):
    scores = cut_lineage(H.report_scores(reports(spark, folder), "share", 5))
    days = cut_lineage(src.quotes(spark, folder).select("trading_date").distinct())
    out = H.first_session_after(scores, days)
    return tidy(out.select("symbol", "report_date", "score", "trading_date"))


@query(
    "report_positions_held",
    """SELECT hold, threshold, symbol, trading_date, max_by(position, report_date) AS position
       FROM (SELECT h.hold, t.threshold, s.symbol, s.report_date, c.trading_date,
                    CASE WHEN abs(score) >= t.threshold THEN sign(score)::DOUBLE ELSE 0 END AS position
             FROM (SELECT symbol, report_date, score, min(n) AS n FROM t_report_scores
                   JOIN t_cal ON trading_date > release_date GROUP BY ALL) s
             CROSS JOIN (VALUES (1), (3), (8)) h(hold) CROSS JOIN (VALUES (0.5::DOUBLE), (1.0)) t(threshold)
             JOIN t_cal c ON c.n BETWEEN s.n AND s.n + h.hold - 1) GROUP BY ALL""",
)
def report_positions_held(spark, folder):
    scores = cut_lineage(H.report_scores(reports(spark, folder), "share", 5))
    days = cut_lineage(src.quotes(spark, folder).select("trading_date").distinct())
    return H.held_positions(scores, days, (1, 3, 8), (0.5, 1.0))


@query(
    "release_dates_without_holidays",
    """SELECT trading_date FROM t_cal WHERE isodow(trading_date) = 3
       AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS h FROM orders WHERE o_totalprice > 499000)
                       WHERE date_trunc('week', h) = date_trunc('week', trading_date) AND h <= trading_date)""",
)
def release_dates_without_holidays(spark, folder):
    days = src.quotes(spark, folder).select("trading_date").distinct()
    holidays = src.table(spark, folder, "orders").filter("o_totalprice > 499000").select(
        F.to_date("o_orderdate").alias("holiday")
    ).distinct()
    return H.release_dates(days, 2, holidays)


# The release weekday of a symbol (Monday is 0), and a session whose release came at another time.
MIDWEEK = ("ECONOMY", "LARGE", "MEDIUM")
SHIFTED = ("1998-01-08",)
RELEASE_MINUTE = 630

shared(
    t_release_days=f"""
SELECT symbol, trading_date FROM (
    SELECT DISTINCT symbol, trading_date, CASE WHEN symbol IN {MIDWEEK} THEN 3 ELSE 4 END AS release_day FROM t_quotes)
WHERE isodow(trading_date) = release_day AND trading_date <> DATE '{SHIFTED[0]}'
AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS h FROM orders WHERE o_totalprice > 499000)
                WHERE date_trunc('week', h) = date_trunc('week', trading_date) AND h <= trading_date)
""",
    t_release_tape="""
SELECT symbol, trading_date, 600 + (k1 * 8 + k2) % 330 AS printed,
       first(price ORDER BY k1, k2, price) AS open, last(price ORDER BY k1, k2, price) AS close
FROM t_quotes SEMI JOIN t_release_days USING (symbol, trading_date) GROUP BY ALL
""",
    t_release_minutes="""
SELECT symbol, trading_date, m, CASE WHEN m = printed THEN open ELSE close END AS open, close
FROM (SELECT *, unnest(range(printed, until)) AS m
      FROM (SELECT *, coalesce(lead(printed) OVER (PARTITION BY symbol, trading_date ORDER BY printed), 930) AS until
            FROM t_release_tape))
""",
    t_events_long=" UNION ALL ".join(
        f"""SELECT symbol, trading_date, {a} AS response_minutes, {h} AS hold_minutes,
        last(close ORDER BY m) FILTER (m >= 630 AND m < {630 + a}) / first(open ORDER BY m) FILTER (m >= 630 AND m < {630 + a}) - 1 AS response_return,
        last(close ORDER BY m) FILTER (m >= {630 + a} AND m < {630 + a + h}) / first(open ORDER BY m) FILTER (m >= {630 + a} AND m < {630 + a + h}) - 1 AS target_return
        FROM t_release_minutes GROUP BY symbol, trading_date
        HAVING count(*) FILTER (m >= 630 AND m < {630 + a}) = {a}
           AND count(*) FILTER (m >= {630 + a} AND m < {630 + a + h}) = {h}"""
        for a in (15, 30) for h in (30, 60, 240)
    ),
    t_release_study="""
SELECT *, CASE WHEN abs(score) >= threshold THEN sign(response_return)::DOUBLE ELSE 0 END AS position
FROM (SELECT *, CASE WHEN count(response_return) OVER w >= 12 THEN response_return / nullif(stddev_samp(response_return) OVER w, 0) END AS score
      FROM t_events_long WINDOW w AS (PARTITION BY symbol, response_minutes, hold_minutes ORDER BY trading_date
                                      ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
CROSS JOIN (VALUES (0.5::DOUBLE), (1.0)) t(threshold)
""",
)


def release_study(spark, folder):
    """Every release of every symbol at the default windows, thresholds, history and whole coverage."""
    tape = src.release_tape(spark, folder)
    own_day = F.when(F.col("symbol").isin(*MIDWEEK), 2).otherwise(3)
    holidays = src.table(spark, folder, "orders").filter("o_totalprice > 499000").select(
        F.to_date("o_orderdate").alias("holiday")
    )
    days = H.release_days(src.quotes(spark, folder).select("symbol", "trading_date"), own_day, holidays, SHIFTED)
    minutes = H.carried_minutes(tape.join(days, ["symbol", "trading_date"], "left_semi"), src.TAPE_END)
    return H.event_study(minutes, days, RELEASE_MINUTE, minute="minute")


@query(
    "event_study_positions",
    f"""SELECT symbol, trading_date, response_minutes, hold_minutes, threshold,
        {r('response_return', 'response_return')}, {r('target_return', 'target_return')},
        {r('score', 'response_score')}, position FROM t_release_study""",
)
def event_study_positions(spark, folder):
    return tidy(release_study(spark, folder))


@query(
    "release_daily_ledger",
    f"""SELECT v.*, c.trading_date, {r('coalesce(position * target_return, 0)', 'gross')},
        coalesce(2 * abs(position), 0)::DOUBLE AS sides
        FROM (SELECT DISTINCT symbol, response_minutes, hold_minutes, threshold FROM t_release_study) v
        CROSS JOIN (SELECT DISTINCT trading_date FROM t_quotes) c
        LEFT JOIN t_release_study s USING (symbol, response_minutes, hold_minutes, threshold, trading_date)""",
)
def release_daily_ledger(spark, folder):
    """Gross return and sides of every variant on every session of the calendar."""
    return tidy(H.event_ledger(cut_lineage(release_study(spark, folder)), src.quotes(spark, folder)))
