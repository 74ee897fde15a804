"""Time zones, sessions, bars and calendars."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepanel.functions.scalars import tidy
from tidepanel.operators import calendar as cal
from tidepanel.registry.base import query, r
from tidepanel.sources import tables as src


@query(
    "session_panel_bars",
    f"""SELECT symbol, trading_date, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')},
        {r('close', 'close')}, {r('volume', 'volume')}, observations,
        {r('realized_volatility_1m', 'realized_volatility_1m')},
        {r('close_to_close_return', 'close_to_close_return')} FROM t_panel""",
)
def session_panel_bars(spark, folder):
    return tidy(src.session_panel(spark, folder).drop("session_close_utc"))


@query(
    "order_panel_bars",
    f"""SELECT symbol, trading_date, {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')},
        {r('close', 'close')}, {r('volume', 'volume')} FROM t_order_panel""",
)
def order_panel_bars(spark, folder):
    return tidy(
        src.order_panel(spark, folder).drop("observations", "realized_volatility_1m")
    )


@query(
    "strict_local_to_utc",
    """SELECT event_id, CASE WHEN NOT nonexistent AND NOT ambiguous THEN epoch_us(u) END AS utc_us,
              nonexistent, ambiguous
       FROM (SELECT event_id, u,
                    timezone('America/New_York', timezone('UTC', u)) <> l AS nonexistent,
                    (timezone('America/New_York', timezone('UTC', u + INTERVAL 1 HOUR)) = l
                     OR timezone('America/New_York', timezone('UTC', u - INTERVAL 1 HOUR)) = l)
                      AS ambiguous
             FROM (SELECT event_id, l, timezone('UTC', timezone('America/New_York', l)) AS u
                   FROM (SELECT event_id, CASE WHEN event_id % 2 = 0
                                THEN TIMESTAMP '2024-11-02 00:00:00'
                                ELSE TIMESTAMP '2024-03-09 00:00:00' END
                                + (event_id % 2880) * INTERVAL 1 MINUTE AS l FROM events)))""",
)
def strict_local_to_utc(spark, folder):
    start = F.when(F.col("event_id") % 2 == 0, "2024-11-02 00:00:00").otherwise(
        "2024-03-09 00:00:00"
    )
    local = F.timestamp_seconds(
        F.unix_timestamp(start.cast("timestamp")) + F.pmod("event_id", F.lit(2880)) * 60
    )
    parts = cal.strict_utc(local)
    possible = ~parts["nonexistent"] & ~parts["ambiguous"]
    return src.table(spark, folder, "events").select(
        "event_id",
        F.when(possible, F.unix_micros(parts["utc"])).alias("utc_us"),
        parts["nonexistent"].alias("nonexistent"),
        parts["ambiguous"].alias("ambiguous"),
    )


@query(
    "contract_symbol_parts",
    """SELECT root AS root_symbol, code AS contract_month_code, contract_year,
              CAST(count(*) AS BIGINT) AS rows_seen
       FROM (SELECT substr(s, 1, length(s) - length(d) - 1) AS root,
                    substr(s, length(s) - length(d), 1) AS code,
                    CAST(CASE WHEN length(d) = 2 THEN CAST(d AS INTEGER)
                         WHEN 2020 + CAST(d AS INTEGER) < 2021 THEN 2030 + CAST(d AS INTEGER)
                         ELSE 2020 + CAST(d AS INTEGER) END AS INTEGER) AS contract_year
             FROM (SELECT *, regexp_extract(s, '([0-9]{1,2})$', 1) AS d
                   FROM (SELECT upper(substr(p_type, 1, 2))
                                || substr('FGHJKMNQUVXZ', CAST(p_partkey % 12 AS INTEGER) + 1, 1)
                                || CAST(p_size % 30 AS VARCHAR) AS s FROM part)))
       GROUP BY ALL""",
)
def contract_symbol_parts(spark, folder):
    code = F.substring(
        F.lit("FGHJKMNQUVXZ"), F.pmod("p_partkey", F.lit(12)).cast("int") + 1, F.lit(1)
    )
    symbol = F.concat(
        F.upper(F.substring("p_type", 1, 2)), code, (F.col("p_size") % 30).cast("string")
    )
    parts = cal.contract_parts(symbol, 2026)
    return (
        src.table(spark, folder, "part")
        .select(*[c.alias(n) for n, c in parts.items()])
        .groupBy(*parts)
        .agg(F.count(F.lit(1)).alias("rows_seen"))
    )


@query(
    "minute_gap_returns",
    f"""SELECT symbol, epoch(timestamp_utc)::BIGINT AS ts, trading_date, {r('close', 'close')},
        volume, {r('return_1m', 'return_1m')}, missing_minutes_before FROM t_returns""",
)
def minute_gap_returns(spark, folder):
    return tidy(
        src.minute_returns(spark, folder).select(
            "symbol", F.unix_timestamp("timestamp_utc").alias("ts"), "trading_date", "close",
            "volume", "return_1m", "missing_minutes_before",
        )
    )


@query(
    "session_bars_from_minutes",
    f"""SELECT *, {r('close0 / lag(close0) OVER (PARTITION BY symbol ORDER BY trading_date) - 1',
                     'close_to_close_return')}, {r('close0', 'close')}
        FROM (SELECT symbol, trading_date, {r('first(open ORDER BY timestamp_utc)', 'open')},
              {r('max(high)', 'high')}, {r('min(low)', 'low')},
              last(close ORDER BY timestamp_utc) AS close0, CAST(sum(volume) AS BIGINT) AS volume,
              CAST(count(*) AS BIGINT) AS observed_minutes,
              CAST(sum(missing_minutes_before) AS BIGINT) AS missing_minutes,
              {r('sqrt(coalesce(sum(return_1m * return_1m), 0))', 'realized_volatility_1m')},
              epoch(max(timestamp_utc))::BIGINT AS close_ts
              FROM t_returns GROUP BY symbol, trading_date)""".replace(
        "SELECT *,", "SELECT * EXCLUDE (close0),", 1
    ),
)
def session_bars_from_minutes(spark, folder):
    bars = cal.session_from_minutes(src.minute_returns(spark, folder))
    return tidy(
        bars.withColumn("close_ts", F.unix_timestamp("session_close_utc")).drop(
            "session_open_utc", "session_close_utc"
        )
    )


@query(
    "panel_quality_summary",
    f"""SELECT symbol, CAST(count(*) AS BIGINT) AS rows_seen,
        CAST(count(DISTINCT trading_date) AS BIGINT) AS sessions,
        epoch(min(timestamp_utc))::BIGINT AS first_ts, epoch(max(timestamp_utc))::BIGINT AS last_ts,
        CAST(count(*) - count(DISTINCT timestamp_utc) AS BIGINT) AS duplicate_keys,
        CAST(count(*) FILTER (missing_minutes_before > 0) AS BIGINT) AS gap_events,
        CAST(sum(missing_minutes_before) AS BIGINT) AS missing_minutes,
        {r('100.0 * count(return_1m) / count(*)', 'return_coverage_pct', 4)}
        FROM t_returns GROUP BY symbol""",
)
def panel_quality_summary(spark, folder):
    from tidepanel.operators.quality import panel_summary

    out = panel_summary(src.minute_returns(spark, folder))
    return tidy(
        out.withColumns(
            {
                "first_ts": F.unix_timestamp("first_timestamp"),
                "last_ts": F.unix_timestamp("last_timestamp"),
            }
        ).drop("first_timestamp", "last_timestamp"),
        4,
    )


def _clock_bar_query(minutes):
    @query(
        f"session_clock_bars_{minutes}m",
        f"""SELECT symbol, trading_date, session_bucket, epoch(timestamp_utc)::BIGINT AS ts,
            {r('open', 'open')}, {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')},
            volume, minute_count, {r('"return"', 'bar_to_bar_return')} FROM t_bars{minutes}""",
    )
    def session_clock_bars(spark, folder):
        return tidy(
            src.clock_bars(spark, folder, minutes).select(
                "symbol", "trading_date", "session_bucket",
                F.unix_timestamp("timestamp_utc").alias("ts"), "open", "high", "low", "close",
                "volume", "minute_count", F.col("return").alias("bar_to_bar_return"),
            )
        )


for _minutes in (15, 30, 60, 240):
    _clock_bar_query(_minutes)


@query(
    "utc_hour_bars",
    f"""SELECT symbol, trading_date, epoch(hour_start_utc)::BIGINT AS hour_ts, {r('open', 'open')},
        {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, volume, observed_minutes,
        epoch(available)::BIGINT AS available_ts FROM t_hour""",
)
def utc_hour_bars(spark, folder):
    bars = cal.hour_bars(src.minute_bars(spark, folder))
    return tidy(
        bars.withColumns(
            {
                "hour_ts": F.unix_timestamp("hour_start_utc"),
                "available_ts": F.unix_timestamp("feature_available_at_utc"),
            }
        ).drop("hour_start_utc", "feature_available_at_utc")
    )


@query(
    "plain_hour_bars",
    f"""SELECT symbol, epoch(timestamp_utc)::BIGINT AS ts, {r('open', 'open')},
        {r('high', 'high')}, {r('low', 'low')}, {r('close', 'close')}, volume FROM t_plain_hour""",
)
def plain_hour_bars(spark, folder):
    bars = cal.plain_hour_bars(src.minute_bars(spark, folder))
    return tidy(
        bars.withColumn("ts", F.unix_timestamp("timestamp_utc")).drop("timestamp_utc")
    )


@query(
    "running_session_state",
    f"""SELECT symbol, epoch(timestamp_utc)::BIGINT AS ts, session_minute, time_quartile,
        {r('mid / close', 'midpoint_to_close')}, {r('loc', 'range_location')},
        CAST(CASE WHEN loc IS NOT NULL
             THEN least(greatest(ceil(least(greatest(loc, 0), 1) * 4), 1), 4) END AS INTEGER)
          AS range_quartile,
        {r('close / vwap - 1', 'vwap_deviation')},
        {r('close / session_open - 1', 'open_deviation')}, {r('r5', 'return_5m')},
        {r('span / session_open', 'running_range_fraction')}, cumulative_volume
        FROM (SELECT *, (hi + lo) / 2 AS mid, nullif(hi - lo, 0) AS span,
                     (close - lo) / nullif(hi - lo, 0) AS loc, amount / cumulative_volume AS vwap
              FROM (SELECT *, max(high) OVER run AS hi, min(low) OVER run AS lo,
                           CAST(sum(volume) OVER run AS BIGINT) AS cumulative_volume,
                           sum((high + low + close) / 3 * volume) OVER run AS amount,
                           first_value(open) OVER run AS session_open,
                           close / lag(close, 5) OVER w - 1 AS r5,
                           CAST(sm AS BIGINT) AS session_minute,
                           CAST(least(sm // 345, 3) + 1 AS INTEGER) AS time_quartile
                    FROM (SELECT *, (hour(local_time) * 60 + minute(local_time) - 1080 + 1440)
                                    % 1440 AS sm FROM t_minute)
                    WINDOW w AS (PARTITION BY symbol, trading_date ORDER BY timestamp_utc),
                           run AS (PARTITION BY symbol, trading_date ORDER BY timestamp_utc
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))""",
)
def running_session_state(spark, folder):
    out = cal.running_session_state(src.minute_bars(spark, folder))
    return tidy(
        out.select(
            "symbol", F.unix_timestamp("timestamp_utc").alias("ts"),
            F.col("session_minute").cast("long").alias("session_minute"), "time_quartile",
            (F.col("running_midpoint") / F.col("close")).alias("midpoint_to_close"),
            "range_location", "range_quartile", "vwap_deviation", "open_deviation", "return_5m", "running_range_fraction",
            "cumulative_volume",
        )
    )


# Clock windows (New York minutes) and their minimum bar counts.
MINIMUM_BARS = {"overnight": 30, "eu_open": 7, "pre_open": 10, "open_30": 1, "target": 11}


@query(
    "clock_window_summary",
    "SELECT symbol, trading_date, "
    + ", ".join(
        f"{r(f'CASE WHEN {n}_n >= {m} THEN {n}_p - 1 END', f'{n}_return')}, "
        f"{r(f'CASE WHEN {n}_n >= {m} THEN {n}_s END', f'{n}_volatility')}, "
        f"CASE WHEN {n}_n >= {m} THEN {n}_v END AS {n}_volume, "
        f"CASE WHEN {n}_n >= {m} THEN {n}_n END AS {n}_bars"
        for n, m in MINIMUM_BARS.items()
    )
    + " FROM t_clock_windows",
)
def clock_window_summary(spark, folder):
    from tidepanel.operators.signals import clock_masks

    masks = {n: (m, MINIMUM_BARS[n]) for n, m in clock_masks("timestamp_utc").items()}
    return tidy(cal.window_summary(src.clock_bars(spark, folder, 15), masks))


from tidepanel.registry.base import shared  # noqa: E402

shared(
    t_clock15="""
SELECT *, hour(lt) * 60 + minute(lt) AS lm
FROM (SELECT *, timezone('America/New_York', timezone('UTC', timestamp_utc)) AS lt FROM t_bars15)
""",
    t_clock_windows="SELECT symbol, trading_date, "
    + ", ".join(
        f"product(1 + bar_return) FILTER ({c}) AS {n}_p, stddev_samp(bar_return) FILTER ({c}) "
        f"AS {n}_s, CAST(sum(volume) FILTER ({c}) AS BIGINT) AS {n}_v, "
        f"CAST(count(*) FILTER ({c}) AS BIGINT) AS {n}_n"
        for n, c in {
            "overnight": "lm >= 1080 OR lm < 570",
            "eu_open": "lm >= 1410 OR lm < 210",
            "pre_open": "lm >= 210 AND lm < 570",
            "open_30": "lm >= 570 AND lm < 600",
            "target": "lm >= 600 AND lm < 960",
        }.items()
    )
    + " FROM t_clock15 GROUP BY symbol, trading_date",
)


@query(
    "daily_sum_on_calendar",
    f"""SELECT s.symbol, d.trading_date, {r('coalesce(v, 0)', 'total')},
        {r('coalesce(c, 0)', 'compounded')}
        FROM (SELECT DISTINCT symbol FROM t_order_panel) s
        CROSS JOIN (SELECT DISTINCT trading_date FROM t_panel) d
        LEFT JOIN (SELECT symbol, trading_date, sum(close / open - 1) AS v,
                          product(close / open) - 1 AS c
                   FROM t_order_panel GROUP BY 1, 2) o
          ON o.symbol = s.symbol AND o.trading_date = d.trading_date""",
)
def daily_sum_on_calendar(spark, folder):
    change = F.col("close") / F.col("open") - 1.0
    daily = (
        src.order_panel(spark, folder)
        .groupBy("symbol", "trading_date")
        .agg(F.sum(change).alias("total"), (F.product(change + 1.0) - 1.0).alias("compounded"))
    )
    days = src.table(spark, folder, "lineitem").join(
        src.table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"), "left_semi"
    )
    out = cal.fill_calendar(
        daily, days.select(F.to_date("l_shipdate").alias("trading_date")), "total"
    )
    return tidy(out.withColumn("compounded", F.coalesce("compounded", F.lit(0.0))))


@query(
    "session_bar_ordinals",
    f"""SELECT symbol, epoch(timestamp_utc)::BIGINT AS ts, CAST(o AS INTEGER) AS ordinal,
        CAST(n - o - 1 AS INTEGER) AS reverse_ordinal, n - o = 3 AS preclose,
        {r('p', 'previous_close')}, {r('x', 'next_open')}
        FROM (SELECT *, row_number() OVER w - 1 AS o, lag(close) OVER w AS p,
                     lead(open) OVER w AS x,
                     count(*) OVER (PARTITION BY symbol, trading_date) AS n FROM t_bars60
              WINDOW w AS (PARTITION BY symbol, trading_date ORDER BY session_bucket))""",
)
def session_bar_ordinals(spark, folder):
    w = Window.partitionBy("symbol", "trading_date").orderBy("timestamp_utc")
    out = cal.bar_ordinals(src.clock_bars(spark, folder, 60)).withColumns(
        {
            "preclose": cal.preclose_flag(),
            "previous_close": cal.in_session_lag("close"),
            "next_open": F.lead("open").over(w),
        }
    )
    return tidy(
        out.select(
            "symbol", F.unix_timestamp("timestamp_utc").alias("ts"), "ordinal",
            "reverse_ordinal", "preclose", "previous_close", "next_open",
        )
    )


@query(
    "day_shifted_values",
    f"""SELECT h.symbol, epoch(h.timestamp_utc)::BIGINT AS ts, {r('a.o', 'open_3d')},
        {r('b.h', 'high_2d')}, {r('b.l', 'low_2d')}
        FROM t_plain_hour h
        LEFT JOIN t_daily a ON a.symbol = h.symbol AND a.day = CAST(h.timestamp_utc AS DATE) - 3
        LEFT JOIN t_daily b ON b.symbol = h.symbol AND b.day = CAST(h.timestamp_utc AS DATE) - 2""",
)
def day_shifted_values(spark, folder):
    bars = cal.plain_hour_bars(src.minute_bars(spark, folder))
    out = cal.daily_value(bars, "open", "first", 3, "open_3d")
    out = cal.daily_value(out, "high", "max", 2, "high_2d")
    out = cal.daily_value(out, "low", "min", 2, "low_2d")
    return tidy(
        out.select(
            "symbol", F.unix_timestamp("timestamp_utc").alias("ts"), "open_3d", "high_2d",
            "low_2d",
        )
    )


shared(
    t_daily="""
SELECT symbol, CAST(timestamp_utc AS DATE) AS day, first(open ORDER BY timestamp_utc) AS o,
       max(high) AS h, min(low) AS l FROM t_plain_hour GROUP BY 1, 2
"""
)


@query(
    "union_calendar_alignment",
    f"""SELECT symbol, trading_date, cal, {r('x', 'return_two_steps_back')},
        {r('CASE WHEN n >= 3 THEN m END', 'mean_10_steps')}
        FROM (SELECT *, lag(ret, 2) OVER w AS x,
                     avg(ret) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m,
                     count(ret) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS n
              FROM (SELECT s.symbol, c.trading_date, c.cal, o.close / o.open - 1 AS ret,
                           o.symbol IS NOT NULL AS printed
                    FROM (SELECT DISTINCT symbol FROM t_order_panel) s
                    CROSS JOIN t_order_cal c
                    LEFT JOIN t_order_panel o
                      ON o.symbol = s.symbol AND o.trading_date = c.trading_date)
              WINDOW w AS (PARTITION BY symbol ORDER BY cal))
        WHERE printed""",
)
def union_calendar_alignment(spark, folder):
    from tidepanel.functions import frames

    panel = cal.number_calendar(src.order_panel(spark, folder), "trading_date").withColumn(
        "ret", F.col("close") / F.col("open") - 1.0
    )
    return tidy(
        panel.select(
            "symbol", "trading_date", "cal",
            frames.step_lag("ret", "symbol", "cal", 2).alias("return_two_steps_back"),
            frames.steps("symbol", "cal", 10, 3).mean("ret").alias("mean_10_steps"),
        )
    )


shared(
    t_order_cal="""
SELECT trading_date, CAST(row_number() OVER (ORDER BY trading_date) AS INTEGER) AS cal
FROM (SELECT DISTINCT trading_date FROM t_order_panel)
"""
)
