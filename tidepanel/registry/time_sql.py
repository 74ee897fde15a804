"""SQL fragments for the derived base tables."""

from tidepanel.registry.base import shared

shared(
    t_quotes="""
SELECT p_type AS symbol, CAST(l_shipdate AS DATE) AS trading_date,
       l_orderkey AS k1, l_linenumber AS k2,
       100.0 + floor(ln(1 + l_extendedprice / l_quantity) * 100000) / 100000.0 AS price,
       l_quantity AS volume
FROM lineitem JOIN part ON l_partkey = p_partkey
""",
    t_session="""
SELECT symbol, trading_date,
       first(price ORDER BY k1, k2, price) AS open, max(price) AS high, min(price) AS low,
       last(price ORDER BY k1, k2, price) AS close, sum(volume) AS volume,
       CAST(count(*) AS BIGINT) AS observations,
       sqrt(avg((price / 107.5 - 1) * (price / 107.5 - 1))) AS realized_volatility_1m
FROM t_quotes GROUP BY symbol, trading_date
""",
    t_panel="""
SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY trading_date) - 1
         AS close_to_close_return,
       trading_date + INTERVAL 22 HOUR AS session_close_utc
FROM t_session
""",
    t_orders="""
SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS trading_date,
       100.0 + floor(ln(1 + o_totalprice) * 100000) / 100000.0 AS price, o_orderkey AS k1
FROM orders
""",
    t_order_panel="""
SELECT symbol, trading_date,
       first(price ORDER BY k1, price) AS open, max(price) AS high, min(price) AS low,
       last(price ORDER BY k1, price) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM t_orders GROUP BY symbol, trading_date
""",
    t_ticks="""
SELECT event_type AS symbol, date_trunc('minute', ts) AS minute_start, ts,
       100.0 + floor(ln(1 + value) * 100000) / 100000.0 AS price, user_id % 100 + 1 AS volume
FROM events
""",
    t_minute0="""
SELECT symbol, minute_start AS timestamp_utc,
       first(price ORDER BY ts, price) AS open, max(price) AS high, min(price) AS low,
       last(price ORDER BY ts, price) AS close, CAST(sum(volume) AS BIGINT) AS volume,
       timezone('America/New_York', timezone('UTC', minute_start)) AS local_time
FROM t_ticks GROUP BY symbol, minute_start
""",
    t_minute="""
SELECT * EXCLUDE (local_time), local_time,
       CAST(local_time AS DATE) + CAST(hour(local_time) >= 18 AS INTEGER) AS trading_date
FROM t_minute0
""",
    t_returns="""
SELECT *, CASE WHEN date_diff('second', prev_ts, timestamp_utc) = 60
               THEN close / prev_close - 1 END AS return_1m,
       CAST(coalesce(date_diff('second', prev_ts, timestamp_utc) // 60 - 1, 0) AS BIGINT)
         AS missing_minutes_before
FROM (SELECT *, lag(timestamp_utc) OVER w AS prev_ts, lag(close) OVER w AS prev_close
      FROM t_minute WINDOW w AS (PARTITION BY symbol, trading_date ORDER BY timestamp_utc))
""",
    t_anchor="""
SELECT *, timezone('UTC', timezone('America/New_York', CAST(trading_date AS TIMESTAMP)))
          - INTERVAL 6 HOUR AS anchor
FROM t_minute
""",
)

for _minutes in (15, 30, 60, 240):
    shared(
        **{
            f"t_bars{_minutes}": f"""
SELECT *, close / lag(close) OVER (PARTITION BY symbol, trading_date ORDER BY session_bucket) - 1
         AS "return", close / open - 1 AS bar_return
FROM (SELECT symbol, trading_date, session_bucket, min(bar_start) AS timestamp_utc,
             first(open ORDER BY timestamp_utc) AS open, max(high) AS high, min(low) AS low,
             last(close ORDER BY timestamp_utc) AS close,
             CAST(sum(volume) AS BIGINT) AS volume, CAST(count(*) AS BIGINT) AS minute_count
      FROM (SELECT *, anchor + session_bucket * INTERVAL {_minutes} MINUTE AS bar_start
            FROM (SELECT *, CAST(date_diff('second', anchor, timestamp_utc)
                                 // ({_minutes} * 60) AS INTEGER) AS session_bucket
                  FROM t_anchor))
      GROUP BY symbol, trading_date, session_bucket)
"""
        }
    )
shared(
    t_hour="""
SELECT symbol, trading_date, date_trunc('hour', timestamp_utc) AS hour_start_utc,
       first(open ORDER BY timestamp_utc) AS open, max(high) AS high, min(low) AS low,
       last(close ORDER BY timestamp_utc) AS close, CAST(sum(volume) AS BIGINT) AS volume,
       CAST(count(*) AS BIGINT) AS observed_minutes, max(timestamp_utc) AS available
FROM t_minute GROUP BY symbol, trading_date, date_trunc('hour', timestamp_utc)
""",
    t_plain_hour="""
SELECT symbol, date_trunc('hour', timestamp_utc) AS timestamp_utc,
       first(open ORDER BY timestamp_utc) AS open, max(high) AS high, min(low) AS low,
       last(close ORDER BY timestamp_utc) AS close, CAST(sum(volume) AS BIGINT) AS volume
FROM t_minute GROUP BY 1, 2
""",
)
