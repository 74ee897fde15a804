"""Quality checks on text renderings of the event rows with faults placed by rule."""

from pyspark.sql import functions as F

from tidepanel.functions.scalars import tidy
from tidepanel.operators import quality as Q
from tidepanel.registry.base import query, r, shared
from tidepanel.sources import sinks
from tidepanel.sources import tables as src


def raw_bars(spark, folder):
    """Event rows as the all-text tab export, with a second copy of some rows."""
    e = src.table(spark, folder, "events").withColumn("price", F.col("value") + 100)
    i = F.col("event_id")
    e = e.withColumn("copy", F.explode(F.sequence(F.lit(0), (i % 97 == 0).cast("int"))))
    stamp = F.date_trunc("minute", F.col("ts").cast("timestamp"))
    stamp = F.when(i % 53 == 0, stamp - F.expr("INTERVAL 1 HOUR")).otherwise(stamp)
    ticker = F.when(i % 101 == 0, "-Ticker").when(i % 499 == 0, " other ").otherwise(
        F.col("event_type")
    )
    ticker = F.when(F.col("event_type") == "view", F.when(i % 101 == 0, "-Ticker").otherwise("views")).otherwise(ticker)
    price = F.col("price")
    return e.select(
        F.concat(F.col("event_type"), F.lit("_Export.txt")).alias("source_file"),
        (i * 2 + F.col("copy")).alias("line"),
        ticker.alias("-Ticker"),
        F.when(i % 103 == 0, "n/a")
        .otherwise(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"))
        .alias("Date Time"),
        price.cast("string").alias("Open"),
        F.when(i % 107 == 0, price - 1).otherwise(price + 1).cast("string").alias("High"),
        (price - 1).cast("string").alias("Low"),
        F.when(i % 109 == 0, "x").otherwise(price.cast("string")).alias("Last"),
        F.when(i % 113 == 0, "-5").otherwise((F.col("user_id") % 7).cast("string")).alias("Volume"),
        F.when(F.col("event_type") == "click", "0")
        .otherwise((F.col("user_id") % 3).cast("string"))
        .alias("Open Interest"),
    )


shared(
    t_raw="""
SELECT event_type || '_Export.txt' AS file, event_id * 2 + copy AS line, event_type,
       CASE WHEN event_id % 101 = 0 THEN '-Ticker' WHEN event_type = 'view' THEN 'views'
            WHEN event_id % 499 = 0 THEN ' other ' ELSE event_type END AS ticker,
       CASE WHEN event_id % 103 = 0 THEN NULL
            WHEN event_id % 53 = 0 THEN date_trunc('minute', ts) - INTERVAL 1 HOUR
            ELSE date_trunc('minute', ts) END AS stamp,
       value + 100 AS o, CASE WHEN event_id % 107 = 0 THEN value + 99 ELSE value + 101 END AS h,
       value + 99 AS l, CASE WHEN event_id % 109 <> 0 THEN value + 100 END AS c,
       CASE WHEN event_id % 113 = 0 THEN -5 ELSE user_id % 7 END AS v,
       CASE WHEN event_type = 'click' THEN 0 ELSE user_id % 3 END AS oi
FROM events, (SELECT unnest([0, 1]) AS copy) WHERE copy = 0 OR event_id % 97 = 0
""",
    t_raw_data="SELECT * FROM t_raw WHERE ticker <> '-Ticker'",
    t_profile="""
SELECT a.*, b.embedded_headers, c.out_of_order, d.exact_duplicate_rows,
       e.duplicate_symbol_timestamp
FROM (SELECT file, count(*) AS rows_seen, min(upper(trim(ticker))) AS symbol,
             (count(DISTINCT upper(trim(ticker))) > 1)::BIGINT AS multiple_symbols_in_file,
             (count(*) FILTER (upper(trim(ticker)) = upper(event_type)) = 0)::BIGINT
               AS filename_symbol_mismatch,
             count(*) FILTER (stamp IS NULL) AS invalid_timestamps,
             count(*) FILTER (c IS NULL) AS invalid_numeric_values,
             count(*) FILTER (h < greatest(o, l, c) OR l > least(o, h, c)) AS invalid_ohlc,
             (count(DISTINCT c) <= 1)::BIGINT AS constant_price_series,
             (max(stamp) - min(stamp) < INTERVAL 30 DAY)::BIGINT AS short_history,
             CASE WHEN max(abs(oi)) = 0 THEN count(*) ELSE 0 END AS open_interest_unavailable
      FROM t_raw_data GROUP BY file) a
JOIN (SELECT file, count(*) FILTER (ticker = '-Ticker') AS embedded_headers
      FROM t_raw GROUP BY file) b USING (file)
JOIN (SELECT file, count(*) FILTER (stamp < p) AS out_of_order
      FROM (SELECT *, lag(stamp) OVER (PARTITION BY file ORDER BY line) AS p FROM t_raw_data)
      GROUP BY file) c USING (file)
JOIN (SELECT file, sum(n - 1) AS exact_duplicate_rows
      FROM (SELECT file, count(*) AS n FROM t_raw_data
            GROUP BY file, ticker, stamp, o, h, l, c, v, oi) GROUP BY file) d USING (file)
JOIN (SELECT file, sum(n - 1) AS duplicate_symbol_timestamp
      FROM (SELECT file, count(*) AS n FROM t_raw_data GROUP BY file, ticker, stamp)
      GROUP BY file) e USING (file)
""",
)

CODES = (
    "embedded_headers", "multiple_symbols_in_file", "filename_symbol_mismatch",
    "invalid_timestamps", "out_of_order", "exact_duplicate_rows", "duplicate_symbol_timestamp",
    "invalid_numeric_values", "invalid_ohlc", "constant_price_series",
    "open_interest_unavailable", "short_history",
)
shared(
    t_issues=" UNION ALL ".join(
        f"SELECT file, '{c}' AS code, CAST({c} AS BIGINT) AS issue_count, "
        f"'{Q.ISSUE_SEVERITY[c]}' AS severity FROM t_profile WHERE {c} > 0"
        for c in CODES
    )
)


@query(
    "bar_file_profile",
    "SELECT file AS source_file, symbol, CAST(rows_seen AS BIGINT) AS rows_seen, "
    + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in CODES)
    + " FROM t_profile",
)
def bar_file_profile(spark, folder):
    out = Q.profile_bar_files(raw_bars(spark, folder), block_rows=1000)
    return out.select(
        "source_file", "symbol", "rows_seen", *[F.col(c).cast("long").alias(c) for c in CODES]
    )


@query("file_issues", "SELECT file AS source_file, code, issue_count, severity FROM t_issues")
def file_issues(spark, folder):
    return Q.issues_from_profile(Q.profile_bar_files(raw_bars(spark, folder)))


@query(
    "file_status_rollup",
    """SELECT f.file AS source_file, CAST(coalesce(n, 0) AS BIGINT) AS issues,
              CAST(coalesce(b, 0) AS BIGINT) AS blocking_issues,
              CASE WHEN b > 0 THEN 'blocked' WHEN n > 0 THEN 'review' ELSE 'ready' END AS status
       FROM (SELECT DISTINCT file FROM t_raw) f
       LEFT JOIN (SELECT file, count(*) AS n,
                         count(*) FILTER (severity IN ('critical', 'high')) AS b
                  FROM t_issues WHERE code IN ('short_history', 'open_interest_unavailable',
                                               'filename_symbol_mismatch')
                  GROUP BY file) USING (file)""",
)
def file_status_rollup(spark, folder):
    raw = raw_bars(spark, folder)
    issues = Q.issues_from_profile(Q.profile_bar_files(raw)).filter(
        F.col("code").isin("short_history", "open_interest_unavailable", "filename_symbol_mismatch")
    )
    return Q.file_status(raw.select("source_file").distinct(), issues)


@query(
    "catalog_severity_summary",
    """SELECT 5::BIGINT AS files, 5::BIGINT AS symbols, CAST(count(*) AS BIGINT) AS issues,
       CAST(count(*) FILTER (severity IN ('critical', 'high')) AS BIGINT) AS blocking_issues,
       CAST(count(*) FILTER (severity = 'critical') AS BIGINT) AS critical,
       CAST(count(*) FILTER (severity = 'high') AS BIGINT) AS high,
       CAST(count(*) FILTER (severity = 'medium') AS BIGINT) AS medium,
       CAST(count(*) FILTER (severity = 'low') AS BIGINT) AS low FROM t_issues""",
)
def catalog_severity_summary(spark, folder):
    raw = raw_bars(spark, folder)
    files = raw.select("source_file").distinct().withColumn("symbol", F.col("source_file"))
    return sinks.catalog_summary(files, Q.issues_from_profile(Q.profile_bar_files(raw)))


@query(
    "cross_file_duplicates",
    """WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS file, sha256(text) AS h, doc_id % 700 AS s FROM documents),
            g AS (SELECT h, count(*) AS n FROM f GROUP BY h HAVING count(*) > 1),
            k AS (SELECT s, count(*) AS n FROM f GROUP BY s HAVING count(*) > 1)
       SELECT file AS source_file, 'duplicate_file_payload' AS code, n - 1 AS issue_count,
              'critical' AS severity FROM f JOIN g USING (h)
       UNION ALL
       SELECT file, 'duplicate_symbol_files', n - 1, 'critical' FROM f JOIN k USING (s)""",
)
def cross_file_duplicates(spark, folder):
    files = src.table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("source_file"),
        F.sha2("text", 256).alias("sha256"),
        (F.col("doc_id") % 700).cast("string").alias("symbol"),
        F.lit("minute_bars").alias("data_kind"),
    )
    return Q.cross_file_issues(files)


@query(
    "quarantine_manifest",
    """SELECT f.file AS source_file, f.kind AS data_kind,
              CASE WHEN b.file IS NOT NULL THEN 'quarantined'
                   WHEN f.kind = 'minute_bars' THEN 'normalized' ELSE 'deferred' END AS status
       FROM (SELECT DISTINCT file,
                    CASE WHEN file = 'error_Export.txt' THEN 'ticks' ELSE 'minute_bars' END AS kind
             FROM t_raw) f
       LEFT JOIN (SELECT DISTINCT file FROM t_issues WHERE severity = 'critical'
                  AND code = 'filename_symbol_mismatch') b USING (file)""",
)
def quarantine_manifest(spark, folder):
    raw = raw_bars(spark, folder)
    files = raw.select("source_file").distinct().withColumn(
        "data_kind",
        F.when(F.col("source_file") == "error_Export.txt", "ticks").otherwise("minute_bars"),
    )
    issues = Q.issues_from_profile(Q.profile_bar_files(raw)).filter(
        F.col("code") == "filename_symbol_mismatch"
    )
    return Q.quarantine(files, issues)


@query(
    "market_data_contract",
    """SELECT CAST(count(*) AS BIGINT) AS rows_seen,
              CAST(count(*) FILTER (stamp IS NULL OR c IS NULL OR ticker IS NULL) AS BIGINT)
                AS null_rows,
              CAST(count(*) FILTER (c <= 100.5) AS BIGINT) AS nonpositive_close,
              CAST(count(*) - (SELECT count(*) FROM
                   (SELECT DISTINCT ticker, stamp FROM t_raw)) AS BIGINT) AS duplicate_keys
       FROM t_raw""",
)
def market_data_contract(spark, folder):
    df = raw_bars(spark, folder).select(
        F.col("-Ticker").alias("symbol"),
        F.expr("try_cast(`Date Time` AS timestamp)").alias("timestamp"),
        (F.col("Last").try_cast("double") - 100.5).alias("close"),
    )
    return Q.validate_market_data(df)


@query(
    "audit_bar_values",
    f"""SELECT file AS source_file, CAST(count(*) FILTER (stamp IS NULL) * 0 AS BIGINT) AS null_cells,
        CAST(count(*) FILTER (o <= 0 OR h <= 0 OR l <= 0 OR c <= 0) AS BIGINT) AS nonpositive_prices,
        CAST(count(*) FILTER (v < 0) AS BIGINT) AS negative_volume,
        CAST(count(*) FILTER (v = 0) AS BIGINT) AS zero_volume,
        {r('100.0 * count(*) FILTER (oi = 0) / count(*)', 'zero_open_interest_pct', 3)},
        any_value(g) AS missing_calendar_minutes
        FROM t_raw_data
        JOIN (SELECT file, CAST(count(*) FILTER (stamp - p > INTERVAL 1 MINUTE) AS BIGINT) AS g
              FROM (SELECT *, lag(stamp) OVER (PARTITION BY file ORDER BY stamp) AS p
                    FROM t_raw_data WHERE stamp IS NOT NULL) GROUP BY file) USING (file)
        GROUP BY file""",
)
def audit_bar_values(spark, folder):
    return tidy(Q.audit_bar_values(raw_bars(spark, folder)), 3)


@query(
    "tick_file_profile",
    """SELECT event_type AS source_file, CAST(count(*) AS BIGINT) AS rows_seen,
       CAST(count(*) FILTER (event_id % 91 = 0) AS BIGINT) AS invalid_numeric_values,
       CAST(count(*) FILTER (user_id % 5 <= 0) AS BIGINT) AS nonpositive_tick_volume,
       CAST(count(*) FILTER (event_id % 91 <> 0 AND (value < bid OR value > ask)) AS BIGINT)
         AS price_outside_quote,
       CAST(count(*) FILTER (bid > ask) AS BIGINT) AS crossed_quotes,
       CAST(count(*) FILTER (event_id % 91 <> 0 AND value <= 0) AS BIGINT) AS nonpositive_prices,
       CAST(max(user_id % 5) AS DOUBLE) AS tickvol_max
       FROM (SELECT *, CASE WHEN event_id % 83 = 0 THEN value + 1 ELSE value - 1 END AS bid,
                    CASE WHEN event_id % 79 = 0 THEN value - 0.5 ELSE value + 1 END AS ask
             FROM events) GROUP BY event_type""",
)
def tick_file_profile(spark, folder):
    i = F.col("event_id")
    v = F.col("value")
    ticks = src.table(spark, folder, "events").select(
        F.col("event_type").alias("source_file"),
        F.col("event_type").alias("-SYMBOL"),
        F.col("ts").cast("string").alias("DATE"),
        F.when(i % 91 == 0, "bad").otherwise(v.cast("string")).alias("PRICE"),
        (F.col("user_id") % 5).cast("string").alias("TICKVOL"),
        F.when(i % 83 == 0, v + 1).otherwise(v - 1).cast("string").alias("BID"),
        F.when(i % 79 == 0, v - 0.5).otherwise(v + 1).cast("string").alias("ASK"),
    )
    return tidy(Q.profile_tick_files(ticks))


@query(
    "all_zero_column_to_null",
    """SELECT event_type, CAST(count(*) AS BIGINT) AS rows_seen,
       CASE WHEN event_type = 'click' THEN 0 ELSE CAST(count(*) AS BIGINT) END AS kept
       FROM events GROUP BY event_type""",
)
def all_zero_column_to_null(spark, folder):
    df = src.table(spark, folder, "events").select(
        "event_type",
        F.when(F.col("event_type") == "click", 0.0)
        .otherwise(F.col("user_id") % 3)
        .cast("double")
        .alias("open_interest"),
    )
    return (
        Q.null_if_all_zero(df, "open_interest", "event_type")
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("rows_seen"), F.count("open_interest").alias("kept"))
    )


@query(
    "normalization_rejects",
    """SELECT a.*, b.utc_collisions FROM
       (SELECT l_returnflag AS source_file,
               CAST(count(*) FILTER (l_discount <= 0 OR l_extendedprice <= 0) AS BIGINT)
                 AS nonpositive_prices,
               CAST(count(*) FILTER (l_quantity - 2 < 0) AS BIGINT) AS negative_volume,
               CAST(min(l_linestatus) <> max(l_linestatus) AS INTEGER) AS changed_identity
        FROM lineitem GROUP BY l_returnflag) a
       JOIN (SELECT l_returnflag AS source_file,
                    CAST(count(*) - count(DISTINCT (l_linestatus, l_shipdate)) AS BIGINT)
                      AS utc_collisions FROM lineitem GROUP BY l_returnflag) b USING (source_file)""",
)
def normalization_rejects(spark, folder):
    df = src.table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("source_file"),
        F.col("l_linestatus").alias("symbol"),
        F.col("l_shipdate").alias("timestamp_utc"),
        F.col("l_extendedprice").alias("open"),
        F.col("l_extendedprice").alias("high"),
        F.col("l_discount").alias("low"),
        F.col("l_extendedprice").alias("close"),
        (F.col("l_quantity") - 2).alias("volume"),
    )
    return Q.normalization_rejects(df)


@query(
    "mean_of_registered_frame",
    f"SELECT {r('avg(close_to_close_return)', 'average_return', 8)} FROM t_panel",
)
def mean_of_registered_frame(spark, folder):
    src.session_panel(spark, folder).createOrReplaceTempView("sample_returns")
    return spark.sql(
        "SELECT round(avg(close_to_close_return), 8) + 0.0D AS average_return FROM sample_returns"
    )


@query(
    "payload_fingerprints",
    """SELECT page_id, sha256(html) AS sha256, CAST(strlen(html) AS BIGINT) AS size_bytes
       FROM pages""",
)
def payload_fingerprints(spark, folder):
    return src.table(spark, folder, "pages").select(
        "page_id",
        F.sha2("html", 256).alias("sha256"),
        F.octet_length("html").cast("long").alias("size_bytes"),
    )
