"""Bar files of both layouts, rendered from the event rows, read back and normalized."""

from pyspark.sql import functions as F

from tidepanel.functions.scalars import tidy
from tidepanel.operators import quality as Q
from tidepanel.registry.base import query, r, shared
from tidepanel.session import shared_folder
from tidepanel.sources import bar_files, sinks
from tidepanel.sources import tables as src

AS_OF = 2026
TAB_HEADER = "-Ticker\tDate Time\tOpen\tHigh\tLow\tLast\tVolume\tOpen Interest"
COMMA_HEADER = "Date,Time,Open,High,Low,Close,Volume"


def rendered_files(spark, folder):
    """A text file for each event type and day; clicks and views in the comma layout, the rest in the tab one.

    The last digit of the day decides which fault every seventh row of its files has.
    """
    e = src.table(spark, folder, "events").withColumn("stamp", F.col("ts").cast("timestamp"))
    comma = F.col("event_type").isin("click", "view")
    kind = F.dayofmonth("stamp") % 10
    hit = F.col("event_id") % 7 == 0
    fault = F.when(hit, kind).otherwise(0)
    e = e.withColumn("day", F.to_date("stamp")).withColumn("fault", fault).withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.when(F.col("fault").isin(6, 8), 1).otherwise(0))))
    symbol = F.when(comma, F.upper("event_type")).otherwise(F.concat(F.upper("event_type"), F.lit("U6")))
    moved = F.when(F.col("fault") == 9, F.col("stamp") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("stamp"))
    other = F.col("fault").eqNullSafe(8) & (F.col("copy") == 1)
    day = F.when(F.col("fault") == 2, "n/a").otherwise(F.date_format(moved, "yyyy-MM-dd"))
    clock = F.concat(F.when(other, F.date_format(moved, "HH:mm:ss.SSSSSS'0'")).otherwise(F.date_format(moved, "HH:mm:ss.SSSSSS")),
                     F.when(F.col("fault") == 7, "+02:00").otherwise(""))
    price = F.col("value") + 100
    last = F.when(F.col("fault") == 5, "x").otherwise(price.cast("string"))
    low = F.when(F.col("fault") == 4, "0").otherwise((price - 1).cast("string"))
    volume = F.when(F.col("fault") == 3, "-5").otherwise((F.col("user_id") % 7).cast("string"))
    high = (price + 1).cast("string")
    interest = F.when(F.col("event_type") == "error", "0").otherwise((F.col("user_id") % 3 + 1).cast("string"))
    tab = F.concat_ws("\t", symbol, F.concat_ws(" ", day, clock), price.cast("string"), high, low, last, volume, interest)
    line = F.when(F.col("fault") == 1, F.when(comma, COMMA_HEADER).otherwise(TAB_HEADER)).when(
        comma, F.concat_ws(",", day, clock, price.cast("string"), high, low, last, volume)).otherwise(tab)
    rows = e.select(F.concat_ws("_", symbol, F.date_format("day", "yyyyMMdd")).alias("source_file"),
                    F.struct("ts", "event_id", "copy").alias("at"), line.alias("value"), comma.alias("comma"))
    first = rows.select("source_file", "comma").distinct().select(
        "source_file", F.lit(None).cast(rows.schema["at"].dataType).alias("at"),
        F.when(F.col("comma"), COMMA_HEADER).otherwise(TAB_HEADER).alias("value"))
    root = shared_folder(spark, "bar-files")
    (rows.select("source_file", "at", "value").unionByName(first).repartition("source_file")
     .sortWithinPartitions("source_file", F.asc_nulls_first("at")).select("source_file", "value")
     .write.partitionBy("source_file").text(root))
    return root


shared(
    t_filed="""
SELECT *, upper(event_type) || CASE WHEN comma THEN '' ELSE 'U6' END AS symbol,
       upper(event_type) || CASE WHEN comma THEN '' ELSE 'U6' END || '_' || strftime(ts, '%Y%m%d') AS source_file,
       CASE WHEN fault = 9 THEN ts - INTERVAL 1 DAY WHEN fault <> 2 THEN ts END AS stamp,
       CASE WHEN fault = 7 THEN ts - INTERVAL 2 HOUR WHEN fault = 9 THEN ts - INTERVAL 1 DAY WHEN fault <> 2 THEN ts END AS parsed
FROM (SELECT e.*, copy, event_type IN ('click', 'view') AS comma,
             CASE WHEN event_id % 7 = 0 THEN day(ts) % 10 ELSE 0 END AS fault
      FROM events e, (SELECT unnest([0, 1]) AS copy)
      WHERE copy = 0 OR (event_id % 7 = 0 AND day(ts) % 10 IN (6, 8)))
""",
    t_filed_data="SELECT * FROM t_filed WHERE fault <> 1",
    t_manifest="""
SELECT *, CASE WHEN coalesce(rows_seen, 0) = 0 THEN 'rejected'
               WHEN embedded_headers + invalid_timestamps + out_of_order + exact_duplicate_rows + duplicate_symbol_timestamp
                    + invalid_numeric_values + invalid_ohlc + constant_price_series > 0 THEN 'quarantined'
               WHEN zoned_timestamps + nonpositive_prices + negative_volume + utc_collisions > 0 THEN 'rejected'
               ELSE 'normalized' END AS status
FROM (SELECT source_file, CASE WHEN any_value(comma) THEN 'bar_comma' ELSE 'bar_tab' END AS layout, any_value(comma) AS is_comma,
             count(*) FILTER (fault = 1) AS embedded_headers, count(*) FILTER (fault <> 1) AS rows_seen,
             count(*) FILTER (fault = 2) AS invalid_timestamps, count(*) FILTER (fault = 7) AS zoned_timestamps,
             count(*) FILTER (fault = 5) AS invalid_numeric_values, count(*) FILTER (fault = 4) AS nonpositive_prices,
             count(*) FILTER (fault = 3) AS negative_volume, 0 AS invalid_ohlc,
             (count(DISTINCT CASE WHEN fault NOT IN (1, 5) THEN value END) <= 1)::BIGINT AS constant_price_series
      FROM t_filed GROUP BY source_file)
JOIN (SELECT source_file, count(*) FILTER (parsed < before) AS out_of_order
      FROM (SELECT source_file, parsed, lag(parsed) OVER (PARTITION BY source_file ORDER BY ts, event_id, copy) AS before FROM t_filed_data)
      GROUP BY source_file) USING (source_file)
JOIN (SELECT source_file, CAST(sum(n - d) AS BIGINT) AS exact_duplicate_rows, CAST(sum(n - k) AS BIGINT) AS duplicate_symbol_timestamp,
             CAST(sum(CASE WHEN stamp IS NOT NULL THEN n - 1 ELSE 0 END) AS BIGINT) AS utc_collisions
      FROM (SELECT source_file, parsed AS stamp, count(*) AS n, count(DISTINCT (fault = 8 AND copy = 1, value, user_id, fault)) AS d,
                   count(DISTINCT (fault = 8 AND copy = 1, fault = 7)) AS k
            FROM t_filed_data GROUP BY source_file, parsed, CASE WHEN fault = 2 THEN ts END) GROUP BY source_file) USING (source_file)
""",
)

COUNTS = ("rows_seen", "embedded_headers", "invalid_timestamps", "zoned_timestamps", "out_of_order", "exact_duplicate_rows",
          "duplicate_symbol_timestamp", "utc_collisions", "invalid_numeric_values", "nonpositive_prices", "negative_volume")


@query(
    "bar_file_manifest",
    "SELECT source_file, layout, status, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in COUNTS) + " FROM t_manifest",
)
def bar_file_manifest(spark, folder):
    _, report = bar_files.normalize(spark, rendered_files(spark, folder), AS_OF)
    return report.select("source_file", "layout", "status", *[F.col(c).cast("long").alias(c) for c in COUNTS])


@query(
    "normalized_bars",
    f"""SELECT symbol, CASE WHEN comma THEN symbol ELSE upper(event_type) END AS root_symbol,
               CASE WHEN NOT comma THEN 'U' END AS contract_month_code, CASE WHEN NOT comma THEN 2026 END AS contract_year,
               ts AS timestamp_local, CASE WHEN comma THEN ts ELSE ts + INTERVAL 5 HOUR END AS timestamp_utc,
               {r('value + 100', 'open')}, {r('value + 101', 'high')}, {r('value + 99', 'low')}, {r('value + 100', 'close')},
               {r('user_id % 7', 'volume')},
               round(CASE WHEN NOT comma AND event_type <> 'error' THEN CAST(user_id % 3 + 1 AS DOUBLE) END, 6) + 0.0 AS open_interest,
               source_file
        FROM t_filed_data JOIN (SELECT source_file FROM t_manifest WHERE status = 'normalized') USING (source_file)""",
)
def normalized_bars(spark, folder):
    bars, _ = bar_files.normalize(spark, rendered_files(spark, folder), AS_OF)
    return tidy(bars.drop("source_sha256").withColumn("timestamp_local", F.col("timestamp_local").cast("timestamp_ntz"))
                .withColumn("timestamp_utc", F.col("timestamp_utc").cast("timestamp_ntz")))


@query(
    "shared_payload_members",
    """SELECT sha256, count(*) AS files, list(file ORDER BY file) AS members
       FROM (SELECT CAST(page_id AS VARCHAR) AS file, sha256(regexp_extract(url, '^[a-z]+://[^/]+')) AS sha256 FROM pages)
       GROUP BY sha256 HAVING count(*) > 1""",
)
def shared_payload_members(spark, folder):
    files = src.table(spark, folder, "pages").select(
        F.col("page_id").cast("string").alias("source_file"),
        F.sha2(F.regexp_extract("url", "^[a-z]+://[^/]+", 0), 256).alias("sha256"))
    return Q.shared_payloads(files).groupBy("sha256", "files").agg(
        F.array_sort(F.flatten(F.collect_list("members"))).alias("members"))


@query(
    "written_catalog",
    """SELECT 'manifest' AS part, source_file, status AS value, CAST(rows_seen AS BIGINT) AS n FROM t_manifest
       UNION ALL SELECT 'issues', source_file, code, n FROM (
         SELECT source_file, unnest(['embedded_headers', 'invalid_timestamps', 'out_of_order', 'exact_duplicate_rows', 'duplicate_symbol_timestamp',
                                     'invalid_numeric_values', 'constant_price_series']) AS code,
                unnest([embedded_headers, invalid_timestamps, out_of_order, exact_duplicate_rows, duplicate_symbol_timestamp,
                        invalid_numeric_values, constant_price_series]) AS n FROM t_manifest) WHERE n > 0
       UNION ALL SELECT 'issues', source_file, 'short_history', 1 FROM t_manifest
       UNION ALL SELECT 'issues', source_file, 'open_interest_unavailable', n FROM (
         SELECT source_file, count(*) FILTER (fault <> 1) AS n FROM t_filed WHERE event_type = 'error' GROUP BY source_file)
       UNION ALL SELECT 'summary', NULL, 'files', count(*) FROM t_manifest""",
)
def written_catalog(spark, folder):
    """The catalog of the rendered files, written as a version and read back."""
    _, report = bar_files.normalize(spark, rendered_files(spark, folder), AS_OF)
    issues = Q.issues_from_profile(report)
    root = shared_folder(spark, "catalog")
    sinks.write_catalog(report, issues, root)
    files, kept, total = (sinks.read_swapped(spark, root, n) for n in ("manifest", "issues", "summary"))
    row = ["part", "source_file", "value", "n"]
    return (
        files.select(F.lit("manifest").alias("part"), "source_file", F.col("status").alias("value"), F.col("rows_seen").alias("n"))
        .unionByName(kept.select(F.lit("issues").alias("part"), "source_file", F.col("code").alias("value"), F.col("issue_count").alias("n")))
        .unionByName(total.select(F.lit("summary").alias("part"), F.lit(None).cast("string").alias("source_file"),
                                  F.lit("files").alias("value"), F.col("files").alias("n"))).select(*row))


@query(
    "written_variants",
    f"""SELECT strategy, family, CAST(count(*) AS BIGINT) AS days, {r('sum(gross)', 'gross', 5)}, {r('sum(net)', 'net', 5)},
               CAST(sum(sides) AS BIGINT) AS sides FROM t_grid GROUP BY strategy, family""",
)
def written_variants(spark, folder):
    """Every rule's series in a directory of its own, written and read back."""
    from tidepanel.registry.evaluate_queries import grid

    root = shared_folder(spark, "variants")
    rows = grid(spark, folder).select("strategy", "family", "trading_date", "gross", "net", "sides")
    sinks.write_variants(rows, root, "family", "strategy")
    kept = sinks.read_swapped(spark, root, "variants")
    return tidy(kept.groupBy("strategy", "family").agg(
        F.count(F.lit(1)).alias("days"), F.sum("gross").alias("gross"), F.sum("net").alias("net"),
        F.sum("sides").cast("long").alias("sides")), 5)


@query(
    "written_labels_and_folds",
    f"""SELECT 'labels' AS part, symbol AS name, CAST(count(x) AS BIGINT) AS n, {r('sum(x)', 'total')}
        FROM (SELECT symbol, ln(lead(close, 5) OVER (PARTITION BY symbol ORDER BY trading_date) / close) AS x FROM t_panel) GROUP BY symbol
        UNION ALL SELECT 'folds', CAST(fold AS VARCHAR), CAST(train_sessions AS BIGINT), CAST(validation_sessions AS DOUBLE) FROM t_folds""",
)
def written_labels_and_folds(spark, folder):
    """Labels and folds, written as one version of two tables and read back."""
    from tidepanel.plans import studies

    root = shared_folder(spark, "labels")
    studies.write_labels_and_folds(src.session_panel(spark, folder), root)
    labels, folds = (sinks.read_swapped(spark, root, n) for n in ("labels", "folds"))
    return tidy(
        labels.groupBy("symbol").agg(F.count("forward_log_return_5s").alias("n"), F.sum("forward_log_return_5s").alias("total"))
        .select(F.lit("labels").alias("part"), F.col("symbol").alias("name"), "n", "total")
        .unionByName(folds.select(F.lit("folds").alias("part"), F.col("fold").cast("string").alias("name"),
                                  F.col("train_sessions").cast("long").alias("n"), F.col("validation_sessions").cast("double").alias("total"))))
