"""Quality checks, issue roll-up and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions.scalars import all_of, col, sum_of
from tidepanel.operators import calendar as cal
from tidepanel.session import cut_lineage

# Issue severities from worst to least.
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
PRICES = ("open", "high", "low", "close")


def panel_summary(minutes: DataFrame) -> DataFrame:
    """Coverage of each symbol's minute returns; duplicates counted on the full key."""
    per_minute = minutes.groupBy("symbol", "timestamp_utc").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("missing_minutes_before") > 0, 1).otherwise(0)).alias("gaps"),
        F.sum("missing_minutes_before").alias("missing"),
        F.count("return_1m").alias("returns"),
        F.first("trading_date").alias("trading_date"),
    )
    per_session = per_minute.groupBy("symbol", "trading_date").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") - 1).alias("duplicates"),
        F.sum("gaps").alias("gaps"),
        F.sum("missing").alias("missing"),
        F.sum("returns").alias("returns"),
        F.min("timestamp_utc").alias("first"),
        F.max("timestamp_utc").alias("last"),
    )
    return per_session.groupBy("symbol").agg(
        F.sum("n").alias("rows_seen"),
        F.count(F.lit(1)).alias("sessions"),
        F.min("first").alias("first_timestamp"),
        F.max("last").alias("last_timestamp"),
        F.sum("duplicates").alias("duplicate_keys"),
        F.sum("gaps").alias("gap_events"),
        F.sum("missing").alias("missing_minutes"),
        F.round(100.0 * F.sum("returns") / F.sum("n"), 4).alias("return_coverage_pct"),
    )


def validate_market_data(df: DataFrame, key: tuple[str, str] = ("symbol", "timestamp")) -> DataFrame:
    """Counts that must all be zero for a (symbol, timestamp, close) table to be accepted."""
    required = [*key, "close"]
    has_null = ~all_of([F.col(c).isNotNull() for c in required])
    per_key = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(has_null.cast("int")).alias("nulls"),
        F.sum((F.col("close") <= 0).cast("int")).alias("low"),
    )
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_seen"),
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("null_rows"),
        F.coalesce(F.sum("low"), F.lit(0)).alias("nonpositive_close"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_keys"),
    )


def assert_market_data(df: DataFrame, key: tuple[str, str] = ("symbol", "timestamp")) -> DataFrame:
    kinds = dict(df.dtypes)
    if kinds[key[1]] != "timestamp":
        raise ValueError("timestamps must carry a time zone")
    found = validate_market_data(df, key).first()
    broken = [n for n in ("null_rows", "nonpositive_close", "duplicate_keys") if found[n]]
    if broken:
        raise ValueError(f"market data rejected: {broken}")
    return df.orderBy(*key)


def containment_broken(high: Column, low: Column, opened: Column, closed: Column) -> Column:
    """High or low fails to contain the other prices."""
    return (high < F.greatest(opened, low, closed)) | (low > F.least(opened, high, closed))


def drop_embedded_headers(df: DataFrame, name: str) -> DataFrame:
    """Remove rows whose cell repeats its own column name (NULL cells stay)."""
    return df.filter(~F.coalesce(F.col(f"`{name}`") == F.lit(name), F.lit(False)))


def duplicate_rows(df: DataFrame, file: str, columns: list[str], name: str) -> DataFrame:
    """Rows beyond the first of each combination, per file."""
    return (
        df.groupBy(file, *[F.col(f"`{c}`") for c in columns if c != file])
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(file)
        .agg(F.sum(F.col("n") - 1).alias(name))
    )


def _bad_number(raw: Column) -> Column:
    return raw.try_cast("double").isNull()


# A time of day that names its zone or offset.
_ZONED = r"(?i)(Z|UTC|GMT|[+-][0-9]{1,2}(:?[0-9]{2})?)$"


def typed_bars(raw: DataFrame, file: str = "source_file", line: str = "line",
               zone: str | Column = "UTC") -> DataFrame:
    """Typed columns of tab-layout text rows, with the hashes that equal rows and equal keys share.

    ``has_interest`` (optional in ``raw``) tells whether the row's file has open interest at all.
    """
    numbers = {n: F.col(f"`{c}`") for n, c in {
        "open": "Open", "high": "High", "low": "Low", "close": "Last", "volume": "Volume"}.items()}
    interest = F.col("`Open Interest`") if "Open Interest" in raw.columns else F.lit(None).cast("string")
    has = F.col("has_interest") if "has_interest" in raw.columns else F.lit("Open Interest" in raw.columns)
    text = [F.col(f"`{c}`") for c in raw.columns if c not in (file, line, "layout", "has_interest", "zone")]
    stamp = F.expr("try_cast(`Date Time` AS timestamp)")
    local = cal.strict_utc(stamp, zone)
    bad = [_bad_number(c).cast("int") for c in numbers.values()] + [(has & _bad_number(interest)).cast("int")]
    return raw.select(
        F.col(file).alias("source_file"), F.col(line).alias("line"),
        F.coalesce(F.col("`-Ticker`") == "-Ticker", F.lit(False)).alias("is_header"),
        F.upper(F.trim("`-Ticker`")).alias("symbol"), stamp.alias("stamp"),
        F.coalesce(F.regexp_like(F.element_at(F.split(F.trim("`Date Time`"), "[ T]"), -1), F.lit(_ZONED)), F.lit(False))
        .alias("zoned"),
        local["utc"].alias("timestamp_utc"),
        F.coalesce(local["nonexistent"] | local["ambiguous"], F.lit(False)).alias("impossible"),
        *[c.try_cast("double").alias(n) for n, c in numbers.items()],
        interest.try_cast("double").alias("open_interest"), has.alias("has_interest"),
        sum_of(bad).alias("bad_numbers"),
        F.xxhash64("`-Ticker`", "`Date Time`").alias("key_hash"), F.xxhash64(*text).alias("row_hash"),
    )


def profile_typed(typed: DataFrame, block_rows: int = 1_000_000) -> DataFrame:
    """One row of counts per bar file.

    No row is exchanged whole.  Counts are combined where rows are read; the order check exchanges the line
    and time of each row by (file, stretch of lines); and times with the hashes
    of key and row meet by (file, time), which needs no further exchange for equal rows, equal keys and equal times.
    """
    stem = F.upper(F.element_at(F.split(F.regexp_replace("source_file", r"\.[^.]*$", ""), "_"), 1))
    low = F.lit(False)
    for p in PRICES:
        low = low | F.coalesce(F.col(p) <= 0, F.lit(False))
    data = ~F.col("is_header")
    close, time = F.when(data, F.col("close")), F.when(data, F.unix_micros("stamp"))
    interest = F.when(data, F.abs("open_interest"))

    def count(condition: Column, name: str) -> Column:
        return F.count_if(data & condition).alias(name)

    counts = typed.groupBy("source_file").agg(
        F.count_if("is_header").alias("embedded_headers"),
        count(F.lit(True), "rows_seen"),
        F.min(F.when(data, F.col("symbol"))).alias("symbol"),
        F.coalesce((F.min(F.when(data, F.col("symbol"))) != F.max(F.when(data, F.col("symbol")))).cast("int"), F.lit(0))
        .alias("multiple_symbols_in_file"),
        F.coalesce(1 - F.max(F.when(data, (F.col("symbol") == stem).cast("int"))), F.lit(0)).alias("filename_symbol_mismatch"),
        count(F.col("stamp").isNull(), "invalid_timestamps"),
        count(F.col("zoned"), "zoned_timestamps"),
        count(F.col("impossible"), "impossible_times"),
        F.coalesce(F.sum(F.when(data, F.col("bad_numbers"))), F.lit(0)).alias("invalid_numeric_values"),
        count(containment_broken(*(F.col(c) for c in ("high", "low", "open", "close"))), "invalid_ohlc"),
        count(low, "nonpositive_prices"),
        count(F.col("volume") < 0, "negative_volume"),
        F.coalesce((F.min(close) == F.max(close)).cast("int"), F.lit(1)).alias("constant_price_series"),
        F.coalesce((F.max(time) - F.min(time) < 30 * 86_400_000_000).cast("int"), F.lit(1)).alias("short_history"),
        F.when((F.max(interest) == 0) & (F.count(interest) == F.count_if(data)), F.count_if(data))
        .otherwise(0).alias("open_interest_unavailable"),
    )
    cut = typed.where(data).select("source_file", "line", "stamp", F.floor(F.col("line") / block_rows).alias("block"))
    order = Window.partitionBy("source_file", "block").orderBy("line")
    edge = Window.partitionBy("source_file").orderBy("block")
    steps = (
        cut.withColumn("previous", F.lag("stamp").over(order)).groupBy("source_file", "block").agg(
            F.count_if(F.col("stamp") < F.col("previous")).alias("inside"),
            F.min_by("stamp", "line").alias("first"), F.max_by("stamp", "line").alias("last"))
        .withColumn("crossing", (F.col("first") < F.lag("last").over(edge)).cast("int"))
        .groupBy("source_file").agg((F.sum("inside") + F.coalesce(F.sum("crossing"), F.lit(0))).alias("out_of_order"))
    )
    at = F.coalesce(F.unix_micros("timestamp_utc"), F.col("key_hash")).alias("at")
    parsed = F.col("timestamp_utc").isNotNull().alias("parsed")
    times = ["source_file", "symbol", "at", "parsed"]
    thin = typed.where(data).select("source_file", "symbol", at, parsed, "key_hash", "row_hash", F.lit(1).alias("n"))
    thin = thin.repartition(*times)
    same_row = thin.groupBy(*times, "key_hash", "row_hash").agg(F.sum("n").alias("n"))
    same_key = same_row.groupBy(*times, "key_hash").agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("rows"))
    same_time = same_key.groupBy(*times).agg(
        F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.sum(F.col("n") - 1).alias("keys"))
    doubles = same_time.groupBy("source_file").agg(
        F.sum("rows").alias("exact_duplicate_rows"), F.sum("keys").alias("duplicate_symbol_timestamp"),
        F.sum(F.when(F.col("parsed"), F.col("n") - 1).otherwise(0)).alias("utc_collisions"))
    return counts.join(steps, "source_file", "left").join(doubles, "source_file", "left").fillna(
        0, ["out_of_order", "exact_duplicate_rows", "duplicate_symbol_timestamp", "utc_collisions"])


def profile_bar_files(
    raw: DataFrame, file: str = "source_file", line: str = "line", block_rows: int = 1_000_000
) -> DataFrame:
    """One row of counts per bar file (tab layout), all columns still text."""
    profile = profile_typed(cut_lineage(typed_bars(raw, file, line)), block_rows).where("rows_seen > 0")
    return profile.withColumnRenamed("source_file", file) if file != "source_file" else profile


def profile_tick_files(raw: DataFrame, file: str = "source_file") -> DataFrame:
    """Counts per tick file: parse failures, volume, quotes."""
    data = drop_embedded_headers(raw, "-SYMBOL")
    names = ("PRICE", "TICKVOL", "BID", "ASK")
    n = {c: F.col(c).try_cast("double") for c in names}
    return data.groupBy(file).agg(
        F.count(F.lit(1)).alias("rows_seen"),
        sum_of([F.count_if(_bad_number(F.col(c))) for c in names]).alias("invalid_numeric_values"),
        F.count_if(n["TICKVOL"] <= 0).alias("nonpositive_tick_volume"),
        F.count_if((n["PRICE"] < n["BID"]) | (n["PRICE"] > n["ASK"])).alias("price_outside_quote"),
        F.count_if(n["BID"] > n["ASK"]).alias("crossed_quotes"),
        F.count_if(n["PRICE"] <= 0).alias("nonpositive_prices"),
        F.max(n["TICKVOL"]).alias("tickvol_max"),
    )


def audit_bar_values(raw: DataFrame, file: str = "source_file") -> DataFrame:
    """Audit counts of the notebook check: null cells, prices, volumes, open interest, gaps."""
    data = drop_embedded_headers(raw, "-Ticker").withColumn(
        "stamp", F.expr("try_cast(`Date Time` AS timestamp)")
    )
    text = [c for c in raw.columns if c not in (file, "line")]
    prices = [F.col(f"`{c}`").try_cast("double") for c in ("Open", "High", "Low", "Last")]
    any_low = F.lit(False)
    for p in prices:
        any_low = any_low | F.coalesce(p <= 0, F.lit(False))
    volume = F.col("Volume").try_cast("double")
    interest = F.col("`Open Interest`").try_cast("double")
    values = data.groupBy(file).agg(
        sum_of([F.count_if(F.col(f"`{c}`").isNull()) for c in text]).alias("null_cells"),
        F.count_if(any_low).alias("nonpositive_prices"),
        F.count_if(volume < 0).alias("negative_volume"),
        F.count_if(volume == 0).alias("zero_volume"),
        F.round(100.0 * F.count_if(interest == 0) / F.count(F.lit(1)), 3).alias(
            "zero_open_interest_pct"
        ),
    )
    return values.join(minute_gaps(data, file, "stamp"), file)


def minute_gaps(df: DataFrame, file: str, stamp: str) -> DataFrame:
    """Steps of more than one minute between consecutive sorted times, per file.

    Times are reduced to distinct values and windowed per (file, day); the step into a day
    comes from the last time of the previous day that has any.
    """
    day = F.to_date(stamp)
    times = df.filter(F.col(stamp).isNotNull()).select(file, stamp, day.alias("day")).distinct()
    w = Window.partitionBy(file, "day").orderBy(stamp)
    micros = F.unix_micros(stamp)
    inside = (
        times.withColumn("gap", micros - F.lag(micros).over(w) > 60_000_000)
        .groupBy(file, "day")
        .agg(
            F.count_if("gap").alias("n"),
            F.min(stamp).alias("first"),
            F.max(stamp).alias("last"),
        )
    )
    edge = Window.partitionBy(file).orderBy("day")
    step = F.unix_micros("first") - F.unix_micros(F.lag("last").over(edge)) > 60_000_000
    return (
        inside.withColumn("crossing", step.cast("int"))
        .groupBy(file)
        .agg(
            (F.sum("n") + F.coalesce(F.sum("crossing"), F.lit(0))).alias(
                "missing_calendar_minutes"
            )
        )
    )


# Issue code -> severity.
ISSUE_SEVERITY = {
    "unknown_schema": "critical",
    "embedded_headers": "high",
    "multiple_symbols_in_file": "critical",
    "filename_symbol_mismatch": "critical",
    "invalid_timestamps": "critical",
    "out_of_order": "high",
    "exact_duplicate_rows": "high",
    "duplicate_symbol_timestamp": "critical",
    "invalid_numeric_values": "critical",
    "invalid_ohlc": "critical",
    "constant_price_series": "high",
    "open_interest_unavailable": "medium",
    "nonpositive_tick_volume": "high",
    "price_outside_quote": "medium",
    "short_history": "medium",
    "duplicate_file_payload": "critical",
    "duplicate_symbol_files": "critical",
}


def issues_from_profile(profile: DataFrame, file: str = "source_file") -> DataFrame:
    """Unpivot nonzero counts into (file, code, severity, count)."""
    codes = [c for c in profile.columns if c in ISSUE_SEVERITY]
    severity = F.create_map(
        *[F.lit(x) for code in codes for x in (code, ISSUE_SEVERITY[code])]
    )
    return (
        profile.select(file, *[F.col(c).cast("long").alias(c) for c in codes])
        .unpivot(file, codes, "code", "issue_count")
        .filter(F.col("issue_count") > 0)
        .withColumn("severity", severity[F.col("code")])
    )


def file_status(files: DataFrame, issues: DataFrame, file: str = "source_file") -> DataFrame:
    """blocked / review / ready per file plus its number of blocking issues."""
    blocking = F.col("severity").isin("critical", "high")
    worst = issues.groupBy(file).agg(
        F.count(F.lit(1)).alias("issues"), F.count_if(blocking).alias("blocking_issues")
    )
    return files.join(worst, file, "left").select(
        *files.columns,
        F.coalesce("issues", F.lit(0)).alias("issues"),
        F.coalesce("blocking_issues", F.lit(0)).alias("blocking_issues"),
        F.when(F.col("blocking_issues") > 0, "blocked")
        .when(F.col("issues") > 0, "review")
        .otherwise("ready")
        .alias("status"),
    )


def cross_file_issues(files: DataFrame, file: str = "source_file") -> DataFrame:
    """Files sharing a payload hash, and files sharing a (symbol, kind)."""

    def shared_by(keys: list[str], code: str) -> DataFrame:
        groups = (
            files.filter(all_of([F.coalesce(F.col(k) != "", F.lit(False)) for k in keys]))
            .groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"))
            .filter("n > 1")
        )
        return files.join(groups, keys).select(
            file,
            F.lit(code).alias("code"),
            (F.col("n") - 1).alias("issue_count"),
            F.lit(ISSUE_SEVERITY[code]).alias("severity"),
        )

    return shared_by(["sha256"], "duplicate_file_payload").unionByName(
        shared_by(["symbol", "data_kind"], "duplicate_symbol_files")
    )


def shared_payloads(files: DataFrame, keys: tuple[str, ...] = ("sha256",), file: str = "source_file",
                    list_length: int = 1000) -> DataFrame:
    """Members of each group of files that share a key, in lists of about ``list_length`` names.

    A group is listed once and not at each of its members; a large one takes several rows, dealt by
    hash, so no list grows with the catalog.
    """
    named = files.filter(all_of([F.coalesce(F.col(k) != "", F.lit(False)) for k in keys]))
    groups = named.groupBy(*keys).agg(F.count(F.lit(1)).alias("files")).filter("files > 1")
    part = F.pmod(F.xxhash64(file), F.ceil(F.col("files") / list_length)).alias("part")
    return named.join(groups, list(keys)).groupBy(*keys, "files", part).agg(
        F.array_sort(F.collect_list(file)).alias("members"))


def quarantine(files: DataFrame, issues: DataFrame, file: str = "source_file") -> DataFrame:
    """Normalization manifest: blocked files are set aside, tick files wait, the rest go on."""
    blocked = issues.filter(F.col("severity").isin("critical", "high")).select(file).distinct()
    held = files.join(blocked, file, "left_semi").withColumn("status", F.lit("quarantined"))
    free = files.join(blocked, file, "left_anti").withColumn(
        "status",
        F.when(F.col("data_kind") == "minute_bars", "normalized").otherwise("deferred"),
    )
    return held.unionByName(free)


def normalization_rejects(canonical: DataFrame) -> DataFrame:
    """Counts of the reject rules on canonical bars, per source file."""
    low = F.lit(False)
    for p in PRICES:
        low = low | (F.col(p) <= 0)
    base = canonical.groupBy("source_file").agg(
        F.count_if(low).alias("nonpositive_prices"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"),
        (F.min("symbol") != F.max("symbol")).cast("int").alias("changed_identity"),
    )
    return base.join(
        duplicate_rows(canonical, "source_file", ["symbol", "timestamp_utc"], "utc_collisions"),
        "source_file",
    )


def null_if_all_zero(df: DataFrame, column: str, *key: str) -> DataFrame:
    """A column that is zero on every row of the key is unavailable, hence NULL.

    The flag is aggregated (map-side combined) and joined back, never windowed, so one key with
    most of the rows does not land in one task.
    """
    flag = df.groupBy(*key).agg(
        F.coalesce(F.max(F.abs(F.col(column))) == 0, F.lit(True)).alias("all_zero")
    )
    return (
        df.join(flag, list(key))
        .withColumn(column, F.when(~F.col("all_zero"), F.col(column)))
        .drop("all_zero")
    )
