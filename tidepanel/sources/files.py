"""Readers for raw text exports and for the tables written by ``sinks``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel import schema as S
from tidepanel.functions.scalars import ratio

TEXT_SUFFIXES = "*.{csv,txt,tsv,CSV,TXT,TSV}"


def list_files(
    spark: SparkSession, folder: str, glob: str | None = None, recursive: bool = False
) -> DataFrame:
    """Files under a folder whose suffix is a text export and whose name fits the glob."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return (
        reader.load(folder)
        .filter(suffix.isin("csv", "txt", "tsv"))
        .select(
            F.element_at(F.split("path", "/"), -1).alias("source_file"),
            "path",
            F.col("length").alias("size_bytes"),
        )
    )


def fingerprint(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """SHA-256 and size of every file; one file is one row, hashed on the executors."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("source_file"),
        "path",
        F.col("length").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


def headers(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """First line of every text file with the layout its columns announce."""
    reader = spark.read.format("text")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.load(folder).select(
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )
    first = (
        lines.filter(F.col("block") == 0)
        .groupBy("source_file")
        .agg(F.min_by("value", "row").alias("header"))
    )

    def has_all(names: tuple[str, ...], sep: str):
        cells = F.transform(F.split("header", sep), lambda c: F.trim(c))
        return F.size(F.array_except(F.array(*[F.lit(n) for n in names]), cells)) == 0

    return first.withColumn(
        "layout",
        F.when(has_all(S.BAR_COMMA_COLUMNS, ","), "bar_comma")
        .when(has_all(S.BAR_TAB_COLUMNS, "\t"), "bar_tab")
        .when(has_all(S.TICK_COLUMNS, "\t"), "tick_tab")
        .otherwise("unknown"),
    ).withColumn(
        "data_kind",
        F.when(F.col("layout").startswith("bar"), "minute_bars")
        .when(F.col("layout") == "tick_tab", "ticks")
        .otherwise("unknown"),
    )


def read_delimited(
    spark: SparkSession, paths: str | list[str], sep: str, columns: tuple[str, ...] | None = None
) -> DataFrame:
    """All-text read of files with a header row; provenance and line order are attached.

    The order inside a file is (split offset, row id): ``line`` packs both, so the check for
    rows moving backward in time needs no single-split read.
    """
    reader = spark.read.option("sep", sep).option("header", "true")
    if columns:
        reader = reader.schema(S.strings(*columns)).option("enforceSchema", "false")
    else:
        reader = reader.option("inferSchema", "false")
    df = reader.csv(paths)
    row_in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.select(
        "*",
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("split_start"),
        row_in_task.alias("split_row"),
    )


def with_lines(df: DataFrame) -> DataFrame:
    """Replace (split_start, split_row) with one increasing line number per file."""
    sizes = df.groupBy("source_file", "split_start").agg(
        (F.max("split_row") + 1).alias("top")
    )
    w = (
        Window.partitionBy("source_file")
        .orderBy("split_start")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("top").over(w), F.lit(0))).drop("top")
    return (
        df.join(offsets, ["source_file", "split_start"])
        .withColumn("line", F.col("offset") + F.col("split_row"))
        .drop("offset", "split_start", "split_row")
    )


def read_headerless_minutes(spark: SparkSession, path: str) -> DataFrame:
    """Seven positional columns; duplicate times, missing or inconsistent prices fail."""
    raw = spark.read.schema(S.HEADERLESS_MINUTE).csv(path)
    price = {c: F.col(c).try_cast("double") for c in ("open", "high", "low", "close")}
    df = raw.select(
        F.try_to_timestamp(F.concat_ws(" ", "date", "time")).alias("timestamp_utc"),
        *[c.alias(n) for n, c in price.items()],
        F.col("volume").try_cast("double").alias("volume"),
    )
    bad_price = (
        (F.col("high") < F.greatest("open", "low", "close"))
        | (F.col("low") > F.least("open", "high", "close"))
        | F.col("open").isNull() | F.col("high").isNull()
        | F.col("low").isNull() | F.col("close").isNull()
    )
    per_time = df.groupBy("timestamp_utc").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(bad_price).alias("bad")
    )
    found = per_time.agg(
        F.count_if(F.col("timestamp_utc").isNull()).alias("no_time"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
    ).first()
    if found["no_time"] or found["duplicates"] or found["bad"]:
        raise ValueError(f"minute file rejected: {found.asDict()}")
    return df


def read_ledger(
    spark: SparkSession,
    paths: str | list[str],
    start: str | None = None,
    end_exclusive: str | None = None,
    expected_trades: int | None = None,
    expected_pnl: float | None = None,
) -> DataFrame:
    """Closed trades from ';' files, one strategy per file name; the stated totals must hold."""
    raw = spark.read.option("sep", ";").option("header", "true").csv(paths)
    S.require_columns(raw, S.LEDGER_COLUMNS)
    stamp = "yyyy.MM.dd HH:mm:ss"
    trades = raw.select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(?:strategy_)?(.+)\.[^.]*$", 1).alias(
            "strategy"
        ),
        F.col("Ticket").alias("ticket"),
        F.to_timestamp("Open time", stamp).alias("open_time"),
        F.to_timestamp("Close time", stamp).alias("close_time"),
        F.col("`Profit/Loss`").cast("double").alias("pnl"),
        F.col("Close type").alias("close_type"),
    )
    per_ticket = trades.groupBy("strategy", "ticket").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("open_time").alias("first_open"),
        F.max("close_time").alias("last_close"),
        F.sum("pnl").alias("pnl"),
    )
    found = per_ticket.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("trades"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"),
        F.min("first_open").cast("string").alias("first_open"),
        F.max("last_close").cast("string").alias("last_close"),
        F.sum("pnl").alias("pnl"),
    ).first()
    problems = []
    if found["duplicates"]:
        problems.append("duplicate strategy/ticket pairs")
    if start and found["first_open"] and found["first_open"] < start:
        problems.append("trade opens before the window")
    if end_exclusive and found["last_close"] and found["last_close"] >= end_exclusive:
        problems.append("trade closes after the window")
    if expected_trades is not None and found["trades"] != expected_trades:
        problems.append(f"{found['trades']} trades, expected {expected_trades}")
    if expected_pnl is not None and abs((found["pnl"] or 0.0) - expected_pnl) > 0.01:
        problems.append(f"total {found['pnl']}, expected {expected_pnl}")
    if problems:
        raise ValueError("; ".join(problems))
    return trades


def read_position_reports(
    spark: SparkSession, paths: str | list[str], codes: dict[str, str]
) -> DataFrame:
    """Weekly position reports of the mapped codes, released three days after their date."""
    raw = spark.read.option("header", "true").csv(paths)
    code = F.trim("CFTC_Contract_Market_Code")
    symbol = F.create_map(*[F.lit(x) for s, c in codes.items() for x in (c, s)])
    number = {
        n: F.col(n).cast("double")
        for n in (
            "Open_Interest_All", "Prod_Merc_Positions_Long_All", "Prod_Merc_Positions_Short_All",
            "M_Money_Positions_Long_All", "M_Money_Positions_Short_All",
        )
        if n in raw.columns
    }
    report = F.to_date("Report_Date_as_YYYY-MM-DD")
    out = [
        symbol[code].alias("symbol"),
        report.alias("report_date"),
        F.date_add(report, 3).alias("release_date"),
    ]
    if "Prod_Merc_Positions_Long_All" in number:
        out.append(
            ratio(
                number["Prod_Merc_Positions_Short_All"] - number["Prod_Merc_Positions_Long_All"],
                number["Open_Interest_All"],
            ).alias("hedging_pressure")
        )
    if "M_Money_Positions_Long_All" in number:
        out.append(
            ratio(
                number["M_Money_Positions_Long_All"] - number["M_Money_Positions_Short_All"],
                number["Open_Interest_All"],
            ).alias("managed_money_net_share")
        )
    return raw.filter(code.isin(*codes.values())).select(*out)


def canonical_bars(
    raw: DataFrame, fingerprints: DataFrame, zone: str, as_of_year: int
) -> DataFrame:
    """Quality-approved tab-layout text rows to the 14 canonical columns."""
    from tidepanel.operators import calendar as cal
    from tidepanel.operators.quality import null_if_all_zero

    symbol = F.upper(F.trim("`-Ticker`"))
    number = {
        n: F.col(f"`{c}`").cast("double")
        for n, c in {
            "open": "Open", "high": "High", "low": "Low", "close": "Last", "volume": "Volume",
        }.items()
    }
    interest = (
        F.col("`Open Interest`").cast("double")
        if "Open Interest" in raw.columns
        else F.lit(None).cast("double")
    )
    parts = cal.contract_parts(symbol, as_of_year)
    df = raw.select(
        symbol.alias("symbol"),
        F.coalesce(parts["root_symbol"], symbol).alias("root_symbol"),
        parts["contract_month_code"].alias("contract_month_code"),
        parts["contract_year"].alias("contract_year"),
        F.col("`Date Time`").cast("timestamp").alias("timestamp_local"),
        *[c.alias(n) for n, c in number.items()],
        interest.alias("open_interest"),
        "source_file",
    )
    df = cal.assert_strict_utc(df, "timestamp_local", zone)
    df = null_if_all_zero(df, "open_interest", "source_file")
    return df.join(
        fingerprints.select("source_file", F.col("sha256").alias("source_sha256")), "source_file"
    ).select(*S.CANONICAL_COLUMNS)


def read_partitioned(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """Hive-partitioned parquet; partition discovery prunes on filters over ``symbol``."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(root)


def read_split(
    spark: SparkSession, root: str, split: str = "development", unseal: bool = False
) -> DataFrame:
    """Only the development split by default; the holdout must be asked for explicitly."""
    if split == "holdout" and not unseal:
        raise PermissionError("the holdout split is sealed; pass unseal=True to read it")
    return spark.read.parquet(root).filter(F.col("split") == split).drop("split")
