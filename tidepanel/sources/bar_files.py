"""Minute-bar text files of both layouts as one normalizing job.

The header line of a file names its columns, so one scan finds each file's layout and a second one reads
all files together, every row by the column places of its own file.  Parsed rows are kept in the shared
folder; profile, rejects and canonical rows all read those, so the text is scanned no third time.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel import schema as S
from tidepanel.operators import calendar as cal
from tidepanel.operators import quality as Q
from tidepanel.session import cut_lineage

LAYOUT_ZONES = {"bar_tab": cal.NEW_YORK, "bar_comma": "UTC"}
#: Faults that keep a file from being normalized, beyond blocking issues of its profile.
REJECTS = ("zoned_timestamps", "impossible_times", "nonpositive_prices", "negative_volume", "utc_collisions")


def read_lines(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """Lines of all text files: ``source_file``, ``line`` (ascending in a file, not gapless), ``first_split``, ``value``.

    A folder ``source_file=NAME`` is one file, as a partitioned writer leaves it.
    """
    reader = spark.read.option("recursiveFileLookup", "false")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = reader.text(folder)
    name = F.col("source_file").cast("string") if "source_file" in lines.columns else F.col("_metadata.file_name")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    start = F.col("_metadata.file_block_start")
    # a byte offset and a row number below 2^33 share one decimal of fixed scale; lines rise within a file
    return lines.select(
        name.alias("source_file"), (start.cast("decimal(20,0)") * F.lit(1 << 33).cast("decimal(10,0)") + row).alias("line"),
        (start == 0).alias("first_split"), F.regexp_replace("value", "\r$", "").alias("value"))


def layouts(lines: DataFrame) -> DataFrame:
    """Header, layout, separator and column names of each file."""
    header = lines.where("first_split").groupBy("source_file").agg(F.min_by("value", "line").alias("header"))

    def names(sep: str) -> Column:
        return F.transform(F.split("header", sep), lambda c: F.trim(c))

    def announces(wanted: tuple[str, ...], sep: str) -> Column:
        return F.size(F.array_except(F.array(*[F.lit(n) for n in wanted]), names(sep))) == 0

    layout = (
        F.when(announces(S.BAR_COMMA_COLUMNS, ","), "bar_comma").when(announces(S.BAR_TAB_COLUMNS, "\t"), "bar_tab")
        .when(announces(S.TICK_COLUMNS, "\t"), "tick_tab").otherwise("unknown"))
    return header.withColumn("layout", layout).select(
        "source_file", "layout", "header",
        F.when(F.col("layout") == "bar_comma", names(",")).otherwise(names("\t")).alias("names"))


def bar_rows(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of all bar files in the text columns of the tab layout, each read by its own file's header.

    The comma layout names no symbol; it is the part of the file name before the first underscore.
    """
    known = files.where(F.col("layout").startswith("bar"))
    cells = F.when(F.col("layout") == "bar_comma", F.split("value", ",")).otherwise(F.split("value", "\t"))
    rows = lines.join(known, "source_file").withColumn("cells", cells)

    def cell(name: str) -> Column:
        found = F.get("cells", F.array_position("names", F.lit(name)).cast("int") - 1)
        return F.when(found != "", F.trim(found))

    comma = F.col("layout") == "bar_comma"
    stem = F.upper(F.element_at(F.split(F.regexp_replace("source_file", r"\.[^.]*$", ""), "_"), 1))
    date = cell("Date")
    ticker = F.get("cells", F.array_position("names", F.lit("-Ticker")).cast("int") - 1)
    return rows.select(
        "source_file", "line", "layout",
        F.when(comma, F.when(date == "Date", "-Ticker").otherwise(stem)).otherwise(ticker).alias("-Ticker"),
        F.when(comma, F.concat_ws(" ", date, cell("Time"))).otherwise(cell("Date Time")).alias("Date Time"),
        *[cell(c).alias(c) for c in ("Open", "High", "Low")],
        F.when(comma, cell("Close")).otherwise(cell("Last")).alias("Last"),
        cell("Volume").alias("Volume"), cell("Open Interest").alias("Open Interest"),
        F.array_contains("names", "Open Interest").alias("has_interest"))


def parsed_bars(lines: DataFrame, files: DataFrame, zones: Mapping[str, str]) -> DataFrame:
    """Typed rows of all bar files in the shared folder, with hashes of their text."""
    rows = bar_rows(lines, files)
    zone = F.lit(None).cast("string")
    for layout, name in zones.items():
        zone = F.when(F.col("layout") == layout, F.lit(name)).otherwise(zone)
    return cut_lineage(Q.typed_bars(rows.withColumn("zone", zone), zone=F.col("zone")))


def manifest(files: DataFrame, typed: DataFrame, block_rows: int = 1_000_000) -> DataFrame:
    """Profile, reject counts and status of each file: normalized, rejected, quarantined, deferred or blocked.

    The header line of each file is a header row of the profile and not an embedded one.
    """
    profile = Q.profile_typed(typed, block_rows)
    profile = profile.withColumn("embedded_headers", F.col("embedded_headers") - 1)
    blocking = [c for c, s in Q.ISSUE_SEVERITY.items() if s in ("critical", "high") and c in profile.columns]
    blocked = Q.sum_of([(F.col(c) > 0).cast("int") for c in blocking])
    rejected = Q.sum_of([(F.col(c) > 0).cast("int") for c in REJECTS])
    return files.select("source_file", "layout").join(profile, "source_file", "left").withColumn(
        "status",
        F.when(F.col("layout") == "unknown", "blocked").when(~F.col("layout").startswith("bar"), "deferred")
        .when(F.coalesce("rows_seen", F.lit(0)) == 0, "rejected")
        .when(blocked > 0, "quarantined").when(rejected > 0, "rejected").otherwise("normalized"))


def normalize(spark: SparkSession, folder: str, as_of_year: int, zones: Mapping[str, str] = LAYOUT_ZONES,
              glob: str | None = None, fingerprints: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Canonical bars of all files that pass, and the manifest of all files.

    ``fingerprints`` (source_file, sha256) gives provenance; without it the hash column is NULL.
    """
    lines = read_lines(spark, folder, glob)
    files = cut_lineage(layouts(lines))
    typed = parsed_bars(lines, files, zones)
    report = cut_lineage(manifest(files, typed))
    passed = report.where("status = 'normalized'").select(
        "source_file", (F.col("open_interest_unavailable") > 0).alias("no_interest"))
    if fingerprints is None:
        passed = passed.withColumn("source_sha256", F.lit(None).cast("string"))
    else:
        passed = passed.join(fingerprints.select("source_file", F.col("sha256").alias("source_sha256")), "source_file", "left")
    parts = cal.contract_parts("symbol", as_of_year)
    rows = typed.where(~F.col("is_header")).join(passed, "source_file")
    bars = rows.select(
        "symbol", F.coalesce(parts["root_symbol"], F.col("symbol")).alias("root_symbol"),
        parts["contract_month_code"].alias("contract_month_code"), parts["contract_year"].alias("contract_year"),
        F.col("stamp").alias("timestamp_local"), "timestamp_utc", "open", "high", "low", "close", "volume",
        F.when(~F.col("no_interest"), F.col("open_interest")).alias("open_interest"), "source_file", "source_sha256",
    ).select(*S.CANONICAL_COLUMNS)
    return bars, report
