"""Explicit schemas and the column checks applied before work starts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


# Column names of the accepted raw files.
BAR_TAB_COLUMNS = ("-Ticker", "Date Time", "Open", "High", "Low", "Last", "Volume")
BAR_COMMA_COLUMNS = ("Date", "Time", "Open", "High", "Low", "Close", "Volume")
TICK_COLUMNS = ("-SYMBOL", "DATE", "PRICE", "TICKVOL", "BID", "ASK")
LEDGER_COLUMNS = (
    "Ticket", "Symbol", "Type", "Open time", "Open price", "Size",
    "Close time", "Close price", "Profit/Loss", "Close type",
)
CANONICAL_COLUMNS = (
    "symbol", "root_symbol", "contract_month_code", "contract_year", "timestamp_local",
    "timestamp_utc", "open", "high", "low", "close", "volume", "open_interest", "source_file",
    "source_sha256",
)

HEADERLESS_MINUTE = strings("date", "time", "open", "high", "low", "close", "volume")

INSTRUMENT = T.StructType(
    [
        T.StructField("root", T.StringType(), False),
        T.StructField("exchange", T.StringType()),
        T.StructField("multiplier", T.DoubleType()),
        T.StructField("tick_size", T.DoubleType()),
        T.StructField("tick_value", T.DoubleType()),
        T.StructField("contract_months", T.ArrayType(T.StringType())),
        T.StructField(
            "roll",
            T.StructType(
                [
                    T.StructField("rule", T.StringType()),
                    T.StructField("days_before", T.IntegerType()),
                ]
            ),
        ),
    ]
)


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def clean_missing(df: DataFrame, names: Iterable[str] | None = None) -> DataFrame:
    """NaN and infinities become NULL so that counts and ordering behave."""
    wanted = set(names) if names is not None else None
    fixed = {}
    for field in df.schema.fields:
        if not isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            continue
        if wanted is not None and field.name not in wanted:
            continue
        col = F.col(f"`{field.name}`")
        fixed[field.name] = F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col)
    return df.withColumns(fixed) if fixed else df
