"""Forward labels, folds, splits and point-in-time scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import frames
from tidepanel.functions.scalars import clip, complete, ratio

KEY, ORDER = "symbol", "trading_date"


def robust_scale(
    features: DataFrame,
    names: list[str],
    least: int = 120,
    low: float = 0.01,
    high: float = 0.99,
) -> DataFrame:
    """Winsorize to earlier quantiles, centre on the earlier median, divide by the earlier IQR.

    Rows go long, so the groups are (symbol, feature) and spread over features as well.
    """
    long = features.unpivot([KEY, ORDER], names, "feature", "x")
    quantiles = {"q_low": low, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q_high": high}
    long = earlier_quantiles(long, [KEY, "feature"], ORDER, "x", quantiles, least)
    iqr = F.col("q75") - F.col("q25")
    scale = F.when(iqr != 0, iqr).otherwise(F.col("earlier_std"))
    bounded = F.greatest(F.least("x", "q_high"), "q_low")
    value = F.when(
        F.col("x").isNotNull() & F.col("q50").isNotNull(), ratio(bounded - F.col("q50"), scale)
    )
    wide = (
        long.select(KEY, ORDER, "feature", value.alias("value"))
        .groupBy(KEY, ORDER)
        .pivot("feature", names)
        .agg(F.first("value"))
    )
    return wide.withColumn("model_row_complete", complete(names))


def earlier_quantiles(
    df: DataFrame, keys: list[str], order: str, x: str, quantiles: dict[str, float], least: int
) -> DataFrame:
    """Quantiles and deviation of all strictly earlier values of the key.

    ``percentile`` over a growing frame sorts the whole history for every row.  The grouped
    pandas form keeps a sorted structure instead (n log n); a group is one series on the session
    calendar, so its size is bounded by the number of sessions.
    """
    slim = df.select(*keys, order, x)
    fields = [f"{k} {slim.schema[k].dataType.simpleString()}" for k in [*keys, order, x]]
    out = ", ".join([*fields, *[f"{n} double" for n in quantiles], "earlier_std double"])

    def run(pdf):
        pdf = pdf.sort_values(order, ignore_index=True)
        values = pdf[x].astype(float)
        history = values.expanding(min_periods=least)
        for name, q in quantiles.items():
            pdf[name] = history.quantile(q).shift(1)
        pdf["earlier_std"] = history.std().shift(1)
        return pdf

    return slim.groupBy(*keys).applyInPandas(run, out)


def feature_registry(
    metadata: DataFrame, redundant: DataFrame, drops: DataFrame
) -> DataFrame:
    """Status of each feature: dropped as duplicate, dropped as degenerate, or selected."""
    review = (
        redundant.select(F.explode(F.array("feature_a", "feature_b")).alias("feature"))
        .distinct()
        .withColumn("high_correlation_review", F.lit(True))
    )
    out = metadata.join(drops, "feature", "left").join(review, "feature", "left")
    return out.select(
        "feature",
        F.coalesce("family", F.lit("unclassified")).alias("family"),
        F.col("duplicate_of").isNull().alias("selected"),
        F.when(F.col("reason") == "duplicate", "drop_exact_duplicate")
        .when(F.col("reason") == "degenerate", "drop_cross_instrument_degenerate")
        .otherwise("selected")
        .alias("status"),
        F.coalesce("duplicate_of", F.lit("")).alias("duplicate_of"),
        F.coalesce("high_correlation_review", F.lit(False)).alias("high_correlation_review"),
    )


def forward_labels(panel: DataFrame, horizons: tuple[int, ...] = (1, 5, 20)) -> DataFrame:
    if any(h < 1 for h in horizons):
        raise ValueError("label horizons must be positive")
    w = frames.ordered(KEY, ORDER)
    out: dict[str, Column] = {}
    for h in horizons:
        out[f"forward_log_return_{h}s"] = F.log(F.lead("close", h).over(w) / F.col("close"))
        out[f"label_available_at_{h}s_utc"] = F.lead("session_close_utc", h).over(w)
    return panel.select(KEY, ORDER, *[c.alias(n) for n, c in out.items()])


def walk_forward_folds(
    dates: DataFrame, train: int = 504, validation: int = 63, embargo: int = 5
) -> DataFrame:
    """Expanding folds from the distinct sessions; the last one may be short.

    Fold numbers are arithmetic on the session number, so building them is one grouping of the
    calendar and no loop.
    """
    calendar = dates.select(ORDER).distinct()
    calendar = calendar.withColumn("n", F.row_number().over(Window.orderBy(ORDER)) - 1)
    first = train + embargo
    fold = F.floor((F.col("n") - first) / validation).cast("int") + 1
    blocks = (
        calendar.filter(F.col("n") >= first)
        .groupBy(fold.alias("fold"))
        .agg(
            F.min(ORDER).alias("validation_start"),
            F.max(ORDER).alias("validation_end"),
            F.count(F.lit(1)).alias("validation_sessions"),
            F.min("n").alias("start_n"),
        )
    )
    edges = calendar.select(F.col("n").alias("edge_n"), F.col(ORDER).alias("edge"))

    def on(offset: int, name: str, df: DataFrame) -> DataFrame:
        side = edges.select((F.col("edge_n") + offset).alias("start_n"), F.col("edge").alias(name))
        return df.join(side, "start_n", "left")

    out = on(embargo + 1, "train_end", on(embargo, "embargo_start", on(1, "embargo_end", blocks)))
    start = calendar.agg(F.min(ORDER).alias("d")).scalar()
    return out.select(
        "fold",
        start.alias("train_start"),
        "train_end",
        "embargo_start",
        "embargo_end",
        "validation_start",
        "validation_end",
        (F.col("start_n") - embargo).cast("long").alias("train_sessions"),
        "validation_sessions",
    )


def fold_of_session(
    df: DataFrame, train: int = 504, validation: int = 63, embargo: int = 5
) -> DataFrame:
    """Attach the validation fold of each row (NULL outside) by session number.

    Equal to the range join with the fold table, but a plain equi-join on the date: folds are
    consecutive blocks of the calendar.
    """
    calendar = df.select(ORDER).distinct()
    n = F.row_number().over(Window.orderBy(ORDER)) - 1
    fold = F.floor((n - (train + embargo)) / validation).cast("int") + 1
    calendar = calendar.select(ORDER, F.when(n >= train + embargo, fold).alias("fold"))
    return df.join(calendar, ORDER)


def training_folds(
    df: DataFrame,
    sessions: DataFrame,
    available: str | None = None,
    train: int = 504,
    validation: int = 63,
    embargo: int = 5,
) -> DataFrame:
    """Fan a row out to every fold that may train on it.

    A row trains fold f when its session is not after the fold's train end and, with
    ``available``, its label was known by the end of that day.  Fold f ends its training at
    session ``train + (f-1) * validation - 1``, so the first admissible fold is arithmetic on
    the session number: one equi-join on the date and a sequence, no inequality join.
    """
    known = F.col(ORDER)
    if available is not None:
        known = F.greatest(known, F.to_date(available))
        df = df.filter(F.col(available).isNotNull())
    calendar = sessions.select(F.col(ORDER).alias("known")).distinct()
    calendar = calendar.select(
        "known",
        (F.row_number().over(Window.orderBy("known")) - 1).alias("n"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("total"),
    )
    first = F.greatest(F.ceil((F.col("n") - (train - 1)) / validation) + 1, F.lit(1))
    last = F.ceil((F.col("total") - (train + embargo)) / validation)
    calendar = calendar.select(
        "known", F.when(first <= last, F.sequence(first, last)).alias("fold")
    )
    return (
        df.withColumn("known", known)
        .join(calendar, "known")
        .drop("known")
        .withColumn("fold", F.explode("fold"))
        .withColumn("fold", F.col("fold").cast("int"))
    )


def holdout_split(sessions: DataFrame, months: int = 12, minimum: int = 6, embargo_days: int = 5) -> DataFrame:
    """Label each row development, embargo or holdout relative to the latest session."""
    if months < minimum or minimum < 6 or embargo_days < 0:
        raise ValueError("the holdout must span at least six months")
    latest = sessions.agg(F.max(ORDER).alias("d")).scalar()
    start = F.add_months(latest, -months)
    end = F.date_sub(start, embargo_days + 1)
    return sessions.withColumn(
        "split",
        F.when(F.col(ORDER) <= end, "development")
        .when(F.col(ORDER) >= start, "holdout")
        .otherwise("embargo"),
    )


def split_coverage(split: DataFrame) -> DataFrame:
    development = F.count_if(F.col("split") == "development")
    return split.groupBy(KEY).agg(
        F.min(ORDER).alias("first_session"),
        F.max(ORDER).alias("last_session"),
        development.alias("development_sessions"),
        F.count_if(F.col("split") == "holdout").alias("holdout_sessions"),
        F.when(development > 0, "development_and_holdout").otherwise("holdout_only").alias(
            "eligibility"
        ),
    )


def research_windows(dates: DataFrame, test_start: str = "2024-10-01", share: float = 0.7) -> DataFrame:
    """build / selection / test label per session date."""
    calendar = dates.select(ORDER).distinct()
    test = F.lit(test_start).cast("date")
    before = F.count_if(F.col(ORDER) < test).over(Window.partitionBy())
    n = F.row_number().over(Window.orderBy(ORDER))
    cut = F.floor(before * share)
    return calendar.select(
        ORDER,
        F.when(F.col(ORDER) >= test, "test")
        .when(n <= cut, "build")
        .otherwise("selection")
        .alias("research_window"),
    )


def volatility_scaled_target(label: str, volatility: str, horizon: int) -> Column:
    return clip(
        ratio(label, F.abs(F.col(volatility)) * float(horizon) ** 0.5), -5.0, 5.0
    )
