"""Performance aggregates over long return tables (strategy, trading_date, value)."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import frames
from tidepanel.functions.scalars import all_of, clip, col, ratio

YEAR = 252.0


def sharpe(x: str | Column, risk_free: float = 0.0) -> Column:
    x = col(x)
    return ratio(F.avg(x) - risk_free / YEAR, F.stddev_samp(x)) * math.sqrt(YEAR)


def volatility(x: str | Column) -> Column:
    return F.stddev_samp(col(x)) * math.sqrt(YEAR)


def metrics(x: str, prefix: str = "", only: Column | None = None) -> list[Column]:
    """sessions, annualized return and volatility, Sharpe and worst drawdown of one column.

    The drawdown is read from the column ``drawdown`` added by ``with_drawdown``.
    """
    value = F.when(only, F.col(x)) if only is not None else F.col(x)
    down = F.when(only, F.col("drawdown")) if only is not None else F.col("drawdown")
    return [
        F.count(value).alias(f"{prefix}sessions"),
        (F.avg(value) * YEAR).alias(f"{prefix}annualized_return"),
        volatility(value).alias(f"{prefix}annualized_volatility"),
        sharpe(value).alias(f"{prefix}sharpe"),
        F.min(down).alias(f"{prefix}maximum_drawdown"),
    ]


def with_drawdown(df: DataFrame, keys: list[str], order: str, x: str) -> DataFrame:
    """Drawdown of compounded wealth; the peak starts at the first wealth value, so a loss on
    the first row is not a drawdown."""
    run = (
        Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    df = df.withColumn("wealth", F.product(1.0 + F.coalesce(F.col(x), F.lit(0.0))).over(run))
    return df.withColumn("drawdown", F.col("wealth") / F.max("wealth").over(run) - 1.0)


def summarize(df: DataFrame, keys: list[str], x: str, order: str = "trading_date", *extra: Column) -> DataFrame:
    return with_drawdown(df, keys, order, x).groupBy(*keys).agg(*metrics(x), *extra)


def expected_shortfall(df: DataFrame, keys: list[str], x: str, confidence: float = 0.95) -> DataFrame:
    """Minus the mean of values at or below the linear quantile."""
    if not 0.0 < confidence < 1.0:
        raise ValueError("confidence must be between zero and one")
    cutoff = df.groupBy(*keys).agg(F.percentile(x, F.lit(1.0 - confidence)).alias("cutoff"))
    return (
        df.join(cutoff, keys)
        .groupBy(*keys)
        .agg((-F.avg(F.when(F.col(x) <= F.col("cutoff"), F.col(x)))).alias("expected_shortfall"))
    )


PERIODS = ("month", "quarter", "year")


def period_returns(df: DataFrame, keys: list[str], x: str, order: str = "trading_date") -> DataFrame:
    """Compounded month, quarter and year returns of the periods that have observations.

    One pass builds months; quarters and years are products of months.
    """
    month = F.trunc(order, "month")
    months = df.filter(F.col(x).isNotNull()).groupBy(*keys, month.alias("month")).agg(
        F.product(1.0 + F.col(x)).alias("growth")
    )
    starts = F.array(
        *[
            F.struct(F.lit(p).alias("period_type"), F.trunc("month", p).alias("period_start"))
            for p in PERIODS
        ]
    )
    return (
        months.withColumn("p", F.explode(starts))
        .groupBy(*keys, "p.period_type", "p.period_start")
        .agg((F.product("growth") - 1.0).alias("period_return"))
    )


def performance_snapshot(df: DataFrame, keys: list[str], x: str, order: str = "trading_date") -> DataFrame:
    """Daily metrics plus win shares and positive counts per calendar period."""
    clean = df.filter(F.col(x).isNotNull())
    daily = with_drawdown(clean, keys, order, x).groupBy(*keys).agg(
        F.count(x).alias("observations"),
        F.min(order).alias("start"),
        F.max(order).alias("end"),
        (F.max_by("wealth", order) - 1.0).alias("total_return"),
        *metrics(x)[1:],
        F.avg((F.col(x) > 0).cast("double")).alias("win_days"),
        F.count_if(F.col(x) > 0).alias("positive_days"),
    )
    up = F.col("period_return") > 0
    periods = period_returns(clean, keys, x, order).groupBy(*keys).agg(
        *[
            c
            for p in PERIODS
            for c in (
                F.avg(F.when(F.col("period_type") == p, up.cast("double"))).alias(f"win_{p}s"),
                F.count_if((F.col("period_type") == p) & up).alias(f"positive_{p}s"),
                F.count_if(F.col("period_type") == p).alias(f"{p}s"),
            )
        ]
    )
    return daily.join(periods, keys)


def weekly_hits(df: DataFrame, keys: list[str], x: str, order: str = "trading_date") -> DataFrame:
    """Share of weeks ending Friday with a gain; weeks without rows count as zero return.

    Empty weeks only enter the denominator, so they are counted from the span, not filled.
    """
    friday = F.next_day(F.date_sub(order, 1), "Fri")
    weeks = df.groupBy(*keys, friday.alias("week_end")).agg(
        (F.product(1.0 + F.col(x)) - 1.0).alias("week_return")
    )
    span = (F.datediff(F.max("week_end"), F.min("week_end")) / 7 + 1).cast("long")
    up = F.count_if(F.col("week_return") > 0)
    return weeks.groupBy(*keys).agg(
        span.alias("weeks"), up.alias("positive_weeks"), (up / span).alias("win_weeks")
    )


def fold_metrics(df: DataFrame, keys: list[str], x: str, *extra: Column) -> DataFrame:
    """Metrics of each validation fold (rows outside every fold have a NULL fold)."""
    return summarize(df.filter(F.col("fold").isNotNull()), [*keys, "fold"], x, "trading_date", *extra)


def over_folds(folds: DataFrame, keys: list[str]) -> DataFrame:
    return folds.groupBy(*keys).agg(
        F.count_if(F.col("annualized_return") > 0).alias("positive_folds"),
        F.min("sharpe").alias("worst_fold_sharpe"),
    )


def fold_and_pooled(df: DataFrame, keys: list[str], x: str, *extra: Column) -> DataFrame:
    """Pooled validation metrics joined with the aggregate over folds."""
    pooled = summarize(df.filter(F.col("fold").isNotNull()), keys, x, "trading_date", *extra)
    return pooled.join(over_folds(fold_metrics(df, keys, x), keys), keys)


def with_costs(df: DataFrame, levels: tuple[float, ...], gross: str = "gross", sides: str = "sides") -> DataFrame:
    """Net return at each one-way cost level; gross and sides are computed once."""
    costs = F.array(*[F.lit(float(c)) for c in levels])
    return df.withColumn("cost_bps", F.explode(costs)).withColumn(
        "net", F.col(gross) - F.col(sides) * F.col("cost_bps") / 10_000.0
    )


def robust_score(a: str, b: str) -> Column:
    """Worse of two Sharpe ratios plus a quarter of their mean, each skipping NULL."""
    mean = F.coalesce((F.col(a) + F.col(b)) / 2.0, F.col(a), F.col(b))
    return F.least(a, b) + 0.25 * mean


def window_metrics(df: DataFrame, keys: list[str], x: str, entries: str) -> DataFrame:
    """Metrics of the build and selection windows side by side, with the robust score.

    Drawdown runs inside each window, so rows are first keyed by window.
    """
    inside = df.filter(F.col("research_window").isin("build", "selection"))
    inside = with_drawdown(inside, [*keys, "research_window"], "trading_date", x)
    aggregates = []
    for name in ("build", "selection"):
        only = F.col("research_window") == name
        aggregates += metrics(x, f"{name}_", only)
        aggregates.append(
            F.coalesce(F.sum(F.when(only, F.col(entries))), F.lit(0)).cast("long").alias(f"{name}_trades")
        )
    return (
        inside.groupBy(*keys)
        .agg(*aggregates)
        .withColumn("robust_score", robust_score("build_sharpe", "selection_sharpe"))
    )


def date_blocks(df: DataFrame, k: int, order: str = "trading_date", name: str = "block") -> DataFrame:
    """Number k contiguous calendar blocks; the first n mod k are one longer, as ntile does."""
    calendar = df.select(order).distinct().withColumn(
        name, F.ntile(k).over(Window.orderBy(order))
    )
    return df.join(calendar, order)


def stability_audit(df: DataFrame, keys: list[str], x: str, k: int = 4) -> DataFrame:
    """Full-sample Sharpe, Sharpe of each block, positive blocks and the worst block."""
    blocked = date_blocks(df, k)
    only = [F.when(F.col("block") == i + 1, F.col(x)) for i in range(k)]
    out = blocked.groupBy(*keys).agg(
        sharpe(x).alias("full_sharpe"),
        *[sharpe(c).alias(f"fold_{i + 1}_sharpe") for i, c in enumerate(only)],
    )
    folds = [F.col(f"fold_{i + 1}_sharpe") for i in range(k)]
    positive = sum((F.when(f > 0, 1).otherwise(0) for f in folds), F.lit(0))
    return out.withColumns(
        {"positive_folds": positive, "worst_fold_sharpe": F.least(*folds)}
    )


def subperiods(df: DataFrame, keys: list[str], x: str, k: int = 4) -> DataFrame:
    clean = df.filter(F.col(x).isNotNull())
    part = F.ntile(k).over(Window.partitionBy(*keys).orderBy("trading_date"))
    return (
        clean.withColumn("subperiod", part)
        .groupBy(*keys, "subperiod")
        .agg(
            F.min("trading_date").alias("start"),
            F.max("trading_date").alias("end"),
            (F.product(1.0 + F.col(x)) - 1.0).alias("total_return"),
            F.coalesce(sharpe(x), F.lit(0.0)).alias("sharpe"),
        )
    )


def best_days_removed(df: DataFrame, keys: list[str], x: str, levels: tuple[int, ...] = (0, 1, 3, 5, 10)) -> DataFrame:
    """Metrics after dropping the best k days (ties: earlier date first)."""
    clean = df.filter(F.col(x).isNotNull())
    rn = F.row_number().over(
        Window.partitionBy(*keys).orderBy(F.col(x).desc(), F.col("trading_date"))
    )
    ranked = clean.withColumn("rn", rn)
    aggregates = []
    for k in levels:
        kept = F.when(F.col("rn") > k, F.col(x))
        aggregates += [
            (F.product(1.0 + F.coalesce(kept, F.lit(0.0))) - 1.0).alias(f"total_{k}"),
            F.coalesce(sharpe(kept), F.lit(0.0)).alias(f"sharpe_{k}"),
            F.coalesce(F.sum(F.when(F.col("rn") <= k, F.col(x))), F.lit(0.0)).alias(f"cut_{k}"),
        ]
    wide = ranked.groupBy(*keys).agg(F.sum(x).alias("all"), *aggregates)
    rows = F.array(
        *[
            F.struct(
                F.lit(k).alias("best_days_removed"),
                F.col(f"total_{k}").alias("total_return"),
                F.col(f"sharpe_{k}").alias("sharpe"),
                F.when(F.col("all") > 0, F.col(f"cut_{k}") / F.col("all")).alias(
                    "share_of_net_sum_removed"
                ),
            )
            for k in levels
        ]
    )
    return wide.select(*keys, F.inline(rows))


def block_bootstrap(
    df: DataFrame, key: str, x: str, block: int = 20, samples: int = 2000, seed: int = 20260823
) -> DataFrame:
    """Moving-block resampling of each key's series, 5/50/95 % of return and Sharpe.

    Draws come from a seeded hash of (key, sample, draw), so a retried task repeats them.  Every
    start of a block carries the block's sum and sum of squares, and those of the shorter last block.
    A key's starts, at most one per session of the calendar, lie in one array that draws look up, so
    no draw is shuffled or joined.
    """
    w = Window.partitionBy(key).orderBy("trading_date")
    series = df.filter(F.col(x).isNotNull()).select(
        key,
        F.row_number().over(w).alias("place"),
        F.collect_list(F.col(x)).over(w.rowsBetween(0, block - 1)).alias("values"),
        F.count(F.lit(1)).over(Window.partitionBy(key)).alias("n"),
    )

    def plus(total: Column, v: Column) -> Column:
        return F.struct((total["s"] + v["s"]).alias("s"), (total["q"] + v["q"]).alias("q"))

    def sums(values: Column) -> Column:
        pairs = F.transform(values, lambda v: F.struct(v.alias("s"), (v * v).alias("q")))
        return F.aggregate(pairs, nothing, plus)

    nothing = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    rest = (F.col("n") - (blocks - 1) * block).cast("int")
    starts = series.select(
        key, "n", F.struct("place", sums(F.col("values")).alias("whole"), sums(F.slice("values", 1, rest)).alias("last")).alias("start")
    )
    keyed = starts.groupBy(key, "n").agg(F.sort_array(F.collect_list("start")).alias("starts"))

    def drawn(draw: Column) -> Column:
        first = F.pmod(
            F.xxhash64(F.lit(seed), F.col(key), F.col("sample"), draw), F.greatest(F.col("n") - block + 1, F.lit(1))
        )
        start = F.get("starts", first.cast("int"))
        return F.when(draw == blocks - 1, start["last"]).otherwise(start["whole"])

    sampled = keyed.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    total = F.aggregate(F.transform(F.sequence(F.lit(0), blocks - 1), drawn), nothing, plus)
    per_sample = sampled.select(key, "n", total.alias("total")).select(
        key, "n", F.col("total.q").alias("q"), (F.col("total.s") / F.col("n")).alias("mean")
    )
    spread = F.when(
        F.col("n") > 1,
        F.sqrt(F.greatest(F.col("q") - F.col("n") * F.col("mean") ** 2, F.lit(0.0)) / (F.col("n") - 1)),
    )
    per_sample = per_sample.select(
        key, (F.col("mean") * YEAR).alias("ret"), (ratio(F.col("mean"), spread) * math.sqrt(YEAR)).alias("sharpe")
    )
    q = F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))
    out = per_sample.groupBy(key).agg(
        F.percentile("ret", q).alias("r"), F.percentile("sharpe", q).alias("s")
    )
    names = ("p05", "p50", "p95")
    return out.select(
        key,
        *[F.col("r")[i].alias(f"annualized_return_{p}") for i, p in enumerate(names)],
        *[F.col("s")[i].alias(f"sharpe_{p}") for i, p in enumerate(names)],
    )


def information_coefficients(df: DataFrame, keys: list[str], forecast: str, actual: str) -> DataFrame:
    """Pearson, Spearman (average ranks) and directional accuracy on complete rows."""
    clean = df.filter(F.col(forecast).isNotNull() & F.col(actual).isNotNull())
    ranked = clean.withColumns(
        {
            "rank_f": frames.mean_rank(forecast, *keys),
            "rank_a": frames.mean_rank(actual, *keys),
        }
    )

    def corr(a: str, b: str) -> Column:
        flat = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
        return F.when(~flat, F.corr(a, b))

    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"),
        corr(forecast, actual).alias("pearson_ic"),
        corr("rank_f", "rank_a").alias("spearman_ic"),
        F.avg((F.signum(forecast) == F.signum(actual)).cast("double")).alias(
            "directional_accuracy"
        ),
    )


def probability_diagnostics(
    df: DataFrame, keys: list[str], probability: str, actual: str, entry: float = 0.55
) -> DataFrame:
    """Calibration and discrimination; the AUC is the rank-sum form with average ranks."""
    clean = df.filter(F.col(actual).isNotNull())
    p = clip(probability, 1e-6, 1.0 - 1e-6)
    clean = clean.withColumn("p", p).withColumn("y", F.col(actual).cast("double"))
    clean = clean.withColumn("rank", frames.mean_rank("p", *keys))
    hits, n = F.sum("y"), F.count(F.lit(1)).cast("double")
    rank_sum = F.sum(F.col("rank") * F.col("y"))
    return clean.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"),
        F.avg("y").alias("base_rate"),
        F.avg("p").alias("mean_probability"),
        F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier_score"),
        (-F.avg(F.when(F.col("y") == 1, F.log("p")).otherwise(F.log1p(-F.col("p"))))).alias(
            "log_loss"
        ),
        ratio(rank_sum - hits * (hits + 1) / 2.0, hits * (n - hits)).alias("roc_auc"),
        F.avg(((F.col("p") >= entry).cast("double") == F.col("y")).cast("double")).alias(
            "accuracy_at_55pct"
        ),
    )


def gates(df: DataFrame, checks: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """(gate, passed) rows from one-row aggregates, plus the conjunction."""
    named = [F.struct(F.lit(n).alias("gate"), c.alias("passed")) for n, c in checks.items()]
    everything = F.struct(F.lit("all_gates").alias("gate"), all_of(list(checks.values())).alias("passed"))
    return df.select(*(keys or []), F.inline(F.array(*named, everything)))


def candidate_status(annual: str, positive: str) -> Column:
    up, wide = F.col(annual) > 0, F.col(positive) >= 2
    return (
        F.when(up & wide, "candidate").when(up | wide, "research_further").otherwise("reject")
    )


def research_tier(sharpe_column: str, positive: str) -> Column:
    s, n = F.col(sharpe_column), F.col(positive)
    return (
        F.when((s >= 1.5) & (n >= 3), "A_promising")
        .when((s >= 0.75) & (n >= 2), "B_candidate")
        .when(s > 0, "C_exploratory_positive")
        .otherwise("D_exploratory_negative")
    )


# --- closed-trade ledger -----------------------------------------------------------------


def ledger_kpis(trades: DataFrame) -> DataFrame:
    """Net, profit factor, win rate, average and share per strategy and in total (rollup)."""
    pnl = F.col("pnl")
    base = trades.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("pnl").alias("net"),
        F.sum(F.when(pnl > 0, pnl)).alias("won"),
        F.sum(F.when(pnl < 0, -pnl)).alias("lost"),
        F.count_if(pnl > 0).alias("wins"),
    )
    out = base.rollup("strategy").agg(
        F.sum("n").alias("trades"),
        F.sum("net").alias("net_profit"),
        ratio(F.sum("won"), F.sum("lost")).alias("profit_factor"),
        (F.sum("wins") / F.sum("n")).alias("win_rate"),
        (F.sum("net") / F.sum("n")).alias("average_trade"),
    )
    total = base.agg(F.sum("net").alias("t")).scalar()
    return out.withColumns(
        {
            "strategy": F.coalesce("strategy", F.lit("all")),
            "contribution_share": ratio("net_profit", total),
        }
    )


def ledger_daily(trades: DataFrame, capital: float) -> DataFrame:
    """P&L on the close date over the full calendar, equity, high-water mark and drawdown.

    Trades collapse to days first; the ordered pass runs over one row per calendar day.
    """
    daily = trades.groupBy(F.to_date("close_time").alias("day")).agg(F.sum("pnl").alias("pnl"))
    span = daily.agg(F.sequence(F.min("day"), F.max("day")).alias("days"))
    full = span.select(F.explode("days").alias("day")).join(daily, "day", "left")
    run = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    full = full.withColumn("daily_pnl", F.coalesce("pnl", F.lit(0.0))).drop("pnl")
    full = full.withColumn("equity", F.lit(capital) + F.sum("daily_pnl").over(run))
    full = full.withColumn("high_water_mark", F.max("equity").over(run))
    return full.withColumns(
        {
            "drawdown_dollars": F.col("equity") - F.col("high_water_mark"),
            "drawdown_pct": F.col("equity") / F.col("high_water_mark") - 1.0,
        }
    )


def ledger_sharpes(daily: DataFrame, capital: float) -> DataFrame:
    """Sharpe over all calendar days and over weekdays only."""
    ret = F.col("daily_pnl") / capital
    weekday = F.when(F.weekday("day") < 5, ret)
    return daily.agg(
        sharpe(ret).alias("calendar_sharpe"),
        sharpe(weekday).alias("weekday_sharpe"),
        F.min("drawdown_pct").alias("worst_drawdown_pct"),
    )


def _fold_level(df: DataFrame, parents: list[str], order: str) -> DataFrame:
    """Join the stretches of each parent, in order, to one stretch: its total, highest and lowest
    running total and worst drop."""
    before = Window.partitionBy(*parents).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("offset", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
    df = df.withColumns({"top": F.col("offset") + F.col("top"), "bottom": F.col("offset") + F.col("bottom")})
    df = df.withColumn("drop", F.least("drop", F.col("bottom") - F.max("top").over(before)))
    return df.groupBy(*parents).agg(
        F.sum("total").alias("total"), F.max("top").alias("top"),
        F.min("bottom").alias("bottom"), F.min("drop").alias("drop"),
    )


def trade_drawdown(trades: DataFrame, slice_width: int = 1_000_000, sliced_by: str = "ticket") -> DataFrame:
    """Worst drop of trade-by-trade equity in (close time, strategy, ticket) order.

    A stretch of trades is its total, its highest and lowest running total and its worst drop, and two
    stretches in order make one.  Trades become slices of (close time, strategy, ticket range), these
    are joined per strategy, then per close time, then per day; each window stays within its parent,
    so a hot strategy is still many slices and only one row per day reaches the last ordered pass.
    """
    keys = ["day", "close_time", "strategy", "part"]
    df = trades.withColumns(
        {"day": F.to_date("close_time"), "part": F.floor(F.col(sliced_by) / slice_width)}
    )
    run = (
        Window.partitionBy(*keys)
        .orderBy("ticket")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    df = df.withColumn("inside", F.sum("pnl").over(run))
    df = df.withColumn("drop", F.col("inside") - F.max("inside").over(run))
    df = df.groupBy(*keys).agg(
        F.sum("pnl").alias("total"),
        F.max("inside").alias("top"),
        F.min("inside").alias("bottom"),
        F.min("drop").alias("drop"),
    )
    while keys:
        order = keys.pop()
        df = _fold_level(df, keys, order)
    return df.select(F.col("drop").alias("trade_max_drawdown"))


def ledger_monthly(daily: DataFrame) -> DataFrame:
    return (
        daily.groupBy(F.trunc("day", "month").alias("month"))
        .agg(F.sum("daily_pnl").alias("monthly_pnl"))
        .withColumn("sign", F.when(F.col("monthly_pnl") >= 0, "Positive").otherwise("Negative"))
    )


def exact_quantiles(df: DataFrame, x: str, probabilities: list[float], bins: int = 4096) -> DataFrame:
    """Linear-interpolated quantiles of one big column without sorting or collecting it.

    Pass one takes bin edges from approximate quantiles, so bins hold similar numbers of rows whatever
    the outliers, and counts them exactly.  Pass two keeps only the bins that hold a wanted rank,
    collapses them to (value, count) and numbers those.  One output row per probability.
    """
    value = df.select(F.col(x).cast("double").alias("v")).filter("v IS NOT NULL")
    marks = [k / bins for k in range(1, bins)]
    edges, n = value.agg(F.percentile_approx("v", marks, 4 * bins), F.count("v")).first()
    spark = value.sparkSession
    if n == 0:
        return spark.createDataFrame([], "probability double, quantile double")
    inner = sorted({e for e in edges if math.isfinite(e)})
    splits = [-math.inf, *inner, math.inf] if inner else [-math.inf, 0.0, math.inf]
    cut = Bucketizer(splits=splits, inputCol="v", outputCol="bin", handleInvalid="keep")
    binned = cut.transform(value)
    histogram = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    histogram = histogram.withColumn("upto", F.sum("c").over(w))
    spots = [(float(p), (n - 1) * float(p)) for p in probabilities]
    asked = spark.createDataFrame(
        [(p, h, rank) for p, h in spots for rank in {math.floor(h), math.ceil(h)}],
        "probability double, h double, rank long",
    )
    ranks = sorted({f(h) for _, h in spots for f in (math.floor, math.ceil)})
    needed = (
        histogram.withColumn("rank", F.explode(F.array(*[F.lit(k).cast("long") for k in ranks])))
        .filter((F.col("rank") >= F.col("upto") - F.col("c")) & (F.col("rank") < F.col("upto")))
        .select("bin", "rank", (F.col("upto") - F.col("c")).alias("before"))
    )
    values = (
        binned.join(needed.select("bin").distinct(), "bin", "left_semi")
        .groupBy("bin", "v")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    inside = Window.partitionBy("bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("upto", F.sum("c").over(inside))
    at = values.join(needed, "bin").filter(
        (F.col("rank") - F.col("before") >= F.col("upto") - F.col("c"))
        & (F.col("rank") - F.col("before") < F.col("upto"))
    )
    hits = asked.join(at.select("rank", "v"), "rank")
    return hits.groupBy("probability").agg(
        (
            F.min("v") + (F.max("v") - F.min("v")) * (F.max("h") - F.floor(F.max("h")))
        ).alias("quantile")
    )


def histogram(df: DataFrame, x: str, bins: int = 24, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Counts in equal bins between two quantiles; outliers clip into the end bins and the last
    bin is closed."""
    lo, hi = exact_quantiles(df, x, [low, high]).agg(F.min("quantile"), F.max("quantile")).first()
    step = (hi - lo) / bins
    v = F.greatest(F.least(F.col(x), F.lit(hi)), F.lit(lo))
    bucket = F.least(F.floor((v - lo) / step), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(x).isNotNull()).groupBy(bucket.alias("bin")).agg(
        F.count(F.lit(1)).alias("trade_count")
    )
    return counts.select(
        "bin",
        "trade_count",
        (lo + F.col("bin") * step).alias("bin_start"),
        (lo + (F.col("bin") + 1) * step).alias("bin_end"),
    )


# --- feature audits ----------------------------------------------------------------------


def feature_quality(features: DataFrame, names: list[str], warm_up: int = 120) -> DataFrame:
    """Missing share (all rows and after the warm-up), distinct values, quantiles, robust outliers."""
    rn = F.row_number().over(Window.partitionBy("symbol").orderBy("trading_date"))
    long = (
        features.withColumn("rn", rn)
        .unpivot(["symbol", "trading_date", "rn"], names, "feature", "x")
    )
    q = F.percentile("x", F.array(*[F.lit(p) for p in (0.01, 0.25, 0.5, 0.75, 0.99)]))
    stats = long.groupBy("feature").agg(
        (100.0 * F.avg(F.col("x").isNull().cast("double"))).alias("missing_pct"),
        (100.0 * F.avg(F.when(F.col("rn") > warm_up, F.col("x").isNull().cast("double")))).alias(
            "missing_after_warmup_pct"
        ),
        F.count_distinct("x").alias("distinct_values"),
        q.alias("q"),
    )
    far = F.abs(F.col("x") - F.col("q")[2]) > 5.0 * (F.col("q")[3] - F.col("q")[1])
    outliers = (
        long.join(stats.select("feature", "q"), "feature")
        .groupBy("feature")
        .agg((100.0 * F.avg(F.when(F.col("x").isNotNull(), far.cast("double")))).alias("robust_outlier_pct"))
    )
    return stats.join(outliers, "feature").select(
        "feature", "missing_pct", "missing_after_warmup_pct", "distinct_values",
        F.col("q")[2].alias("median"), F.col("q")[0].alias("p01"), F.col("q")[4].alias("p99"),
        "robust_outlier_pct",
    )


def feature_drift(features: DataFrame, names: list[str]) -> DataFrame:
    """Shift of the median between the early and the late half, over the pooled IQR."""
    halves = date_blocks(features, 2).unpivot(["symbol", "trading_date", "block"], names, "feature", "x")
    x = F.col("x")
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)))
    out = halves.groupBy("feature").agg(
        F.percentile(F.when(F.col("block") == 1, x), F.lit(0.5)).alias("early_median"),
        F.percentile(F.when(F.col("block") == 2, x), F.lit(0.5)).alias("late_median"),
        q.alias("q"),
    )
    iqr = F.col("q")[1] - F.col("q")[0]
    return out.select(
        "feature", "early_median", "late_median",
        ratio(F.col("late_median") - F.col("early_median"), iqr).alias("median_shift_iqr"),
    )


def describe(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    names = ("p01", "p05", "p25", "p50", "p75", "p95", "p99")
    q = F.percentile(x, F.array(*[F.lit(int(n[1:]) / 100.0) for n in names]))
    out = df.groupBy(*keys).agg(
        F.count(x).alias("observations"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("deviation"),
        F.min(x).alias("minimum"),
        F.max(x).alias("maximum"),
        q.alias("q"),
        volatility(x).alias("annualized_volatility"),
    )
    return out.withColumns({n: F.col("q")[i] for i, n in enumerate(names)}).drop("q")


# --- intraday attribution ------------------------------------------------------------------


def component_information(df: DataFrame, components: list[str], ret: str) -> DataFrame:
    """Pooled correlation of each score component with the next row's return in its session."""
    w = Window.partitionBy("symbol", "trading_date").orderBy("timestamp_utc")
    ahead = df.withColumn("ahead", F.lead(ret).over(w))
    long = ahead.unpivot(["symbol", "trading_date", "ahead"], components, "component", "score")
    both = F.col("score").isNotNull() & F.col("ahead").isNotNull()
    return long.filter(both).groupBy("component").agg(
        F.count(F.lit(1)).alias("observations"), F.corr("score", "ahead").alias("next_return_ic")
    )


def quartile_attribution(df: DataFrame, score: str, active: str, contribution: str) -> DataFrame:
    return df.groupBy("time_quartile", "range_quartile").agg(
        F.count(F.lit(1)).alias("observations"),
        F.avg((F.col(active) != 0).cast("double")).alias("active_share"),
        F.avg(F.abs(score)).alias("mean_absolute_score"),
        F.sum(contribution).alias("contribution"),
    )


def symbol_day_attribution(df: DataFrame, score: str, active: str, weight: str, contribution: str) -> DataFrame:
    return df.groupBy("symbol", "trading_date").agg(
        F.avg(score).alias("mean_score"),
        F.count_if(F.col(active) != 0).alias("active_minutes"),
        F.avg(F.abs(weight)).alias("mean_absolute_weight"),
        F.sum(contribution).alias("contribution"),
    )


def dominant_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """How often each column is the largest of its row (first one on ties)."""
    values = F.array(*[F.col(n) for n in names])
    label = F.array(*[F.lit(n) for n in names])[F.array_position(values, F.array_max(values)).cast("int") - 1]
    known = df.filter(all_of([F.col(n).isNotNull() for n in names]))
    return known.groupBy(label.alias("dominant")).agg(F.count(F.lit(1)).alias("rows_seen"))
