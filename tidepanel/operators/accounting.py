"""Positions to returns: lags, turnover, costs and set-based allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import frames
from tidepanel.functions.scalars import clip, col, ratio

DATE, SYMBOL = "trading_date", "symbol"


def lag_positions(df: DataFrame, keys: list[str], weight: str = "weight", k: int = 1, name: str = "implemented") -> DataFrame:
    """Weight held on a row is the one decided k rows earlier; none before that."""
    if k < 1:
        raise ValueError("positions must be lagged by at least one period")
    w = frames.ordered([*keys, SYMBOL], DATE)
    return df.withColumn(name, F.coalesce(F.lag(weight, k).over(w), F.lit(0.0)))


def turnover(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Half the absolute weight change summed per date; the first date counts zero."""
    w = frames.ordered([*keys, SYMBOL], DATE)
    change = F.abs(F.col(weight) - F.lag(weight).over(w))
    return (
        df.withColumn("change", change)
        .groupBy(*keys, DATE)
        .agg((F.coalesce(F.sum("change"), F.lit(0.0)) / 2.0).alias("turnover"))
    )


def net_returns(
    returns: DataFrame, weights: DataFrame, keys: list[str], bps: float = 0.0, lag: int = 1
) -> DataFrame:
    """Gross, turnover, cost and net per date on rows both tables have.

    One window per (strategy, symbol) gives the lagged weight and its change together, then one
    grouping per (strategy, date).
    """
    if bps < 0:
        raise ValueError("cost cannot be negative")
    both = weights.select(*keys, DATE, SYMBOL, "weight").join(
        returns.select(DATE, SYMBOL, "ret"), [DATE, SYMBOL]
    )
    w = frames.ordered([*keys, SYMBOL], DATE)
    held = F.coalesce(F.lag("weight", lag).over(w), F.lit(0.0))
    before = F.when(
        F.row_number().over(w) > 1, F.coalesce(F.lag("weight", lag + 1).over(w), F.lit(0.0))
    )
    both = both.withColumns({"held": held, "change": F.abs(held - before)})
    return (
        both.groupBy(*keys, DATE)
        .agg(
            F.coalesce(F.sum(F.col("held") * F.col("ret")), F.lit(0.0)).alias("gross"),
            (F.coalesce(F.sum("change"), F.lit(0.0)) / 2.0).alias("turnover"),
            F.sum(F.abs("held")).alias("gross_exposure"),
            F.sum("held").alias("net_exposure"),
        )
        .withColumn("cost", F.col("turnover") * bps / 10_000.0)
        .withColumn("net", F.col("gross") - F.col("cost"))
    )


def trade_sides(position: str, keys: list[str], order: str) -> Column:
    """Position change inside the session plus closing what is left on its last bar.

    ``keys`` must contain the session, so a change never spans two of them.
    """
    w = frames.ordered(keys, order)
    p = F.col(position)
    change = F.abs(p - F.coalesce(F.lag(p).over(w), F.lit(0.0)))
    closing = F.when(F.lead(p).over(w).isNull(), F.abs(p)).otherwise(0.0)
    return change + closing


def session_closed_pnl(bars: DataFrame, keys: list[str], position: str, target: str, order: str = "timestamp_utc") -> DataFrame:
    """Daily gross and sides of bar positions that never leave their session."""
    sides = trade_sides(position, [*keys, SYMBOL, DATE], order)
    return (
        bars.withColumns({"sides": sides, "gross": F.col(position) * F.coalesce(target, F.lit(0.0))})
        .groupBy(*keys, SYMBOL, DATE)
        .agg(F.sum("gross").alias("gross"), F.sum("sides").alias("sides"))
    )


def active_leg_portfolio(legs: DataFrame, keys: list[str], bps: float) -> DataFrame:
    """Mean net return of the active legs per date, zero when none; round-trip cost per leg."""
    p = F.col("position")
    net = p * F.coalesce("ret", F.lit(0.0)) - F.abs(p) * 2.0 * bps / 10_000.0
    return legs.groupBy(*keys, DATE).agg(
        F.coalesce(ratio(F.sum(net), F.sum(F.abs(p))), F.lit(0.0)).alias("net"),
        F.sum(F.abs(p)).alias("active_legs"),
    )


def hourly_pnl(df: DataFrame, keys: list[str], time: str, target: str, ret: str, bps: float) -> DataFrame:
    """Next-bar implementation of dense hourly target weights with half-turnover cost.

    What is still held on the last bar is charged as liquidated there.
    """
    w = frames.ordered([*keys, SYMBOL], time)
    held = F.coalesce(F.lag(F.coalesce(target, F.lit(0.0))).over(w), F.lit(0.0))
    df = df.withColumn("held", held)
    before = F.lag("held").over(w)
    last = F.lead(time).over(w).isNull()
    change = F.abs(F.col("held") - F.coalesce(before, F.lit(0.0))) / 2.0
    df = df.withColumn(
        "turn", change + F.when(last, F.abs("held") / 2.0).otherwise(0.0)
    )
    return (
        df.groupBy(*keys, time)
        .agg(
            F.sum(F.col("held") * F.coalesce(ret, F.lit(0.0))).alias("gross_return"),
            F.sum("turn").alias("turnover"),
            F.sum(F.abs("held")).alias("gross_exposure"),
        )
        .withColumn("cost", F.col("turnover") * bps / 10_000.0)
        .withColumn("net_return", F.col("gross_return") - F.col("cost"))
    )


def probability_weight(
    probability: str, displacement: str, sigma: str, entry: float = 0.55, risk: float = 0.10 / 2**0.5,
    cap: float = 0.25,
) -> Column:
    """Confidence above the entry probability, against the displacement, scaled by risk."""
    confidence = clip((F.col(probability) - entry) / (1.0 - entry), 0.0, 1.0)
    direction = -F.signum(F.col(displacement))
    return clip(ratio(direction * confidence * risk, sigma), -cap, cap)


def entry_count(df: DataFrame, keys: list[str], time: str, target: str) -> DataFrame:
    """Rows where a position opens or flips, and times with any position."""
    w = frames.ordered([*keys, SYMBOL], time)
    before = F.coalesce(F.lag(target).over(w), F.lit(0.0))
    opens = (F.col(target) != 0) & (
        (before == 0) | (F.signum(F.col(target)) != F.signum(before))
    )
    per_time = (
        df.withColumn("opens", opens)
        .groupBy(*keys, time)
        .agg(F.count_if("opens").alias("entries"), F.sum(F.abs(target)).alias("gross"))
    )
    return per_time.groupBy(*keys).agg(
        F.sum("entries").alias("entries"), F.count_if(F.col("gross") > 0).alias("active_hours")
    )


def balance_long_short(score: Column, keys: list[str], net_limit: float) -> Column:
    """Long and short books of one date, net clipped to the limit.

    A one-sided date is re-centred on its median first; if a side is still empty all weights
    are zero.
    """
    w = Window.partitionBy(*keys)
    longs = F.sum(F.when(score > 0, 1).otherwise(0)).over(w)
    shorts = F.sum(F.when(score < 0, 1).otherwise(0)).over(w)
    centred = score - F.percentile(score, F.lit(0.5)).over(w)
    working = F.when((longs == 0) | (shorts == 0), centred).otherwise(score)
    up, down = F.greatest(working, F.lit(0.0)), -F.least(working, F.lit(0.0))
    long_total, short_total = F.sum(up).over(w), F.sum(down).over(w)
    net = F.greatest(
        F.least((long_total - short_total) / (long_total + short_total), F.lit(net_limit)),
        F.lit(-net_limit),
    )
    weight = (1.0 + net) / 2.0 * up / long_total - (1.0 - net) / 2.0 * down / short_total
    return F.when((long_total > 0) & (short_total > 0), weight).otherwise(0.0)


def market_neutral(score: Column, keys: list[str]) -> Column:
    """Scores centred on the date's median, half the book on each side."""
    w = Window.partitionBy(*keys)
    centred = score - F.percentile(score, F.lit(0.5)).over(w)
    up, down = F.greatest(centred, F.lit(0.0)), -F.least(centred, F.lit(0.0))
    long_total, short_total = F.sum(up).over(w), F.sum(down).over(w)
    return F.when(
        (long_total > 0) & (short_total > 0), 0.5 * up / long_total - 0.5 * down / short_total
    )


def volatility_target(
    df: DataFrame, keys: list[str], weight: str, history: str, target: float = 0.10, cap: float = 2.0
) -> DataFrame:
    """Leverage weights to a volatility from the shrunk trailing covariance.

    ``history`` is each row's array of (age, return) of complete past rows.  The portfolio's
    exponentially weighted variance is that of its past return series, so the quadratic form
    never needs the covariance of every symbol pair.
    """
    past = df.select(*keys, DATE, weight, F.inline(history).alias("age", "x"))
    series = past.groupBy(*keys, DATE, "age").agg(F.sum(F.col(weight) * F.col("x")).alias("p"))
    port = series.groupBy(*keys, DATE).agg(ew_variance("p", "age").alias("port"))
    own = df.groupBy(*keys, DATE).agg(
        F.sum(F.pow(weight, F.lit(2)) * F.col("variance")).alias("own")
    )
    sigma = F.sqrt(0.8 * F.col("port") + 0.2 * F.col("own")) * 252.0**0.5
    lever = F.when(sigma > 0, F.least(target / sigma, F.lit(cap))).otherwise(0.0)
    scale = port.join(own, [*keys, DATE]).select(*keys, DATE, lever.alias("leverage"))
    return df.join(scale, [*keys, DATE])


def ew_variance(x: str, age: str, half_life: float = 20.0) -> Column:
    """Bias-corrected exponentially weighted variance; ``age`` is rows since the newest."""
    w = F.pow(F.lit(0.5), F.col(age) / half_life)
    total, square = F.sum(w), F.sum(w * w)
    mean = F.sum(w * F.col(x)) / total
    raw = F.sum(w * F.col(x) * F.col(x)) / total - mean * mean
    return F.greatest(raw, F.lit(0.0)) * total * total / (total * total - square)


def cap_net(df: DataFrame, keys: list[str], weight: str, limit: float = 0.25) -> Column:
    """If leverage pushed the net past the limit, split the gross again around the limit."""
    w = Window.partitionBy(*keys, DATE)
    x = F.col(weight)
    net, gross = F.sum(x).over(w), F.sum(F.abs(x)).over(w)
    bound = F.greatest(F.least(net, F.lit(limit)), F.lit(-limit))
    up, down = F.greatest(x, F.lit(0.0)), -F.least(x, F.lit(0.0))
    split = (
        up / F.sum(up).over(w) * (gross + bound) / 2.0
        - down / F.sum(down).over(w) * (gross - bound) / 2.0
    )
    return F.when(F.abs(net) > limit, split).otherwise(x)


def trailing_history(returns: DataFrame, lookback: int = 60) -> DataFrame:
    """Per (date, symbol): array of (age, return) over the complete rows of the last n sessions.

    A session is complete when every symbol of the panel has a return.  Ages count complete
    rows from the newest one in the window.  ``returns`` is dense: (cal, date, symbol, ret).
    """
    members = returns.agg(F.count_distinct(SYMBOL).alias("n")).scalar()
    w = Window.partitionBy("cal")
    full = F.count("ret").over(w) == F.col("members")
    df = returns.withColumn("members", members).withColumn("full", full)
    n = F.sum(F.col("full").cast("int")).over(
        frames.ordered(SYMBOL, "cal").rowsBetween(Window.unboundedPreceding, 0)
    )
    df = df.withColumn("complete_no", n)
    frame = frames.ordered(SYMBOL, "cal").rowsBetween(-(lookback - 1), 0)
    item = F.when(
        F.col("full"), F.struct(F.col("complete_no").alias("no"), F.col("ret").alias("x"))
    )
    held = F.collect_list(item).over(frame)
    top = F.col("complete_no")
    out = df.withColumn("held", held)
    history = F.transform(
        "held", lambda h: F.struct((top - h["no"]).alias("age"), h["x"].alias("x"))
    )
    out = out.withColumn("history", history)
    return out.filter((F.size("history") >= 20) & (F.col("cal") >= lookback)).select(
        DATE, SYMBOL, "cal", "history"
    )


def history_variance(history: DataFrame) -> DataFrame:
    """Exponentially weighted variance of every symbol from its history array."""
    long = history.select(DATE, SYMBOL, F.inline("history").alias("age", "x"))
    own = long.groupBy(DATE, SYMBOL).agg(ew_variance("x", "age").alias("variance"))
    return history.join(own, [DATE, SYMBOL])


def covariance_target_weights(
    scores: DataFrame, history: DataFrame, keys: list[str], neutral: bool = False,
    net_limit: float = 0.25, least_assets: int = 3, target: float = 0.10, cap: float = 2.0,
) -> DataFrame:
    """Weights per (strategy, date, symbol) from scores and the trailing shrunk covariance.

    ``history`` comes from ``history_variance``.  ``neutral`` uses the median-centred half/half
    book on raw scores; otherwise scores are divided by volatility and balanced with a net cap.
    """
    df = scores.filter(F.col("score").isNotNull()).join(history, [DATE, SYMBOL])
    w = Window.partitionBy(*keys, DATE)
    df = df.withColumn("assets", F.count(F.lit(1)).over(w)).filter(F.col("assets") >= least_assets)
    if neutral:
        book = market_neutral(F.col("score"), [*keys, DATE])
    else:
        sigma = F.greatest(F.sqrt("variance"), F.lit(1e-8))
        df = df.withColumn("risk_score", F.col("score") / sigma)
        book = balance_long_short(F.col("risk_score"), [*keys, DATE], net_limit)
    df = df.withColumn("book", book).filter(F.col("book").isNotNull())
    df = volatility_target(df, keys, "book", "history", target, cap)
    df = df.withColumn("weight", F.col("book") * F.col("leverage"))
    if not neutral:
        df = df.withColumn("weight", cap_net(df, keys, "weight", net_limit))
    return df.select(*keys, DATE, SYMBOL, "weight")


def water_fill(df: DataFrame, keys: list[str], volatility: str, cap: float) -> DataFrame:
    """Inverse-volatility weights with a per-asset cap, excess shared by the uncapped.

    In descending score order the capped set is a prefix.  With j capped, the rest share
    1 - j*cap by score; the smallest j for which the largest uncapped weight fits is the answer,
    so running sums replace the loop.
    """
    if not 0.0 < cap <= 1.0:
        raise ValueError("cap must be in (0, 1]")
    w = Window.partitionBy(*keys)
    score = 1.0 / F.col(volatility)
    df = df.withColumns({"score": score, "n": F.count(F.lit(1)).over(w)})
    order = w.orderBy(F.col("score").desc(), F.col(SYMBOL))
    df = df.withColumns(
        {
            "j": F.row_number().over(order) - 1,
            "left": F.sum("score").over(
                order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
            ),
        }
    )
    share = F.col("score") / F.col("left") * (1.0 - F.col("j") * cap)
    df = df.withColumn("fits", F.when(share <= cap + 1e-15, F.col("j")))
    df = df.withColumn("first", F.min("fits").over(w))
    pool = F.max(F.when(F.col("j") == F.col("first"), F.col("left"))).over(w)
    weight = F.when(F.col("j") < F.col("first"), F.lit(cap)).otherwise(
        F.col("score") / pool * (1.0 - F.col("first") * cap)
    )
    feasible = F.when(
        F.col("n") * cap < 1.0, F.raise_error(F.lit("cap is infeasible for the number of assets"))
    ).otherwise(weight)
    return df.withColumn("weight", feasible).drop("score", "n", "j", "left", "fits", "first")


def redistribute_excess(df: DataFrame, keys: list[str], volatility: str, cap: float, name: str = SYMBOL) -> DataFrame:
    """Inverse-volatility weights whose excess over the cap goes to those below it, n passes.

    Not the same fixed point as ``water_fill``: an asset sitting exactly at the cap is still
    below it and receives.  Weights of one portfolio form one array (its members), and the
    passes are a fold over it.
    """
    raw = F.coalesce(1.0 / F.when(F.col(volatility) != 0, F.col(volatility)), F.lit(0.0))
    packed = df.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), raw.alias("w")))).alias("m")
    )

    def total(ws: Column) -> Column:
        return F.aggregate(ws, F.lit(0.0), lambda s, x: s + x)

    def one_pass(ws: Column, _: Column) -> Column:
        excess = F.aggregate(
            ws, F.lit(0.0), lambda s, x: s + F.when(x > cap, x - cap).otherwise(0.0)
        )
        under = F.aggregate(ws, F.lit(0.0), lambda s, x: s + F.when(x > cap, 0.0).otherwise(x))
        return F.transform(
            ws,
            lambda x: F.when(x > cap, F.lit(cap)).otherwise(
                F.when(under > 0, x + excess * x / under).otherwise(x)
            ),
        )

    start = F.transform("m", lambda e: e["w"])
    packed = packed.withColumn("w0", start)
    packed = packed.withColumn("w0", F.transform("w0", lambda x: x / total(F.col("w0"))))
    packed = packed.withColumn(
        "w1", F.aggregate(F.sequence(F.lit(1), F.size("w0")), F.col("w0"), one_pass)
    )
    packed = packed.withColumn("w2", F.transform("w1", lambda x: x / total(F.col("w1"))))
    return packed.select(
        *keys, F.inline(F.arrays_zip(F.transform("m", lambda e: e["k"]), "w2")).alias(name, "weight")
    )


def leverage_for(volatility: Column, target: float = 0.10, cap: float = 2.0) -> Column:
    """Leverage to the target; one where volatility is zero."""
    return F.when(volatility > 0, F.least(target / volatility, F.lit(cap))).otherwise(1.0)


def mean_sleeve(df: DataFrame, keys: list[str], value: str = "net") -> DataFrame:
    """Equal weight of the member series that have a value on the date."""
    return df.groupBy(*keys, DATE).agg(F.avg(value).alias(value))


def causal_volatility_balance(
    sleeves: DataFrame, name: str, value: str = "net", target: float = 0.10, lookback: int = 60, least: int = 20
) -> DataFrame:
    """Equal mean, and the mean of sleeves scaled by earlier volatility, scaled once more."""

    def scale(prior: Column) -> Column:
        return F.when(prior > 0, clip(target / prior, 0.25, 2.0)).otherwise(1.0)

    prior = frames.rows(name, DATE, lookback, least, end=-1).std(value) * 252.0**0.5
    df = sleeves.withColumn("scaled", F.col(value) * F.coalesce(scale(prior), F.lit(1.0)))
    daily = df.groupBy(DATE).agg(
        F.avg(value).alias("equal_weight"), F.avg("scaled").alias("balanced")
    )
    w = Window.orderBy(DATE).rowsBetween(-lookback, -1)
    port = F.when(F.count("balanced").over(w) >= least, F.stddev_samp("balanced").over(w)) * 252.0**0.5
    return daily.select(
        DATE, "equal_weight",
        (F.col("balanced") * F.coalesce(scale(port), F.lit(1.0))).alias("causal_volatility_balanced"),
    )


def two_sleeve_mix(df: DataFrame, a: str, b: str, lookbacks: tuple[int, ...] = (20, 40, 60, 90, 120)) -> DataFrame:
    """Prior inverse-volatility mix of two aligned sleeves for each lookback, 50/50 until known."""
    df = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    mixes = []
    for n in lookbacks:
        least = max(10, n // 3)
        w = Window.orderBy(DATE).rowsBetween(-n, -1)

        def inverse(x: str, w=w, least: int = least) -> Column:
            s = F.when(F.count(x).over(w) >= least, F.stddev_samp(x).over(w))
            return 1.0 / F.when(s != 0, s)

        ia, ib = inverse(a), inverse(b)
        total = F.coalesce(ia, F.lit(0.0)) + F.coalesce(ib, F.lit(0.0))
        wa = F.coalesce(ratio(ia, total), F.lit(0.5))
        wb = F.coalesce(ratio(ib, total), F.lit(0.5))
        mixes.append(
            F.struct(F.lit(n).alias("lookback"), (wa * F.col(a) + wb * F.col(b)).alias("mixed"))
        )
    return df.select(DATE, F.array(*mixes).alias("mixes")).select(DATE, F.inline("mixes"))


def static_weights(df: DataFrame, name: str, value: str, only: Column) -> DataFrame:
    """Equal and inverse-volatility weights fitted on the selected rows only."""
    fitted = df.groupBy(name).agg(F.stddev_samp(F.when(only, F.col(value))).alias("s"))
    w = Window.partitionBy()
    inverse = F.coalesce(1.0 / F.when(F.col("s") != 0, F.col("s")), F.lit(0.0))
    return fitted.select(
        name,
        (1.0 / F.count(F.lit(1)).over(w)).alias("equal_weight"),
        (inverse / F.sum(inverse).over(w)).alias("inverse_volatility"),
    )


def weighted_portfolio(df: DataFrame, weights: DataFrame, name: str, value: str, columns: tuple[str, ...]) -> DataFrame:
    return df.join(weights, name).groupBy(DATE).agg(
        *[F.sum(F.col(value) * F.col(c)).alias(c) for c in columns]
    )


def dollar_change(bars: DataFrame, instruments: DataFrame, contracts: Column) -> DataFrame:
    """Price change times multiplier times contracts, from the instrument dimension."""
    w = frames.ordered(SYMBOL, DATE)
    change = F.col("close") - F.lag("close").over(w)
    return bars.withColumn("change", change).join(instruments, SYMBOL, "left").withColumn(
        "dollar_pnl", F.col("change") * F.col("multiplier") * contracts
    )


SESSION_MINUTES = 23 * 60


def minute_weights(
    df: DataFrame, signal: str, every: int = 15, limit: float = 0.25, history: int = 240, least: int = 120
) -> DataFrame:
    """Minute targets: risk-scaled signals balanced per timestamp, reset on rebalance minutes.

    Between rebalances a symbol keeps its last target.  A weight is held only on a row exactly
    one minute after the row that decided it, in the same session.
    """
    w = frames.ordered(SYMBOL, "timestamp_utc")
    risk = frames.rows(SYMBOL, "timestamp_utc", history, least).std("return_1m")
    df = df.withColumn("risk_score", ratio(signal, risk))
    at = Window.partitionBy("timestamp_utc")
    x = F.col("risk_score")
    long0 = F.sum(F.greatest(x, F.lit(0.0))).over(at)
    short0 = F.sum(-F.least(x, F.lit(0.0))).over(at)
    one_sided = (F.coalesce(long0, F.lit(0.0)) == 0) | (F.coalesce(short0, F.lit(0.0)) == 0)
    centred = x - F.percentile(x, F.lit(0.5)).over(at)
    df = df.withColumn("working", F.when(one_sided, centred).otherwise(x))
    up = F.when(F.col("working").isNotNull(), F.greatest("working", F.lit(0.0)))
    down = F.when(F.col("working").isNotNull(), -F.least("working", F.lit(0.0)))
    long_total = F.sum(up).over(at)
    short_total = F.sum(down).over(at)
    long_total = F.when(long_total != 0, long_total)
    short_total = F.when(short_total != 0, short_total)
    net = clip((long_total - short_total) / (long_total + short_total), -limit, limit)
    target = (1.0 + net) / 2.0 * up / long_total - (1.0 - net) / 2.0 * down / short_total
    rebalance = (F.col("session_minute") % every == 0) | (
        F.col("session_minute") >= SESSION_MINUTES - 5
    )
    df = df.withColumn("decided", F.when(rebalance, F.coalesce(target, F.lit(0.0))))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn(
        "target_weight", F.coalesce(F.last("decided", ignorenulls=True).over(run), F.lit(0.0))
    )
    step = F.unix_timestamp("timestamp_utc") - F.unix_timestamp(F.lag("timestamp_utc").over(w))
    adjacent = (step == 60) & (F.lag(DATE).over(w) == F.col(DATE))
    held = F.when(adjacent, F.lag("target_weight").over(w))
    return df.withColumn("implemented_weight", F.coalesce(held, F.lit(0.0))).drop(
        "risk_score", "working", "decided"
    )


def volatility_scaled_daily(df: DataFrame, bps: float = 3.5, target: float = 0.10, history: int = 20) -> DataFrame:
    """Daily gross, turnover, cost and exposure of minute weights scaled by earlier volatility.

    The drawdown feedback of a path-dependent simulation is left out on purpose.
    """
    gross = F.col("implemented_weight") * F.coalesce("return_1m", F.lit(0.0))
    base = df.groupBy(DATE).agg(F.sum(gross).alias("base"))
    w = Window.orderBy(DATE).rowsBetween(-history, -1)
    prior = F.when(F.count("base").over(w) >= history, F.stddev_samp("base").over(w)) * 252.0**0.5
    scale = base.select(
        DATE,
        # No variation at all earns the largest scale; an unknown one leaves the weights alone.
        F.when(prior == 0, 2.0)
        .otherwise(F.coalesce(clip(target / prior, 0.25, 2.0), F.lit(1.0)))
        .alias("risk_scale"),
    )
    df = df.join(scale, DATE).withColumn(
        "actual", F.col("implemented_weight") * F.col("risk_scale")
    )
    run = frames.ordered(SYMBOL, "timestamp_utc")
    df = df.withColumn(
        "turn", F.abs(F.col("actual") - F.coalesce(F.lag("actual").over(run), F.lit(0.0))) / 2.0
    )
    per_minute = df.groupBy(DATE, "timestamp_utc").agg(
        F.sum(F.col("actual") * F.coalesce("return_1m", F.lit(0.0))).alias("g"),
        F.sum("turn").alias("t"),
        F.sum(F.abs("actual")).alias("e"),
    )
    return (
        per_minute.groupBy(DATE)
        .agg(
            F.sum("g").alias("gross_return"), F.sum("t").alias("turnover"),
            F.avg("e").alias("gross_exposure"),
        )
        .withColumn("cost", F.col("turnover") * bps / 10_000.0)
        .withColumn("net_return", F.col("gross_return") - F.col("cost"))
    )
