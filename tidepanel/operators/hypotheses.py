"""Rule families as long tables of positions and costed daily returns.

Every family computes each distinct score once, then explodes thresholds and directions from
literals.  Bar positions live inside their session; session positions act on the next session.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.functions import frames
from tidepanel.functions.scalars import binary_entropy, clip, ratio
from tidepanel.operators import accounting, calendar

VARIANT = ("lookback", "threshold", "direction")
SESSION = ("symbol", "trading_date")
BAR = "timestamp_utc"


def fan(df: DataFrame, scores: dict[int, Column | str], keep: list[str]) -> DataFrame:
    """One row per lookback with its score in ``observed``."""
    rows = [
        F.struct(F.lit(k).alias("lookback"), (F.col(s) if isinstance(s, str) else s).alias("observed"))
        for k, s in scores.items()
    ]
    return df.select(*keep, F.array(*rows).alias("rows")).select(*keep, F.inline("rows"))


def with_rules(df: DataFrame, thresholds: tuple[float, ...], directions: tuple[int, ...] = (1,)) -> DataFrame:
    rules = F.array(
        *[
            F.struct(F.lit(float(t)).alias("threshold"), F.lit(d).alias("direction"))
            for t in thresholds
            for d in directions
        ]
    )
    return df.select("*", F.inline(rules))


def thresholded(observed: Column | str = "observed", sign: Column | None = None) -> Column:
    """Direction times the sign of a score at least as large as the threshold, else zero."""
    x = F.col(observed) if isinstance(observed, str) else observed
    side = F.signum(x) if sign is None else sign
    return F.coalesce(
        F.when(F.abs(x) >= F.col("threshold"), side * F.col("direction")), F.lit(0.0)
    )


def zscore(x: Column | str, key: str, order: str, history: int = 160, least: int = 40, bound: float | None = 6.0) -> Column:
    """Distance from the mean of the rows before, in their deviations."""
    f = frames.rows(key, order, history, least, end=-1)
    x = F.col(x) if isinstance(x, str) else x
    z = ratio(x - f.mean(x), f.std(x))
    return z if bound is None else clip(z, -bound, bound)


def cal_zscore(x: Column | str, history: int = 160, least: int = 40, bound: float | None = 6.0) -> Column:
    """The same over positions of the shared bar calendar."""
    f = frames.steps("symbol", "cal", history, least, end=-1)
    x = F.col(x) if isinstance(x, str) else x
    z = ratio(x - f.mean(x), f.std(x))
    return z if bound is None else clip(z, -bound, bound)


def next_session(df: DataFrame, x: str = "observed") -> DataFrame:
    """Move each variant's score to the symbol's next session row."""
    w = frames.ordered(["symbol", "lookback"], "trading_date")
    return df.withColumn(x, F.lag(x).over(w))


def session_result(df: DataFrame, target: str = "target") -> DataFrame:
    """Daily gross and sides of positions opened and closed inside one session."""
    return df.withColumns(
        {
            "gross": F.col("position") * F.coalesce(target, F.lit(0.0)),
            "sides": F.abs("position") * 2.0,
        }
    ).select(*SESSION, *VARIANT, "gross", "sides")


def bar_result(df: DataFrame) -> DataFrame:
    """Daily gross and sides of bar positions, per variant."""
    return accounting.session_closed_pnl(df, list(VARIANT), "position", "bar_return", BAR)


def earlier_in_session(x: str) -> Column:
    """The variant's score one bar earlier, only if that bar is in the same session."""
    return F.lag(x).over(frames.ordered(["symbol", "trading_date", "lookback"], BAR))


def sessions_of(bars: DataFrame) -> DataFrame:
    """Session summary of bars: OHLC, return, range, signed variances, first and last bars."""
    r = F.col("bar_return")
    out = bars.groupBy(*SESSION).agg(
        F.min_by("open", BAR).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", BAR).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum(F.pow(F.greatest(r, F.lit(0.0)), F.lit(2))).alias("up_variance"),
        F.sum(F.pow(F.least(r, F.lit(0.0)), F.lit(2))).alias("down_variance"),
        F.min_by("close", BAR).alias("first_close"),
        F.max_by("open", BAR).alias("last_open"),
        F.max(F.when(F.col("ordinal") == 1, F.col("open"))).alias("second_open"),
    )
    return out.withColumns(
        {
            "session_return": F.col("close") / F.col("open") - 1.0,
            "range_fraction": (F.col("high") - F.col("low")) / F.col("open"),
        }
    )


def h002_semivariance(sessions: DataFrame, lookbacks=(2, 5, 10, 20)) -> DataFrame:
    total = F.col("up_variance") + F.col("down_variance")
    lean = ratio(F.abs(F.col("up_variance") - F.col("down_variance")), total)
    df = sessions.withColumns({"lean": lean, "target": F.col("session_return")})
    scores = {}
    for n in lookbacks:
        f = frames.rows("symbol", "trading_date", n)
        scores[n] = F.signum(f.sum("session_return")) * f.mean("lean")
    df = next_session(fan(df, scores, [*SESSION, "target"]))
    df = with_rules(df, (0.25, 0.50, 0.75), (-1, 1))
    return session_result(df.withColumn("position", thresholded()))


def h003_opening_window(sessions: DataFrame, lookbacks=(20, 60), least: int = 40) -> DataFrame:
    opening = F.col("first_close") / F.col("open") - 1.0
    df = sessions.withColumns(
        {"opening": opening, "target": F.col("close") / F.col("last_open") - 1.0}
    )
    scores = {n: zscore("opening", "symbol", "trading_date", 2 * n, least) for n in lookbacks}
    df = with_rules(fan(df, scores, [*SESSION, "target"]), (0.0, 0.5, 1.0), (-1, 1))
    return session_result(df.withColumn("position", thresholded()))


def h004_compressed_breakout(sessions: DataFrame, lookbacks=(10, 20, 40), quantiles=(0.20, 0.35)) -> DataFrame:
    w = frames.ordered("symbol", "trading_date")
    breakout = (
        F.when(F.col("first_close") > F.lag("high").over(w), 1.0)
        .when(F.col("first_close") < F.lag("low").over(w), -1.0)
        .otherwise(0.0)
    )
    prior = F.lag("range_fraction").over(w)
    rows = []
    for n in lookbacks:
        for q in quantiles:
            cut = frames.rows("symbol", "trading_date", n, n, end=-1).quantile("range_fraction", q)
            rows.append(
                F.struct(
                    F.lit(n).alias("lookback"), F.lit(q).alias("threshold"),
                    F.when(prior <= cut, breakout).otherwise(0.0).alias("raw"),
                )
            )
    df = sessions.withColumn("rows", F.array(*rows)).select(
        *SESSION, (F.col("close") / F.col("second_open") - 1.0).alias("target"), F.inline("rows")
    )
    df = df.withColumn("direction", F.explode(F.array(F.lit(-1), F.lit(1))))
    return session_result(df.withColumn("position", F.col("raw") * F.col("direction")))


def _printed_before(bars: DataFrame) -> DataFrame:
    """Number bars on the union calendar and flag rows whose neighbour printed next to them."""
    df = calendar.number_calendar(bars, BAR)
    w = frames.ordered("symbol", "cal")
    date = F.col("trading_date")
    same = (F.lag("cal").over(w) == F.col("cal") - 1) & (F.lag("trading_date").over(w) == date)
    following = (F.lead("cal").over(w) == F.col("cal") + 1) & (F.lead("trading_date").over(w) == date)
    return df.withColumns(
        {
            "same_session": F.coalesce(same, F.lit(False)),
            "followed": F.coalesce(following, F.lit(False)),
            "close_return": F.col("close") / frames.step_lag("close", "symbol", "cal") - 1.0,
        }
    )


def _union_result(df: DataFrame) -> DataFrame:
    """Daily result on the union calendar: a hole ends a run of bars like a session end does."""
    w = frames.ordered(["symbol", *VARIANT], "cal")
    p = F.col("position")
    before = F.when(F.col("same_session"), F.lag("position").over(w)).otherwise(0.0)
    sides = F.abs(p - F.coalesce(before, F.lit(0.0))) + F.when(~F.col("followed"), F.abs(p)).otherwise(0.0)
    df = df.withColumns({"sides": sides, "gross": p * F.coalesce("bar_return", F.lit(0.0))})
    return df.groupBy(*SESSION, *VARIANT).agg(
        F.sum("gross").alias("gross"), F.sum("sides").alias("sides")
    )


def h005_declared_leader(bars: DataFrame, leaders: dict[str, str], lookbacks=(1, 2, 4)) -> DataFrame:
    """A named leader's impulse on the previous bar position sets the follower's position."""
    df = _printed_before(bars)
    df = df.withColumns(
        {f"i{n}": frames.steps("symbol", "cal", n).sum("close_return") for n in lookbacks}
    )
    df = df.withColumns({f"z{n}": cal_zscore(f"i{n}") for n in lookbacks})
    pairs = F.create_map(*[F.lit(x) for s, l in leaders.items() for x in (s, l)])
    followers = df.withColumn("leader", pairs[F.col("symbol")])
    signals = df.select(
        F.col("symbol").alias("leader"), (F.col("cal") + 1).alias("cal"),
        *[F.col(f"z{n}").alias(f"lead{n}") for n in lookbacks],
    )
    joined = followers.filter(F.col("leader").isNotNull()).join(signals, ["leader", "cal"], "left")
    scores = {n: F.when(F.col("same_session"), F.col(f"lead{n}")) for n in lookbacks}
    keep = [*SESSION, "cal", "bar_return", "same_session", "followed"]
    df = with_rules(fan(joined, scores, keep), (0.5, 1.0), (-1, 1))
    return _union_result(df.withColumn("position", thresholded()))


def h006_momentum_volume(bars: DataFrame, lookbacks=(2, 4, 8)) -> DataFrame:
    df = _printed_before(bars).withColumn(
        "log_volume", F.log1p(clip(F.col("volume").cast("double"), 0.0, None))
    )
    df = df.withColumns(
        {f"i{n}": frames.steps("symbol", "cal", n).sum("close_return") for n in lookbacks}
    )
    df = df.withColumn("surprise", clip(cal_zscore("log_volume"), 0.0, None))
    df = df.withColumns({f"x{n}": cal_zscore(f"i{n}") * F.col("surprise") for n in lookbacks})
    scores = {
        n: F.when(F.col("same_session"), frames.step_lag(f"x{n}", "symbol", "cal")) for n in lookbacks
    }
    keep = [*SESSION, "cal", "bar_return", "same_session", "followed"]
    df = with_rules(fan(df, scores, keep), (0.5, 1.0), (-1, 1))
    return _union_result(df.withColumn("position", thresholded()))


def h007_high_to_price(panel: DataFrame, lookbacks=(5, 10, 20, 40)) -> DataFrame:
    """``panel`` is dense: (symbol, trading_date, cal, close, session_return)."""
    c = F.col("close")
    df = panel.withColumns(
        {f"h{n}": c / frames.steps("symbol", "cal", n).max(c) - 1.0 for n in lookbacks}
    )
    df = df.withColumns(
        {f"s{n}": (frames.pct_rank(f"h{n}", "trading_date") - 0.5) * 2.0 for n in lookbacks}
    )
    df = df.withColumn("target", F.col("session_return"))
    scores = {n: F.col(f"s{n}") for n in lookbacks}
    df = next_session(fan(df, scores, [*SESSION, "target"]))
    return session_result(with_rules(df, (0.2, 0.4)).withColumn("position", thresholded()))


def h008_clock_drift(bars: DataFrame, lookbacks=(20, 60), least_of=None) -> DataFrame:
    """Drift of the same session bucket over its own earlier sessions."""
    scores = {}
    for n in lookbacks:
        least = max(10, n // 2) if least_of is None else least_of
        f = frames.rows(["symbol", "session_bucket"], "trading_date", n, least, end=-1)
        scores[n] = clip(ratio(f.mean("bar_return"), f.std("bar_return")), -6.0, 6.0)
    df = with_rules(fan(bars, scores, [*SESSION, BAR, "bar_return"]), (0.0, 0.10, 0.20))
    return bar_result(df.withColumn("position", thresholded()))


def h009_jump(bars: DataFrame, histories=(40, 160)) -> DataFrame:
    """Return beyond a bipower proxy of continuous variation (products of lags 1 and 2)."""
    w = frames.ordered("symbol", BAR)
    r = F.col("bar_return")
    df = bars.withColumn("pair", F.abs(F.lag(r, 1).over(w)) * F.abs(F.lag(r, 2).over(w)))
    scores = {}
    for n in histories:
        smooth = frames.rows("symbol", BAR, n, max(20, n // 2)).mean("pair") * (math.pi / 2.0)
        smooth = F.when(smooth != 0, smooth)
        jump = clip(r * r - smooth, 0.0, None)
        scores[n] = clip(F.signum(r) * F.sqrt(jump / smooth), -10.0, 10.0)
    df = fan(df, scores, [*SESSION, BAR, "bar_return"])
    df = df.withColumn("observed", earlier_in_session("observed"))
    df = with_rules(df, (1.0, 2.0), (-1, 1))
    return bar_result(df.withColumn("position", thresholded()))


def h010_price_impact(bars: DataFrame, histories=(80, 160)) -> DataFrame:
    amount = F.col("close") * F.col("volume")
    df = bars.withColumn("impact", ratio("bar_return", amount))
    scores = {n: zscore("impact", "symbol", BAR, n) for n in histories}
    df = fan(df, scores, [*SESSION, BAR, "bar_return"])
    df = df.withColumn("observed", earlier_in_session("observed"))
    df = with_rules(df, (1.0, 2.0), (-1,))
    return bar_result(df.withColumn("position", thresholded()))


def h011_sign_entropy(bars: DataFrame, lookbacks=(8, 16, 32)) -> DataFrame:
    r = F.col("bar_return")
    up = F.when(r > 0, 1.0).otherwise(0.0)
    keep = [*SESSION, BAR, "bar_return"]
    rows = []
    for n in lookbacks:
        f = frames.rows("symbol", BAR, n)
        rows.append(
            F.struct(
                F.lit(n).alias("lookback"),
                (1.0 - binary_entropy(f.mean(up))).alias("observed"),
                F.signum(f.sum(r)).alias("trend"),
            )
        )
    df = bars.withColumn("rows", F.array(*rows)).select(*keep, F.inline("rows"))
    df = df.withColumns(
        {"observed": earlier_in_session("observed"), "trend": earlier_in_session("trend")}
    )
    df = with_rules(df, (0.10, 0.25, 0.50))
    position = F.coalesce(
        F.when(F.col("observed") >= F.col("threshold"), F.col("trend")), F.lit(0.0)
    )
    return bar_result(df.withColumn("position", position))


def h012_weekday(panel: DataFrame) -> DataFrame:
    day = F.weekday("trading_date")
    position = F.when(day == 4, 1.0).when(day == 0, -1.0).otherwise(0.0)
    return session_result(
        panel.withColumns(
            {
                "position": position, "target": F.col("session_return"), "lookback": F.lit(1),
                "threshold": F.lit(0.0), "direction": F.lit(1),
            }
        )
    )


def h013_volume_reversal(panel: DataFrame, lookbacks=(3, 5)) -> DataFrame:
    """Dense panel with ``volume``; fade the last returns while volume expands within bounds."""
    x = F.coalesce("session_return", F.lit(0.0))
    short = frames.steps("symbol", "cal", 5, end=-1).mean("volume")
    long = frames.steps("symbol", "cal", 20, end=-1).mean("volume")
    df = panel.withColumns({"growth": ratio(short, long), "target": x})
    scores = {n: frames.steps("symbol", "cal", n, end=-1).sum(x) for n in lookbacks}
    df = with_rules(fan(df, scores, [*SESSION, "target", "growth"]), (1.0, 1.25), (-1,))
    fits = (F.col("growth") >= F.col("threshold")) & (F.col("growth") <= 3.0)
    position = F.coalesce(F.when(fits, -F.signum("observed")), F.lit(0.0))
    return session_result(df.withColumn("position", position))


def h014_overnight_fade(windows: DataFrame, history: int = 80, least: int = 40) -> DataFrame:
    """``windows`` has overnight and core returns per (symbol, session), zero when absent."""
    score = zscore("overnight", "symbol", "trading_date", history, least)
    df = fan(windows, {history: score}, [*SESSION, "core"])
    df = with_rules(df, (0.0, 0.5, 1.0), (-1,))
    return session_result(df.withColumn("position", thresholded()), "core")


def h015_variance_ratio(panel: DataFrame, histories=(40, 80), horizons=(2, 5)) -> DataFrame:
    """Dense zero-filled returns: multi-session variance against its random-walk multiple."""
    w = frames.ordered("symbol", "cal")
    df = panel.withColumn("x", F.coalesce("session_return", F.lit(0.0)))
    df = df.withColumns({f"sum{h}": frames.steps("symbol", "cal", h).sum("x") for h in horizons})
    rows = []
    for n in histories:
        f = frames.steps("symbol", "cal", n)
        one = f.var("x")
        for h in horizons:
            stat = ratio(f.var(f"sum{h}"), one * float(h)) - 1.0
            rows.append(
                F.struct(
                    F.lit(n).alias("lookback"), F.lit(h).alias("direction"),
                    stat.alias("observed"), F.signum(f"sum{h}").alias("trend"),
                )
            )
    df = df.withColumn("rows", F.array(*rows)).withColumn("rows", F.lag("rows").over(w))
    df = df.select(*SESSION, F.col("x").alias("target"), F.inline_outer("rows"))
    df = df.filter(F.col("lookback").isNotNull())
    df = df.withColumn("threshold", F.explode(F.array(F.lit(0.10), F.lit(0.25))))
    position = F.coalesce(
        F.when(
            F.abs("observed") >= F.col("threshold"), F.col("trend") * F.signum("observed")
        ),
        F.lit(0.0),
    )
    return session_result(df.withColumn("position", position))


def bias_corrected_skew(x: str) -> Column:
    """Sample skewness; Spark's own is the population form."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def h016_skew_rank(bars: DataFrame, smoothings=(1, 3, 5)) -> DataFrame:
    sessions = bars.groupBy(*SESSION).agg(
        bias_corrected_skew("bar_return").alias("skew"),
        (F.max_by("close", BAR) / F.min_by("open", BAR) - 1.0).alias("session_return"),
    )
    df = calendar.densify(sessions)
    df = df.withColumns({f"m{n}": frames.steps("symbol", "cal", n).mean("skew") for n in smoothings})
    df = df.withColumns(
        {f"s{n}": (frames.pct_rank(f"m{n}", "trading_date") - 0.5) * -2.0 for n in smoothings}
    )
    df = df.withColumn("target", F.col("session_return"))
    df = next_session(fan(df, {n: F.col(f"s{n}") for n in smoothings}, [*SESSION, "target"]))
    return session_result(with_rules(df, (0.2, 0.4)).withColumn("position", thresholded()))


# --- reports and events ----------------------------------------------------------------


def report_scores(reports: DataFrame, value: str, members: int) -> DataFrame:
    """Centred rank of each symbol among the reports of one date, complete dates only."""
    w = Window.partitionBy("report_date")
    df = reports.withColumn("n", F.count(value).over(w)).filter(F.col("n") == members)
    rank = frames.mean_rank(value, "report_date")
    centre, scale = (members + 1.0) / 2.0, (members - 1.0) / 2.0
    return df.withColumn("score", (rank - centre) / scale).select(
        "symbol", "report_date", "release_date", "score"
    )


def first_session_after(scores: DataFrame, sessions: DataFrame) -> DataFrame:
    """Number of the first session strictly after the release; unmatched releases drop out.

    Both sides are unioned on one date axis and a running count of sessions gives the answer,
    so there is no inequality join.
    """
    calendar_ = sessions.select("trading_date").distinct().select(
        F.col("trading_date").alias("day"),
        F.row_number().over(Window.orderBy("trading_date")).alias("cal"),
    )
    releases = scores.select(F.col("release_date").alias("day")).distinct()
    axis = (
        releases.select("day", F.lit(None).cast("int").alias("cal"), F.lit(True).alias("is_release"))
        .unionByName(calendar_.withColumn("is_release", F.lit(False)))
    )
    run = Window.orderBy("day", F.col("is_release").asc()).rowsBetween(Window.unboundedPreceding, 0)
    axis = axis.withColumn("reached", F.coalesce(F.max("cal").over(run), F.lit(0)))
    target = axis.filter("is_release").select(
        F.col("day").alias("release_date"), (F.col("reached") + 1).alias("cal")
    )
    return scores.join(target, "release_date").join(
        calendar_.select("cal", F.col("day").alias("trading_date")), "cal"
    )


def held_positions(scores: DataFrame, sessions: DataFrame, holds: tuple[int, ...], thresholds: tuple[float, ...]) -> DataFrame:
    """Sign of far ranks, held for k sessions from the first one after release.

    Where holds overlap the later report wins.
    """
    entry = first_session_after(scores, sessions).drop("trading_date")
    calendar_ = sessions.select("trading_date").distinct().withColumn(
        "cal", F.row_number().over(Window.orderBy("trading_date"))
    )
    rules = F.array(
        *[
            F.struct(F.lit(h).alias("hold"), F.lit(float(t)).alias("threshold"))
            for h in holds
            for t in thresholds
        ]
    )
    df = entry.select("*", F.inline(rules))
    df = df.withColumn("position", F.when(F.abs("score") >= F.col("threshold"), F.signum("score")).otherwise(0.0))
    df = df.withColumn("cal", F.explode(F.sequence(F.col("cal"), F.col("cal") + F.col("hold") - 1)))
    held = df.groupBy("hold", "threshold", "symbol", "cal").agg(
        F.max_by("position", "report_date").alias("position")
    )
    return held.join(calendar_, "cal").drop("cal")


def release_dates(sessions: DataFrame, weekday: int, holidays: DataFrame, exceptions: tuple[str, ...] = ()) -> DataFrame:
    """Sessions on the release weekday in weeks without a holiday up to that day."""
    return release_days(sessions.select("trading_date"), F.lit(weekday), holidays, exceptions)


def release_days(sessions: DataFrame, weekday: Column, holidays: DataFrame, exceptions: tuple[str, ...] = ()) -> DataFrame:
    """Distinct rows of ``sessions`` on their own release weekday in weeks without a holiday up to that day."""
    days = sessions.distinct().filter(F.weekday("trading_date") == weekday)
    if exceptions:
        days = days.filter(~F.col("trading_date").cast("string").isin(*exceptions))
    first = holidays.groupBy(F.date_trunc("week", "holiday").cast("date").alias("week")).agg(
        F.min(F.weekday("holiday")).alias("first_holiday")
    )
    marked = days.withColumn("week", F.date_trunc("week", "trading_date").cast("date")).join(first, "week", "left")
    kept = marked.filter(F.col("first_holiday").isNull() | (F.col("first_holiday") > F.weekday("trading_date")))
    return kept.select(*sessions.columns)


def carried_minutes(bars: DataFrame, end: int, minute: str = "minute") -> DataFrame:
    """A bar for every minute of a session from its first print to ``end``; minutes without a print carry the close."""
    w = Window.partitionBy(*SESSION).orderBy(minute)
    until = F.coalesce(F.lead(minute).over(w), F.lit(end))
    spans = bars.withColumn("until", until).filter(F.col(minute) < F.col("until"))
    each = spans.withColumn("at", F.explode(F.sequence(F.col(minute), F.col("until") - 1)))
    opened = F.when(F.col("at") == F.col(minute), F.col("open")).otherwise(F.col("close"))
    return each.select(*SESSION, F.col("at").alias(minute), opened.alias("open"), "close")


def event_ledger(study: DataFrame, sessions: DataFrame) -> DataFrame:
    """Daily gross return and traded sides of every variant, zero on sessions without an event.

    Only variants times sessions are made: the sorted calendar is one array, exploded per variant.
    """
    variant = ["symbol", "response_minutes", "hold_minutes", "threshold"]
    dates = sessions.agg(F.array_sort(F.collect_set("trading_date")).alias("dates")).scalar()
    traded = study.select(
        *variant, "trading_date", (F.col("position") * F.col("target_return")).alias("gross"),
        (2.0 * F.abs("position")).alias("sides"),
    )
    grid = study.select(*variant).distinct().select("*", F.explode(dates).alias("trading_date"))
    return grid.join(traded, [*variant, "trading_date"], "left").fillna(0.0, ["gross", "sides"])


def event_study(
    minutes: DataFrame, days: DataFrame, start: int, responses=(15, 30), holds=(30, 60, 240),
    thresholds=(0.5, 1.0), history: int = 20, least: int = 12, coverage: float = 1.0,
    minute: str | None = None,
) -> DataFrame:
    """Response window return, later target return and the position it implies, per variant.

    All windows are conditional aggregates of one pass over the event days' minutes.  A window
    counts only when ``coverage`` of its minutes printed.  ``days`` may have a symbol, then each
    symbol has its own; ``minute`` names the minute of the local day where the bars have no instant.
    """
    place = minute or BAR
    m = F.col(minute) if minute else calendar.local_minutes(BAR)
    keys = [c for c in SESSION if c in days.columns]
    df = minutes.join(days, keys, "left_semi").withColumn("m", m)

    def window(lo: int, hi: int, name: str) -> list[Column]:
        inside = (F.col("m") >= lo) & (F.col("m") < hi)
        at = F.when(inside, F.col(place))
        ret = F.max_by("close", at) / F.min_by("open", at) - 1.0
        return [
            F.when(F.count_if(inside) >= coverage * (hi - lo), ret).alias(name)
        ]

    aggregates: list[Column] = []
    for a in responses:
        aggregates += window(start, start + a, f"response_{a}")
        for h in holds:
            aggregates += window(start + a, start + a + h, f"target_{a}_{h}")
    wide = df.groupBy(*SESSION).agg(*aggregates)
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("response_minutes"), F.lit(h).alias("hold_minutes"),
                F.col(f"response_{a}").alias("response_return"),
                F.col(f"target_{a}_{h}").alias("target_return"),
            )
            for a in responses
            for h in holds
        ]
    )
    long = wide.select(*SESSION, F.inline(rows)).filter(
        F.col("response_return").isNotNull() & F.col("target_return").isNotNull()
    )
    f = frames.rows(["symbol", "response_minutes", "hold_minutes"], "trading_date", history, least, end=-1)
    long = long.withColumn("response_score", ratio("response_return", f.std("response_return")))
    long = long.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    return long.withColumn(
        "position",
        F.when(F.abs("response_score") >= F.col("threshold"), F.signum("response_return")).otherwise(0.0),
    )
