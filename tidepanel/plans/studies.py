"""Composed jobs: each runs its whole rule grid as one chain of DataFrame operators.

Where the reproduced workflow would feed drawdown back into positions, these jobs charge lagged
weights, turnover and cost only, and their tables say so in ``accounting``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.functions import frames
from tidepanel.operators import accounting as B
from tidepanel.operators import calendar as cal
from tidepanel.operators import evaluate as E
from tidepanel.operators import hypotheses as H
from tidepanel.operators import labels as L
from tidepanel.operators import network as G
from tidepanel.operators import selection as K
from tidepanel.operators import signals as N
from tidepanel.session import cut_lineage
from tidepanel.sources import sinks

DATE, SYMBOL = "trading_date", "symbol"
ACCOUNTING = "lag, turnover and cost; no drawdown feedback"


def literal_grid(df: DataFrame, **values) -> DataFrame:
    for name, items in values.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in items])))
    return df


# --- matrix studies on bars ---------------------------------------------------------------


def _bar_inputs(bars: DataFrame) -> DataFrame:
    """Bars on the union calendar with the in-session close return and the next bar's return."""
    df = H._printed_before(bars)
    w = frames.ordered(SYMBOL, "cal")
    following = F.when(F.col("followed"), F.lead("bar_return").over(w))
    return df.withColumns(
        {
            "session_close_return": F.when(F.col("same_session"), F.col("close_return")),
            "next_return": following,
        }
    )


def _tail_result(df: DataFrame, variant: list[str], score: str, threshold: str) -> DataFrame:
    """Balanced tails per bar, held on the next bar of the session, summed by day."""
    weight = G.tail_weights(F.col(score), F.col(threshold), [*variant, "cal"])
    df = df.withColumn("signal", weight)
    w = frames.ordered([SYMBOL, *variant], "cal")
    held = F.coalesce(F.when(F.col("same_session"), F.lag("signal").over(w)), F.lit(0.0))
    df = df.withColumn("position", held)
    before = F.when(F.col("same_session"), F.lag("position").over(w)).otherwise(0.0)
    p = F.col("position")
    sides = F.abs(p - F.coalesce(before, F.lit(0.0))) + F.when(~F.col("followed"), F.abs(p)).otherwise(0.0)
    df = df.withColumns({"sides": sides, "gross": p * F.coalesce("bar_return", F.lit(0.0))})
    return df.groupBy(*variant, SYMBOL, DATE).agg(
        F.sum("gross").alias("gross"), F.sum("sides").alias("sides")
    )


def component_grid(bars: DataFrame, sessions=(20, 40), thresholds=(1.25, 1.75, 2.25)) -> DataFrame:
    """First-component residual rules: history x threshold x one- or two-bar confirmation."""
    base = cut_lineage(_bar_inputs(bars))
    scores = G.component_residuals(base, "session_close_return", sessions)
    keep = [SYMBOL, DATE, "timestamp_utc", "cal", "same_session", "followed", "bar_return"]
    df = literal_grid(base.select(*keep), train=sessions)
    df = df.join(scores.select(SYMBOL, "timestamp_utc", "train", "score"), [SYMBOL, "timestamp_utc", "train"], "left")
    before = F.when(
        F.col("same_session"), frames.step_lag("score", [SYMBOL, "train"], "cal")
    )
    df = df.withColumn("score_before", before)
    df = literal_grid(df, threshold=thresholds, confirmation=(1, 2))
    agrees = (F.col("score") * F.col("score_before") > 0) & (
        F.abs("score_before") >= F.col("threshold")
    )
    df = df.withColumn(
        "candidate", F.when((F.col("confirmation") == 1) | agrees, F.col("score"))
    )
    return _tail_result(df, ["train", "threshold", "confirmation"], "candidate", "threshold")


def var_grid(bars: DataFrame, sessions=(20, 40), penalties=(10.0, 100.0), thresholds=(0.10, 0.25)) -> DataFrame:
    """Ridge VAR forecasts traded against their tails, history x penalty x threshold."""
    base = cut_lineage(_bar_inputs(bars))
    scores = G.var_forecasts(base, "session_close_return", "next_return", sessions, penalties)
    keep = [SYMBOL, DATE, "timestamp_utc", "cal", "same_session", "followed", "bar_return"]
    df = literal_grid(base.select(*keep), train=sessions, penalty=penalties)
    df = df.join(
        scores.select(SYMBOL, "timestamp_utc", "train", "penalty", (-F.col("score")).alias("score")),
        [SYMBOL, "timestamp_utc", "train", "penalty"], "left",
    )
    df = literal_grid(df, threshold=thresholds)
    return _tail_result(df, ["train", "penalty", "threshold"], "score", "threshold")


def network_grid(
    panel: DataFrame, windows=(40, 60), momenta=(5, 10), thresholds=(1.0, 1.5), holds=(3, 5), k: int = 4
) -> DataFrame:
    """Network dislocation rules on a dense (cal, date, symbol, ret) panel: 16 variants."""
    scores = G.network_residuals(panel, [(w, m) for w in windows for m in momenta], k)
    variant = ["window", "momentum", "threshold", "hold"]
    df = literal_grid(panel, window=windows, momentum=momenta).join(
        scores.select("cal", SYMBOL, "window", "momentum", "score"), ["cal", SYMBOL, "window", "momentum"], "left"
    )
    df = literal_grid(df, threshold=thresholds)
    df = df.withColumn(
        "entered", G.balanced_entries("score", F.col("threshold"), ["window", "momentum", "threshold", "cal"])
    )
    df = literal_grid(df, hold=holds)
    position = G.cohort_positions("entered", F.col("hold"), holds, [SYMBOL, *variant])
    df = df.withColumn("position", position)
    w = frames.ordered([SYMBOL, *variant], "cal")
    change = F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0)))
    df = df.withColumn("change", change)
    return df.groupBy(*variant, DATE).agg(
        F.sum(F.col("position") * F.coalesce("ret", F.lit(0.0))).alias("gross"),
        F.sum("change").alias("sides"),
    )


# --- hypothesis passes --------------------------------------------------------------------


def _tagged(df: DataFrame, name: str, timeframe: int) -> DataFrame:
    return df.select(
        F.lit(name).alias("hypothesis_id"), F.lit(timeframe).alias("timeframe"), SYMBOL, DATE,
        F.col("lookback").cast("int").alias("lookback"), "threshold",
        F.col("direction").cast("int").alias("direction"), "gross", "sides",
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hypothesis_pass_one(bars: dict[int, DataFrame], leaders: dict[str, str], least: int = 40) -> DataFrame:
    parts = []
    for minutes, frame in bars.items():
        sessions = cut_lineage(H.sessions_of(cal.bar_ordinals(frame)))
        parts += [
            _tagged(H.h002_semivariance(sessions), "H002", minutes),
            _tagged(H.h003_opening_window(sessions, least=least), "H003", minutes),
            _tagged(H.h004_compressed_breakout(sessions), "H004", minutes),
            _tagged(H.h005_declared_leader(frame, leaders), "H005", minutes),
            _tagged(H.h006_momentum_volume(frame), "H006", minutes),
        ]
    return _union(parts)


def hypothesis_pass_two(bars: dict[int, DataFrame], panel: DataFrame) -> DataFrame:
    parts = [_tagged(H.h007_high_to_price(panel), "H007", 1440)]
    for minutes, frame in bars.items():
        parts += [
            _tagged(H.h008_clock_drift(frame), "H008", minutes),
            _tagged(H.h009_jump(frame), "H009", minutes),
            _tagged(H.h010_price_impact(frame), "H010", minutes),
            _tagged(H.h011_sign_entropy(frame), "H011", minutes),
        ]
    return _union(parts)


def hypothesis_pass_three(quarter_bars: DataFrame, panel: DataFrame, least: int = 40) -> DataFrame:
    masks = N.clock_masks("timestamp_utc")
    windows = cal.window_summary(
        quarter_bars,
        {"overnight": (masks["overnight"], 1), "core": (masks["open_30"] | masks["target"], 1)},
    ).select(
        SYMBOL, DATE, F.coalesce("overnight_return", F.lit(0.0)).alias("overnight"),
        F.coalesce("core_return", F.lit(0.0)).alias("core"),
    )
    return _union(
        [
            _tagged(H.h012_weekday(panel), "H012", 1440),
            _tagged(H.h013_volume_reversal(panel), "H013", 1440),
            _tagged(H.h014_overnight_fade(windows, least=least), "H014", 15),
            _tagged(H.h015_variance_ratio(panel), "H015", 1440),
            _tagged(H.h016_skew_rank(quarter_bars), "H016", 15),
        ]
    )


def study_tail(returns: DataFrame, strategy: list[str], levels=(0.0, 0.5, 1.0, 2.0, 3.5, 5.0), least: int = 12) -> DataFrame:
    """Chained selection on one-way cost 1, replayed at every cost level, with its metrics."""
    base = returns.withColumn("strategy", F.concat_ws("|", *[F.col(c).cast("string") for c in strategy]))
    base = cut_lineage(base.groupBy("strategy", DATE).agg(F.sum("gross").alias("gross"), F.sum("sides").alias("sides")))
    net = base.withColumn("net", F.col("gross") - F.col("sides") / 10_000.0)
    need = F.greatest(F.lit(least), 6 * (F.col("evaluation_fold") - 1))
    picked = cut_lineage(K.chained_selection(net, ["strategy"], "net", "sides", need))
    stressed = E.with_costs(base, levels)
    out = K.replay(stressed, picked, ["strategy"], "net")
    return E.summarize(out, ["cost_bps"], "portfolio_return")


# --- rule searches on session features ------------------------------------------------------


def dense_returns(panel: DataFrame) -> DataFrame:
    df = cal.densify(panel.select(SYMBOL, DATE, "close_to_close_return"))
    return df.withColumnRenamed("close_to_close_return", "ret")


def weights_and_returns(
    scores: DataFrame, returns: DataFrame, keys: list[str], bps: float, neutral: bool
) -> DataFrame:
    """Scores to covariance-targeted weights to costed daily returns.  Dates without a book hold
    zero, so positions close when a signal ends."""
    history = cut_lineage(B.history_variance(B.trailing_history(returns)).drop("cal"))
    weights = B.covariance_target_weights(scores, history, keys, neutral=neutral)
    grid = returns.select(SYMBOL, DATE).join(
        scores.select(*keys, SYMBOL).distinct(), SYMBOL
    )
    full = grid.join(weights, [*keys, DATE, SYMBOL], "left").withColumn(
        "weight", F.coalesce("weight", F.lit(0.0))
    )
    return B.net_returns(returns, full, keys, bps)


def theme_daily(features: DataFrame, panel: DataFrame, bps: float = 3.5, folds: dict | None = None) -> DataFrame:
    """Daily costed returns of the sixty theme rules with their validation fold."""
    returns = cut_lineage(dense_returns(panel))
    scores = cut_lineage(N.theme_scores(features))
    daily = weights_and_returns(scores, returns, ["strategy", "theme"], bps, neutral=False)
    return cut_lineage(L.fold_of_session(cut_lineage(daily), **(folds or {})))


def theme_books(daily: DataFrame, top: int = 3) -> DataFrame:
    """Daily returns of the books that themes and rules form together.

    ``daily`` has strategy, theme, trading_date, fold and net.  Books: all rules, all themes, each theme's
    champion, its best ``top``, every rule with a gain (the champions where none has one), and the equal and
    volatility-balanced mix of the themes.  Rules are ranked on their validation rows.
    """
    evidence = E.summarize(daily.filter(F.col("fold").isNotNull()), ["theme", "strategy"], "net")
    evidence = K.ranked(evidence, ["theme"], "sharpe")
    gains = F.col("annualized_return") > 0
    evidence = cut_lineage(evidence)
    some = evidence.agg(F.coalesce(F.bool_or(gains), F.lit(False)).alias("some")).scalar()
    evidence = evidence.withColumn("some", some)
    books = {
        "all_rules_equal_weight": F.lit(True),
        "theme_champions_equal_weight": F.col("rank") == 1,
        f"top_{top}_per_theme_equal_weight": F.col("rank") <= top,
        "all_positive_equal_weight": F.when(F.col("some"), gains).otherwise(F.col("rank") == 1),
    }
    member = F.explode(F.filter(F.array(*[F.when(c, F.lit(b)) for b, c in books.items()]), lambda b: b.isNotNull()))
    members = evidence.select("theme", "strategy", member.alias("book"))
    rules = B.mean_sleeve(daily.join(members, ["theme", "strategy"]), ["book"])
    themes = cut_lineage(B.mean_sleeve(daily, ["theme"]))
    even = B.mean_sleeve(themes, []).select(F.lit("all_themes_equal_weight").alias("book"), DATE, "net")
    mixed = B.causal_volatility_balance(themes, "theme").unpivot(
        [DATE], ["equal_weight", "causal_volatility_balanced"], "mix", "net"
    ).select(F.concat(F.lit("theme_"), "mix").alias("book"), DATE, "net")
    out = rules.select("book", DATE, "net").unionByName(even).unionByName(mixed)
    days = daily.select(DATE, "fold").distinct()
    return out.join(days, DATE)


def book_summary(books: DataFrame, key: str = "book") -> DataFrame:
    """Fold evidence and tier of each book, best first by rank."""
    out = E.fold_and_pooled(books, [key], "net")
    out = out.withColumn("research_tier", E.research_tier("sharpe", "positive_folds"))
    return K.ranked(out, [], "sharpe", key)


def validation_correlation(daily: DataFrame, name: str, least: int = 20) -> DataFrame:
    """Correlation of every pair of series on the validation rows."""
    rows = daily.filter(F.col("fold").isNotNull())
    return G.pairwise_correlation(rows, [DATE], name, "net", least)


def theme_search(features: DataFrame, panel: DataFrame, bps: float = 3.5, folds: dict | None = None) -> DataFrame:
    """Sixty theme rules to returns to fold evidence, tiered."""
    df = theme_daily(features, panel, bps, folds)
    out = E.fold_and_pooled(df, ["strategy", "theme"], "net", F.avg("turnover").alias("average_daily_turnover"))
    out = out.withColumn("research_tier", E.research_tier("sharpe", "positive_folds"))
    return K.ranked(out, ["theme"], "sharpe").withColumn("accounting", F.lit(ACCOUNTING))


def reversion_tournament(features: DataFrame, panel: DataFrame, bps: float = 3.5, folds: dict | None = None) -> DataFrame:
    """Fifty reversion rules, market neutral, with the stability flag."""
    returns = cut_lineage(dense_returns(panel))
    scores = cut_lineage(N.reversion_scores(features))
    daily = weights_and_returns(scores, returns, ["strategy", "family"], bps, neutral=True)
    df = L.fold_of_session(cut_lineage(daily), **(folds or {}))
    out = E.fold_and_pooled(df, ["strategy", "family"], "net")
    lead = (F.col("sharpe") >= 0.75) & (F.col("positive_folds") >= 3) & (F.col("worst_fold_sharpe") > -0.5)
    return out.withColumns({"stable_diagnostic_lead": lead, "accounting": F.lit(ACCOUNTING)})


def forecast_sleeves(features: DataFrame, panel: DataFrame, bps: float = 3.5) -> DataFrame:
    """Daily net returns of the trend and breakout forecasts."""
    returns = cut_lineage(dense_returns(panel))
    trend = N.trend_forecast(features).withColumn("strategy", F.lit("trend"))
    breakout = features.select(
        SYMBOL, DATE, N.breakout_forecast().alias("score"), F.lit("breakout").alias("strategy")
    )
    scores = cut_lineage(trend.unionByName(breakout))
    return weights_and_returns(scores, returns, ["strategy"], bps, neutral=False)


def reversion_families(features: DataFrame, panel: DataFrame, bps: float = 3.5) -> DataFrame:
    """Equal mean of the market-neutral reversion rules of each family, as sleeves."""
    returns = cut_lineage(dense_returns(panel))
    scores = cut_lineage(N.reversion_scores(features))
    daily = cut_lineage(weights_and_returns(scores, returns, ["strategy", "family"], bps, neutral=True))
    return B.mean_sleeve(daily, ["family"]).select(F.col("family").alias("strategy"), DATE, "net")


def candidate_sleeves(
    features: DataFrame, panel: DataFrame, regimes: DataFrame, extra: DataFrame | None = None, bps: float = 3.5
) -> DataFrame:
    """Every sleeve on the market calendar: trend (mean of the plain and the regime-scaled book), breakout,
    reversion families, and ``extra`` series (strategy, trading_date, net) such as model or intraday ones.

    A date outside the market calendar is left out.
    """
    trends = trend_baseline(features, panel, regimes, bps)
    trend = B.mean_sleeve(trends, []).select(F.lit("multi_asset_trend").alias("strategy"), DATE, "net")
    breakout = forecast_sleeves(features, panel, bps).filter("strategy = 'breakout'").select("strategy", DATE, "net")
    parts = [trend, breakout, reversion_families(features, panel, bps)]
    if extra is not None:
        parts.append(extra.join(panel.select(DATE).distinct(), DATE, "left_semi").select("strategy", DATE, "net"))
    return cut_lineage(_union(parts))


def sleeve_books(sleeves: DataFrame, folds: dict | None = None) -> DataFrame:
    """The candidate portfolio's equal and balanced books as series with their validation fold."""
    books = candidate_portfolio(sleeves, folds).unpivot(
        [DATE, "book"], ["equal_weight", "causal_volatility_balanced"], "mix", "net"
    ).select(F.concat_ws("_", "book", "mix").alias("book"), DATE, "net")
    return cut_lineage(L.fold_of_session(books, **(folds or {})))


def candidate_portfolio(sleeves: DataFrame, folds: dict | None = None) -> DataFrame:
    """Gate sleeves on fold evidence, then balance the funded ones and all of them."""
    df = cut_lineage(L.fold_of_session(sleeves, **(folds or {})))
    status = E.fold_and_pooled(df, ["strategy"], "net").withColumn(
        "research_status", E.candidate_status("annualized_return", "positive_folds")
    )
    funded = df.join(
        status.filter(F.col("research_status") == "candidate").select("strategy"), "strategy", "left_semi"
    )
    both = [
        B.causal_volatility_balance(part, "strategy").withColumn("book", F.lit(name))
        for name, part in (("all_sleeves", df), ("candidates", funded))
    ]
    return _union(both)


def trend_baseline(features: DataFrame, panel: DataFrame, regimes: DataFrame, bps: float = 3.5) -> DataFrame:
    """Trend book with and without the regime risk overlay."""
    returns = cut_lineage(dense_returns(panel))
    history = B.history_variance(B.trailing_history(returns)).drop("cal")
    plain = cut_lineage(B.covariance_target_weights(N.trend_forecast(features), history, []))
    scale = regimes.select(DATE, G.exposure_multiplier().alias("multiplier"))
    overlaid = plain.join(scale, DATE, "left").withColumn(
        "weight", F.col("weight") * F.coalesce("multiplier", F.lit(1.0))
    )
    both = plain.withColumn("strategy", F.lit("trend")).unionByName(
        overlaid.select(*plain.columns).withColumn("strategy", F.lit("trend_with_regimes"))
    )
    return B.net_returns(returns, both, ["strategy"], bps)


def intraday_sleeve(
    minutes: DataFrame, least: int = 60, entry: float = 0.55, leave: float = 0.15, cap: int = 60, bps: float = 3.5
) -> DataFrame:
    """Running state, combined score, middle-range filter, alerts, weights, daily accounting."""
    from tidepanel.operators.stateful import hysteresis

    scored = cut_lineage(N.intraday_scores(cal.running_session_state(minutes), least))
    kept = scored.withColumn(
        "filtered", F.when(F.col("range_quartile").isin(2, 3), F.col("score_balanced")).otherwise(0.0)
    )
    states = hysteresis(kept, "filtered", entry, leave, cap)
    df = scored.join(states, [SYMBOL, DATE, "timestamp_utc"])
    return B.volatility_scaled_daily(B.minute_weights(df, "position_signal"), bps)


def regime_table(features: DataFrame, panel: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """Scaled features to observable regimes, blended with a model's table when one is given."""
    names = [c for group in G.REGIME_INPUTS.values() for c in group if c in features.columns]
    scaled = L.robust_scale(features, names)
    observable = G.regime_probabilities(scaled, G.correlation_concentration(panel))
    if model is None:
        model = observable.select(
            DATE, *G.REGIMES, F.lit(None).cast("double").alias("model_confidence")
        ).limit(0)
    return G.blend_regimes(observable, model)


def saved_rule_replay(features: DataFrame, panel: DataFrame, names: list[str], bps: float = 3.5) -> DataFrame:
    """Replay named theme rules and average them into one series."""
    rules = [r for r in N.theme_registry() if r[0] in names]
    if not rules:
        raise ValueError("no saved rule with that name")
    returns = cut_lineage(dense_returns(panel))
    scores = cut_lineage(N.theme_scores(features, rules))
    daily = weights_and_returns(scores, returns, ["strategy"], bps, neutral=False)
    return B.mean_sleeve(daily, [])


def write_labels_and_folds(panel: DataFrame, root: str) -> None:
    """Forward labels and walk-forward folds as one version of two tables."""
    sinks.write_swapped({"labels": L.forward_labels(panel), "folds": L.walk_forward_folds(panel)}, root)


def rule_scores_prepared(bars: DataFrame, lookbacks: tuple[int, ...], peers: dict[str, str]) -> DataFrame:
    """All generic and session-aware scores per lookback with the entry flags."""
    parts = []
    for n in lookbacks:
        generic = N.product_scores(bars, n).select(SYMBOL, "timestamp_utc", *N.PRODUCT_FAMILIES)
        aware = N.session_aware_scores(bars, n, peers).select(SYMBOL, "timestamp_utc", *N.SESSION_AWARE)
        both = generic.join(aware, [SYMBOL, "timestamp_utc"]).withColumn("lookback", F.lit(n))
        parts.append(both)
    flags = N.entry_eligibility(bars).select(
        SYMBOL, "timestamp_utc", "eligible_all", "eligible_below_median", "eligible_above_median",
        "in_us_core", "in_overnight", "is_preclose",
    )
    names = [*N.PRODUCT_FAMILIES, *N.SESSION_AWARE]
    long = _union(parts).unpivot([SYMBOL, "timestamp_utc", "lookback"], names, "family", "score")
    return long.join(flags, [SYMBOL, "timestamp_utc"])


def probability_predictions(
    df: DataFrame, leads: list[tuple[str, int]], variants: dict[str, list[str]], extreme: float = 3.0
) -> DataFrame:
    """Reversion probabilities of every lead, fold and feature set on the extreme hours of the validation rows.

    ``df`` has hourly features, labels per horizon and a ``block`` number; block k > 1 is the
    validation of fold k.  A fold trains on earlier blocks' extreme hours whose label was known
    before its first hour.  Cases whose training rows have one class only are skipped.
    """
    from tidepanel.operators import models as M

    options = F.array(*[
        F.struct(
            F.lit(i).alias("lead_no"), F.lit(f"{s}_{h}h").alias("lead"), F.lit(s).alias("lead_symbol"),
            F.col(f"target_before_stop_{h}h").cast("double").alias("target"),
            F.col(f"label_available_at_{h}h_utc").alias("known_at"),
        )
        for i, (s, h) in enumerate(leads)
    ])
    long = df.filter(F.col("regression_residual_zscore_24h").isNotNull()).select("*", F.inline(options))
    long = cut_lineage(long.filter(
        (F.col("lead_symbol") == F.col(SYMBOL)) & (F.abs("regression_residual_zscore_24h") >= extreme)))
    last = df.agg(F.max("block")).first()[0] or 1
    cutoff = df.groupBy(F.col("block").alias("fold_no")).agg(F.min("hour_start_utc").alias("cutoff"))
    train = long.filter("target IS NOT NULL").withColumn(
        "fold_no", F.explode(F.filter(F.sequence(F.lit(2), F.lit(max(2, last))), lambda k: k > F.col("block")))
    ).join(cutoff, "fold_no").filter(F.col("known_at") < F.col("cutoff"))
    case = (F.col("fold_no") * len(leads) + F.col("lead_no")).cast("int")
    train = train.withColumn("fold", case)
    apply = long.filter("block > 1").withColumn("fold_no", F.col("block")).withColumn("fold", case)
    cases = [k * len(leads) + i for k in range(2, last + 1) for i in range(len(leads))]
    keep = ["fold_no", "lead", SYMBOL, DATE, "hour_start_utc", "regression_displacement_24h",
            "realized_volatility_24h", "target", "reversion_probability"]
    out = None
    for variant, names in variants.items():
        scored = M.logistic_by_fold(train, apply, names, cases).select(*keep).withColumn("model_variant", F.lit(variant))
        out = scored if out is None else out.unionByName(scored)
    return out.withColumnRenamed("fold_no", "fold")


def probability_sleeve(
    df: DataFrame, predictions: DataFrame, leads: list[tuple[str, int]], variants: list[str], bps: float = 3.5
) -> tuple[DataFrame, DataFrame]:
    """Daily accounting and fold summary of each scope: every lead alone, and all of them combined.

    Leads on one instrument average their weights.  A fold's hours run through without a daily
    break, and scopes without a prediction stay flat.
    """
    keys = ["fold", "model_variant", "scope"]
    weight = B.probability_weight("reversion_probability", "regression_displacement_24h", "realized_volatility_24h")
    weights = predictions.withColumn("weight", weight).withColumn(
        "scope", F.explode(F.array(F.lit("combined"), F.col("lead")))
    ).groupBy(*keys, SYMBOL, "hour_start_utc").agg(F.avg("weight").alias("target_weight"))
    names = [f"{s}_{h}h" for s, h in leads]
    scopes = F.array(*[
        F.struct(F.lit(v).alias("model_variant"), F.lit(s).alias("scope")) for v in variants for s in ("combined", *names)
    ])
    hours = df.filter((F.col("block") > 1) & F.col(SYMBOL).isin(*{s for s, _ in leads})).select(
        F.col("block").alias("fold"), SYMBOL, DATE, "hour_start_utc", F.expm1("log_return_1h").alias("ret"), F.inline(scopes)
    )
    held = cut_lineage(hours.join(weights, [*keys, SYMBOL, "hour_start_utc"], "left").fillna(0.0, ["target_weight"]))
    days = df.filter("block > 1").select("hour_start_utc", DATE).distinct()
    hourly = B.hourly_pnl(held, keys, "hour_start_utc", "target_weight", "ret", bps).join(days, "hour_start_utc")
    daily = cut_lineage(hourly.groupBy(*keys, DATE).agg(
        *[F.sum(c).alias(c) for c in ("gross_return", "cost", "net_return", "turnover")],
        F.avg("gross_exposure").alias("average_gross_exposure"),
    ))
    entries = B.entry_count(held, keys, "hour_start_utc", "target_weight")
    summary = E.summarize(
        daily, keys, "net_return", DATE, F.sum("cost").alias("total_cost"), F.avg("turnover").alias("average_daily_turnover")
    ).join(entries, keys)
    return daily, summary
