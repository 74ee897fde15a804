"""Bars, windows, features, labels: hand values and no look-ahead."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from helpers import assert_prefix_invariant, seeded_panel
from pyspark.sql import functions as F

from tidepanel.functions import frames
from tidepanel.functions.scalars import normal_cdf
from tidepanel.operators import accounting as B
from tidepanel.operators import calendar as cal
from tidepanel.operators import evaluate as E
from tidepanel.operators import features as X
from tidepanel.operators import hypotheses as H
from tidepanel.operators import labels as L
from tidepanel.operators import network as G
from tidepanel.operators import signals as N
from tidepanel.operators import smoothing
from tidepanel.operators.joins import assert_unique, merge_many_to_one, merge_unique
from tidepanel.operators.stateful import hysteresis


def utc(hour, minute, day=20):
    return dt.datetime(2026, 8, day, hour, minute)


@pytest.fixture(scope="module")
def minutes(spark):
    rows = [
        ("ES", utc(21, 59), 100.0, 101.0, 99.0, 100.0, 10),
        ("ES", utc(22, 0), 101.0, 102.0, 100.0, 101.0, 20),
        ("ES", utc(22, 1), 102.0, 103.0, 101.0, 102.0, 30),
        ("ES", utc(22, 3), 103.0, 104.0, 102.0, 103.0, 40),
    ]
    df = spark.createDataFrame(
        rows, "symbol string, timestamp_utc timestamp, open double, high double, low double, close double, volume long"
    )
    return cal.minute_returns(df.withColumn("trading_date", cal.trading_date("timestamp_utc")))


def test_minute_returns_respect_sessions_and_gaps(minutes):
    rows = minutes.orderBy("timestamp_utc").collect()
    assert [str(r.trading_date) for r in rows] == ["2026-08-20"] + ["2026-08-21"] * 3
    assert rows[0].return_1m is None and rows[1].return_1m is None and rows[3].return_1m is None
    assert rows[2].return_1m == pytest.approx(102 / 101 - 1)
    assert [r.missing_minutes_before for r in rows] == [0, 0, 0, 1]


def test_session_bar(minutes):
    second = cal.session_from_minutes(minutes).orderBy("trading_date").collect()[1]
    assert (second.observed_minutes, second.missing_minutes, second.volume) == (3, 1, 90)


def test_strict_utc_flags(spark):
    df = spark.sql(
        "SELECT timestamp'2024-03-10 02:30:00' AS gap, timestamp'2024-11-03 01:30:00' AS fold, "
        "timestamp'2024-06-01 12:00:00' AS plain"
    )
    out = df.select(
        cal.strict_utc("gap")["nonexistent"].alias("a"), cal.strict_utc("fold")["ambiguous"].alias("b"),
        (cal.strict_utc("plain")["nonexistent"] | cal.strict_utc("plain")["ambiguous"]).alias("c"),
    ).first()
    assert (out.a, out.b, out.c) == (True, True, False)
    with pytest.raises(Exception, match="impossible local time"):
        cal.assert_strict_utc(df, "gap").collect()


@pytest.mark.parametrize("symbol,year", [("ESU6", 2026), ("ESU0", 2030), ("ESZ21", 21)])
def test_contract_year(spark, symbol, year):
    parts = cal.contract_parts(F.lit(symbol), 2026)
    row = spark.range(1).select(*[c.alias(n) for n, c in parts.items()]).first()
    assert row.root_symbol == "ES" and row.contract_year == year


def test_features_do_not_look_ahead(spark):
    panel = seeded_panel(spark)
    assert_prefix_invariant(X.session_features, panel, dt.date(2020, 5, 9))


def test_scores_do_not_look_ahead(spark):
    panel = seeded_panel(spark, 120).withColumn("session_return", F.col("close") / F.col("open") - 1.0)
    assert_prefix_invariant(
        lambda d: N.session_scores(cal.number_calendar(d, "trading_date"), (1, 5)), panel, dt.date(2020, 4, 9)
    )


def test_robust_scale_is_point_in_time_and_bounded(spark):
    panel = seeded_panel(spark, 180, ("A",))
    names = ["close_to_close_return", "volume"]
    assert_prefix_invariant(lambda d: L.robust_scale(d, names, 60), panel, dt.date(2020, 5, 29))
    last = panel.agg(F.max("trading_date")).first()[0]
    shocked = panel.withColumn(
        "volume", F.when(F.col("trading_date") == F.lit(last), 1e6).otherwise(F.col("volume"))
    )
    value = L.robust_scale(shocked, names, 60).filter(F.col("trading_date") == F.lit(last)).first().volume
    assert abs(value) < 100


def test_ema_matches_pandas_over_many_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(100, 5, 6000)
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(x)], "k string, i int, x double")
    out = smoothing.emas(
        df, {"fast": ("x", 2 / 4.0, 1), "slow": ("x", 2 / 121.0, 120), "slower": ("x", 1 / 900.0, 1)}, "k", "i"
    ).orderBy("i").toPandas()
    s = pd.Series(x)
    for name, a, least in (("fast", 0.5, 1), ("slow", 2 / 121.0, 120), ("slower", 1 / 900.0, 1)):
        want = s.ewm(alpha=a, adjust=False, min_periods=least).mean()
        np.testing.assert_allclose(out[name].to_numpy(), want.to_numpy(), rtol=1e-10)


def test_calendar_steps_equal_dense_pandas_windows(spark):
    rng = np.random.default_rng(5)
    dense = pd.DataFrame(rng.normal(size=(60, 3)), columns=list("abc"))
    dense[rng.random((60, 3)) < 0.3] = np.nan
    long = dense.stack().rename("x").reset_index().rename(columns={"level_0": "t", "level_1": "symbol"})
    df = cal.number_calendar(spark.createDataFrame(long), "t")
    got = df.select(
        "symbol", "t", frames.steps("symbol", "cal", 7, 3).std("x").alias("s"),
        frames.step_lag("x", "symbol", "cal", 2).alias("l"),
    ).toPandas().set_index(["t", "symbol"])
    times = sorted(long["t"].unique())
    base = dense.loc[times].reset_index(drop=True)
    std, lag = base.rolling(7, min_periods=3).std(), base.shift(2)
    for (t, s), row in got.iterrows():
        i = times.index(t)
        for a, b in ((row.s, std[s][i]), (row.l, lag[s][i])):
            assert (pd.isna(a) and pd.isna(b)) or a == pytest.approx(b, abs=1e-12)


def test_mean_ranks_and_leave_one_out(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, None)], "t int, x double")
    out = df.select(
        "x", frames.pct_rank("x", "t").alias("r"), frames.leave_one_out("x", "t").alias("o")
    ).toPandas()
    want = pd.Series([1.0, 2.0, 2.0, np.nan]).rank(pct=True)
    assert sorted(out["r"].dropna()) == pytest.approx(sorted(want.dropna()))
    assert out.loc[out["x"].isna(), "o"].iloc[0] == pytest.approx(5 / 3)


def test_normal_cdf(spark):
    from math import erf, sqrt

    xs = [-9.0, -3.2, -1.0, 0.0, 0.5, 2.9, 3.1, 6.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal_cdf(F.col("x")).alias("p"))
    for row in df.collect():
        assert row.p == pytest.approx(0.5 * (1 + erf(row.x / sqrt(2))), abs=1e-11)


def test_realized_measures_by_hand(spark):
    rows = [("A", dt.date(2020, 1, 1), utc(10, i), r) for i, r in enumerate((0.01, -0.02, 0.03))]
    df = spark.createDataFrame(rows, "symbol string, trading_date date, timestamp_utc timestamp, return_1m double")
    out = X.realized_measures(df).first()
    r = np.log1p([0.01, -0.02, 0.03])
    rv, bv = (r**2).sum(), np.pi / 2 * (abs(r[0] * r[1]) + abs(r[1] * r[2]))
    assert out.realized_variance == pytest.approx(rv)
    assert out.bipower_variation == pytest.approx(bv)
    assert out.jump_variation == pytest.approx(max(rv - bv, 0))
    assert out.realized_quarticity == pytest.approx((r**4).sum())


def test_folds_have_an_embargo_and_do_not_overlap(spark):
    folds = L.walk_forward_folds(seeded_panel(spark, 120, ("A",)), 60, 20, 5).orderBy("fold").collect()
    assert [f.validation_sessions for f in folds] == [20, 20, 15]
    for f in folds:
        assert f.train_end < f.embargo_start <= f.embargo_end < f.validation_start
    assert folds[1].validation_start > folds[0].validation_end


def test_training_rows_are_realized_before_the_cutoff(spark):
    panel = seeded_panel(spark, 120, ("A",))
    folds = {f.fold: f for f in L.walk_forward_folds(panel, 60, 20, 5).collect()}
    rows = L.training_folds(L.forward_labels(panel, (5,)), panel, "label_available_at_5s_utc", 60, 20, 5)
    for row in rows.groupBy("fold").agg(
        F.max("trading_date").alias("d"), F.max("label_available_at_5s_utc").alias("a")
    ).collect():
        assert row.d <= folds[row.fold].train_end and row.a.date() <= folds[row.fold].train_end


def test_hysteresis_fixture(spark):
    scores = (0.0, 0.5, 0.4, 0.05, -0.5)
    rows = [("A", dt.date(2020, 1, 1), utc(10, i), i, s) for i, s in enumerate(scores)]
    df = spark.createDataFrame(
        rows, "symbol string, trading_date date, timestamp_utc timestamp, session_minute int, score double"
    )
    out = hysteresis(df, "score", 0.35, 0.10).orderBy("timestamp_utc").collect()
    assert [r.position_signal for r in out] == [0.0, 1.0, 1.0, 0.0, -1.0]


def test_reports_act_strictly_after_release(spark):
    days = [dt.date(2024, 1, d) for d in (4, 5, 8, 9, 10, 11, 12)]
    sessions = spark.createDataFrame([(d,) for d in days], "trading_date date")
    reports = spark.createDataFrame(
        [(s, dt.date(2024, 1, 2), dt.date(2024, 1, 5), float(i)) for i, s in enumerate("abcde")],
        "symbol string, report_date date, release_date date, share double",
    )
    scores = H.report_scores(reports, "share", 5)
    entry = H.first_session_after(scores, sessions).collect()
    assert {r.trading_date for r in entry} == {dt.date(2024, 1, 8)}
    held = H.held_positions(scores, sessions, (5,), (1.0,)).filter("position <> 0").toPandas()
    assert sorted(held["trading_date"].unique()) == days[2:7]


def test_first_day_loss_is_no_drawdown(spark):
    rows = [("s", dt.date(2020, 1, i + 1), r) for i, r in enumerate((-0.1, 0.05, -0.02))]
    df = spark.createDataFrame(rows, "strategy string, trading_date date, net double")
    out = E.summarize(df, ["strategy"], "net").first()
    assert out.maximum_drawdown == pytest.approx(-0.02)


def test_empty_weeks_count(spark):
    rows = [("s", dt.date(2024, 1, 3), 0.01), ("s", dt.date(2024, 1, 24), 0.01)]
    df = spark.createDataFrame(rows, "strategy string, trading_date date, net double")
    out = E.weekly_hits(df, ["strategy"], "net").first()
    assert (out.weeks, out.positive_weeks) == (4, 2)


def test_exact_quantiles_on_a_hot_value(spark):
    x = np.concatenate([np.full(500, 3.0), np.random.default_rng(1).normal(size=1000)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = {r.probability: r["quantile"] for r in E.exact_quantiles(df, "x", [0.01, 0.5, 0.731, 0.99], 64).collect()}
    for p, q in got.items():
        assert q == pytest.approx(np.quantile(x, p))


def test_exact_quantiles_with_one_far_outlier(spark):
    x = np.concatenate([[1e12], np.random.default_rng(3).normal(size=3000)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = {r.probability: r["quantile"] for r in E.exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.999, 1.0], 32).collect()}
    assert len(got) == 5
    for p, q in got.items():
        assert q == pytest.approx(np.quantile(x, p))


def test_exact_quantiles_of_one_value_and_of_none(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "x double")
    assert [r["quantile"] for r in E.exact_quantiles(df, "x", [0.3]).collect()] == [2.0]
    assert E.exact_quantiles(df.limit(0), "x", [0.3]).count() == 0


def test_trade_drawdown_equals_a_plain_walk(spark):
    rng = np.random.default_rng(4)
    rows = []
    for ticket in range(3000):
        stamp = dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(rng.integers(0, 24 * 20)))
        strategy = "hot" if rng.random() < 0.7 else f"s{rng.integers(0, 9)}"
        rows.append((stamp, strategy, ticket, float(rng.normal())))
    df = spark.createDataFrame(rows, "close_time timestamp_ntz, strategy string, ticket long, pnl double")
    walk = np.cumsum([r[3] for r in sorted(rows)])
    worst = np.min(walk - np.maximum.accumulate(walk))
    for width in (7, 1_000_000):
        assert E.trade_drawdown(df.repartition(5), width).first()[0] == pytest.approx(worst)
    assert E.trade_drawdown(df.limit(0)).first()[0] is None


def test_bootstrap_blocks_equal_a_plain_draw(spark):
    rows = [("s", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i % 7) - 2.5) for i in range(47)]
    df = spark.createDataFrame(rows, "strategy string, trading_date date, net double")
    draws = spark.range(30).selectExpr("id AS sample", "explode(sequence(0, 2)) AS draw").selectExpr(
        "sample", "draw", "pmod(xxhash64(20260823, 's', CAST(sample AS INT), draw), 28) AS first").collect()
    means = []
    for k in range(30):
        starts = [r["first"] for r in sorted(draws) if r["sample"] == k]
        picked = [f + i for d, f in enumerate(starts) for i in range(20) if d * 20 + i < 47]
        means.append(252 * np.mean([rows[i][2] for i in picked]))
    got = E.block_bootstrap(df, "strategy", "net", samples=30).first()
    assert [got.annualized_return_p05, got.annualized_return_p50] == pytest.approx(list(np.quantile(means, [0.05, 0.5])))


def test_bootstrap_is_repeatable_and_brackets_the_mean(spark):
    rng = np.random.default_rng(2)
    rows = [("s", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(rng.normal(0.001, 0.01, 300))]
    df = spark.createDataFrame(rows, "strategy string, trading_date date, net double")
    a = E.block_bootstrap(df, "strategy", "net", samples=200).first()
    b = E.block_bootstrap(df.repartition(7), "strategy", "net", samples=200).first()
    mean = np.mean([r[2] for r in rows]) * 252
    for x, y in zip(a[1:], b[1:]):
        assert x == pytest.approx(y, rel=1e-9)
    assert a.annualized_return_p05 < mean < a.annualized_return_p95


def test_water_filling_caps_and_sums_to_one(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 4.0), ("d", 8.0)], "symbol string, vol double")
    w = {r.symbol: r.weight for r in B.water_fill(df, [], "vol", 0.4).collect()}
    assert sum(w.values()) == pytest.approx(1) and max(w.values()) <= 0.4 + 1e-12
    assert w["b"] == pytest.approx(0.6 * 0.5 / 0.875)
    with pytest.raises(Exception, match="infeasible"):
        B.water_fill(df, [], "vol", 0.2).collect()


def test_isolated_node_is_uniform(spark):
    rho = {("a", "b"): 0.5, ("a", "c"): -0.2, ("b", "c"): -0.1}
    rows = [("k", i, j, v) for (x, y), v in rho.items() for i, j in ((x, y), (y, x))]
    edges = spark.createDataFrame(rows, "key string, i string, j string, rho double")
    w = G.neighbour_weights(edges, 2).toPandas().pivot(index="i", columns="j", values="weight")
    np.testing.assert_allclose(w.sum(axis=1), 1.0)
    np.testing.assert_allclose(w.loc["c"], 1 / 3)


def test_duplicate_keys_are_refused(spark):
    with pytest.raises(ValueError, match="not unique"):
        assert_unique(spark.createDataFrame([(1,), (1,)], "k int"), ["k"])


def test_merges_refuse_repeated_keys_when_they_run(spark):
    once = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    twice = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, w string")
    assert merge_many_to_one(twice, once, ["k"]).count() == 3
    for broken in (merge_unique(twice, once, ["k"]), merge_many_to_one(once, twice, ["k"])):
        with pytest.raises(Exception, match="not unique"):
            broken.collect()
