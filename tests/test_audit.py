"""Study audits, theme portfolios and model studies against plain pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import selection as K
from tidepanel.plans import audit as A

DAYS = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(120)]


@pytest.fixture(scope="module")
def rules(spark):
    rng = np.random.default_rng(5)
    rows = []
    for family in ("up", "down", "flat"):
        for symbol in ("A", "B", "C"):
            for k in range(2):
                drift = {"up": 0.002, "down": -0.001, "flat": 0.0015}[family]
                for i, day in enumerate(DAYS):
                    if k and i % 7 == 3:
                        continue  # no row: flat that day
                    rows.append((f"{family}|{symbol}|{k}", symbol, family, day, float(rng.normal(drift, 0.01)), 2.0))
    return spark.createDataFrame(
        rows, "strategy string, symbol string, family string, trading_date date, gross double, sides double"
    )


def wide(rules, column):
    return rules.toPandas().pivot(index="trading_date", columns="strategy", values=column).sort_index().fillna(0.0)


def by_hand(rules, bps):
    """Members, weights, leverage and series at a cost level, by loops over folds and families."""
    gross, sides = wide(rules, "gross"), wide(rules, "sides")
    net = gross - sides * 3.5 / 1e4
    stressed = gross - sides * bps / 1e4
    blocks = np.array_split(np.arange(len(net)), 4)
    chosen, series = {}, []
    for fold in (2, 3, 4):
        past = [net.iloc[b] for b in blocks[: fold - 1]]
        train = pd.concat(past)
        sleeves, held = {}, {}
        for family in ("up", "down", "flat"):
            found = []
            for name in [c for c in net if c.startswith(family)]:
                s = [p[name].mean() / p[name].std() * 252**0.5 for p in past]
                score = np.mean(s) - 0.25 * np.std(s)
                active = sum((sides.iloc[b][name] > 0).sum() for b in blocks[: fold - 1])
                if active >= max(12, 6 * (fold - 1)) and min(s) > -0.5 and score > 0:
                    found.append((-score, name))
            picked = []
            for _, name in sorted(found):
                if any(name.split("|")[1] == p.split("|")[1] for p in picked) or len(picked) == 3:
                    continue
                if picked and train[picked].corrwith(train[name]).abs().max() > 0.75:
                    continue
                picked.append(name)
            if picked:
                sleeves[family], held[family] = train[picked].mean(axis=1), picked
        chosen[fold] = held
        if len(sleeves) < 2:
            continue
        frame = pd.DataFrame(sleeves)
        w = 1 / frame.std()
        w = w / w.sum()
        for _ in range(len(w)):
            over = w > 0.4
            excess, rest = (w[over] - 0.4).sum(), w[~over].sum()
            w[over] = 0.4
            if rest > 0:
                w[~over] += excess * w[~over] / rest
        w = w / w.sum()
        lever = min(2.0, 0.1 / ((frame * w).sum(axis=1).std() * 252**0.5))
        ahead = stressed.iloc[blocks[fold - 1]]
        series.append(sum(ahead[held[f]].mean(axis=1) * w[f] for f in held) * lever)
    return chosen, pd.concat(series)


@pytest.fixture(scope="module")
def audit(rules):
    return A.family_audit(rules, "family", samples=200)


def test_family_choice_and_costs(rules, audit):
    chosen, own = by_hand(rules, 3.5)
    members, weights = K.read_selection_records(audit.records, "family")
    got = {fold: {} for fold in chosen}
    for row in members.orderBy(F.desc("training_score")).collect():
        got[row["evaluation_fold"]].setdefault(row["family"], []).append(row["strategy"])
        assert len(row["prior_fold_sharpes"]) == row["evaluation_fold"] - 1
    assert got == chosen and len(own) > 0
    assert all(0 < w["weight"] <= 1 and 0 < w["leverage"] <= 2 for w in weights.collect())
    series = audit.portfolio.toPandas().set_index("trading_date")["portfolio_return"].sort_index()
    np.testing.assert_allclose(series, own, atol=1e-12)
    costs = audit.costs.toPandas().set_index("cost_bps")
    for bps in A.COSTS:
        x = by_hand(rules, bps)[1]
        assert costs.loc[bps, "sharpe"] == pytest.approx(x.mean() / x.std() * 252**0.5)
        assert costs.loc[bps, "total_return"] == pytest.approx((1 + x).prod() - 1)


def test_family_gates(rules, audit):
    chosen, own = by_hand(rules, 3.5)
    gates = {row["gate"]: row["passed"] for row in audit.gates.collect()}
    sharpe = own.mean() / own.std() * 252**0.5
    rest = own.drop(own.nlargest(3).index)
    folds = [x.mean() > 0 for x in np.array_split(own, 3)] if len(own) == 90 else None
    assert gates["walk_forward_sharpe_at_least_2"] == (sharpe >= 2)
    assert gates["sharpe_at_3_5_bps_at_least_1_5"] == (sharpe >= 1.5)
    assert gates["sharpe_after_removing_best_three_days_positive"] == (rest.mean() > 0)
    assert gates["at_least_two_unique_hypotheses_selected_each_fold"] == all(len(h) >= 2 for h in chosen.values())
    if folds is not None:
        assert gates["every_evaluation_fold_positive"] == all(folds)
    assert gates["bootstrap_fifth_percentile_sharpe_positive"] == (audit.bootstrap.first()["sharpe_p05"] > 0)
    assert gates["all_gates"] == all(v for k, v in gates.items() if k != "all_gates")


def test_nothing_chosen(rules):
    """No member clears its costs: empty tables, every gate fails."""
    audit = A.family_audit(rules, "family", bps=500.0, samples=20)
    assert audit.portfolio.count() == 0 and audit.snapshots().count() == 0
    assert not any(row["passed"] for row in audit.gates.collect())


def test_model_study(spark):
    rng = np.random.default_rng(9)
    rows = [
        (s, day, 2 + i // 40, float(rng.normal(0, 0.003)), float(rng.normal(0, 0.01)))
        for i, day in enumerate(DAYS) for s in "ABCDEF"
    ]
    df = spark.createDataFrame(
        rows, "symbol string, trading_date date, evaluation_fold int, a_prediction double, target_return double"
    ).withColumn("b_prediction", -F.col("a_prediction"))
    daily, audit = A.model_audit(df, {"a": "a_prediction", "b": "b_prediction"}, "a", bps=5.0, samples=50)
    pdf = df.toPandas()
    costs = audit.costs.toPandas().set_index("cost_bps")
    for bps in A.COSTS:
        expected = []
        for _, day in pdf.groupby("trading_date"):
            best = day.reindex(day["a_prediction"].abs().sort_values(ascending=False).index)[:4]
            best = best[best["a_prediction"].abs() >= 2 * 5.0 / 1e4]
            legs = np.sign(best["a_prediction"]) * best["target_return"] - 2 * bps / 1e4
            expected.append(legs.mean() if len(legs) else 0.0)
        x = pd.Series(expected)
        assert costs.loc[bps, "sharpe"] == pytest.approx(x.mean() / x.std() * 252**0.5)
        assert costs.loc[bps, "observations"] == len(DAYS)
    assert daily.groupBy("model").count().count() == 2
    assert audit.folds.count() == 3 and audit.gates.count() == 5


def test_theme_books(spark):
    from tidepanel.plans import studies as P

    rng = np.random.default_rng(17)
    rows = [
        (f"{theme}_{k}", theme, day, 1 + i // 50 if 20 <= i else None, float(rng.normal(0.0005 * (k - 1), 0.01)))
        for theme in ("x", "y", "z") for k in range(4) for i, day in enumerate(DAYS)
    ]
    daily = spark.createDataFrame(rows, "strategy string, theme string, trading_date date, fold int, net double")
    got = P.theme_books(daily, top=2).toPandas().pivot(index="trading_date", columns="book", values="net")
    net = daily.toPandas().pivot(index="trading_date", columns="strategy", values="net")
    seen = net.iloc[20:]
    sharpe = seen.mean() / seen.std()
    best = {t: sharpe[[c for c in net if c.startswith(t)]].sort_values(ascending=False).index for t in "xyz"}
    themes = pd.DataFrame({t: net[list(best[t])].mean(axis=1) for t in "xyz"})
    expected = {
        "all_rules_equal_weight": net.mean(axis=1),
        "all_themes_equal_weight": themes.mean(axis=1),
        "theme_champions_equal_weight": net[[b[0] for b in best.values()]].mean(axis=1),
        "top_2_per_theme_equal_weight": net[[c for b in best.values() for c in b[:2]]].mean(axis=1),
        "all_positive_equal_weight": net[seen.columns[seen.mean() > 0]].mean(axis=1),
        "theme_equal_weight": themes.mean(axis=1),
    }
    for book, series in expected.items():
        np.testing.assert_allclose(got[book], series, atol=1e-12)
    prior = themes.rolling(60, min_periods=20).std().shift(1) * 252**0.5
    scaled = (themes * (0.1 / prior).clip(0.25, 2.0).fillna(1.0)).mean(axis=1)
    whole = scaled.rolling(60, min_periods=20).std().shift(1) * 252**0.5
    np.testing.assert_allclose(
        got["theme_causal_volatility_balanced"], scaled * (0.1 / whole).clip(0.25, 2.0).fillna(1.0), atol=1e-9
    )
    losing = daily.withColumn("net", -F.abs("net"))
    none = P.theme_books(losing, top=2).toPandas().pivot(index="trading_date", columns="book", values="net")
    np.testing.assert_allclose(none["all_positive_equal_weight"], none["theme_champions_equal_weight"])
    rho = P.validation_correlation(daily, "strategy").toPandas().set_index(["member_a", "member_b"])["correlation"]
    assert len(rho) == 66
    assert rho[("x_0", "y_1")] == pytest.approx(seen["x_0"].corr(seen["y_1"]))
