"""The reversion probability retest: sleeves by scope against a loop, labels known only later left out."""

import datetime as dt
import math
import random

import pytest

from tidepanel.plans import studies as P

LEADS = [("a", 2), ("b", 3), ("a", 3)]
START = dt.datetime(2024, 1, 1)


def weight(p, d, sigma):
    w = -((d > 0) - (d < 0)) * min(max((p - 0.55) / 0.45, 0), 1) * 0.1 / 2**0.5 / sigma
    return min(max(w, -0.25), 0.25)


def test_sleeves_equal_a_loop_over_hours(spark):
    rng = random.Random(5)
    hours, predictions = [], []
    for n in range(72):
        at, block = START + dt.timedelta(hours=n), 1 + n // 24
        for s in "ab":
            hours.append((s, at.date(), at, block, rng.gauss(0, 0.01)))
            for lead in [f"{x}_{h}h" for x, h in LEADS if x == s]:
                if block > 1 and rng.random() < 0.4:
                    predictions.append((block, "m", lead, s, at, rng.random(), rng.gauss(0, 1), 0.3 + rng.random()))
    df = spark.createDataFrame(hours, "symbol string, trading_date date, hour_start_utc timestamp, block int, log_return_1h double")
    found = spark.createDataFrame(predictions, "fold int, model_variant string, lead string, symbol string, hour_start_utc timestamp, "
                                  "reversion_probability double, regression_displacement_24h double, realized_volatility_24h double")
    daily, summary = P.probability_sleeve(df, found, LEADS, ["m", "none"])
    got = {(r.fold, r.model_variant, r.scope, r.trading_date): r for r in daily.collect()}
    ends = {(r.fold, r.model_variant, r.scope): r for r in summary.collect()}
    scopes = ["combined"] + [f"{s}_{h}h" for s, h in LEADS]
    assert len(ends) == 2 * 2 * 4
    for fold in (2, 3):
        times = sorted({h[2] for h in hours if h[3] == fold})
        for scope in scopes:
            target = {}
            for s in "ab":
                for at in times:
                    ws = [weight(p, d, v) for f, _, lead, x, t, p, d, v in predictions
                          if (f, x, t) == (fold, s, at) and scope in ("combined", lead)]
                    target[s, at] = sum(ws) / len(ws) if ws else 0.0
            gross, turnover, entries = 0.0, 0.0, 0
            for s in "ab":
                if scope != "combined" and not scope.startswith(s):
                    assert all(target[s, at] == 0 for at in times)
                before, held = 0.0, 0.0
                for i, at in enumerate(times):
                    new = target[s, times[i - 1]] if i else 0.0
                    ret = next(math.expm1(h[4]) for h in hours if h[0] == s and h[2] == at)
                    gross += new * ret
                    turnover += abs(new - held) / 2 + (abs(new) / 2 if at == times[-1] else 0)
                    held = new
                    w = target[s, at]
                    entries += w != 0 and (before == 0 or (before > 0) != (w > 0))
                    before = w
            rows = [r for k, r in got.items() if k[:3] == (fold, "m", scope)]
            assert sum(r.gross_return for r in rows) == pytest.approx(gross, abs=1e-12)
            assert sum(r.turnover for r in rows) == pytest.approx(turnover, abs=1e-12)
            assert sum(r.cost for r in rows) == pytest.approx(turnover * 3.5 / 1e4, abs=1e-12)
            end = ends[fold, "m", scope]
            assert (end.entries, end.active_hours) == (entries, sum(any(target[s, at] for s in "ab") for at in times))
            assert ends[fold, "none", scope].entries == 0 and ends[fold, "none", scope].total_cost == 0


def test_labels_known_after_the_fold_starts_do_not_train(spark):
    def rows(late_label):
        rng, out = random.Random(8), []
        for n in range(60):
            at, block = START + dt.timedelta(hours=n), 1 + n // 40
            known, target = at + dt.timedelta(hours=2), float(rng.random() < 0.5)
            x = rng.gauss(0, 1)
            if 38 <= n < 40:
                target = late_label
            z = 4.0 if n % 5 else 1.0  # every fifth hour is not extreme
            out.append(("a", at.date(), at, block, z, x, 0.5, target, known, x))
        return spark.createDataFrame(out, "symbol string, trading_date date, hour_start_utc timestamp, block int, "
                                     "regression_residual_zscore_24h double, regression_displacement_24h double, realized_volatility_24h double, "
                                     "target_before_stop_2h double, label_available_at_2h_utc timestamp, state double")

    results = [
        {r.hour_start_utc: r.reversion_probability for r in P.probability_predictions(rows(late), [("a", 2)], {"one": ["state"]}).collect()}
        for late in (0.0, 1.0)
    ]
    assert len(results[0]) == 16 and results[0] == pytest.approx(results[1], abs=1e-9)
