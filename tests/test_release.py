"""Release events: own weekdays and holidays, carried minutes, whole windows and the daily ledger."""

import datetime as dt
import statistics

from tidepanel.operators import hypotheses as H

DAY = dt.date(2024, 1, 3)  # a Wednesday


def test_release_days_follow_each_symbols_weekday_and_holidays(spark):
    days = [DAY + dt.timedelta(n) for n in range(21)]
    sessions = spark.createDataFrame([(s, d) for s in "ab" for d in days for _ in range(2)], "symbol string, trading_date date")
    # The Thursday holiday disrupts b's Thursday and not a's Wednesday; a holiday is itself disrupted.
    holidays = spark.createDataFrame([(dt.date(2024, 1, 11),), (dt.date(2024, 1, 15),)], "holiday date")
    weekday = "CASE symbol WHEN 'a' THEN 2 ELSE 3 END"
    from pyspark.sql import functions as F

    got = {(r.symbol, r.trading_date) for r in H.release_days(sessions, F.expr(weekday), holidays, ("2024-01-04",)).collect()}
    assert got == {("a", DAY), ("a", dt.date(2024, 1, 10))}
    assert H.release_days(sessions, F.expr(weekday), holidays.limit(0)).count() == 6


def test_event_study_takes_whole_windows_and_earlier_events_only(spark):
    rows, want = [], []
    for k in range(30):
        day = DAY + dt.timedelta(7 * k)
        start = 640 if k == 5 else 600  # the sixth event has no price at the release
        move = ((k * 7) % 11 - 5) / 100
        rows += [("a", day, start, 100.0, 100.0), ("a", day, 644, 100.0, 100.0 * (1 + move)), ("a", day, 700, 100.0, 110.0)]
        if k != 5:
            want.append((day, move))
    bars = spark.createDataFrame(rows, "symbol string, trading_date date, minute int, open double, close double")
    minutes = H.carried_minutes(bars, 930)
    assert minutes.filter(f"trading_date = DATE '{DAY}'").count() == 330
    days = bars.select("symbol", "trading_date").distinct()
    study = H.event_study(minutes, days, 630, (15,), (240,), (0.5,), minute="minute")
    got = {r.trading_date: r for r in study.collect()}
    assert set(got) == {d for d, _ in want}
    for i, (day, move) in enumerate(want):
        r, before = got[day], [m for _, m in want[max(0, i - 20):i]]
        assert abs(r.response_return - move) < 1e-9 and abs(r.target_return - (110 / (100 * (1 + move)) - 1)) < 1e-9
        if len(before) < 12:
            assert r.response_score is None and r.position == 0
        else:
            score = move / statistics.stdev(before)
            assert abs(r.response_score - score) < 1e-6
            assert r.position == (0 if abs(score) < 0.5 else (move > 0) - (move < 0))
    ledger = H.event_ledger(study, bars.unionByName(bars.limit(1).selectExpr(
        "symbol", "DATE '2030-01-01' AS trading_date", "minute", "open", "close"))).collect()
    assert len(ledger) == 31 and sum(r.sides for r in ledger) == 2 * sum(abs(r.position) for r in got.values())
    assert abs(sum(r.gross for r in ledger) - sum(r.position * r.target_return for r in got.values())) < 1e-9
