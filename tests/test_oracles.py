"""A sample of registered queries against their SQL at the smallest scale; every name resolves."""

import datetime as dt
import statistics

import duckdb
import pytest

import __spark_entry__ as entry
from tidepanel.registry import signal_queries

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SAMPLE = (
    "session_panel_bars", "minute_gap_returns", "session_clock_bars_60m", "peer_features", "walk_forward_folds",
    "trade_sequence_drawdown", "net_return_accounting", "h013_volume_conditional_reversal", "keep_last_per_key",
)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    res = con.execute(entry.oracle_sql()[name])
    order = sorted(range(len(res.description)), key=lambda i: res.description[i][0])
    assert [res.description[i][0] for i in order] == cols
    want = sorted((repr([row[i] for i in order]) for row in res.fetchall()))
    got = sorted(repr(list(row)) for row in df.select(*[f"`{c}`" for c in cols]).collect())
    assert got == want


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns[:2] == ["symbol", "fold"]


def test_learning_frame_equals_sql(spark, con):
    test_query_equals_sql(spark, con, "learning_frame_whole_history")


def test_learning_frame_has_the_whole_history(spark, monkeypatch):
    names = "overnight_return eu_open_return pre_open_return open_30_return overnight_volatility".split()
    volumes = "overnight_volume pre_open_volume open_30_volume".split()
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(i * i % 7), *[0.1] * 5, *[float(i + 1)] * 3) for i in range(30)]
    schema = "symbol string, trading_date date, target_return double, " + ", ".join(f"{n} double" for n in names + volumes)
    windows = spark.createDataFrame(rows, schema)
    monkeypatch.setattr(signal_queries.cal, "window_summary", lambda *_: windows)
    got = signal_queries.learning(spark, FOLDER).orderBy("trading_date").collect()
    y = [r[2] for r in rows]
    for i, x in enumerate(got):
        if i < 20:
            assert x["prior_target_volatility_20"] is None and x["observed_volume_surprise"] is None
        else:
            assert x["prior_target_volatility_20"] == pytest.approx(statistics.stdev(y[i - 20 : i]))
            assert x["observed_volume_surprise"] == pytest.approx((i + 1) / statistics.mean(range(i - 19, i + 1)))
        assert x["prior_session_momentum_5"] == (None if i < 5 else pytest.approx(sum(y[i - 5 : i])))
