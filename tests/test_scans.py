"""Theme queries read the prints once and give the rules the same features as the whole table."""

import pandas as pd
import pytest

import __spark_entry__ as entry
from tidepanel.operators import signals as N
from tidepanel.plans import studies as P
from tidepanel.registry.signal_queries import full_features
from tidepanel.sources import tables as src

FOLDER = "/root/testdata/sf0.001"


class Reached(Exception):
    pass


@pytest.mark.parametrize("name, step", [("saved_rule_replay", "saved_rule_replay"), ("theme_rule_correlation", "theme_daily")])
def test_prints_are_scanned_once(spark, monkeypatch, name, step):
    scans, quotes = [], src.quotes
    monkeypatch.setattr(src, "quotes", lambda *a: scans.append(a) or quotes(*a))

    def stop(features, panel, *rest):
        raise Reached

    monkeypatch.setattr(P, step, stop)
    with pytest.raises(Reached):
        entry.queries()[name](spark, FOLDER)
    assert len(scans) == 1


def test_named_features_equal_the_whole_table(spark):
    keys = ["symbol", "trading_date"]
    panel = src.settled_panel(spark, FOLDER)
    names = N.theme_inputs([r for r in N.theme_registry() if r[0] in ("momentum_01", "trend_02", "lead_lag_01")])
    some = full_features(spark, FOLDER, panel, [*names, "return_sign_imbalance"])
    whole = full_features(spark, FOLDER).select(*some.columns)
    got, want = (df.toPandas().sort_values(keys).reset_index(drop=True) for df in (some, whole))
    pd.testing.assert_frame_equal(got, want)
    assert got[names].notna().any().all() and got["return_sign_imbalance"].notna().any()
