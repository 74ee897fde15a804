"""The audit of a walk-forward study: what was chosen, how it did per fold, and how it bears stress.

Rules come as one long table of daily gross return and traded sides.  A study chooses rules on
earlier folds, by family or one at a time, and is judged only on the folds after.  Every table is an
aggregate of joins of the return table with the few chosen rules, so the rules are read twice: once to
choose, once to replay the choice at every cost level.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.operators import calendar as cal
from tidepanel.operators import evaluate as E
from tidepanel.operators import selection as K
from tidepanel.session import cut_lineage

DATE = "trading_date"

# One-way cost levels in basis points, numbers of best days removed, and the
# resampling of a study.
COSTS = (0.0, 0.5, 1.0, 2.0, 3.5, 5.0)
REMOVED = (0, 1, 3, 5, 10)
BLOCK, SAMPLES, SEED = 20, 5000, 20260823


class Audit(NamedTuple):
    """``records`` are the saved choices, ``portfolio`` the out-of-sample series at the study's own cost."""

    records: DataFrame
    portfolio: DataFrame
    snapshot: DataFrame
    folds: DataFrame
    costs: DataFrame
    outliers: DataFrame
    subperiods: DataFrame
    bootstrap: DataFrame
    gates: DataFrame

    def snapshots(self) -> DataFrame:
        """Figures of the whole series, of each evaluation fold and of each cost level in one table."""
        level = {"whole": (self.snapshot, "portfolio"), "fold": (self.folds, "evaluation_fold"), "cost": (self.costs, "cost_bps")}
        rows = None
        for section, (table, key) in level.items():
            value = F.lit(0.0) if section == "whole" else F.col(key).cast("double")
            part = table.select(F.lit(section).alias("section"), value.alias("level"), *[c for c in table.columns if c != key])
            rows = part if rows is None else rows.unionByName(part)
        return rows

    def stress(self) -> DataFrame:
        """Return and Sharpe without the best days and of each stretch of the series."""
        cut = self.outliers.select(
            F.lit("best_days_removed").alias("section"), F.col("best_days_removed").alias("level"), "total_return", "sharpe"
        )
        return cut.unionByName(
            self.subperiods.select(F.lit("subperiod").alias("section"), F.col("subperiod").alias("level"), "total_return", "sharpe")
        )


def extended_snapshot(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Daily, calendar-period and weekly figures of each series."""
    rows = df.filter(F.col(x).isNotNull())
    return E.performance_snapshot(rows, keys, x).join(E.weekly_hits(rows, keys, x), keys)


def rule_totals(returns: DataFrame, strategy: list[str], keep: list[str]) -> DataFrame:
    """Daily gross and sides per rule, named by its parameters."""
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in strategy])
    rows = returns.withColumn("strategy", name)
    return rows.groupBy("strategy", *keep, DATE).agg(F.sum("gross").alias("gross"), F.sum("sides").alias("sides"))


def on_calendar(returns: DataFrame, names: list[str]) -> DataFrame:
    """Every rule on every date of the study; a rule is flat where it has no row.

    ``names`` are the columns that belong to the rule.  Rules times sessions is bounded by the calendar.
    """
    rules = returns.select("strategy", *names).distinct()
    rows = cal.densify(returns.select("strategy", DATE, "gross", "sides"), "strategy").drop("cal")
    return rows.fillna(0.0, ["gross", "sides"]).join(rules, "strategy")


def measures(tables: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """One row with a column per named number, each an aggregate of its own table.

    The numbers meet as (name, value) rows of a union, so small tables are never joined without a key.
    """
    rows = None
    for name, (table, value) in tables.items():
        row = table.agg(value.cast("double").alias("value")).select(F.lit(name).alias("name"), "value")
        rows = row if rows is None else rows.unionByName(row)
    return rows.agg(*[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in tables])


def at_least(name: str, limit: float) -> Column:
    """A gate on a number; one that is missing fails."""
    return F.coalesce(F.col(name) >= limit, F.lit(False))


def above(name: str, limit: float = 0.0) -> Column:
    return F.coalesce(F.col(name) > limit, F.lit(False))


def common_measures(snapshot: DataFrame, bootstrap: DataFrame) -> dict[str, tuple[DataFrame, Column]]:
    return {
        "sharpe": (snapshot, F.max("sharpe")),
        "wins": (snapshot, F.max(F.greatest("win_weeks", "win_months"))),
        "resampled": (bootstrap, F.max("sharpe_p05")),
    }


def common_gates() -> dict[str, Column]:
    return {
        "walk_forward_sharpe_at_least_2": at_least("sharpe", 2.0),
        "winning_weeks_or_months_at_least_70_percent": at_least("wins", 0.70),
        "bootstrap_fifth_percentile_sharpe_positive": above("resampled"),
    }


def _tables(portfolio: DataFrame, stressed: DataFrame, samples: int) -> dict[str, DataFrame]:
    series = portfolio.withColumn("portfolio", F.lit("walk_forward"))
    return {
        "snapshot": extended_snapshot(series, ["portfolio"], "portfolio_return"),
        "folds": extended_snapshot(portfolio, ["evaluation_fold"], "portfolio_return"),
        "costs": extended_snapshot(stressed, ["cost_bps"], "portfolio_return"),
        "outliers": E.best_days_removed(series, ["portfolio"], "portfolio_return", REMOVED),
        "subperiods": E.subperiods(series, ["portfolio"], "portfolio_return"),
        "bootstrap": E.block_bootstrap(series, "portfolio", "portfolio_return", BLOCK, samples, SEED),
    }


def _cost(table: DataFrame, bps: float, name: str) -> tuple[DataFrame, Column]:
    return table, F.max(F.when(F.col("cost_bps") == bps, F.col(name)))


def _removed(table: DataFrame, days: int) -> tuple[DataFrame, Column]:
    return table, F.max(F.when(F.col("best_days_removed") == days, F.col("sharpe")))


def family_audit(
    returns: DataFrame, family: str, bps: float = 3.5, minimum_score: float | None = 0.0, *, folds: int = 4,
    samples: int = SAMPLES, digits: int | None = None,
) -> Audit:
    """Families of rules chosen fold by fold, weighted, and replayed at every cost level.

    ``returns`` has strategy, symbol, the family, trading_date, gross and sides.  The leverage and
    weights of the replays are the saved ones, so costs change the returns alone.
    """
    base = cut_lineage(on_calendar(returns, ["symbol", family]))
    net = base.withColumn("net", F.col("gross") - F.col("sides") * bps / 10_000.0)
    members, weights = K.select_families(
        net, family, "net", "sides", folds=folds, minimum_score=minimum_score, digits=digits
    )
    portfolio = cut_lineage(K.replay_families(net, members, weights, family, "net", folds=folds))
    chosen = base.join(members.select("strategy").distinct(), "strategy", "left_semi")
    stressed = cut_lineage(K.replay_families(
        E.with_costs(chosen, COSTS), members, weights, family, "net", folds=folds, keys=["cost_bps"]
    ))
    t = _tables(portfolio, stressed, samples)
    families = members.groupBy("evaluation_fold").agg(F.count_distinct(family).alias("n"))
    numbers = measures({
        **common_measures(t["snapshot"], t["bootstrap"]),
        "worst_fold": (t["folds"], F.min(F.coalesce("sharpe", F.lit(0.0)))),
        "costly": _cost(t["costs"], 3.5, "sharpe"),
        "without_best": _removed(t["outliers"], 3),
        "fewest_families": (families, F.min("n")),
    })
    gates = E.gates(numbers, common_gates() | {
        "every_evaluation_fold_positive": above("worst_fold"),
        "sharpe_at_3_5_bps_at_least_1_5": at_least("costly", 1.5),
        "sharpe_after_removing_best_three_days_positive": above("without_best"),
        "at_least_two_unique_hypotheses_selected_each_fold": at_least("fewest_families", 2.0),
    })
    return Audit(K.selection_records(members, weights, family), portfolio, gates=gates, **t)


def chain_audit(
    returns: DataFrame, bps: float = 1.0, least: int = 12, *, folds: int = 4, samples: int = SAMPLES
) -> Audit:
    """The best rule of earlier folds, levered on its past, and replayed at every cost level.

    ``returns`` has strategy, trading_date, gross and sides.
    """
    base = cut_lineage(on_calendar(returns, []))
    net = base.withColumn("net", F.col("gross") - F.col("sides") * bps / 10_000.0)
    need = F.greatest(F.lit(least), 6 * (F.col("evaluation_fold") - 1))
    picked = cut_lineage(K.chained_selection(net, ["strategy"], "net", "sides", need, folds))
    portfolio = cut_lineage(
        K.replay(net, picked, ["strategy"], "net", folds).select(DATE, "evaluation_fold", "portfolio_return")
    )
    chosen = base.join(picked.select("strategy").distinct(), "strategy", "left_semi")
    stressed = cut_lineage(
        K.replay(E.with_costs(chosen, COSTS), picked, ["strategy"], "net", folds).select("cost_bps", DATE, "portfolio_return")
    )
    t = _tables(portfolio, stressed, samples)
    numbers = measures({
        **common_measures(t["snapshot"], t["bootstrap"]),
        "folds": (t["folds"], F.count(F.lit(1))),
        "worst_fold": (t["folds"], F.min("annualized_return")),
        "gross": _cost(t["costs"], 0.0, "annualized_return"),
        "one_point": _cost(t["costs"], 1.0, "annualized_return"),
        "without_best": _removed(t["outliers"], 10),
    })
    every = F.coalesce(F.col("folds") == folds - 1, F.lit(False))
    gates = E.gates(numbers, common_gates() | {
        "selection_available_all_evaluation_folds": every,
        "gross_expectancy_positive": above("gross"),
        "one_bp_expectancy_positive": above("one_point"),
        "all_evaluation_folds_positive": every & above("worst_fold"),
        "positive_after_removing_best_ten_days": above("without_best"),
    })
    records = picked.withColumn("prior_fold_sharpes", F.to_json("prior_fold_sharpes"))
    return Audit(records, portfolio, gates=gates, **t)


def model_audit(
    predictions: DataFrame, models: dict[str, str], primary: str, bps: float = 1.0, *, samples: int = SAMPLES
) -> tuple[DataFrame, Audit]:
    """Forecasts traded by conviction: every model's daily series, and the audit of the primary one.

    ``predictions`` has symbol, trading_date, evaluation_fold, target_return and a column per model.
    Entries must clear the study's own cost at every cost level, so dearer trading changes no choice.
    """
    from tidepanel.operators import accounting as B
    from tidepanel.operators import models as M

    options = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("forecast")) for m, c in models.items()])
    long = predictions.select("symbol", DATE, "evaluation_fold", F.col("target_return").alias("ret"), F.inline(options))
    legs = cut_lineage(M.conviction_positions(long, "forecast", bps, keys=["model"]))
    days = ["model", "evaluation_fold"]
    daily = cut_lineage(B.active_leg_portfolio(legs, days, bps).withColumnRenamed("net", "portfolio_return"))
    portfolio = daily.filter(F.col("model") == primary).select(DATE, "evaluation_fold", "portfolio_return")
    priced = None
    for cost in COSTS:
        part = B.active_leg_portfolio(legs.filter(F.col("model") == primary), [], cost).select(
            F.lit(cost).alias("cost_bps"), DATE, F.col("net").alias("portfolio_return")
        )
        priced = part if priced is None else priced.unionByName(part)
    t = _tables(portfolio, priced, samples)
    numbers = measures({
        **common_measures(t["snapshot"], t["bootstrap"]),
        "worst_fold": (t["folds"], F.min("annualized_return")),
    })
    gates = E.gates(numbers, common_gates() | {"every_evaluation_fold_positive": above("worst_fold")})
    return daily, Audit(legs, portfolio, gates=gates, **t)
