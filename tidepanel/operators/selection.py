"""Choosing rules from ranked lists, fold by fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.operators import evaluate as E
from tidepanel.operators.accounting import leverage_for
from tidepanel.session import cut_lineage

DATE = "trading_date"


def eligible(build: int, selection: int) -> Column:
    return (
        (F.col("build_annualized_return") > 0)
        & (F.col("selection_annualized_return") > 0)
        & (F.col("build_trades") >= build)
        & (F.col("selection_trades") >= selection)
    )


def ranked(df: DataFrame, keys: list[str], score: str, tie: str = "strategy") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w))


def top_k(df: DataFrame, k: int, score: str, tie: str = "strategy") -> DataFrame:
    """The k best rows; Spark keeps k rows per task before the final merge."""
    return df.orderBy(F.col(score).desc_nulls_last(), F.col(tie)).limit(k)


def with_supplements(df: DataFrame, qualified: Column, score: str, target: int = 100, floor: int = 20) -> DataFrame:
    """The qualified best; when too few qualify, the best others fill up to the floor."""
    chosen = top_k(df.filter(qualified), target, score).withColumn("qualified", F.lit(True))
    rest = df.join(chosen.select("strategy"), "strategy", "left_anti")
    others = ranked(rest, [], score).withColumn("qualified", F.lit(False))
    held = chosen.agg(F.count(F.lit(1)).alias("n")).scalar()
    size = df.agg(F.least(F.lit(min(floor, target)), F.count(F.lit(1))).alias("n")).scalar()
    others = others.withColumns({"held": held, "need": size})
    fill = others.filter(F.col("rank") <= F.col("need") - F.col("held"))
    return chosen.unionByName(fill.drop("rank", "held", "need"))


def best_per_key(df: DataFrame, key: str, score: str, n: int) -> DataFrame:
    """Best row of each key, then the n best keys."""
    return top_k(ranked(df, [key], score).filter("rank = 1").drop("rank"), n, score)


def champions(df: DataFrame, key: str, score: str, n: int = 3) -> DataFrame:
    """Top n of each key, the first flagged as champion."""
    out = ranked(df, [key], score).filter(F.col("rank") <= n)
    return out.withColumn("champion", F.col("rank") == 1)


def series_arrays(returns: DataFrame, key: str, value: str, only: Column | None = None) -> DataFrame:
    """One row per strategy with its dense return series as an array in date order."""
    df = returns.filter(only) if only is not None else returns
    packed = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(DATE, value))).alias("s"))
    return packed.select(key, F.transform("s", lambda e: e[value]).alias("series"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def greedy_pruned(
    candidates: DataFrame, keys: list[str], score: str, *, target: int, per_symbol: int,
    maximum_correlation: float, least: int = 1,
) -> DataFrame:
    """Walk each key's ranked list, skipping full symbols and near copies of those taken.

    All keys go on together, a pick at a time: a key's next pick is its best candidate that no earlier pick
    has ruled out, and it rules out those that resemble it or whose symbol is full.  So each pick is
    one join of the candidates left with one row per key, and every candidate is compared with the picks
    alone.  A correlation that is undefined does not exclude.
    """
    rows = ranked(candidates.select(*keys, "strategy", "symbol", score, "series"), keys, score)
    rows = rows.repartition(*keys, "strategy")  # ranking brings a key into one task, comparing spreads it again
    rows = cut_lineage(rows.withColumns({
        "total": _sum(F.col("series")), "squares": _sum(F.transform("series", lambda x: x * x)), "used": F.lit(0)}))
    left = rows
    picks = None
    for number in range(1, target + 1):
        best = cut_lineage(left.groupBy(*keys).agg(
            F.min_by(F.struct("rank", "strategy", "symbol", score, "series", "total", "squares"), "rank").alias("pick")))
        if not best.take(1):
            break
        picked = best.select(*keys, "pick.strategy", "pick.symbol", F.col(f"pick.{score}"), F.lit(number).alias("pick"))
        picks = picked if picks is None else picks.unionByName(picked)
        n = F.size("series")
        own, other = (F.col(f"{p}squares") - F.col(f"{p}total") ** 2 / n for p in ("", "pick."))
        constant = (own <= 1e-12 * F.col("squares")) | (other <= 1e-12 * F.col("pick.squares"))
        together = _sum(F.zip_with("series", "pick.series", lambda x, y: x * y)) - F.col("total") * F.col("pick.total") / n
        alike = F.coalesce(~constant & (F.abs(together) > maximum_correlation * F.sqrt(own * other)), F.lit(False))
        used = F.col("used") + (F.col("symbol") == F.col("pick.symbol")).cast("int")
        left = cut_lineage(
            left.join(best, keys).where(F.col("rank") > F.col("pick.rank"))
            .withColumn("used", used).where((F.col("used") < per_symbol) & ~alike).drop("pick"))
    if picks is None:
        return rows.where(F.lit(False)).select(*keys, "strategy", "symbol", score, F.lit(0).alias("pick"))
    if least > 1:
        enough = picks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        picks = picks.join(enough.select(*keys), keys, "left_semi")
    return picks


def prior_fold_scores(
    returns: DataFrame, keys: list[str], value: str, active: str, folds: int = 4
) -> DataFrame:
    """Per strategy and evaluation fold: the Sharpe of every earlier block, their mean less a
    quarter of their deviation (population), the worst, and the active days before the fold.
    """
    blocked = E.date_blocks(returns, folds, DATE)
    per_block = blocked.groupBy(*keys, "block").agg(
        E.sharpe(value).alias("s"), F.count_if(F.col(active) > 0).alias("active")
    )
    ahead = per_block.withColumn(
        "evaluation_fold",
        F.explode(F.sequence(F.col("block") + 1, F.lit(folds + 1))),
    ).filter(F.col("evaluation_fold") <= folds)
    out = ahead.groupBy(*keys, "evaluation_fold").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("block", "s"))), lambda e: e["s"]
        ).alias("prior_fold_sharpes"),
        F.count("s").alias("known"),
        F.avg("s").alias("mean_s"),
        F.stddev_pop("s").alias("sd_s"),
        F.min("s").alias("worst_prior_sharpe"),
        F.sum("active").alias("training_trades"),
    )
    return out.filter(F.col("known") == F.col("evaluation_fold") - 1).select(
        *keys, "evaluation_fold", "prior_fold_sharpes", "worst_prior_sharpe", "training_trades",
        (F.col("mean_s") - 0.25 * F.col("sd_s")).alias("training_score"),
    )


def chained_selection(
    returns: DataFrame, keys: list[str], value: str, active: str, least_trades: Column, folds: int = 4,
    within: list[str] | None = None,
) -> DataFrame:
    """Best earlier score per evaluation fold (and per ``within``), levered on its past rows."""
    within = within or []
    scores = prior_fold_scores(returns, keys, value, active, folds)
    scores = scores.filter(F.col("training_trades") >= least_trades)
    best = Window.partitionBy("evaluation_fold", *within).orderBy(
        F.col("training_score").desc(), *[F.col(k).desc() for k in keys]
    )
    picked = scores.withColumn("rank", F.row_number().over(best)).filter("rank = 1").drop("rank")
    blocked = E.date_blocks(returns, folds, DATE)
    past = (
        blocked.join(picked.select(*keys, "evaluation_fold"), keys)
        .filter(F.col("block") < F.col("evaluation_fold"))
        .groupBy(*keys, "evaluation_fold")
        .agg(leverage_for(F.stddev_samp(value) * 252.0**0.5).alias("leverage"))
    )
    return picked.join(past, [*keys, "evaluation_fold"])


def replay(returns: DataFrame, picked: DataFrame, keys: list[str], value: str, folds: int = 4) -> DataFrame:
    """Out-of-sample series of saved selections, on any return table of the same rules."""
    blocked = E.date_blocks(returns, folds, DATE).withColumnRenamed("block", "evaluation_fold")
    return blocked.join(picked.select(*keys, "evaluation_fold", "leverage"), [*keys, "evaluation_fold"]).withColumn(
        "portfolio_return", F.col(value) * F.col("leverage")
    )


def select_families(
    returns: DataFrame, family: str, value: str, active: str, *, folds: int = 4, per_family: int = 3,
    maximum_correlation: float = 0.75, minimum_score: float | None = 0.0, maximum_weight: float = 0.40,
    digits: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Family members chosen on earlier folds, families weighted by capped inverse volatility.

    Returns (members, weights): members carry the Sharpe ratios and active days they were chosen by,
    weights the leverage of their fold.  A fold with fewer than two families has members and no weights.
    ``digits`` rounds scores before they are ranked, so that rules with equal returns tie.
    """
    from tidepanel.operators.accounting import redistribute_excess

    keys = ["strategy", "symbol", family]
    scores = prior_fold_scores(returns, keys, value, active, folds)
    fits = (F.col("training_trades") >= F.greatest(F.lit(12), 6 * (F.col("evaluation_fold") - 1))) & (
        F.col("worst_prior_sharpe") > -0.50
    )
    if minimum_score is not None:
        fits = fits & (F.col("training_score") > minimum_score)
    scores = scores.filter(fits)
    if digits is not None:
        scores = scores.withColumn("training_score", F.round("training_score", digits))
    scores = cut_lineage(scores)
    blocked = E.date_blocks(returns, folds, DATE)
    arrays = blocked.groupBy("strategy").agg(
        F.array_sort(F.collect_list(F.struct(DATE, "block", value))).alias("s")
    )
    training = F.transform(
        F.filter("s", lambda e: e["block"] < F.col("evaluation_fold")), lambda e: e[value]
    )
    candidates = scores.join(arrays, "strategy").withColumn("series", training)
    picked = greedy_pruned(
        candidates, ["evaluation_fold", family], "training_score", target=per_family, per_symbol=1,
        maximum_correlation=maximum_correlation,
    )
    why = scores.select("evaluation_fold", *keys, "training_trades", "prior_fold_sharpes")
    members = cut_lineage(picked.join(why, ["evaluation_fold", *keys]))
    train = _family_sleeves(returns, members, family, value, folds, [], F.col("block") < F.col("evaluation_fold"))
    vol = train.groupBy("evaluation_fold", family).agg(F.stddev_samp("sleeve").alias("vol"))
    enough = vol.groupBy("evaluation_fold").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    vol = vol.join(enough.select("evaluation_fold"), "evaluation_fold")
    weights = redistribute_excess(vol, ["evaluation_fold"], "vol", maximum_weight, name=family)
    mixed = train.join(weights, ["evaluation_fold", family]).groupBy("evaluation_fold", DATE).agg(
        F.sum(F.col("sleeve") * F.col("weight")).alias("r")
    )
    lever = mixed.groupBy("evaluation_fold").agg(leverage_for(F.stddev_samp("r") * 252.0**0.5).alias("leverage"))
    return members, cut_lineage(weights.join(lever, "evaluation_fold"))


def _family_sleeves(
    returns: DataFrame, members: DataFrame, family: str, value: str, folds: int, keys: list[str], only: Column
) -> DataFrame:
    """Daily mean of each family's members, over the dates that ``only`` keeps for the fold."""
    chosen = members.select("evaluation_fold", family, "strategy")
    rows = E.date_blocks(returns, folds, DATE).drop(family).join(chosen, "strategy").filter(only)
    return rows.groupBy(*keys, "evaluation_fold", family, DATE).agg(F.avg(value).alias("sleeve"))


def replay_families(
    returns: DataFrame, members: DataFrame, weights: DataFrame, family: str, value: str, *, folds: int = 4,
    keys: list[str] | None = None,
) -> DataFrame:
    """Out-of-sample series of saved members and weights, on any return table of the same rules.

    ``keys`` tell apart several return tables in one, such as cost levels.
    """
    keys = keys or []
    sleeves = _family_sleeves(returns, members, family, value, folds, keys, F.col("block") == F.col("evaluation_fold"))
    return sleeves.join(weights, ["evaluation_fold", family]).groupBy(*keys, DATE, "evaluation_fold").agg(
        (F.sum(F.col("sleeve") * F.col("weight")) * F.max("leverage")).alias("portfolio_return")
    )


def walk_forward_families(
    returns: DataFrame, family: str, value: str, active: str, *, folds: int = 4, **choices
) -> tuple[DataFrame, DataFrame]:
    """(selections, portfolio) of ``select_families``; a fold with fewer than two families is skipped."""
    members, weights = select_families(returns, family, value, active, folds=folds, **choices)
    portfolio = replay_families(returns, members, weights, family, value, folds=folds)
    return members.drop("training_trades", "prior_fold_sharpes"), portfolio


FAMILY_WEIGHT = "__FAMILY_WEIGHT__"  # fixed value: marks a family's weight among the records


def selection_records(members: DataFrame, weights: DataFrame, family: str) -> DataFrame:
    """One record per member and per family weight, evidence as JSON text."""
    chosen = members.select(
        "evaluation_fold", family, "strategy", "symbol", "training_score", F.col("training_trades").cast("long"),
        F.to_json("prior_fold_sharpes").alias("prior_fold_sharpes"),
    )
    weighed = weights.select(
        "evaluation_fold", family, F.lit(FAMILY_WEIGHT).alias("strategy"), F.lit("").alias("symbol"),
        F.col("weight").alias("training_score"), F.lit(0).cast("long").alias("training_trades"),
        F.to_json(F.struct("leverage")).alias("prior_fold_sharpes"),
    )
    return chosen.unionByName(weighed)


def read_selection_records(records: DataFrame, family: str) -> tuple[DataFrame, DataFrame]:
    """(members, weights) of saved records."""
    is_weight = F.col("strategy") == FAMILY_WEIGHT
    members = records.filter(~is_weight).withColumn(
        "prior_fold_sharpes", F.from_json("prior_fold_sharpes", "array<double>")
    )
    weights = records.filter(is_weight).select(
        "evaluation_fold", family, F.col("training_score").alias("weight"),
        F.from_json("prior_fold_sharpes", "leverage double")["leverage"].alias("leverage"),
    )
    return members, weights


def parameter_neighbours(audit: DataFrame, chosen: DataFrame, lookbacks: tuple[int, ...], thresholds: tuple[float, ...]) -> DataFrame:
    """Rules one grid step or less from a chosen rule of the same symbol and family.

    Each chosen rule lists its neighbouring cells, so the match is an equi-join on the cell.
    """
    def index(values, column):
        return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)).cast("int")

    cell = ["symbol", "family", "i", "j"]
    grid = audit.withColumns({"i": index(lookbacks, "lookback"), "j": index(thresholds, "threshold")})
    near = chosen.withColumns(
        {"ci": index(lookbacks, "lookback"), "cj": index(thresholds, "threshold")}
    ).select(F.col("strategy").alias("selected_strategy"), "symbol", "family", "ci", "cj")
    step = F.sequence(F.lit(-1), F.lit(1))
    near = near.withColumn("di", F.explode(step)).withColumn("dj", F.explode(step))
    near = near.filter("di <> 0 OR dj <> 0").select(
        "selected_strategy", "symbol", "family", (F.col("ci") + F.col("di")).alias("i"),
        (F.col("cj") + F.col("dj")).alias("j"),
    )
    return near.join(grid, cell).drop("i", "j")
