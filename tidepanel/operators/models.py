"""Walk-forward model fits.

Ridge fits are exact: tasks reduce their rows to partial Gram matrices per fold, and only those
small matrices meet to be solved.  Classifiers and boosted trees are Spark ML estimators, fitted
once per fold from the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.functions.scalars import ratio
from tidepanel.session import cut_lineage

ROWS_PER_TASK = 200_000  # training rows a task of the tree fits takes


def fold_statistics(train: DataFrame, names: list[str], robust: bool) -> DataFrame:
    """Per fold: fill value, centre and scale of every column, and whether it had gaps.

    Robust scaling measures the imputed column, so quartiles are taken after filling.  A zero
    spread scales by one.
    """
    filled = train.groupBy("fold").agg(
        *[F.coalesce(F.percentile(c, F.lit(0.5)), F.lit(0.0)).alias(f"fill_{c}") for c in names],
        *[(F.count(c) < F.count(F.lit(1))).alias(f"gap_{c}") for c in names],
    )
    df = train.join(filled, "fold")
    value = {c: F.coalesce(F.col(c), F.col(f"fill_{c}")) for c in names}
    aggregates: list[Column] = []
    for c in names:
        if robust:
            q = F.percentile(value[c], F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
            aggregates += [q.alias(f"q_{c}")]
            miss = F.col(c).isNull().cast("double")
            aggregates += [
                F.percentile(miss, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"m_{c}")
            ]
        else:
            aggregates += [F.avg(value[c]).alias(f"mean_{c}"), F.stddev_pop(value[c]).alias(f"sd_{c}")]
    spread = df.groupBy("fold").agg(*aggregates)
    stats = filled.join(spread, "fold")

    def unit(c: Column) -> Column:
        return F.when(c == 0, 1.0).otherwise(c)

    out = [F.col("fold")]
    for c in names:
        if robust:
            out += [
                F.col(f"fill_{c}"), F.col(f"gap_{c}"),
                F.col(f"q_{c}")[1].alias(f"centre_{c}"),
                unit(F.col(f"q_{c}")[2] - F.col(f"q_{c}")[0]).alias(f"scale_{c}"),
                F.col(f"m_{c}")[1].alias(f"mcentre_{c}"),
                unit(F.col(f"m_{c}")[2] - F.col(f"m_{c}")[0]).alias(f"mscale_{c}"),
            ]
        else:
            out += [
                F.col(f"fill_{c}"), F.lit(False).alias(f"gap_{c}"),
                F.col(f"mean_{c}").alias(f"centre_{c}"), unit(F.col(f"sd_{c}")).alias(f"scale_{c}"),
                F.lit(0.0).alias(f"mcentre_{c}"), F.lit(1.0).alias(f"mscale_{c}"),
            ]
    return stats.select(*out)


def design(df: DataFrame, stats: DataFrame, names: list[str], dummies: list[str]) -> DataFrame:
    """Standardized vector ``x``: values, gap indicators, then symbol dummies.

    A column without gaps in training keeps a constant zero indicator, which a penalized fit
    leaves at zero.
    """
    df = df.join(stats, "fold")
    values = [
        (F.coalesce(F.col(c), F.col(f"fill_{c}")) - F.col(f"centre_{c}")) / F.col(f"scale_{c}")
        for c in names
    ]
    gaps = [
        F.when(
            F.col(f"gap_{c}"),
            (F.col(c).isNull().cast("double") - F.col(f"mcentre_{c}")) / F.col(f"mscale_{c}"),
        ).otherwise(0.0)
        for c in names
    ]
    hot = [(F.col("symbol") == s).cast("double") for s in dummies]
    keep = [c for c in df.columns if c not in stats.columns or c == "fold"]
    return df.select(*keep, F.array(*values, *gaps, *hot).alias("x"))


def ridge_by_fold(train: DataFrame, alpha: float, target: str = "target") -> DataFrame:
    """(fold, intercept, coefficients) of a penalized fit with an unpenalized intercept."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for fold, part in pdf.groupby("fold"):
                x = np.array([np.asarray(v, dtype=float) for v in part["x"]])
                z = np.column_stack([np.ones(len(part)), x, part[target].to_numpy(float)])
                g = z.T @ z
                sums[fold] = sums.get(fold, 0.0) + g
        for fold, g in sums.items():
            yield pd.DataFrame({"fold": [fold], "gram": [g.ravel()]})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.asarray(g, dtype=float) for g in pdf["gram"]], axis=0)
        k = int(round(len(total) ** 0.5))
        g = total.reshape(k, k)
        n, sx, sy = g[0, 0], g[0, 1:-1], g[0, -1]
        xx = g[1:-1, 1:-1] - np.outer(sx, sx) / n
        xy = g[1:-1, -1] - sx * sy / n
        beta = np.linalg.solve(xx + alpha * np.eye(k - 2), xy)
        return pd.DataFrame(
            {
                "fold": [pdf["fold"].iloc[0]],
                "intercept": [sy / n - sx @ beta / n],
                "coefficients": [beta],
                "rows": [int(n)],
            }
        )

    grams = train.select("fold", "x", target).mapInPandas(partial, "fold int, gram array<double>")
    return grams.groupBy("fold").applyInPandas(
        solve, "fold int, intercept double, coefficients array<double>, rows long"
    )


def ridge_predict(df: DataFrame, model: DataFrame, name: str = "forecast") -> DataFrame:
    joined = df.join(model.drop("rows"), "fold")
    dot = F.aggregate(
        F.zip_with("x", "coefficients", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v
    )
    return joined.withColumn(name, F.col("intercept") + dot).drop("x", "intercept", "coefficients")


def coefficient_table(model: DataFrame, names: list[str], dummies: list[str]) -> DataFrame:
    labels = [*names, *[f"missing_{c}" for c in names], *[f"symbol_{s}" for s in dummies]]
    pos = F.posexplode("coefficients").alias("i", "coefficient")
    label = F.array(*[F.lit(x) for x in labels])
    return model.select("fold", pos).select("fold", label[F.col("i")].alias("feature"), "coefficient")


def coefficient_stability(table: DataFrame) -> DataFrame:
    return table.groupBy("feature").agg(
        F.avg(F.abs("coefficient")).alias("mean_absolute"),
        F.min("coefficient").alias("lowest"),
        F.max("coefficient").alias("highest"),
    )


def pooled_ridge(
    train: DataFrame, apply: DataFrame, names: list[str], dummies: list[str], alpha: float = 10.0,
    robust: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Forecasts and coefficients; ``train`` is fanned out by fold, ``apply`` carries its fold."""
    stats = fold_statistics(train, names, robust)
    model = ridge_by_fold(design(train, stats, names, dummies), alpha)
    return ridge_predict(design(apply, stats, names, dummies), model), coefficient_table(
        model, names, dummies
    )


def _filled(df: DataFrame, stats: DataFrame, names: list[str]) -> DataFrame:
    joined = df.join(stats.select("fold", *[f"fill_{c}" for c in names]), "fold")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"fill_{c}")) for c in names}).drop(
        *[f"fill_{c}" for c in names]
    )


def boosted_by_fold(
    train: DataFrame, apply: DataFrame, names: list[str], folds: list[int], target: str = "target",
    iterations: int = 150, leaf: int = 100, name: str = "nonlinear",
) -> DataFrame:
    """Boosted trees per fold: the role of histogram boosting with 15 leaves (depth four here).

    Spark's trees take no leaf penalty, so values differ from other implementations.
    """
    stats = fold_statistics(train, names, False)
    train, apply = _filled(train, stats, names), _filled(apply, stats, names)
    # Written once: every tree of every fold reads its rows from here, in as few tasks as they need.
    train = cut_lineage(train.select("fold", target, *names))
    sizes = {row["fold"]: row["n"] for row in train.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = None
    for fold in folds:
        rows = train.filter(F.col("fold") == fold).repartition(1 + sizes.get(fold, 0) // ROWS_PER_TASK)
        stages = [
            VectorAssembler(inputCols=names, outputCol="features"),
            GBTRegressor(
                labelCol=target, maxIter=iterations, stepSize=0.05, maxDepth=4,
                minInstancesPerNode=leaf, seed=20260823, predictionCol=name,
            ),
        ]
        model = Pipeline(stages=stages).fit(rows)
        part = model.transform(apply.filter(F.col("fold") == fold)).drop("features")
        out = part if out is None else out.unionByName(part)
    return out


def logistic_by_fold(
    train: DataFrame, apply: DataFrame, names: list[str], folds: list[int], target: str = "target",
    strength: float = 1.0, name: str = "reversion_probability",
) -> DataFrame:
    """Penalized logistic probability per fold on robust-scaled inputs; one-class folds are skipped.

    ``strength`` is the inverse penalty of the summed loss, hence regParam = 1 / (C n).
    """
    stats = fold_statistics(train, names, True)

    def vectors(df: DataFrame) -> DataFrame:
        return design(df, stats, names, []).select(
            "*", F.transform("x", lambda v: v).alias("row")
        ).drop("x")

    from pyspark.ml.functions import array_to_vector

    # Written once: every fit reads its rows from here.
    train = cut_lineage(vectors(train).withColumn("features", array_to_vector("row")).drop("row"))
    apply = cut_lineage(vectors(apply).withColumn("features", array_to_vector("row")).drop("row"))
    sizes = {
        row["fold"]: row
        for row in train.groupBy("fold")
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct(target).alias("classes"))
        .collect()
    }
    out = None
    for fold in folds:
        size = sizes.get(fold)
        if size is None or size["classes"] < 2:
            continue
        model = LogisticRegression(
            labelCol=target, regParam=1.0 / (strength * size["n"]), elasticNetParam=0.0,
            standardization=False, maxIter=200, tol=1e-9,
        ).fit(train.filter(F.col("fold") == fold))
        part = model.transform(apply.filter(F.col("fold") == fold))
        part = part.withColumn(name, vector_to_array("probability")[1]).drop(
            "features", "rawPrediction", "probability", "prediction"
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no fold has two classes to train on")
    return out


def conviction_positions(
    df: DataFrame, forecast: str, hurdle_bps: float, top: int = 4, keys: list[str] | None = None
) -> DataFrame:
    """Sign of the strongest forecasts that clear a round-trip hurdle, per date (and per ``keys``)."""
    from pyspark.sql import Window

    size = F.abs(forecast)
    rank = F.row_number().over(
        Window.partitionBy(*(keys or []), "trading_date").orderBy(size.desc(), F.col("symbol"))
    )
    clears = (size >= 2.0 * hurdle_bps / 10_000.0) & (F.col("conviction_rank") <= top)
    return df.withColumn("conviction_rank", rank).withColumn(
        "position", F.when(clears, F.signum(forecast)).otherwise(0.0)
    )


def scaled_label(label: str, volatility: str, h: int) -> Column:
    """Hourly label over its expected size, bounded."""
    size = F.col(volatility) * (h / (23.0 * 252.0)) ** 0.5
    value = ratio(label, size)
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(5.0)), F.lit(-5.0)))
