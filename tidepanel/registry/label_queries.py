"""Labels, folds, splits and point-in-time scaling."""

from pyspark.sql import functions as F

from tidepanel.functions.scalars import tidy
from tidepanel.operators import labels as L
from tidepanel.registry.base import query, r, shared
from tidepanel.sources import tables as src

shared(
    t_cal="""
SELECT trading_date, row_number() OVER (ORDER BY trading_date) - 1 AS n
FROM (SELECT DISTINCT trading_date FROM t_panel)
""",
    t_folds="""
SELECT CAST(f + 1 AS INTEGER) AS fold, (SELECT min(trading_date) FROM t_cal) AS train_start,
       a.trading_date AS train_end, b.trading_date AS embargo_start,
       c.trading_date AS embargo_end, d.trading_date AS validation_start,
       e.trading_date AS validation_end, 504 + 63 * f AS train_sessions,
       e.n - d.n + 1 AS validation_sessions
FROM (SELECT unnest(range(0, 200)) AS f) k
JOIN t_cal a ON a.n = 503 + 63 * f JOIN t_cal b ON b.n = 504 + 63 * f
JOIN t_cal c ON c.n = 508 + 63 * f JOIN t_cal d ON d.n = 509 + 63 * f
JOIN t_cal e ON e.n = least(571 + 63 * f, (SELECT max(n) FROM t_cal))
""",
)


@query(
    "forward_labels",
    "SELECT symbol, trading_date, "
    + ", ".join(
        f"{r(f'ln(lead(close, {h}) OVER w / close)', f'forward_log_return_{h}s')}, "
        f"CAST(lead(trading_date, {h}) OVER w AS DATE) AS label_date_{h}s"
        for h in (1, 5, 20)
    )
    + " FROM t_panel WINDOW w AS (PARTITION BY symbol ORDER BY trading_date)",
)
def forward_labels(spark, folder):
    out = L.forward_labels(src.session_panel(spark, folder))
    return tidy(
        out.select(
            "symbol", "trading_date",
            *[c for h in (1, 5, 20) for c in (
                F.col(f"forward_log_return_{h}s"),
                F.to_date(f"label_available_at_{h}s_utc").alias(f"label_date_{h}s"),
            )],
        )
    )


@query(
    "walk_forward_folds",
    """SELECT fold, train_start, train_end, embargo_start, embargo_end, validation_start,
       validation_end, CAST(train_sessions AS BIGINT) AS train_sessions,
       CAST(validation_sessions AS BIGINT) AS validation_sessions FROM t_folds""",
)
def walk_forward_folds(spark, folder):
    return L.walk_forward_folds(src.session_panel(spark, folder))


@query(
    "temporal_split",
    """SELECT symbol, trading_date, CASE WHEN trading_date <= hs - 6 THEN 'development'
              WHEN trading_date >= hs THEN 'holdout' ELSE 'embargo' END AS split
       FROM t_panel, (SELECT CAST(max(trading_date) - INTERVAL 12 MONTH AS DATE) AS hs FROM t_panel)""",
)
def temporal_split(spark, folder):
    return L.holdout_split(src.session_panel(spark, folder)).select(
        "symbol", "trading_date", "split"
    )


@query(
    "split_coverage",
    """SELECT symbol, min(trading_date) AS first_session, max(trading_date) AS last_session,
       CAST(count(*) FILTER (trading_date <= hs - 6) AS BIGINT) AS development_sessions,
       CAST(count(*) FILTER (trading_date >= hs) AS BIGINT) AS holdout_sessions,
       CASE WHEN count(*) FILTER (trading_date <= hs - 6) > 0 THEN 'development_and_holdout'
            ELSE 'holdout_only' END AS eligibility
       FROM t_panel, (SELECT CAST(max(trading_date) - INTERVAL 12 MONTH AS DATE) AS hs FROM t_panel)
       GROUP BY symbol""",
)
def split_coverage(spark, folder):
    return L.split_coverage(L.holdout_split(src.session_panel(spark, folder)))


@query(
    "research_windows",
    """SELECT trading_date, CASE WHEN trading_date >= DATE '2000-06-01' THEN 'test'
              WHEN n < floor(k * 0.7) THEN 'build' ELSE 'selection' END AS research_window
       FROM t_cal, (SELECT count(*) AS k FROM t_cal WHERE trading_date < DATE '2000-06-01')""",
)
def research_windows(spark, folder):
    return L.research_windows(src.session_panel(spark, folder), "2000-06-01")


@query(
    "validation_fold_of_session",
    """SELECT p.symbol, p.trading_date, f.fold FROM t_panel p
       LEFT JOIN t_folds f ON p.trading_date BETWEEN f.validation_start AND f.validation_end""",
)
def validation_fold_of_session(spark, folder):
    return L.fold_of_session(src.session_panel(spark, folder)).select(
        "symbol", "trading_date", "fold"
    )


@query(
    "training_rows_per_fold",
    f"""SELECT f.fold, p.symbol, CAST(count(*) AS BIGINT) AS training_rows,
        max(p.label_date) AS last_label_date, {r('avg(p.y)', 'mean_label')}
        FROM (SELECT symbol, trading_date, lead(trading_date, 5) OVER w AS label_date,
                     ln(lead(close, 5) OVER w / close) AS y
              FROM t_panel WINDOW w AS (PARTITION BY symbol ORDER BY trading_date)) p
        JOIN t_folds f ON p.trading_date <= f.train_end AND p.label_date <= f.train_end
        GROUP BY f.fold, p.symbol""",
)
def training_rows_per_fold(spark, folder):
    panel = src.session_panel(spark, folder)
    labels = L.forward_labels(panel, (5,))
    rows = L.training_folds(labels, panel, "label_available_at_5s_utc")
    return tidy(
        rows.groupBy("fold", "symbol").agg(
            F.count(F.lit(1)).alias("training_rows"),
            F.max(F.to_date("label_available_at_5s_utc")).alias("last_label_date"),
            F.avg("forward_log_return_5s").alias("mean_label"),
        )
    )


SCALED = ("log_return_1s", "range_fraction", "log_volume", "close_location")


@query(
    "point_in_time_robust_scale",
    "SELECT symbol, trading_date, "
    + ", ".join(r(f"{c}_z", c) for c in SCALED)
    + ", "
    + " AND ".join(f"{c}_z IS NOT NULL" for c in SCALED)
    + " AS model_row_complete FROM (SELECT symbol, trading_date, "
    + ", ".join(
        f"""CASE WHEN count({c}) OVER w >= 120 AND {c} IS NOT NULL THEN
            (greatest(least({c}, quantile_cont({c}, 0.99) OVER w), quantile_cont({c}, 0.01) OVER w)
             - quantile_cont({c}, 0.5) OVER w)
            / nullif(CASE WHEN quantile_cont({c}, 0.75) OVER w <> quantile_cont({c}, 0.25) OVER w
                     THEN quantile_cont({c}, 0.75) OVER w - quantile_cont({c}, 0.25) OVER w
                     ELSE stddev_samp({c}) OVER w END, 0) END AS {c}_z"""
        for c in SCALED
    )
    + """ FROM (SELECT symbol, trading_date, lr AS log_return_1s, rf AS range_fraction,
                       lv AS log_volume, (close - low) / nullif(high - low, 0) AS close_location
                FROM t_in2)
          WINDOW w AS (PARTITION BY symbol ORDER BY trading_date
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
)
def point_in_time_robust_scale(spark, folder):
    from tidepanel.operators import features as X
    from tidepanel.functions.scalars import ratio

    df = X.with_inputs(src.session_panel(spark, folder)).withColumn(
        "close_location", ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low"))
    )
    return tidy(L.robust_scale(df, list(SCALED)))


@query(
    "volatility_scaled_target",
    f"""SELECT symbol, trading_date,
        {r('CASE WHEN y IS NOT NULL AND v IS NOT NULL THEN greatest(least(y / nullif(v * sqrt(5.0), 0), 5), -5) END', 'target')}
        FROM (SELECT symbol, trading_date, ln(lead(close, 5) OVER w / close) AS y,
                     CASE WHEN count(lr) OVER w20 >= 20 THEN stddev_samp(lr) OVER w20 END AS v
              FROM t_in2 WINDOW w AS (PARTITION BY symbol ORDER BY trading_date),
              w20 AS (PARTITION BY symbol ORDER BY trading_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))""",
)
def volatility_scaled_target(spark, folder):
    from tidepanel.functions import frames

    panel = src.session_panel(spark, folder)
    vol = panel.select(
        "symbol", "trading_date",
        frames.rows("symbol", "trading_date", 20).std(F.log1p("close_to_close_return")).alias("v"),
    )
    df = L.forward_labels(panel, (5,)).join(vol, ["symbol", "trading_date"])
    return tidy(
        df.select(
            "symbol", "trading_date",
            L.volatility_scaled_target("forward_log_return_5s", "v", 5).alias("target"),
        )
    )


@query(
    "feature_selection_registry",
    """WITH f AS (SELECT DISTINCT p_brand AS feature, CASE WHEN p_brand LIKE '%1' THEN NULL
                         ELSE substr(p_brand, 1, 7) END AS family FROM part),
            d AS (SELECT p_brand AS feature, max(p_size) AS z FROM part GROUP BY 1)
       SELECT f.feature, coalesce(min(family), 'unclassified') AS family,
              max(z) % 3 = 0 AS selected,
              CASE WHEN max(z) % 3 = 1 THEN 'drop_exact_duplicate'
                   WHEN max(z) % 3 = 2 THEN 'drop_cross_instrument_degenerate'
                   ELSE 'selected' END AS status,
              CASE WHEN max(z) % 3 = 0 THEN '' ELSE 'other' END AS duplicate_of,
              f.feature IN (SELECT p_brand FROM part WHERE p_retailprice > 1900)
                AS high_correlation_review
       FROM f JOIN d USING (feature) GROUP BY f.feature""",
)
def feature_selection_registry(spark, folder):
    part = src.table(spark, folder, "part")
    brand = F.col("p_brand").alias("feature")
    metadata = part.select(
        brand,
        F.when(~F.col("p_brand").like("%1"), F.substring("p_brand", 1, 7)).alias("family"),
    ).distinct()
    drops = (
        part.groupBy(brand)
        .agg((F.max("p_size") % 3).alias("z"))
        .filter("z > 0")
        .select(
            "feature",
            F.lit("other").alias("duplicate_of"),
            F.when(F.col("z") == 1, "duplicate").otherwise("degenerate").alias("reason"),
        )
    )
    redundant = part.filter("p_retailprice > 1900").select(
        F.col("p_brand").alias("feature_a"), F.col("p_brand").alias("feature_b")
    )
    return L.feature_registry(metadata, redundant, drops)
