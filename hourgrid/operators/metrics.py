"""Error metrics, best parameter set, result table, importance ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hourgrid.functions.numeric import exact_avg
from hourgrid.session import cut_lineage


def error_metrics(df: DataFrame, keys: Sequence[str] = ("region", "is_test"), y: str = "y", y_hat: str = "y_hat") -> DataFrame:
    """RMSE, MAE, MAPE (in %, over rows with a non-zero actual) and R2 per key.

    R2 = 1 - SSE / SST with SST = n * var_pop(y) (Welford-stable, no
    sum-of-squares cancellation).  Constant actuals: R2 = 1 for a perfect fit,
    else 0 (the finite convention of the usual scoring library).  Rows without an
    actual or a prediction are left out of all of them; ``n`` counts the others."""
    df = df.where(F.col(y).isNotNull() & F.col(y_hat).isNotNull())
    e = F.col(y_hat) - F.col(y)
    sse = F.sum(e * e)
    sst = F.var_pop(y) * F.count(y)
    r2 = F.when(sst == F.lit(0.0), F.when(sse == F.lit(0.0), F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(
        F.lit(1.0) - sse / sst
    )
    pct = F.when(F.col(y) != F.lit(0.0), F.abs(F.try_divide(e, F.col(y))))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (F.avg(pct) * F.lit(100.0)).alias("mape"),
        r2.alias("r2"),
    )


def best_params(
    scores: DataFrame,
    keys: Sequence[str] = ("region",),
    params: str = "params",
    order: str = "param_order",
    score: str = "mae",
) -> DataFrame:
    """Mean fold error per parameter set, then the set with the lowest mean per
    key; equal means go to the set listed first (lowest ``order``).  Means come
    from exact sums, so equal means are found equal whatever the row order."""
    keys = list(keys)
    mean = scores.groupBy(*keys, order, params).agg(exact_avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n_folds"))
    pick = F.struct(F.col("mean_score"), F.col(order))
    return mean.groupBy(*keys).agg(
        F.min_by(F.col(params), pick).alias("best_params"),
        F.min_by(F.col(order), pick).alias("best_param_order"),
        F.min("mean_score").alias("best_score"),
    )


def region_results(metrics: DataFrame, best: DataFrame, key: str = "region") -> DataFrame:
    """One row per region: best parameters and the error metrics, ordered by region."""
    return metrics.join(best, on=key, how="left").orderBy(key)


def importance_rank(imp: DataFrame, top: int = 10, key: str = "region", feature: str = "feature", value: str = "importance", regions: DataFrame | None = None) -> DataFrame:
    """Compare feature importances across regions.

    Per feature, each region's importance is divided by the feature's largest
    importance over all regions (a region without the feature counts 0); the
    feature's score is the mean of these shares over all regions.  Features
    whose largest importance is 0 get no score.  Returns the ``top`` features by
    score (ties by name), one row per feature and region with the rank; a feature
    that a region lacks has importance 0 there.  ``regions`` is a table with all of them;
    without it they are those of ``imp``, which is written once (features x regions)
    since it is read for the regions, the scores and the cells.  No region passes the driver."""
    if regions is None:
        imp = cut_lineage(imp, "importances")
        regions = imp
    regions = cut_lineage(regions.select(key).distinct(), "regions")
    counted = F.broadcast(regions.agg(F.count("*").alias("_regions")).withColumn("_one", F.lit(1)))
    per_feature = imp.groupBy(feature).agg(F.max(value).alias("_max"), F.sum(value).alias("_sum"))
    per_feature = per_feature.withColumn("_one", F.lit(1)).join(counted, "_one").withColumn(
        "mean_share", F.try_divide(F.col("_sum"), F.nullif(F.col("_max"), F.lit(0.0)) * F.col("_regions"))
    )
    ranked = per_feature.filter(F.col("mean_share").isNotNull()).orderBy(F.desc("mean_share"), F.asc(feature)).limit(top)
    # The top-k table has at most `top` rows: numbering it in one task and
    # broadcasting it are bounded by construction.
    ranked = ranked.select(
        feature, "_max", "mean_share", F.row_number().over(Window.orderBy(F.desc("mean_share"), F.asc(feature))).alias("rank")
    )
    # top x regions cells, each there once
    cells = regions.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(top)))).join(F.broadcast(ranked), "rank")
    found = imp.select(feature, F.col(key).alias("_key"), value).join(F.broadcast(ranked.select(feature)), feature, "left_semi").withColumnRenamed(feature, "_feature")
    out = cells.join(found, F.col(key).eqNullSafe(F.col("_key")) & (F.col(feature) == F.col("_feature")), "left").withColumn(value, F.coalesce(value, F.lit(0.0)))
    out = out.withColumn("share", F.try_divide(F.col(value), F.col("_max")))
    return out.select("rank", feature, key, value, "share", "mean_share")
