"""Composed pipelines (the user-facing API), keyed, and with ``regions=`` to work on some.

Most are lazy.  Those that write a staged table (``build_features`` from the lags on,
``sequence_dataset``, ``eda_report``, ``model_report``) or check completeness run jobs while
the query is being built; ``hourgrid.session.stages`` removes their tables afterwards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.operators import features as fe
from hourgrid.operators import boosting, metrics, model, reshape, sites, splits
from hourgrid.operators.ordered import DEFAULT_BLOCK_ROWS, measure
from hourgrid.operators.reports import corr_matrix, hour_month_grid, hour_month_mean, scatter_extract
from hourgrid.schemas import (
    CORR_COLS,
    ENERGY_TYPES,
    EXCLUDED_SITE,
    FUEL_TYPES,
    MODEL_FEATURES,
    PARAM_GRID,
    SEQ_LEN,
    STATE_REGION,
    TARGET,
)
from hourgrid.operators.sinks import committed, read_table, write_if_absent
from hourgrid.session import cut_lineage
from hourgrid.sources.pages import require_complete
from hourgrid.sources.weather import read_weather_text


def _only(df: DataFrame, regions: Sequence[str] | None, col: str = "region") -> DataFrame:
    return df if regions is None else df.where(F.col(col).isin(list(regions)))


def build_region_sites(
    rows: DataFrame | Sequence[DataFrame],
    coords: DataFrame,
    regions: DataFrame | Mapping[str, str] = STATE_REGION,
    exclude: str | None = EXCLUDED_SITE,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """Scraped site rows (or the scraped tables) + coordinate list -> one busiest site per
    region (lower-case columns)."""
    if not isinstance(rows, DataFrame):
        rows = sites.union_tables(rows)
    d = sites.fill_states(rows)
    d = sites.clean_sites(d)
    d = sites.attach_coords(d, coords)
    if not isinstance(regions, DataFrame):
        regions = sites.region_table(rows.sparkSession, regions)
    d = _only(sites.map_region(d, regions), only, "Region")
    if exclude is not None:
        d = sites.exclude_code(d, exclude)
    return sites.snake(sites.busiest_site(d))


def build_energy_hours(
    base_text: DataFrame,
    fuel_text: DataFrame,
    base_types: Mapping[str, str] = ENERGY_TYPES,
    fuel_types: Mapping[str, str] = FUEL_TYPES,
    plan: str = "union",
    regions: Sequence[str] | None = None,
    complete: bool = False,
) -> DataFrame:
    """Landed text readings (base feed, fuel feed) -> one wide row per hour, with ``region``,
    the code of the respondent.  ``complete`` first checks that all announced rows are there."""
    feeds = [_only(x, regions, "respondent") for x in (base_text, fuel_text)]
    if complete:
        feeds = [require_complete(x) for x in feeds]
    b, f = (reshape.parse_readings(x) for x in feeds)
    hours = reshape.energy_hours(b, f, base_types, fuel_types, plan=plan)
    return hours.withColumn("region", F.col("respondent"))


def build_weather_hours(
    spark: SparkSession, path: str, missing_sentinel: float | None = None, region: str | None = None, regions: Sequence[str] | None = None
) -> DataFrame:
    """All landed weather files under ``path`` -> one row per region and hour."""
    return read_weather_text(spark, path, missing_sentinel, region=region, regions=regions)


def build_features(
    energy: DataFrame,
    weather: DataFrame,
    keys: Sequence[str] = ("region",),
    block_rows: int = DEFAULT_BLOCK_ROWS,
    stage: str = "final",
    materialize: bool = True,
    regions: Sequence[str] | None = None,
) -> DataFrame:
    """Energy x weather -> model table.  ``stage`` returns an intermediate table:
    ``joined``, ``calendar``, ``shares``, ``lags`` (before the null drop),
    ``complete`` (after it; the correlation input), ``rolled``, ``final``.

    With ``materialize`` (the default) the joined hourly table is written once to the shared checkpoint
    folder, since it is read for the counts of the series and for the rows.  Where no series has more than
    ``block_rows`` rows, lags and rolling means then share one exchange and one sort; else the complete
    table is written, too, and the rolling pass counts what is left of each series."""
    energy, weather = (_only(x, regions, keys[0]) for x in (energy, weather))
    d = fe.join_energy_weather(energy, weather, keys)
    if stage == "joined":
        return d
    d = fe.calendar_features(d)
    if stage == "calendar":
        return d
    d = fe.share_features(d)
    if stage == "shares":
        return d
    if materialize:
        # one folder a region: later filters on the key prune the files
        d = cut_lineage(d, "hours", keys)
    small = measure(d, keys, "period", block_rows) is None
    d = fe.lag_features(d, keys, block_rows=block_rows, small=small)
    if stage == "lags":
        return d
    d = fe.dropna_any(d)
    if stage == "complete":
        return d
    if materialize and not small:
        d = cut_lineage(d, "complete", keys)
    d = fe.rolling_means(d, keys=keys, block_rows=block_rows, small=small)
    if stage == "rolled":
        return d
    if stage != "final":
        raise ValueError(f"unknown stage {stage!r}")
    return fe.to_feature_table(fe.drop_source_columns(d))


def eda_correlation(energy: DataFrame, weather: DataFrame, keys: Sequence[str] = ("region",), block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    return corr_matrix(build_features(energy, weather, keys, block_rows, stage="complete"), CORR_COLS, keys)


def eda_report(
    energy: DataFrame,
    weather: DataFrame,
    keys: Sequence[str] = ("region",),
    regions: Sequence[str] | None = None,
    block_rows: int = DEFAULT_BLOCK_ROWS,
) -> dict[str, DataFrame]:
    """The tables behind the exploration: the correlation matrix, hour x month means of
    demand, wind and solar (long, and a grid for each), and the plot extracts.  The complete
    table and the one with 720-row means are written once."""
    keys = list(keys)
    complete = cut_lineage(build_features(energy, weather, keys, block_rows, "complete", regions=regions), "complete", keys)
    rolled = cut_lineage(fe.rolling_means(complete, keys=keys, block_rows=block_rows), "rolled", keys)
    values = ["demand", "wind", "solar"]
    out = {"corr": corr_matrix(complete, CORR_COLS, keys), "hour_month": hour_month_mean(rolled, values, keys)}
    out |= {f"grid_{v}": hour_month_grid(rolled, v, keys) for v in values}
    return out | {"extracts": scatter_extract(rolled, keys)}


def sequence_dataset(
    final: DataFrame,
    split: str,
    window: int = SEQ_LEN,
    keys: Sequence[str] = ("region",),
    features: Sequence[str] = tuple(MODEL_FEATURES),
    target: str = TARGET,
    block_rows: int = DEFAULT_BLOCK_ROWS,
    materialize: bool = True,
    regions: Sequence[str] | None = None,
) -> DataFrame:
    """Split by date, scale features with training statistics, and cut
    ``window``-row sequences inside each split.  The split table is read twice
    (statistics, then scaling), so by default it is checkpointed once to the
    shared checkpoint folder instead of replaying its plan."""
    keys = list(keys)
    d = splits.time_split(_only(final, regions, keys[0]), split)
    if materialize:
        d = cut_lineage(d, "split", keys)
    d, _ = splits.standardise(d, list(features), keys)
    return splits.sequences(d, list(features), target, window, [*keys, "is_test"], block_rows=block_rows)


def with_prediction_lag(df: DataFrame) -> DataFrame:
    """A naive forecast (previous row's target) as ``y_hat``, target as ``y``."""
    return df.withColumns({"y": F.col(TARGET), "y_hat": F.col("lag_interchange_1h")})


def model_report(
    spark: SparkSession,
    final: DataFrame,
    split: str,
    grid: Mapping[str, Sequence[float]] = PARAM_GRID,
    features: Sequence[str] = tuple(MODEL_FEATURES),
    target: str = TARGET,
    regions: Sequence[str] | None = None,
    keys: Sequence[str] = ("region",),
    block_rows: int = boosting.BLOCK_ROWS,
) -> dict[str, DataFrame]:
    """All series at once: expanding-fold grid search on the training rows, refit with the
    best set, predictions for train and test rows, error metrics per split,
    gain and split-count importances; plus the cross-region importance ranking.

    ``nodes`` is the table of all models.  The split rows, the blocks, scores, models and predictions are
    written once, all series in one job each, in folders by key: neither the plans nor the
    driver's work grow with the number of series (those of more than ``block_rows`` training rows
    apart: a row each on the driver, see ``boosting``)."""
    keys, features = list(keys), list(features)
    d = cut_lineage(splits.time_split(_only(final, regions, keys[0]), split), "split", keys)
    folded = splits.expanding_folds(d.filter(~F.col("is_test")), keys)
    blocks = model.training_blocks(folded, features, target, keys, block_rows=block_rows)
    scores = cut_lineage(model.grid_search(blocks, grid, keys), "scores")
    best = metrics.best_params(scores, keys)
    nodes = cut_lineage(model.fit_best(blocks, best, grid, features, keys), "nodes", keys)
    preds = model.predict(d, nodes, features, keys, ["period"], block_rows)
    preds = cut_lineage(preds.select(*keys, "period", "is_test", F.col(target).alias("y"), "y_hat"), "predictions", keys)
    gains = cut_lineage(model.gain_importance(nodes, features, keys), "gains")
    results = metrics.region_results(metrics.error_metrics(preds.filter(~F.col("is_test")), keys), best, keys[0])
    # parameters as a map of numbers
    as_map = F.transform_values(F.str_to_map("best_params", F.lit(","), F.lit("=")), lambda _, v: v.cast("double"))
    return {
        "fold_scores": scores,
        "best": best,
        "nodes": nodes,
        "predictions": preds,
        "metrics": metrics.error_metrics(preds, [*keys, "is_test"]),
        "importances": gains,
        "importance_rank": metrics.importance_rank(gains, key=keys[0]),
        "split_counts": model.split_counts(nodes, keys),
        "results": results.withColumn("best_params", as_map),
    }


#: Tables of a model report that are kept by region; the last one tells which regions are done.
REPORT_TABLES = ("fold_scores", "nodes", "predictions", "importances", "split_counts", "results")


def write_model_report(spark: SparkSession, final: DataFrame, split: str, path: str, grid: Mapping[str, Sequence[float]] = PARAM_GRID, key: str = "region", **options) -> dict[str, DataFrame]:
    """The tables of :func:`model_report` below ``path``, written once by region: regions that are there are
    neither trained nor written again, all others in one job a table.  Returns the tables as they are read
    back, and the ranking over all regions."""
    done = committed(spark, f"{path}/{REPORT_TABLES[-1]}", key).select(F.col(key).alias("_done"))
    todo = final.join(done, F.col(key).cast("string").eqNullSafe(F.col("_done")), "left_anti")
    if not todo.select(key).isEmpty():
        report = model_report(spark, todo, split, grid, keys=[key], **options)
        for name in REPORT_TABLES:
            write_if_absent(report[name], f"{path}/{name}", key)
    out = {name: read_table(spark, f"{path}/{name}", part=key) for name in REPORT_TABLES}
    return out | {"importance_rank": metrics.importance_rank(out["importances"], key=key)}
