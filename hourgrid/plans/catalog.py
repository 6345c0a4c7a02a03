"""Registered queries: one per operator of the inventory, each reading the
driver's tables (through ``hourgrid.sources.bindings``) and returning a lazy
DataFrame.  The DuckDB statements that must give the same rows are in
``hourgrid.plans.oracle``.

Numbers that come out of sums over many rows are rounded to 4 places (in the
oracle too); everything else is exact by construction (decimal sums, copies,
single IEEE operations on equal inputs).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.functions.numeric import exact_avg
from hourgrid.operators import boosting, metrics, model, reports, reshape, sites, splits
from hourgrid.operators.ordered import DEFAULT_BLOCK_ROWS
from hourgrid.plans import pipelines
from hourgrid.schemas import CORR_COLS, EXCLUDED_SITE, MODEL_FEATURES, PARAM_GRID, TARGET
from hourgrid.operators.sinks import read_table, write_if_absent
from hourgrid.session import cut_lineage, scratch_path
from hourgrid.sources import bindings as b
from hourgrid.sources.pages import ARRIVAL, first_rows, land_pages, page_completeness, page_gaps, read_pages, require_complete
from hourgrid.sources.tables import ENERGY_COLS, read_coords_csv, read_energy_csv, read_model_table
from hourgrid.sources.weather import land_weather, read_weather_text, time_gaps, write_weather
from hourgrid.streaming.ingest import ingest_pages

# Fixed values of the bound test data.
TEST_SPLIT = "2000-07-01"
BASE = {t: t for t in b.BASE_TYPES}
FUEL = {t: t for t in b.FUEL_TYPES}
FILTER_REGIONS = ["AMERICA", "EUROPE"]
# Forecast scale factors standing in for a parameter grid (best_params binding).
FACTOR_GRID = [1.0, 0.9, 1.1]

# Rows per window block; the session may override it (tests use small blocks to
# exercise the halo logic).
BLOCK_CONF = "hourgrid.window.blockRows"
# Likewise for the blocks of training rows.
MODEL_CONF = "hourgrid.model.blockRows"
# Moves values off the ties of rounding.
OFF_TIES = 3.7e-8
# A model that SQL can grow, too.
SHORT_MODEL = {"max_depth": 3, "learning_rate": 0.1, "n_estimators": 2}


def block_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BLOCK_CONF, str(DEFAULT_BLOCK_ROWS)))


def model_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(MODEL_CONF, str(boosting.BLOCK_ROWS)))


def r4(c: str | Column) -> Column:
    """Round a noisy statistic to 4 places (and fold -0.0 into 0.0)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 4) + F.lit(0.0)


def _lower(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


# ---------------------------------------------------------------- features
def _stage(spark: SparkSession, d: str, stage: str) -> DataFrame:
    return pipelines.build_features(b.panel(spark, d), b.weather(spark, d), ("region",), block_rows(spark), stage)


def q_energy_weather(spark, d):
    return _stage(spark, d, "joined")


def q_calendar_features(spark, d):
    return _stage(spark, d, "calendar")


def q_share_features(spark, d):
    return _stage(spark, d, "shares")


def q_lag_features(spark, d):
    return _stage(spark, d, "lags")


def q_dropna_any(spark, d):
    return _stage(spark, d, "complete")


def q_rolling_30d(spark, d):
    return _stage(spark, d, "rolled")


def q_feature_table(spark, d):
    return _stage(spark, d, "final")


def q_corr_matrix(spark, d):
    c = reports.corr_matrix(_stage(spark, d, "complete"), CORR_COLS, ("region",))
    return c.withColumn("corr", r4("corr"))


def q_scatter_extract(spark, d):
    return reports.scatter_extract(_stage(spark, d, "rolled"))


# ---------------------------------------------------------------- splits
def _split_final(spark, d) -> DataFrame:
    return splits.time_split(_stage(spark, d, "final"), TEST_SPLIT)


def q_time_split(spark, d):
    return _split_final(spark, d).select("region", "period", TARGET, "is_test")


def q_expanding_folds(spark, d):
    train = cut_lineage(_split_final(spark, d).filter(~F.col("is_test")), "train", ["region"])
    return splits.expanding_folds(train, ("region",)).select("region", "period", "fold")


def q_standardise(spark, d):
    # statistics and scaling both read the split table: checkpoint it once
    scaled, _ = splits.standardise(cut_lineage(_split_final(spark, d)), MODEL_FEATURES, ("region",))
    return scaled.select("region", "period", "is_test", *[r4(c).alias(c) for c in MODEL_FEATURES])


def q_sequence_24(spark, d):
    seq = pipelines.sequence_dataset(_stage(spark, d, "final"), TEST_SPLIT, block_rows=block_rows(spark))
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    total = add(F.flatten("seq"))
    # a sum weighted by the place of the step, and the first and last step: the order counts
    weighted = add(F.transform("seq", lambda s, i: add(s) * (i + 1)))
    ends = {"first_step": F.get("seq", F.lit(0)), "last_step": F.get("seq", F.size("seq") - 1)}
    return seq.select(
        "region", "is_test", "period", F.size("seq").alias("n_steps"), r4(total).alias("seq_sum"), r4(weighted).alias("seq_weighted"),
        *[r4(add(e)).alias(n) for n, e in ends.items()], "y",
    )


def q_scale_inverse(spark, d):
    """Features scaled and brought back."""
    scaled, scaler = splits.standardise(cut_lineage(_split_final(spark, d)), MODEL_FEATURES, ("region",))
    back = splits.apply_scaler(scaled, scaler, MODEL_FEATURES, ("region",), inverse=True)
    # many values lie half-way between two of four places: moved off before they are rounded
    return back.select("region", "period", "is_test", *[r4(F.col(c) + F.lit(OFF_TIES)).alias(c) for c in MODEL_FEATURES])


# ---------------------------------------------------------------- metrics
def _naive_predictions(spark, d) -> DataFrame:
    return pipelines.with_prediction_lag(_split_final(spark, d))


def q_error_metrics(spark, d):
    m = metrics.error_metrics(_naive_predictions(spark, d), ("region", "is_test"))
    return m.select("region", "is_test", "n", *[r4(c).alias(c) for c in ("rmse", "mae", "mape", "r2")])


def _fold_scores(spark, d) -> DataFrame:
    """(region, params, param_order, fold, mae): scaled day-ahead forecasts scored on
    the expanding validation folds of the panel series."""
    # numbering reads its input twice: the aggregated panel is written once before
    folded = splits.expanding_folds(cut_lineage(b.panel(spark, d), "panel"), ("region",)).filter(F.col("fold") >= 1)
    grid = F.array(
        *[F.struct(F.lit(i).alias("param_order"), F.lit(f).alias("factor")) for i, f in enumerate(FACTOR_GRID)]
    )
    d2 = folded.select("region", "fold", "demand", "da_forecast", F.explode(grid).alias("p"))
    d2 = d2.select(
        "region",
        "fold",
        F.col("p.param_order").alias("param_order"),
        F.concat(F.lit("factor="), F.col("p.factor").cast("string")).alias("params"),
        F.abs(F.col("demand") - F.col("da_forecast") * F.col("p.factor")).alias("err"),
    )
    return d2.groupBy("region", "params", "param_order", "fold").agg(exact_avg("err").alias("mae"))


def q_scaled_scores(spark, d):
    """Scores of a forecast made in scaled units, after inverse scaling."""
    rows = cut_lineage(_naive_predictions(spark, d), "naive")
    scaler = splits.fit_scaler(rows, [TARGET])
    stats = scaler.select("region", *[F.col(f"{TARGET}__{s}").alias(f"{c}__{s}") for c in ("y", "y_hat") for s in ("mean", "scale")])
    scaled = splits.apply_scaler(rows.select("region", "is_test", "y", "y_hat"), stats, ["y", "y_hat"])
    m = metrics.error_metrics(splits.original_units(scaled, scaler, TARGET), ("region", "is_test"))
    return m.select("region", "is_test", "n", *[r4(c).alias(c) for c in ("rmse", "mae", "r2")])


def q_best_params(spark, d):
    return metrics.best_params(_fold_scores(spark, d))


def q_region_results(spark, d):
    m = metrics.error_metrics(_naive_predictions(spark, d).filter(~F.col("is_test")), ("region",))
    m = m.select("region", "n", *[r4(c).alias(c) for c in ("rmse", "mae", "mape", "r2")])
    best = q_best_params(spark, d)
    return metrics.region_results(m, best)


def q_importance_rank(spark, d):
    c = q_corr_matrix(spark, d)
    imp = c.filter((F.col("feature_1") == TARGET) & (F.col("feature_2") != TARGET)).select(
        "region", F.col("feature_2").alias("feature"), F.abs(F.col("corr")).alias("importance")
    )
    out = metrics.importance_rank(imp, top=10)
    return out.withColumns({"share": r4("share"), "mean_share": r4("mean_share")})


# ---------------------------------------------------------------- readings
def q_reading_parse(spark, d):
    return reshape.parse_readings(b.readings_text(spark, d))


def q_reading_pivot(spark, d):
    return reshape.pivot_first(b.readings(spark, d), BASE)


def q_energy_outer(spark, d):
    txt = b.readings_text(spark, d)
    base = txt.filter(F.col("type_name").isin(list(BASE)))
    fuel = txt.filter(F.col("type_name").isin(list(FUEL)))
    return pipelines.build_energy_hours(base, fuel, BASE, FUEL)


def q_energy_pages(spark, d):
    """Pages as the service sends them (names of the wire, no ordinal, one document a file, some
    pretty-printed, some landed twice) -> each place once, complete? -> wide energy hours with their region."""
    path = land_pages(b.readings_text(spark, d), scratch_path(spark, "wire-pages"), page_rows=2000, wire=True, again=F.col("_page") % 3 == 0)
    rows = require_complete(read_pages(spark, path))
    return pipelines.build_energy_hours(
        rows.filter(F.col("type_name").isin(list(BASE))), rows.filter(F.col("type_name").isin(list(FUEL))), BASE, FUEL
    )


def q_page_completeness(spark, d):
    path = land_pages(b.readings_text(spark, d), scratch_path(spark, "pages"))
    return page_completeness(read_pages(spark, path, layout="lines"))


def q_page_gaps(spark, d):
    """Places of each result that have not come, where some pages are missing and some came twice."""
    path = land_pages(b.readings_text(spark, d), scratch_path(spark, "pages"), 200, missing=F.col("_page") % 5 == 2, again=F.col("_page") % 3 == 0)
    return page_gaps(cut_lineage(read_pages(spark, path)))


def q_page_coverage(spark, d):
    """Rows of those pages, each place once."""
    path = land_pages(b.readings_text(spark, d), scratch_path(spark, "pages"), 200, missing=F.col("_page") % 5 == 2, again=F.col("_page") % 3 == 0)
    return first_rows(read_pages(spark, path)).drop(*ARRIVAL)


def q_pages_explode(spark, d):
    path = land_pages(b.readings_text(spark, d), scratch_path(spark, "pages"))
    return read_pages(spark, path).drop(*ARRIVAL)


def q_pages_stream(spark, d):
    """Land pages, ingest them incrementally twice (the second run finds nothing new),
    read the table back."""
    landing = land_pages(b.readings_text(spark, d), scratch_path(spark, "landing"))
    out, ckpt = scratch_path(spark, "readings"), scratch_path(spark, "readings-ckpt")
    ingest_pages(spark, landing, out, ckpt)
    ingest_pages(spark, landing, out, ckpt)
    return spark.read.parquet(out).drop(*ARRIVAL)


def q_hour_month_mean(spark, d):
    wide = reshape.pivot_first(b.readings(spark, d), {**BASE, **FUEL})
    wide = wide.withColumns({"hr": F.hour("period"), "mo": F.month("period")})
    return reports.hour_month_mean(wide, ["signup", "click", "view"], keys=("respondent",))


def q_hour_month_grid(spark, d):
    wide = reshape.pivot_first(b.readings(spark, d), {**BASE, **FUEL})
    wide = wide.withColumns({"hr": F.hour("period"), "mo": F.month("period")})
    return reports.hour_month_grid(wide, "signup", keys=("respondent",))


def _eda(spark, d) -> dict[str, DataFrame]:
    return pipelines.eda_report(b.panel(spark, d), b.weather(spark, d), block_rows=block_rows(spark))


def q_eda_hour_month(spark, d):
    """Hour x month means of demand, wind and solar of the feature table (all 12 months)."""
    return _eda(spark, d)["hour_month"]


def q_eda_grid(spark, d):
    return _eda(spark, d)["grid_demand"]


def q_energy_csv_read(spark, d):
    """Energy hours written as CSV by region, read back with a schema, two regions only."""
    path = scratch_path(spark, "energy-csv")
    hours = b.panel(spark, d).select("region", *ENERGY_COLS)
    out = hours.withColumn("period", F.date_format("period", "yyyy-MM-dd HH:mm:ss"))
    out.write.option("header", True).partitionBy("region").csv(path)
    return read_energy_csv(spark, path, regions=FILTER_REGIONS)


def q_model_table_read(spark, d):
    path = write_if_absent(_stage(spark, d, "final"), scratch_path(spark, "model-table"))
    return read_model_table(spark, path, regions=FILTER_REGIONS)


def q_coords_read(spark, d):
    """A coordinate list with more columns, in another order, as CSV."""
    path = scratch_path(spark, "coords-csv")
    c = b.coords(spark, d)
    c.select(F.lit("x").alias("type"), "longitude_deg", "iata_code", F.lit(1).alias("id"), "latitude_deg").write.option("header", True).csv(path)
    return read_coords_csv(spark, path)


def q_site_tables_union(spark, d):
    """The scraped tables one by one, one without its ICAO column and one that is no site table."""
    rows = b.airport_rows(spark, d)
    tables = [rows.filter(F.col("table_no") == t) for t in range(5)]
    tables[1] = tables[1].drop("ICAO")
    return _lower(sites.union_tables([*tables, rows.select("table_no", "City")]))


def q_weather_read(spark, d):
    path = land_weather(b.weather(spark, d), scratch_path(spark, "weather"))
    return read_weather_text(spark, path)


def q_weather_write(spark, d):
    """Weather hours written once by region (twice: the second finds them all), read back."""
    path = scratch_path(spark, "weather-table")
    for _ in range(2):
        write_weather(b.weather(spark, d), path)
    return read_table(spark, path)


def q_weather_gaps(spark, d):
    """Days that are missing where the chunks of some months have not come."""
    path = land_weather(b.weather(spark, d).where(~F.month("datetime").isin([3, 4, 9])), scratch_path(spark, "weather"))
    return time_gaps(read_weather_text(spark, path), "1 day", end="2001-09-01")


# ---------------------------------------------------------------- sites
def _filled(spark, d) -> DataFrame:
    return sites.fill_states(b.airport_rows(spark, d))


def _cleaned(spark, d) -> DataFrame:
    return sites.clean_sites(_filled(spark, d))


def q_state_ffill(spark, d):
    return _lower(_filled(spark, d))


def q_text_clean(spark, d):
    return _lower(_cleaned(spark, d))


def q_airport_coords(spark, d):
    return _lower(sites.attach_coords(_cleaned(spark, d), b.coords(spark, d)))


def q_region_map(spark, d):
    m = sites.map_region(_cleaned(spark, d), b.region_map(spark, d))
    return _lower(m.select("table_no", "row_no", "IATA", "State", "Region"))


def q_region_filter(spark, d):
    m = sites.map_region(_cleaned(spark, d), b.region_map(spark, d))
    return _lower(m.filter(F.col("Region").isin(FILTER_REGIONS)).select("table_no", "row_no", "IATA", "State", "Region"))


def q_site_excluded(spark, d):
    """One code left out, sites without a code kept; some sites of the stand-in have that code."""
    code = F.when(F.col("row_no") % 7 == 3, F.lit(EXCLUDED_SITE)).otherwise(F.col("IATA"))
    rows = sites.exclude_code(_cleaned(spark, d).withColumn("IATA", code))
    return _lower(rows.select("table_no", "row_no", "IATA", "State", "Enplanements"))


def q_region_site(spark, d):
    return pipelines.build_region_sites(b.airport_rows(spark, d), b.coords(spark, d), b.region_map(spark, d))


# ---------------------------------------------------------------- model
def _model_report(spark, d) -> dict[str, DataFrame]:
    return pipelines.model_report(spark, _stage(spark, d, "final"), TEST_SPLIT, PARAM_GRID)


def q_gbt_cv(spark, d):
    """The cells of the cross-validation (27 sets, each fold), and whether each error is a number of 0 or more."""
    ok = (F.col("mae") >= 0) & (F.col("mae") < float("inf"))
    return _model_report(spark, d)["fold_scores"].select("region", "params", "param_order", "fold", ok.alias("ok"))


def q_gbt_predict(spark, d):
    """The rows that are predicted, and whether their region's model beats the mean on train rows."""
    report = _model_report(spark, d)
    fits = report["metrics"].filter(~F.col("is_test")).select("region", (F.col("r2") > 0).alias("beats_mean"))
    return report["predictions"].join(fits, "region").select("region", "period", "is_test", "y", "beats_mean")


def q_split_counts(spark, d):
    """By region: whether there are 1 to 15 features, all with splits, and all of the model."""
    of_region = _model_report(spark, d)["split_counts"].groupBy("region").agg(
        F.count("*").alias("n"), F.min("splits").alias("least"), F.count_if(~F.col("feature").isin(MODEL_FEATURES)).alias("strange")
    )
    return of_region.select("region", (F.col("n").between(1, 15) & (F.col("least") > 0) & (F.col("strange") == 0)).alias("ok"))


def q_gbt_cv_full(spark, d):
    """The error of every cell of the grid."""
    return _model_report(spark, d)["fold_scores"].select("region", "params", "param_order", "fold", "mae")


def q_gbt_predict_full(spark, d):
    """Actual and predicted values of the model that the grid chooses."""
    return _model_report(spark, d)["predictions"].select("region", "period", "is_test", "y", "y_hat")


def q_split_counts_full(spark, d):
    return _model_report(spark, d)["split_counts"].select("region", "feature", "splits", "cover")


def _short_model(spark, d) -> tuple[DataFrame, DataFrame]:
    """The split rows and the node table of SHORT_MODEL on the training rows: small enough for SQL to grow it, too."""
    rows = cut_lineage(_split_final(spark, d), "split", ["region"])
    blocks = model.training_blocks(rows.filter(~F.col("is_test")).withColumn("fold", F.lit(0)), MODEL_FEATURES, TARGET, block_rows=model_rows(spark))
    params = rows.select("region").distinct().withColumns({k: F.lit(v) for k, v in SHORT_MODEL.items()})
    return rows, cut_lineage(boosting.fit(blocks, ["region"], params, MODEL_FEATURES), "nodes", ["region"])


def q_gbt_nodes(spark, d):
    """Binning, histograms, cuts and leaves of two trees of every region."""
    told = ["gain", "value", "threshold", "base"]
    return _short_model(spark, d)[1].select("region", "tree", "node", "feature", "cover", *[r4(c).alias(c) for c in told])


def q_gbt_walk(spark, d):
    """Predictions of that model for train and test rows."""
    rows, nodes = _short_model(spark, d)
    out = boosting.predict(rows, nodes, MODEL_FEATURES, ["region"], ["period"], model_rows(spark))
    return out.select("region", "period", "is_test", F.col(TARGET).alias("y"), r4("y_hat").alias("y_hat"))


def q_gbt_importance(spark, d):
    """Gain shares, cuts and rows parted, of every region and feature."""
    nodes = _short_model(spark, d)[1]
    counts = boosting.split_counts(nodes, ["region"], None)
    out = boosting.gain_importance(nodes, MODEL_FEATURES, ["region"]).join(counts, ["region", "feature"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("region", "feature", r4("importance").alias("importance"), zero("splits"), zero("cover"))


def q_gbt_importance_rank(spark, d):
    """The ranking across regions, fed by the gains of that model."""
    gains = boosting.gain_importance(_short_model(spark, d)[1], MODEL_FEATURES, ["region"])
    out = metrics.importance_rank(gains)
    return out.select("rank", "feature", "region", *[r4(c).alias(c) for c in ("importance", "share", "mean_share")])


def q_sink_ignore(spark, d):
    """Write the model table once per region, write again (a no-op), read back."""
    path = scratch_path(spark, "final")
    final = _stage(spark, d, "final")
    write_if_absent(final, path)
    write_if_absent(final, path)
    return read_model_table(spark, path)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "energy_weather": q_energy_weather,
    "calendar_features": q_calendar_features,
    "share_features": q_share_features,
    "lag_features": q_lag_features,
    "dropna_any": q_dropna_any,
    "rolling_30d": q_rolling_30d,
    "feature_table": q_feature_table,
    "corr_matrix": q_corr_matrix,
    "scatter_extract": q_scatter_extract,
    "time_split": q_time_split,
    "expanding_folds": q_expanding_folds,
    "standardise": q_standardise,
    "scale_inverse": q_scale_inverse,
    "sequence_24": q_sequence_24,
    "error_metrics": q_error_metrics,
    "scaled_scores": q_scaled_scores,
    "best_params": q_best_params,
    "region_results": q_region_results,
    "importance_rank": q_importance_rank,
    "reading_parse": q_reading_parse,
    "reading_pivot": q_reading_pivot,
    "energy_outer": q_energy_outer,
    "energy_pages": q_energy_pages,
    "page_completeness": q_page_completeness,
    "page_gaps": q_page_gaps,
    "page_coverage": q_page_coverage,
    "eda_hour_month": q_eda_hour_month,
    "eda_grid": q_eda_grid,
    "energy_csv_read": q_energy_csv_read,
    "model_table_read": q_model_table_read,
    "coords_read": q_coords_read,
    "site_tables_union": q_site_tables_union,
    "pages_explode": q_pages_explode,
    "pages_stream": q_pages_stream,
    "hour_month_mean": q_hour_month_mean,
    "hour_month_grid": q_hour_month_grid,
    "weather_read": q_weather_read,
    "weather_write": q_weather_write,
    "weather_gaps": q_weather_gaps,
    "state_ffill": q_state_ffill,
    "text_clean": q_text_clean,
    "airport_coords": q_airport_coords,
    "region_map": q_region_map,
    "region_filter": q_region_filter,
    "region_site": q_region_site,
    "site_excluded": q_site_excluded,
    "gbt_cv": q_gbt_cv,
    "gbt_predict": q_gbt_predict,
    "split_counts": q_split_counts,
    "gbt_cv_full": q_gbt_cv_full,
    "gbt_predict_full": q_gbt_predict_full,
    "split_counts_full": q_split_counts_full,
    "gbt_nodes": q_gbt_nodes,
    "gbt_walk": q_gbt_walk,
    "gbt_importance": q_gbt_importance,
    "gbt_importance_rank": q_gbt_importance_rank,
    "sink_ignore": q_sink_ignore,
}
