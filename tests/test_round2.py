"""Payloads as the service sends them, losses that must not be silent, pruning, staging."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from hourgrid import session
from hourgrid.operators import metrics, reports, reshape, sinks
from hourgrid.operators.ordered import row_index
from hourgrid.plans import pipelines as P
from hourgrid.plans.catalog import QUERIES
from hourgrid.sources import pages
from hourgrid.sources.bindings import panel, weather
from hourgrid.sources.tables import read_model_table
from hourgrid.sources.weather import land_weather, read_weather_text

SF = "/root/testdata/sf0.001"
HOURS = 60


def _page(region, types, value, total=None):
    rows = [
        {"period": f"2024-01-{1 + h // 24:02d}T{h % 24:02d}", "respondent": region, "respondent-name": f"Region {region}", "type-name": t, "value": str(value(h, t)), "value-units": "megawatthours"}
        for h in range(HOURS)
        for t in types
    ]
    return {"response": {"total": str(total or len(rows)), "data": rows}}


@pytest.fixture(scope="module")
def landed(tmp_path_factory):
    d = tmp_path_factory.mktemp("landed")
    for i, r in enumerate(("NY", "007")):
        for feed, types in (("base", ["Demand", "Day-ahead demand forecast", "Net generation", "Total interchange"]), ("fuel", ["Solar", "Wind"])):
            (d / feed).mkdir(exist_ok=True)
            text = json.dumps(_page(r, types, lambda h, t: 100 + h * 7 % 13 + len(t)), indent=4 if i else None)
            (d / feed / f"{r}.json").write_text(text)
        (d / "weather").mkdir(exist_ok=True)
        lines = ["-BEGIN HEADER-", *["meta"] * (3 + i), "-END HEADER-", "YEAR,MO,DY,HR,ALLSKY_SFC_SW_DWN,T2M,WSC"]
        lines += [f"2024,1,{1 + h // 24},{h % 24},{h / 10},{-999 if h == 0 else h},3.5" for h in range(HOURS)]
        (d / "weather" / f"weather_power_{r}.csv").write_text("\n".join(lines) + "\n")
    return d


def test_pages_to_features(spark, landed):
    """README quick start on landed files: names of the wire, no ordinal, one document a file."""
    energy = P.build_energy_hours(pages.read_pages(spark, f"{landed}/base"), pages.read_pages(spark, f"{landed}/fuel"), complete=True)
    assert energy.count() == 2 * HOURS and energy.where("demand IS NULL OR wind IS NULL").isEmpty()
    hours = P.build_weather_hours(spark, f"{landed}/weather")
    assert {r[0] for r in hours.select("region").distinct().collect()} == {"NY", "007"}
    final = P.build_features(energy, hours, keys=["region"])
    assert len(final.columns) == 38 and final.count() == 2 * (HOURS - 24)
    assert P.build_features(energy, hours, keys=["region"], regions=["007"]).count() == HOURS - 24
    report = P.eda_report(energy, hours, regions=["NY"])
    assert report["hour_month"].count() == 24 and report["corr"].count() == 144 and report["grid_wind"].count() == 24


def test_corrupt_or_missing_pages_raise(spark, landed, tmp_path):
    (tmp_path / "a.json").write_text('{"response": {"total": "1", "data": [')
    (tmp_path / "b.json").write_text('{"error": "busy"}')
    assert pages.corrupt_pages(spark, str(tmp_path)).count() == 2
    with pytest.raises(Exception, match="cannot be read"):
        pages.read_pages(spark, str(tmp_path)).collect()
    few = tmp_path / "few"
    few.mkdir()
    (few / "x.json").write_text(json.dumps(_page("NY", ["Demand"], lambda h, t: 1, total=1000)))
    with pytest.raises(ValueError, match="NY: 60 of 1000"):
        pages.require_complete(pages.read_pages(spark, str(few)))
    both = tmp_path / "lines"
    both.mkdir()
    (both / "x.json").write_text("\n".join(json.dumps(_page(r, ["Demand"], lambda h, t: 1)) for r in "AB"))
    assert pages.read_pages(spark, str(both)).count() == pages.read_pages(spark, str(both), layout="lines").count() == 2 * HOURS


def test_null_order_and_ordinal(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t), ("a", None), (None, t)], "region string, period timestamp_ntz")
    for bad in (df.where("region IS NOT NULL"), df.where("period IS NOT NULL")):
        with pytest.raises(Exception, match="cannot be numbered"):
            row_index(bad, ["region"], "period").collect()
    long = spark.createDataFrame([(t, "a", "A", "Wind", 3.0, None), (t, "a", "A", "Solar", 4.0, None), (t, "a", "A", "Solar", 5.0, 9)], "period timestamp_ntz, respondent string, respondent_name string, type_name string, value double, ordinal long")
    got = reshape.pivot_first(long, {"Wind": "wind", "Solar": "solar"}).first()
    assert (got.wind, got.solar) == (3.0, 5.0)


def test_large_values_have_a_mean(spark):
    df = spark.createDataFrame([("a", 1, 1, 1e10), ("a", 1, 1, 3e10)], "region string, hr int, mo int, x double")
    assert reports.hour_month_mean(df, ["x"]).first().avg_x == 2e10


def test_metrics_leave_out_missing_predictions(spark):
    df = spark.createDataFrame([("a", 2.0, 2.5), ("a", 3.0, 2.5), ("a", 100.0, None), ("a", None, 1.0)], "region string, y double, y_hat double")
    r = metrics.error_metrics(df, ("region",)).first()
    assert (r.n, r.rmse, r.r2) == (2, 0.5, 0.0)


def test_correlation_is_pairwise(spark):
    rows = [("a", float(i), 2.0 * i if i < 5 else None) for i in range(100)] + [("a", 1e6, None)]
    df = spark.createDataFrame(rows, "region string, x double, z double")
    got = {(r.feature_1, r.feature_2): r["corr"] for r in reports.corr_matrix(df, ["x", "z"]).collect()}
    assert abs(got["x", "z"] - 1.0) < 1e-12 and abs(got["z", "x"] - 1.0) < 1e-12


def test_importance_has_every_cell(spark):
    imp = spark.createDataFrame([("a", "f", 1.0), ("b", "g", 0.5)], "region string, feature string, importance double")
    got = {(r.feature, r.region): (r.importance, r.mean_share) for r in metrics.importance_rank(imp).collect()}
    assert got == {("f", "a"): (1.0, 0.5), ("f", "b"): (0.0, 0.5), ("g", "a"): (0.0, 0.5), ("g", "b"): (0.5, 0.5)}


def test_write_once_with_null_and_code_regions(spark, tmp_path):
    df = spark.createDataFrame([("007", 1), (None, 2), ("NY", 3)], "region string, x int")
    path = str(tmp_path / "t")
    for _ in range(3):
        sinks.write_if_absent(df, path)
    assert sorted(map(tuple, read_model_table(spark, path).collect()), key=str) == sorted([(1, "007"), (2, None), (3, "NY")], key=str)
    only = read_model_table(spark, path, regions=["007"])
    assert only.count() == 1 and "PartitionFilters: [" in only._jdf.queryExecution().executedPlan().toString()


def test_weather_names(spark, tmp_path):
    (tmp_path / "odd.csv").write_text("2024,1,1,0,1,2,3\n")
    with pytest.raises(Exception, match="no region in the file name"):
        read_weather_text(spark, str(tmp_path)).collect()
    assert read_weather_text(spark, str(tmp_path), region="X").first().region == "X"
    path = land_weather(weather(spark, SF).withColumn("region", F.lit("007")), str(tmp_path / "by"))
    assert read_weather_text(spark, path, regions=["007"]).first().region == "007"


def test_sites_without_enplanements(spark):
    tables = [spark.createDataFrame([(i, 0, "NEW YORK", None, None), (i, 1, f"c{i}[1]", "a", f"X{i}")], "table_no int, row_no int, City string, Airport string, IATA string") for i in range(2)]
    tables.append(spark.createDataFrame([(9,)], "other int"))
    coords = spark.createDataFrame([("x0", 1.0, 2.0)], "iata_code string, latitude_deg double, longitude_deg double")
    got = P.build_region_sites(tables, coords).first()
    assert (got.region, got.iata, got.latitude_deg, got.city) == ("NY", "X0", 1.0, "c0")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_region_filter_reaches_the_files(spark):
    plan = _plan(QUERIES["feature_table"](spark, SF).where(F.col("region") == "ASIA"))
    scans = [x for x in plan.splitlines() if "FileScan" in x]
    assert scans and all("region" in x.partition("PartitionFilters: ")[2].partition("]")[0] for x in scans)
    assert plan.count("Exchange hash") <= 4
    assert _plan(QUERIES["expanding_folds"](spark, SF)).count("Exchange hash") <= 5


@pytest.mark.parametrize("name", ["best_params", "region_results"])
def test_raw_table_is_not_scanned_again(spark, name):
    assert "lineitem.parquet" not in _plan(QUERIES[name](spark, SF))  # it was read for a staged table


def test_small_blocks_give_the_same(spark):
    names = ["feature_table", "expanding_folds"]
    want = {n: sorted(map(str, QUERIES[n](spark, SF).collect())) for n in names}
    spark.conf.set("hourgrid.window.blockRows", "97")
    try:
        assert all(sorted(map(str, QUERIES[n](spark, SF).collect())) == want[n] for n in names)
    finally:
        spark.conf.unset("hourgrid.window.blockRows")


def test_stages_are_removed(spark):
    with session.stages(spark):
        final = P.build_features(panel(spark, SF), weather(spark, SF))
        path = [p for run in session._OPEN for p in run]
        assert path and final.count() > 0 and all(sinks.path_exists(spark, p) for p in path)
    assert not any(sinks.path_exists(spark, p) for p in path)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *_):
            return None

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())


def test_full_grid_is_registered(spark, monkeypatch):
    import __spark_entry__ as ent
    from hourgrid import schemas
    from hourgrid.operators.model import param_sets
    from hourgrid.plans import catalog

    def report(spark, final, split, grid):
        rows = [("A", str(p), i, k, 0.5 + i) for i, p in enumerate(param_sets(grid)) for k in (1, 2, 3, 4)]
        return {
            "fold_scores": spark.createDataFrame(rows, "region string, params string, param_order int, fold int, mae double"),
            "predictions": spark.createDataFrame([("A", 1, True, 2.0, len(rows) / 4, 0)], "region string, period int, is_test boolean, y double, y_hat double, x int"),
            "split_counts": spark.createDataFrame([("A", "z", len(rows), 7)], "region string, feature string, splits int, cover long"),
        }

    monkeypatch.setattr(catalog.pipelines, "model_report", report)
    monkeypatch.setattr(catalog, "_stage", lambda *a: None)
    names = ent.queries()
    rows = names["gbt_cv_full"](spark, "").collect()
    assert len(rows) == 4 * 27 == 4 * len(param_sets(schemas.PARAM_GRID)) and {r.mae for r in rows} == {0.5 + i for i in range(27)}
    assert names["gbt_cv"](spark, "").count() == 4 * 27
    assert names["gbt_predict_full"](spark, "").first().y_hat == 27.0
    assert names["split_counts_full"](spark, "").first().splits == 108
