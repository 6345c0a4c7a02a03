"""Write-once commits, correlation with gaps, missing times, scaled scores, reports kept by region."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hourgrid.operators import metrics, reports, sinks, splits
from hourgrid.plans import pipelines
from hourgrid.sources.weather import time_gaps

SCHEMA = "region string, x int"


def rows_of(spark, path):
    return sorted(map(str, (tuple(r) for r in sinks.read_table(spark, path).select("region", "x").collect())))


def test_a_dying_writer_leaves_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    sinks.write_if_absent(spark.createDataFrame([("a", 1)], SCHEMA), path)
    more = spark.createDataFrame([("a", 9), ("b", 2), (None, 3)], SCHEMA)

    def die(*_):
        raise OSError("gone")

    monkeypatch.setattr(sinks, "_commit", die)
    with pytest.raises(OSError):
        sinks.write_if_absent(more, path)
    monkeypatch.undo()
    # its files are there, but not part of the table
    assert len(list((tmp_path / "t").glob("attempt=*"))) == 2
    assert rows_of(spark, path) == ["('a', 1)"] and [r.region for r in sinks.committed(spark, path).collect()] == ["a"]
    broken = spark.createDataFrame([("c", 1), ("c", 0)], SCHEMA).withColumn("x", F.when(F.col("x") == 0, F.raise_error(F.lit("bad row"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="bad row"):
        sinks.write_if_absent(broken, path)
    sinks.write_if_absent(more, path)
    assert rows_of(spark, path) == ["('a', 1)", "('b', 2)", "(None, 3)"]


def test_two_writers_leave_one_copy(spark, tmp_path, monkeypatch):
    """Both find the region absent and write it; the number of the commit decides."""
    path, real, late = str(tmp_path / "t"), sinks._commit, []

    def other_first(spark, path, attempt):
        if not late:
            late.append(attempt)
            sinks.write_if_absent(spark.createDataFrame([("a", 2), ("c", 5)], SCHEMA), path)
        real(spark, path, attempt)

    monkeypatch.setattr(sinks, "_commit", other_first)
    sinks.write_if_absent(spark.createDataFrame([("a", 1), ("b", 1), (None, 7)], SCHEMA), path)
    assert sorted(sinks.commits(spark, path).values()) == [0, 1]
    assert rows_of(spark, path) == ["('a', 2)", "('b', 1)", "('c', 5)", "(None, 7)"]
    assert rows_of(spark, path) == sorted(map(str, [("a", 2), ("b", 1), ("c", 5), (None, 7)]))
    assert sinks.read_table(spark, path, regions=["a"]).first().x == 2
    # a number that another writer holds is passed over
    lock = tmp_path / "t" / "_locks" / "00000002"
    lock.write_text("")
    sinks.write_if_absent(spark.createDataFrame([("d", 1)], SCHEMA), path)
    assert max(sinks.commits(spark, path).values()) == 3 and len(rows_of(spark, path)) == 5


def test_whole_table_once(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.read_table(spark, path)
    for x in (1, 2):
        sinks.write_if_absent(spark.createDataFrame([("a" * x, x)], SCHEMA), path, per_partition=False)
    assert rows_of(spark, path) == ["('a', 1)"]


@pytest.mark.parametrize("gaps", [0.0, 0.3])
def test_correlation_by_numpy(spark, gaps):
    r = random.Random(3)
    cols = ["p", "q", "flat", "w"]
    rows = []
    for k in ("a", "b", None):
        for i in range(60):
            x = 1e6 + r.random()
            v = [x, 2 * x + r.random(), 0.1, r.random()]
            rows.append((k, *[None if r.random() < gaps else y for y in v]))
    rows.append(("one", 1.0, 2.0, 3.0, None))
    df = spark.createDataFrame(rows, "region string, p double, q double, flat double, w double")
    got = {(x.region, x.feature_1, x.feature_2): x["corr"] for x in reports.corr_matrix(df, cols).collect()}
    assert len(got) == 4 * 16
    for k in ("a", "b", None):
        for i, f in enumerate(cols):
            for j, g in enumerate(cols):
                xy = [(x[i + 1], x[j + 1]) for x in rows if x[0] == k and x[i + 1] is not None and x[j + 1] is not None]
                want = None if "flat" in (f, g) else np.corrcoef(*zip(*xy))[0, 1]
                assert got[k, f, g] == (None if want is None else pytest.approx(want, abs=1e-9)), (k, f, g)
    assert all(v is None for k, v in got.items() if k[0] == "one")


def test_correlation_has_one_sum_a_pair(spark):
    df = spark.createDataFrame([("a", *[float(i * j) for j in range(12)]) for i in range(5)], "region string, " + ", ".join(f"c{j} double" for j in range(12)))
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = reports.corr_matrix(df, [f"c{j}" for j in range(12)])._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    partial = next(x for x in plan.splitlines() if "partial_sum" in x)
    assert partial.count("partial_") == 12 + 66 and "covar" not in plan and "stddev" not in plan


def test_time_gaps(spark):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    hours = {"a": [0, 1, 2, 6, 6, 7, 20], "b": list(range(24)), "c": [3]}
    df = spark.createDataFrame([(k, t(h)) for k, v in hours.items() for h in v] + [("a", None)], "region string, datetime timestamp_ntz")
    for block in (1_000_000, 2):
        got = sorted(map(tuple, time_gaps(df, block_rows=block).collect()))
        assert got == [("a", t(3), t(6), 3), ("a", t(8), t(20), 12)]
        ends = {tuple(r) for r in time_gaps(df, start="2024-01-01 00:00:00", end="2024-01-02 00:00:00", block_rows=block).collect()} - set(got)
        assert ends == {("a", t(21), t(24), 3), ("c", t(0), t(3), 3), ("c", t(4), t(24), 20)}


def test_scores_in_original_units(spark):
    rows = [("a", float(i), float(i) * 1.1, i > 7) for i in range(10)] + [("b", 100.0 * i, 90.0 * i, False) for i in range(4)]
    df = spark.createDataFrame(rows, "region string, y double, y_hat double, is_test boolean")
    scaler = splits.fit_scaler(df.withColumnRenamed("y", "t"), ["t"])
    s = {r.region: (r["t__mean"], r["t__scale"]) for r in scaler.collect()}
    scaled = spark.createDataFrame([(k, (y - s[k][0]) / s[k][1], (h - s[k][0]) / s[k][1], x) for k, y, h, x in rows], df.schema)
    got = {r.region: r for r in metrics.error_metrics(splits.original_units(scaled, scaler, "t"), ("region",)).collect()}
    want = {r.region: r for r in metrics.error_metrics(df, ("region",)).collect()}
    for k in "ab":
        assert got[k].rmse == pytest.approx(want[k].rmse) and got[k].mae == pytest.approx(want[k].mae)


def test_sequence_runs_store_steps_once(spark):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(k, False, t(i), float(i), float(-i), 10.0 * i) for k, n in (("a", 500), ("b", 24), ("c", 25)) for i in range(n)]
    df = spark.createDataFrame(rows, "region string, is_test boolean, period timestamp_ntz, f double, g double, y double")
    runs = splits.sequence_runs(df, ["f", "g"], "y", run_rows=100)
    assert runs.agg(F.sum(F.size("steps"))).first()[0] <= (500 + 25) + 24 * 6
    for run_rows, block in ((100, 10**6), (7, 10**6), (10**6, 60)):
        runs = splits.sequence_runs(df, ["f", "g"], "y", run_rows=run_rows, block_rows=block)
        assert runs.agg(F.max(F.size("steps"))).first()[0] <= min(run_rows, block) + 24
        got = {(r.region, r.period): (r.seq, r.y) for r in splits.sequence_rows(runs).collect()}
        want = {(k, t(i)): ([[float(j), float(-j)] for j in range(i - 24, i)], 10.0 * i) for k, n in (("a", 500), ("c", 25)) for i in range(24, n)}
        assert got == want


def test_reports_are_kept_by_region(spark, tmp_path, monkeypatch):
    r, t = random.Random(1), dt.datetime(2024, 1, 1)
    rows = [(k, t + dt.timedelta(hours=i), r.random(), r.random(), r.random()) for k in ("a", "b") for i in range(40)]
    final = spark.createDataFrame(rows, "region string, period timestamp_ntz, x double, z double, y double")
    grid = {"n_estimators": [2], "max_depth": [2], "learning_rate": [0.3]}
    calls, real = [], pipelines.model_report

    def counted(spark, final, *a, **k):
        calls.append(sorted(x[0] for x in final.select("region").distinct().collect()))
        return real(spark, final, *a, **k)

    monkeypatch.setattr(pipelines, "model_report", counted)
    run = lambda df: pipelines.write_model_report(spark, df, "2024-01-02", str(tmp_path / "r"), grid, features=["x", "z"], target="y")
    first = run(final.where("region = 'a'"))["predictions"].collect()
    out = run(final)
    assert calls == [["a"], ["b"]] and out["predictions"].count() == 80
    assert sorted(map(str, out["predictions"].where("region = 'a'").collect())) == sorted(map(str, first))
    assert {x.region for x in out["results"].collect()} == {"a", "b"} and out["results"].first().best_params["max_depth"] == 2.0
    assert {x.region for x in out["importance_rank"].collect()} == {"a", "b"}
    run(final)
    assert len(calls) == 2


def test_report_plans_do_not_grow_with_the_regions(spark):
    t = dt.datetime(2024, 1, 1)
    grid = {"n_estimators": [1], "max_depth": [1], "learning_rate": [0.3]}
    sizes = []
    for n in (2, 7):
        rows = [(f"r{k}", t + dt.timedelta(hours=i), float(i % 5), float(i % 7)) for k in range(n) for i in range(30)]
        report = pipelines.model_report(spark, spark.createDataFrame(rows, "region string, period timestamp_ntz, x double, y double"), "2024-01-02", grid, features=["x"], target="y")
        sizes.append({k: v._jdf.queryExecution().executedPlan().toString().count("\n") for k, v in report.items()})
        assert report["results"].count() == n
    assert sizes[0] == sizes[1]
