"""Folds, scaling, sequences, metrics, best parameters, importance ranking, reports."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from hourgrid.operators.metrics import best_params, error_metrics, importance_rank
from hourgrid.operators.reports import corr_matrix, hour_month_mean
from hourgrid.operators.splits import apply_scaler, expanding_folds, sequences, standardise, time_split


def _series(spark, n, region="A", start=datetime(2023, 7, 1)):
    rows = [(region, start + timedelta(hours=i), float(i), float(i % 7), 3.0) for i in range(n)]
    return spark.createDataFrame(rows, "region string, period timestamp_ntz, y double, x double, c double")


@pytest.mark.parametrize("n,sizes", [(103, [23, 20, 20, 20, 20]), (10, [2, 2, 2, 2, 2]), (12, [4, 2, 2, 2, 2])])
def test_fold_sizes(spark, n, sizes):
    got = expanding_folds(_series(spark, n)).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in got] == sizes
    # validation folds follow training rows in time
    f = expanding_folds(_series(spark, n)).toPandas().sort_values("period")
    assert list(f["fold"]) == sorted(f["fold"])


def test_too_short_for_folds(spark):
    assert {r.fold for r in expanding_folds(_series(spark, 4)).collect()} == {None}


def test_standardise_train_only_and_inverse(spark):
    df = time_split(_series(spark, 50), "2023-07-02 12:00:00")
    scaled, scaler = standardise(df, ["x", "c"])
    pdf = df.toPandas()
    tr = pdf[~pdf.is_test]
    s = scaled.toPandas().sort_values("period")
    assert np.allclose(s["x"], (pdf.sort_values("period")["x"] - tr.x.mean()) / tr.x.std(ddof=0))
    assert (s["c"] == 0.0).all()  # constant column: scale 1
    back = apply_scaler(scaled, scaler, ["x", "c"], inverse=True).toPandas().sort_values("period")
    assert np.allclose(back["x"], pdf.sort_values("period")["x"])


def test_sequences_window_and_split(spark):
    df = time_split(_series(spark, 60), "2023-07-02 01:00:00")  # 25 train rows, 35 test rows
    seq = sequences(df, ["x", "y"], "y", window=24, block_rows=7).toPandas()
    counts = seq.groupby("is_test").size().to_dict()
    assert counts == {False: 1, True: 11}
    first = seq[~seq.is_test].iloc[0]
    assert len(first.seq) == 24 and first.seq[0][1] == 0.0 and first.seq[-1][1] == 23.0 and first.y == 24.0


def test_metrics_perfect_constant_and_mape(spark):
    df = spark.createDataFrame(
        [("p", 1.0, 1.0), ("p", 2.0, 2.0), ("c", 5.0, 5.0), ("c", 5.0, 6.0), ("z", 0.0, 1.0), ("z", 2.0, 3.0)],
        "region string, y double, y_hat double",
    )
    m = {r.region: r for r in error_metrics(df, ("region",)).collect()}
    assert (m["p"].rmse, m["p"].mae, m["p"].mape, m["p"].r2) == (0.0, 0.0, 0.0, 1.0)
    assert m["c"].r2 == 0.0
    assert m["z"].mape == 50.0  # the zero actual is left out


def test_best_params_tie_goes_to_first(spark):
    rows = [("A", "p1", 1, k, 2.0) for k in (1, 2)] + [("A", "p0", 0, k, v) for k, v in ((1, 1.0), (2, 3.0))]
    df = spark.createDataFrame(rows, "region string, params string, param_order int, fold int, mae double")
    r = best_params(df).collect()[0]
    assert (r.best_params, r.best_param_order, r.best_score) == ("p0", 0, 2.0)


def test_importance_rank(spark):
    rows = [("A", "f1", 0.5), ("B", "f1", 1.0), ("A", "f2", 0.2), ("A", "zero", 0.0), ("B", "zero", 0.0)]
    rows += [("A", f"g{i}", 0.01 * i) for i in range(12)]
    df = spark.createDataFrame(rows, "region string, feature string, importance double")
    out = importance_rank(df, top=10).toPandas()
    assert out.feature.nunique() == 10 and "zero" not in set(out.feature)
    top = out[out["rank"] == 1]
    assert set(top.feature) == {"f1"} and np.isclose(top.mean_share.iloc[0], 0.75)
    assert np.isclose(out[out.feature == "f2"].mean_share.iloc[0], 0.5)  # absent in B counts 0


def test_corr_constant_column_is_null(spark):
    df = spark.createDataFrame([("A", 1.0, 2.0, 5.0), ("A", 2.0, 4.1, 5.0), ("A", 3.0, 5.9, 5.0)], "region string, a double, b double, k double")
    got = {(r.feature_1, r.feature_2): r.corr for r in corr_matrix(df, ["a", "b", "k"]).collect()}
    assert got[("a", "k")] is None and got[("k", "k")] is None
    assert got[("a", "a")] == 1.0 and got[("a", "b")] == got[("b", "a")] and got[("a", "b")] > 0.99


def test_hour_month_mean(spark):
    df = spark.createDataFrame([("A", 1, 1, 2.0), ("A", 1, 1, None), ("A", 1, 1, 4.0), ("A", 2, 1, 1.0)], "region string, hr int, mo int, v double")
    got = {(r.hr, r.mo): r.avg_v for r in hour_month_mean(df, ["v"]).collect()}
    assert got == {(1, 1): 3.0, (2, 1): 1.0}
