"""Feature pipeline against a brute-force pandas rendering of the same rules."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd

from hourgrid.operators.features import calendar_features, lag_features, rolling_means, share_features
from hourgrid.plans.pipelines import build_features


def _energy_weather(spark, n=200, regions=("A", "B"), seed=1, gap_every=37):
    rnd = random.Random(seed)
    e, w = [], []
    t0 = datetime(2023, 12, 25)
    for reg in regions:
        h = 0
        for i in range(n):
            h += 2 if i % gap_every == 0 else 1  # gaps in hours
            t = t0 + timedelta(hours=h)
            dem = rnd.uniform(100, 200)
            ng = rnd.choice([0.0, None, rnd.uniform(50, 250)]) if i % 29 == 0 else rnd.uniform(50, 250)
            e.append((t, reg, reg, reg, dem, dem + rnd.uniform(-5, 5), ng, (ng or 0) - dem, rnd.choice([None, 3.0]), 2.0))
            w.append((t.year, t.month, t.day, t.hour, rnd.uniform(0, 900), rnd.uniform(-10, 30), rnd.uniform(0, 9), reg, t))
    rnd.shuffle(e)
    energy = spark.createDataFrame(
        e,
        "period timestamp_ntz, respondent string, respondent_name string, region string, demand double, "
        "da_forecast double, net_generation double, total_interchange double, solar double, wind double",
    )
    weather = spark.createDataFrame(
        w,
        "year int, mo int, dy int, hr int, allsky_sfc_sw_dwn double, t2m double, wsc double, region string, datetime timestamp_ntz",
    )
    return energy, weather


def _brute(energy, weather):
    e = energy.toPandas()
    w = weather.toPandas()
    out = []
    for reg, g in e.groupby("region"):
        m = g.merge(w[w.region == reg].drop(columns=["region"]), left_on="period", right_on="datetime").sort_values("period")
        m = m.reset_index(drop=True)
        m["solar"] = m["solar"].fillna(0.0)
        m["wind"] = m["wind"].fillna(0.0)
        ng = m["net_generation"].replace(0, np.nan)
        m["pct_solar"] = (m["solar"] / ng * 100).fillna(0)
        m["pct_wind"] = (m["wind"] / ng * 100).fillna(0)
        m["da_forecast_yesterday"] = m["da_forecast"].shift(24)
        m["unexpect_dem_diff"] = m["demand"] - m["da_forecast_yesterday"]
        m["lag_interchange_1h"] = m["total_interchange"].shift(1)
        m["lag_interchange_24h"] = m["total_interchange"].shift(24)
        m["net_generation_lag_1"] = m["net_generation"].shift(1)
        m["interchange_roll_mean_3h"] = m["total_interchange"].shift(1).rolling(3).mean()
        m = m.dropna().reset_index(drop=True)
        m["wsc_30d_avg"] = m["wsc"].rolling(720, min_periods=1).mean()
        m["demand_30d_avg"] = m["demand"].rolling(5, min_periods=1).mean()
        out.append(m)
    return pd.concat(out)


def test_pipeline_matches_brute_force(spark):
    energy, weather = _energy_weather(spark)
    spark_df = build_features(energy, weather, block_rows=17, stage="rolled").toPandas()
    exp = _brute(energy, weather)
    assert len(spark_df) == len(exp)
    m = exp.merge(spark_df, on=["region", "period"], suffixes=("_e", ""))
    assert len(m) == len(exp)
    for c in ["pct_solar", "da_forecast_yesterday", "unexpect_dem_diff", "lag_interchange_1h", "interchange_roll_mean_3h", "wsc_30d_avg"]:
        assert np.allclose(m[c].astype(float), m[f"{c}_e"].astype(float), rtol=1e-9, atol=1e-9), c


def test_rolling_window_param_and_blocks(spark):
    energy, weather = _energy_weather(spark, n=90, regions=("A",))
    d = build_features(energy, weather, stage="complete")
    got = rolling_means(d, ["demand"], window=5, block_rows=4).toPandas().sort_values("period")
    exp = _brute(energy, weather).sort_values("period")
    assert np.allclose(got["demand_30d_avg"].values, exp["demand_30d_avg"].values, rtol=1e-12)


def test_calendar_monday_zero_weekend(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 1, 6),), (datetime(2024, 12, 31),)], "period timestamp_ntz")
    r = calendar_features(df).orderBy("period").collect()
    assert [(x.day_of_week, x.is_weekend, x.day_of_year) for x in r] == [(0, 0, 1), (5, 1, 6), (1, 0, 366)]


def test_share_zero_and_missing(spark):
    df = spark.createDataFrame([(0.0, 5.0), (None, 5.0), (10.0, None), (20.0, 5.0)], "net_generation double, solar double")
    r = share_features(df).collect()
    assert [x.pct_solar for x in r] == [0.0, 0.0, 0.0, 25.0]
    assert [x.wind for x in r] == [0.0] * 4  # absent column -> 0


def test_short_series_gives_no_rows(spark):
    energy, weather = _energy_weather(spark, n=24, regions=("A",), gap_every=1000)
    assert build_features(energy, weather, stage="final").count() == 0
    energy, weather = _energy_weather(spark, n=25, regions=("A",), gap_every=1000)
    assert lag_features(build_features(energy, weather, stage="shares")).count() == 25
