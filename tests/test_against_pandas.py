"""Window features against pandas, entity by entity."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from breezeway.operators import eda, quality
from breezeway.plans import features
from tests.helpers import random_readings


@pytest.fixture(scope="module")
def data(spark):
    df = random_readings(spark, rows=300, seed=3).filter("location is not null").cache()
    pdf = df.toPandas().sort_values(["location", "timestamp", "seq"], kind="stable").reset_index(drop=True)
    return df, pdf


def in_order(df):
    return df.toPandas().sort_values(["location", "timestamp", "seq"], kind="stable").reset_index(drop=True)


def by_station(pdf, f):
    return pd.concat([f(g) for _, g in pdf.groupby("location")]).sort_index()


def same(got, want):
    np.testing.assert_allclose(got.astype(float), want.astype(float), rtol=0, atol=1e-9, equal_nan=True)


def test_advanced_features(data):
    df, pdf = data
    out = in_order(features.advanced_features(df))
    for n in (1, 2, 3, 6, 12, 24, 48):
        same(out[f"pm10_lag_{n}h"], by_station(pdf, lambda g: g["pm10"].shift(n)))
    for n in (3, 6, 12, 24, 48):
        roll = lambda g, c: g[c].rolling(n, min_periods=1)
        same(out[f"pm2_5_rolling_mean_{n}h"], by_station(pdf, lambda g: roll(g, "pm2_5").mean()))
        same(out[f"aqi_rolling_std_{n}h"], by_station(pdf, lambda g: roll(g, "aqi").std()))
        same(out[f"pm2_5_rolling_min_{n}h"], by_station(pdf, lambda g: roll(g, "pm2_5").min()))
    same(out["pm2_5_change_3h"], by_station(pdf, lambda g: g["pm2_5"].diff(3)))
    same(out["wind_change"], by_station(pdf, lambda g: g["wind_speed"].diff(1)))
    same(out["pm2_5_pm10_ratio"], pdf["pm2_5"] / (pdf["pm10"] + 1))
    same(out["dow_sin"], np.sin(2 * np.pi * pdf["timestamp"].dt.dayofweek / 7))
    assert len(features.advanced_feature_names()) == 82
    assert set(features.advanced_feature_names()) <= set(out.columns)


def test_full_features(data):
    df, pdf = data
    out = in_order(features.full_features(df, ["24h"]))
    same(out["pm2_5_rolling_24h_std"],
         by_station(pdf, lambda g: g["pm2_5"].rolling(24, min_periods=1).std().fillna(0)))
    same(out["aqi_24h_ahead"], by_station(pdf, lambda g: g["aqi"].shift(-24)))
    same(out["no2_o3_ratio"], pdf["no2"].astype(float) / (pdf["o3"].astype(float) + 1e-6))
    assert len(out.columns) - len(df.columns) == 32 + 1


def test_full_features_skip_blocks_without_inputs(data):
    df, _ = data
    out = features.full_features(df.select("seq", "location", "timestamp", "pm10", "temperature"), ["24h"])
    assert "pm10_lag_1h" in out.columns and "pm2_5_lag_1h" not in out.columns
    assert "temp_humidity_interaction" not in out.columns and "aqi_24h_ahead" not in out.columns


def test_simple_features_drop_incomplete_rows(data):
    df, pdf = data
    out = in_order(features.simple_features(df, 24))

    def want(g):
        g = g.copy()
        for n in (1, 3, 6):
            for c in ("aqi", "pm2_5"):
                g[f"{c}_lag_{n}h"] = g[c].shift(n)
        for n in (3, 6):
            for c in ("aqi", "pm2_5"):
                g[f"{c}_rolling_mean_{n}h"] = g[c].rolling(n).mean()
        g["target_aqi_24h"] = g["aqi"].shift(-24)
        return g.dropna()

    expected = by_station(pdf, want).reset_index(drop=True)
    assert list(out["seq"]) == list(expected["seq"])
    same(out["aqi_rolling_mean_6h"], expected["aqi_rolling_mean_6h"])


def test_quality_of_short_runs(spark):
    """Runs of 11, 12, 23 and 24 rows decide what is allowed; gaps of exactly 90 minutes join."""
    rows = []
    for station, n in {"a": 11, "b": 12, "c": 23, "d": 24}.items():
        rows += [(station, i, i * 5400) for i in range(n)]
        rows += [(station, 100, 10**7)]
    df = spark.createDataFrame(rows, "location string, seq long, t long").withColumn(
        "timestamp", F.timestamp_seconds("t"))
    out = {r["location"]: r for r in quality.data_quality(df).collect()}
    assert [(out[k]["max_consecutive"], out[k]["can_use_lags"], out[k]["can_forecast"]) for k in "abcd"] == [
        (11, False, False), (12, True, False), (23, True, False), (24, True, True)]
    assert out["a"]["total_records"] == 12


def test_histogram_and_box_plot(data):
    df, pdf = data
    counts, edges = np.histogram(pdf["pm2_5"], bins=50)
    out = eda.histogram(df, "pm2_5").toPandas().sort_values("bin")
    assert list(out["n"]) == list(counts)
    np.testing.assert_allclose(out["low"], edges[:-1])
    flat = eda.histogram(df.withColumn("k", F.lit(2.0)), "k").toPandas().sort_values("bin")
    assert list(flat["n"]) == list(np.histogram(np.full(len(pdf), 2.0), bins=50)[0])
    box = eda.box_plot(df, "pm2_5").first()
    np.testing.assert_allclose([box["q1"], box["median"], box["q3"]], pdf["pm2_5"].quantile([0.25, 0.5, 0.75]))


def test_correlation_and_trend(data):
    df, pdf = data
    numeric = pdf.drop(columns=["location", "timestamp"]).astype(float)
    want = numeric.corr()["aqi"]
    got = {r["column"]: r["r"] for r in eda.correlation_with(df).collect()}
    for c in want.index:
        assert got[c] == pytest.approx(want[c], abs=1e-9)
    constant = eda.correlation_with(df.withColumn("k", F.lit(1.0)), columns=["k"]).first()
    assert constant["r"] is None
    known = numeric.dropna(subset=["no2"])
    slope, intercept = np.polyfit(known["no2"], known["aqi"], 1)
    line = {r["pollutant"]: r for r in eda.trend_lines(df).collect()}["no2"]
    assert (line["slope"], line["intercept"]) == (pytest.approx(slope), pytest.approx(intercept))


def test_describe(data):
    df, pdf = data
    got = {r["column"]: r for r in eda.describe(df, ["pm2_5", "no2"]).collect()}
    for c in ("pm2_5", "no2"):
        want = pdf[c].astype(float).describe()
        row = got[c]
        np.testing.assert_allclose(
            [row["count"], row["mean"], row["std"], row["min"], row["q25"], row["q50"], row["q75"], row["max"]], want)
