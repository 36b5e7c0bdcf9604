"""Metrics, training, registry and serving."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from breezeway.operators import metrics
from breezeway.plans import registry as reg
from breezeway.plans import serving, training
from breezeway.plans.features import advanced_feature_names
from catalog import fixtures as fx

AT = datetime.datetime(2024, 2, 1, 12, 30)


@pytest.fixture(scope="module")
def readings(spark):
    return fx.readings(spark, "/root/testdata/sf0.01").filter("location in ('st0', 'st1')").cache()


def test_r2_of_constant_targets(spark):
    df = spark.createDataFrame([("exact", 2.0, 2.0), ("exact", 2.0, 2.0), ("off", 2.0, 2.5), ("off", 2.0, 2.0)],
                               "g string, y double, prediction double")
    out = {r["g"]: r["r2"] for r in metrics.error_metrics(df, by=["g"]).collect()}
    assert out == {"exact": 1.0, "off": 0.0}


def test_mape_skips_zero_and_may_be_empty(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 2.0, 1.0), ("b", 0.0, 1.0)], "g string, y double, prediction double")
    out = {r["g"]: r["mape"] for r in metrics.error_metrics(df, by=["g"], mape=True).collect()}
    assert out == {"a": 50.0, "b": 0.0}


def test_ties_go_to_the_first_candidate(spark):
    df = spark.createDataFrame([("x", 1, 0.5, 0.7), ("y", 0, 0.5, 0.7), ("z", 2, 0.9, 0.1)],
                               "model string, rank int, mae double, r2 double")
    assert metrics.best_by_mae(df, []).first()["model"] == "y"
    assert metrics.best_by_r2(df, []).first()["model"] == "y"


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x = np.c_[rng.normal(size=(200, 4)) * [1, 10, 0.1, 3], np.full(200, 5.0)]
    x = np.c_[x, x[:, 0] + x[:, 1]]  # collinear and constant columns
    y = x[:, :4] @ [1.0, -0.2, 3.0, 0.5] + rng.normal(size=200) + 2
    names = [f"x{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([tuple(map(float, r)) + (float(v),) for r, v in zip(x, y)], [*names, "y"])
    rows = training.assemble(df, names, "y")
    got = np.array([r[0] for r in training.ridge(rows, 1.0).fit(rows).transform(rows).select("prediction").collect()])
    centred = x - x.mean(axis=0)
    w = np.linalg.solve(centred.T @ centred + np.eye(x.shape[1]), centred.T @ (y - y.mean()))
    np.testing.assert_allclose(got, centred @ w + y.mean(), atol=1e-8)


def test_shuffled_split_is_stable_and_about_80_percent(readings):
    a = training.shuffled_split(readings.repartition(5)).filter("is_train")
    b = training.shuffled_split(readings).filter("is_train")
    assert a.select("seq").exceptAll(b.select("seq")).isEmpty()
    assert 0.75 < b.count() / readings.count() < 0.85


SMALL = {"Ridge": training.ridge, "Forest": lambda _: training.random_forest(5, 4)}


def test_train_save_load_and_forecast(spark, readings, tmp_path):
    models = training.train_adaptive(readings, ["24h"], SMALL)
    model = models["24h"]
    assert set(model.all_metrics) == {"Ridge", "Forest"}
    assert model.metrics["mae"] == min(m["mae"] for m in model.all_metrics.values())
    assert "aqi_lag_6h" in model.features and "seq" not in model.features
    root = str(tmp_path / "models")
    version = training.save_and_register(spark, model, root, f"{root}/registry", AT)
    assert version == "v20240201_1230"
    wanted = spark.createDataFrame([("aqi_forecast_24h", version), ("aqi_forecast_48h", "v0")], "model_name string, version string")
    registry = reg.read_registry(spark, f"{root}/registry")
    assert reg.production_models(registry).isEmpty()
    promoted = reg.promote(registry, wanted)
    row = reg.production_models(promoted).first()
    assert row["promoted_at"] is not None and row["feature_cols"] == model.features
    loaded = training.load_model(row)
    fresh = training.adaptive_frames(readings, ["24h"])[0].na.drop(subset=model.features)
    out = training.predict(loaded, fresh)
    assert out.filter("prediction < 1 or prediction > 5").isEmpty() and not out.isEmpty()


def test_nowcast_when_runs_are_short(spark, sf):
    """At the small scale no run reaches 12 rows: no lags, the current index is the target."""
    frame, features = training.adaptive_frames(fx.readings(spark, sf), ["24h", "48h"])
    assert not [c for c in features if "lag" in c]
    assert frame.filter("target_aqi_24h <> aqi or target_aqi_48h <> aqi").isEmpty()
    assert [r["model_type"] for r in frame.select("model_type").distinct().collect()] == ["Nowcasting"]


def test_horizon_without_rows_is_skipped(spark, readings):
    few = readings.filter("timestamp < '2024-01-03'")
    assert set(training.train_simple(few, ["24h", "72h"], {"Ridge": training.ridge})) <= {"24h"}


def test_tuned_trainer_and_serving(spark, readings):
    grid = training.tuned_candidates({"maxIter": [2, 3]}, {"numTrees": [2, 3]}, folds=2)
    models = training.train_tuned(readings, ["24h"], grid)
    assert models["24h"].features == advanced_feature_names()
    rows = serving.serving_rows(readings)
    assert rows.count() == 2
    out = serving.forecast(rows, {"24h": training.scorer_of(models["24h"].model)}).collect()
    assert len(out) == 2 and all(1 <= r["predicted_aqi"] <= 5 for r in out)
    assert len(training.BOOSTING_GRID) == 5 and np.prod([len(v) for v in training.BOOSTING_GRID.values()]) == 32


def test_full_trainer(readings):
    models = training.train_full(readings, ["24h"], {"Ridge": training.ridge})
    assert {"no2_o3_ratio", "wind_gust"} <= set(models["24h"].features)


def test_serving_needs_enough_rows(readings):
    first = readings.orderBy("timestamp").limit(60)
    n = {r["location"]: r["count"] for r in first.groupBy("location").count().collect()}
    served = {r["location"] for r in serving.serving_rows(first).collect()}
    assert served == {k for k, v in n.items() if v >= 50}


def registry_rows(spark):
    def row(name, version, stage, status, day, **m):
        return (name, version, stage, status, "t", "p", ["a"], m, {}, datetime.datetime(2024, 1, day), None, None)

    return spark.createDataFrame([
        row("m", "v1", "production", "active", 1, mae=0.5, r2=0.6),
        row("m", "v2", "staging", "active", 2, mae=0.4),
        row("m", "v3", "staging", "inactive", 3, mae=0.1, r2=0.9),
        row("n", "v1", "archived", "active", 1, mae=0.3, r2=0.2),
    ], reg.REGISTRY)


def test_promotion(spark):
    registry = registry_rows(spark)
    want = lambda *rows: spark.createDataFrame(list(rows), "model_name string, version string")
    stages = lambda df: {(r["model_name"], r["version"]): r["stage"] for r in df.collect()}
    after = stages(reg.promote(registry, want(("m", "v2"), ("n", "v9"))))
    assert after == {("m", "v1"): "archived", ("m", "v2"): "production", ("m", "v3"): "staging", ("n", "v1"): "archived"}
    assert stages(reg.promote(registry, want(("m", "v3")))) == stages(registry)
    found = {r["version"]: r["found"] for r in reg.promotion_result(registry, want(("m", "v2"), ("m", "v3"))).collect()}
    assert found == {"v2": True, "v3": False}


def test_compare_puts_missing_metrics_last(spark):
    registry = registry_rows(spark)
    order = lambda metric: [r["version"] for r in reg.compare_models(registry, metric, "m").orderBy("place").collect()]
    assert order("r2") == ["v1", "v2"]
    assert order("mae") == ["v2", "v1"]
    assert [r["version"] for r in reg.model_history(registry, "m").collect()] == ["v3", "v2", "v1"]
    assert [r["version"] for r in reg.list_models(registry, "m").collect()] == ["v2", "v1"]


def test_each_model_type_trains_on_its_own_entities(spark):
    rows = fx.readings(spark, "/root/testdata/sf0.01")
    scattered = rows.filter("location = 'st1'").withColumn("location", F.lit("scattered")).withColumn(
        "timestamp", F.expr("timestamp_seconds(unix_timestamp(timestamp) * 3)"))
    models = training.train_adaptive_by_type(rows.unionByName(scattered), ["24h"], {"Ridge": training.ridge})
    assert set(models) == {"Forecasting", "Nowcasting"}
    assert all(m["24h"].details["model_type"] == t for t, m in models.items())
