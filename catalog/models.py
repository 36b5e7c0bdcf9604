"""Splits, metrics, training, forecasts and the model registry."""

from __future__ import annotations

import datetime
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from breezeway.operators import metrics
from breezeway.operators.quality import data_quality
from breezeway.operators.windows import with_split
from breezeway.plans import registry as reg
from breezeway.plans import serving, training, tuning
from breezeway.plans.features import advanced_feature_names, advanced_features
from breezeway.session import materialise, scratch_path
from breezeway.operators.shape import drop_missing, fill_missing
from catalog import fixtures as fx
from catalog import query, r
from catalog.quality import RUN_ROWS
from catalog.windows import S, SPLIT_SQL


@query("a32_error_metrics", f"""WITH $predictions, m AS (SELECT model, avg(y) AS ybar FROM predictions GROUP BY model)
SELECT p.model, count(*) AS n, {r('avg(abs(y - prediction))')} AS mae, {r('sqrt(avg((y - prediction) ** 2))')} AS rmse,
       {r('1 - sum((y - prediction) ** 2) / sum((y - ybar) ** 2)')} AS r2
FROM predictions p JOIN m ON p.model = m.model GROUP BY p.model""")
def _(spark, sf):
    out = metrics.error_metrics(fx.predictions(spark, sf), by=["model"])
    return out.withColumns({c: F.round(c, 6) for c in ("mae", "rmse", "r2")})


# Groups of one day and station: some have a constant target, where R2 is 1 or 0.
@query("a32_error_metrics_of_small_groups", f"""WITH $predictions, d AS (
  SELECT p.model, seq // 40 AS cell, y, prediction FROM predictions p),
g AS (SELECT *, avg(y) OVER (PARTITION BY model, cell) AS ybar FROM d)
SELECT model, cell, count(*) AS n, {r('avg(abs(y - prediction))')} AS mae, {r('sqrt(avg((y - prediction) ** 2))')} AS rmse,
       CASE WHEN min(y) = max(y) THEN CASE WHEN sum((y - prediction) ** 2) = 0 THEN 1e0 ELSE 0e0 END
            ELSE {r('1 - sum((y - prediction) ** 2) / sum((y - ybar) ** 2)')} END AS r2
FROM g GROUP BY model, cell""")
def _(spark, sf):
    df = fx.predictions(spark, sf).withColumn("cell", F.floor(F.col("seq") / 40).cast("long"))
    out = metrics.error_metrics(df, by=["model", "cell"])
    return out.withColumns({c: F.round(c, 6) for c in ("mae", "rmse", "r2")})


@query("a33_mape", f"""WITH $predictions SELECT model,
  {r('coalesce(avg(CASE WHEN y - 3 <> 0 THEN abs((y - 3 - prediction) / (y - 3)) END) * 100, 0)')} AS mape
FROM predictions GROUP BY model""")
def _(spark, sf):
    df = fx.predictions(spark, sf).withColumn("y", F.col("y") - 3)
    return metrics.error_metrics(df, by=["model"], mape=True).select("model", F.round("mape", 6).alias("mape"))


METRICS_BY_STATION = """scores AS (
  SELECT p.location, p.model, min(rank) AS rank, round(avg(abs(y - prediction)), 9) AS mae,
         round(1 - sum((y - prediction) ** 2) / sum((y - ybar) ** 2), 9) AS r2
  FROM predictions p JOIN (SELECT location, avg(y) AS ybar FROM readings_y GROUP BY location) m ON p.location = m.location
  GROUP BY p.location, p.model)"""
SCORES_SQL = "WITH $predictions, readings_y AS (SELECT location, y FROM predictions WHERE model = 'a'), " + METRICS_BY_STATION


def scores(spark, sf):
    out = metrics.error_metrics(fx.predictions(spark, sf), by=["location", "model", "rank"])
    return out.withColumns({c: F.round(c, 9) for c in ("mae", "r2")})


@query("a34_mean_r2", SCORES_SQL + f" SELECT model, {r('avg(r2)')} AS mean_r2, avg(r2) > 0.65 AS passed FROM scores GROUP BY model")
def _(spark, sf):
    return metrics.mean_r2(scores(spark, sf), ["model"]).withColumn("mean_r2", F.round("mean_r2", 6))


@query("m11_best_by_mae", SCORES_SQL + f""" SELECT location, arg_min(model, mae * 1000 + rank * 1e-6) AS model,
  {r('min(mae)')} AS mae FROM scores GROUP BY location""")
def _(spark, sf):
    return metrics.best_by_mae(scores(spark, sf), ["location"]).withColumn("mae", F.round("mae", 6))


@query("m12_best_by_r2", SCORES_SQL + f""" SELECT location, arg_max(model, r2 * 1000 - rank * 1e-6) AS model,
  {r('max(r2)')} AS r2 FROM scores GROUP BY location""")
def _(spark, sf):
    return metrics.best_by_r2(scores(spark, sf), ["location"]).withColumn("r2", F.round("r2", 6))


@query("m01_time_split", f"""WITH $readings, {SPLIT_SQL} SELECT location, k <= floor(n * 0.8e0) AS is_train,
  count(*) AS n, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM ranked GROUP BY ALL""")
def _(spark, sf):
    return with_split(fx.readings(spark, sf), S).groupBy("location", "is_train").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


@query("m02_shuffled_split", """WITH $readings SELECT seq, location,
  row_number() OVER (ORDER BY md5('42:' || seq)) <= (SELECT count(*) * 4 // 5 FROM readings) AS is_train FROM readings""")
def _(spark, sf):
    return training.shuffled_split(fx.readings(spark, sf).select("seq", "location"))


HORIZONS = ["24h", "48h", "72h"]


def training_rows(spark, sf, horizons=("24h",)):
    """For each horizon: advanced features as a vector, the target and the time split. Features are made once."""
    features = advanced_feature_names()
    hours = {f"target_aqi_{h}": int(h[:-1]) for h in horizons}
    frame = materialise(advanced_features(fx.readings(spark, sf), S, hours), "features")
    out = {}
    for h, target in zip(horizons, hours):
        clean = fill_missing(drop_missing(frame, [target]), features)
        rows = with_split(clean, S).select("seq", "location", "is_train", *features, target)
        out[h] = materialise(training.assemble(rows, features, target), "training")
    return out


def fit_and_predict(spark, sf, build):
    """Fit on the training rows of each horizon and predict its test rows; horizons are fitted at once."""
    frames = training_rows(spark, sf, HORIZONS)

    def one(h):
        train = frames[h].filter("is_train")
        model = build(train).fit(train)
        return training.predict(model, frames[h].filter("not is_train")).select(
            F.lit(h).alias("horizon"), "seq", "location", "label", "prediction")

    with ThreadPoolExecutor(len(HORIZONS)) as pool:
        parts = list(pool.map(one, HORIZONS))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("m03_random_forest")
def _(spark, sf):
    return fit_and_predict(spark, sf, lambda _: training.random_forest(100, 10))


@query("m04_gradient_boosting")
def _(spark, sf):
    return fit_and_predict(spark, sf, lambda _: training.gradient_boosting(50, 5))


@query("m05_ridge")
def _(spark, sf):
    return fit_and_predict(spark, sf, training.ridge)


@query("m06_deep_boosting")
def _(spark, sf):
    return fit_and_predict(spark, sf, lambda _: training.deep_boosting())


@query("m07_feature_vectors")
def _(spark, sf):
    from pyspark.ml.functions import vector_to_array

    frames = training_rows(spark, sf, HORIZONS)
    parts = [frames[h].select(F.lit(h).alias("horizon"), "seq", "location", "label", vector_to_array("features").alias("features"))
             for h in HORIZONS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def searched(spark, sf, search):
    """Mean R2 of every grid point."""
    model = search.fit(training_rows(spark, sf)["24h"].filter("is_train"))
    points = [(", ".join(f"{k}={v}" for k, v in sorted(s.point.items())), float(s.mean), len(s.by_fold)) for s in model.scores]
    return spark.createDataFrame(points, "point string, mean_r2 double, folds int")


@query("m08_boosting_grid")
def _(spark, sf):
    """A short search; the full grid is the library's default, see README for what it takes."""
    return searched(spark, sf, tuning.boosting_search({"maxIter": [4, 5], "maxDepth": [3], "stepSize": [0.08, 0.1]}))


@query("m09_forest_grid")
def _(spark, sf):
    """All 32 points on three folds."""
    return searched(spark, sf, tuning.forest_search())


@query("m10_candidate_metrics")
def _(spark, sf):
    """All candidates of the adaptive trainer on all horizons."""
    parts = []
    for h, rows in training_rows(spark, sf, HORIZONS).items():
        train, test = rows.filter("is_train"), rows.filter("not is_train")
        fitted = training.fit_all(training.ADAPTIVE_CANDIDATES, train)
        parts.append(training.evaluate(fitted, test).select(F.lit(h).alias("horizon"), "*"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


AT = datetime.datetime(2024, 2, 1, 12, 30)


def trained(spark, sf, horizons):
    """Train, save, register and promote; returns the models and the registry path."""
    models = training.train_adaptive(fx.readings(spark, sf), horizons, s=S)
    root = scratch_path(spark, "models")
    for model in models.values():
        training.save_and_register(spark, model, root, f"{root}/registry", AT, stage="production")
    return models, f"{root}/registry"


@query("m13_train_all_horizons")
def _(spark, sf):
    models, _ = trained(spark, sf, HORIZONS)
    rows = [(m.horizon, m.name, m.training_samples, m.test_samples, m.metrics["mae"], m.metrics["rmse"], m.metrics["r2"])
            for m in models.values()]
    return spark.createDataFrame(rows, "horizon string, model string, training_samples long, test_samples long, "
                                       "mae double, rmse double, r2 double")


def outcomes(spark, models):
    rows = [(m.horizon, m.name, len(m.features), m.training_samples, m.test_samples, m.metrics["mae"]) for m in models.values()]
    return spark.createDataFrame(
        rows, "horizon string, model string, features int, training_samples long, test_samples long, mae double")


@query("m13_train_simple")
def _(spark, sf):
    return outcomes(spark, training.train_simple(fx.readings(spark, sf), s=S))


@query("m13_train_full")
def _(spark, sf):
    return outcomes(spark, training.train_full(fx.readings(spark, sf), s=S))


@query("m14_forecast_of_trained_model")
def _(spark, sf):
    """Train on the readings, register, look the models up again and forecast."""
    models = training.train_tuned(fx.readings(spark, sf), HORIZONS, training.ADAPTIVE_CANDIDATES, S)
    root = scratch_path(spark, "models")
    for model in models.values():
        training.save_and_register(spark, model, root, f"{root}/registry", AT, stage="production")
    production = reg.production_models(reg.read_registry(spark, f"{root}/registry"))
    # one row per horizon
    rows = production.collect()
    scorers = {row["metadata"]["horizon"]: training.scorer_of(training.load_model(row)) for row in rows}
    known = production.select(
        F.col("metadata")["horizon"].alias("horizon"), F.col("metadata")["algorithm"].alias("model_name"),
        F.col("metrics")["mae"].alias("mae"), F.col("metrics")["r2"].alias("r2"))
    return serving.forecast(serving.serving_rows(fx.readings(spark, sf)), scorers, known)


@query("s19_save_model_with_metadata")
def _(spark, sf):
    _, path = trained(spark, sf, HORIZONS)
    return fx.flat_registry(reg.read_registry(spark, path)).drop("file_path")


FLAT = "model_name, version, stage, status, file_path, horizon, mae, rmse, r2, registered_at"


@query("m15_register_version", f"""WITH $registry SELECT {FLAT} FROM registry UNION ALL
SELECT model_name, 'v-next' AS version, 'staging', 'active', 'models/next', max(horizon), 0.5e0, 0.75e0, 0.25e0,
  TIMESTAMP '2025-01-01' FROM registry GROUP BY model_name""")
def _(spark, sf):
    path = scratch_path(spark, "registry")
    registry = fx.registry(spark, sf)
    reg.register(path, registry)
    new = registry.groupBy("model_name").agg(F.first("metadata").alias("metadata"))
    numbers = F.map_from_arrays(F.array(F.lit("mae"), F.lit("rmse"), F.lit("r2")), F.array(F.lit(0.5), F.lit(0.75), F.lit(0.25)))
    none = F.lit(None).cast("timestamp")
    reg.register(path, new.select(
        "model_name", F.lit("v-next").alias("version"), F.lit("staging").alias("stage"), F.lit("active").alias("status"),
        F.lit("training_pipeline").alias("registered_by"), F.lit("models/next").alias("file_path"),
        F.array(F.lit("pm2_5")).alias("feature_cols"), numbers.alias("metrics"), "metadata",
        F.lit("2025-01-01").cast("timestamp").alias("registered_at"), none.alias("archived_at"), none.alias("promoted_at")))
    return fx.flat_registry(reg.read_registry(spark, path))


def newest_sql(where: str) -> str:
    return f"""WITH $registry SELECT {FLAT} FROM (SELECT *, row_number() OVER (
  PARTITION BY model_name ORDER BY registered_at DESC, version DESC) AS k FROM registry WHERE {where}) t WHERE k = 1"""


@query("m16_newest_models", newest_sql("status = 'active'"))
def _(spark, sf):
    return fx.flat_registry(reg.newest_models(fx.registry(spark, sf)))


@query("m16_production_models", newest_sql("status = 'active' AND stage = 'production'"))
def _(spark, sf):
    return fx.flat_registry(reg.production_models(fx.registry(spark, sf)))


@query("m17_list_models", f"""WITH $registry SELECT {FLAT} FROM registry
WHERE status = 'active' AND stage = 'staging' ORDER BY registered_at DESC""")
def _(spark, sf):
    return fx.flat_registry(reg.list_models(fx.registry(spark, sf), stage="staging"))


WANTED_SQL = """wanted AS (SELECT model_name, CASE WHEN model_name LIKE '%48h' THEN 'none' ELSE max(version) END AS version
  FROM registry WHERE status = 'active' GROUP BY model_name)"""


def wanted(registry):
    return reg.active(registry).groupBy("model_name").agg(F.max("version").alias("version")).withColumn(
        "version", F.when(F.col("model_name").endswith("48h"), "none").otherwise(F.col("version")))


@query("m18_promote", f"""WITH $registry, {WANTED_SQL}, found AS (
  SELECT w.model_name, w.version FROM wanted w WHERE EXISTS (
    SELECT 1 FROM registry r WHERE r.model_name = w.model_name AND r.version = w.version AND r.status = 'active'))
SELECT r.model_name, r.version, r.status,
  CASE WHEN r.status = 'active' AND r.version = f.version THEN 'production'
       WHEN r.status = 'active' AND f.version IS NOT NULL AND r.stage = 'production' THEN 'archived' ELSE r.stage END AS stage,
  CASE WHEN r.status = 'active' AND f.version IS NOT NULL AND r.stage = 'production' THEN TIMESTAMP '2025-01-01' END AS archived_at,
  CASE WHEN r.status = 'active' AND r.version = f.version THEN TIMESTAMP '2025-01-01' END AS promoted_at
FROM registry r LEFT JOIN found f ON r.model_name = f.model_name""")
def _(spark, sf):
    path, registry = scratch_path(spark, "registry"), fx.registry(spark, sf)
    reg.register(path, registry)
    reg.promote_stored(spark, path, wanted(registry), F.lit("2025-01-01").cast("timestamp"))
    out = reg.read_registry(spark, path)
    return out.select("model_name", "version", "status", "stage", "archived_at", "promoted_at")


@query("m18_promotion_result", f"""WITH $registry, {WANTED_SQL} SELECT w.*, EXISTS (
  SELECT 1 FROM registry r WHERE r.model_name = w.model_name AND r.version = w.version AND r.status = 'active') AS found
FROM wanted w""")
def _(spark, sf):
    registry = fx.registry(spark, sf)
    return reg.promotion_result(registry, wanted(registry))


def compared_sql(metric: str, direction: str, top: str = "") -> str:
    return f"""WITH $registry SELECT * FROM (SELECT {FLAT}, {metric} AS metric_value, row_number() OVER (
  PARTITION BY model_name ORDER BY {metric} {direction} NULLS LAST, registered_at DESC, version) AS place
FROM registry WHERE status = 'active') t {top}"""


def compared(spark, sf, *args, **options):
    out = reg.compare_models(fx.registry(spark, sf), *args, **options)
    return fx.flat_registry(out).join(
        out.select("file_path", "metric_value", "place"), "file_path")


@query("m19_compare_by_r2", compared_sql("r2", "DESC"))
def _(spark, sf):
    return compared(spark, sf, "r2")


@query("m19_compare_top_five", compared_sql("r2", "DESC", "WHERE place <= 5"))
def _(spark, sf):
    return compared(spark, sf, "r2", top=5)


@query("o3_sort_models_by_mae", compared_sql("mae", "ASC"))
def _(spark, sf):
    return compared(spark, sf, "mae")


@query("m20_model_history", f"""WITH $registry SELECT {FLAT} FROM registry
WHERE model_name = (SELECT max(model_name) FROM registry) ORDER BY registered_at DESC""")
def _(spark, sf):
    registry = fx.registry(spark, sf)
    name = registry.agg(F.max("model_name").alias("name")).first()["name"]
    return fx.flat_registry(reg.model_history(registry, name))


@query("m21_training_metadata", f"""WITH $readings, {RUN_ROWS}, q AS (
  SELECT location, CAST(sum(run_rows) AS BIGINT) AS total_records, max(run_rows) AS max_consecutive FROM runs GROUP BY location),
n AS (SELECT location, CAST(floor(count(*) * 0.8e0) AS BIGINT) AS training_samples, count(*) AS n FROM readings GROUP BY location)
SELECT q.location, 'Ridge' AS model_name, training_samples, n - training_samples AS test_samples, '24h' AS horizon,
  CASE WHEN max_consecutive >= 24 THEN 'Forecasting' ELSE 'Nowcasting' END AS model_type,
  total_records, max_consecutive, max_consecutive >= 12 AS uses_lags FROM q JOIN n ON q.location = n.location""")
def _(spark, sf):
    rows = fx.readings(spark, sf)
    quality = data_quality(rows, S)
    counts = with_split(rows, S).groupBy("location").agg(
        F.count_if("is_train").alias("training_samples"), F.count_if(~F.col("is_train")).alias("test_samples"))
    models = counts.select(
        "location", F.lit("Ridge").alias("model_name"), F.array(F.lit("pm2_5")).alias("feature_cols"),
        F.create_map(F.lit("mae"), F.lit(0.5)).alias("metrics"), F.lit(AT).cast("timestamp").alias("trained_on"),
        "training_samples", "test_samples", F.lit("24h").alias("horizon"))
    kinds = quality.select("location", F.when(F.col("can_forecast"), "Forecasting").otherwise("Nowcasting").alias("model_type"))
    out = reg.training_metadata(models.join(kinds, "location"), quality)
    return out.select("location", "model_name", "training_samples", "test_samples", "horizon", "model_type",
                      "data_quality.total_records", "data_quality.max_consecutive", "uses_lags")
