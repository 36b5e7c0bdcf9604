"""Current state, history, weekly figures, health and batch forecasts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breezeway.functions import fixed_values as V
from breezeway.functions.bands import (
    clip_index, display_round, five_step_category, five_step_colour, five_step_message, five_step_text_colour,
)
from breezeway.functions.calendar import hours_after
from breezeway.operators.quality import with_enough_rows
from breezeway.operators.series import Series
from breezeway.operators.shape import fill_missing
from breezeway.plans.features import advanced_feature_names, advanced_features, hours_of
from breezeway.session import materialise
from breezeway.sources.readings import latest, latest_n_each, since_days


def current_status(df: DataFrame, s: Series = Series()) -> DataFrame:
    """Newest reading per entity with its band, colours and advice."""
    aqi = F.col("aqi")
    return latest(df, s).select(
        F.coalesce("location", F.lit(V.DEFAULT_LOCATION)).alias("location"), s.ts, "aqi",
        five_step_category(aqi).alias("aqi_category"),
        five_step_colour(aqi).alias("color"),
        five_step_text_colour(aqi).alias("text_color"),
        five_step_message(aqi).alias("message"),
        "pm2_5", "pm10", "o3", "no2", "so2", "co",
        "temperature", "humidity", "wind_speed", "pressure",
        F.lit(V.FIVE_STEP_SCALE_NAME).alias("scale"))


def history(df: DataFrame, days: int = 7, as_of: Column | None = None, s: Series = Series()) -> DataFrame:
    return since_days(df, days, as_of, s.ts).select(
        *s.key, s.ts, "aqi", five_step_category(F.col("aqi")).alias("aqi_category"),
        "pm2_5", "pm10", "temperature", "humidity")


def history_envelope(df: DataFrame, days: int = 7, as_of: Column | None = None, s: Series = Series()) -> DataFrame:
    recent = since_days(df, days, as_of, s.ts)
    return recent.groupBy(*s.key).agg(F.count(F.lit(1)).alias("record_count")).withColumn("days", F.lit(days))


def weekly_figures(df: DataFrame, days: int = 7, as_of: Column | None = None, s: Series = Series()) -> DataFrame:
    recent = since_days(df, days, as_of, s.ts)
    out = recent.groupBy(*s.key).agg(
        F.avg("aqi").alias("avg_aqi"), F.max("aqi").alias("peak_aqi"),
        F.avg("pm2_5").alias("avg_pm2_5"), F.avg("temperature").alias("avg_temperature"))
    return out.withColumn("avg_category", five_step_category(F.col("avg_aqi")))


def health(df: DataFrame, production: DataFrame, s: Series = Series()) -> DataFrame:
    """One row: readings, newest time, models in production and their horizons."""
    horizon = F.regexp_extract("model_name", "_(\\d+h)$", 1)
    models = production.filter((F.col("stage") == "production") & (F.col("status") == "active")).agg(
        F.struct(
            F.countDistinct("model_name").alias("n"),
            F.array_sort(F.collect_set(horizon)).alias("horizons")).alias("m"))
    return (
        df.agg(F.count(F.lit(1)).alias("data_records"), F.max(s.ts).alias("latest_data"))
        .withColumn("_m", models.scalar())
        .select("data_records", "latest_data", F.col("_m.n").alias("models_loaded"),
                F.concat_ws(",", "_m.horizons").alias("available_horizons"))
    )


def serving_rows(df: DataFrame, s: Series = Series(), history_rows: int = 100, least: int = 50) -> DataFrame:
    """One feature row per entity: its newest, computed from its last ``history_rows`` rows.

    Entities with fewer than ``least`` rows are not served. Missing features become 0.
    """
    # one frame of at most history_rows rows an entity, which the count and the features read
    recent = materialise(latest_n_each(df, history_rows, s), "recent")
    newest = latest_n_each(advanced_features(with_enough_rows(recent, least, s), s), 1, s)
    return fill_missing(newest, advanced_feature_names())


Scorer = Callable[[DataFrame], DataFrame]


def linear_scorer(weights: dict[str, float], intercept: float = 0.0) -> Scorer:
    """Adds ``prediction``, a fixed linear formula."""
    def score(df: DataFrame) -> DataFrame:
        total = F.lit(intercept)
        for name, weight in weights.items():
            total = total + F.col(name) * F.lit(weight)
        return df.withColumn("prediction", total)

    return score


def forecast(rows: DataFrame, scorers: dict[str, Scorer], models: DataFrame | None = None,
             s: Series = Series()) -> DataFrame:
    """Predictions of every available horizon for every serving row.

    The serving rows (one per entity) are scored once per model; horizons
    without a model are skipped. ``models`` (horizon, model_name, mae, r2) adds
    the metadata of each model, one row per horizon.
    """
    parts = []
    for horizon in V.HORIZONS:
        if horizon not in scorers:
            continue
        scored = scorers[horizon](rows).withColumn("prediction", clip_index(F.col("prediction")))
        value = F.col("prediction")
        parts.append(scored.select(
            *s.key,
            F.lit(horizon).alias("horizon"),
            hours_after(F.col(s.ts), F.lit(hours_of(horizon))).alias("forecast_time"),
            display_round(value, 2).alias("predicted_aqi"),
            display_round(value, 1).alias("display_aqi"),
            five_step_category(value).alias("aqi_category"),
            five_step_colour(value).alias("color"),
            F.lit(None).cast("string").alias("confidence")))
    if not parts:
        raise ValueError("no model for any horizon")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out if models is None else out.join(models, "horizon")
