"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_REQUIRED_DOUBLES = [
    "pm2_5", "pm10", "temperature", "feels_like", "temp_min", "temp_max",
    "humidity", "pressure", "wind_speed", "clouds",
]
_OPTIONAL_DOUBLES = ["co", "no", "no2", "o3", "so2", "wind_direction", "wind_gust", "visibility"]

REQUIRED_FIELDS = ["aqi", *_REQUIRED_DOUBLES, "weather_main", "weather_description"]

READINGS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("location", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("aqi", T.IntegerType()),
        *[T.StructField(c, T.DoubleType()) for c in _REQUIRED_DOUBLES],
        *[T.StructField(c, T.DoubleType()) for c in _OPTIONAL_DOUBLES],
        T.StructField("weather_main", T.StringType()),
        T.StructField("weather_description", T.StringType()),
        T.StructField("ingestion_timestamp", T.TimestampType()),
        T.StructField("batch_id", T.StringType()),
    ]
)

# One fetch lands as two payloads, each wrapped in this envelope.
LANDING = T.StructType(
    [
        T.StructField("location", T.StringType()),
        T.StructField("fetch_id", T.LongType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("payload", T.StringType()),
    ]
)

AIR_PAYLOAD = (
    "list array<struct<main: struct<aqi: int>, components: struct<"
    "pm2_5: double, pm10: double, co: double, no: double, no2: double, o3: double, so2: double>>>"
)

WEATHER_PAYLOAD = (
    "main struct<temp: double, feels_like: double, temp_min: double, temp_max: double, "
    "humidity: double, pressure: double>, "
    "wind struct<speed: double, deg: double, gust: double>, "
    "clouds struct<`all`: double>, visibility double, "
    "weather array<struct<main: string, description: string>>"
)

REGISTRY = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("registered_by", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("feature_cols", T.ArrayType(T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("registered_at", T.TimestampType()),
        T.StructField("archived_at", T.TimestampType()),
        T.StructField("promoted_at", T.TimestampType()),
    ]
)

TRAINING_METADATA = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("feature_cols", T.ArrayType(T.StringType())),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("trained_on", T.TimestampType()),
        T.StructField("training_samples", T.LongType()),
        T.StructField("test_samples", T.LongType()),
        T.StructField("horizon", T.StringType()),
        T.StructField("model_type", T.StringType()),
        T.StructField(
            "data_quality",
            T.StructType(
                [
                    T.StructField("total_records", T.LongType()),
                    T.StructField("max_consecutive", T.LongType()),
                    T.StructField("can_use_lags", T.BooleanType()),
                    T.StructField("can_forecast", T.BooleanType()),
                ]
            ),
        ),
        T.StructField("uses_lags", T.BooleanType()),
    ]
)
