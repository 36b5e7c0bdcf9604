"""Column selection, missing values and schema-level choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breezeway.functions import fixed_values as V


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is the source's missing value; Spark would order it above all numbers."""
    floats = (T.DoubleType, T.FloatType)
    return df.select(
        *[
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, floats) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def feature_names(df: DataFrame, excluded: list[str], numeric_only: bool = False) -> list[str]:
    """All columns but the excluded and our bookkeeping ones, in schema order."""
    skip = {*excluded, *V.BOOKKEEPING}
    names = [c for c in df.columns if c not in skip]
    return [c for c in names if c in numeric_columns(df, [])] if numeric_only else names


def model_input_names() -> list[str]:
    """The fixed 42-column model input."""
    lags = [f"{c}_lag_{n}h" for c in ("pm2_5", "pm10", "aqi") for n in (1, 3, 6, 12, 24)]
    return [
        "pm2_5", "pm10", "co", "no2", "o3", "so2",
        "temperature", "humidity", "pressure", "wind_speed",
        "hour", "day_of_week", "day_of_month", "month", "is_weekend",
        "hour_sin", "hour_cos", "month_sin", "month_cos",
        *lags,
        "pm2_5_rolling_24h_mean", "pm2_5_rolling_24h_std",
        "pm10_rolling_24h_mean", "aqi_rolling_24h_mean",
        "temp_humidity_interaction", "wind_pressure_interaction",
        "pm2_5_pm10_ratio", "no2_o3_ratio",
    ]


def drop_missing(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=subset)


def fill_missing(df: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in columns})


def ensure_columns(df: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    """Add the absent ones among ``columns`` as a constant."""
    absent = {c: F.lit(value) for c in columns if c not in df.columns}
    return df.withColumns(absent) if absent else df


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def where_present(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop columns; absent ones are ignored."""
    return df.drop(*columns)


def first_present(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate that the schema has."""
    return next((c for c in candidates if c in df.columns), None)


def resolve_target(df: DataFrame) -> DataFrame:
    """Make sure there is an ``aqi`` column; ``target`` stands in for it."""
    if "aqi" not in df.columns and "target" in df.columns:
        return df.withColumn("aqi", F.col("target"))
    return df


def numeric_columns(df: DataFrame, excluded: list[str] = V.COORDINATE_NAMES) -> list[str]:
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in excluded
    ]


def known_horizons(df: DataFrame, column: str = "horizon") -> DataFrame:
    return df.filter(F.col(column).isin(*V.HORIZONS))


def unpivot_row(df: DataFrame, records: list[dict[str, Column]]) -> DataFrame:
    """Turn one wide row into one row per record; all records share their names."""
    rows = F.array(*[F.struct(*[c.alias(n) for n, c in r.items()]) for r in records])
    return df.select(F.explode(rows).alias("_r")).select("_r.*")
