"""Products, ratios, defaults and row checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breezeway.functions import fixed_values as V


def present(df: DataFrame, name: str, default: float | None = None) -> Column:
    """Column ``name``; ``default`` where it is NULL or absent from the schema."""
    value = F.col(name) if name in df.columns else F.lit(None).cast("double")
    return value if default is None else F.coalesce(value, F.lit(default))


def small_ratio(top: Column, bottom: Column) -> Column:
    """a / (b + 1e-6)."""
    return F.try_divide(top, bottom + F.lit(1e-6))


def unit_ratio(top: Column, bottom: Column) -> Column:
    """a / (b + 1)."""
    return F.try_divide(top, bottom + F.lit(1.0))


def weather_products(df: DataFrame) -> list[Column]:
    """The interaction columns whose inputs exist in ``df``."""
    c = F.col
    wanted = [
        ("temp_humidity_interaction", "temperature", "humidity", lambda a, b: a * b),
        ("wind_pressure_interaction", "wind_speed", "pressure", lambda a, b: a * b),
        ("pm2_5_pm10_ratio", "pm2_5", "pm10", small_ratio),
        ("no2_o3_ratio", "no2", "o3", small_ratio),
    ]
    return [
        f(c(a), c(b)).alias(name)
        for name, a, b, f in wanted
        if a in df.columns and b in df.columns
    ]


def weather_products_with_defaults(df: DataFrame) -> list[Column]:
    """The same four columns for single rows, where a missing input has a default."""
    return [
        (present(df, "temperature", 0.0) * present(df, "humidity", 0.0)).alias(
            "temp_humidity_interaction"),
        (present(df, "wind_speed", 0.0) * present(df, "pressure", 1013.0)).alias(
            "wind_pressure_interaction"),
        small_ratio(present(df, "pm2_5", 0.0), present(df, "pm10", 1.0)).alias("pm2_5_pm10_ratio"),
        small_ratio(present(df, "no2", 0.0), present(df, "o3", 1.0)).alias("no2_o3_ratio"),
    ]


def pollution_products() -> list[Column]:
    c = F.col
    return [
        (c("pm2_5") * c("wind_speed")).alias("pm2_5_x_wind"),
        (c("pm2_5") * c("humidity")).alias("pm2_5_x_humidity"),
        (c("pm2_5") * c("temperature")).alias("pm2_5_x_temp"),
        (c("wind_speed") * c("humidity")).alias("wind_x_humidity"),
        (c("temperature") * c("humidity")).alias("temp_x_humidity"),
        unit_ratio(c("pm2_5"), c("pm10")).alias("pm2_5_pm10_ratio"),
    ]


def in_index_range(value: Column) -> Column:
    return value.between(0, 500)


def valid_coordinates(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def with_row_check(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Add ``valid`` and ``error``: the first broken rule in field order, '' if none.

    Text columns are tested for being numeric; a field absent from the schema
    is missing in every row.
    """
    rules = []
    for name in fields or V.VALIDATED_FIELDS:
        missing = F.lit(f"Missing required feature: {name}")
        if name not in df.columns:
            rules.append(missing)
            continue
        raw = F.col(name)
        number = raw
        rules.append(F.when(raw.isNull(), missing))
        if not isinstance(df.schema[name].dataType, T.NumericType):
            number = raw.try_cast("double")
            rules.append(
                F.when(number.isNull(), f"Invalid type for {name}: expected number"))
        rules.append(F.when(number < 0, f"Invalid value for {name}: must be non-negative"))
    error = F.coalesce(*rules, F.lit(""))
    return df.withColumn("error", error).withColumn("valid", F.col("error") == "")
