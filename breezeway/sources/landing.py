"""Landed weather-service payloads -> flat readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breezeway.schemas import AIR_PAYLOAD, REQUIRED_FIELDS, WEATHER_PAYLOAD

_WEATHER_FIELDS = {
    "temperature": "main.temp", "feels_like": "main.feels_like",
    "temp_min": "main.temp_min", "temp_max": "main.temp_max",
    "humidity": "main.humidity", "pressure": "main.pressure",
    "wind_speed": "wind.speed", "wind_direction": "wind.deg", "wind_gust": "wind.gust",
    "clouds": "clouds.all", "visibility": "visibility",
}


def _parsed(landed: DataFrame, schema: str, *keep: str) -> DataFrame:
    """Payloads as struct ``p``.

    The one-element explode is a barrier: without it later filters on single
    fields would be pushed below this step and parse the text once per field.
    """
    return landed.select(*keep, F.explode(F.array(F.from_json("payload", schema))).alias("p"))


def parse_air(landed: DataFrame) -> DataFrame:
    """First list entry of each air payload."""
    parts = _parsed(landed, AIR_PAYLOAD, "location", "fetch_id", "fetched_at")
    entry = F.try_element_at(F.col("p")["list"], F.lit(1))
    gases = ["pm2_5", "pm10", "co", "no", "no2", "o3", "so2"]
    return parts.select(
        "location", "fetch_id", "fetched_at", entry["main"]["aqi"].alias("aqi"),
        *[entry["components"][g].alias(g) for g in gases])


def parse_weather(landed: DataFrame) -> DataFrame:
    """Flat weather fields; a missing wind direction is 0."""
    parts = _parsed(landed, WEATHER_PAYLOAD, "location", "fetch_id")
    first = F.try_element_at(F.col("p.weather"), F.lit(1))
    out = parts.select(
        "location", "fetch_id",
        *[F.col(f"p.{path}").alias(name) for name, path in _WEATHER_FIELDS.items()],
        first["main"].alias("weather_main"), first["description"].alias("weather_description"))
    return out.withColumn("wind_direction", F.coalesce("wind_direction", F.lit(0.0)))


def merge_payloads(air: DataFrame, weather: DataFrame, source: str = "openweather") -> DataFrame:
    """Join the two payloads of each fetch; a fetch without a required field is rejected.

    Required fields are checked before the join, so rejected payloads are not
    shuffled. (location, fetch_id) is unique on both sides.
    """
    air, weather = parse_air(air), parse_weather(weather)
    air = air.na.drop("any", subset=[c for c in REQUIRED_FIELDS if c in air.columns])
    weather = weather.na.drop("any", subset=[c for c in REQUIRED_FIELDS if c in weather.columns])
    return (
        air.join(weather, ["location", "fetch_id"])
        .withColumnsRenamed({"fetch_id": "seq", "fetched_at": "timestamp"})
        .withColumn("source", F.lit(source))
    )
