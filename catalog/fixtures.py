"""Readings, polls, payloads and a registry derived from the given tables.

Each fixture exists as a Spark expression and as a DuckDB table expression.
Measures are multiples of 1/4, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def five_step(value: Column) -> Column:
    return (
        F.when(value <= 10, 1).when(value <= 25, 2).when(value <= 50, 3)
        .when(value <= 75, 4).otherwise(5)
    )


_FIVE_STEP_SQL = "CASE WHEN {0} <= 10 THEN 1 WHEN {0} <= 25 THEN 2 WHEN {0} <= 50 THEN 3 WHEN {0} <= 75 THEN 4 ELSE 5 END"


def _source(n: Column) -> Column:
    return (
        F.when(n % 7 == 0, None).when(n % 3 == 0, "openweather")
        .when(n % 3 == 1, "openweather_historical").otherwise("sensor")
    )


_SOURCE_SQL = (
    "CASE WHEN {0} % 7 = 0 THEN NULL WHEN {0} % 3 = 0 THEN 'openweather' "
    "WHEN {0} % 3 = 1 THEN 'openweather_historical' ELSE 'sensor' END"
)


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly readings of four stations."""
    v = F.floor(F.col("value") * 4).cast("double") / 4

    def of(kind: str) -> Column:
        return F.max(F.when(F.col("event_type") == kind, v))

    grouped = (
        events(spark, sf)
        .groupBy(
            F.concat(F.lit("st"), (F.col("user_id") % 4).cast("string")).alias("location"),
            F.date_trunc("hour", "ts").cast("timestamp").alias("timestamp"))
        .agg(
            F.min("event_id").alias("seq"),
            F.min_by(v, "event_id").alias("v0"), F.max_by(v, "event_id").alias("v1"),
            of("click").alias("no2"), of("view").alias("o3"), of("error").alias("wind_gust"),
            of("signup").alias("so2"), of("purchase").alias("co"),
            F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("su"), F.sum("event_id").alias("se"))
    )
    seq = F.col("seq")
    d = lambda c: c.cast("double")
    temperature = d(F.lit(20) + F.col("n") % 15)
    return grouped.select(
        "seq", "location", _source(seq).alias("source"), "timestamp",
        five_step(F.col("v0")).alias("aqi"),
        F.col("v0").alias("pm2_5"), (F.col("v0") + F.col("v1")).alias("pm10"),
        "co", F.when(seq % 5 != 0, d(seq % 40)).alias("no"), "no2", "o3", "so2",
        temperature.alias("temperature"), (temperature - 1).alias("feels_like"),
        (temperature - 2).alias("temp_min"), (temperature + 3).alias("temp_max"),
        d(F.lit(30) + F.col("su") % 60).alias("humidity"),
        d(F.lit(1000) + F.col("se") % 30).alias("pressure"),
        (d(seq % 100) / 10).alias("wind_speed"),
        d(F.col("se") % 360).alias("wind_direction"), "wind_gust",
        d(F.col("su") % 101).alias("clouds"),
        F.when(seq % 4 != 0, d(seq % 10000)).alias("visibility"),
        F.when(seq % 3 == 0, "Clear").when(seq % 3 == 1, "Clouds").otherwise("Rain").alias("weather_main"),
        F.when(seq % 3 == 0, "clear sky").otherwise("few clouds").alias("weather_description"),
        F.timestamp_add("MINUTE", (seq % 50).cast("int"), F.col("timestamp")).alias("ingestion_timestamp"),
        F.concat(F.lit("b"), (seq % 10).cast("string")).alias("batch_id"))


_READINGS_SQL = f"""readings AS (
  SELECT seq, location, {_SOURCE_SQL.format('seq')} AS source, hr AS timestamp,
         {_FIVE_STEP_SQL.format('v0')} AS aqi, v0 AS pm2_5, v0 + v1 AS pm10,
         co, CASE WHEN seq % 5 <> 0 THEN CAST(seq % 40 AS DOUBLE) END AS no, no2, o3, so2,
         CAST(20 + n % 15 AS DOUBLE) AS temperature, CAST(20 + n % 15 AS DOUBLE) - 1 AS feels_like,
         CAST(20 + n % 15 AS DOUBLE) - 2 AS temp_min, CAST(20 + n % 15 AS DOUBLE) + 3 AS temp_max,
         CAST(30 + su % 60 AS DOUBLE) AS humidity, CAST(1000 + se % 30 AS DOUBLE) AS pressure,
         CAST(seq % 100 AS DOUBLE) / 10 AS wind_speed, CAST(se % 360 AS DOUBLE) AS wind_direction,
         wind_gust, CAST(su % 101 AS DOUBLE) AS clouds,
         CASE WHEN seq % 4 <> 0 THEN CAST(seq % 10000 AS DOUBLE) END AS visibility,
         CASE seq % 3 WHEN 0 THEN 'Clear' WHEN 1 THEN 'Clouds' ELSE 'Rain' END AS weather_main,
         CASE seq % 3 WHEN 0 THEN 'clear sky' ELSE 'few clouds' END AS weather_description,
         hr + to_minutes(CAST(seq % 50 AS BIGINT)) AS ingestion_timestamp,
         'b' || (seq % 10) AS batch_id
  FROM (
    SELECT 'st' || (user_id % 4) AS location, date_trunc('hour', ts) AS hr, min(event_id) AS seq,
           min_by(v, event_id) AS v0, max_by(v, event_id) AS v1,
           max(v) FILTER (WHERE event_type = 'click') AS no2,
           max(v) FILTER (WHERE event_type = 'view') AS o3,
           max(v) FILTER (WHERE event_type = 'error') AS wind_gust,
           max(v) FILTER (WHERE event_type = 'signup') AS so2,
           max(v) FILTER (WHERE event_type = 'purchase') AS co,
           count(*) AS n, CAST(sum(user_id) AS BIGINT) AS su, CAST(sum(event_id) AS BIGINT) AS se
    FROM (SELECT *, floor(value * 4) / 4 AS v FROM events) e
    GROUP BY ALL
  ) g
)"""


def with_versions(df: DataFrame, even: str = "v1") -> DataFrame:
    return df.withColumn("model_version", F.when(F.col("seq") % 2 == 0, even).otherwise("v2"))


def sensor_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One reading per event: grows with the table, at irregular times."""
    e, u, v = F.col("event_id"), F.col("user_id"), F.floor(F.col("value") * 4).cast("double") / 4
    d = lambda c: c.cast("double")
    rows = events(spark, sf).select(
        e.alias("seq"), F.concat(F.lit("st"), (u % 4).cast("string")).alias("location"),
        _source(e).alias("source"),
        F.col("ts").cast("timestamp").alias("timestamp"), v.alias("pm2_5"), (v + d(u % 50)).alias("pm10"),
        d(F.lit(20) + u % 15).alias("temperature"), d(F.lit(30) + e % 60).alias("humidity"),
        d(F.lit(1000) + e % 30).alias("pressure"), (d(e % 100) / 10).alias("wind_speed"),
        d(e % 101).alias("clouds"))
    return rows.withColumn("aqi", five_step(F.col("pm2_5")))


_SENSOR_SQL = f"""sensor_rows AS (
  SELECT *, {_FIVE_STEP_SQL.format('pm2_5')} AS aqi FROM (
    SELECT event_id AS seq, 'st' || (user_id % 4) AS location, {_SOURCE_SQL.format('event_id')} AS source,
           ts AS timestamp, floor(value * 4) / 4 AS pm2_5,
           floor(value * 4) / 4 + CAST(user_id % 50 AS DOUBLE) AS pm10,
           CAST(20 + user_id % 15 AS DOUBLE) AS temperature, CAST(30 + event_id % 60 AS DOUBLE) AS humidity,
           CAST(1000 + event_id % 30 AS DOUBLE) AS pressure, CAST(event_id % 100 AS DOUBLE) / 10 AS wind_speed,
           CAST(event_id % 101 AS DOUBLE) AS clouds
    FROM events) s
)"""


#: Rows of one entity in a window task in the queries over user rows: their hot entity is split.
FEW_ROWS = 500


def user_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Sensor rows of one entity a user, but a third of them all of one entity."""
    users = events(spark, sf).select(F.col("event_id").alias("seq"), "user_id")
    key = F.when(F.col("seq") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return sensor_rows(spark, sf).join(users, "seq").withColumn("location", key).drop("user_id")


_USER_SQL = _SENSOR_SQL.replace("sensor_rows AS", "user_rows AS").replace(
    "'st' || (user_id % 4) AS location",
    "CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE 'u' || user_id END AS location")


def polls(spark: SparkSession, sf: str) -> DataFrame:
    """Polls for the ingest gate, one per event, with coarse values that repeat."""
    return events(spark, sf).select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("st"), (F.col("user_id") % 4).cast("string")).alias("location"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        five_step(F.col("value")).alias("aqi"),
        (F.floor(F.col("value") / 25) * 25).cast("double").alias("pm2_5"),
        (F.lit(20) + F.col("user_id") % 2).cast("double").alias("temperature"))


_POLLS_SQL = f"""polls AS (
  SELECT event_id AS seq, 'st' || (user_id % 4) AS location, ts AS timestamp,
         {_FIVE_STEP_SQL.format('value')} AS aqi, floor(value / 25) * 25 AS pm2_5,
         CAST(20 + user_id % 2 AS DOUBLE) AS temperature
  FROM events
)"""


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """One model version per order, with metrics, stages and states."""
    o, price = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    horizon = F.when(o % 3 == 0, "24h").when(o % 3 == 1, "48h").otherwise("72h")
    at = F.timestamp_add("SECOND", (o % 86400).cast("int"), F.col("o_orderdate").cast("timestamp"))
    mae = (price % 1000).cast("double") / 1000
    pairs = F.map_from_arrays
    base = pairs(F.array(F.lit("mae"), F.lit("rmse")), F.array(mae, mae + 0.25))
    with_r2 = F.map_concat(base, F.create_map(F.lit("r2"), (F.floor(price / 7) % 1000).cast("double") / 1000))
    none = F.lit(None).cast("timestamp")
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        F.concat(F.lit("aqi_forecast_c"), (F.col("o_custkey") % 50).cast("string"), F.lit("_"), horizon)
        .alias("model_name"),
        F.concat(F.lit("v"), o.cast("string")).alias("version"),
        F.when(F.col("o_orderstatus") == "F", "archived").when(F.col("o_orderstatus") == "O", "staging")
        .otherwise("production").alias("stage"),
        F.when(o % 7 == 0, "inactive").otherwise("active").alias("status"),
        F.lit("training_pipeline").alias("registered_by"),
        F.concat(F.lit("models/"), o.cast("string")).alias("file_path"),
        F.array(F.lit("pm2_5"), F.lit("hour")).alias("feature_cols"),
        F.when(o % 5 == 0, base).otherwise(with_r2).alias("metrics"),
        F.create_map(F.lit("horizon"), horizon).alias("metadata"),
        at.alias("registered_at"), none.alias("archived_at"), none.alias("promoted_at"))


_REGISTRY_SQL = """registry AS (
  SELECT 'aqi_forecast_c' || (o_custkey % 50) || '_' || h AS model_name, 'v' || o_orderkey AS version,
         CASE o_orderstatus WHEN 'F' THEN 'archived' WHEN 'O' THEN 'staging' ELSE 'production' END AS stage,
         CASE WHEN o_orderkey % 7 = 0 THEN 'inactive' ELSE 'active' END AS status,
         'models/' || o_orderkey AS file_path, h AS horizon, mae, mae + 0.25 AS rmse,
         CASE WHEN o_orderkey % 5 <> 0
              THEN CAST(CAST(floor(p / 7) AS BIGINT) % 1000 AS DOUBLE) / 1000 END AS r2,
         o_orderdate + to_seconds(o_orderkey % 86400) AS registered_at
  FROM (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN '24h' WHEN 1 THEN '48h' ELSE '72h' END AS h,
               CAST(floor(o_totalprice) AS BIGINT) AS p,
               CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS DOUBLE) / 1000 AS mae
        FROM orders) o
)"""


def flat_registry(df: DataFrame) -> DataFrame:
    """Registry rows with scalar columns only."""
    metric = lambda m: F.try_element_at("metrics", F.lit(m)).alias(m)
    return df.select("model_name", "version", "stage", "status", "file_path",
                     F.col("metadata")["horizon"].alias("horizon"),
                     metric("mae"), metric("rmse"), metric("r2"), "registered_at")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Two fixed predictors of the readings: (location, model, rank, y, prediction)."""
    rows = readings(spark, sf)
    a = F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.col("pm2_5") / 16))
    both = F.explode(F.array(
        F.struct(F.lit("a").alias("model"), F.lit(0).alias("rank"), a.alias("prediction")),
        F.struct(F.lit("b").alias("model"), F.lit(1).alias("rank"), F.lit(3.0).alias("prediction"))))
    return rows.select("location", "seq", F.col("aqi").cast("double").alias("y"), both.alias("_p")).select(
        "location", "seq", "y", "_p.*")


_PREDICTIONS_SQL = """predictions AS (
  SELECT location, seq, CAST(aqi AS DOUBLE) AS y, 'a' AS model, 0 AS rank,
         least(5e0, greatest(1e0, pm2_5 / 16)) AS prediction FROM readings
  UNION ALL
  SELECT location, seq, CAST(aqi AS DOUBLE), 'b', 1, 3e0 FROM readings
)"""


def landed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The two JSON payloads of every fetch; some lack required or optional fields."""
    rows = sensor_rows(spark, sf)
    e = F.col("seq")
    gone = lambda when, c: F.when(~when, c)
    components = F.struct(
        F.col("pm2_5"), gone(e % 9 == 0, F.col("pm10")).alias("pm10"),
        gone(e % 2 == 0, F.col("pm2_5") + 1).alias("co"), F.col("clouds").alias("no2"))
    entry = F.struct(F.struct("aqi").alias("main"), components.alias("components"))
    entries = F.when(e % 10 == 0, F.array().cast(f"array<{_type_of(rows, entry)}>")).otherwise(F.array(entry))
    air = F.to_json(F.struct(entries.alias("list")))
    main = F.struct(
        F.col("temperature").alias("temp"), F.col("temperature").alias("feels_like"),
        (F.col("temperature") - 1).alias("temp_min"), (F.col("temperature") + 1).alias("temp_max"),
        "humidity", "pressure")
    wind = F.struct(gone(e % 8 == 3, F.col("wind_speed")).alias("speed"),
                    gone(e % 4 == 1, F.col("humidity")).alias("deg"),
                    gone(e % 3 == 0, F.col("wind_speed") * 2).alias("gust"))
    sky = F.array(F.struct(F.lit("Clear").alias("main"), F.lit("clear sky").alias("description")))
    weather = F.to_json(F.struct(
        main.alias("main"), wind.alias("wind"), F.struct(F.col("clouds").alias("all")).alias("clouds"),
        sky.alias("weather")))
    envelope = ["location", e.alias("fetch_id"), F.col("timestamp").alias("fetched_at")]
    return (rows.select(*envelope, air.alias("payload")), rows.select(*envelope, weather.alias("payload")))


def _type_of(df: DataFrame, column: Column) -> str:
    return df.select(column.alias("c")).schema["c"].dataType.simpleString()


_R = _READINGS_SQL
CTES = {
    "predictions": f"{_R}, {_PREDICTIONS_SQL}",
    "sensor_rows": _SENSOR_SQL,
    "user_rows": _USER_SQL,
    "readings": _R,
    "polls": _POLLS_SQL,
    "registry": _REGISTRY_SQL,
}
