"""Feature sets and serving plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeway.operators.series import Series
from breezeway.functions import fixed_values as V
from breezeway.plans import features as plans
from breezeway.plans import serving
from catalog import fixtures as fx
from catalog import query, r
from catalog.windows import OVER, S, SIZES, frame, full_mean_sql, lag_sql

TAU = "2 * pi()"
CALENDAR_SQL = {
    "hour": "CAST(hour(timestamp) AS INTEGER)",
    "day_of_week": "CAST(isodow(timestamp) - 1 AS INTEGER)",
    "day_of_month": "CAST(day(timestamp) AS INTEGER)",
    "month": "CAST(month(timestamp) AS INTEGER)",
    "is_weekend": "CASE WHEN isodow(timestamp) >= 6 THEN 1 ELSE 0 END",
    "is_rush_hour": "CASE WHEN hour(timestamp) BETWEEN 7 AND 10 OR hour(timestamp) BETWEEN 17 AND 20 THEN 1 ELSE 0 END",
    "hour_sin": r(f"sin({TAU} * hour(timestamp) / 24)", 9), "hour_cos": r(f"cos({TAU} * hour(timestamp) / 24)", 9),
    "dow_sin": r(f"sin({TAU} * (isodow(timestamp) - 1) / 7)", 9),
    "dow_cos": r(f"cos({TAU} * (isodow(timestamp) - 1) / 7)", 9),
    "month_sin": r(f"sin({TAU} * month(timestamp) / 12)", 9), "month_cos": r(f"cos({TAU} * month(timestamp) / 12)", 9),
}
CYCLES = [c for c in CALENDAR_SQL if c.endswith(("_sin", "_cos"))]


def calendar_sql(names) -> list[str]:
    return [f"{CALENDAR_SQL[n]} AS {n}" for n in names]


def rounded(df, extra=()):
    """Round the columns whose last bits depend on the engine."""
    names = [c for c in df.columns if c in CYCLES or "_std" in c or "_ratio" in c or c in extra]
    return df.withColumns({c: F.round(c, 9 if c in CYCLES else 6) for c in names})


RATIOS = [
    r("pm2_5 / (pm10 + 1e-6)") + " AS pm2_5_pm10_ratio",
    r("no2 / (o3 + 1e-6)") + " AS no2_o3_ratio",
]
PRODUCTS = [
    "temperature * humidity AS temp_humidity_interaction",
    "wind_speed * pressure AS wind_pressure_interaction",
]
RAW = "seq, location, timestamp, pm2_5, pm10, aqi, no2, o3, temperature, humidity, pressure, wind_speed, clouds"
RAW_NAMES = RAW.split(", ")

FULL_SQL = ", ".join([
    RAW, *calendar_sql(plans.FULL_CALENDAR),
    *lag_sql(["pm2_5", "pm10", "aqi"], [1, 3, 6, 12, 24]),
    *[f"avg({c}) {frame(24)} AS {c}_rolling_24h_mean" for c in ("pm2_5", "pm10", "aqi")],
    r(f"coalesce(stddev_samp(pm2_5) {frame(24)}, 0)") + " AS pm2_5_rolling_24h_std",
    *PRODUCTS, *RATIOS,
    *[f"lead(aqi, {h}) {OVER} AS aqi_{h}h_ahead" for h in (24, 48, 72)],
])


@query("v1_full_features", f"WITH $readings SELECT {FULL_SQL} FROM readings")
def _(spark, sf):
    return rounded(plans.full_features(fx.readings(spark, sf).select(*RAW_NAMES), V.HORIZONS, S))


SIMPLE_SQL = [
    *lag_sql(["aqi", "pm2_5"], [1, 3, 6]),
    *[full_mean_sql(c, n) for n in (3, 6) for c in ("aqi", "pm2_5")],
    *calendar_sql(plans.SIMPLE_CALENDAR),
]


@query("v2_simple_features", f"""WITH $readings, f AS (
  SELECT {RAW}, wind_gust, {', '.join(SIMPLE_SQL)}, lead(aqi, 24) {OVER} AS target_aqi_24h FROM readings)
SELECT * FROM f WHERE f IS NOT NULL AND {' AND '.join(c + ' IS NOT NULL' for c in [
    'no2', 'o3', 'wind_gust', 'aqi_lag_6h', 'pm2_5_lag_6h', 'aqi_rolling_mean_6h', 'pm2_5_rolling_mean_6h',
    'target_aqi_24h'])}""")
def _(spark, sf):
    return rounded(plans.simple_features(fx.readings(spark, sf).select(*RAW_NAMES, "wind_gust"), 24, S))


ADAPTIVE_RAW = "seq, location, timestamp, aqi, pm2_5, pm10, temperature, humidity, pressure, wind_speed"


def adaptive_sql(use_lags):
    history = SIMPLE_SQL[:10] if use_lags else []
    parts = [ADAPTIVE_RAW, "0e0 AS clouds", *calendar_sql(plans.ADAPTIVE_CALENDAR), *history]
    return f"WITH $readings SELECT {', '.join(parts)} FROM readings"


@query("v3_adaptive_features", adaptive_sql(False))
def _(spark, sf):
    return rounded(plans.adaptive_features(fx.readings(spark, sf).select(*ADAPTIVE_RAW.split(", ")), False, S))


@query("v3_adaptive_features_with_lags", adaptive_sql(True))
def _(spark, sf):
    return rounded(plans.adaptive_features(fx.readings(spark, sf).select(*ADAPTIVE_RAW.split(", ")), True, S))


ADVANCED_RAW = "seq, location, timestamp, pm2_5, pm10, aqi, temperature, humidity, pressure, wind_speed, clouds"
ADVANCED_SQL = ", ".join([
    ADVANCED_RAW, *calendar_sql(plans.ADVANCED_CALENDAR),
    *lag_sql(["pm2_5", "pm10", "aqi"], [1, 2, 3, 6, 12, 24, 48]),
    *[f"avg({c}) {frame(n)} AS {c}_rolling_mean_{n}h" for n in SIZES for c in ("pm2_5", "aqi")],
    *[r(f"stddev_samp({c}) {frame(n)}") + f" AS {c}_rolling_std_{n}h" for n in SIZES for c in ("pm2_5", "aqi")],
    *[f"{h}(pm2_5) {frame(n)} AS pm2_5_rolling_{h}_{n}h" for n in SIZES for h in ("max", "min")],
    *[f"pm2_5 - lag(pm2_5, {n}) {OVER} AS pm2_5_change_{n}h" for n in (1, 3, 6)],
    "pm2_5 * wind_speed AS pm2_5_x_wind", "pm2_5 * humidity AS pm2_5_x_humidity",
    "pm2_5 * temperature AS pm2_5_x_temp", "wind_speed * humidity AS wind_x_humidity",
    "temperature * humidity AS temp_x_humidity", r("pm2_5 / (pm10 + 1)") + " AS pm2_5_pm10_ratio",
    f"temperature - lag(temperature) {OVER} AS temp_change",
    f"wind_speed - lag(wind_speed) {OVER} AS wind_change",
    f"pressure - lag(pressure) {OVER} AS pressure_change",
])


def advanced(df, s=S):
    return rounded(plans.advanced_features(df.select(*ADVANCED_RAW.split(", ")), s))


@query("v4_advanced_features", f"WITH $readings SELECT {ADVANCED_SQL} FROM readings")
def _(spark, sf):
    return advanced(fx.readings(spark, sf))


@query("v4_advanced_features_of_sensor_rows", f"WITH $sensor_rows SELECT {ADVANCED_SQL} FROM sensor_rows")
def _(spark, sf):
    return advanced(fx.sensor_rows(spark, sf))


@query("v4_advanced_features_of_user_rows", f"WITH $user_rows SELECT {ADVANCED_SQL} FROM user_rows")
def _(spark, sf):
    return advanced(fx.user_rows(spark, sf), Series(max_rows=fx.FEW_ROWS))


ZERO_LAGS = ", ".join(f"0e0 AS {c}_lag_{n}h" for c in ("pm2_5", "pm10", "aqi") for n in (1, 3, 6, 12, 24))
DEFAULT_PRODUCTS = ", ".join([
    "coalesce(temperature, 0) * coalesce(humidity, 0) AS temp_humidity_interaction",
    "coalesce(wind_speed, 0) * coalesce(pressure, 1013) AS wind_pressure_interaction",
    r("coalesce(pm2_5, 0) / (coalesce(pm10, 1) + 1e-6)") + " AS pm2_5_pm10_ratio",
    r("coalesce(no2, 0) / (coalesce(o3, 1) + 1e-6)") + " AS no2_o3_ratio",
])


@query("v5_single_row_features", f"""WITH $readings SELECT {RAW}, {', '.join(calendar_sql(plans.FULL_CALENDAR))},
  {DEFAULT_PRODUCTS}, {ZERO_LAGS}, pm2_5 AS pm2_5_rolling_24h_mean, 0e0 AS pm2_5_rolling_24h_std,
  pm10 AS pm10_rolling_24h_mean, CAST(aqi AS DOUBLE) AS aqi_rolling_24h_mean FROM readings""")
def _(spark, sf):
    return rounded(plans.single_row_features(fx.readings(spark, sf).select(*RAW_NAMES)))


@query("v6_time_features", f"SELECT event_id, {', '.join(calendar_sql(plans.FULL_CALENDAR))} FROM (SELECT event_id, ts AS timestamp FROM events) e")
def _(spark, sf):
    return rounded(plans.time_features(fx.events(spark, sf).select("event_id", "ts"), "ts").drop("ts"))


@query("v7_interaction_features", f"WITH $readings SELECT seq, location, {DEFAULT_PRODUCTS} FROM readings")
def _(spark, sf):
    out = plans.interaction_features(fx.readings(spark, sf))
    return rounded(out.select("seq", "location", "temp_humidity_interaction", "wind_pressure_interaction",
                              "pm2_5_pm10_ratio", "no2_o3_ratio"))


def category_sql(x: str) -> str:
    return (f"CASE WHEN {x} <= 1.5 THEN 'Good' WHEN {x} <= 2.5 THEN 'Fair' WHEN {x} <= 3.5 THEN 'Moderate' "
            f"WHEN {x} <= 4.5 THEN 'Poor' WHEN {x} IS NOT NULL THEN 'Very Poor' END")


def colour_sql(x: str) -> str:
    return (f"CASE WHEN {x} <= 1.5 THEN '#00E400' WHEN {x} <= 2.5 THEN '#FFFF00' WHEN {x} <= 3.5 THEN '#FF7E00' "
            f"WHEN {x} <= 4.5 THEN '#FF0000' WHEN {x} IS NOT NULL THEN '#8F3F97' END")


def message_sql(x: str) -> str:
    texts = [b[3] for b in V.FIVE_STEP_BANDS]
    whens = " ".join(f"WHEN {x} <= {b} THEN '{t}'" for b, t in zip((1.5, 2.5, 3.5, 4.5), texts))
    return f"CASE {whens} WHEN {x} IS NOT NULL THEN '{texts[4]}' END"


LAST_WEEK = "timestamp >= (SELECT max(timestamp) FROM readings) - INTERVAL 7 DAYS"


@query("p18_history", f"""WITH $readings SELECT location, timestamp, aqi, {category_sql('aqi')} AS aqi_category,
  pm2_5, pm10, temperature, humidity FROM readings WHERE {LAST_WEEK}""")
def _(spark, sf):
    return serving.history(fx.readings(spark, sf), 7)


@query("p19_current_status", f"""WITH $readings SELECT location, timestamp, aqi,
  {category_sql('aqi')} AS aqi_category, {colour_sql('aqi')} AS color,
  CASE WHEN aqi <= 2.5 THEN 'black' ELSE 'white' END AS text_color, {message_sql('aqi')} AS message,
  pm2_5, pm10, o3, no2, so2, co, temperature, humidity, wind_speed, pressure, '1-5 (OpenWeather)' AS scale
FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY timestamp DESC, seq DESC) AS k FROM readings) t
WHERE k = 1""")
def _(spark, sf):
    return serving.current_status(fx.readings(spark, sf))


@query("a31_weekly_figures", f"""WITH $readings, g AS (
  SELECT location, avg(aqi) AS avg_aqi, max(aqi) AS peak_aqi, avg(pm2_5) AS avg_pm2_5,
         avg(temperature) AS avg_temperature FROM readings WHERE {LAST_WEEK} GROUP BY location)
SELECT *, {category_sql('avg_aqi')} AS avg_category FROM g""")
def _(spark, sf):
    return serving.weekly_figures(fx.readings(spark, sf), 7)


@query("a35_health", """WITH $readings, $registry SELECT
  (SELECT count(*) FROM readings) AS data_records, (SELECT max(timestamp) FROM readings) AS latest_data,
  count(DISTINCT model_name) AS models_loaded, string_agg(DISTINCT horizon, ',' ORDER BY horizon) AS available_horizons
FROM registry WHERE stage = 'production' AND status = 'active'""")
def _(spark, sf):
    return serving.health(fx.readings(spark, sf), fx.registry(spark, sf))


@query("a36_history_envelope", f"""WITH $readings SELECT location, count(*) AS record_count, 7 AS days
FROM readings WHERE {LAST_WEEK} GROUP BY location""")
def _(spark, sf):
    return serving.history_envelope(fx.readings(spark, sf), 7)


WEIGHTS = {"24h": {"pm2_5": 0.0625, "aqi_lag_1h": 0.25}, "48h": {"pm2_5_rolling_max_48h": 0.015625},
           "72h": {"pm2_5_lag_48h": -0.5, "hour": 0.5}}
INTERCEPT = 0.5
FORECAST_SQL = " UNION ALL ".join(
    f"""SELECT location, '{h}' AS horizon, timestamp + INTERVAL {h[:-1]} HOURS AS forecast_time,
        least(5e0, greatest(1e0, 0.5e0 + {' + '.join(f'{n} * {w}e0' for n, w in ws.items())})) AS p FROM last_rows"""
    for h, ws in WEIGHTS.items())


@query("m14_forecast_of_fixed_model", f"""WITH $readings, recent AS (
  SELECT *, count(*) OVER (PARTITION BY location) AS n FROM (
    SELECT *, row_number() OVER (PARTITION BY location ORDER BY timestamp DESC, seq DESC) AS back FROM readings) t
  WHERE back <= 100),
feats AS (
  SELECT location, timestamp, back, n, pm2_5, hour(timestamp) AS hour,
         coalesce(lag(aqi, 1) {OVER}, 0) AS aqi_lag_1h, coalesce(lag(pm2_5, 48) {OVER}, 0) AS pm2_5_lag_48h,
         max(pm2_5) {frame(48)} AS pm2_5_rolling_max_48h FROM recent),
last_rows AS (SELECT * FROM feats WHERE back = 1 AND n >= 50),
scored AS ({FORECAST_SQL})
SELECT location, horizon, forecast_time, CAST(printf('%.2f', p) AS DOUBLE) AS predicted_aqi, CAST(printf('%.1f', p) AS DOUBLE) AS display_aqi,
       {category_sql('p')} AS aqi_category, {colour_sql('p')} AS color, CAST(NULL AS VARCHAR) AS confidence
FROM scored""")
def _(spark, sf):
    rows = serving.serving_rows(fx.readings(spark, sf))
    return serving.forecast(rows, {h: serving.linear_scorer(w, INTERCEPT) for h, w in WEIGHTS.items()})


@query("j4_fan_out_to_horizons", """WITH $readings SELECT seq, location, h.horizon, timestamp + to_hours(h.hours) AS forecast_time
FROM readings, (VALUES ('24h', 24), ('48h', 48), ('72h', 72)) h(horizon, hours)""")
def _(spark, sf):
    horizons = F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.lit(plans.hours_of(h)).alias("hours")) for h in V.HORIZONS])).alias("h")
    df = fx.readings(spark, sf).select("seq", "location", "timestamp", horizons)
    later = F.timestamp_add("HOUR", F.col("h.hours"), F.col("timestamp"))
    return df.select("seq", "location", "h.horizon", later.alias("forecast_time"))
