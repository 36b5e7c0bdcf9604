"""Scalar functions, predicates and column selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeway.functions import bands, calendar, derived
from breezeway.functions import fixed_values as V
from breezeway.operators import shape
from breezeway.plans.features import full_features
from catalog import fixtures as fx
from catalog import query, r
from catalog.features import CALENDAR_SQL, FULL_SQL, category_sql, colour_sql, message_sql, rounded
from catalog.windows import S


def events_with(*columns):
    """A query of event ids and the given columns (name -> builder of an expression)."""
    def build(spark, sf):
        df = fx.events(spark, sf)
        return df.select("event_id", *[f().alias(n) for n, f in columns])

    return build


def on_events(name: str, sql: str, *columns):
    query(name, f"SELECT event_id, {sql} FROM (SELECT *, ts AS timestamp FROM events) e")(events_with(*columns))


ts, value = (lambda: F.col("ts")), (lambda: F.col("value"))
cal = CALENDAR_SQL

on_events("f01_calendar_parts", f"{cal['hour']} AS hour, {cal['day_of_month']} AS day_of_month, {cal['month']} AS month",
          ("hour", lambda: calendar.hour(ts())), ("day_of_month", lambda: F.dayofmonth(ts())),
          ("month", lambda: F.month(ts())))
on_events("f02_day_of_week", f"{cal['day_of_week']} AS day_of_week", ("day_of_week", lambda: calendar.day_of_week(ts())))
on_events("f03_is_weekend", f"{cal['is_weekend']} AS is_weekend", ("is_weekend", lambda: calendar.is_weekend(ts())))
on_events("f04_is_rush_hour", f"{cal['is_rush_hour']} AS is_rush_hour",
          ("is_rush_hour", lambda: calendar.is_rush_hour(ts())))

CYCLES = [c for c in cal if c.endswith(("_sin", "_cos"))]


@query("f05_cyclic_parts", "SELECT event_id, " + ", ".join(f"{cal[c]} AS {c}" for c in CYCLES)
       + " FROM (SELECT *, ts AS timestamp FROM events) e")
def _(spark, sf):
    return rounded(fx.events(spark, sf).select("event_id", *calendar.calendar_columns(F.col("ts"), CYCLES)))


@query("f06_weather_products", """WITH $readings SELECT seq, location, temperature * humidity AS temp_humidity_interaction,
  wind_speed * pressure AS wind_pressure_interaction FROM readings""")
def _(spark, sf):
    df = fx.readings(spark, sf).select("seq", "location", "temperature", "humidity", "wind_speed", "pressure")
    return df.select("seq", "location", *derived.weather_products(df))


@query("f07_pollution_products", f"""WITH $readings SELECT seq, location, pm2_5 * wind_speed AS pm2_5_x_wind,
  pm2_5 * humidity AS pm2_5_x_humidity, pm2_5 * temperature AS pm2_5_x_temp, wind_speed * humidity AS wind_x_humidity,
  temperature * humidity AS temp_x_humidity, {r('pm2_5 / (pm10 + 1)')} AS pm2_5_pm10_ratio FROM readings""")
def _(spark, sf):
    return rounded(fx.readings(spark, sf).select("seq", "location", *derived.pollution_products()))


@query("f08_small_ratio", f"""WITH $readings SELECT seq, location, {r('pm2_5 / (pm10 + 1e-6)')} AS pm2_5_pm10_ratio,
  {r('no2 / (o3 + 1e-6)')} AS no2_o3_ratio FROM readings""")
def _(spark, sf):
    out = fx.readings(spark, sf).select(
        "seq", "location", derived.small_ratio(F.col("pm2_5"), F.col("pm10")).alias("pm2_5_pm10_ratio"),
        derived.small_ratio(F.col("no2"), F.col("o3")).alias("no2_o3_ratio"))
    return rounded(out)


@query("f09_unit_ratio", f"WITH $readings SELECT seq, location, {r('pm2_5 / (pm10 + 1)')} AS pm2_5_pm10_ratio FROM readings")
def _(spark, sf):
    return rounded(fx.readings(spark, sf).select(
        "seq", "location", derived.unit_ratio(F.col("pm2_5"), F.col("pm10")).alias("pm2_5_pm10_ratio")))


def banded_sql(x: str, table: list[tuple]) -> str:
    whens = " ".join(
        f"WHEN {x} BETWEEN {lo}e0 AND {hi}e0 THEN CAST(round_even(({a}e0 - {b}e0) / ({hi}e0 - {lo}e0) * ({x} - {lo}e0) + {b}e0, 0) AS INTEGER)"
        for lo, hi, b, a in table)
    return f"CASE WHEN {x} IS NULL THEN NULL {whens} WHEN {x} > {table[-1][1]}e0 THEN 500 ELSE 0 END"


# Concentrations below zero, in the holes between bands and past the last band occur too.
CONCENTRATION = "value * 2 - 20"
on_events("f10_epa_index_pm25", f"{banded_sql(f'({CONCENTRATION})', V.EPA_PM25)} AS index, {banded_sql('value', V.EPA_PM25)} AS index_of_value",
          ("index", lambda: bands.epa_index_pm25(value() * 2 - 20)),
          ("index_of_value", lambda: bands.epa_index_pm25(value())))
on_events("f11_epa_index_pm10", f"{banded_sql(f'({CONCENTRATION})', V.EPA_PM10)} AS index, {banded_sql('floor(value)', V.EPA_PM10)} AS index_of_whole",
          ("index", lambda: bands.epa_index_pm10(value() * 2 - 20)),
          ("index_of_whole", lambda: bands.epa_index_pm10(F.floor(value()))))

# Half steps from 0.5 to 5.5, so the band limits are hit exactly.
STEP = "(0.5e0 + (event_id % 11) * 0.5e0)"
step = lambda: F.lit(0.5) + (F.col("event_id") % 11) * F.lit(0.5)
on_events("f12_five_step_category", f"{category_sql(STEP)} AS category", ("category", lambda: bands.five_step_category(step())))
on_events("f13_five_step_colour", f"{colour_sql(STEP)} AS color", ("color", lambda: bands.five_step_colour(step())))
on_events("f14_five_step_message", f"{message_sql(STEP)} AS message", ("message", lambda: bands.five_step_message(step())))
on_events("f15_text_colour", f"CASE WHEN {STEP} <= 2.5 THEN 'black' ELSE 'white' END AS text_color",
          ("text_color", lambda: bands.five_step_text_colour(step())))


def epa_sql(x: str, field: int, quote: str = "'") -> str:
    whens = " ".join(
        f"WHEN {x} <= {b[0]} THEN {quote}{b[field]}{quote}" for b in V.EPA_BANDS[:-1])
    return f"CASE {whens} ELSE {quote}{V.EPA_BANDS[-1][field]}{quote} END"


@query("f16_epa_record", f"""SELECT event_id, {epa_sql('value', 1)} AS category, {epa_sql('value', 2)} AS color,
  {epa_sql('value', 3, '')} AS level, {epa_sql('value', 4)} AS message FROM events""")
def _(spark, sf):
    return fx.events(spark, sf).select("event_id", bands.epa_record(F.col("value")).alias("b")).select("event_id", "b.*")


on_events("f17_epa_short_category", epa_sql("value", 1).replace("Unhealthy for Sensitive Groups", "Unhealthy for Sensitive") + " AS category",
          ("category", lambda: bands.epa_short_category(value())))

RANGES = "(VALUES ('good', 0, 50), ('moderate', 51, 100), ('unhealthy_sensitive', 101, 150), ('unhealthy', 151, 200), " \
         "('very_unhealthy', 201, 300), ('hazardous', 301, 500)) b(name, low, high)"


@query("f18_index_ranges", f"""SELECT b.name, b.low, b.high, count(e.event_id) AS n FROM {RANGES}
LEFT JOIN events e ON CAST(floor(e.value) AS BIGINT) BETWEEN b.low AND b.high GROUP BY ALL""")
def _(spark, sf):
    named = fx.events(spark, sf).groupBy(bands.index_range_name(F.floor("value")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return bands.index_range_table(spark).join(named, "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))


TEXT = "CASE WHEN event_id % 6 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END"
on_events("f19_parse_timestamp", f"coalesce(try_cast({TEXT} AS TIMESTAMP), TIMESTAMP '2024-02-01') AS parsed",
          ("parsed", lambda: calendar.parse_or(
              F.when(F.col("event_id") % 6 == 0, "not a time").otherwise(calendar.display(ts())),
              F.lit("2024-02-01").cast("timestamp"))))
on_events("f20_format_timestamp", "strftime(ts, '%Y-%m-%d %H:%M:%S') AS shown", ("shown", lambda: calendar.display(ts())))
HORIZON = "CASE event_id % 4 WHEN 0 THEN '24h' WHEN 1 THEN '48h' WHEN 2 THEN '72h' ELSE 'all' END"
horizon = lambda: (F.when(F.col("event_id") % 4 == 0, "24h").when(F.col("event_id") % 4 == 1, "48h")
                   .when(F.col("event_id") % 4 == 2, "72h").otherwise("all"))
on_events("f21_horizon_hours", f"try_cast(replace({HORIZON}, 'h', '') AS INTEGER) AS hours",
          ("hours", lambda: calendar.horizon_hours(horizon())))
on_events("f22_forecast_time", "ts + to_hours(24 * (event_id % 3 + 1)) AS forecast_time",
          ("forecast_time", lambda: calendar.hours_after(ts().cast("timestamp"), (F.lit(24) * (F.col("event_id") % 3 + 1)).cast("int"))))
PREDICTED = "greatest(1e0, least(5e0, value / 40))"
predicted = lambda: bands.clip_index(value() / 40)
on_events("f23_display_rounding", f"CAST(printf('%.2f', {PREDICTED}) AS DOUBLE) AS two_places, "
          f"CAST(printf('%.1f', {PREDICTED}) AS DOUBLE) AS one_place, {category_sql(PREDICTED)} AS category",
          ("two_places", lambda: bands.display_round(predicted(), 2)),
          ("one_place", lambda: bands.display_round(predicted(), 1)),
          ("category", lambda: bands.five_step_category(predicted())))
on_events("f24_version_stamp", "strftime(ts, 'v%Y%m%d_%H%M') AS version", ("version", lambda: calendar.version_stamp(ts())))
on_events("f25_minutes_since", "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 60000000e0 AS minutes",
          ("minutes", lambda: calendar.minutes_between(ts(), F.lit("2024-01-01").cast("timestamp"))))
on_events("f26_json_path", "CAST(json_extract(props, '$.k') AS INTEGER) AS k",
          ("k", lambda: F.from_json("props", "k int")["k"]))
on_events("f27_regex_match", "regexp_matches(event_type, 'i[a-z]*n|ck') AS matches",
          ("matches", lambda: F.col("event_type").rlike("i[a-z]*n|ck")))


# Column selection and missing values.

@query("p01_feature_selection", """WITH $readings SELECT pm2_5, pm10, temperature, humidity, pressure, wind_speed, clouds
FROM readings""")
def _(spark, sf):
    df = fx.readings(spark, sf)
    return df.select(*shape.feature_names(df, V.NOT_FEATURES_ADAPTIVE))


MODEL_INPUT = ["pm2_5", "pm10", "co", "no2", "o3", "so2", "temperature", "humidity", "pressure", "wind_speed",
               "hour", "day_of_week", "day_of_month", "month", "is_weekend", "hour_sin", "hour_cos", "month_sin", "month_cos",
               *[f"{c}_lag_{n}h" for c in ("pm2_5", "pm10", "aqi") for n in (1, 3, 6, 12, 24)],
               "pm2_5_rolling_24h_mean", "pm2_5_rolling_24h_std", "pm10_rolling_24h_mean", "aqi_rolling_24h_mean",
               "temp_humidity_interaction", "wind_pressure_interaction", "pm2_5_pm10_ratio", "no2_o3_ratio"]


@query("p02_fixed_model_input", f"WITH $readings, f AS (SELECT {FULL_SQL}, co, so2 FROM readings) SELECT {', '.join(MODEL_INPUT)} FROM f")
def _(spark, sf):
    return rounded(full_features(fx.readings(spark, sf), None, S).select(*shape.model_input_names()))


SOME = "seq, location, pm2_5, no2, o3, wind_gust"


@query("p03_drop_rows_missing_any", f"""WITH $readings SELECT {SOME} FROM readings
WHERE no2 IS NOT NULL AND o3 IS NOT NULL AND wind_gust IS NOT NULL""")
def _(spark, sf):
    return shape.drop_missing(fx.readings(spark, sf).select(*SOME.split(", ")))


@query("p04_drop_rows_missing_subset", f"WITH $readings SELECT {SOME} FROM readings WHERE no2 IS NOT NULL")
def _(spark, sf):
    return shape.drop_missing(fx.readings(spark, sf).select(*SOME.split(", ")), ["no2"])


@query("p05_complete_features_and_target", """WITH $readings, t AS (SELECT seq, location, pm2_5, no2,
  lead(aqi, 24) OVER (PARTITION BY location ORDER BY timestamp, seq) AS aqi_24h_ahead FROM readings)
SELECT * FROM t WHERE pm2_5 IS NOT NULL AND no2 IS NOT NULL AND aqi_24h_ahead IS NOT NULL""")
def _(spark, sf):
    from breezeway.operators.windows import with_targets

    df = with_targets(fx.readings(spark, sf).select("seq", "location", "timestamp", "pm2_5", "no2", "aqi"), [24], S)
    return shape.drop_missing(df, ["pm2_5", "no2", "aqi_24h_ahead"]).drop("timestamp", "aqi")


@query("p06_fill_missing", """WITH $readings SELECT seq, location, coalesce(no2, 0) AS no2, coalesce(o3, 0) AS o3 FROM readings""")
def _(spark, sf):
    return shape.fill_missing(fx.readings(spark, sf).select("seq", "location", "no2", "o3"), ["no2", "o3"])


@query("p07_add_absent_columns", "WITH $readings SELECT seq, location, clouds, 0e0 AS dew_point FROM readings")
def _(spark, sf):
    return shape.ensure_columns(fx.readings(spark, sf).select("seq", "location", "clouds"), ["clouds", "dew_point"])


@query("p08_defaults", "WITH $readings SELECT seq, coalesce(source, 'Karachi') AS source, coalesce(no2, 0) AS no2 FROM readings")
def _(spark, sf):
    return shape.with_defaults(fx.readings(spark, sf).select("seq", "source", "no2"), {"source": "Karachi", "no2": 0.0})


@query("p09_where_present", "WITH $readings SELECT seq, source FROM readings WHERE source IS NOT NULL")
def _(spark, sf):
    return shape.where_present(fx.readings(spark, sf).select("seq", "source"), "source")


@query("p10_drop_columns", "WITH $readings SELECT seq, location, pm2_5 FROM readings")
def _(spark, sf):
    df = fx.readings(spark, sf).select("seq", "location", "pm2_5", "batch_id", "source", "ingestion_timestamp")
    return shape.drop_columns(df, V.METADATA_COLUMNS)


@query("p11_resolve_target", "WITH $readings SELECT seq, location, pm2_5 AS target, pm2_5 AS aqi FROM readings")
def _(spark, sf):
    df = fx.readings(spark, sf).select("seq", "location", F.col("pm2_5").alias("target"))
    return shape.resolve_target(df)


CHECKED = ["pm2_5", "pm10", "humidity"]
RAW_TEXT = """SELECT event_id,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'abc' WHEN event_id % 17 = 0 THEN '-5'
       ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS pm2_5,
  CASE WHEN event_id % 5 = 0 THEN -1e0 WHEN event_id % 4 <> 0 THEN value END AS pm10, event_id - 50 AS humidity FROM events"""
RULES = " ".join(
    f"WHEN {c} IS NULL THEN 'Missing required feature: {c}' "
    + (f"WHEN try_cast({c} AS DOUBLE) IS NULL THEN 'Invalid type for {c}: expected number' " if c == "pm2_5" else "")
    + f"WHEN try_cast({c} AS DOUBLE) < 0 THEN 'Invalid value for {c}: must be non-negative'" for c in CHECKED)


@query("p13_row_check", f"""WITH t AS ({RAW_TEXT}), c AS (SELECT *, CASE {RULES} ELSE '' END AS error FROM t)
SELECT *, error = '' AS valid FROM c""")
def _(spark, sf):
    e = F.col("event_id")
    text = (F.when(e % 11 == 0, None).when(e % 13 == 0, "abc").when(e % 17 == 0, "-5")
            .otherwise(F.floor("value").cast("string")))
    number = F.when(e % 5 == 0, -1.0).when(e % 4 != 0, F.col("value"))
    df = fx.events(spark, sf).select("event_id", text.alias("pm2_5"), number.alias("pm10"), (e - 50).alias("humidity"))
    return derived.with_row_check(df, CHECKED)


on_events("p14_index_in_range", "value * 2 - 20 BETWEEN 0 AND 500 AS valid", ("valid", lambda: derived.in_index_range(value() * 2 - 20)))
on_events("p15_valid_coordinates", "value - 100 BETWEEN -90 AND 90 AND user_id * 3 - 200 BETWEEN -180 AND 180 AS valid",
          ("valid", lambda: derived.valid_coordinates(value() - 100, F.col("user_id") * 3 - 200)))


@query("p16_known_horizons", f"SELECT * FROM (SELECT event_id, {HORIZON} AS horizon FROM events) t WHERE horizon IN ('24h', '48h', '72h')")
def _(spark, sf):
    return shape.known_horizons(fx.events(spark, sf).select("event_id", horizon().alias("horizon")))


on_events("p17_clip", "greatest(1e0, least(5e0, value / 32 - 1)) AS clipped", ("clipped", lambda: bands.clip_index(value() / 32 - 1)))
