"""Window columns, runs, fills and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeway.operators import windows as win
from breezeway.operators.series import Series, with_windows
from breezeway.plans.features import adaptive_targets
from breezeway.sources.readings import latest_n_each
from catalog import fixtures as fx
from catalog import query, r

S = Series()
OVER = "OVER (PARTITION BY location ORDER BY timestamp, seq)"
IDS = ["seq", "location"]


def frame(n: int) -> str:
    return f"OVER (PARTITION BY location ORDER BY timestamp, seq ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def lag_sql(columns, lags) -> list[str]:
    return [f"lag({c}, {n}) {OVER} AS {c}_lag_{n}h" for n in lags for c in columns]


def full_mean_sql(c: str, n: int) -> str:
    return f"CASE WHEN count({c}) {frame(n)} = {n} THEN avg({c}) {frame(n)} END AS {c}_rolling_mean_{n}h"


def select_sql(columns: list[str], table: str = "readings") -> str:
    return f"WITH ${table} SELECT seq, location, {', '.join(columns)} FROM {table}"


def base(spark, sf, *columns):
    return fx.readings(spark, sf).select("seq", "location", "timestamp", *columns)


def over(df, build, back):
    """Ids and the built columns."""
    names = df.columns
    out = with_windows(df, build, S, back=back)
    return out.select(*IDS, *[c for c in out.columns if c not in names])


def rolled(df, parts):
    names = df.columns
    out = win.with_rolling(df, parts, SIZES, S)
    return out.select(*IDS, *[c for c in out.columns if c not in names])


def _lags(which):
    columns, lags = win.LAG_SETS[which]

    def build(spark, sf):
        df = base(spark, sf, *columns)
        out = win.with_lags(df, which, S)
        return out.select(*IDS, *[c for c in out.columns if "_lag_" in c])

    return build


query("w01_lags", select_sql(lag_sql(*win.LAG_SETS["full"])))(_lags("full"))
query("w02_short_lags", select_sql(lag_sql(*win.LAG_SETS["simple"])))(_lags("simple"))
query("w03_long_lags", select_sql(lag_sql(*win.LAG_SETS["advanced"])))(_lags("advanced"))
query("w03_long_lags_of_sensor_rows", select_sql(lag_sql(*win.LAG_SETS["advanced"]), "sensor_rows"))(
    lambda spark, sf: win.with_lags(
        fx.sensor_rows(spark, sf).select("seq", "location", "timestamp", "pm2_5", "pm10", "aqi"), "advanced", S
    ).drop("timestamp", "pm2_5", "pm10", "aqi"))


@query("w04_day_rolling_mean", select_sql(
    [f"avg({c}) {frame(24)} AS {c}_rolling_24h_mean" for c in ("pm2_5", "pm10", "aqi")]))
def _(spark, sf):
    out = win.with_day_rolling(base(spark, sf, "pm2_5", "pm10", "aqi"), ["pm2_5", "pm10", "aqi"], S)
    return out.select(*IDS, *[f"{c}_rolling_24h_mean" for c in ("pm2_5", "pm10", "aqi")])


@query("w05_day_rolling_std", select_sql(
    [r(f"coalesce(stddev_samp(pm2_5) {frame(24)}, 0)") + " AS pm2_5_rolling_24h_std"]))
def _(spark, sf):
    out = win.with_day_rolling(base(spark, sf, "pm2_5"), ["pm2_5"], S)
    return out.select(*IDS, F.round("pm2_5_rolling_24h_std", 6).alias("pm2_5_rolling_24h_std"))


@query("w06_full_rolling_mean", select_sql([full_mean_sql(c, n) for n in (3, 6) for c in ("aqi", "pm2_5", "no2")]))
def _(spark, sf):
    return over(base(spark, sf, "aqi", "pm2_5", "no2"),
                lambda w: win.full_mean_columns(w, ["aqi", "pm2_5", "no2"], [3, 6]), 6)


SIZES = [3, 6, 12, 24, 48]


@query("w07_rolling_mean", select_sql(
    [f"avg({c}) {frame(n)} AS {c}_rolling_mean_{n}h" for n in SIZES for c in ("pm2_5", "aqi")]))
def _(spark, sf):
    return rolled(base(spark, sf, "pm2_5", "aqi"), {"pm2_5": ["mean"], "aqi": ["mean"]})


@query("w07_rolling_mean_with_missing_values", select_sql(
    [f"{h}({c}) {frame(n)} AS {c}_rolling_{k}_{n}h" for n in SIZES for c in ("no2", "so2")
     for h, k in (("avg", "mean"), ("max", "max"))]))
def _(spark, sf):
    return rolled(base(spark, sf, "no2", "so2"), {"no2": ["mean", "max"], "so2": ["mean", "max"]})


@query("w08_rolling_std", select_sql(
    [r(f"stddev_samp({c}) {frame(n)}") + f" AS {c}_rolling_std_{n}h" for n in SIZES for c in ("pm2_5", "aqi")]))
def _(spark, sf):
    out = rolled(base(spark, sf, "pm2_5", "aqi"), {"pm2_5": ["std"], "aqi": ["std"]})
    return out.select(*IDS, *[F.round(c, 6).alias(c) for c in out.columns if c not in IDS])


@query("w09_rolling_extremes", select_sql(
    [f"{h}(pm2_5) {frame(n)} AS pm2_5_rolling_{h}_{n}h" for n in SIZES for h in ("max", "min")]))
def _(spark, sf):
    return rolled(base(spark, sf, "pm2_5"), {"pm2_5": ["max", "min"]})


@query("w10_changes", select_sql([f"pm2_5 - lag(pm2_5, {n}) {OVER} AS pm2_5_change_{n}h" for n in (1, 3, 6)]))
def _(spark, sf):
    return over(base(spark, sf, "pm2_5"), win.change_columns, 6)


@query("w11_weather_changes", select_sql([
    f"temperature - lag(temperature, 1) {OVER} AS temp_change",
    f"wind_speed - lag(wind_speed, 1) {OVER} AS wind_change",
    f"pressure - lag(pressure, 1) {OVER} AS pressure_change"]))
def _(spark, sf):
    return over(base(spark, sf, "temperature", "wind_speed", "pressure"), win.weather_change_columns, 1)


@query("w12_gap_to_previous", select_sql(
    [f"epoch_us(timestamp) - epoch_us(lag(timestamp) {OVER}) AS gap_micros"], "sensor_rows"))
def _(spark, sf):
    return win.with_gap(fx.sensor_rows(spark, sf).select("seq", "location", "timestamp"), S).drop("timestamp")


RUNS_SQL = f"""gaps AS (
  SELECT seq, location, timestamp, epoch_us(timestamp) - epoch_us(lag(timestamp) {OVER}) AS gap FROM readings
), numbered AS (
  SELECT seq, location, timestamp,
         CAST(sum(CASE WHEN gap <= 5400000000 THEN 0 ELSE 1 END) {OVER} AS BIGINT) AS run_id FROM gaps
)"""


@query("w13_run_ids", f"WITH $readings, {RUNS_SQL} SELECT seq, location, run_id FROM numbered")
def _(spark, sf):
    return win.with_run_id(base(spark, sf), S).drop("timestamp")


@query("w14_targets", select_sql([f"lead(aqi, {h}) {OVER} AS aqi_{h}h_ahead" for h in (24, 48, 72)]))
def _(spark, sf):
    return win.with_targets(base(spark, sf, "aqi"), [24, 48, 72], S).drop("timestamp", "aqi")


BY_DAY = "OVER (PARTITION BY location, day ORDER BY timestamp, seq)"


# Per station and day: days with all 24 hours forecast, the others take the current index.
@query("w14_adaptive_targets", f"""WITH $readings, d AS (
  SELECT *, CAST(timestamp AS DATE) AS day, epoch_us(timestamp) - epoch_us(lag(timestamp) {BY_DAY.replace('day', 'CAST(timestamp AS DATE)')}) AS gap
  FROM readings),
n AS (SELECT *, lead(aqi, 3) {BY_DAY} AS ahead,
             sum(CASE WHEN gap <= 5400000000 THEN 0 ELSE 1 END) {BY_DAY} AS run FROM d),
runs AS (SELECT location, day, run, count(*) AS k FROM n GROUP BY location, day, run),
q AS (SELECT location, day, CAST(sum(k) AS BIGINT) AS total_records, max(k) AS max_consecutive FROM runs GROUP BY location, day)
SELECT n.seq, n.location, n.day, total_records, max_consecutive,
       CASE WHEN max_consecutive >= 24 THEN ahead ELSE aqi END AS target_aqi_3h,
       CASE WHEN max_consecutive >= 24 THEN 'Forecasting' ELSE 'Nowcasting' END AS model_type
FROM n JOIN q ON n.location = q.location AND n.day = q.day""")
def _(spark, sf):
    df = base(spark, sf, "aqi").withColumn("day", F.to_date("timestamp"))
    out = adaptive_targets(df, ["3h"], Series(key=("location", "day")))
    return out.drop("timestamp", "aqi", "can_use_lags", "can_forecast")


@query("w15_forward_fill", f"""WITH $readings, carried AS (
  SELECT seq, location, timestamp, no2, o3,
         last_value(CASE WHEN no2 IS NOT NULL THEN timestamp END IGNORE NULLS) {OVER} AS t_no2,
         last_value(no2 IGNORE NULLS) {OVER} AS v_no2,
         last_value(CASE WHEN o3 IS NOT NULL THEN timestamp END IGNORE NULLS) {OVER} AS t_o3,
         last_value(o3 IGNORE NULLS) {OVER} AS v_o3
  FROM readings)
SELECT seq, location,
       CASE WHEN timestamp - t_no2 < INTERVAL 3 HOURS THEN v_no2 END AS no2,
       CASE WHEN timestamp - t_o3 < INTERVAL 3 HOURS THEN v_o3 END AS o3
FROM carried""")
def _(spark, sf):
    return win.forward_fill(base(spark, sf, "no2", "o3"), ["no2", "o3"], S).drop("timestamp")


SPLIT_SQL = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY location ORDER BY timestamp, seq) AS k,
         count(*) OVER (PARTITION BY location) AS n FROM readings)"""


@query("w16_time_split", f"WITH $readings, {SPLIT_SQL} SELECT seq, location, k <= floor(n * 0.8e0) AS is_train FROM ranked")
def _(spark, sf):
    return win.with_split(base(spark, sf), S).drop("timestamp")


# The same operators with many entities and a hot one that is split.

FEW = Series(max_rows=fx.FEW_ROWS)


def users(spark, sf, *columns):
    return fx.user_rows(spark, sf).select("seq", "location", "timestamp", *columns)


def of_users(sql: str) -> str:
    return sql.replace("readings", "user_rows")


query("w03_long_lags_of_user_rows", select_sql(lag_sql(*win.LAG_SETS["advanced"]), "user_rows"))(
    lambda spark, sf: win.with_lags(users(spark, sf, "pm2_5", "pm10", "aqi"), "advanced", FEW).drop(
        "timestamp", "pm2_5", "pm10", "aqi"))


@query("w13_run_ids_of_user_rows", of_users(f"WITH $readings, {RUNS_SQL} SELECT seq, location, run_id FROM numbered"))
def _(spark, sf):
    return win.with_run_id(users(spark, sf), FEW).drop("timestamp")


@query("w15_forward_fill_of_user_rows", f"""WITH $user_rows, holed AS (
  SELECT seq, location, timestamp, CASE WHEN seq % 5 <> 0 THEN pm10 END AS pm10 FROM user_rows),
carried AS (SELECT *, last_value(CASE WHEN pm10 IS NOT NULL THEN timestamp END IGNORE NULLS) {OVER} AS t,
  last_value(pm10 IGNORE NULLS) {OVER} AS v FROM holed)
SELECT seq, location, CASE WHEN timestamp - t < INTERVAL 3 HOURS THEN v END AS pm10 FROM carried""")
def _(spark, sf):
    holed = users(spark, sf, F.when(F.col("seq") % 5 != 0, F.col("pm10")).alias("pm10"))
    return win.forward_fill(holed, ["pm10"], FEW).drop("timestamp")


@query("w16_time_split_of_user_rows", of_users(
    f"WITH $readings, {SPLIT_SQL} SELECT seq, location, k <= floor(n * 0.8e0) AS is_train FROM ranked"))
def _(spark, sf):
    return win.with_split(users(spark, sf), FEW).drop("timestamp")


@query("w17_last_feature_row", f"""WITH $readings, recent AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY timestamp DESC, seq DESC) AS back
                 FROM readings) t WHERE back <= 100),
feats AS (SELECT seq, location, back, pm2_5, lag(pm2_5, 48) {OVER} AS pm2_5_lag_48h,
                 avg(pm2_5) {frame(48)} AS pm2_5_rolling_mean_48h FROM recent)
SELECT seq, location, pm2_5, pm2_5_lag_48h, pm2_5_rolling_mean_48h FROM feats WHERE back = 1""")
def _(spark, sf):
    recent = latest_n_each(base(spark, sf, "pm2_5"), 100, S)
    out = with_windows(recent, lambda w: [
        F.lag("pm2_5", 48).over(w).alias("pm2_5_lag_48h"),
        win.rolling(w, "pm2_5", 48, "mean").alias("pm2_5_rolling_mean_48h")], S, back=48)
    return latest_n_each(out, 1, S).drop("timestamp")


@query("o1_order_within_entity", """WITH $sensor_rows SELECT seq, location,
  row_number() OVER (PARTITION BY location ORDER BY timestamp, seq) AS place FROM sensor_rows""")
def _(spark, sf):
    from breezeway.operators.series import with_positions

    df = fx.sensor_rows(spark, sf).select("seq", "location", "timestamp")
    return with_positions(df, S, "place", "_n").drop("timestamp", "_n")


@query("o2_top_rows", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def _(spark, sf):
    return fx.events(spark, sf).select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(10)
