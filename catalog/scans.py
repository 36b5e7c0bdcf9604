"""Scans, sinks, deletes and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeway.functions import fixed_values as V
from breezeway.operators import dedup
from breezeway.plans import registry as models
from breezeway.schemas import READINGS
from breezeway.session import scratch_path
from breezeway.sources import landing, readings as scans
from breezeway.sources.store import ReadingStore
from catalog import fixtures as fx
from catalog import query

ALL = "seq, location, source, timestamp, aqi, pm2_5, pm10"
COLUMNS = ALL.split(", ")


def rows(spark, sf):
    return fx.readings(spark, sf).select(*COLUMNS)


@query("s01_scan_in_time_order", "SELECT event_id, ts, user_id, value FROM events ORDER BY ts, event_id")
def _(spark, sf):
    df = scans.read_table(spark, f"{sf}/events.parquet").withColumnsRenamed({"ts": "timestamp", "event_id": "seq"})
    out = scans.in_time_order(df.select("seq", "timestamp", "user_id", "value"))
    return out.withColumnsRenamed({"timestamp": "ts", "seq": "event_id"})


@query("s02_scan_unordered", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def _(spark, sf):
    return scans.read_table(spark, f"{sf}/events.parquet")


@query("s03_scan_in_insertion_order", "SELECT event_id, value FROM events ORDER BY event_id")
def _(spark, sf):
    return scans.in_insertion_order(fx.events(spark, sf).select("event_id", "value"), "event_id")


@query("s04_scan_of_source", "SELECT event_id, ts, value FROM events WHERE event_type = 'click'")
def _(spark, sf):
    return scans.of_source(fx.events(spark, sf), "click", "event_type").select("event_id", "ts", "value")


VERSIONED = """WITH $readings, v AS (
  SELECT seq, location, pm2_5, CASE WHEN seq % 2 = 0 THEN '{even}' ELSE 'v2' END AS model_version FROM readings)
SELECT * FROM v WHERE model_version = 'v1' OR NOT EXISTS (SELECT 1 FROM v WHERE model_version = 'v1')"""


def versioned(spark, sf, even):
    df = fx.with_versions(fx.readings(spark, sf).select("seq", "location", "pm2_5"), even)
    return scans.of_version_or_all(df, "v1")


@query("s05_scan_of_version", VERSIONED.format(even="v1"))
def _(spark, sf):
    return versioned(spark, sf, "v1")


@query("s05_scan_of_version_fallback", VERSIONED.format(even="v3"))
def _(spark, sf):
    return versioned(spark, sf, "v3")


@query("s06_scan_last_days", f"""WITH $readings
SELECT {ALL} FROM readings WHERE timestamp >= (SELECT max(timestamp) FROM readings) - INTERVAL 7 DAYS""")
def _(spark, sf):
    return scans.since_days(rows(spark, sf), 7)


@query("s06_scan_since_date", "SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAYS")
def _(spark, sf):
    end = F.lit("2024-01-30").cast("timestamp_ntz")
    return scans.since_days(fx.events(spark, sf), 7, end, ts="ts").select("event_id", "ts", "value")


@query("s07_latest_reading", f"""WITH $readings SELECT {ALL} FROM (
  SELECT *, row_number() OVER (PARTITION BY location ORDER BY timestamp DESC, seq DESC) AS k FROM readings) t
WHERE k = 1""")
def _(spark, sf):
    return scans.latest(rows(spark, sf))


@query("s08_latest_by_ingestion", """WITH $readings SELECT seq, location, ingestion_timestamp, batch_id FROM (
  SELECT *, row_number() OVER (PARTITION BY location ORDER BY ingestion_timestamp DESC, seq DESC) AS k
  FROM readings) t WHERE k = 1""")
def _(spark, sf):
    df = fx.readings(spark, sf).select("seq", "location", "ingestion_timestamp", "batch_id")
    return scans.latest(df, by=["ingestion_timestamp", "seq"])


@query("s09_latest_100", f"WITH $readings SELECT {ALL} FROM readings ORDER BY timestamp DESC, seq DESC LIMIT 100")
def _(spark, sf):
    return scans.latest_n(rows(spark, sf), 100)


@query("s09_latest_100_each", f"""WITH $readings SELECT {ALL} FROM (
  SELECT *, row_number() OVER (PARTITION BY location ORDER BY timestamp DESC, seq DESC) AS k FROM readings) t
WHERE k <= 100""")
def _(spark, sf):
    return scans.latest_n_each(rows(spark, sf), 100)


@query("s10_project_one_column", "SELECT value FROM events")
def _(spark, sf):
    return scans.read_table(spark, f"{sf}/events.parquet").select("value")


@query("s11_sample_report", "WITH $readings SELECT timestamp, aqi, pm2_5 FROM readings ORDER BY seq LIMIT 10")
def _(spark, sf):
    return scans.sample_report(rows(spark, sf), V.REPORT_TIME_CANDIDATES)


@query("s11_first_rows", "SELECT event_id, ts, value FROM events ORDER BY event_id LIMIT 100")
def _(spark, sf):
    return scans.first_rows(fx.events(spark, sf), 100, "event_id").select("event_id", "ts", "value")


@query("s12_merge_payloads", """WITH $sensor_rows
SELECT location, seq, timestamp, aqi, pm2_5, pm10,
       CASE WHEN seq % 2 <> 0 THEN pm2_5 + 1 END AS co, CAST(NULL AS DOUBLE) AS no, clouds AS no2,
       CAST(NULL AS DOUBLE) AS o3, CAST(NULL AS DOUBLE) AS so2,
       temperature, temperature AS feels_like, temperature - 1 AS temp_min, temperature + 1 AS temp_max,
       humidity, pressure, wind_speed,
       CASE WHEN seq % 4 = 1 THEN 0e0 ELSE humidity END AS wind_direction,
       CASE WHEN seq % 3 <> 0 THEN wind_speed * 2 END AS wind_gust, clouds,
       CAST(NULL AS DOUBLE) AS visibility, 'Clear' AS weather_main, 'clear sky' AS weather_description,
       'openweather' AS source
FROM sensor_rows WHERE seq % 9 <> 0 AND seq % 10 <> 0 AND seq % 8 <> 3""")
def _(spark, sf):
    return landing.merge_payloads(*fx.landed(spark, sf))


def stored(spark, sf):
    """A store in the shared folder that holds all readings."""
    store = ReadingStore(spark, scratch_path(spark, "readings"), READINGS)
    store.append(fx.readings(spark, sf))
    return store


@query("s13_append", f"""WITH $readings SELECT {ALL} FROM readings
UNION ALL SELECT seq + 1000000000 AS seq, location, source, timestamp, aqi, pm2_5, pm10 FROM readings""")
def _(spark, sf):
    store = stored(spark, sf)
    store.append(fx.readings(spark, sf).withColumn("seq", F.col("seq") + 1000000000))
    return store.read().select(*COLUMNS)


@query("s14_append_stamped", """WITH $readings
SELECT location, count(*) AS n, count(*) AS ids, TIMESTAMP '2024-03-01' AS timestamp FROM readings GROUP BY location""")
def _(spark, sf):
    store = ReadingStore(spark, scratch_path(spark, "readings"), READINGS)
    store.append_stamped(fx.readings(spark, sf), batch=1, at=F.lit("2024-03-01").cast("timestamp"))
    return store.read().groupBy("location").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("seq").alias("ids"), F.max("timestamp").alias("timestamp"))


@query("s15_delete_ids", f"WITH $readings SELECT {ALL} FROM readings WHERE seq % 3 <> 0")
def _(spark, sf):
    store = stored(spark, sf)
    ids = store.read().filter(F.col("seq") % 3 == 0).select("seq")
    store.delete_ids(ids)
    return store.read().select(*COLUMNS)


@query("s16_delete_sources", f"""WITH $readings SELECT {ALL} FROM readings
WHERE source IS NULL OR source NOT IN ('openweathermap_live', 'openweather')""")
def _(spark, sf):
    return dedup.delete_sources(rows(spark, sf), ["openweathermap_live", "openweather"])


@query("s17_delete_matching_sources", f"""WITH $readings SELECT {ALL} FROM readings
WHERE source IS NULL OR NOT regexp_matches(source, 'openweather')""")
def _(spark, sf):
    return dedup.delete_matching(rows(spark, sf), "openweather")


@query("s18_delete_all", "SELECT CAST(0 AS BIGINT) AS n, count(*) AS earlier_rows FROM (SELECT DISTINCT user_id % 4, date_trunc('hour', ts) FROM events) t")
def _(spark, sf):
    store = stored(spark, sf)
    before = store.read()
    store.delete_all()
    kept = store.read().agg(F.count(F.lit(1)).alias("n"))
    return kept.select("n", before.agg(F.count(F.lit(1))).scalar().alias("earlier_rows"))


@query("j1_anti_join_ids", """WITH $sensor_rows
SELECT seq, location, pm2_5 FROM sensor_rows s
WHERE NOT EXISTS (SELECT 1 FROM sensor_rows d WHERE d.seq = s.seq AND d.pm2_5 > 100)""")
def _(spark, sf):
    df = fx.sensor_rows(spark, sf).select("seq", "location", "pm2_5")
    return dedup.delete_ids(df, df.filter(F.col("pm2_5") > 100))


@query("j2_join_payloads", """WITH $sensor_rows SELECT location, seq AS fetch_id, aqi, pm2_5, temperature
FROM sensor_rows WHERE seq % 10 <> 0""")
def _(spark, sf):
    air, weather = fx.landed(spark, sf)
    joined = landing.parse_air(air).join(landing.parse_weather(weather), ["location", "fetch_id"])
    return joined.filter("aqi is not null").select("location", "fetch_id", "aqi", "pm2_5", "temperature")


@query("j3_wanted_versions", """WITH $registry, wanted AS (
  SELECT model_name, CASE WHEN model_name LIKE '%48h' THEN 'none' ELSE max(version) END AS version
  FROM registry GROUP BY model_name)
SELECT w.model_name, w.version, r.stage, r.status, r.mae
FROM wanted w LEFT JOIN registry r ON w.model_name = r.model_name AND w.version = r.version""")
def _(spark, sf):
    registry = fx.registry(spark, sf)
    wanted = registry.groupBy("model_name").agg(F.max("version").alias("version")).withColumn(
        "version", F.when(F.col("model_name").endswith("48h"), "none").otherwise(F.col("version")))
    out = models.wanted_versions(registry, wanted)
    return out.select("model_name", "version", "stage", "status", F.try_element_at("metrics", F.lit("mae")).alias("mae"))
