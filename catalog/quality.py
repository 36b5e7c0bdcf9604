"""Counts, gates, gaps, runs, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeway.operators.series import Series
from breezeway.functions.bands import scale_of_value
from breezeway.functions.fixed_values import TARGET_CANDIDATES
from breezeway.operators import dedup, quality
from breezeway.operators.shape import drop_missing
from catalog import fixtures as fx
from catalog import query, r
from catalog.windows import OVER, RUNS_SQL, S


@query("a01_row_count", "SELECT count(*) AS n FROM events")
def _(spark, sf):
    return quality.row_count(fx.events(spark, sf))


@query("a01_row_count_where", "WITH $readings SELECT count(*) AS n FROM readings WHERE regexp_matches(source, 'openweather')")
def _(spark, sf):
    return quality.row_count(fx.readings(spark, sf), F.col("source").rlike("openweather"))


@query("a02_count_by_source", "WITH $readings SELECT source, count(*) AS n FROM readings GROUP BY source")
def _(spark, sf):
    return quality.count_by(fx.readings(spark, sf), "source")


@query("a03_count_by_known_source",
       "WITH $readings SELECT source, count(*) AS n FROM readings WHERE source IS NOT NULL GROUP BY source")
def _(spark, sf):
    return quality.count_by(fx.readings(spark, sf), "source", present_only=True)


@query("a04_field_range", """WITH $readings SELECT min(no2) AS min_value, max(no2) AS max_value,
  avg(no2) AS avg_value, count(no2) AS count FROM readings""")
def _(spark, sf):
    return quality.field_range(fx.readings(spark, sf), "no2")


@query("a05_field_range_missing_as_zero", """WITH $readings SELECT min(coalesce(no2, 0)) AS min_value,
  max(coalesce(no2, 0)) AS max_value, avg(coalesce(no2, 0)) AS avg_value FROM readings""")
def _(spark, sf):
    return quality.field_range_missing_as_zero(fx.readings(spark, sf), "no2")


@query("a06_time_field_span", """WITH $readings
SELECT 'timestamp' AS field, count(timestamp) AS n, min(timestamp) AS oldest, max(timestamp) AS newest FROM readings
UNION ALL SELECT 'ingestion_timestamp', count(ingestion_timestamp), min(ingestion_timestamp),
  max(ingestion_timestamp) FROM readings""")
def _(spark, sf):
    df = fx.readings(spark, sf).withColumn("created_at", F.lit(None).cast("timestamp"))
    return quality.field_span(df, ["timestamp", "created_at", "date", "ingestion_timestamp"])


FIELDS = ["seq", "source", "no2", "wind_gust", "aqi"]


@query("a07_field_names", "WITH $readings, first AS (SELECT * FROM readings ORDER BY seq LIMIT 100) " + " UNION ALL ".join(
    f"SELECT '{c}' AS field FROM first HAVING count({c}) > 0" for c in FIELDS))
def _(spark, sf):
    df = fx.readings(spark, sf).select(*FIELDS).withColumn("never", F.lit(None).cast("int"))
    return quality.field_names(df)


@query("a07_field_names_of_json", """SELECT DISTINCT unnest(json_keys(props)) AS field
FROM (SELECT props FROM events ORDER BY event_id LIMIT 100) t""")
def _(spark, sf):
    return quality.field_names_of_json(fx.events(spark, sf), "props", "event_id")


@query("a08_detect_scale", """WITH $readings SELECT 'aqi' AS field, min(aqi) AS min_value, max(aqi) AS max_value,
  avg(aqi) AS avg_value, count(aqi) AS count,
  CASE WHEN max(aqi) <= 5 AND min(aqi) >= 1 THEN '1-5' WHEN max(aqi) <= 500 AND min(aqi) >= 0 THEN 'EPA'
       ELSE 'unusual' END AS scale FROM readings""")
def _(spark, sf):
    return quality.detect_target_scale(fx.readings(spark, sf), TARGET_CANDIDATES)


@query("a08_detect_scale_of_values", """SELECT event_id, CASE WHEN value BETWEEN 1 AND 5 THEN '1-5'
  WHEN value BETWEEN 6 AND 500 THEN 'EPA' WHEN value IS NOT NULL THEN 'unusual' END AS scale FROM events""")
def _(spark, sf):
    return fx.events(spark, sf).select("event_id", scale_of_value(F.col("value")).alias("scale"))


@query("a09_index_stats", f"""WITH $readings SELECT count(*) AS n, min(aqi) AS aqi_min, max(aqi) AS aqi_max,
  {r('stddev_samp(aqi)')} AS aqi_std, count(DISTINCT aqi) AS aqi_unique, min(pm2_5) AS pm2_5_min,
  max(pm2_5) AS pm2_5_max, {r('stddev_samp(pm2_5)')} AS pm2_5_std FROM readings""")
def _(spark, sf):
    out = quality.index_stats(fx.readings(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("aqi_std", "pm2_5_std")})


def gates_sql(by: str) -> str:
    return f"""WITH $readings, g AS (
  SELECT {by + ',' if by else ''} count(*) AS n, round(stddev_samp(aqi), 9) AS sd FROM readings {'GROUP BY ' + by if by else ''})
SELECT {by + ',' if by else ''} n, {r('sd')} AS aqi_std, n < 168 AS few_rows, coalesce(sd < 0.3, false) AS low_variance,
  n >= 100 AS passed, coalesce(n >= 100 AND sd < 0.2, false) AS variance_warning FROM g"""


@query("a10_training_gates", gates_sql(""))
def _(spark, sf):
    return quality.training_gates(fx.readings(spark, sf)).withColumn("aqi_std", F.round("aqi_std", 6))


@query("a10_training_gates_by_day", gates_sql("location, day").replace("FROM readings GROUP", "FROM (SELECT *, timestamp::DATE AS day FROM readings) t GROUP"))
def _(spark, sf):
    df = fx.readings(spark, sf).withColumn("day", F.to_date("timestamp"))
    return quality.training_gates(df, ["location", "day"]).withColumn("aqi_std", F.round("aqi_std", 6))


@query("a11_sample_gates", """WITH $readings, d AS (SELECT *, location || timestamp::DATE AS cell FROM readings),
g AS (SELECT cell, count(*) AS raw_rows, count(*) FILTER (WHERE no2 IS NOT NULL) AS clean_rows FROM d GROUP BY cell)
SELECT *, raw_rows >= 30 AND clean_rows >= 20 AS adaptive_ok, raw_rows >= 20 AND clean_rows >= 10 AS simple_ok,
  raw_rows >= 50 AS warn_ok, raw_rows >= 50 AS serving_ok FROM g""")
def _(spark, sf):
    cell = F.concat("location", F.to_date("timestamp").cast("string"))
    df = fx.readings(spark, sf).withColumn("cell", cell).select("cell", "no2")
    return quality.sample_gates(df, drop_missing(df, ["no2"]), ["cell"])


@query("a21_flag_duplicates", """WITH $readings SELECT seq, location, aqi, pm2_5,
  row_number() OVER (PARTITION BY location, aqi, CAST(floor(pm2_5 * 100 + 0.5) AS BIGINT) ORDER BY seq) > 1 AS is_duplicate
FROM readings""")
def _(spark, sf):
    return dedup.flag_duplicates(fx.readings(spark, sf).select("seq", "location", "aqi", "pm2_5"))


DEDUP_SENSOR = """SELECT * FROM (SELECT seq, location, timestamp, aqi, pm2_5, row_number() OVER (
  PARTITION BY location, aqi, CAST(floor(pm2_5 * 100 + 0.5) AS BIGINT) ORDER BY seq) AS k FROM sensor_rows) t"""


@query("a21_drop_duplicates", f"WITH $sensor_rows SELECT * EXCLUDE (k) FROM ({DEDUP_SENSOR}) d WHERE k = 1")
def _(spark, sf):
    return dedup.drop_duplicates(fx.sensor_rows(spark, sf).select("seq", "location", "timestamp", "aqi", "pm2_5"))


@query("a21_repeated_documents", """SELECT doc_id, source,
  row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_duplicate FROM documents""")
def _(spark, sf):
    """The same rule with another key: texts, by digest and length, instead of measures."""
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text")
    return dedup.flag_duplicates(df, key=[], seq="doc_id", parts=[F.sha2("text", 256).alias("_digest"), F.length("text").alias("_length")]).drop("text")


@query("a22_duplicate_totals", f"""WITH $sensor_rows SELECT count(*) AS total_before,
  count(*) FILTER (WHERE k = 1) AS unique_count, count(*) FILTER (WHERE k > 1) AS duplicate_count,
  count(*) FILTER (WHERE k = 1) AS total_after FROM ({DEDUP_SENSOR}) d""")
def _(spark, sf):
    return dedup.duplicate_totals(fx.sensor_rows(spark, sf))


@query("a25_time_span", """WITH $sensor_rows SELECT location, count(*) AS n, min(timestamp) AS first_ts,
  max(timestamp) AS last_ts, epoch_us(max(timestamp)) - epoch_us(min(timestamp)) AS span_micros
FROM sensor_rows GROUP BY location""")
def _(spark, sf):
    return quality.time_span(fx.sensor_rows(spark, sf), S)


GAPS = f"gaps AS (SELECT location, timestamp, seq, epoch_us(timestamp) - epoch_us(lag(timestamp) {OVER}) AS gap FROM {{0}})"


@query("a26_gap_stats", f"""WITH $sensor_rows, {GAPS.format('sensor_rows')}
SELECT location, min(gap) AS min_gap, max(gap) AS max_gap, {r('avg(gap)', 3)} AS mean_gap,
       {r('quantile_cont(CAST(gap AS DOUBLE), 0.5)', 3)} AS median_gap
FROM gaps WHERE gap IS NOT NULL GROUP BY location""")
def _(spark, sf):
    out = quality.gap_stats(fx.sensor_rows(spark, sf), S)
    return out.withColumns({c: F.round(c, 3) for c in ("mean_gap", "median_gap")})


@query("a26_gap_stats_of_user_rows", f"""WITH $user_rows, {GAPS.format('user_rows')}
SELECT location, min(gap) AS min_gap, max(gap) AS max_gap, {r('avg(gap)', 3)} AS mean_gap,
       {r('quantile_cont(CAST(gap AS DOUBLE), 0.5)', 3)} AS median_gap
FROM gaps WHERE gap IS NOT NULL GROUP BY location""")
def _(spark, sf):
    out = quality.gap_stats(fx.user_rows(spark, sf), Series(max_rows=fx.FEW_ROWS))
    return out.withColumns({c: F.round(c, 3) for c in ("mean_gap", "median_gap")})


@query("a27_large_gaps", f"""WITH $readings, {GAPS.format('readings')}, large AS (
  SELECT location, timestamp, gap AS gap_micros, row_number() {OVER} AS rank,
         count(*) OVER (PARTITION BY location) AS large_gaps FROM gaps WHERE gap > 7200000000)
SELECT * FROM large WHERE rank <= 10""")
def _(spark, sf):
    return quality.large_gaps(fx.readings(spark, sf), S)


RUN_ROWS = f"""{RUNS_SQL}, runs AS (
  SELECT location, run_id, count(*) AS run_rows, min(timestamp) AS run_start, max(timestamp) AS run_end
  FROM numbered GROUP BY location, run_id)"""


@query("a28_run_lengths", f"WITH $readings, {RUN_ROWS} SELECT * FROM runs WHERE run_rows > 1")
def _(spark, sf):
    return quality.run_lengths(fx.readings(spark, sf), S)


@query("a28_run_summary", f"""WITH $readings, {RUN_ROWS}
SELECT location, count(*) AS n_runs, max(run_rows) AS longest_run FROM runs WHERE run_rows > 1 GROUP BY location""")
def _(spark, sf):
    return quality.run_summary(fx.readings(spark, sf), S)


@query("a29_data_quality", f"""WITH $readings, {RUN_ROWS}
SELECT location, CAST(sum(run_rows) AS BIGINT) AS total_records, max(run_rows) AS max_consecutive,
       max(run_rows) >= 12 AS can_use_lags, max(run_rows) >= 24 AS can_forecast FROM runs GROUP BY location""")
def _(spark, sf):
    return quality.data_quality(fx.readings(spark, sf), S)


@query("a30_daily_coverage", """WITH $readings SELECT location, CAST(timestamp AS DATE) AS date, count(*) AS records,
  CASE WHEN count(*) >= 20 THEN 'good' WHEN count(*) >= 10 THEN 'partial' ELSE 'poor' END AS status
FROM readings GROUP BY location, CAST(timestamp AS DATE)""")
def _(spark, sf):
    return quality.daily_coverage(fx.readings(spark, sf), S)
