"""The ingest gate in batch and as a stream, and the stream jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeway.operators.series import Series
from breezeway.session import scratch_path
from breezeway.streaming import gate, jobs
from catalog import fixtures as fx
from catalog import query
from catalog.windows import S

# The gate compares with the last stored poll, so it is recursive.
GATE_SQL = """WITH RECURSIVE $polls, ranked AS (
  SELECT *, epoch_us(timestamp) AS t, row_number() OVER (PARTITION BY location ORDER BY timestamp, seq) AS k FROM polls
), walk AS (
  SELECT location, k, seq, 'first' AS reason, t AS last_t, aqi AS last_aqi, pm2_5 AS last_pm, temperature AS last_temp
  FROM ranked WHERE k = 1
  UNION ALL
  SELECT location, k, seq, reason,
         CASE WHEN reason = 'unchanged' THEN last_t ELSE t END, CASE WHEN reason = 'unchanged' THEN last_aqi ELSE aqi END,
         CASE WHEN reason = 'unchanged' THEN last_pm ELSE pm2_5 END,
         CASE WHEN reason = 'unchanged' THEN last_temp ELSE temperature END
  FROM (SELECT n.location, n.k, n.seq, n.t, n.aqi, n.pm2_5, n.temperature,
               w.last_t, w.last_aqi, w.last_pm, w.last_temp,
               CASE WHEN n.t - w.last_t >= 2700000000 THEN 'elapsed'
                    WHEN n.aqi = w.last_aqi AND abs(n.pm2_5 - w.last_pm) < 0.5 AND abs(n.temperature - w.last_temp) < 0.5
                    THEN 'unchanged' ELSE 'changed' END AS reason
        FROM walk w JOIN ranked n ON n.location = w.location AND n.k = w.k + 1) s
)
"""
STORED = GATE_SQL + """SELECT p.seq, p.location, p.timestamp, p.aqi, p.pm2_5, p.temperature
FROM walk w JOIN polls p ON p.seq = w.seq WHERE w.reason <> 'unchanged'"""


@query("t1_ingest_gate", STORED)
def _(spark, sf):
    return gate.accepted(fx.polls(spark, sf), S)


@query("t1_ingest_gate_in_chunks", STORED)
def _(spark, sf):
    """The way huge stations take, forced by a low row limit."""
    return gate.accepted(fx.polls(spark, sf), Series(max_rows=1000))


@query("t3_gate_reasons", GATE_SQL + "SELECT seq, location, reason FROM walk")
def _(spark, sf):
    return gate.with_gate_reason(fx.polls(spark, sf), S).select("seq", "location", "reason")


@query("t3_gate_reason_counts", GATE_SQL + "SELECT location, reason, count(*) AS n FROM walk GROUP BY location, reason")
def _(spark, sf):
    return gate.with_gate_reason(fx.polls(spark, sf), S).groupBy("location", "reason").agg(F.count(F.lit(1)).alias("n"))


def events_stream(spark, sf):
    schema = fx.events(spark, sf).schema
    return jobs.landing_stream(spark, sf, schema, "events.parquet")


def polls_stream(spark, sf):
    return events_stream(spark, sf).select(
        F.col("event_id").alias("seq"), F.concat(F.lit("st"), (F.col("user_id") % 4).cast("string")).alias("location"),
        F.col("ts").cast("timestamp").alias("timestamp"), fx.five_step(F.col("value")).alias("aqi"),
        (F.floor(F.col("value") / 25) * 25).cast("double").alias("pm2_5"),
        (F.lit(20) + F.col("user_id") % 2).cast("double").alias("temperature"))


@query("t2_gated_stream_to_store", STORED)
def _(spark, sf):
    path = scratch_path(spark, "gated")
    stream = polls_stream(spark, sf)
    jobs.store_gated(stream, path, f"{path}-state", S).awaitTermination()
    return jobs.read_gated(spark, path, stream.schema, S)


@query("t4_daily_coverage_stream", """SELECT location, date, n AS records,
  CASE WHEN n >= 20 THEN 'good' WHEN n >= 10 THEN 'partial' ELSE 'poor' END AS status
FROM (SELECT 'st' || (user_id % 4) AS location, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY ALL) d""")
def _(spark, sf):
    path = scratch_path(spark, "coverage")
    stream = polls_stream(spark, sf).select("location", "timestamp")
    jobs.keep_daily_coverage(stream, path, f"{path}-state", S).awaitTermination()
    return jobs.read_daily_coverage(spark, path, stream.schema, S).drop("late")


@query("t5_latest_kept_current", """WITH $polls SELECT seq, location, timestamp, aqi, pm2_5, temperature FROM (
  SELECT *, row_number() OVER (PARTITION BY location ORDER BY timestamp DESC, seq DESC) AS k FROM polls) t WHERE k = 1""")
def _(spark, sf):
    path = scratch_path(spark, "latest")
    stream = polls_stream(spark, sf)
    jobs.keep_latest(stream, path, f"{path}-state", S).awaitTermination()
    return jobs.read_latest(spark, path, stream.schema)
