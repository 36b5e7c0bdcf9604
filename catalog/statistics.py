"""Exploratory statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from breezeway.operators.series import Series
from breezeway.functions.bands import five_step_category
from breezeway.functions.fixed_values import CORRELATION_FEATURES, POLLUTANTS
from breezeway.operators import eda
from breezeway.operators.percentiles import exact_percentiles
from breezeway.operators.shape import numeric_columns
from catalog import fixtures as fx
from catalog import query, r
from catalog.features import category_sql

MEASURES = ["pm2_5", "pm10", "no2", "o3", "temperature", "humidity", "wind_speed", "aqi"]


def quantile(c: str, p: float) -> str:
    return r(f"quantile_cont(CAST({c} AS DOUBLE), {p})")


def rounded(df, *names):
    return df.withColumns({c: F.round(c, 6) for c in names})


@query("a12_target_stats", f"""WITH $readings SELECT avg(aqi) AS mean, {quantile('aqi', 0.5)} AS median,
  {r('stddev_samp(aqi)')} AS std, min(aqi) AS min, max(aqi) AS max FROM readings""")
def _(spark, sf):
    return rounded(eda.target_stats(fx.readings(spark, sf)), "std", "median")


@query("a13_describe", "WITH $readings " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS std,
        CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, {quantile(c, 0.25)} AS q25,
        {quantile(c, 0.5)} AS q50, {quantile(c, 0.75)} AS q75 FROM readings""" for c in MEASURES))
def _(spark, sf):
    return rounded(eda.describe(fx.readings(spark, sf), MEASURES), "mean", "std", "q25", "q50", "q75")


PROFILED = {"location": "string", "source": "string", "timestamp": "timestamp", "aqi": "int", "pm2_5": "double", "no2": "double"}


@query("a14_column_profile", "WITH $readings " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS type, count(*) AS rows, count({c}) AS non_null,
        count(DISTINCT {c}) AS distinct_values FROM readings""" for c, t in PROFILED.items()))
def _(spark, sf):
    return eda.column_profile(fx.readings(spark, sf), list(PROFILED))


@query("a14_type_histogram", "WITH $readings SELECT type, columns, (SELECT count(*) FROM readings) AS rows "
       "FROM (VALUES ('string', 2::BIGINT), ('timestamp', 1), ('int', 1), ('double', 2)) t(type, columns)")
def _(spark, sf):
    return eda.type_histogram(fx.readings(spark, sf), list(PROFILED))


@query("a15_missing_values", "WITH $readings, m AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count,
        {r(f'(count(*) - count({c})) * 100e0 / count(*)')} AS percentage FROM readings"""
    for c in ["source", "no2", "o3", "so2", "co", "no", "visibility", "wind_gust", "aqi"]) +
    ") SELECT * FROM m WHERE missing_count > 0")
def _(spark, sf):
    return rounded(eda.missing_values(fx.readings(spark, sf)), "percentage")


SHORT_EPA = """CASE WHEN value <= 50 THEN 'Good' WHEN value <= 100 THEN 'Moderate'
  WHEN value <= 150 THEN 'Unhealthy for Sensitive' WHEN value <= 200 THEN 'Unhealthy'
  WHEN value <= 300 THEN 'Very Unhealthy' ELSE 'Hazardous' END"""


@query("a16_category_distribution", f"""SELECT {SHORT_EPA} AS category, count(*) AS n,
  {r('count(*) * 100e0 / sum(count(*)) OVER ()')} AS percentage FROM events GROUP BY 1""")
def _(spark, sf):
    df = fx.events(spark, sf).withColumnRenamed("value", "aqi")
    return rounded(eda.category_distribution(df), "percentage")


@query("a16_five_step_distribution", f"""WITH $readings SELECT {category_sql('aqi')} AS category, count(*) AS n,
  {r('count(*) * 100e0 / sum(count(*)) OVER ()')} AS percentage FROM readings GROUP BY 1""")
def _(spark, sf):
    out = eda.category_distribution(fx.readings(spark, sf), five_step_category(F.col("aqi")))
    return rounded(out, "percentage")


@query("a17_histogram", f"""WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
counts AS (SELECT least(CAST(floor((value - lo) / (hi - lo) * 50) AS INTEGER), 49) AS bin, count(*) AS n
           FROM events, e GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, {r('lo + (hi - lo) * b.bin / 50e0')} AS low,
       {r('lo + (hi - lo) * (b.bin + 1) / 50e0')} AS high, coalesce(n, 0) AS n
FROM range(50) b(bin) LEFT JOIN counts c ON b.bin = c.bin, e""")
def _(spark, sf):
    return rounded(eda.histogram(fx.events(spark, sf), "value", 50), "low", "high")


BOX_SQL = f"""WITH q AS (
  SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT {r('max(q1)')} AS q1, {r('max(m)')} AS median, {r('max(q3)')} AS q3,
  min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
  max(value) FILTER (WHERE value <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers
FROM events, q"""


@query("a18_box_plot", BOX_SQL)
def _(spark, sf):
    return rounded(eda.box_plot(fx.events(spark, sf), "value"), "q1", "median", "q3")


@query("a18_box_plot_in_blocks", BOX_SQL)
def _(spark, sf):
    """The way of large inputs."""
    return rounded(eda.box_plot(fx.events(spark, sf), "value", Series(max_rows=fx.FEW_ROWS)), "q1", "median", "q3")


NUMERIC = ["seq", "aqi", "pm2_5", "pm10", "co", "no", "no2", "o3", "so2", "temperature", "feels_like", "temp_min",
           "temp_max", "humidity", "pressure", "wind_speed", "wind_direction", "wind_gust", "clouds", "visibility"]


def corr_sql(x: str, y: str) -> str:
    """NULL instead of NaN for a constant side."""
    v = f"corr({x}, {y})"
    return f"CASE WHEN isnan({v}) THEN NULL ELSE {r(v)} END"


CORR = " UNION ALL ".join(f"""SELECT '{c}' AS "column", {corr_sql('aqi', c)} AS r FROM readings""" for c in NUMERIC)


@query("a19_correlation_with_target", f"WITH $readings {CORR}")
def _(spark, sf):
    return rounded(eda.correlation_with(fx.readings(spark, sf)), "r")


@query("a19_top_correlations",
       f'WITH $readings, c AS ({CORR}) SELECT * FROM c ORDER BY r DESC NULLS LAST, "column" LIMIT 11')
def _(spark, sf):
    return rounded(eda.correlation_with(fx.readings(spark, sf), top=11), "r")


@query("a20_correlation_matrix", "WITH $readings " + " UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, {corr_sql(x, y)} AS r FROM readings"
    for x in CORRELATION_FEATURES for y in CORRELATION_FEATURES))
def _(spark, sf):
    return rounded(eda.correlation_matrix(fx.readings(spark, sf)), "r")


@query("a23_pollutant_ranges", "WITH $readings " + " UNION ALL ".join(
    f"SELECT '{c}' AS pollutant, {r(f'avg({c})')} AS mean, min({c}) AS min, max({c}) AS max FROM readings"
    for c in POLLUTANTS))
def _(spark, sf):
    return rounded(eda.pollutant_ranges(fx.readings(spark, sf)), "mean")


@query("a24_trend_lines", "WITH $readings " + " UNION ALL ".join(
    f"""SELECT '{c}' AS pollutant, {r(f'regr_slope(aqi, {c})')} AS slope,
        {r(f'regr_intercept(aqi, {c})')} AS intercept FROM readings""" for c in POLLUTANTS))
def _(spark, sf):
    return rounded(eda.trend_lines(fx.readings(spark, sf)), "slope", "intercept")


@query("p12_numeric_columns", "WITH $readings SELECT unnest([" + ", ".join(f"'{c}'" for c in NUMERIC) + """]) AS "column",
  (SELECT count(*) FROM readings) AS rows""")
def _(spark, sf):
    df = fx.readings(spark, sf).withColumn("lat", F.lit(24.9))
    names = F.explode(F.array(*[F.lit(c) for c in numeric_columns(df)])).alias("column")
    return df.agg(F.count(F.lit(1)).alias("rows")).select(names, "rows")


@query("percentiles_by_kind", f"""SELECT event_type, {quantile('value', 0.1)} AS value_p10,
  {quantile('value', 0.5)} AS value_p50, {quantile('value', 0.99)} AS value_p99 FROM events GROUP BY event_type""")
def _(spark, sf):
    out = exact_percentiles(fx.events(spark, sf), ["value"], [0.1, 0.5, 0.99], ["event_type"])
    return rounded(out, "value_p10", "value_p50", "value_p99")
