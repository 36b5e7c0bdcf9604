"""Counts, coverage, gaps, runs and training gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breezeway.functions import fixed_values as V
from breezeway.functions.bands import scale_of_range
from breezeway.functions.calendar import MICROS_PER_MINUTE, micros
from breezeway.operators.percentiles import exact_percentiles
from breezeway.operators.series import Series, same_key
from breezeway.operators.shape import first_present, unpivot_row, where_present
from breezeway.operators.windows import with_gap, with_run_id
from breezeway.session import materialise

def _rows() -> Column:
    return F.count(F.lit(1))


def row_count(df: DataFrame, where: Column | None = None) -> DataFrame:
    return (df if where is None else df.filter(where)).agg(_rows().alias("n"))


def count_by(df: DataFrame, column: str, present_only: bool = False) -> DataFrame:
    df = where_present(df, column) if present_only else df
    return df.groupBy(column).agg(_rows().alias("n"))


def field_range(df: DataFrame, column: str) -> DataFrame:
    """min, max, avg and count of the known values."""
    return df.agg(
        F.min(column).alias("min_value"), F.max(column).alias("max_value"),
        F.avg(column).alias("avg_value"), F.count(column).alias("count"))


def field_range_missing_as_zero(df: DataFrame, column: str) -> DataFrame:
    value = F.coalesce(F.col(column), F.lit(0))
    return df.agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"),
                  F.avg(value).alias("avg_value"))


def field_span(df: DataFrame, candidates: list[str] = V.TIME_CANDIDATES) -> DataFrame:
    """Count, oldest and newest of each candidate time field that has values; one scan."""
    present = [c for c in candidates if c in df.columns]
    wide = df.agg(*[
        a for c in present
        for a in (F.count(c).alias(f"{c}_n"), F.min(c).alias(f"{c}_lo"), F.max(c).alias(f"{c}_hi"))
    ])
    records = [
        {"field": F.lit(c), "n": F.col(f"{c}_n"), "oldest": F.col(f"{c}_lo").cast("timestamp"),
         "newest": F.col(f"{c}_hi").cast("timestamp")}
        for c in present
    ]
    return unpivot_row(wide, records).filter("n > 0")


def field_names(df: DataFrame, seq: str = "seq", rows: int = 100) -> DataFrame:
    """Names of the columns that have a value in the first ``rows`` rows."""
    sample = df.orderBy(seq).limit(rows)
    wide = sample.agg(*[F.count(c).alias(c) for c in df.columns])
    records = [{"field": F.lit(c), "n": F.col(c)} for c in df.columns]
    return unpivot_row(wide, records).filter("n > 0").select("field")


def field_names_of_json(df: DataFrame, payload: str, order: str, rows: int = 100) -> DataFrame:
    """Distinct top-level keys of the first ``rows`` JSON payloads."""
    sample = df.orderBy(order).limit(rows)
    return sample.select(F.explode(F.json_object_keys(payload)).alias("field")).distinct()


def detect_scale(df: DataFrame, column: str = "aqi") -> DataFrame:
    stats = field_range(df, column)
    return stats.withColumn("scale", scale_of_range(F.col("min_value"), F.col("max_value")))


def detect_target_scale(df: DataFrame, candidates: list[str] = V.TARGET_CANDIDATES) -> DataFrame:
    """Scale of the first candidate target column the table has."""
    column = first_present(df, candidates)
    if column is None:
        raise ValueError("no target column among " + ", ".join(candidates))
    return detect_scale(df, column).withColumn("field", F.lit(column))


def index_stats(df: DataFrame) -> DataFrame:
    """Spread of the index and of pm2_5."""
    return df.agg(
        _rows().alias("n"),
        F.min("aqi").alias("aqi_min"), F.max("aqi").alias("aqi_max"),
        F.stddev_samp("aqi").alias("aqi_std"), F.countDistinct("aqi").alias("aqi_unique"),
        F.min("pm2_5").alias("pm2_5_min"), F.max("pm2_5").alias("pm2_5_max"),
        F.stddev_samp("pm2_5").alias("pm2_5_std"))


def training_gates(df: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Row-count and variance gates before training."""
    std = F.round(F.stddev_samp("aqi"), 9)
    stats = df.groupBy(*(key or [])).agg(_rows().alias("n"), std.alias("aqi_std"))
    n, spread = F.col("n"), F.col("aqi_std")
    return stats.withColumns({
        "few_rows": n < 168,
        "low_variance": F.coalesce(spread < 0.3, F.lit(False)),
        "passed": n >= 100,
        "variance_warning": F.coalesce((n >= 100) & (spread < 0.2), F.lit(False)),
    })


# Minimum rows per use: raw rows, rows left after cleaning (None = not asked).
SAMPLE_GATES = {"adaptive": (30, 20), "simple": (20, 10), "warn": (50, None), "serving": (50, None)}


def sample_gates(raw: DataFrame, clean: DataFrame, key: list[str] = ["location"]) -> DataFrame:
    """Which uses each entity has enough rows for."""
    raw_n = raw.groupBy(*key).agg(_rows().alias("raw_rows"))
    clean_n = clean.groupBy(*key).agg(_rows().alias("clean_rows"))
    counts = raw_n.join(clean_n, same_key(raw_n, clean_n, key), "left").select(
        *[raw_n[k] for k in key], "raw_rows", F.coalesce("clean_rows", F.lit(0)).alias("clean_rows"))
    gates = {}
    for name, (least_raw, least_clean) in SAMPLE_GATES.items():
        ok = F.col("raw_rows") >= least_raw
        gates[f"{name}_ok"] = ok if least_clean is None else ok & (F.col("clean_rows") >= least_clean)
    return counts.withColumns(gates)


def with_enough_rows(df: DataFrame, least: int, s: Series = Series()) -> DataFrame:
    """Rows of the entities that have at least ``least`` rows."""
    enough = df.groupBy(*s.key).agg(_rows().alias("_n")).filter(F.col("_n") >= least).drop("_n")
    return df.join(enough, same_key(df, enough, list(s.key)), "left_semi")


def time_span(df: DataFrame, s: Series = Series()) -> DataFrame:
    t = micros(F.col(s.ts))
    return df.groupBy(*s.key).agg(
        _rows().alias("n"), F.min(s.ts).alias("first_ts"), F.max(s.ts).alias("last_ts"),
        (F.max(t) - F.min(t)).alias("span_micros"))


def gap_stats(df: DataFrame, s: Series = Series()) -> DataFrame:
    """Smallest, largest, mean and median gap of each entity in microseconds.

    The gaps are written once; both aggregates read them.
    """
    key = list(s.key)
    gaps = materialise(with_gap(df.select(*key, *s.order), s).filter("gap_micros is not null").select(
        *key, "gap_micros"), "gaps")
    basic = gaps.groupBy(*key).agg(
        F.min("gap_micros").alias("min_gap"), F.max("gap_micros").alias("max_gap"),
        F.avg("gap_micros").alias("mean_gap"))
    median = exact_percentiles(gaps, ["gap_micros"], [0.5], key, s)
    median = median.withColumnRenamed("gap_micros_p50", "median_gap")
    return basic.join(median, same_key(basic, median, key)).select(*[basic[k] for k in key], *basic.columns[len(key):],
                                                                   "median_gap")


def large_gaps(df: DataFrame, s: Series = Series(), hours: int = V.LARGE_GAP_HOURS, show: int = 10) -> DataFrame:
    """The first ``show`` gaps over ``hours`` of each entity in time order, and their number."""
    key = list(s.key)
    gaps = with_gap(df.select(*key, *s.order), s)
    large = materialise(gaps.filter(F.col("gap_micros") > hours * 60 * MICROS_PER_MINUTE), "large-gaps")
    first = large.withColumn("rank", F.row_number().over(s.window()).cast("long")).filter(F.col("rank") <= show)
    counts = large.groupBy(*key).agg(_rows().alias("large_gaps"))
    return first.join(counts, same_key(first, counts, key)).select(
        *[first[k] for k in key], s.ts, "gap_micros", "rank", "large_gaps")


def runs(df: DataFrame, s: Series = Series(), minutes: int = V.RUN_GAP_MINUTES) -> DataFrame:
    """One row per run of readings without a gap over ``minutes``."""
    key = list(s.key)
    return with_run_id(df.select(*key, *s.order), s, minutes).groupBy(*key, "run_id").agg(
        _rows().alias("run_rows"), F.min(s.ts).alias("run_start"), F.max(s.ts).alias("run_end"))


def run_lengths(df: DataFrame, s: Series = Series()) -> DataFrame:
    """Runs of more than one row."""
    return runs(df, s).filter("run_rows > 1")


def run_summary(df: DataFrame, s: Series = Series()) -> DataFrame:
    """Number of runs of more than one row and the longest, per entity."""
    return run_lengths(df, s).groupBy(*s.key).agg(
        _rows().alias("n_runs"), F.max("run_rows").alias("longest_run"))


def data_quality(df: DataFrame, s: Series = Series()) -> DataFrame:
    """Rows, longest run and what the run length allows, per entity."""
    out = runs(df, s).groupBy(*s.key).agg(
        F.sum("run_rows").alias("total_records"), F.max("run_rows").alias("max_consecutive"))
    return out.withColumns({
        "can_use_lags": F.col("max_consecutive") >= V.LAG_RUN,
        "can_forecast": F.col("max_consecutive") >= V.FORECAST_RUN,
    })


def coverage_status(records: Column) -> Column:
    return F.when(records >= 20, "good").when(records >= 10, "partial").otherwise("poor")


def daily_coverage(df: DataFrame, s: Series = Series()) -> DataFrame:
    """Rows per day that has any, with a status."""
    days = df.groupBy(*s.key, F.to_date(s.ts).alias("date")).agg(_rows().alias("records"))
    return days.withColumn("status", coverage_status(F.col("records")))
