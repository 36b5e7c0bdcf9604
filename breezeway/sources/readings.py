"""Scans of a readings table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from breezeway.operators.series import Series
from breezeway.operators.shape import nan_to_null


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan without inference when ``schema`` is given; NaN becomes NULL."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return nan_to_null(reader.parquet(path))


def in_time_order(df: DataFrame, s: Series = Series()) -> DataFrame:
    """Global time order; only for output that is read in order."""
    return df.orderBy(s.ts, s.seq)


def in_insertion_order(df: DataFrame, seq: str = "seq") -> DataFrame:
    return df.orderBy(seq)


def of_source(df: DataFrame, source: str, column: str = "source") -> DataFrame:
    return df.filter(F.col(column) == source)


def of_version_or_all(df: DataFrame, version: str, column: str = "model_version") -> DataFrame:
    """Rows of ``version``; all rows if the version has none."""
    has_version = df.agg(
        F.coalesce(F.max((F.col(column) == version).cast("int")), F.lit(0)).alias("n"))
    is_version = F.coalesce(F.col(column) == version, F.lit(False))
    return df.filter(is_version | (has_version.scalar() == 0))


def since_days(df: DataFrame, days: int, as_of: Column | None = None, ts: str = "timestamp") -> DataFrame:
    """Rows of the last ``days`` days before ``as_of``, by default the newest row's time.

    Give a literal ``as_of`` to let the filter reach the scan; tables stored by
    date also take the date filter, which skips whole directories.
    """
    end = df.agg(F.max(ts)).scalar() if as_of is None else as_of
    cutoff = end - F.make_dt_interval(days=F.lit(days))
    recent = df.filter(F.col(ts) >= cutoff)
    return recent.filter(F.col("date") >= F.to_date(cutoff)) if "date" in df.columns else recent


def latest(df: DataFrame, s: Series = Series(), by: Sequence[str] | None = None) -> DataFrame:
    """The newest row of each entity.

    A hash aggregate finds the largest first order column of each entity; only rows that
    have it are ranked by the other columns.
    """
    first, *rest = by or s.order
    newest = df.groupBy(*s.key).agg(F.max(first).alias("_newest")).withColumnsRenamed({k: f"_of_{k}" for k in s.key})
    same = F.col(first).eqNullSafe(F.col("_newest"))
    for k in s.key:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    last = df.join(newest, same).select(*df.columns)
    place = F.row_number().over(Window.partitionBy(*s.key).orderBy(*[F.desc_nulls_last(c) for c in rest or [first]]))
    return last.withColumn("_place", place).filter("_place = 1").drop("_place")


def latest_n(df: DataFrame, n: int, s: Series = Series()) -> DataFrame:
    """The newest ``n`` rows of the whole table."""
    return df.orderBy(F.desc(s.ts), F.desc(s.seq)).limit(n)


def latest_n_each(df: DataFrame, n: int, s: Series = Series()) -> DataFrame:
    """The newest ``n`` rows of each entity; each map task sends at most ``n`` per entity."""
    w = Window.partitionBy(*s.key).orderBy(F.desc(s.ts), F.desc(s.seq))
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def first_rows(df: DataFrame, n: int, seq: str = "seq") -> DataFrame:
    return df.orderBy(seq).limit(n)


def sample_report(df: DataFrame, time_candidates: list[str], n: int = 10, seq: str = "seq") -> DataFrame:
    """First rows with the first time field the table has, aqi and pm2_5."""
    time_field = next((c for c in time_candidates if c in df.columns), None)
    columns = ([time_field] if time_field else []) + ["aqi", "pm2_5"]
    return df.orderBy(seq).limit(n).select(*columns)
