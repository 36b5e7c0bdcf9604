"""Repeated readings and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reading_key(aqi: str = "aqi", value: str = "pm2_5") -> list[Column]:
    """(index, value in hundredths); a missing part counts as 0."""
    cents = F.floor(F.coalesce(F.col(value), F.lit(0.0)) * 100 + 0.5).cast("long")
    return [F.coalesce(F.col(aqi), F.lit(0)).alias("_aqi"), cents.alias("_cents")]


def first_seen_ids(df: DataFrame, key: list[str], parts: list[Column], seq: str = "seq") -> DataFrame:
    """The ``seq`` of the first row of each (key, parts).

    A minimum per group: copies are folded on the map side, so a third of all
    rows sharing one key is no burden.
    """
    return df.groupBy(*key, *parts).agg(F.min(seq).alias(seq)).select(seq)


def flag_duplicates(df: DataFrame, key: list[str] = ["location"], seq: str = "seq",
                    parts: list[Column] | None = None) -> DataFrame:
    """Add ``is_duplicate``; joins on the unique ``seq``, never on the repeated key."""
    first = first_seen_ids(df, key, parts or reading_key(), seq).withColumn("_first", F.lit(True))
    return (
        df.join(first, seq, "left")
        .withColumn("is_duplicate", F.col("_first").isNull())
        .drop("_first")
        .select(*df.columns, "is_duplicate")
    )


def drop_duplicates(df: DataFrame, key: list[str] = ["location"], seq: str = "seq",
                    parts: list[Column] | None = None) -> DataFrame:
    """Keep the first row of each (key, parts) in insertion order."""
    first = first_seen_ids(df, key, parts or reading_key(), seq)
    return df.join(first, seq, "left_semi").select(*df.columns)


def duplicate_totals(df: DataFrame, key: list[str] = ["location"],
                     parts: list[Column] | None = None) -> DataFrame:
    """Rows before, unique rows (= rows after) and duplicates, from the group counts alone."""
    groups = df.groupBy(*key, *(parts or reading_key())).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_before"),
        F.count(F.lit(1)).alias("unique_count"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_count"),
    ).withColumn("total_after", F.col("unique_count"))


def delete_ids(df: DataFrame, ids: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows whose id is not listed."""
    return df.join(ids.select(seq), seq, "left_anti").select(*df.columns)


def delete_sources(df: DataFrame, sources: list[str], column: str = "source") -> DataFrame:
    """Rows of other sources; rows without a source stay."""
    return df.filter(~F.coalesce(F.col(column).isin(*sources), F.lit(False)))


def delete_matching(df: DataFrame, pattern: str, column: str = "source") -> DataFrame:
    """Rows whose source does not match the (unanchored) pattern; NULL stays."""
    return df.filter(~F.coalesce(F.col(column).rlike(pattern), F.lit(False)))


def delete_all(df: DataFrame) -> DataFrame:
    return df.limit(0)
