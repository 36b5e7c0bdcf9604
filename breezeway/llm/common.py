"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from breezeway.session import materialise

#: A word is a run of anything but blanks, tabs, line ends, vertical tabs and form feeds.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"

#: A table joined to all documents is broadcast up to this many rows; beyond, it is salted.
BROADCAST_ROWS = 100_000
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; -1 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus, F.lit(-1)).cast("int")


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """Words of a text in order; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once per row.

    A column that is named inside a lambda may be inlined there by the optimizer and
    would be computed again for each element. A lambda variable never is.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def attach_small(
    rows: DataFrame, small: DataFrame, keys: Sequence[str], n_small: int, spread: Column,
) -> DataFrame:
    """Left join on null-safe ``keys`` with a table of ``n_small`` rows, unique in the keys.

    Up to BROADCAST_ROWS rows the table is broadcast. A larger one is repeated over SALTS
    values of ``spread``, so that the rows of a hot key go to as many tasks.
    """
    named = small.select(*[F.col(k).alias(f"_key_{k}") for k in keys],
                         *[c for c in small.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    drop = [f"_key_{k}" for k in keys]
    if n_small <= BROADCAST_ROWS:
        return rows.join(F.broadcast(named), same, "left").drop(*drop)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    copies = named.withColumn("_salt_of", F.explode(F.array(*[F.lit(i).cast("long") for i in range(SALTS)])))
    return salted.join(copies, same & (F.col("_salt") == F.col("_salt_of")), "left").drop(*drop, "_salt", "_salt_of")


def sampled(
    rows: DataFrame, n: int, by: Sequence[str], stratum: str | None = None, per_stratum: int = 0,
) -> DataFrame:
    """At most ``n`` different rows by the hash of the columns ``by``, with ``place`` from 1.

    With ``stratum`` (one of ``by``) they are taken from each of its values in turn, at
    most ``per_stratum`` of one. Only hashes are ranked; the rows themselves are then
    picked by a broadcast of the n chosen hashes.
    """
    tagged = rows.withColumn("_h", F.xxhash64(*by))
    group = [stratum] if stratum else []
    ids = tagged.select(*group, "_h").distinct()
    order = [F.col("_h")]
    if stratum:
        nth = F.row_number().over(Window.partitionBy(stratum).orderBy("_h"))
        ids = ids.withColumn("_nth", nth).where(F.col("_nth") <= per_stratum)
        order = [F.col("_nth"), F.col("_h")]
    chosen = materialise(ids.orderBy(*order).limit(n).select(
        "_h", F.row_number().over(Window.orderBy(*order)).alias("place")), "sample")
    return materialise(tagged.join(F.broadcast(chosen), "_h").dropDuplicates(["_h"]).drop("_h"), "sampled")


def positions(keys: DataFrame, key: str) -> DataFrame:
    """Distinct keys in ascending order, nulls last, with ``position`` from 0.

    Keys are dealt into ranges and numbered inside each; the start of a range is the
    running count of the ranges before it, one row a range.
    """
    in_order = F.col(key).asc_nulls_last()
    ranges = materialise(
        keys.select(key).distinct().repartitionByRange(in_order).withColumn("_range", F.spark_partition_id()),
        "positions",
    )
    starts = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range",
        (F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
        .alias("_start"),
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(in_order)) - 1
    return (
        ranges.withColumn("_inside", inside)
        .join(F.broadcast(starts), "_range")
        .select(key, (F.col("_start") + F.col("_inside")).cast("long").alias("position"))
    )
