"""Exact interpolated percentiles at any scale, by histograms that are refined.

A first histogram groups values by sign and power of two. The buckets that hold a wanted
rank are then cut into BUCKETS equal parts between their least and greatest value, and so on,
until a bucket is one value: a part of a power of two needs at most six rounds. All
groups, columns and ranks are refined together. Each round folds the values on the map side
into counts; a group of any size is as many rows as buckets are in use.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breezeway.operators.series import Series, bounded
from breezeway.session import discard, materialise

#: Parts of a bucket in the next round.
BUCKETS = 1024
#: Above the exponents of all doubles.
_POWERS = 1100


def percentile_name(column: str, p: float) -> str:
    return f"{column}_p{p * 100:g}".replace(".", "_")


def _magnitude(x: Column) -> Column:
    """A whole number that grows with ``x``: by sign and power of two; NaN is the greatest value."""
    power = F.floor(F.log2(F.abs(x))) + _POWERS
    finite = F.when(x == 0, 0).when(x > 0, power).otherwise(-power)
    far = 4 * _POWERS
    return (F.when(F.isnan(x), far + 1).when(x == float("inf"), far).when(x == float("-inf"), -far).otherwise(finite)).cast("int")


def _part(x: Column, low: Column, high: Column) -> Column:
    """Which of the equal parts of a bucket a value is in; it never falls where the value grows."""
    return F.least(F.floor((x - low) / (high - low) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def _same(names: list[str]) -> Column:
    condition = F.lit(True)
    for c in names:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return condition


def _renamed(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"_r_{c}" for c in names})


def _bucket_of_rank(targets: DataFrame, buckets: DataFrame, cell: list[str]) -> DataFrame:
    """``targets`` (cell, rank, below) with the bucket of ``buckets`` (cell, part, n, least, most) that holds the rank."""
    in_order = Window.partitionBy(*cell).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    counted = buckets.withColumn("_upto", F.sum("n").over(in_order))
    both = targets.join(_renamed(counted, cell), _same(cell))
    before = F.col("below") + F.col("_upto") - F.col("n")
    return both.where((before <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("_upto"))).select(
        *[c for c in targets.columns if c not in ("low", "high", "below")], F.col("least").alias("low"),
        F.col("most").alias("high"), before.alias("below"))


def _rank_ends(total: int, p: float) -> tuple[int, int, float]:
    """The two ranks that a percentile lies between, and how far it is from the lower one."""
    place = (total - 1) * p
    return math.floor(place), math.ceil(place), place - math.floor(place)


def _each_column(columns: list[Column], tag) -> Column:
    """(c, t, x) of each column: its number, a tag and its value."""
    return F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), tag(i, x).alias("t"), x.alias("x")) for i, x in enumerate(columns)]))


def _fold() -> list[Column]:
    return [F.count("x").alias("n"), F.min("x").alias("least"), F.max("x").alias("most")]


def _of_whole(rows: DataFrame, columns: list[Column], probs: list[float]) -> list[float | None]:
    """Percentiles of each column (and probability) of an input without groups.

    The buckets in use are a few for each percentile, so the driver keeps them.
    """
    closed = lambda low, high: low == high or (math.isnan(low) and math.isnan(high))
    found = rows.select(_each_column(columns, lambda i, x: _magnitude(x)).alias("_v")).select("_v.*").where(
        "x IS NOT NULL").groupBy("c", "t").agg(*_fold()).collect()
    ranks: dict[tuple[int, int], tuple[float, float, int]] = {}  # column, rank -> bucket and the rows below it

    def place(wanted: dict, buckets: list) -> None:
        buckets = sorted(buckets, key=lambda b: b.t)
        for (c, rank), below in wanted.items():
            for b in buckets:
                if below <= rank < below + b.n:
                    ranks[c, rank] = (b.least, b.most, below)
                    break
                below += b.n

    totals = [sum(b.n for b in found if b.c == i) for i in range(len(columns))]
    for i, total in enumerate(totals):
        if total:
            place({(i, r): 0 for p in probs for r in _rank_ends(total, p)[:2]}, [b for b in found if b.c == i])
    while True:
        open_ = sorted({(c, low, high) for (c, _), (low, high, _) in ranks.items() if not closed(low, high)})
        if not open_:
            break
        at = {o: k for k, o in enumerate(open_)}

        def tag(i: int, x: Column) -> Column:
            out = F.lit(None).cast("struct<o:int,part:int>")
            for (c, low, high), k in at.items():
                if c == i:
                    part = _part(x, F.lit(low), F.lit(high))
                    out = F.when((x >= low) & (x <= high), F.struct(F.lit(k).alias("o"), part.alias("part"))).otherwise(out)
            return out

        parts = rows.select(_each_column(columns, tag).alias("_v")).select("_v.x", "_v.t.o", F.col("_v.t.part").alias("t")).where(
            "o IS NOT NULL").groupBy("o", "t").agg(*_fold()).collect()
        for o, k in at.items():
            inside = {key: below for key, (low, high, below) in ranks.items() if (key[0], low, high) == o}
            place(inside, [b for b in parts if b.o == k])
    out = []
    for i, total in enumerate(totals):
        for p in probs:
            if not total:
                out.append(None)
                continue
            low, high, weight = _rank_ends(total, p)
            a, b = ranks[i, low][0], ranks[i, high][0]
            out.append(a if closed(a, b) else a * (1 - weight) + b * weight)
    return out


def exact_percentiles(
    df: DataFrame, columns: list[str], probs: list[float], by: list[str] | None = None,
    s: Series = Series(),
) -> DataFrame:
    """One row per group with a column ``<column>_p<percent>`` for each pair.

    Between two ranks it interpolates. A missing value has no rank; a group without a value
    has NULL percentiles. NaN counts as the greatest value. The same way is taken for every
    size; ``s`` is not looked at.
    """
    keys = [f"_k{i}" for i in range(len(by or []))]
    names = [percentile_name(c, p) for c in columns for p in probs]
    rows = df.select(
        *[F.col(c).alias(k) for c, k in zip(by or [], keys)],
        *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])
    if not hasattr(df, "_scratch"):  # each round reads the values again
        rows = materialise(rows, "percentile-values")
    x = [F.col(f"_x{i}") for i in range(len(columns))]
    if not by:
        values = _of_whole(rows, x, [float(p) for p in probs])
        schema = ", ".join(f"`{n}` double" for n in names)
        return df.sparkSession.createDataFrame([tuple(values)], schema)

    cell = [*keys, "c"]
    # a row without a value keeps its group: its bucket counts none
    first = materialise(
        rows.select(*keys, _each_column(x, lambda i, v: _magnitude(v)).alias("_v"))
        .select(*keys, "_v.c", "_v.x", F.col("_v.t").alias("part"))
        .groupBy(*cell, "part").agg(*_fold()), "percentile-buckets")
    n_groups = first.select(*keys).distinct().count()
    totals = first.groupBy(*cell).agg(F.sum("n").alias("_all")).where("_all > 0")
    place = (F.col("_all") - 1) * F.col("p")
    wanted = totals.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in sorted(set(probs))])))
    wanted = wanted.select(*cell, "p", (place - F.floor(place)).alias("weight"),
                           F.explode(F.array(F.floor(place), F.ceil(place))).alias("rank"))
    wanted = wanted.distinct().select("*", F.lit(0).cast("long").alias("below"))
    targets = materialise(_bucket_of_rank(wanted, first.where("n > 0"), cell), "percentile-ranks")

    part = [*cell, "low", "high"]
    while True:
        open_ = targets.where(~F.col("low").eqNullSafe(F.col("high")))
        if open_.isEmpty():
            break
        groups = open_.groupBy(*keys).agg(F.collect_set(F.struct("c", "low", "high")).alias("_open"))
        # the few open buckets of a group beside each of its rows
        beside = rows.join(bounded(_renamed(groups, keys), n_groups), _same(keys))
        value = F.get(F.array(*x), F.col("_o.c"))
        inside = beside.select(*keys, *[f"_x{i}" for i in range(len(x))], F.explode("_open").alias("_o")).select(
            *keys, F.col("_o.c").alias("c"), F.col("_o.low").alias("low"), F.col("_o.high").alias("high"), value.alias("x"))
        parts = inside.where("x >= low AND x <= high").groupBy(
            *part, _part(F.col("x"), F.col("low"), F.col("high")).alias("part")).agg(*_fold())
        found = _bucket_of_rank(open_, parts, part)
        after = materialise(targets.where(F.col("low").eqNullSafe(F.col("high"))).unionByName(found), "percentile-ranks")
        discard(targets)
        targets = after

    out = []
    for i, c in enumerate(columns):
        for p in probs:
            hit = (F.col("c") == i) & (F.col("p") == float(p))
            low, high = F.min(F.when(hit, F.struct("rank", "low")))["low"], F.max(F.when(hit, F.struct("rank", "low")))["low"]
            weight = F.max(F.when(hit, F.col("weight")))
            out.append(F.when(low == high, low).otherwise(low * (1 - weight) + high * weight).alias(percentile_name(c, p)))
    found = targets.groupBy(*keys).agg(*out)
    every = first.select(*keys).distinct()
    return every.join(_renamed(found, keys), _same(keys), "left").select(
        *[F.col(k).alias(c) for k, c in zip(keys, by)], *names)
