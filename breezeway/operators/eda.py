"""Exploratory statistics: one scan with one wide aggregate wherever possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breezeway.functions import fixed_values as V
from breezeway.functions.bands import epa_short_category
from breezeway.operators.percentiles import exact_percentiles, percentile_name
from breezeway.operators.series import Series
from breezeway.operators.shape import numeric_columns, unpivot_row

def _rows() -> Column:
    return F.count(F.lit(1))


def _with_percentiles(wide: DataFrame, df: DataFrame, columns: list[str], probs: list[float], s: Series) -> DataFrame:
    """Put two one-row aggregates side by side."""
    ranks = exact_percentiles(df, columns, probs, None, s)
    return wide.withColumn("_one", F.lit(1)).join(ranks.withColumn("_one", F.lit(1)), "_one").drop("_one")


def target_stats(df: DataFrame, column: str = "aqi", s: Series = Series()) -> DataFrame:
    wide = df.agg(
        F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"), F.max(column).alias("max"))
    out = _with_percentiles(wide, df, [column], [0.5], s)
    return out.withColumnRenamed(percentile_name(column, 0.5), "median")


def describe(df: DataFrame, columns: list[str] | None = None, s: Series = Series()) -> DataFrame:
    """count, mean, std, min, quartiles and max of each numeric column, one row per column."""
    columns = columns or numeric_columns(df, [])
    wide = df.agg(*[
        f(c).alias(f"{c}_{name}") for c in columns
        for name, f in {"count": F.count, "mean": F.avg, "std": F.stddev_samp,
                        "min": F.min, "max": F.max}.items()
    ])
    quartiles = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    wide = _with_percentiles(wide, df, columns, list(quartiles.values()), s)
    records = []
    for c in columns:
        record = {"column": F.lit(c), "count": F.col(f"{c}_count")}
        record |= {n: F.col(f"{c}_{n}").cast("double") for n in ("mean", "std", "min", "max")}
        record |= {n: F.col(percentile_name(c, p)) for n, p in quartiles.items()}
        records.append(record)
    return unpivot_row(wide, records)


def column_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Type, rows, known values and distinct values of each column."""
    columns = columns or df.columns
    values = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    # counts of each value are folded on the map side; no row is copied whole for a column
    per_value = df.select(values.alias("_v")).groupBy("_v.column", "_v.value").agg(_rows().alias("_n"))
    known = F.col("value").isNotNull()
    profile = per_value.groupBy("column").agg(
        F.sum("_n").alias("rows"), F.sum(F.when(known, F.col("_n")).otherwise(0)).alias("non_null"),
        F.count_if(known).alias("distinct_values"))
    types = {c: df.schema[c].dataType.simpleString() for c in columns}
    empty = df.sparkSession.createDataFrame([(c, t) for c, t in types.items()], "column string, type string")
    return empty.join(profile, "column", "left").select(
        "column", "type", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("rows", "non_null", "distinct_values")])


def type_histogram(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, columns and number of columns per type."""
    return column_profile(df, columns).groupBy("type").agg(
        _rows().alias("columns"), F.max("rows").alias("rows"))


def missing_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing count and percentage of the columns that miss any, largest first."""
    columns = columns or df.columns
    wide = df.agg(_rows().alias("_rows"), *[F.count(c).alias(c) for c in columns])
    rows = F.col("_rows")
    records = [
        {"column": F.lit(c), "missing_count": rows - F.col(c),
         "percentage": F.try_divide((rows - F.col(c)) * 100.0, rows)}
        for c in columns
    ]
    return unpivot_row(wide, records).filter("missing_count > 0").orderBy(F.desc("missing_count"))


def category_distribution(df: DataFrame, category: Column | None = None) -> DataFrame:
    """Count and percentage per category, by name."""
    category = epa_short_category(F.col("aqi")) if category is None else category
    counts = df.groupBy(category.alias("category")).agg(_rows().alias("n"))
    # at most one row per category reaches this window
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())
    return counts.withColumn("percentage", share).orderBy("category")


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram; the last bin includes the maximum; empty bins are kept."""
    known = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    ends = known.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(
        F.struct(
            F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        ).alias("ends"))
    placed = known.withColumn("e", ends.scalar())
    width = F.col("e.hi") - F.col("e.lo")
    position = F.floor((F.col("x") - F.col("e.lo")) / width * bins)
    counts = placed.groupBy(F.least(position, F.lit(bins - 1)).cast("int").alias("bin")).agg(_rows().alias("n"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = frame.join(counts, "bin", "left").withColumn("e", ends.scalar())
    edge = lambda k: F.col("e.lo") + width * k / F.lit(float(bins))
    return out.select(
        "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n")).filter(F.col("low").isNotNull())


def box_plot(df: DataFrame, column: str = "aqi", s: Series = Series()) -> DataFrame:
    """Quartiles, whiskers within 1.5 interquartile ranges, and the number of outliers."""
    known = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    ranks = exact_percentiles(known, ["x"], [0.25, 0.5, 0.75], None, s).toDF("q1", "median", "q3")
    ranks = ranks.select(F.struct("q1", "median", "q3").alias("q"))
    rows = known.withColumn("q", ranks.scalar())
    reach = (F.col("q.q3") - F.col("q.q1")) * 1.5
    inside = F.col("x").between(F.col("q.q1") - reach, F.col("q.q3") + reach)
    return rows.agg(
        F.first("q.q1").alias("q1"), F.first("q.median").alias("median"), F.first("q.q3").alias("q3"),
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))


def pair_correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson's r of each pair over the rows that know both: (x, y, n, r).

    Rows are grouped by which columns they miss. Within such a group every sum
    is shared by all pairs, so one product per pair is enough; the few group
    rows are then added up per pair. Values are centred on their means first.
    r is NULL where either column is constant.
    """
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("means")).scalar()
    centred = df.select(*columns).withColumn("_m", means).select(
        *[(F.col(c).cast("double") - F.col("_m")[c]).alias(c) for c in columns])
    missing = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    at = {c: i for i, c in enumerate(columns)}
    groups = centred.groupBy(missing.alias("_missing")).agg(
        _rows().alias("n"),
        F.array(*[F.sum(c) for c in columns]).alias("sums"),
        F.array(*[F.sum(F.col(c) * F.col(c)) for c in columns]).alias("squares"),
        F.array(*[F.min(c) for c in columns]).alias("lows"),
        F.array(*[F.max(c) for c in columns]).alias("highs"),
        F.array(*[F.sum(F.col(x) * F.col(y)) for x, y in pairs]).alias("products"))
    names = F.array(*[F.lit(c) for c in columns])
    places = {s: F.array(*[F.lit(at[p[i]]) for p in pairs]) for i, s in enumerate("xy")}
    parts = groups.select("*", F.posexplode("products").alias("_pair", "xy")).withColumns(
        {f"_{s}": F.get(places[s], F.col("_pair")) for s in "xy"})
    known = lambda c: F.when(F.col("xy").isNotNull(), c)
    pick = lambda array, s: known(F.get(F.col(array), F.col(f"_{s}")))
    out = parts.groupBy(*[F.get(names, F.col(f"_{s}")).alias(s) for s in "xy"]).agg(
        F.sum(known(F.col("n"))).alias("n"), F.sum("xy").alias("xy"),
        *[f(pick(array, s)).alias(f"{s}_{name}") for s in "xy" for name, array, f in (
            ("sum", "sums", F.sum), ("square", "squares", F.sum), ("min", "lows", F.min), ("max", "highs", F.max))])
    col = F.col
    spread = lambda s: col(f"{s}_square") - col(f"{s}_sum") * col(f"{s}_sum") / col("n")
    together = col("xy") - col("x_sum") * col("y_sum") / col("n")
    r = F.try_divide(together, F.sqrt(spread("x") * spread("y")))
    varies = (col("x_min") < col("x_max")) & (col("y_min") < col("y_max"))
    return out.select("x", "y", F.coalesce("n", F.lit(0)).alias("n"),
                      F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"))


def correlation_with(df: DataFrame, target: str = "aqi", columns: list[str] | None = None,
                     top: int | None = None) -> DataFrame:
    """Correlation of each numeric column with ``target``, highest first."""
    columns = columns or numeric_columns(df)
    out = pair_correlations(df, [(c, target) for c in columns]).select(F.col("x").alias("column"), "r")
    out = out.orderBy(F.desc_nulls_last("r"), "column")
    return out if top is None else out.limit(top)


def correlation_matrix(df: DataFrame, columns: list[str] = V.CORRELATION_FEATURES) -> DataFrame:
    """All pairs (x, y, r) of the given columns that exist; each pair is computed once."""
    columns = [c for c in columns if c in df.columns]
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i:]]
    sides = F.when(F.col("x") == F.col("y"), F.array(F.struct("x", "y"))).otherwise(
        F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
    return pair_correlations(df, pairs).select(F.explode(sides).alias("p"), "r").select("p.x", "p.y", "r")


def pollutant_ranges(df: DataFrame, columns: list[str] = V.POLLUTANTS) -> DataFrame:
    columns = [c for c in columns if c in df.columns]
    wide = df.agg(*[
        f(c).alias(f"{c}_{n}") for c in columns
        for n, f in {"mean": F.avg, "min": F.min, "max": F.max}.items()])
    return unpivot_row(wide, [
        {"pollutant": F.lit(c), **{n: F.col(f"{c}_{n}") for n in ("mean", "min", "max")}}
        for c in columns])


def trend_lines(df: DataFrame, target: str = "aqi", columns: list[str] = V.POLLUTANTS) -> DataFrame:
    """Least-squares line of ``target`` on each pollutant; NULL on a constant pollutant."""
    columns = [c for c in columns if c in df.columns]
    y = F.col(target).cast("double")
    wide = df.agg(*[
        f(y, F.col(c)).alias(f"{c}_{n}") for c in columns
        for n, f in {"slope": F.regr_slope, "intercept": F.regr_intercept}.items()])
    return unpivot_row(wide, [
        {"pollutant": F.lit(c), "slope": F.col(f"{c}_slope"), "intercept": F.col(f"{c}_intercept")}
        for c in columns])
