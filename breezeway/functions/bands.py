"""Air-quality index scalars and bands (JVM-side ``when`` chains)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from breezeway.functions import fixed_values as V


def _banded_index(value: Column, bands: list[tuple], top: int) -> Column:
    """Piecewise-linear index over closed bands.

    Values between two bands and below the first give 0, above the last ``top``.
    """
    x = value.cast("double")
    expr = F.when(x.isNull(), None).when(F.isnan(x), 0)
    for low, high, index_low, index_high in bands:
        slope = (index_high - index_low) / (high - low)
        inside = F.bround(F.lit(slope) * (x - F.lit(float(low))) + F.lit(float(index_low)), 0)
        expr = expr.when(x.between(float(low), float(high)), inside.cast("int"))
    return expr.when(x > float(bands[-1][1]), top).otherwise(0).cast("int")


def epa_index_pm25(value: Column) -> Column:
    return _banded_index(value, V.EPA_PM25, V.EPA_MAX_INDEX)


def epa_index_pm10(value: Column) -> Column:
    return _banded_index(value, V.EPA_PM10, V.EPA_MAX_INDEX)


def _pick(value: Column, bands: list[tuple], field: int, relabel: dict | None = None) -> Column:
    """Value of ``field`` in the first band whose upper bound holds ``value``.

    A missing value has no band; NaN compares false and lands in the open one.
    """
    relabel = relabel or {}
    expr = F.when(value.isNull(), None)
    for band in bands:
        out = F.lit(relabel.get(band[field], band[field]))
        if band[0] is None:
            return expr.otherwise(out)
        expr = expr.when(value <= F.lit(band[0]), out)
    return expr


def five_step_category(value: Column) -> Column:
    return _pick(value, V.FIVE_STEP_BANDS, 1)


def five_step_colour(value: Column) -> Column:
    return _pick(value, V.FIVE_STEP_BANDS, 2)


def five_step_message(value: Column) -> Column:
    return _pick(value, V.FIVE_STEP_BANDS, 3)


def five_step_text_colour(value: Column) -> Column:
    return F.when(value.isNull(), None).when(value <= V.DARK_TEXT_UP_TO, "black").otherwise("white")


def epa_category(value: Column) -> Column:
    return _pick(value, V.EPA_BANDS, 1)


def epa_short_category(value: Column) -> Column:
    return _pick(value, V.EPA_BANDS, 1, V.EPA_SHORT_LABELS)


def epa_record(value: Column) -> Column:
    """struct(category, colour, level, message) of an EPA index."""
    return F.struct(
        epa_category(value).alias("category"),
        _pick(value, V.EPA_BANDS, 2).alias("color"),
        _pick(value, V.EPA_BANDS, 3).alias("level"),
        _pick(value, V.EPA_BANDS, 4).alias("message"),
    )


def index_range_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.INDEX_RANGES, "name string, low int, high int")


def index_range_name(value: Column) -> Column:
    """Name of the closed integer range holding ``value``; NULL between ranges."""
    expr = F.when(F.lit(False), None)
    for name, low, high in V.INDEX_RANGES:
        expr = expr.when(value.between(low, high), name)
    return expr


def scale_of_range(low: Column, high: Column) -> Column:
    """Which index scale a column with this minimum and maximum uses."""
    return (
        F.when(low.isNull() | high.isNull(), None)
        .when((high <= 5) & (low >= 1), "1-5")
        .when((high <= 500) & (low >= 0), "EPA")
        .otherwise("unusual")
    )


def scale_of_value(value: Column) -> Column:
    return (
        F.when(value.isNull(), None)
        .when(value.between(1, 5), "1-5")
        .when(value.between(6, 500), "EPA")
        .otherwise("unusual")
    )


def display_round(value: Column, places: int) -> Column:
    """Round an index for display by its exact binary value, half to even.

    ``F.round`` looks at the shortest decimal form, so 2.175 (just below the
    half in binary) would go up. The value is scaled to whole multiples of
    2**-52, which is exact from 1 to 16; other values use ``F.round``.
    """
    scale = 10**places
    units = (value * F.lit(float(1 << 52))).try_cast("long") * scale
    whole, rest = F.shiftright(units, 52), units.bitwiseAND(F.lit((1 << 52) - 1))
    half = F.lit(1 << 51)
    up = (rest > half) | ((rest == half) & (whole % 2 == 1))
    exact = (whole + up.cast("long")) / F.lit(float(scale))
    return F.when(value.between(1, 16), exact).otherwise(F.round(value, places))


def clip_index(value: Column, low: float = 1.0, high: float = 5.0) -> Column:
    """Clip to the five-step scale; NULL stays NULL."""
    return F.when(
        value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value.cast("double")))
    )
