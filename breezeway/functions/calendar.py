"""Calendar features and timestamp scalars."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_MINUTE = 60_000_000


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, for zoned and zone-less timestamps."""
    return F.unix_micros(ts.cast("timestamp"))


def hour(ts: Column) -> Column:
    return F.hour(ts)


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def is_weekend(ts: Column) -> Column:
    return (day_of_week(ts) >= 5).cast("int")


def is_rush_hour(ts: Column) -> Column:
    h = F.hour(ts)
    return (h.between(7, 10) | h.between(17, 20)).cast("int")


def cycle_sin(value: Column, period: int) -> Column:
    return F.sin(F.lit(2 * math.pi) * value / F.lit(period))


def cycle_cos(value: Column, period: int) -> Column:
    return F.cos(F.lit(2 * math.pi) * value / F.lit(period))


def calendar_columns(ts: Column, names: list[str]) -> list[Column]:
    """The named calendar features of ``ts``, in the order asked for."""
    cycles = {"hour": (F.hour(ts), 24), "dow": (F.weekday(ts), 7), "month": (F.month(ts), 12)}
    built = {
        "hour": hour(ts),
        "day_of_week": day_of_week(ts),
        "day_of_month": F.dayofmonth(ts),
        "month": F.month(ts),
        "is_weekend": is_weekend(ts),
        "is_rush_hour": is_rush_hour(ts),
    }
    for prefix, (value, period) in cycles.items():
        built[f"{prefix}_sin"] = cycle_sin(value, period)
        built[f"{prefix}_cos"] = cycle_cos(value, period)
    return [built[name].alias(name) for name in names]


def parse_or(text: Column, fallback: Column) -> Column:
    """Parse a timestamp; text that does not parse gives ``fallback``."""
    return F.coalesce(F.try_to_timestamp(text), fallback)


def display(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def version_stamp(ts: Column) -> Column:
    return F.date_format(ts, "'v'yyyyMMdd_HHmm")


def horizon_hours(horizon: Column) -> Column:
    """'24h' -> 24."""
    return F.regexp_replace(horizon, "h", "").try_cast("int")


def hours_after(ts: Column, hours: Column) -> Column:
    return F.timestamp_add("HOUR", hours, ts)


def minutes_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(MICROS_PER_MINUTE))
