"""Window columns over one entity's rows; frames count rows, not hours."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from breezeway.functions import fixed_values as V
from breezeway.functions.calendar import MICROS_PER_MINUTE, micros
from breezeway.operators.series import Series, with_last_known, with_positions, with_runs, with_window_steps, with_windows

LAG_SETS = {
    "full": (["pm2_5", "pm10", "aqi"], [1, 3, 6, 12, 24]),
    "simple": (["aqi", "pm2_5"], [1, 3, 6]),
    "advanced": (["pm2_5", "pm10", "aqi"], [1, 2, 3, 6, 12, 24, 48]),
}


# Column builders: they take the ordered window and return aliased columns.

def lag_columns(w: WindowSpec, columns: list[str], lags: list[int]) -> list[Column]:
    return [F.lag(c, n).over(w).alias(f"{c}_lag_{n}h") for n in lags for c in columns]


def rows_back(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), Window.currentRow)


def rolling(w: WindowSpec, column: str, n: int, how: str) -> Column:
    """Rolling ``how`` over the last ``n`` rows, partial frames allowed."""
    f = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min}[how]
    return f(column).over(rows_back(w, n))


def rolling_full_mean(w: WindowSpec, column: str, n: int) -> Column:
    """Rolling mean that is NULL unless all ``n`` values are known."""
    frame = rows_back(w, n)
    return F.when(F.count(column).over(frame) == n, F.avg(column).over(frame))


def change(w: WindowSpec, column: str, n: int) -> Column:
    return F.col(column) - F.lag(column, n).over(w)


def full_mean_columns(w: WindowSpec, columns: list[str], sizes: list[int]) -> list[Column]:
    return [rolling_full_mean(w, c, n).alias(f"{c}_rolling_mean_{n}h") for n in sizes for c in columns]


# Doubling frames. A frame of 2k rows is the frame of the last k rows merged with
# the same frame k rows back, so a size costs a few lags instead of a pass over
# its rows: 3 from the values, 6 and 12 from 3, 24 and 48 from 12. A frame's
# state is up to five plain columns: n, total, q (the sum of squared deviations,
# merged by the pairwise formula, which is as stable as one pass), high and low;
# only those that the wanted statistics need are kept.

DOUBLING = [3, 6, 12, 24, 48]
STATE_PARTS = {"mean": ["n", "total"], "std": ["n", "total", "q"], "max": ["high"], "min": ["low"]}


def _needed(hows: list[str]) -> list[str]:
    return [p for p in ("n", "total", "q", "high", "low") if any(p in STATE_PARTS[h] for h in hows)]


# The state arithmetic is SQL text: one call per column instead of dozens.

def _zero(name: str) -> str:
    return f"coalesce({name}, 0D)"


def _first_state(values: list[str]) -> dict[str, str]:
    """State of the few given values, any of them may be missing."""
    values = [f"cast(`{v}` as double)" for v in values]
    n = " + ".join(f"if({v} is null, 0D, 1D)" for v in values)
    total = " + ".join(_zero(v) for v in values)
    mean = f"try_divide({total}, {n})"
    return {
        "n": n, "total": total,
        "q": " + ".join(_zero(f"({v} - {mean}) * ({v} - {mean})") for v in values),
        "high": f"greatest({', '.join(values)})", "low": f"least({', '.join(values)})",
    }


def _merged(a: str, b: str) -> dict[str, str]:
    """State of two adjoining frames, given by name prefix; one before the first row is NULL."""
    apart = f"(try_divide(`{b}_total`, `{b}_n`) - try_divide(`{a}_total`, `{a}_n`))"
    between = f"{apart} * {apart} * try_divide(`{a}_n` * `{b}_n`, `{a}_n` + `{b}_n`)"
    added = {p: f"{_zero(f'`{a}_{p}`')} + {_zero(f'`{b}_{p}`')}" for p in ("n", "total", "q")}
    return added | {
        "q": f"{added['q']} + {_zero(between)}",
        "high": f"greatest(`{a}_high`, `{b}_high`)", "low": f"least(`{a}_low`, `{b}_low`)",
    }


def from_state(column: str, n: int, how: str) -> Column:
    """A statistic of the last ``n`` rows; partial frames at the start count as they are."""
    s = f"_{column}_last_{n}"
    return F.expr({
        "mean": f"try_divide(`{s}_total`, `{s}_n`)",
        "std": f"if(`{s}_n` > 1D, sqrt(`{s}_q` / (`{s}_n` - 1D)), null)",
        "max": f"`{s}_high`", "min": f"`{s}_low`",
    }[how])


Label = Callable[[str, str, int], str]


def rolling_name(column: str, how: str, n: int) -> str:
    return f"{column}_rolling_{how}_{n}h"


def day_rolling_name(column: str, how: str, n: int) -> str:
    return f"{column}_rolling_{n}h_{how}"


def with_frame_columns(df: DataFrame, w: WindowSpec, wanted: dict[str, list[str]], sizes: list[int],
                       label: Label = rolling_name, own: list[Column] | None = None,
                       last: list[Column] | None = None) -> DataFrame:
    """Add statistics of the last 3, 6, 12, 24 or 48 rows.

    ``wanted`` maps columns to statistics. The per-row columns ``own`` are added
    after the first lags and the window columns ``last`` ride along with the
    last ones: this spreads the work over the steps, so that the generated code
    of each stays small enough to be compiled, and keeps the rows narrow.
    """
    parts = {c: _needed(hows) for c, hows in wanted.items()}
    upto = max(sizes)

    def lagged(df: DataFrame, lags: dict[str, tuple[str, int]], final: bool) -> DataFrame:
        ride = last if final and last else []
        return df.select("*", *[F.lag(c, k).over(w).alias(name) for name, (c, k) in lags.items()], *ride)

    def named(states: dict[str, tuple[str, dict[str, str]]]) -> dict[str, Column]:
        return {f"{prefix}_{p}": F.expr(state[p]) for c, (prefix, state) in states.items() for p in parts[c]}

    def finished(df: DataFrame, ready: list[int], keep: int | None) -> DataFrame:
        """Turn the states of ``ready`` into statistics; only the state of ``keep`` rows stays."""
        stats = {
            label(c, how, n): from_state(c, n, how)
            for n in ready if n in sizes for c, hows in wanted.items() for how in hows
        }
        done = [f"_{c}_last_{n}_{p}" for n in ready if n != keep for c in parts for p in parts[c]]
        return df.withColumns(stats).drop(*done) if stats else df.drop(*done)

    recent = {f"_{c}_{k}_back": (c, k) for c in parts for k in (1, 2)}
    df = lagged(df, recent, upto == 3)
    df = df.withColumns(named({
        c: (f"_{c}_last_3", _first_state([c, f"_{c}_1_back", f"_{c}_2_back"]))
        for c in parts
    })).drop(*recent).select("*", *(own or []))
    if upto == 3:
        return finished(df, [3], None)
    for base in (3, 12):
        reach = [n for n in (2 * base, 4 * base) if n <= upto]
        earlier = {
            f"_{c}_earlier_{k}_{p}": (f"_{c}_last_{base}_{p}", base * k)
            for c in parts for k in range(1, max(reach) // base) for p in parts[c]
        }
        df = lagged(df, earlier, max(reach) == upto)
        df = df.withColumns(named({
            c: (f"_{c}_last_{2 * base}", _merged(f"_{c}_last_{base}", f"_{c}_earlier_1"))
            for c in parts}))
        if 4 * base in reach:
            df = df.withColumns(named({
                c: (f"_{c}_pair", _merged(f"_{c}_earlier_2", f"_{c}_earlier_3")) for c in parts}))
            df = df.withColumns(named({
                c: (f"_{c}_last_{4 * base}", _merged(f"_{c}_last_{2 * base}", f"_{c}_pair"))
                for c in parts}))
        df = df.drop(*earlier, *[f"_{c}_pair_{p}" for c in parts for p in parts[c]])
        if max(reach) == upto:
            return finished(df, [base, *reach], None)
        df = finished(df, [3, 6], keep=12)
    return df


def day_rolling_parts(columns: list[str]) -> dict[str, list[str]]:
    return {c: ["mean", "std"] if c == "pm2_5" else ["mean"] for c in columns}


def zero_deviation(df: DataFrame) -> DataFrame:
    """A single value has no deviation; the 24-row column shows 0 for it."""
    name = day_rolling_name("pm2_5", "std", 24)
    return df.withColumn(name, F.coalesce(F.col(name), F.lit(0.0))) if name in df.columns else df


def with_rolling(df: DataFrame, parts: dict[str, list[str]], sizes: list[int] = DOUBLING,
                 s: Series = Series()) -> DataFrame:
    """Rolling statistics of the last so many rows, partial frames allowed.

    3, 6, 12, 24 and 48 rows are merged from smaller frames; other sizes take a plain frame.
    """
    doubling = [n for n in sizes if n in DOUBLING]
    others = [n for n in sizes if n not in DOUBLING]

    def steps(rows: DataFrame, w: WindowSpec) -> DataFrame:
        rows = with_frame_columns(rows, w, parts, doubling) if doubling else rows
        plain = [rolling(w, c, n, how).alias(rolling_name(c, how, n))
                 for n in others for c, hows in parts.items() for how in hows]
        return rows.select("*", *plain)

    return with_window_steps(df, steps, s, back=max(sizes))


def with_day_rolling(df: DataFrame, columns: list[str], s: Series = Series()) -> DataFrame:
    """24-row means, and the deviation of pm2_5."""
    def steps(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return zero_deviation(with_frame_columns(rows, w, day_rolling_parts(columns), [24], day_rolling_name))

    return with_window_steps(df, steps, s, back=24)


def change_columns(w: WindowSpec) -> list[Column]:
    return [change(w, "pm2_5", n).alias(f"pm2_5_change_{n}h") for n in (1, 3, 6)]


def weather_change_columns(w: WindowSpec) -> list[Column]:
    names = {"temperature": "temp_change", "wind_speed": "wind_change", "pressure": "pressure_change"}
    return [change(w, c, 1).alias(name) for c, name in names.items()]


def gap_micros(w: WindowSpec, ts: str) -> Column:
    now = micros(F.col(ts))
    return now - F.lag(now, 1).over(w)


def opens_run(w: WindowSpec, ts: str, minutes: int = V.RUN_GAP_MINUTES) -> Column:
    """True on the first row and after a gap of more than ``minutes``."""
    return F.coalesce(gap_micros(w, ts) > minutes * MICROS_PER_MINUTE, F.lit(True))


# Operators.

def with_lags(df: DataFrame, which: str = "full", s: Series = Series()) -> DataFrame:
    columns, lags = LAG_SETS[which]
    return with_windows(df, lambda w: lag_columns(w, columns, lags), s, back=max(lags))


def with_gap(df: DataFrame, s: Series = Series(), name: str = "gap_micros") -> DataFrame:
    """Microseconds since the previous row of the entity."""
    return with_windows(df, lambda w: [gap_micros(w, s.ts).alias(name)], s, back=1)


def with_run_id(df: DataFrame, s: Series = Series(), minutes: int = V.RUN_GAP_MINUTES) -> DataFrame:
    return with_runs(df, s, lambda w: opens_run(w, s.ts, minutes), "run_id")


def with_targets(df: DataFrame, hours: list[int], s: Series = Series(), column: str = "aqi",
                 pattern: str = "{column}_{h}h_ahead") -> DataFrame:
    """The value of ``column`` so many rows ahead."""
    def build(w: WindowSpec) -> list[Column]:
        return [F.lead(column, h).over(w).alias(pattern.format(column=column, h=h)) for h in hours]

    return with_windows(df, build, s, ahead=max(hours))


def forward_fill(df: DataFrame, columns: list[str], s: Series = Series(),
                 hours: int = V.FILL_GAP_HOURS) -> DataFrame:
    """Fill a missing value with the last known one if that is younger than ``hours``."""
    df = with_last_known(df, {c: f"_known_{c}" for c in columns}, s)
    filled = {}
    for c in columns:
        age = micros(F.col(s.ts)) - micros(F.col(f"_known_{c}.ts"))
        young = age < hours * 60 * MICROS_PER_MINUTE
        filled[c] = F.coalesce(F.col(c), F.when(young, F.col(f"_known_{c}.value")))
    return df.withColumns(filled).drop(*[f"_known_{c}" for c in columns])


def with_split(df: DataFrame, s: Series = Series(), share: float = 0.8, name: str = "is_train") -> DataFrame:
    """Mark the first ``int(n * share)`` rows of each entity as training rows."""
    df = with_positions(df, s)
    cut = F.floor(F.col("_total") * F.lit(share))
    return df.withColumn(name, F.col("_pos") <= cut).drop("_pos", "_total")
