"""Feature sets. Each one shuffles and sorts its rows once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from breezeway.functions.calendar import calendar_columns
from breezeway.functions.derived import (
    pollution_products, present, weather_products, weather_products_with_defaults,
)
from breezeway.operators.quality import data_quality
from breezeway.operators.series import Series, attach, with_window_steps, with_windows
from breezeway.operators.shape import drop_missing, ensure_columns
from breezeway.operators.windows import (
    DOUBLING, LAG_SETS, change_columns, day_rolling_name, day_rolling_parts, full_mean_columns, lag_columns,
    weather_change_columns, with_frame_columns, zero_deviation,
)
from breezeway.session import materialise

FULL_CALENDAR = ["hour", "day_of_week", "day_of_month", "month", "is_weekend",
                 "hour_sin", "hour_cos", "month_sin", "month_cos"]
ADVANCED_CALENDAR = ["hour", "day_of_week", "month", "day_of_month", "is_weekend", "is_rush_hour",
                     "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos"]
SIMPLE_CALENDAR = ["hour", "day_of_week", "is_weekend", "hour_sin", "hour_cos"]
ADAPTIVE_CALENDAR = [*SIMPLE_CALENDAR, "dow_sin", "dow_cos"]
SIMPLE_WEATHER = ["temperature", "humidity", "pressure", "wind_speed", "clouds"]
ADAPTIVE_WEATHER = ["pm2_5", "pm10", *SIMPLE_WEATHER]
ADVANCED_RAW = ["pm2_5", "pm10", *SIMPLE_WEATHER]
SHORT_SIZES = [3, 6]
ADVANCED_SIZES = DOUBLING
ADVANCED_ROLLING = {"pm2_5": ["mean", "std", "max", "min"], "aqi": ["mean", "std"]}
ADVANCED_BACK = 48


def hours_of(horizon: str) -> int:
    return int(horizon.replace("h", ""))


def lead_columns(w: WindowSpec, targets: dict[str, int]) -> list[Column]:
    return [F.lead("aqi", h).over(w).alias(name) for name, h in targets.items()]


def full_features(df: DataFrame, horizons: list[str] | None = None, s: Series = Series()) -> DataFrame:
    """Calendar, lags, 24-row statistics and weather products; each block needs its inputs."""
    tracked = [c for c in LAG_SETS["full"][0] if c in df.columns]
    targets = {f"aqi_{h}_ahead": hours_of(h) for h in horizons or []} if "aqi" in df.columns else {}

    products = weather_products(df)

    def steps(rows: DataFrame, w: WindowSpec) -> DataFrame:
        ordered = [*lag_columns(w, tracked, LAG_SETS["full"][1]), *lead_columns(w, targets)]
        own = [*calendar_columns(F.col(s.ts), FULL_CALENDAR), *products]
        return zero_deviation(with_frame_columns(
            rows, w, day_rolling_parts(tracked), [24], day_rolling_name, own, ordered))

    return with_window_steps(df, steps, s, back=24, ahead=max(targets.values(), default=0))


def simple_features(df: DataFrame, forecast_hours: int = 24, s: Series = Series(),
                    subset: list[str] | None = None) -> DataFrame:
    """Short lags and full-frame means with the target; rows missing any value are dropped.

    ``subset=None`` looks at every column, so rows without a gust value go too;
    ``subset=[]`` drops nothing.
    """
    df = ensure_columns(df, SIMPLE_WEATHER)
    columns, lags = LAG_SETS["simple"]

    def build(w: WindowSpec) -> list[Column]:
        return [
            *lag_columns(w, columns, lags),
            *full_mean_columns(w, columns, SHORT_SIZES),
            *calendar_columns(F.col(s.ts), SIMPLE_CALENDAR),
            *lead_columns(w, {f"target_aqi_{forecast_hours}h": forecast_hours}),
        ]

    out = with_windows(df, build, s, back=6, ahead=forecast_hours)
    return out if subset == [] else drop_missing(out, subset)


def adaptive_features(df: DataFrame, use_lags: bool = False, s: Series = Series(),
                      targets: dict[str, int] | None = None) -> DataFrame:
    """Calendar and current weather; with ``use_lags`` also short lags and means."""
    df = ensure_columns(df, ADAPTIVE_WEATHER)
    calendar = calendar_columns(F.col(s.ts), ADAPTIVE_CALENDAR)
    if not use_lags and not targets:
        return df.select("*", *calendar)
    columns, lags = LAG_SETS["simple"]

    def build(w: WindowSpec) -> list[Column]:
        history = [*lag_columns(w, columns, lags), *full_mean_columns(w, columns, SHORT_SIZES)]
        return [*calendar, *(history if use_lags else []), *lead_columns(w, targets or {})]

    return with_windows(df, build, s, back=6, ahead=max((targets or {}).values(), default=0))


def adaptive_leads(horizons: list[str]) -> dict[str, int]:
    return {f"_lead_{h}": hours_of(h) for h in horizons}


def pick_adaptive_targets(df: DataFrame, quality: DataFrame, horizons: list[str], s: Series = Series()) -> DataFrame:
    """Per entity: the future index where it has a long enough run, else the current one.

    Needs the lead columns of ``adaptive_leads``; adds ``target_aqi_<h>`` for
    each horizon, ``model_type`` and the quality columns.
    """
    out = attach(df, quality, list(s.key), quality.count())
    picked = {
        f"target_aqi_{h}": F.when(F.col("can_forecast"), F.col(f"_lead_{h}")).otherwise(F.col("aqi"))
        for h in horizons
    }
    kind = F.when(F.col("can_forecast"), "Forecasting").otherwise("Nowcasting")
    return out.withColumns(picked).withColumn("model_type", kind).drop(*adaptive_leads(horizons))


def adaptive_targets(df: DataFrame, horizons: list[str], s: Series = Series()) -> DataFrame:
    leads = adaptive_leads(horizons)
    ahead = with_windows(df, lambda w: lead_columns(w, leads), s, ahead=max(leads.values()))
    return pick_adaptive_targets(ahead, materialise(data_quality(df, s), "quality"), horizons, s)


def advanced_features(df: DataFrame, s: Series = Series(), targets: dict[str, int] | None = None) -> DataFrame:
    """The 75 engineered columns of the tuned models, used for training and serving alike."""
    columns, lags = LAG_SETS["advanced"]

    def steps(rows: DataFrame, w: WindowSpec) -> DataFrame:
        ordered = [
            *lag_columns(w, columns, lags), *change_columns(w), *weather_change_columns(w),
            *lead_columns(w, targets or {}),
        ]
        own = [*calendar_columns(F.col(s.ts), ADVANCED_CALENDAR), *pollution_products()]
        return with_frame_columns(rows, w, ADVANCED_ROLLING, ADVANCED_SIZES, own=own, last=ordered)

    ahead = max((targets or {}).values(), default=0)
    return with_window_steps(df, steps, s, back=ADVANCED_BACK, ahead=ahead)


def advanced_feature_names() -> list[str]:
    """The 82 model inputs: 7 raw columns and the engineered ones."""
    columns, lags = LAG_SETS["advanced"]
    return [
        *ADVANCED_RAW,
        *ADVANCED_CALENDAR,
        *[f"{c}_lag_{n}h" for n in lags for c in columns],
        *[f"{c}_rolling_{how}_{n}h" for n in ADVANCED_SIZES
          for c, hows in ADVANCED_ROLLING.items() for how in hows],
        *[f"pm2_5_change_{n}h" for n in (1, 3, 6)],
        "pm2_5_x_wind", "pm2_5_x_humidity", "pm2_5_x_temp",
        "wind_x_humidity", "temp_x_humidity", "pm2_5_pm10_ratio",
        "temp_change", "wind_change", "pressure_change",
    ]


def single_row_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Features of rows served without history: lags 0, means = current values, deviation 0."""
    lags = [F.lit(0.0).alias(f"{c}_lag_{n}h") for c in ("pm2_5", "pm10", "aqi") for n in (1, 3, 6, 12, 24)]
    return df.select(
        "*",
        *calendar_columns(F.col(ts), FULL_CALENDAR),
        *weather_products_with_defaults(df),
        *lags,
        present(df, "pm2_5", 0.0).alias("pm2_5_rolling_24h_mean"),
        F.lit(0.0).alias("pm2_5_rolling_24h_std"),
        present(df, "pm10", 0.0).alias("pm10_rolling_24h_mean"),
        F.coalesce(F.col("aqi").cast("double"), F.lit(0.0)).alias("aqi_rolling_24h_mean"),
    )


def time_features(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """The nine calendar features of every timestamp."""
    return df.select("*", *calendar_columns(F.col(ts), FULL_CALENDAR))


def interaction_features(df: DataFrame) -> DataFrame:
    """The four weather products with their defaults."""
    return df.select("*", *weather_products_with_defaults(df))
