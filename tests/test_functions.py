"""Hand-worked values of the scalar functions."""

import datetime

import pytest
from pyspark.sql import functions as F

from breezeway.functions import bands, calendar, derived


def values(spark, column, inputs, ddl="x double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, {ddl}")
    return [r["out"] for r in df.select("i", column.alias("out")).orderBy("i").collect()]


def test_pm25_index(spark):
    inputs = [-1.0, 0.0, 12.0, 12.05, 12.1, 21.32, 35.4, 500.4, 500.5, float("nan"), None]
    assert values(spark, bands.epa_index_pm25(F.col("x")), inputs) == [
        0, 0, 50, 0, 51, 70, 100, 500, 500, 0, None]


def test_pm10_index(spark):
    inputs = [54.0, 54.5, 55.0, 154.0, 604.0, 605.0, -3.0]
    assert values(spark, bands.epa_index_pm10(F.col("x")), inputs) == [50, 0, 51, 100, 500, 500, 0]


def test_five_step_limits(spark):
    inputs = [1.0, 1.5, 1.6, 2.5, 3.5, 4.5, 4.51, None]
    assert values(spark, bands.five_step_category(F.col("x")), inputs) == [
        "Good", "Good", "Fair", "Fair", "Moderate", "Poor", "Very Poor", None]
    assert values(spark, bands.five_step_text_colour(F.col("x")), [2.5, 2.6]) == ["black", "white"]


def test_epa_record(spark):
    out = values(spark, bands.epa_record(F.col("x")), [50.0, 100.5, 301.0])
    assert [(r["category"], r["level"]) for r in out] == [
        ("Good", 1), ("Unhealthy for Sensitive Groups", 3), ("Hazardous", 6)]
    assert values(spark, bands.epa_short_category(F.col("x")), [120.0]) == ["Unhealthy for Sensitive"]


def test_index_range_names(spark):
    assert values(spark, bands.index_range_name(F.col("x")), [0.0, 50.5, 51.0, 500.0, 501.0]) == [
        "good", None, "moderate", "hazardous", None]


def test_display_round_matches_python(spark):
    inputs = [1.0, 2.175, 2.665, 2.675, 3.125, 3.375, 4.9999, 5.0, 1.005, 2.25, 2.35, 1.15]
    for places in (1, 2):
        assert values(spark, bands.display_round(F.col("x"), places), inputs) == [round(v, places) for v in inputs]


def test_clip_keeps_null(spark):
    assert values(spark, bands.clip_index(F.col("x")), [0.2, 3.3, 9.0, None]) == [1.0, 3.3, 5.0, None]


def test_scales(spark):
    assert values(spark, bands.scale_of_value(F.col("x")), [0.0, 1.0, 5.0, 5.5, 6.0, 500.0, 501.0]) == [
        "unusual", "1-5", "1-5", "unusual", "EPA", "EPA", "unusual"]


def test_calendar(spark):
    monday = datetime.datetime(2024, 1, 1, 7, 30)
    saturday = datetime.datetime(2024, 1, 6, 21, 0)
    for f, want in [(calendar.day_of_week, [0, 5]), (calendar.is_weekend, [0, 1]), (calendar.is_rush_hour, [1, 0])]:
        assert values(spark, f(F.col("x")), [monday, saturday], "x timestamp") == want
    assert values(spark, calendar.version_stamp(F.col("x")), [monday], "x timestamp") == ["v20240101_0730"]
    assert values(spark, calendar.horizon_hours(F.col("x")), ["24h", "all"], "x string") == [24, None]


def test_parse_falls_back(spark):
    fallback = F.lit(datetime.datetime(2020, 1, 1))
    out = values(spark, calendar.parse_or(F.col("x"), fallback), ["2024-05-06 07:08:09", "soon", None], "x string")
    assert out == [datetime.datetime(2024, 5, 6, 7, 8, 9), datetime.datetime(2020, 1, 1), datetime.datetime(2020, 1, 1)]


def test_row_check_reports_first_rule(spark):
    df = spark.createDataFrame(
        [(1, "3", 1.0), (2, None, None), (3, "x", -1.0), (4, "-2", None), (5, "1", None)],
        "i int, pm2_5 string, pm10 double")
    out = {r["i"]: (r["valid"], r["error"]) for r in derived.with_row_check(df, ["pm2_5", "pm10"]).collect()}
    assert out == {
        1: (True, ""), 2: (False, "Missing required feature: pm2_5"),
        3: (False, "Invalid type for pm2_5: expected number"),
        4: (False, "Invalid value for pm2_5: must be non-negative"),
        5: (False, "Missing required feature: pm10")}
    absent = derived.with_row_check(df, ["humidity"]).select("error").distinct().collect()
    assert [r["error"] for r in absent] == ["Missing required feature: humidity"]


@pytest.mark.parametrize("top,bottom,want", [(1.0, 1.0, 1 / 1.000001), (0.0, 0.0, 0.0)])
def test_small_ratio(spark, top, bottom, want):
    df = spark.createDataFrame([(top, bottom)], "a double, b double")
    assert df.select(derived.small_ratio(F.col("a"), F.col("b"))).first()[0] == want


def test_ratio_by_zero_is_null(spark):
    df = spark.createDataFrame([(1.0, -1.0)], "a double, b double")
    assert df.select(derived.unit_ratio(F.col("a"), F.col("b"))).first()[0] is None
