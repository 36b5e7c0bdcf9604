"""The physical plans are the intended ones."""

import re

import pytest
from pyspark.sql import functions as F

from breezeway.operators import dedup, quality, windows
from breezeway.operators.series import Series
from breezeway.plans import features, serving
from breezeway.sources import readings as scans
from catalog import fixtures as fx


@pytest.fixture(scope="module")
def table(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "readings")
    fx.readings(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(text, operator):
    return len(re.findall(rf"(?m)^[\s:+\-|*()\d]*{operator}\b", text))


@pytest.mark.parametrize("build", [
    lambda t: features.advanced_features(t, targets={"a": 24, "b": 72}),
    lambda t: features.full_features(t, ["24h", "72h"]),
    lambda t: features.simple_features(t, 24),
    lambda t: windows.with_run_id(t),
    lambda t: windows.with_split(t),
    lambda t: windows.forward_fill(t, ["no2", "o3", "so2"]),
    lambda t: quality.data_quality(t),
])
def test_one_shuffle_and_one_sort(table, build):
    text = plan(build(table))
    assert count(text, "Exchange") == 1 and count(text, "Sort") == 1
    assert "Python" not in text


def test_rolling_statistics_take_three_windows(table):
    assert count(plan(features.advanced_features(table)), "Window") == 3


def test_filters_and_columns_reach_the_scan(table):
    text = plan(scans.of_source(table, "sensor").select("seq", "pm2_5"))
    assert "EqualTo(source,sensor)" in text
    assert "ReadSchema: struct<seq:bigint,source:string,pm2_5:double>" in text
    recent = plan(scans.since_days(table, 3, F.lit("2024-01-20").cast("timestamp")).select("seq"))
    assert "GreaterThanOrEqual(timestamp" in recent


def test_features_read_only_their_columns(table):
    text = plan(features.advanced_features(table).select("location", "pm2_5_rolling_std_48h"))
    assert "ReadSchema: struct<seq:bigint,location:string,timestamp:timestamp,pm2_5:double>" in text


def test_top_rows_are_limited_before_the_shuffle(table):
    assert "TakeOrderedAndProject" in plan(scans.latest_n(table, 100))
    assert count(plan(scans.latest_n_each(table, 100)), "WindowGroupLimit") == 2


def test_aggregates_fold_before_the_shuffle(table):
    for df in (scans.latest(table), scans.latest(table, by=["seq"]), dedup.drop_duplicates(table)):
        text = plan(df)
        assert "partial_" in text and "SortAggregate" not in text
    for df in (dedup.duplicate_totals(table),
               quality.daily_coverage(table), serving.weekly_figures(table, 7, F.lit("2024-01-20").cast("timestamp"))):
        text = plan(df)
        assert "partial_" in text and "Window" not in text


def test_no_nested_loop_joins(table):
    """Versions, history and health read their one-row inputs as scalar subqueries."""
    versioned = fx.with_versions(table)
    for df in (scans.of_version_or_all(versioned, "v1"), scans.since_days(table, 7)):
        text = plan(df)
        assert "Subquery" in text and "NestedLoop" not in text and "Cartesian" not in text


def test_huge_entities_are_cut(table):
    text = plan(features.advanced_features(table, Series(max_rows=50)))
    assert "_chunk" in text and "Union" in text
    assert "BroadcastHashJoin" in text


def test_payloads_are_parsed_once(spark, sf):
    from breezeway.sources import landing

    text = plan(landing.merge_payloads(*fx.landed(spark, sf)))
    assert text.count("from_json") == 2
