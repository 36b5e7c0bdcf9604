"""The way huge entities take gives the same rows as the plain window."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from breezeway.operators import quality, windows
from breezeway.operators.percentiles import exact_percentiles, percentile_name
from breezeway.operators.series import Series, running_count, split_by_size, with_positions
from breezeway.plans import features
from breezeway.streaming import gate
from tests.helpers import random_readings, rows_of

PLAIN = Series()
# Entities above 90 rows are huge; a, and by chance others, are cut in several chunks.
CUT = Series(max_rows=90)


@pytest.fixture(scope="module")
def readings(spark):
    return random_readings(spark).cache()


def test_split_finds_only_huge_entities(readings):
    split = split_by_size(readings, CUT)
    counts = {r["location"]: r["count"] for r in readings.groupBy("location").count().collect()}
    hot = {k for k, n in counts.items() if n > 90}
    assert {r["location"] for r in split.hot.select("location").distinct().collect()} == hot
    assert split.hot_rows == sum(counts[k] for k in hot)
    assert split.cold.count() + split.hot.count() == readings.count()
    assert split_by_size(readings, Series(max_rows=10**6)).hot is None


def test_positions(readings):
    assert rows_of(with_positions(readings, CUT)) == rows_of(with_positions(readings, PLAIN))


def test_null_entity_is_kept(readings):
    n = readings.filter("location is null").count()
    assert n > 0
    assert with_positions(readings, CUT).filter("location is null").count() == n


@pytest.mark.parametrize("s", [CUT, Series(max_rows=1)])
def test_advanced_features_with_targets(readings, s):
    targets = {"t24": 24, "t72": 72}
    a = features.advanced_features(readings, PLAIN, targets)
    b = features.advanced_features(readings, s, targets)
    assert a.columns == b.columns
    assert rows_of(a) == rows_of(b)


def test_full_and_simple_features(readings):
    assert rows_of(features.full_features(readings, ["24h", "48h"], CUT)) == rows_of(
        features.full_features(readings, ["24h", "48h"], PLAIN))
    assert rows_of(features.simple_features(readings, 24, CUT)) == rows_of(
        features.simple_features(readings, 24, PLAIN))


def test_runs_and_gaps(readings):
    for f in (windows.with_run_id, windows.with_gap):
        assert rows_of(f(readings, CUT)) == rows_of(f(readings, PLAIN))
    for f in (quality.run_lengths, quality.data_quality, quality.gap_stats, quality.large_gaps):
        assert rows_of(f(readings, CUT)) == rows_of(f(readings, PLAIN))


def test_forward_fill(readings):
    a = windows.forward_fill(readings, ["no2", "o3"], PLAIN)
    assert rows_of(windows.forward_fill(readings, ["no2", "o3"], CUT)) == rows_of(a)
    assert a.filter("no2 is null").count() < readings.filter("no2 is null").count()


def test_carried_value_crosses_empty_chunks(spark):
    """A value known only in the first chunk is still the last known one many chunks later."""
    rows = spark.range(500).select(
        F.col("id").alias("seq"), F.lit("a").alias("location"),
        F.timestamp_seconds(F.col("id")).alias("timestamp"),
        F.when(F.col("id") == 3, 7.0).alias("v"))
    out = windows.forward_fill(rows, ["v"], Series(max_rows=40))
    assert out.filter("v = 7.0").count() == 497


def test_time_split(readings):
    assert rows_of(windows.with_split(readings, CUT)) == rows_of(windows.with_split(readings, PLAIN))


@pytest.mark.parametrize("by", [[], ["location"]])
def test_exact_percentiles(readings, by):
    columns, probs = ["pm2_5", "no2"], [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    a = exact_percentiles(readings, columns, probs, by, PLAIN)
    b = exact_percentiles(readings, columns, probs, by, Series(max_rows=30))
    assert a.columns == b.columns
    assert rows_of(a) == rows_of(b)


def test_percentiles_with_one_dominant_value(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    s = Series(max_rows=10)
    assert rows_of(exact_percentiles(df, ["v"], [0.5, 0.95], None, s)) == rows_of(
        exact_percentiles(df, ["v"], [0.5, 0.95]))


def test_percentiles_of_all_magnitudes(spark):
    """Against numpy: both signs, all powers of two, neighbours in the last bit, infinities, one huge group."""
    rng = np.random.default_rng(3)
    close = np.nextafter(1.0, 2.0) + np.arange(700) * np.spacing(1.0)
    wide = rng.choice([-1.0, 1.0], 900) * 2.0 ** rng.uniform(-1070, 1020, 900)
    groups = {"close": close, "wide": wide, "few": np.array([3.0, -0.0, 0.0, 5e-324]), "one": np.array([-7.25]),
              "same": np.full(300, 2.5), "far": np.array([-np.inf, -1.0, 4.0, 9.0, np.inf]),
              "large": np.round(rng.normal(size=5000), 2)}
    df = spark.createDataFrame([(g, float(v), float(i)) for g, vs in groups.items() for i, v in enumerate(vs)], "g string, v double, w double")
    probs = [0.0, 0.013, 0.25, 0.5, 0.75, 0.987, 1.0]
    for row in exact_percentiles(df, ["v", "w"], probs, ["g"]).collect():
        values = np.sort(groups[row.g])
        for name, known in (("v", values), ("w", np.arange(len(values)).astype(float))):
            for p in probs:
                place = (len(known) - 1) * p
                low, high, weight = known[math.floor(place)], known[math.ceil(place)], place - math.floor(place)
                want = low if low == high else low * (1 - weight) + high * weight
                got = row[percentile_name(name, p)]
                assert got == want or (math.isnan(got) and math.isnan(want))


def test_percentiles_take_few_jobs_and_no_sort_of_the_values(spark):
    df = spark.range(100_000).select((F.col("id") % 3).alias("g"), F.sqrt("id").alias("v"))
    got = {r.g: r.v_p50 for r in exact_percentiles(df, ["v"], [0.5], ["g"]).collect()}
    want = df.groupBy("g").agg(F.percentile("v", F.lit(0.5)).alias("p")).collect()
    assert got == {r.g: r.p for r in want}


def test_running_count(spark):
    counts = spark.range(100).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"), F.lit(3).alias("n"))
    out = running_count(counts, ["g"], "v", "n", Series(max_rows=7))
    for row in out.collect():
        assert row["_upto"] == (row["v"] // 2 + 1) * 3
        assert row["_all"] == 150


def polls(readings):
    """Slowly changing values, so that the gate rejects many."""
    return readings.withColumns({
        "aqi": F.lit(2), "pm2_5": F.floor(F.col("pm2_5") / 40) * 40.0, "temperature": F.lit(20.0)})


@pytest.mark.parametrize("max_rows", [90, 20, 5])
def test_gate(readings, max_rows):
    df = polls(readings)
    a = rows_of(gate.gate_reasons(df, PLAIN))
    assert len({r[0] for r in a}) == 4
    assert rows_of(gate.gate_reasons(df, Series(max_rows=max_rows))) == a


def test_gate_of_constant_series_needs_many_rounds(spark):
    """Equal polls every 10 minutes: each decision depends on all earlier ones."""
    df = spark.range(100).select(
        F.col("id").alias("seq"), F.lit("a").alias("location"),
        F.timestamp_seconds(F.col("id") * 600).alias("timestamp"),
        F.lit(1).alias("aqi"), F.lit(1.0).alias("pm2_5"), F.lit(1.0).alias("temperature"))
    s = Series(max_rows=13)
    kept = sorted(r["seq"] for r in gate.accepted(df, s).collect())
    assert kept == list(range(0, 100, 5))


def test_compare_models_of_a_huge_name(spark, sf):
    from breezeway.plans import registry as reg
    from catalog import fixtures as fx

    registry = fx.registry(spark, sf).withColumn("model_name", F.lit("one"))
    import breezeway.plans.registry as module

    a = rows_of(reg.compare_models(registry).select("version", "place", "metric_value"))
    original = module.Series
    module.Series = lambda *names: original(*names, max_rows=50)
    try:
        b = rows_of(reg.compare_models(registry).select("version", "place", "metric_value"))
    finally:
        module.Series = original
    assert a == b


def test_size_is_counted_not_estimated(spark, tmp_path):
    """Many rows in a tiny file: the hot entity is still found, and the count is shared."""
    from breezeway.operators import series as module

    path = str(tmp_path / "flat")
    spark.range(200_000).selectExpr("'a' location", "timestamp_seconds(id) timestamp", "id seq").coalesce(1).write.parquet(path)
    df, s = spark.read.parquet(path), Series(max_rows=50_000)
    split = split_by_size(df, s)
    assert split.hot_entities == 1 and split.hot_rows == 200_000
    assert split_by_size(windows.with_gap(df, s), s).hot_rows == 200_000
    large = Series(max_rows=300_000)
    assert split_by_size(df, large).hot is None
    known = len(module._counted)
    assert split_by_size(windows.with_gap(df, large), large).hot is None
    assert len(module._counted) == known


def test_percentile_ways_agree_on_null_groups_single_rows_and_nothing(spark):
    rows = [("a", 1.0), ("a", 4.0), ("a", None), ("b", None), ("b", None), ("c", 2.0)]
    for data in (rows, []):
        df = spark.createDataFrame(data, "g string, v double")
        for by in (["g"], []):
            ways = [sorted(map(tuple, exact_percentiles(df, ["v"], [0.0, 0.25, 0.5, 1.0], by, Series(max_rows=m)).collect()),
                           key=str) for m in (1000, 1)]
            assert ways[0] == ways[1]


def test_other_rolling_sizes_take_plain_frames(spark):
    df = spark.createDataFrame([("a", i, i, float(i * i % 7)) for i in range(20)], "location string, timestamp long, seq long, v double")
    out = windows.with_rolling(df, {"v": ["mean", "max"]}, [5, 12]).orderBy("seq").collect()
    assert out[9].v_rolling_mean_5h == pytest.approx(sum(i * i % 7 for i in range(5, 10)) / 5)
    assert out[9].v_rolling_max_12h == max(i * i % 7 for i in range(10))
    assert "v_rolling_mean_7h" in windows.with_rolling(df, {"v": ["mean"]}, [7]).columns


def test_counts_of_a_table_that_grew_are_taken_again(spark, tmp_path):
    """An entity that passes the limit by an append is found, and operators over one frame count once."""
    from breezeway.operators import series

    path, s = str(tmp_path / "t"), Series(key=("k",), ts="t", seq="n", max_rows=10)
    rows = lambda a, b: spark.range(a, b).select(F.lit("x").alias("k"), F.col("id").alias("t"), F.col("id").alias("n"))
    rows(0, 5).write.parquet(path)
    assert series.heavy_entities(spark.read.parquet(path), s).entities == 0
    rows(5, 100).write.mode("append").parquet(path)
    df = spark.read.parquet(path)
    assert (series.heavy_entities(df, s).entities, series.heavy_entities(df, s).rows) == (1, 100)
    known = len(series._counted)
    assert series.heavy_entities(df.withColumn("more", F.lit(1)), s).entities == 1 and len(series._counted) == known
