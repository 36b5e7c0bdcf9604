"""Stored snapshots, deletes and landed payloads."""

import json

import pytest
from pyspark.sql import functions as F

from breezeway.operators import dedup
from breezeway.schemas import LANDING, READINGS
from breezeway.sources import landing, readings as scans
from breezeway.sources.store import ReadingStore
from catalog import fixtures as fx


@pytest.fixture(scope="module")
def rows(spark, sf):
    return fx.readings(spark, sf).cache()


def store(spark, tmp_path):
    return ReadingStore(spark, str(tmp_path / "table"), READINGS)


def test_empty_store_reads(spark, tmp_path):
    assert store(spark, tmp_path).read().count() == 0


def test_append_delete_and_append_again(spark, tmp_path, rows):
    table, n = store(spark, tmp_path), rows.count()
    table.append(rows)
    assert table.read().count() == n
    matching = rows.filter(F.col("source").rlike("openweather")).count()
    table.replace(dedup.delete_matching(table.read(), "openweather"))
    assert table.read().count() == n - matching
    assert table.read().filter("source is null").count() == rows.filter("source is null").count()
    table.append(rows.limit(5))
    assert table.read().count() == n - matching + 5
    table.replace(dedup.delete_all(table.read()))
    assert table.read().count() == 0
    table.append(rows.limit(3))
    assert table.read().count() == 3


def test_time_filter_skips_directories(spark, tmp_path, rows):
    table = store(spark, tmp_path)
    table.append(rows)
    recent = scans.since_days(table.read(), 3, F.lit("2024-01-20").cast("timestamp"))
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan
    assert "PushedFilters: [IsNotNull(timestamp), GreaterThanOrEqual(timestamp" in plan
    assert recent.count() == rows.filter("timestamp >= '2024-01-17'").count()


def test_stamped_ids_are_unique_across_batches(spark, tmp_path, rows):
    table = store(spark, tmp_path)
    first = table.append_stamped(rows.repartition(7), batch=1)
    second = table.append_stamped(rows, batch=2)
    assert first.union(second).distinct().count() == 2 * rows.count()
    assert table.read().filter("timestamp is null").count() == 0


def air(**parts):
    components = {"pm2_5": 1.5, "pm10": 2.5, "co": 3.0}
    return {"list": [{"main": {"aqi": 2}, "components": components | parts}]}


def weather(**parts):
    return {"main": {"temp": 20.0, "feels_like": 19.0, "temp_min": 18, "temp_max": 22, "humidity": 40, "pressure": 1010},
            "wind": {"speed": 3.0}, "clouds": {"all": 75}, "weather": [{"main": "Rain", "description": "light rain"}]} | parts


def test_payloads(spark):
    cases = [
        (air(), weather()),
        (air(pm10=None), weather()),
        ({"list": []}, weather()),
        ({}, weather()),
        (air(), weather(weather=[])),
        (air(), weather(wind={"deg": 90})),
        (air(), weather(wind={"speed": 1.0, "deg": 90, "gust": 4.5}, visibility=9000)),
    ]

    def side(i):
        lines = [("x", n, None, json.dumps(c[i])) for n, c in enumerate(cases)]
        lines.append(("x", 99, None, "not json"))
        return spark.createDataFrame(lines, LANDING)

    out = {r["seq"]: r for r in landing.merge_payloads(side(0), side(1)).collect()}
    assert set(out) == {0, 6}
    assert (out[0]["wind_direction"], out[0]["wind_gust"], out[0]["visibility"], out[0]["no2"]) == (0.0, None, None, None)
    assert (out[6]["wind_direction"], out[6]["wind_gust"], out[6]["visibility"]) == (90.0, 4.5, 9000.0)
    assert (out[0]["aqi"], out[0]["clouds"], out[0]["weather_main"], out[0]["source"]) == (2, 75.0, "Rain", "openweather")


def test_duplicates_of_a_dominant_key(spark):
    """A third of the rows are copies of one reading."""
    df = spark.range(900).select(
        F.col("id").alias("seq"), F.lit("a").alias("location"), F.lit(3).alias("aqi"),
        F.when(F.col("id") % 3 == 0, 7.001).otherwise(F.col("id").cast("double")).alias("pm2_5"))
    flagged = dedup.flag_duplicates(df)
    kept = {r["seq"] for r in flagged.filter("not is_duplicate").collect()}
    # 7.001 counts as 7.00, which is also the value of row 7
    assert kept == {0} | {i for i in range(900) if i % 3 and i != 7}
    assert {r["seq"] for r in dedup.drop_duplicates(df).collect()} == kept
    totals = dedup.duplicate_totals(df).first()
    assert (totals["total_before"], totals["unique_count"], totals["duplicate_count"]) == (900, len(kept), 900 - len(kept))


def test_missing_parts_of_the_key_count_as_zero(spark):
    df = spark.createDataFrame([(1, "a", None, None), (2, "a", 0, 0.0), (3, "a", 0, 0.004)],
                               "seq long, location string, aqi int, pm2_5 double")
    assert [r["seq"] for r in dedup.drop_duplicates(df).collect()] == [1]


def test_nan_becomes_null(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, None)], "i int, v double").write.parquet(path)
    out = scans.read_table(spark, path)
    assert sorted((r["i"], r["v"]) for r in out.collect() if r["v"] is not None) == [(2, 1.0)]
    assert out.filter("v is null").count() == 2


def test_interrupted_replace_leaves_the_old_table(spark, sf):
    from catalog.fixtures import readings
    from breezeway.schemas import READINGS
    from breezeway.session import scratch_path
    from breezeway.sources.store import ReadingStore

    store = ReadingStore(spark, scratch_path(spark, "readings"), READINGS)
    rows = readings(spark, sf)
    store.append(rows)
    n = store.read().count()
    spark.range(3).write.parquet(f"{store.root}/snapshot=2/_temporary/0")  # what a killed writer leaves
    assert store.read().count() == n > 0
    store.replace(rows.limit(5))
    assert store.read().count() == 5


def test_stamped_ids_are_dense_and_unique(spark, sf):
    from catalog.fixtures import readings
    from breezeway.schemas import READINGS
    from breezeway.session import scratch_path
    from breezeway.sources.store import ReadingStore

    store = ReadingStore(spark, scratch_path(spark, "readings"), READINGS)
    rows = readings(spark, sf).repartition(7)
    ids = sorted(r.seq for r in store.append_stamped(rows, batch=3).collect())
    assert ids == [(3 << 44) + i for i in range(rows.count())]


def test_registry_promotion_is_stored_and_last_wanted_version_wins(spark):
    import datetime

    from breezeway.plans import registry as reg
    from breezeway.session import scratch_path

    path, at = scratch_path(spark, "registry"), datetime.datetime(2024, 1, 1)
    for version in ("v1", "v2", "v3"):
        reg.register(path, reg.registry_row(spark, "m", version, "f", {"mae": 1.0}, ["x"], at))
    wanted = spark.createDataFrame([("m", "v2", 2), ("m", "v1", 1), ("m", "none", 3)], "model_name string, version string, place int")
    reg.promote_stored(spark, path, wanted, order="place")
    assert {(r.version, r.stage) for r in reg.read_registry(spark, path).collect()} == {
        ("v1", "staging"), ("v2", "production"), ("v3", "staging")}
    reg.promote_stored(spark, path, spark.createDataFrame([("m", "v3")], "model_name string, version string"))
    assert [r.version for r in reg.production_models(reg.read_registry(spark, path)).collect()] == ["v3"]


def test_edges_of_metrics_gates_and_gaps(spark):
    import datetime

    from breezeway.operators import metrics, quality

    scored = spark.createDataFrame([(1.0, 1.0), (2.0, 2.5), (3.0, 3.0), (100.0, None)], "y double, prediction double")
    assert metrics.error_metrics(scored).first()["r2"] == 0.875
    rows = spark.createDataFrame([("a", None, None, 0), ("b", 2.0, float("nan"), 1), ("c", 1.0, 0.5, 2)],
                                 "model string, mae double, r2 double, rank int")
    assert tuple(metrics.best_by_mae(rows, []).first()) == ("c", 1.0)
    assert tuple(metrics.best_by_r2(rows, []).first()) == ("c", 0.5)
    at = [datetime.datetime(2024, 1, 1, h) for h in (0, 1, 9)]
    df = spark.createDataFrame([(None, t, i) for i, t in enumerate(at)], "location string, timestamp timestamp, seq long")
    assert quality.gap_stats(df).first()["max_gap"] == 8 * 3600 * 10**6
    assert quality.large_gaps(df).count() == 1
    assert quality.sample_gates(df, df).first()["clean_rows"] == 3
    assert quality.with_enough_rows(df, 3).count() == 3


def test_deleting_one_id_rewrites_one_date(spark, tmp_path, rows):
    table = store(spark, tmp_path)
    table.append(rows)
    before, n = table.table.current(), table.read().count()
    gone = rows.orderBy("seq").limit(1).select("seq", F.to_date("timestamp").cast("string").alias("d")).first()
    table.delete_ids(spark.createDataFrame([(gone.seq,), (-1,)], "seq long"))
    after = table.table.current()
    assert {d for d in before.parts if before.parts[d] != after.parts.get(d)} == {f"date={gone.d}"}
    assert table.read().count() == n - 1 and table.read().where(F.col("seq") == gone.seq).isEmpty()
    assert table.read(before.number).count() == n  # the old version is as it was
    table.delete_ids(spark.createDataFrame([(-5,)], "seq long"))
    assert table.table.current() == after
    assert table.vacuum() == [before.number] and table.read().count() == n - 1
    table.delete_where(F.col("source") == "sensor")
    assert table.read().count() == rows.where("source <> 'sensor' OR source IS NULL").count() - (
        0 if gone.seq in {r.seq for r in rows.where("source = 'sensor'").collect()} else 1)
    table.delete_all()
    assert table.read().isEmpty()


def test_half_written_parts_are_never_read(spark, tmp_path, rows):
    """A writer that dies before it publishes leaves nothing behind that counts."""
    table = store(spark, tmp_path)
    table.append(rows.limit(10))
    table.table.write_part(rows)
    assert table.read().count() == 10
    table.append(rows.limit(3))
    assert table.read().count() == 13
    table.vacuum()
    assert table.read().count() == 13


def test_two_writers_lose_nothing(spark, tmp_path, rows):
    """Appends from many threads, and a delete that another writer overtakes."""
    from concurrent.futures import ThreadPoolExecutor

    from breezeway.sources.manifest import Conflict, publish, Version

    table = store(spark, tmp_path)
    few = rows.limit(20).cache()
    few.count()
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: table.append(few.withColumn("seq", F.col("seq") + 10_000 * i)), range(8)))
    assert table.read().count() == 160 and table.versions() == list(range(1, 9))
    assert not publish(spark, table.root, Version(8))  # a number is taken once

    ids = few.limit(5).select("seq")
    raced = []

    def gone(stored):
        if not raced:  # between reading and publishing, another writer appends to the same dates
            raced.append(table.append(few.withColumn("seq", F.col("seq") + 90_000)))
        return stored.join(ids, "seq", "left_semi")

    table.table.change(gone, lambda stored: dedup.delete_ids(stored, ids))
    assert table.read().count() == 175
    base = table.table.current()
    table.append(few.limit(1))
    with pytest.raises(Conflict):
        table.table.replace(few, based_on=base)
    assert table.read().count() == 176
