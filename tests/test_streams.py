"""The gate as a stream equals the batch gate; the other stream jobs."""

import datetime
import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from breezeway.streaming import gate, jobs
from catalog import fixtures as fx
from tests.helpers import rows_of


@pytest.fixture(scope="module")
def polls(spark, sf):
    return fx.polls(spark, sf).cache()


def land(polls, folder, parts):
    """Write polls as ``parts`` files in time order, rows shuffled inside each."""
    sliced = polls.withColumn("_part", F.ntile(parts).over(Window.orderBy("timestamp", "seq")))
    for n in range(1, parts + 1):
        part = sliced.filter(F.col("_part") == n).drop("_part").orderBy(F.rand(7))
        part.coalesce(1).write.mode("append").parquet(folder)


def stored_by_stream(spark, folder, tmp_path, schema, files_per_batch, run="a"):
    """Poll ids that the stream stores from the files of a folder."""
    root = str(tmp_path / f"table-{run}")
    stream = jobs.landing_stream(spark, folder, schema, files_per_batch=files_per_batch)
    jobs.store_gated(stream, root, f"{root}-state").awaitTermination()
    return {r.seq for r in jobs.read_gated(spark, root, schema).select("seq").collect()}, root


@pytest.mark.parametrize("files_per_batch", [1, 3, None])
def test_stream_gate_equals_batch_gate(spark, polls, tmp_path, files_per_batch):
    folder = str(tmp_path / "landing")
    land(polls, folder, 4)
    got, root = stored_by_stream(spark, folder, tmp_path, polls.schema, files_per_batch)
    assert got == {r.seq for r in gate.accepted(polls).select("seq").collect()}
    decided = jobs.decided_polls(spark, root, polls.schema).read()
    assert decided.count() == polls.count() and 0 < len(got) < polls.count()


def drifting(rng, n, step, location):
    """Polls that hover around the tolerance, with pauses; many decisions hang on the one before."""
    minute, pm, out = 0, 10.0, []
    for i in range(n):
        minute += rng.choice(step)
        pm += rng.choice([0, 0, 0.2, -0.2, 0.45, -0.45])
        out.append((minute, round(pm, 2), location))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_order_of_arrival_does_not_matter(spark, tmp_path, seed):
    """Files out of order and rows dealt at random store the same polls as one batch in order."""
    rng = random.Random(seed)
    rows = drifting(rng, 400, [5, 10, 20, 44, 45, 300], "a") + drifting(rng, 150, [7], "b") + drifting(rng, 60, [600, 1], None)
    polls = frame(spark, [poll(i, m, pm=p, location=w) for i, (m, p, w) in enumerate(rows)])
    shares = 4
    share = [rng.randrange(shares) if seed > 1 else shares - 1 - i * shares // len(rows) for i in range(len(rows))]
    for n in range(shares):
        mine = [poll(i, m, pm=p, location=w) for i, (m, p, w) in enumerate(rows) if share[i] == n]
        frame(spark, mine).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
    landed = spark.read.parquet(str(tmp_path / "landing"))
    want = {r.seq for r in gate.accepted(landed).select("seq").collect()}
    got, _ = stored_by_stream(spark, str(tmp_path / "landing"), tmp_path, polls.schema, 1)
    assert got == want


def test_late_poll_changes_later_decisions(spark, tmp_path):
    """A late poll far back is stored, and what it makes a repeat is no longer stored, days on as well."""
    root = str(tmp_path / "table")
    chain = [poll(i, 40 * i) for i in range(200)]  # every second one is stored, for five days
    schema = frame(spark, []).schema
    handle = jobs.gate_batches(root, schema)
    handle(frame(spark, chain[1:]), 0)
    stored = lambda: {r.seq for r in jobs.read_gated(spark, root, schema).collect()}
    assert stored() == set(range(1, 200, 2))
    first = jobs.decided_polls(spark, root, schema)
    handle(frame(spark, chain[:1]), 1)
    assert stored() == set(range(0, 200, 2))
    handle(frame(spark, chain[:1]), 1)  # delivered again
    assert stored() == set(range(0, 200, 2)) and first.read().count() == 200


def test_late_poll_rewrites_only_its_days(spark, tmp_path):
    root = str(tmp_path / "table")
    rows = [poll(i, 60 * i, pm=float(i)) for i in range(24 * 10)]
    schema = frame(spark, []).schema
    handle = jobs.gate_batches(root, schema)
    handle(frame(spark, rows), 0)
    table = jobs.decided_polls(spark, root, schema)
    before = table.current().parts
    handle(frame(spark, [poll(1000, 60 * 30 + 1, pm=30.2), poll(1001, 60 * 30 + 20, pm=99.0)]), 1)
    after = table.current().parts
    assert {d for d in before if before[d] != after[d]} == {"date=1970-01-02"}
    assert jobs.read_gated(spark, root, schema).count() == 24 * 10 + 1


def poll(seq, minute, pm=1.0, aqi=1, temperature=20.0, location="a"):
    return (seq, location, minute * 60, aqi, pm, temperature)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "seq long, location string, t long, aqi int, pm2_5 double, temperature double")
    return df.withColumn("timestamp", F.timestamp_seconds("t")).drop("t")


def reasons(spark, rows):
    return [r["reason"] for r in gate.gate_reasons(frame(spark, rows)).orderBy("seq").collect()]


def test_gate_rules(spark):
    assert reasons(spark, [
        poll(1, 0), poll(2, 44), poll(3, 45), poll(4, 60, pm=1.49), poll(5, 61, pm=1.5), poll(6, 62, aqi=2, pm=1.5),
        poll(7, 63, aqi=2, pm=1.5, temperature=20.5), poll(8, 200, aqi=2, pm=1.5, temperature=20.5),
    ]) == ["first", "unchanged", "elapsed", "unchanged", "changed", "changed", "changed", "elapsed"]


def test_gate_compares_with_the_last_stored_poll(spark):
    """Slow drift: each step is below the tolerance, their sum is not."""
    assert reasons(spark, [poll(1, 0, 1.0), poll(2, 5, 1.3), poll(3, 10, 1.6), poll(4, 15, 1.9)]) == [
        "first", "unchanged", "changed", "unchanged"]


def test_missing_measures_count_as_zero(spark):
    assert reasons(spark, [poll(1, 0, None, None, None), poll(2, 5, 0.2, 0, 0.1)]) == ["first", "unchanged"]


def plain_reasons(rows):
    """The rules, one poll after the other."""
    last, out = {}, {}
    for seq, location, t, aqi, pm, temperature in sorted(rows, key=lambda r: (str(r[1]), r[2], r[0])):
        now = (t, aqi or 0, pm or 0.0, temperature or 0.0)
        at = last.get(location)
        if at is None:
            out[seq] = "first"
        elif t - at[0] >= 45 * 60:
            out[seq] = "elapsed"
        elif now[1] == at[1] and abs(now[2] - at[2]) < 0.5 and abs(now[3] - at[3]) < 0.5:
            out[seq] = "unchanged"
            continue
        else:
            out[seq] = "changed"
        last[location] = now
    return out


def test_gate_on_long_stretches_without_a_pause(spark):
    """Constant values at many paces: the outcome of a block hangs on the block before, all along."""
    rng = random.Random(4)
    rows = [poll(10_000 * k + i, pace * i, location=f"pace{pace}") for k, pace in enumerate([1, 4, 7, 10, 20, 40, 44, 45, 46])
            for i in range(300)]
    for k, pace in enumerate([[3], [1, 2, 30], [10], [44, 1], [90, 89, 91], [46, 44, 200]]):
        rows += [poll(1_000_000 + 10_000 * k + i, m, pm=p, location=w)
                 for i, (m, p, w) in enumerate(drifting(rng, 300, pace, None if k == 2 else f"drift{k}"))]
    rng.shuffle(rows)
    got = {r.seq: r.reason for r in gate.gate_reasons(frame(spark, rows)).collect()}
    assert got == plain_reasons(rows)


def test_gate_on_dense_polls(spark):
    """Hundreds of polls in a block: constant, hovering around the tolerance, in steps, copied, not a number."""
    rng, rows = random.Random(5), []

    def add(location, n, pace, value):
        t = 0
        for _ in range(n):
            t += rng.choice(pace)
            rows.append((len(rows), location, t, 1, value(), 20.0))

    walk = [10.0]
    step = lambda sizes: lambda: walk.append(round(walk[-1] + rng.choice(sizes), 2)) or walk[-1]
    add("constant", 900, [13], lambda: 1.0)
    add("hover", 900, [0, 0, 7, 11], step([0, 0.2, -0.2, 0.45, -0.45]))
    add("flat", 900, [5, 11], step([0] * 200 + [0.3, -0.3]))
    add("steps", 900, [3, 2700], step([0, 0.5, 0.6, 1.0, -1.0, 1.01]))
    add("copies", 900, [0] * 40 + [600], lambda: float(rng.choice([1, 1, 2])))
    add("nan", 200, [0, 5], lambda: rng.choice([1.0, float("nan"), float("inf")]))
    rng.shuffle(rows)
    got = {r.seq: r.reason for r in gate.gate_reasons(frame(spark, rows)).collect()}
    assert got == plain_reasons(rows)


def test_copies_and_constant_values_take_no_part_in_blocks(spark, monkeypatch):
    """What lies in the blocks' arrays does not grow with copies, nor the work on them with its square."""
    held, write = [], gate.materialise

    def spy(df, label):
        out = write(df, label)
        if label == "gate-blocks":
            held.append(out.agg(F.sum(F.size("states"))).first()[0])
        return out

    monkeypatch.setattr(gate, "materialise", spy)
    rows = [(1000 * copy + i, "a", 60 * i, 1 + i // 10 % 2, 1.0, 20.0) for i in range(80) for copy in range(50)]
    got = {r.seq: r.reason for r in gate.gate_reasons(frame(spark, rows)).collect()}
    assert got == plain_reasons(rows)
    assert held == [10 + 7]  # of 4,000: the times up to the first change, what comes before is not known, and each change


def test_gate_on_thousands_of_polls_that_hover_within_the_tolerance(spark):
    """The next stored poll is found without a look at all polls of the block; 24,000 took 64 s before."""
    rng, n = random.Random(6), 24_000
    hover = [(i, "a", i * 1000 // n, 1, rng.choice([10.0, 10.1, 10.2]), 20.0) for i in range(n)]
    late_turns = [(n + i, "b", i * 2000 // n, 1, 1.0 + (i // 3 % 2 if i > n // 2 else 0), 20.0) for i in range(n)]
    start = time.monotonic()
    got = {r.seq: r.reason for r in gate.gate_reasons(frame(spark, hover + late_turns)).collect()}
    assert got == plain_reasons(hover + late_turns)
    assert time.monotonic() - start < 45


@pytest.mark.parametrize("n", [1, 15, 16, 17, 80, 81, 300, 1000])
def test_next_stored_poll_equals_a_look_at_each(spark, n):
    """From every tenth place of arrays of many lengths, with values that are not numbers too."""
    rng = random.Random(n)
    odd = [float("nan"), float("inf")]
    states = [(60_000_000 * i // 10, 1.0 + (i > 900), 10.0 + rng.choice([0, 0.2, 0.4] + ([1.0] if rng.random() < 0.005 else [])), 20.0)
              for i in range(n)]
    lasts = [(0, 1.0, 10.2, 20.0), (0, 2.0, 10.2, 20.0), (-2_700_000_000 + 60_000_000, 1.0, 10.3, 20.0), (0, 1.0, odd[0], 20.0), (0, 1.0, odd[1], 20.0)]
    if n > 100:
        states[n - 7] = (*states[n - 7][:2], odd[0], 20.0)
    state = gate._STATE
    df = spark.createDataFrame([(k, states, x, a) for k, x in enumerate(lasts) for a in range(0, n + 1, 10)],
                               f"k int, states array<{state}>, last {state}, start int")
    got = df.select("k", "start", gate.let(gate._spans(F.col("states")), lambda s: gate._next(
        F.col("states"), s, F.col("last"), F.col("start"))).alias("at")).collect()

    def repeats(last, p):
        return p[0] - last[0] < gate.GATE_MICROS and p[1] == last[1] and abs(p[2] - last[2]) < 0.5 and abs(p[3] - last[3]) < 0.5

    for r in got:
        assert r["at"] == next((k for k in range(r.start, n) if not repeats(lasts[r.k], states[k])), None)


def test_gate_plan_has_no_python_and_no_join_on_ids(spark, polls):
    plan = gate.with_gate_reason(polls)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert not any("Join" in line and "seq" in line for line in plan.splitlines())


def test_daily_coverage_keeps_open_days_and_counts_late_rows(spark, tmp_path):
    root, schema = str(tmp_path / "days"), "location string, timestamp timestamp"
    at = lambda rows: spark.createDataFrame(
        [(w, datetime.datetime(2024, 1, d, h)) for w, d, h in rows], schema)
    handle = jobs.coverage_batches(root, at([]).schema)
    handle(at([("a", 1, 1), ("a", 1, 2), ("a", 2, 9), (None, 2, 9)]), 0)
    handle(at([("a", 1, 3), ("a", 2, 8), ("a", 2, 6), ("b", 3, 1)]), 1)
    handle(at([("a", 1, 3), ("a", 2, 8), ("a", 2, 6), ("b", 3, 1)]), 1)  # delivered again
    handle(at([]), 2)
    got = {(r.location, r.date.day): (r.records, r.late, r.status) for r in jobs.read_daily_coverage(spark, root, at([]).schema).collect()}
    assert got == {("a", 1): (3, 1, "poor"), ("a", 2): (3, 1, "poor"), (None, 2): (1, 0, "poor"), ("b", 3): (1, 0, "poor")}


def test_latest_is_kept_over_batches(spark, polls, tmp_path):
    folder, root = str(tmp_path / "landing"), str(tmp_path / "latest")
    land(polls, folder, 3)
    stream = jobs.landing_stream(spark, folder, polls.schema, files_per_batch=1)
    jobs.keep_latest(stream, root, str(tmp_path / "state")).awaitTermination()
    want = polls.groupBy("location").agg(F.max("timestamp").alias("timestamp"))
    assert rows_of(jobs.read_latest(spark, root, polls.schema).select("location", "timestamp")) == rows_of(want)


def test_latest_handler_repeats_a_batch(spark, polls, tmp_path):
    root = str(tmp_path / "latest")
    handle = jobs.upsert_latest(root)
    old, new = polls.filter("timestamp < '2024-01-10'"), polls.filter("timestamp >= '2024-01-10'")
    handle(new, 0)
    handle(old, 1)
    once = rows_of(jobs.read_latest(spark, root, polls.schema))
    handle(old, 1)
    assert rows_of(jobs.read_latest(spark, root, polls.schema)) == once
    assert min(r["timestamp"].isoformat() for r in jobs.read_latest(spark, root, polls.schema).collect()) > "2024-01-10"
