"""Structured Streaming jobs over landing folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from breezeway.functions.calendar import MICROS_PER_MINUTE, micros
from breezeway.operators.quality import coverage_status
from breezeway.operators.series import Series
from breezeway.session import discard, materialise
from breezeway.sources.commits import drop_versions, read_version, versions, write_version
from breezeway.sources.manifest import PartTable, Version
from breezeway.sources.readings import latest
from breezeway.streaming.gate import GATE_MICROS, with_gate_reason


def landing_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet",
                   files_per_batch: int | None = None) -> DataFrame:
    """Files of a folder as a stream; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def decided_polls(spark: SparkSession, root: str, schema: T.StructType, s: Series = Series()) -> PartTable:
    """All landed polls, each with ``stored``: whether the gate lets it pass."""
    full = T.StructType([*schema.fields, T.StructField("stored", T.BooleanType())])
    return PartTable(spark, root, full, "date", F.to_date(s.ts), (*s.key, *s.order))


def _on(left: DataFrame, right: DataFrame, names: list[str], how: str) -> DataFrame:
    """Null-safe join that keeps the names of ``left``."""
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(right.withColumnsRenamed({c: f"_r_{c}" for c in names}), same, how).drop(*[f"_r_{c}" for c in names])


def _decided(table: PartTable, base: Version, new: DataFrame, s: Series, days: int) -> tuple[DataFrame, int]:
    """The polls of each entity on the days of its new ones and ``days`` after, decided again:
    poll, ``was`` (null: new) and ``stored``; and on how many of the last days the stored polls end
    otherwise than before, so that the day after must be decided too.

    What precedes such a day is settled. Of it the gate sees the stored polls of the last 45
    minutes, which it stores again.
    """
    key, entity_day = list(s.key), [*s.key, "date"]
    touched = new.select(*key, F.to_date(s.ts).alias("date")).distinct()
    wanted = materialise(touched.select(*key, F.explode(F.sequence("date", F.date_add("date", days))).alias("date"))
                         .distinct().withColumn("wanted", F.lit(True)), "gate-days")
    dates = [r[0] for r in wanted.select("date").union(wanted.select(F.date_sub("date", 1))).distinct().collect()]
    known = [str(d) for d in dates if f"date={d}" in base.parts]
    old = _on(table.read(base, known), wanted, entity_day, "left")
    eve = wanted.select(*key, F.date_sub("date", 1).alias("date"), F.lit(True).alias("eve"))
    end = F.unix_micros(F.date_add("date", 1).cast("timestamp")) - GATE_MICROS
    last_minutes = micros(F.col(s.ts)) > end
    seen = _on(old, eve, entity_day, "left").where(F.col("wanted") | (F.col("eve") & F.col("stored") & last_minutes))
    columns = [c for c in table.schema.names if c != "stored"]
    rows = seen.select(*columns, F.col("stored").alias("was"), F.coalesce("wanted", F.lit(False)).alias("open")).unionByName(
        new.select(*columns, F.lit(None).cast("boolean").alias("was"), F.lit(True).alias("open")))
    decided = materialise(
        with_gate_reason(rows, s).where("open").withColumn("stored", F.col("reason") != "unchanged")
        .withColumn("date", F.to_date(s.ts)).drop("reason", "open"), "gate-decided")
    newest = lambda c: F.max(F.when(F.col(c), F.struct(s.ts, s.seq)))
    day_after = wanted.select(*key, F.date_sub("date", 1).alias("date"), F.lit(True).alias("inner"))
    ends = _on(decided.where(last_minutes), day_after, entity_day, "left").where("inner IS NULL").groupBy(*entity_day).agg(
        newest("was").alias("a"), newest("stored").alias("b"))
    later = [d for d in base.parts if any(f"date={x}" < d for x in dates)]
    changed = ends.where(~F.col("a").eqNullSafe(F.col("b"))).count() if later else 0
    discard(wanted)
    return decided, changed


def gate_batches(root: str, schema: T.StructType, s: Series = Series(), name: str = "polls") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` handler that stores each poll with the gate's decision, in any order of arrival.

    A poll may come late, after later ones were decided. Then the days it may change are
    decided again from the last stored polls before it: its own day and the next, and
    more of them as long as the last stored poll of a day is another one than before.
    Decisions forget the past soon, so few days are read. Only dates on which a decision
    changed are written anew, in one version with the new polls, which notes the batch: a batch that is
    delivered again leaves the table as it is. Whatever the batches, the table holds what
    the gate decides over all polls at once.
    """
    note = f"batch of {name}"

    def handle(batch: DataFrame, n: int) -> None:
        table = decided_polls(batch.sparkSession, root, schema, s)
        base = table.current()
        if base.notes.get(note, -1) >= n or batch.isEmpty():
            return
        new, days = materialise(batch.select(*schema.names), "polls"), 1
        decided, changed = _decided(table, base, new, s, days)
        while changed:
            discard(decided)
            days *= 4
            decided, changed = _decided(table, base, new, s, days)
        row = [*s.key, "date", s.seq]
        added, flips = decided.where("was IS NULL"), decided.where("was <> stored").select(*row, F.lit(True).alias("flips"))
        if not base.parts or flips.isEmpty():
            table.append(added, {note: n})
        else:
            table.change(
                lambda rows: _on(rows, flips.drop("flips"), row, "left_semi"),
                lambda rows: _on(rows, flips, row, "left").withColumn("stored", F.col("stored") != F.coalesce("flips", F.lit(False))),
                added=added, notes={note: n})
        discard(new, decided)

    return handle


def store_gated(stream: DataFrame, root: str, state_path: str, s: Series = Series()) -> StreamingQuery:
    """Landed polls -> gate -> table, over everything that has arrived."""
    return (
        stream.writeStream.foreachBatch(gate_batches(root, stream.schema, s, name=state_path))
        .option("checkpointLocation", state_path)
        .trigger(availableNow=True)
        .start()
    )


def read_gated(spark: SparkSession, root: str, schema: T.StructType, s: Series = Series()) -> DataFrame:
    """The stored polls."""
    return decided_polls(spark, root, schema, s).read().where("stored").select(*schema.names)


def coverage_table(spark: SparkSession, root: str, schema: T.StructType, s: Series = Series()) -> PartTable:
    """Rows per entity and day, and how many of them came late."""
    keys = [schema[c] for c in s.key]
    counts = [T.StructField(c, T.LongType()) for c in ("records", "late")]
    return PartTable(spark, root, T.StructType([*keys, T.StructField("day", T.DateType()), *counts]), "date", F.col("day"), s.key)


def coverage_batches(root: str, schema: T.StructType, s: Series = Series(), delay_minutes: int = 120,
                     name: str = "rows") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` handler that adds each batch's counts to the table of days, open days included.

    ``late`` counts rows older than ``delay_minutes`` before the newest row of earlier batches.
    Only the dates of a batch are written anew; a batch that is delivered again is not counted twice.
    """
    note, newest = f"batch of {name}", "newest"

    def handle(batch: DataFrame, n: int) -> None:
        table = coverage_table(batch.sparkSession, root, schema, s)
        base = table.current()
        if base.notes.get(note, -1) >= n:
            return
        t = micros(F.col(s.ts))
        border = base.notes.get(newest, -(1 << 62)) - delay_minutes * MICROS_PER_MINUTE
        counts = materialise(batch.groupBy(*s.key, F.to_date(s.ts).alias("day")).agg(
            F.count(F.lit(1)).alias("records"), F.count_if(t < border).alias("late"), F.max(t).alias("_newest")), "coverage")
        top = counts.agg(F.max("_newest")).first()[0]
        if top is None:
            return
        dates = counts.select(F.col("day").alias("date")).distinct()
        known = [d.split("=")[1] for d in base.parts]
        add = lambda rows: rows.groupBy(*s.key, "day").agg(F.sum("records").alias("records"), F.sum("late").alias("late"))
        table.change(
            lambda rows: rows.join(dates, "date", "left_semi"),
            lambda rows: add(rows.select(*table.schema.names).unionByName(
                counts.where(F.col("day").cast("string").isin(known)).select(*table.schema.names))),
            added=counts.where(~F.col("day").cast("string").isin(known)) if known else counts,
            notes={note: n, newest: max(top, base.notes.get(newest, top))})
        discard(counts)

    return handle


def keep_daily_coverage(stream: DataFrame, root: str, state_path: str, s: Series = Series()) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(coverage_batches(root, stream.schema, s, name=state_path))
        .option("checkpointLocation", state_path)
        .trigger(availableNow=True)
        .start()
    )


def read_daily_coverage(spark: SparkSession, root: str, schema: T.StructType, s: Series = Series()) -> DataFrame:
    """Entity, date, records, late and status of every day, the open one included."""
    rows = coverage_table(spark, root, schema, s).read()
    return rows.select(*s.key, "date", "records", "late", coverage_status(F.col("records")).alias("status"))


def upsert_latest(root: str, s: Series = Series()) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` handler that keeps the newest row of each entity.

    Batch ``n`` is written to ``root/batch=n`` from the newest earlier batch and then
    committed, so a repeated batch writes the same table again and a half-written one is
    never read. Tables older than the one before are removed.
    """
    def handle(batch: DataFrame, n: int) -> None:
        spark, rows = batch.sparkSession, batch
        before = [b for b in versions(spark, root, "batch") if b < n]
        if before:
            rows = batch.unionByName(read_version(spark, root, "batch", batch.schema, before[-1]))
            drop_versions(spark, root, "batch", before[-1])
        write_version(latest(rows, s), root, "batch", n)

    return handle


def keep_latest(stream: DataFrame, root: str, state_path: str, s: Series = Series()) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(upsert_latest(root, s))
        .option("checkpointLocation", state_path)
        .trigger(availableNow=True)
        .start()
    )


def read_latest(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    return read_version(spark, root, "batch", schema)
