"""Row-ordered work on entity series that stays parallel when one entity is huge.

Lags, rolling frames, leads, runs and positions are defined over the rows of
one entity in time order. Most entities fit in one window task, so they use a
plain ``partitionBy(key).orderBy(ts, seq)`` window: one shuffle.

Entities with more than ``max_rows`` rows are found by a count and take a
second way, with the same results:

1. ``repartitionByRange(key, ts, seq)`` lays their rows out in even, ordered
   blocks (ties and hot keys are split too), written to the shared folder so
   that the layout is fixed;
2. block counts give every row its exact position in its entity;
3. positions are cut into chunks; the few rows a neighbour needs are copied to
   it, windows run per (key, chunk), and the copies are dropped.

Running values (run numbers, carried values) add a scan over one summary row
per chunk.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from breezeway.session import materialise, plan_name

# A summary or key table is broadcast only below this many rows.
BROADCAST_ROWS = 500_000


@dataclass(frozen=True)
class Series:
    """Which columns name the entity, its time and its tie-breaker.

    ``max_rows`` bounds the rows of one entity in one window task.
    """

    key: tuple[str, ...] = ("location",)
    ts: str = "timestamp"
    seq: str = "seq"
    max_rows: int = 1_000_000

    @property
    def order(self) -> list[str]:
        return [self.ts, self.seq]

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.key).orderBy(*self.order)


@dataclass(frozen=True)
class Split:
    """Rows of ordinary entities, rows of huge ones, and the bounds known about them."""

    cold: DataFrame
    hot: DataFrame | None = None
    hot_rows: int = 0
    hot_entities: int = 0


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` if ``rows``, a proven upper bound of its size, is small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def same_key(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Null-safe equality on ``names``."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition


def attach(left: DataFrame, right: DataFrame, on: list[str], rows: int) -> DataFrame:
    """Null-safe inner join that keeps ``left``'s key columns; ``right`` has unique keys."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    joined = left.join(bounded(renamed, rows), condition)
    return joined.drop(*[f"_r_{c}" for c in on])


@dataclass(frozen=True)
class Heavy:
    """Entities with more than ``max_rows`` rows: how many, their rows, and their keys if any."""

    entities: int
    rows: int
    keys: DataFrame | None = None


# What is known of frames that were counted. Chained operators only add columns, so the
# key column alone has the same optimized plan for all of them and is counted once.
_counted: OrderedDict[tuple, Heavy] = OrderedDict()
COUNTED_FRAMES = 64


def heavy_entities(df: DataFrame, s: Series) -> Heavy:
    """Count rows per entity; one partial aggregate over the key columns."""
    keys = df.select(*s.key)
    name = (df.sparkSession.sparkContext.applicationId, *plan_name(keys), s.key, s.max_rows)
    if name not in _counted:
        counts = keys.groupBy(*s.key).agg(F.count(F.lit(1)).alias("_rows"))
        heavy = counts.filter(F.col("_rows") > s.max_rows)
        found = heavy.agg(F.count(F.lit(1)).alias("n"), F.sum("_rows").alias("rows")).first()
        _counted[name] = Heavy(
            found["n"], found["rows"] or 0,
            materialise(heavy.drop("_rows"), "heavy-entities") if found["n"] else None)
        if len(_counted) > COUNTED_FRAMES:
            _counted.popitem(last=False)
    return _counted[name]


def split_by_size(df: DataFrame, s: Series) -> Split:
    """Separate the entities whose rows exceed ``s.max_rows``."""
    heavy = heavy_entities(df, s)
    if not heavy.entities:
        return Split(df)
    keys = bounded(heavy.keys, heavy.entities)
    match = same_key(df, keys, list(s.key))
    return Split(
        cold=df.join(keys, match, "left_anti"),
        hot=df.join(keys, match, "left_semi"),
        hot_rows=heavy.rows,
        hot_entities=heavy.entities,
    )


def _range_blocks(df: DataFrame, columns: list[str], rows: int, per_block: int) -> tuple[DataFrame, int]:
    """Ordered blocks with a fixed row address ``_at``; returns their number too."""
    parts = max(1, math.ceil(rows / per_block))
    laid = (
        df.repartitionByRange(parts, *columns)
        .sortWithinPartitions(*columns)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    laid = materialise(laid, "ordered-blocks")
    return laid.withColumn("_block", F.shiftright("_at", 33)), parts


def _before(totals: DataFrame, key: list[str], place: str, amount: str, name: str) -> DataFrame:
    """Exclusive running sum of ``amount`` over ``place`` within ``key``."""
    w = Window.partitionBy(*key).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(name, F.coalesce(F.sum(amount).over(w), F.lit(0)))


def place_hot(split: Split, s: Series) -> DataFrame:
    """Rows of the huge entities with ``_pos`` (1-based) and ``_total``."""
    key = list(s.key)
    blocks, parts = _range_blocks(split.hot, [*key, *s.order], split.hot_rows, s.max_rows)
    totals = blocks.groupBy(*key, "_block").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    totals = _before(totals, key, "_block", "_rows", "_ahead_of")
    totals = totals.withColumn("_total", F.sum("_rows").over(Window.partitionBy(*key)))
    placed = attach(blocks, totals, [*key, "_block"], parts + split.hot_entities)
    return placed.withColumn(
        "_pos", F.col("_ahead_of") + F.col("_at") - F.col("_first") + 1
    ).drop("_at", "_block", "_first", "_rows", "_ahead_of")


def chunk_rows(placed: DataFrame, s: Series, back: int, ahead: int) -> DataFrame:
    """Cut positions into chunks and copy edge rows to the neighbour that needs them."""
    size = max(s.max_rows, back + ahead + 1)
    offset = F.col("_pos") - 1
    home = F.floor(offset / F.lit(size)).cast("long")
    within = offset % F.lit(size)
    chunks = F.array_compact(
        F.array(
            home,
            F.when(within >= size - back, home + 1),
            F.when((within < ahead) & (home > 0), home - 1),
        )
    )
    return (
        placed.withColumn("_home", home)
        .withColumn("_chunk", F.explode(chunks))
        .withColumn("_own", F.col("_home") == F.col("_chunk"))
        .drop("_home")
    )


def chunk_window(s: Series) -> WindowSpec:
    return Window.partitionBy(*s.key, "_chunk").orderBy("_pos")


def with_window_steps(
    df: DataFrame,
    steps: Callable[[DataFrame, WindowSpec], DataFrame],
    s: Series,
    back: int = 0,
    ahead: int = 0,
) -> DataFrame:
    """Apply window ``steps`` that together look ``back`` rows behind and ``ahead`` rows on.

    ``steps`` receives the rows and their ordered window; it may use windows
    over columns made by earlier windows, and must keep all columns.
    """
    split = split_by_size(df, s)
    out = steps(split.cold, s.window())
    if split.hot is None:
        return out
    chunks = chunk_rows(place_hot(split, s), s, back, ahead)
    hot = steps(chunks, chunk_window(s)).filter("_own")
    return out.unionByName(hot.select(*out.columns))


def with_windows(
    df: DataFrame, build: Callable[[WindowSpec], list[Column]], s: Series, back: int = 0, ahead: int = 0,
) -> DataFrame:
    """Add window columns; ``build`` receives the ordered window and returns aliased columns."""
    return with_window_steps(df, lambda rows, w: rows.select("*", *build(w)), s, back, ahead)


def with_positions(df: DataFrame, s: Series, pos: str = "_pos", total: str = "_total") -> DataFrame:
    """Add each row's 1-based place in its entity and the entity's row count."""
    split = split_by_size(df, s)
    out = split.cold.select(
        "*",
        F.row_number().over(s.window()).cast("long").alias(pos),
        F.count(F.lit(1)).over(Window.partitionBy(*s.key)).alias(total),
    )
    if split.hot is None:
        return out
    hot = place_hot(split, s).withColumnsRenamed({"_pos": pos, "_total": total})
    return out.unionByName(hot.select(*out.columns))


def _chunk_carry(
    rows: DataFrame, s: Series, split: Split,
    carries: dict[str, tuple[Column, Callable[[str, WindowSpec], Column]]],
) -> DataFrame:
    """Attach to every row what can be read off the summaries of earlier chunks.

    ``carries`` maps a new column to (summary of one chunk, scan over summaries).
    """
    key = list(s.key)
    earlier = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*key, "_chunk").agg(*[a.alias(n) for n, (a, _) in carries.items()])
    sums = sums.select(*key, "_chunk", *[scan(n, earlier).alias(n) for n, (_, scan) in carries.items()])
    chunks = math.ceil(split.hot_rows / s.max_rows) + split.hot_entities
    return attach(rows, sums, [*key, "_chunk"], chunks)


def with_runs(df: DataFrame, s: Series, starts: Callable[[WindowSpec], Column], run: str = "run_id") -> DataFrame:
    """Number the runs of each entity from 1.

    ``starts`` says, given the ordered window, whether a row opens a run; it may
    look one row back.
    """
    split = split_by_size(df, s)
    so_far = (Window.unboundedPreceding, Window.currentRow)
    cold = (
        split.cold.withColumn("_start", starts(s.window()).cast("long"))
        .withColumn(run, F.sum("_start").over(s.window().rowsBetween(*so_far)))
        .drop("_start")
    )
    if split.hot is None:
        return cold
    rows = chunk_rows(place_hot(split, s), s, back=1, ahead=0)
    rows = rows.withColumn("_start", starts(chunk_window(s)).cast("long")).filter("_own")
    rows = _chunk_carry(rows, s, split, {"_carried": (
        F.sum("_start"), lambda name, w: F.coalesce(F.sum(name).over(w), F.lit(0)))})
    local = F.sum("_start").over(chunk_window(s).rowsBetween(*so_far))
    return cold.unionByName(rows.withColumn(run, F.col("_carried") + local).select(*cold.columns))


def with_last_known(df: DataFrame, values: dict[str, str], s: Series) -> DataFrame:
    """For each value column add struct(ts, value) of the latest row so far that knows it.

    ``values`` maps a value column to the name of the added struct.
    """
    split = split_by_size(df, s)
    so_far = (Window.unboundedPreceding, Window.currentRow)
    known = {
        into: F.when(
            F.col(c).isNotNull(), F.struct(F.col(s.ts).alias("ts"), F.col(c).alias("value")))
        for c, into in values.items()
    }

    def latest(w: WindowSpec) -> dict[str, Column]:
        return {n: F.last(k, ignorenulls=True).over(w.rowsBetween(*so_far)) for n, k in known.items()}

    cold = split.cold.withColumns(latest(s.window()))
    if split.hot is None:
        return cold
    rows = chunk_rows(place_hot(split, s), s, back=0, ahead=0)
    rows = _chunk_carry(rows, s, split, {
        f"_carried_{n}": (
            F.max_by(k, F.when(k.isNotNull(), F.col("_pos"))),
            lambda name, w: F.last(name, ignorenulls=True).over(w))
        for n, k in known.items()
    })
    found = latest(chunk_window(s))
    rows = rows.withColumns({n: F.coalesce(c, F.col(f"_carried_{n}")) for n, c in found.items()})
    return cold.unionByName(rows.select(*cold.columns))


def running_count(counts: DataFrame, group: list[str], order: str, amount: str, s: Series) -> DataFrame:
    """Add ``_upto``: the running sum of ``amount`` over ``order`` within ``group``, and ``_all``.

    Meant for value counts of unknown size: ordered blocks instead of one task per group.
    """
    counts = materialise(counts, "value-counts")
    rows = counts.count()
    blocks, parts = _range_blocks(counts, [*group, order], rows, s.max_rows)
    totals = blocks.groupBy(*group, "_block").agg(F.sum(amount).alias("_amount"))
    totals = _before(totals, group, "_block", "_amount", "_ahead_of")
    totals = totals.withColumn("_all", F.sum("_amount").over(Window.partitionBy(*group)))
    groups = totals.select(*group).distinct().count()
    placed = attach(blocks, totals.drop("_amount"), [*group, "_block"], parts + groups)
    w = Window.partitionBy(*group, "_block").orderBy(order)
    local = F.sum(amount).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn("_upto", F.col("_ahead_of") + local).drop("_at", "_block", "_ahead_of")
