"""Ingest gate: store a poll unless it repeats the last stored one.

A poll is stored if it is the first of its entity, if at least 45 minutes have
passed since the last *stored* poll, or if index, pm2_5 or temperature moved.
Each decision depends on the one before, so the polls of an entity form a chain.

The chain is cut into blocks of time. A block is longer than 45 minutes, so all it has to
know of the past is which poll of the block before it was stored last, or that none was
within 45 minutes. For each of these few cases it computes which of its own polls is stored
last: a table from cases to cases. Where all cases end alike, as in almost every block, the
outcome is known without the past. Tables of the others are composed with those of the
block before, then of the two before that, the four before those, and so on, until all
end alike: the logarithm of the longest stretch in rounds. With the last stored poll before
it, every block then decides its own polls.

Most repeats are known from the poll before alone and take no part in this. A poll is surely
stored if it differs from the one before by more than twice the tolerance: what that one repeats
is then too far off as well. Up to 45 minutes after a sure one, and at one and the same time, a
poll that equals the one before repeats whatever that one repeats. So copies and constant values
cost one sort; blocks hold the polls that are left.

All of it is windows, joins and array functions on (entity, block). A task holds one block of one
entity, so a long history of one entity is as many blocks. Work within a block grows with its
polls left times their logarithm: the poll that is stored next is found by the least and greatest
measures of spans of polls, spans of spans and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breezeway.functions import fixed_values as V
from breezeway.functions.arrays import let, places
from breezeway.functions.calendar import MICROS_PER_MINUTE, micros
from breezeway.operators.series import Series
from breezeway.session import discard, materialise

REASONS = ["first", "elapsed", "changed", "unchanged"]
GATE_MICROS = V.GATE_MINUTES * MICROS_PER_MINUTE
#: A block must be at least as long as the gate.
BLOCK_MICROS = 2 * GATE_MICROS
#: Polls that are looked at before more of a block is searched, and before all the rest is.
NEAR = (1, 8, 64)
#: Of so many polls each the least and greatest measures are kept for the search of the rest.
SPAN = 16
#: Reasons are gathered in pieces of so many, as an array is copied for each that is added.
PIECE = 128

MEASURES = ["aqi", "pm2_5", "temperature"]
_STATE = "struct<t:bigint,aqi:double,pm2_5:double,temperature:double>"


def _block_of(ts: Column) -> Column:
    return F.floor(micros(ts) / BLOCK_MICROS).alias("_block")


def _measure(c: str) -> Column:
    """What the gate compares: a missing measure counts as 0."""
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def _with_sure_repeats(df: DataFrame, s: Series) -> DataFrame:
    """``df`` with _block and ``_sure``: whether the poll before it in its block shows that it is a repeat."""
    rest = [c for c in df.columns if c not in (*s.key, s.ts, s.seq)]
    measures = [_measure(c) for c in MEASURES]
    # polls without a time are alone
    alone = F.when(F.col(s.ts).isNull(), F.col(s.seq))
    w = Window.partitionBy(*s.key, "_block", alone).orderBy(s.ts, s.seq, *measures, *rest)
    t = micros(F.col(s.ts))
    poll = F.struct(t.alias("t"), *[m.alias(c) for m, c in zip(measures, MEASURES)])
    both = df.withColumn("_block", _block_of(F.col(s.ts))).withColumn("_now", poll).withColumn("_before", F.lag("_now").over(w))
    now, before = F.col("_now"), F.col("_before")
    apart = [F.abs(now[c] - before[c]) for c in MEASURES[1:]]
    stored = (now["t"] - before["t"] >= GATE_MICROS) | (now["aqi"] != before["aqi"])
    equal = now["aqi"] == before["aqi"]
    for d in apart:
        stored, equal = stored | (d > 2 * V.GATE_TOLERANCE), equal & (d == 0)
    since = F.max(F.when(stored, now["t"])).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sure = ~stored & equal & ((now["t"] == before["t"]) | F.coalesce(now["t"] - since < GATE_MICROS, F.lit(False)))
    return both.withColumn("_sure", F.coalesce(sure, F.lit(False))).drop("_now", "_before")


def _blocks(df: DataFrame, columns: list[str], s: Series) -> DataFrame:
    """key, _block, and in order of time the whole rows of its polls and what the gate compares (``states``)."""
    poll = F.struct(
        micros(F.col(s.ts)).alias("t"), F.col(s.seq).alias("seq"), *[_measure(c).alias(c) for c in MEASURES],
        F.struct(*columns).alias("row"))
    blocks = df.groupBy(*s.key, "_block").agg(F.sort_array(F.collect_list(poll)).alias("_polls"))
    return blocks.select(
        *s.key, "_block", F.col("_polls.row").alias("rows"),
        F.transform("_polls", lambda p: F.struct(p["t"], *[p[c] for c in MEASURES])).alias("states"))


def _repeats(last: Column, poll: Column) -> Column:
    """Whether ``poll`` is not stored after ``last``."""
    return F.coalesce(
        (poll["t"] - last["t"] < GATE_MICROS) & (poll["aqi"] == last["aqi"])
        & (F.abs(poll["pm2_5"] - last["pm2_5"]) < V.GATE_TOLERANCE)
        & (F.abs(poll["temperature"] - last["temperature"]) < V.GATE_TOLERANCE), F.lit(False))


def _spans(states: Column) -> Column:
    """Least and greatest of what the gate compares, of each SPAN of ``states``, of each two such spans, each four, …"""
    def of(part: Column) -> Column:
        return F.struct(F.element_at(part, -1)["t"].alias("t"), *[
            f(part[c]).alias(f"{c}_{end}") for c in MEASURES for f, end in ((F.array_min, "low"), (F.array_max, "high"))])

    def both(a: Column, b: Column) -> Column:  # the last one has none beside it
        return F.struct(F.greatest(a["t"], b["t"]).alias("t"), *[
            f(a[f"{c}_{end}"], b[f"{c}_{end}"]).alias(f"{c}_{end}")
            for c in MEASURES for f, end in ((F.least, "low"), (F.greatest, "high"))])

    def level(at: Column, _) -> Column:
        return let(F.element_at(at, -1), lambda below: F.concat(at, F.array(F.transform(
            _upto(_halves(F.size(below))), lambda i: both(F.get(below, 2 * i), F.get(below, 2 * i + 1))))))

    n = _ceil(F.size(states), SPAN)
    lowest = F.transform(_upto(n), lambda i: of(F.slice(states, i * SPAN + 1, SPAN)))
    return F.aggregate(_upto(_top(n)), F.array(lowest), level)


def _upto(n: Column) -> Column:
    return places(F.lit(0), n)


def _ceil(n: Column, size: int) -> Column:
    return F.floor((n + (size - 1)) / size).cast("int")


def _halves(n: Column) -> Column:
    return _ceil(n, 2)


def _top(n: Column) -> Column:
    """So many times ``n`` spans are halved until one is left, at least once."""
    return F.length(F.bin(n - 1))


def _all_repeat(last: Column, span: Column) -> Column:
    """Whether no poll of ``span`` is stored after ``last``; false for no span."""
    same = (span["t"] - last["t"] < GATE_MICROS) & (span["aqi_low"] == last["aqi"]) & (span["aqi_high"] == last["aqi"])
    for c in MEASURES[1:]:
        same = same & (span[f"{c}_high"] - last[c] < V.GATE_TOLERANCE) & (last[c] - span[f"{c}_low"] < V.GATE_TOLERANCE)
    return F.coalesce(same, F.lit(False))


def _span_of_next(spans: Column, last: Column, start: Column) -> Column:
    """Number of the first of the lowest ``spans`` from ``start`` on with a poll that is stored after ``last``.

    Goes up as long as wider spans begin where it stands and hold only repeats, and down again inside the first
    that doesn't. Their number or more if none does.
    """
    up, width = (lambda n, j: F.call_function("shiftright", n, j)), (lambda j: F.call_function("shiftleft", F.lit(1), j))

    def passed(at: Column, j: Column) -> Column:
        return _all_repeat(last, F.get(F.get(spans, j), up(at["n"], j)))

    def rise(at: Column, j: Column) -> Column:
        moved = F.struct((at["n"] + width(j)).alias("n"), at["within"].alias("within"))
        return (F.when(at["within"].isNotNull() | (up(at["n"], j) % 2 == 0), at)
                .when(passed(at, j), moved).otherwise(F.struct(at["n"].alias("n"), j.alias("within"))))

    def sink(at: Column, j: Column) -> Column:
        moved = F.struct((at["n"] + width(j)).alias("n"), at["within"].alias("within"))
        return F.when((at["within"].isNull() | (j < at["within"])) & passed(at, j), moved).otherwise(at)

    levels = _upto(F.size(spans))
    from_start = F.struct(start.cast("int").alias("n"), F.lit(None).cast("int").alias("within"))
    return F.aggregate(F.reverse(levels), F.aggregate(levels, from_start, rise), sink, lambda at: at["n"])


def _next(states: Column, spans: Column, last: Column, start: Column) -> Column:
    """Place of the first of ``states`` from ``start`` on that is stored after ``last``; null if none is.

    Beyond the near ones the ``spans`` are searched, in the logarithm of their number.
    """
    n = F.size(states)
    stored = lambda k: ~_repeats(last, F.get(states, k))
    first = lambda a, b: F.get(F.filter(places(a, b), stored), F.lit(0))
    far = _ceil(start + NEAR[-1], SPAN) * SPAN
    near = [F.least(k, n) for k in (*[start + k for k in NEAR[:-1]], far)]
    found = [first(a, b) for a, b in zip([start, *near], near)]
    beyond = let(_span_of_next(spans, last, far / SPAN) * SPAN, lambda a: first(a, F.least(a + SPAN, n)))
    return F.coalesce(*found, F.when(far < n, beyond))


def _ends(states: Column, spans: Column) -> Column:
    """For each of ``states``: the place of the last stored one if this one is stored.

    The next stored ones are followed in steps of doubled length.
    """
    follow = F.transform(states, lambda x, i: F.coalesce(_next(states, spans, x, i + 1), i))
    return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(F.size(states)))), follow,
                       lambda to, _: F.transform(to, lambda k: F.get(to, k)))


def _beside(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Null-safe join on ``on`` that keeps the columns of ``left``; keys of ``right`` are unique."""
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(right.withColumnsRenamed({c: f"_r_{c}" for c in on}), condition, how).drop(*[f"_r_{c}" for c in on])


def _tables(states: DataFrame, on: list[str]) -> DataFrame:
    """on, skipped, table: ``table[0]`` is the place of the last stored poll if none is recent before
    the block, ``table[1 + i]`` if it is poll ``skipped + i`` of the block before; -1 for none."""
    before = states.select(*on[:-1], (F.col("_block") + 1).alias("_block"), F.col("states").alias("earlier"))
    both = _beside(states, before, on, "left")
    earlier = F.coalesce("earlier", F.array().cast(f"array<{_STATE}>"))
    recent = F.filter(earlier, lambda x: x["t"] > F.get("states", F.lit(0))["t"] - GATE_MICROS)

    def table(spans: Column, ends: Column) -> Column:
        of = lambda x: let(_next(F.col("states"), spans, x, F.lit(0)), lambda k: F.coalesce(F.get(ends, k), F.lit(-1)))
        return F.concat(F.array(F.get(ends, F.lit(0))), F.transform("recent", of))

    return both.withColumn("recent", recent).select(
        *on, (F.size(earlier) - F.size("recent")).alias("skipped"),
        let(_spans(F.col("states")), lambda spans: let(_ends(F.col("states"), spans), lambda ends: table(spans, ends))).alias("table"))


def _outcomes(tables: DataFrame, on: list[str]) -> DataFrame:
    """on, last: the place of the last stored poll of each block, -1 for none."""
    alike = F.size(F.array_distinct("table")) == 1
    now, span = materialise(tables.select("*", alike.alias("known")), "gate-tables"), 1
    while not now.where("NOT known").isEmpty():
        before = now.select(*on[:-1], (F.col("_block") + span).alias("_block"), F.col("skipped").alias("_skipped"),
                            F.col("table").alias("_table"))
        open_ = _beside(now.where("NOT known"), before, on, "inner")
        case = lambda e: F.when(e < F.col("skipped"), 0).otherwise(e - F.col("skipped") + 1)
        # in two steps: a name given in a select would hide the column of that name in its lambdas
        composed = open_.select(*on, "_skipped", F.transform("_table", lambda e: F.get("table", case(e))).alias("_composed"))
        composed = composed.withColumnsRenamed({"_skipped": "skipped", "_composed": "table"})
        after = materialise(now.where("known").unionByName(composed.select("*", alike.alias("known"))), "gate-tables")
        discard(now)
        now, span = after, 2 * span
    return now.select(*on, F.get("table", F.lit(0)).alias("last"))


def _reasons(states: Column, entry: Column, opening: Column) -> Column:
    """Reason of each of ``states`` after the stored poll ``entry``, or after none (``opening``)."""
    def step(at: Column, poll: Column) -> Column:
        reason = (F.when(at["last"].isNull(), opening).when(_repeats(at["last"], poll), "unchanged")
                  .when(poll["t"] - at["last"]["t"] >= GATE_MICROS, "elapsed").otherwise("changed"))
        return let(reason, lambda r: F.struct(
            F.when(r == "unchanged", at["last"]).otherwise(poll).cast(_STATE).alias("last"),
            F.array_append(at["out"], r).alias("out")))

    def piece(at: Column, part: Column) -> Column:
        none = F.struct(at["last"].alias("last"), F.array().cast("array<string>").alias("out"))
        return let(F.aggregate(part, none, step), lambda p: F.struct(
            p["last"].alias("last"), F.array_append(at["out"], p["out"]).alias("out")))

    start = F.struct(entry.cast(_STATE).alias("last"), F.array().cast("array<array<string>>").alias("out"))
    parts = F.transform(F.sequence(F.lit(1), F.size(states), F.lit(PIECE)), lambda k: F.slice(states, k, PIECE))
    return F.aggregate(parts, start, piece, lambda at: F.flatten(at["out"]))


def with_gate_reason(df: DataFrame, s: Series = Series()) -> DataFrame:
    """``df`` with the ``reason`` of every poll; ``unchanged`` polls are the rejected ones.

    Polls of one time are taken by ``seq``. Polls without a time count as changed.
    """
    on = [*s.key, "_block"]
    polls = materialise(_with_sure_repeats(df, s), "gate-polls")
    timed = F.col("_block").isNotNull()
    blocks = materialise(_blocks(polls.where(timed & ~F.col("_sure")), df.columns, s), "gate-blocks")
    states = blocks.select(*on, "states")
    outcome = _outcomes(_tables(states, on), on)
    entry = _beside(states, outcome, on, "inner").select(
        *s.key, (F.col("_block") + 1).alias("_block"), F.when(F.col("last") >= 0, F.get("states", "last")).alias("_entry"))
    opening = states.groupBy(*s.key).agg(F.min("_block").alias("_block")).withColumn("_first", F.lit(True))
    entries = _beside(_beside(states.select(*on), entry, on, "left"), opening, on, "left")
    reasons = _reasons(F.col("states"), F.col("_entry"), F.when(F.col("_first"), "first").otherwise("elapsed"))
    both = let(reasons, lambda r: F.transform("rows", lambda row, i: F.struct(row.alias("row"), F.get(r, i).alias("reason"))))
    decided = _beside(blocks, entries, on, "inner").select(F.explode(both).alias("_p")).select("_p.row.*", "_p.reason")
    known = polls.where(~timed | F.col("_sure")).select(*df.columns, F.when(timed, "unchanged").otherwise("changed").alias("reason"))
    return known.unionByName(decided)


def gate_reasons(df: DataFrame, s: Series = Series()) -> DataFrame:
    """(seq, reason) of every poll; ``unchanged`` polls are the rejected ones."""
    needed = list(dict.fromkeys([*s.key, s.ts, s.seq, "aqi", "pm2_5", "temperature"]))
    return with_gate_reason(df.select(*needed), s).select(s.seq, "reason")


def accepted(df: DataFrame, s: Series = Series()) -> DataFrame:
    """The polls to store."""
    return with_gate_reason(df, s).where("reason <> 'unchanged'").drop("reason")
