"""Mixing sources to target weights with hash-threshold histograms.

Words are summed by source and hash digit. Where the running sum of a source crosses its
budget lies one boundary bucket; only rows of that bucket are looked at again, by their
next digit, until one row is left. Rows are then kept by comparing their digits with the
cut of their source. Nothing is sorted, and budgets of one source are nested: a larger
budget keeps every row that a smaller one keeps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breezeway.llm.common import attach_small, n_words, positions
from breezeway.session import materialise

DIGIT_BITS = 12
#: Digits of the hash of a row's content, then digits of its number, which part equal rows.
CONTENT_DIGITS, NUMBER_DIGITS = 5, 5


def _digits(value: Column, n: int) -> list[Column]:
    """The ``n`` highest digits of a 64-bit value."""
    mask = (1 << DIGIT_BITS) - 1
    return [F.shiftrightunsigned(value, 64 - DIGIT_BITS * (i + 1)).bitwiseAND(F.lit(mask)).cast("int")
            for i in range(n)]


def targets(
    sizes: DataFrame, *, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, repeat: int = 2,
) -> DataFrame:
    """Target words of every source of ``sizes`` (source, source_size).

    Sources in code-point order, null last, take the weights in turn and share
    ``share`` times all words. A target stops at ``repeat`` times its source's size and
    the excess is shared again by weight. Each round needs two sums; the level that a
    weight of 1 gets only rises, so a source once stopped stays stopped.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    placed = positions(sizes, "source").withColumn("weight", weight)
    named = sizes.select(F.col("source").alias("_source"), "source_size")
    table = materialise(
        placed.join(named, F.col("source").eqNullSafe(F.col("_source"))).select("source", "source_size", "weight"),
        "sources",
    )
    limit = F.col("source_size") * repeat
    level = -1.0
    while True:
        open_ = limit >= F.col("weight") * F.lit(level)
        total, stopped, shared = table.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(~open_, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(open_, F.col("weight"))), F.lit(0)),
        ).first()
        higher = (share * total - stopped) / shared if shared else level
        if higher <= level:
            break
        level = higher
    target = F.least(limit.cast("double"), F.col("weight") * F.lit(float(max(level, 0.0))))
    return table.select("source", "source_size", target.alias("target"))


def cuts(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """For each source the whole copies of all its rows, and the cut for one copy more.

    ``rows``: source, size, digits; ``sources``: source, source_size, target. Returns
    source, source_size, target, whole, cut, inclusive.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = materialise(sources.withColumn("whole", whole.cast("int")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")), "budgets")
    n_sources = state.count()
    left = state.select("source", "rest", F.array().cast("array<int>").alias("cut"))
    active, done = rows, None
    for digit in range(CONTENT_DIGITS + NUMBER_DIGITS):
        sums = active.groupBy("source", F.col("digits")[digit].alias("_digit")).agg(
            F.sum("size").alias("_size"), F.count(F.lit(1)).alias("_rows"))
        running = F.sum("_size").over(
            Window.partitionBy("source").orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0))
        crossing = (
            attach_small(sums.withColumn("_upto", running), left, ["source"], n_sources, F.col("_digit"))
            .where(F.col("_upto") > F.col("rest"))
            .groupBy("source")
            .agg(F.min_by(F.struct("_digit", "_size", "_rows", "_upto", "rest", "cut"), "_digit").alias("_at"))
        )
        rest = F.col("_at.rest") - (F.col("_at._upto") - F.col("_at._size"))
        found = materialise(crossing.select(
            "source", rest.alias("rest"), F.concat(F.col("_at.cut"), F.array("_at._digit")).alias("cut"),
            ((F.col("_at._rows") == 1) & (2 * rest > F.col("_at._size"))).alias("inclusive"),
            ((F.col("_at._rows") == 1) | (rest <= 0)).alias("_ends"),
        ), "cuts")
        last = digit == CONTENT_DIGITS + NUMBER_DIGITS - 1
        ended = found.where(F.lit(last) | F.col("_ends")).select("source", "cut", "inclusive")
        done = ended if done is None else done.unionByName(ended)
        left = found.where(~F.col("_ends")).select("source", "rest", "cut")
        if last or left.isEmpty():
            break
        inside = attach_small(
            active, left.select("source", F.col("cut").alias("_cut")), ["source"], n_sources, F.col("digits"))
        active = materialise(inside.where(F.slice("digits", 1, digit + 1) == F.col("_cut")).drop("_cut"), "boundary")
    # a source that its budget takes whole has no crossing: every digit lies below the cut
    return attach_small(state.drop("rest"), done, ["source"], n_sources, F.col("source")).select(
        "source", "source_size", "target", "whole",
        F.coalesce("cut", F.array(F.lit(1 << DIGIT_BITS))).alias("cut"),
        F.coalesce("inclusive", F.lit(False)).alias("inclusive"),
    )


def mix(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source",
    carry: Sequence[str] | None = None, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, repeat: int = 2,
) -> DataFrame:
    """Every row with the copies that the mix takes of it.

    Returns the columns of ``carry`` (default: all) and one struct ``mixed``: size (words),
    source_size, target, copies. A row is taken whole, at most ``repeat`` times. The words
    taken of a source differ from its target by half a row at most. Rows that are equal in
    key and text are told apart by their number, so how many of them are taken is fixed.
    Texts without words (null, empty) have size 0; they follow their hash like the rest,
    and all are taken once per whole copy of their source. An empty table gives an empty one.
    """
    carry = list(docs.columns if carry is None else carry)
    tagged = docs.select(
        F.struct(*[F.col(c) for c in carry]).alias("kept"), F.col(source).cast("string").alias("source"),
        n_words(F.col(text)).alias("size"), F.xxhash64(key, text).alias("_hash"),
        F.xxhash64(F.monotonically_increasing_id(), F.lit("row")).alias("_number"),
    )
    digits = F.array(*_digits(F.col("_hash"), CONTENT_DIGITS), *_digits(F.col("_number"), NUMBER_DIGITS))
    rows = materialise(tagged.select("kept", "source", "size", digits.alias("digits")), "mixing")
    narrow = rows.select("source", "size", "digits")
    sizes = materialise(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), "sizes")
    table = cuts(narrow, targets(sizes, weights=weights, share=share, repeat=repeat))
    table = materialise(table, "mix")
    head = F.slice(F.col("digits"), 1, F.size("cut"))
    more = (head < F.col("cut")) | ((head == F.col("cut")) & F.col("inclusive"))
    copies = F.least(F.col("whole") + more.cast("int"), F.lit(repeat))
    joined = attach_small(rows, table, ["source"], table.count(), F.col("digits"))
    return joined.select("kept.*", F.struct(
        F.col("size"), F.col("source_size"), F.col("target"), copies.alias("copies")).alias("mixed"))
