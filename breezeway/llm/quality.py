"""Quality rules with thresholds from the data.

Counts are integers per text. Each measure (a count per mille of another) is summed into
a histogram whose buckets keep the leading bits of a value: a quantile sketch with a fixed
relative error that merges by adding counts. Upper fences come from the quantiles of a
language and source; groups with few documents take the merged sketch of their language,
then that of all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breezeway.llm.common import BLANK, attach_small, let, words
from breezeway.session import materialise

WINDOW = 8
#: Leading bits that a bucket keeps: values below 2**BITS are exact, others within 1/16.
BITS = 5
#: measure -> (count, per, upper quantile in per mille, reach): a group's fence is its median plus
#: ``reach`` times what the upper quantile exceeds it by, plus MARGIN. Symbols and marks are junk
#: that may fill much of a group, so their quantile is low; lines and words repeat in a few good texts.
MEASURES = {
    "symbol_share": ("n_symbols", "word_chars", 750, 8),
    "dup_line_share": ("n_dup_lines", "n_lines", 980, 3),
    "repeat_share": ("n_repeat_words", "n_words", 980, 3),
    "same_word_share": ("n_same_words", "n_words", 900, 6),
    "capital_share": ("n_capitals", "word_chars", 900, 6),
    "mark_share": ("n_marks", "word_chars", 750, 8),
}
#: Per mille that a document may always exceed the quantiles by.
MARGIN = 5
#: The median and the upper quantiles in use, in per mille.
QUANTILES = (500, *sorted({upper for _, _, upper, _ in MEASURES.values()}))


def _repeat_words(hashes: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text."""
    def joined(a: Column, step: int) -> Column:
        # the hash of i and of i + step; the tail, where one of both is missing, is cut
        both = F.zip_with(a, F.slice(a, step + 1, F.greatest(F.size(a) - step, F.lit(0))),
                          lambda x, y: F.when(y.isNotNull(), F.xxhash64(x, y)))
        return F.slice(both, 1, F.greatest(F.size(a) - step, F.lit(0)))

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def flagged(s: Column) -> Column:
            after = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))
            return let(after, lambda a: F.zip_with(
                s, F.zip_with(a, F.concat(F.array(F.lit(False)), a), lambda x, y: F.coalesce(x, F.lit(False)) | y),
                lambda x, f: F.when(f, x["i"])))

        def length(at: Column) -> Column:
            steps = F.zip_with(at, F.slice(at, 2, F.size(at)),
                               lambda x, y: F.least(F.coalesce(y - x, F.lit(WINDOW)), F.lit(WINDOW)))
            return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

        return let(placed, lambda s: let(F.array_sort(F.array_compact(flagged(s))), length))

    def of_windows(h1: Column) -> Column:
        return let(joined(h1, 1), lambda h2: let(joined(h2, 2), lambda h4: let(
            joined(h4, 4), lambda h8: F.when(F.size(F.array_distinct(h8)) < F.size(h8), covered(h8)).otherwise(0))))

    return F.when(F.size(hashes) > WINDOW, let(hashes, of_windows)).otherwise(0).cast("long")


def counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``docs`` with one struct column ``counts`` of integers; all 0 for a null or empty text."""
    whole = F.coalesce(F.col(text), F.lit(""))
    hashes = F.transform(words(F.col(text)), lambda w: F.xxhash64(w))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    n_lines = let(lines, lambda x: F.struct(
        F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    many = lambda pattern: F.regexp_count(whole, F.lit(pattern)).cast("long")
    same = lambda h: F.size(F.filter(
        F.zip_with(h, F.slice(h, 2, F.size(h)), lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    word_parts = let(hashes, lambda h: F.struct(
        F.size(h).alias("n"), _repeat_words(h).alias("repeats"),
        F.when(F.size(h) > 1, same(h)).otherwise(0).alias("same")))
    # bound once: as columns they would be inlined and computed again for each field
    return docs.withColumn("counts", let(word_parts, lambda w: let(n_lines, lambda x: F.struct(
        w["n"].cast("long").alias("n_words"),
        (F.length(whole) - F.regexp_count(whole, F.lit(BLANK))).cast("long").alias("word_chars"),
        many("[#*$%&|<>]").alias("n_symbols"),
        x["dup"].cast("long").alias("n_dup_lines"),
        w["repeats"].alias("n_repeat_words"),
        x["n"].cast("long").alias("n_lines"),
        w["same"].cast("long").alias("n_same_words"),
        many(r"\p{Lu}").alias("n_capitals"),
        many("[!?]").alias("n_marks"),
    ))))


def base_failed(c: Column, *, least_words: int = 20, most_repeat_percent: int = 30) -> Column:
    """The two fixed rules that hold before any threshold."""
    return (c["n_words"] < least_words) | (100 * c["n_repeat_words"] > most_repeat_percent * c["n_words"])


def measures(c: Column) -> Column:
    """Struct of the measures in whole per mille; 0 over nothing."""
    return F.struct(*[
        F.when(c[per] > 0, F.floor(1000 * c[count] / c[per])).otherwise(0).cast("long").alias(name)
        for name, (count, per, _, _) in MEASURES.items()])


def bucket(value: Column) -> Column:
    """Lower end of the sketch bucket of a whole number from 0."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    power = F.pow(F.lit(2.0), shift).cast("long")
    return (F.floor(value / power) * power).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """Sketch rows lang, source, measure, bucket, n of rows with lang, source, measures."""
    each = F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), bucket(F.col(f"measures.{m}")).alias("bucket")) for m in MEASURES]))
    return measured.select("lang", "source", each.alias("at")).groupBy(
        "lang", "source", F.col("at.measure").alias("measure"), F.col("at.bucket").alias("bucket"),
    ).agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, group: list[str], at: tuple[int, ...]) -> DataFrame:
    """Quantiles q0, q1, … (in per mille) of each group and measure, and its number of rows ``n``.

    Merges the sketch rows of a group first. A quantile is the lower end of the bucket
    that holds the row of rank ceil(q * n / 1000).
    """
    merged = sketch.groupBy(*group, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*group, "measure")
    upto = F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.withColumn("_upto", upto).withColumn("_all", F.sum("n").over(w))
    return ranked.groupBy(*group, "measure").agg(F.max("_all").alias("n"), *[
        F.min(F.when(F.col("_upto") * 1000 >= F.col("_all") * q, F.col("bucket"))).alias(f"q{i}")
        for i, q in enumerate(at)])


def thresholds(measured: DataFrame, *, least_docs: int = 100, margin: int = MARGIN) -> DataFrame:
    """Upper fences lang, source, fences (measure -> per mille): see MEASURES.

    A group of fewer than ``least_docs`` documents takes the fence of its language, and a
    language of fewer the fence of all documents.
    """
    sketch = materialise(sketches(measured), "sketches")
    fence = F.lit(None).cast("long")
    for name, (_, _, upper, reach) in MEASURES.items():
        spread = F.col(f"q{QUANTILES.index(upper)}") - F.col("q0")
        fence = F.when(F.col("measure") == name, F.col("q0") + reach * spread + margin).otherwise(fence)

    def fences(group: list[str], label: str) -> DataFrame:
        return quantiles(sketch, group, QUANTILES).select(
            *[F.col(g).alias(f"{label}_{g}") for g in group], F.col("measure").alias(f"{label}_measure"),
            F.when(F.col("n") >= least_docs, fence).alias(label) if group else fence.alias(label))

    own, of_lang, of_all = fences(["lang", "source"], "own"), fences(["lang"], "lang"), fences([], "all")
    chosen = (
        own.join(of_lang, F.col("own_lang").eqNullSafe(F.col("lang_lang"))
                 & (F.col("own_measure") == F.col("lang_measure")), "left")
        .join(of_all, F.col("own_measure") == F.col("all_measure"), "left")
    )
    return chosen.groupBy(F.col("own_lang").alias("lang"), F.col("own_source").alias("source")).agg(*[
        F.max(F.when(F.col("own_measure") == m, F.coalesce("own", "lang", "all"))).alias(f"most_{m}")
        for m in MEASURES])


def _within() -> Column:
    ok = F.lit(True)
    for m in MEASURES:
        ok = ok & (F.col(f"measures.{m}") <= F.coalesce(F.col(f"most_{m}"), F.lit(1 << 40)))
    return ok


def judge(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source",
    least_docs: int = 100, margin: int = MARGIN,
) -> DataFrame:
    """One row per document: key, the counts, base_failed, the measures, their fences, kept.

    A document that a fixed rule fails takes no part in the sketches and is not kept.
    Null and empty texts have no words and fail. Null languages and sources are groups of
    their own. Equal rows get equal verdicts; an empty table gives an empty one.
    """
    counted = counts(docs.select(
        F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"),
    )).select("key", "lang", "source", "counts")
    measured = materialise(counted.select(
        "*", base_failed(F.col("counts")).alias("base_failed"), measures(F.col("counts")).alias("measures")), "quality")
    table = materialise(
        thresholds(measured.where(~F.col("base_failed")), least_docs=least_docs, margin=margin), "fences")
    joined = attach_small(measured, table, ["lang", "source"], table.count(), F.col("key"))
    return joined.select(
        F.col("key").alias(key), "counts.*", "base_failed", "measures.*", *[f"most_{m}" for m in MEASURES],
        (~F.col("base_failed") & _within()).alias("kept"))


def filtered(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source",
    least_docs: int = 100, margin: int = MARGIN,
) -> DataFrame:
    """The documents that the rules keep, with their columns.

    The texts are read twice, first for the sketches and then for the verdicts, so that
    no text is shuffled or stored between.
    """
    plain = docs.select(F.struct(*docs.columns).alias("kept"), F.col(text).alias("text"),
                        F.col(lang).alias("lang"), F.col(source).alias("source"))
    verdict = let(F.col("counts"), lambda c: F.struct(base_failed(c).alias("base_failed"), measures(c).alias("measures")))
    # a generator of one row: what is asked of its columns isn't moved below it and computed twice
    measured = counts(plain).select("kept", "lang", "source", F.inline(F.array(verdict)))
    table = materialise(thresholds(
        measured.where(~F.col("base_failed")).select("lang", "source", "measures"),
        least_docs=least_docs, margin=margin), "fences")
    joined = attach_small(measured.where(~F.col("base_failed")), table, ["lang", "source"], table.count(),
                          F.xxhash64("kept.*"))
    return joined.where(_within()).select("kept.*")
