"""Jaccard self-join on word n-grams by universe partition.

A set's n-gram hashes are dealt by a hash into the segments of a size band. Two sets of a
band (or of it and the next) that are similar enough differ in at most H n-grams, so of
H + 1 segments one at least is equal in both. A few spare segments more make up for empty
ones, which many sets share: with E of them, E + 1 segments are equal, so one that is not
empty is, unless both sets have more than E empty segments. Only such rare sets, then,
have signatures of empty segments. An allocation gives each segment 0 (not
used), 1 (found when equal) or 2 (found when one n-gram is missing on one side, by all
one-deletion subsets); as long as it keeps its sum no pair is lost. It starts at 1
everywhere. Where the measured work of a segment is larger than that of the cheapest one
with its deletions, the first goes to 0 and the second to 2.

Equal sets are one class from the start. Within a group of classes that share a segment,
the class with the most shared segments is the pivot: all others are verified against it.
Later rounds take more pivots, and only pairs that are not yet in one component. A group
of near copies so costs a row for each member, not one for each pair.

Before n-grams are read, a pair is checked by sketches: of each of SKETCH_BITS buckets, whether
an odd number of the set's n-grams fall into it. Buckets in which two sketches differ hold an n-gram
that only one of the sets has, so sets that differ in more buckets than similar ones do in n-grams
cannot link. The check stands in the join that pairs members, so that such pairs are never rows.

Nothing as large as the texts is kept: signatures are shuffled in PARTS by their group, of which the
groups that classes share are left, and n-grams are made again from the texts, for classes of pairs alone.
Pairs grow faster than the documents, so they are checked in passes, each of which shuffles n-grams in
proportion to the documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breezeway.llm.components import contract
from breezeway.llm.textarrays import Texts, chunks, hash_words, mix, split_words
from breezeway.session import bound_batches, discard, materialise, release_shuffles

#: Class ids are broadcast to filter the documents up to this many (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Larger groups are dealt anew after the pivot's round.
SMALL_GROUP = 1024
#: Signatures are shuffled in so many parts, one after the other.
PARTS = 3
#: The n-grams of the pairs of a pass are at most this share of those of all documents.
PASS_SHARE = 1 / 3
#: Buckets of a set's sketch, in words of 64.
SKETCH_BITS = 1024
SKETCH = [f"sketch{i}" for i in range(SKETCH_BITS // 64)]
#: Pivots of a group grow by this factor a round.
MORE_PIVOTS = 8


@lru_cache(maxsize=8)
def bands(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest set size of each band, the segments of its scheme, and how many of them are spare.

    Sets of band j are compared in scheme j with those of bands j and j + 1.
    """
    low = [1]
    while low[-1] <= largest:
        low.append(low[-1] * 100 // percent + 1)
    low = np.array(low, dtype=np.int64)
    most = np.append(low[1:] - 1, low[-1] * 100 // percent)
    need = (most + most * 100 // percent) * (100 - percent) // (100 + percent) + 1
    spare = np.zeros_like(need)
    for _ in range(12):  # the more segments, the more of them are empty
        empty = (need + spare) * np.exp(-low / (need + spare))
        spare = np.where(need > 1, np.ceil(empty + 2 * np.sqrt(empty)), 0).astype(np.int64)
    spare = np.where(spare <= need / 2, spare, 0)  # else there is no end to it: small sets go without
    return low, need + spare, spare


def ngram_sets(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, flat, and where each text's begin.

    A text of fewer words is one n-gram, its whole word sequence; one without words has none.
    """
    words = split_words(texts)
    h = hash_words(texts, words)
    count = np.diff(words.first)
    grams = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    starts = np.concatenate([[0], np.cumsum(grams)])
    text = np.repeat(np.arange(len(texts)), grams)
    at = words.first[text] + np.arange(len(text)) - starts[text]
    out = np.full(len(text), np.uint64(n), dtype=np.uint64)
    for k in range(n):
        there = k < count[text]
        step = mix(out + h[np.minimum(at + k, max(len(h) - 1, 0))]) if len(h) else out
        out = np.where(there, step, out)
    out = mix(out + np.minimum(count[text], n).astype(np.uint64))
    order = np.lexsort((out, text))
    out, text = out[order], text[order]
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    out, text = out[keep], text[keep]
    return out, np.searchsorted(text, np.arange(len(texts) + 1))


def _sums(values: np.ndarray, slot: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of the low and high halves of ``values`` by slot."""
    low = np.bincount(slot, weights=(values & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
    high = np.bincount(slot, weights=(values >> np.uint64(32)).astype(np.float64), minlength=n)
    return low.astype(np.uint64), high.astype(np.uint64)


def class_ids(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set: equal sets have equal ids. Empty sets have id 0."""
    sizes = np.diff(starts)
    low, high = _sums(mix(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5)), np.repeat(np.arange(len(sizes)), sizes), len(sizes))
    ids = mix(low + mix(high + sizes.astype(np.uint64)))
    return np.where(sizes > 0, ids, 0).astype(np.uint64).view(np.int64)


def sketches(grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of words for each set: whether the number of its n-grams in each bucket is odd."""
    words = np.zeros((len(starts) - 1, len(SKETCH)), dtype=np.uint64)
    bucket = mix(grams ^ np.uint64(0x3C6EF372FE94F82B)) % np.uint64(SKETCH_BITS)
    of = np.repeat(np.arange(len(words)), np.diff(starts)) * len(SKETCH)
    np.bitwise_xor.at(words.reshape(-1), of + (bucket >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bucket & np.uint64(63)))
    return words.view(np.int64)


def _keys(scheme: np.ndarray, segment: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    place = mix((scheme.astype(np.uint64) << np.uint64(40)) + segment.astype(np.uint64))
    return mix(mix(low + place) + high).view(np.int64)


def signatures(
    grams: np.ndarray, starts: np.ndarray, percent: int, changed: dict[int, dict[int, int]] | None = None,
) -> dict[str, np.ndarray]:
    """Signature rows of each set in the scheme of its own band and, as the larger, of the band below.

    ``changed``: scheme -> segment -> allocation of the segments that are not at 1.
    """
    sizes = np.diff(starts)
    low_size, segments, spare = bands(percent, 1 << max(int(sizes.max(initial=1)).bit_length(), 4))
    own = np.searchsorted(low_size, sizes, side="right") - 1
    rows = []
    for larger in (False, True):
        sets = np.flatnonzero((sizes > 0) & (own >= larger))
        scheme = own[sets] - larger
        m = segments[scheme]
        base = np.cumsum(m) - m
        length = sizes[sets]
        which = np.repeat(np.arange(len(sets)), length)
        at = np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length) + starts[sets][which]
        gram = grams[at]
        dealt = mix(gram + np.uint64(0x5851F42D4C957F2D) * (scheme[which].astype(np.uint64) + np.uint64(1)))
        segment = (dealt >> np.uint64(11)) % m[which].astype(np.uint64)
        slot = base[which] + segment.astype(np.int64)
        value = mix(gram ^ np.uint64(0x632BE59BD9B4E019))
        total = int(m.sum())
        low, high = _sums(value, slot, total)
        of = np.repeat(np.arange(len(sets)), m)
        part = np.arange(total) - base[of]
        use = np.ones(total, dtype=np.int64)
        for j, parts in (changed or {}).items():
            inside = scheme[of] == j
            for i, a in parts.items():
                use[inside & (part == i)] = a
        void = np.bincount(slot, minlength=total) == 0
        enough = np.add.reduceat(void, base) <= spare[scheme] if len(sets) else np.zeros(0, bool)
        for j in changed or {}:  # an empty segment may stand beside one of a single n-gram there
            enough[scheme == j] = False
        keep = (use > 0) & ~(void & enough[of])
        rows.append((_keys(scheme[of], part, low, high)[keep], sets[of][keep], np.zeros(int(keep.sum()), bool),
                     scheme[of][keep], part[keep], np.full(int(keep.sum()), larger)))
        twice = use[slot] == 2
        if twice.any():
            s, w = slot[twice], which[twice]
            v = value[twice]
            less = _keys(scheme[w], part[s], low[s] - (v & np.uint64(0xFFFFFFFF)), high[s] - (v >> np.uint64(32)))
            rows.append((less, sets[w], np.ones(len(w), bool), scheme[w], part[s], np.full(len(w), larger)))
    names = ("group", "set", "deleted", "scheme", "segment", "larger")
    return {n: np.concatenate([r[k] for r in rows]) for k, n in enumerate(names)}


def sizes_and_classes(docs: DataFrame, n: int) -> DataFrame:
    """key, n_shingles, class of every row of ``docs`` (key, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                grams, starts = ngram_sets(texts, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(np.diff(starts)),
                     pa.array(class_ids(grams, starts))], ["key", "n_shingles", "class"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"key {kind}, n_shingles bigint, class bigint")


def _signature_rows(
    docs: DataFrame, n: int, percent: int, changed: dict | None, part: int | None = None, parts: int = PARTS,
) -> DataFrame:
    """Signature rows of each different set of a task: group, class, size, larger, deleted, scheme, segment.

    ``part``: only groups of this one of ``parts``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                grams, starts = ngram_sets(texts, n)
                ids = class_ids(grams, starts)
                new = []
                for i, c in enumerate(ids.tolist()):
                    if c not in seen:
                        seen.add(c)
                        new.append(i)
                sizes = np.diff(starts)[new]
                at = np.repeat(starts[:-1][new] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
                rows = signatures(grams[at], np.concatenate([[0], np.cumsum(sizes)]), percent, changed)
                if changed is not None:  # all other schemes stay as they are
                    again = np.isin(rows["scheme"], list(changed))
                    rows = {k: v[again] for k, v in rows.items()}
                if part is not None:
                    inside = rows["group"] % parts == part
                    rows = {k: v[inside] for k, v in rows.items()}
                of = rows["set"]
                yield pa.RecordBatch.from_arrays([
                    pa.array(rows["group"]), pa.array(ids[new][of]), pa.array(sizes[of].astype(np.int32)),
                    pa.array(rows["larger"]), pa.array(rows["deleted"]), pa.array(rows["scheme"].astype(np.int32)),
                    pa.array(rows["segment"].astype(np.int32))],
                    ["group", "class", "size", "larger", "deleted", "scheme", "segment"])

    return docs.select("text").mapInArrow(
        run, "group bigint, class bigint, size int, larger boolean, deleted boolean, scheme int, segment int")


def _shared(rows: DataFrame) -> DataFrame:
    """Signature rows whose group holds two classes, one of them of the scheme's own band."""
    dealt = rows.repartition("group").dropDuplicates(["group", "class", "deleted"])
    w = Window.partitionBy("group")
    return (
        dealt.withColumn("_least", F.min("class").over(w)).withColumn("_most", F.max("class").over(w))
        .withColumn("_own", F.min("larger").over(w)).withColumn("_exact", F.min("deleted").over(w))
        .where("_least <> _most AND NOT _own AND NOT _exact").drop("_least", "_most", "_own", "_exact")
    )


def allocation(shared: DataFrame, percent: int) -> dict[int, dict[int, int]]:
    """Segments whose allocation changes, by scheme, from the measured work of all at 1.

    The work of a segment is the rows of its shared groups times their size. Only segments
    that stand out in their scheme are looked at, one row each.
    """
    per_group = shared.groupBy("scheme", "segment", "group").agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.avg("size").alias("_size"))
    work = per_group.groupBy("scheme", "segment").agg(
        F.sum(F.col("_n") * F.col("_n")).alias("work"), F.sum(F.col("_n")).alias("rows"), F.avg("_size").alias("size"))
    w = Window.partitionBy("scheme")
    table = materialise(work.withColumn("usual", F.percentile_approx("work", 0.5).over(w)).where(
        "work > 1000 + 8 * usual"), "work")
    out: dict[int, dict[int, int]] = {}
    for row in table.orderBy("scheme", F.desc("work")).toLocalIterator():
        _, segments, _ = bands(percent, 1 << max(int(row.size).bit_length() + 1, 4))
        m = int(segments[row.scheme]) if row.scheme < len(segments) else 0
        parts = out.setdefault(row.scheme, {})
        if row.segment in parts:  # raised for another one
            continue
        extra = row.usual * 2 + row.rows * (1 + row.size / max(m, 1))
        cheap = next((i for i in range(m) if i not in parts and i != row.segment), None)
        if cheap is not None and row.work > extra and 2 * (len(parts) + 2) <= m:
            parts[row.segment], parts[cheap] = 0, 2
    discard(table)
    return {j: parts for j, parts in out.items() if parts}


def _parts_of(rows: DataFrame, percent: int, changed: dict[int, dict[int, int]]) -> int:
    """Parts for the signatures of the schemes ``changed``, by the share of n-grams dealt in them.

    Twice as many as the share alone would need: empty segments and sets less one n-gram have signatures there too.
    """
    size = F.col("n_shingles")
    low = [int(x) for x in bands(percent, 1 << 40)[0]] + [1 << 62] * 2
    dealt = reduce(add, [F.when((size >= low[j]) & (size < low[j + 2]), size).otherwise(0) for j in changed])
    there, whole = rows.agg(F.sum(dealt).alias("there"), F.sum(size).alias("whole")).first()
    return max(1, math.ceil(PARTS * there / max(whole, 1)))


def _sets(docs: DataFrame, wanted: DataFrame, n: int, what: str) -> DataFrame:
    """class and its n-grams (``what``: "grams") or its sketch ("sketch") for the classes of ``wanted`` (key, class)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                grams, starts = ngram_sets(texts, n)
                if what == "sketch":
                    columns = [pa.array(word) for word in sketches(grams, starts).T]
                else:
                    columns = [pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(grams.view(np.int64)))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(class_ids(grams, starts)), *columns], ["class", *(SKETCH if what == "sketch" else ["grams"])])

    few = wanted.count() <= BROADCAST_IDS
    # by hash, which is one number and never null: a table of those is less than half as large; classes are compared below
    keys = wanted.select(F.xxhash64("key").alias("_wanted"))
    rows = docs.join(F.broadcast(keys) if few else keys, F.xxhash64("key") == F.col("_wanted"), "left_semi").select("text")
    found = rows.mapInArrow(run, "class bigint" + (
        "".join(f", {c} bigint" for c in SKETCH) if what == "sketch" else ", grams array<bigint>"))
    classes = wanted.select("class")
    found = found.join(F.broadcast(classes) if few else classes, "class", "left_semi")
    return found.repartition("class").dropDuplicates(["class"])


def _side_by_side(docs: DataFrame, wanted: DataFrame, pairs: DataFrame, n: int, most: float,
                  select: Callable[[DataFrame], DataFrame], label: str) -> list[DataFrame]:
    """``select`` of ``pairs`` (a, b: classes of ``wanted``) with grams_a and grams_b, written.

    Pairs are dealt to passes, so that those of a pass have about ``most`` n-grams. A table a pass.
    """
    def classes_of(pairs: DataFrame) -> DataFrame:
        both = pairs.select(F.explode(F.array("a", "b")).alias("class"))
        return materialise(both.groupBy("class").agg(F.count(F.lit(1)).alias("_pairs")).join(wanted, "class"), "wanted")

    classes = classes_of(pairs)
    grams = classes.agg(F.sum(F.col("_pairs") * F.col("n_shingles"))).first()[0] or 0
    passes = max(1, math.ceil(grams / max(most, 1)))
    out = []
    for k in range(passes):
        some = pairs if passes == 1 else pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(passes)) == k)
        if passes > 1:
            discard(classes)
            classes = classes_of(some)
        sets = _sets(docs, classes, n, "grams")
        grams_a = sets.select(F.col("class").alias("a"), F.col("grams").alias("grams_a"))
        grams_b = sets.select(F.col("class").alias("b"), F.col("grams").alias("grams_b"))
        out.append(materialise(select(some.join(grams_a, "a").join(grams_b, "b")), label))
        release_shuffles(docs.sparkSession)
    discard(classes)
    return out


def similar(docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """Per row of ``docs``: key, n_shingles (distinct word n-grams), component_id.

    Two rows link when 100 * common n-grams >= percent * all n-grams of both;
    component_id is the least key that links lead to, itself included. Words are split at
    ASCII blanks with A-Z lower-cased; fewer than ``n`` words are one n-gram. Null texts
    and texts without words have no n-grams and link with nothing. Equal rows link. A null
    key counts as the largest. An empty table gives an empty one. Sets are told apart by
    64-bit hashes of their n-grams and of the whole.
    """
    bound_batches(docs.sparkSession)
    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = materialise(sizes_and_classes(plain, n), "sets")
    parts = []
    for part in range(PARTS):
        parts.append(materialise(_shared(_signature_rows(plain, n, percent, None, part)), "shared"))
        release_shuffles(docs.sparkSession)
    shared = reduce(DataFrame.unionByName, parts)
    if changed := allocation(shared, percent):
        kept = materialise(shared.where(~F.col("scheme").isin(list(changed))), "shared")
        discard(*parts)
        pieces = _parts_of(rows, percent, changed)
        parts = [kept]
        for part in range(pieces):
            anew = _shared(_signature_rows(plain, n, percent, changed, part, pieces))
            parts.append(materialise(anew.select(*kept.columns), "shared"))
            release_shuffles(docs.sparkSession)
        shared = reduce(DataFrame.unionByName, parts)
    roots = _components(plain, rows, shared, n, percent)
    discard(*parts)
    return _labelled(rows, roots).withColumnRenamed("key", key)


def deduplicated(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90,
) -> DataFrame:
    """One document of each group of ``similar``, with its columns: the one of the least key.

    Rows that are equal in key and text count as one. Documents without words stay.
    """
    labels = similar(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), key="key", text="text",
                     n=n, percent=percent)
    marked = materialise(labels.groupBy(F.col("key").alias("_key")).agg(
        F.max(F.col("key").eqNullSafe(F.col("component_id"))).alias("_stays"), F.count(F.lit(1)).alias("_n")).where(
        "NOT _stays OR _n > 1"), "marked")
    plain = docs.select(F.struct(*docs.columns).alias("kept"), F.col(key).alias("key"), F.col(text).alias("text"))

    def of(keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select("_key")
        few = keys.count() <= BROADCAST_IDS
        return plain.join(F.broadcast(keys) if few else keys, F.col("key").eqNullSafe(F.col("_key")), how)

    first = F.row_number().over(Window.partitionBy("key", F.xxhash64("text")).orderBy(F.lit(0)))
    again = of(marked.where("_stays"), "left_semi").withColumn("_nth", first).where("_nth = 1")
    return of(marked, "left_anti").select("kept.*").unionByName(again.select("kept.*"))


def _pivot_order(grams: str, pivot: str, percent: int) -> Column:
    """First n-grams of a set when those that its pivot lacks come first, each part by hash.

    Similar sets share one of their first |x| - ceil(percent * |x|) + 1 under any order.
    """
    ordered = F.concat(F.array_except(grams, pivot), F.array_intersect(grams, pivot))
    n = F.size(grams)
    return F.slice(ordered, 1, (n - F.ceil(n * percent / 100) + 1).cast("int"))


def _components(plain: DataFrame, rows: DataFrame, shared: DataFrame, n: int, percent: int) -> DataFrame:
    """Component of each class that links with another: node, root.

    Pairs of a pivot and the others come first. Groups of at most SMALL_GROUP members then
    go on with more pivots, so that a member is compared with fewer than SMALL_GROUP sketches a group. Members of larger groups are dealt anew, by their pivot and each
    of their first n-grams in the pivot's order: copies with many edits of their own start
    with n-grams that nothing else has, so only likely pairs meet again.
    """
    weight = shared.groupBy("class").agg(F.count(F.lit(1)).alias("_weight"))
    w = Window.partitionBy("group")
    in_order = w.orderBy(F.desc("_weight"), "class", "deleted")
    members = materialise(
        shared.join(weight, "class").withColumn("rank", F.row_number().over(in_order) - 1)
        .withColumn("members", F.count(F.lit(1)).over(w)).withColumn("pivot", F.first("class").over(in_order))
        .withColumn("place", F.lit(None).cast("int"))
        .select("group", "class", "size", "larger", "deleted", "rank", "place", "_weight", "members", "pivot"), "members")
    wanted = members.select("class").distinct().join(rows, "class").groupBy("class").agg(
        F.min("key").alias("key"), F.max("n_shingles").alias("n_shingles"))
    wanted = materialise(wanted, "wanted")
    most = PASS_SHARE * (rows.agg(F.sum("n_shingles")).first()[0] or 0)
    sets = materialise(_sets(plain, wanted, n, "sketch"), "sketches")
    release_shuffles(plain.sparkSession)
    fits = 100 * F.least("size", "size_a") >= percent * F.greatest("size", "size_a")
    allowed = fits & ~(F.col("larger") & F.col("larger_a")) & ~(F.col("deleted") & F.col("deleted_a"))
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    linked = 100 * both >= percent * (F.size("grams_a") + F.size("grams_b") - both)
    differ = reduce(add, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_a"))) for c in SKETCH])
    close = (100 + percent) * differ <= (100 - percent) * (F.col("size") + F.col("size_a"))

    heads = members.where("rank = 0").select("group", F.col("size").alias("size_a"), F.col("larger").alias("larger_a"),
                                             F.col("deleted").alias("deleted_a"))
    stars = members.where("class <> pivot").join(heads, "group").groupBy(
        F.col("pivot").alias("a"), F.col("class").alias("b")).agg(
        F.max(allowed).alias("allowed"), F.max(F.col("members") > SMALL_GROUP).alias("large"), F.first("size").alias("size"),
        F.first("size_a").alias("size_a"), F.first("_weight").alias("_weight"))
    sketch_a = sets.select(F.col("class").alias("a"), *[F.col(c).alias(f"{c}_a") for c in SKETCH])
    stars = stars.where("allowed OR large").join(sketch_a, "a").join(sets.select(F.col("class").alias("b"), *SKETCH), "b").where(
        F.col("large") | close).select("a", "b", "large", "size", "_weight")
    stars = materialise(stars, "pairs")
    passes = _side_by_side(plain, wanted, stars, n, most, lambda pairs: pairs.select(
        "a", "b", linked.alias("linked"), "size", "_weight",
        F.when(F.col("large"), _pivot_order("grams_b", "grams_a", percent)).alias("firsts")), "stars")
    discard(stars)
    checked = reduce(DataFrame.unionByName, passes)
    links = checked.where("linked").select("a", "b")
    found = []

    def components() -> DataFrame:
        labels = contract(links)
        out = materialise(labels, "components")
        discard(labels)
        return out

    roots = components()
    again = checked.where("firsts IS NOT NULL").select(
        "a", F.col("b").alias("class"), "size", "_weight", F.posexplode("firsts").alias("place", "gram"))
    dealt = Window.partitionBy("group").orderBy(F.desc("_weight"), "class")
    again = again.withColumn("group", F.xxhash64("a", "gram")).select(
        "group", "class", "size", F.lit(False).alias("larger"), F.lit(False).alias("deleted"),
        F.row_number().over(dealt).alias("rank"), "place")
    small = members.where(F.col("members") <= SMALL_GROUP).select(again.columns)
    first_members, members, first, last = members, small.unionByName(again), 1, 1 + MORE_PIVOTS
    while True:
        placed = members.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn(
            "root", F.coalesce("root", "class"))
        # groups with a pivot left, and with two components among what is left and the pivots to come
        left = placed.where(F.col("rank") >= first).withColumn("_a", F.min("root").over(w)).withColumn(
            "_b", F.max("root").over(w)).where("_a <> _b").drop("_a", "_b")
        if not set(SKETCH) <= set(left.columns):
            left = left.join(sets.select("class", *SKETCH), "class")
        after = materialise(left, "members")
        discard(first_members)
        members = first_members = after
        if members.isEmpty():
            discard(members, sets, wanted, *passes, *found)
            return roots
        pivots = members.where(F.col("rank") < last).select(
            "group", F.col("class").alias("a"), *[F.col(c).alias(f"{c}_a") for c in (
                "size", "larger", "deleted", "rank", "place", "root", *SKETCH)])
        # with both at their places in the pivot's order, no more than this many n-grams can be common
        common = F.least(F.col("size") - F.col("place"), F.col("size_a") - F.col("place_a"))
        enough = F.col("place").isNull() | ((100 + percent) * common >= percent * (F.col("size") + F.col("size_a")))
        pairs = materialise(members.join(pivots, "group").where(
            (F.col("rank") > F.col("rank_a")) & (F.col("root") != F.col("root_a")) & allowed & enough & close
        ).select(F.least("a", "class").alias("a"), F.greatest("a", "class").alias("b")).distinct(), "pairs")
        members = members.drop("root")
        if not pairs.isEmpty():
            new = _side_by_side(plain, wanted, pairs, n, most, lambda pairs: pairs.where(linked).select("a", "b"), "links")
            found += new
            more = reduce(DataFrame.unionByName, new)
            if not more.isEmpty():
                links = links.unionByName(more)
                before, roots = roots, components()
                discard(before)
        discard(pairs)
        first, last = last, last + (last - first) * MORE_PIVOTS


def _labelled(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The least key of each component beside every row."""
    small = roots.select(F.col("node").alias("class"), "root")
    placed = materialise(rows.join(small, "class", "left").select(
        "key", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("root", "class")).alias("root")), "placed")
    discard(rows, roots)
    least = placed.where("root IS NOT NULL").groupBy("root").agg(
        F.min("key").alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return placed.join(least, "root", "left").select(
        "key", "n_shingles", F.coalesce("_least", "key").alias("component_id"))
