"""Ranked lexical search by bag deduplication.

Of a document only its bag counts: the frequencies of the terms that some item holds, and
the whole number m that its length gives. Documents are restricted to the vocabulary of the
items; equal bags, found by hash and verified byte for byte, are one class, which is scored
once. Each task keeps its best classes of each item. Of the classes that win, members are
expanded by ascending key.

The 20 best classes by (score, least key) hold the 20 best documents: a class ahead of
another has a member ahead of all of the other's. So it is enough to expand 20 members of
20 classes an item, however large a class is.

Items are taken in blocks of a bounded number of terms; every block reads all documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breezeway.llm.textarrays import TERM_BYTES, chunks, hash_words, split_words
from breezeway.session import discard, materialise

#: Different (item, term) entries that one pass over the documents serves.
BLOCK_TERMS = 200_000
#: Winning classes are broadcast up to this many.
BROADCAST_CLASSES = 10_000
#: Scores that a task holds at once.
SCORES_AT_ONCE = 1 << 22
_LAST = np.iinfo(np.int64).max


def _item_terms(items: DataFrame) -> DataFrame:
    """item, number, term (hash), times of every different term of every row of ``items`` (item, number, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(2)):
                words = split_words(texts, TERM_BYTES)
                pairs = np.stack([words.text.astype(np.int64), hash_words(texts, words).view(np.int64)])
                pairs, times = np.unique(pairs, axis=1, return_counts=True)
                at = pa.array(pairs[0] + first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(pairs[1]), pa.array(times)],
                    ["item", "number", "term", "times"])

    kind = items.schema["item"].dataType.simpleString()
    return items.mapInArrow(run, f"item {kind}, number bigint, term bigint, times bigint")


def _bags(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """key, n and bag of every document (key, text) with a term.

    A bag is the int32 pairs (place in ``vocabulary``, frequency) of its terms there, ascending.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(vocabulary)
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                words = split_words(texts, TERM_BYTES)
                h = hash_words(texts, words).view(np.int64)
                place = np.minimum(np.searchsorted(vocabulary, h), size - 1)
                known = vocabulary[place] == h
                found, tf = np.unique(words.text[known] * size + place[known], return_counts=True)
                starts = np.searchsorted(found, np.arange(len(texts) + 1) * size)
                pairs = np.stack([found % size, tf], axis=1).astype(np.int32)
                bag = pa.Array.from_buffers(pa.binary(), len(texts), [
                    None, pa.py_buffer((8 * starts).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(pairs))])
                n = np.diff(words.first)
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(n.astype(np.int64)), bag], ["key", "n", "bag"])
                yield out.filter(pa.array(n > 0))

    return docs.mapInArrow(run, "key bigint, n bigint, bag binary")


def _pairs(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and frequency of the pairs of a column of bags."""
    offsets = np.frombuffer(bags.buffers()[1], dtype=np.int32)[bags.offset:bags.offset + len(bags) + 1]
    pairs = np.frombuffer(bags.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]].view(np.int32).reshape(-1, 2)
    return np.repeat(np.arange(len(bags)), np.diff(offsets) // 8), pairs[:, 0], pairs[:, 1].astype(np.int64)


def _frequencies(classes: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of the vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, dtype=np.int64)
        for batch in batches:
            row, term, _ = _pairs(batch.column(0))
            np.add.at(held, term, batch.column(1).to_numpy()[row])
        terms = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(held[terms])], ["term", "held"])

    sums = classes.select("bag", "members").mapInArrow(run, "term bigint, held bigint").groupBy("term").agg(F.sum("held").alias("held"))
    out = np.zeros(size, dtype=np.int64)
    for row in sums.collect():  # a row for each term of the block at most
        out[row.term] = row.held
    return out


def _best(rows: tuple[np.ndarray, ...], top: int) -> tuple[np.ndarray, ...]:
    """The ``top`` rows (item, score, least, id) of each item by score, then by least key."""
    item, score, least, _ = rows
    order = np.lexsort((least, -score, item))
    inside = np.arange(len(order)) - np.searchsorted(item[order], item[order])
    return tuple(r[order[inside < top]] for r in rows)


def _scored(classes: DataFrame, weights: tuple[np.ndarray, ...], numbers: np.ndarray, top: int) -> DataFrame:
    """Each task's best classes of each item: number of the item, score, least, id.

    ``weights``: for each term where its items begin; the items' places in ``numbers``; the
    term's weight times its repeats there. Scores are sums of whole numbers below 2**53,
    which doubles hold exactly.
    """
    shared, n_items = classes.sparkSession.sparkContext.broadcast((*weights, numbers)), len(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, items, weight, numbers = shared.value
        step = max(1, SCORES_AT_ONCE // n_items)
        kept = tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
        bound = np.zeros(n_items)
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                ids, m, least = (part.column(i).to_numpy() for i in (0, 1, 3))
                row, term, tf = _pairs(part.column(2))
                share = (1_000_000_000 * tf) // (1000 * tf + 12 * m[row])
                count = begin[term + 1] - begin[term]
                pair = np.repeat(np.arange(len(term)), count)
                at = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) + begin[term][pair]
                scores = np.bincount(
                    row[pair] * n_items + items[at], weights=(share[pair] * weight[at]).astype(np.float64),
                    minlength=part.num_rows * n_items).reshape(part.num_rows, n_items)
                c, i = np.nonzero((scores > 0) & (scores >= bound))
                new = (i, scores[c, i].astype(np.int64), least[c], ids[c])
                kept = _best(tuple(np.concatenate(both) for both in zip(kept, new)), top)
                full = np.bincount(kept[0], minlength=n_items) >= top
                last = np.zeros(n_items)
                last[kept[0]] = kept[1]  # rows of an item descend, so the last one stays
                bound = np.where(full, last, 0)
        kept = (numbers[kept[0]], *kept[1:])
        yield pa.RecordBatch.from_arrays([pa.array(k) for k in kept], ["number", "score", "least", "id"])

    return classes.select("id", "m", "bag", F.coalesce("least", F.lit(_LAST)).alias("least")).mapInArrow(
        run, "number bigint, score bigint, least bigint, id bigint")


def _first(rows: DataFrame, by: str, order: list[Column], top: int, name: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn(name, nth).where(F.col(name) <= top)


def _block(docs: DataFrame, terms: list, top: int) -> DataFrame:
    """number, rank, key, score for one block of item terms (number, term, times)."""
    number, term, times = (np.array([r[c] for r in terms], dtype=np.int64) for c in ("number", "term", "times"))
    by_term = np.argsort(term, kind="stable")
    vocabulary, begin, term = np.unique(term[by_term], return_index=True, return_inverse=True)
    begin = np.append(begin, len(by_term))
    numbers, items = np.unique(number[by_term], return_inverse=True)
    times = times[by_term]

    bags = materialise(_bags(docs, vocabulary), "search-bags")
    totals = bags.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    length = F.expr(f"cast(75 + (25 * n * {totals.n}L) div {max(totals.terms, 1)}L as bigint)")
    held = bags.where(F.octet_length("bag") > 0).select("key", length.alias("m"), "bag").withColumn("hash", F.xxhash64("m", "bag"))
    classes = materialise(
        held.groupBy("hash", "m", "bag").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("members"))
        .withColumn("id", F.monotonically_increasing_id()), "search-classes")

    df = _frequencies(classes, len(vocabulary))
    weight = np.array([math.floor(1000 * math.log((2 * totals.n + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
    scored = _scored(classes, (begin, items, weight[term] * times), numbers, top)
    best = materialise(
        _first(scored, "number", [F.desc("score"), F.col("least")], top, "nth").select("number", "score", "id"), "search-best")
    winners = materialise(classes.join(best.select("id").distinct(), "id").select("id", "hash", "m", "bag"), "search-winners")
    few = winners.count() <= BROADCAST_CLASSES
    found = held.join(F.broadcast(winners) if few else winners, ["hash", "m", "bag"]).select("id", "key")
    ascending = F.col("key").asc_nulls_last()
    members = _first(found, "id", [ascending], top, "nth").select("id", "key")
    rows = _first(best.join(members, "id"), "number", [F.desc("score"), ascending], top, "rank")
    out = materialise(rows.select("number", "rank", "key", "score"), "search-block")
    discard(bags, classes, best, winners)
    return out


def ranked(
    docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", top: int = 20,
) -> DataFrame:
    """The ``top`` documents of each row of ``items``: item, rank (from 1), key, score.

    Terms are runs of ASCII letters, digits and all other code points from U+0080, with
    only A-Z lower-cased. A term weighs floor(1000 ln((2 N + 2) / (2 df + 1))) and adds it times
    10^9 tf div (1000 tf + 12 m), as often as the item repeats it, where
    m = 75 + 25 n N div L; N, L and df count all documents with a term. Equal scores are by
    ascending ``key``, a whole number; a null one comes last. Repeated documents each have a
    rank; repeated items are ranked each. A null or empty text has no terms: such an item
    has no rows, such a document is not counted. Terms are told apart by 64-bit hashes.
    """
    plain = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    asked = items.select(F.col(item).alias("item"), F.monotonically_increasing_id().alias("number"), F.col(item_text).alias("text"))
    terms = materialise(_item_terms(asked), "search-items")
    n_blocks = -(-terms.count() // BLOCK_TERMS)
    names = terms.select("item", "number").distinct()
    out = []
    for b in range(n_blocks):
        mine = terms.where(F.pmod(F.xxhash64("number"), F.lit(n_blocks)) == b)
        rows = mine.collect()  # a block: about BLOCK_TERMS rows
        if rows:
            out.append(_block(plain, rows, top))
    if not out:
        return plain.join(asked.limit(0), F.lit(False)).select(
            F.col("item").alias(item), F.lit(0).alias("rank"), F.col("key").alias(key), F.lit(0).cast("long").alias("score"))
    rows = out[0]
    for o in out[1:]:
        rows = rows.unionByName(o)
    return rows.join(names, "number").select(F.col("item").alias(item), "rank", F.col("key").alias(key), "score")
