"""Removal of long repeated word spans by De Bruijn compaction.

The graph's edges are token k-mers, here all windows of ``window`` words; two that follow
each other in a text meet in a node. A word goes when an edge over it occurs again.

Edges leave a text in pieces, not one by one: consecutive windows whose least word n-gram
is the same one form a piece, a path of up to ``window - gram + 1`` edges. Equal windows
have equal least n-grams, so an edge can only occur again among pieces of its n-gram, and
of the pieces inside a repeated span all are equal but the first and the last.

1. Pieces whose n-gram occurs once go (a count and a semi-join).
2. Equal pieces are repeated paths. A piece with one successor and one predecessor
   everywhere is joined with them; each document is then cut into maximal nonbranching
   paths. An occurrence of such a path is one row, however long the span is.
3. Where pieces of one n-gram differ, one of each kind is split into its single edges.
4. Source coordinates verify both: the words of each path's occurrences, and of each single
   edge, are read from the texts again and told apart by a digest of the words themselves.
   What occurs twice by this digest is removed.

Texts are known by 128 bits of hashes, so copies share the work: a third of all rows being
one text costs its pieces once a task. No group is collected but the pieces of one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from breezeway.llm.textarrays import Texts, Words, chunks, hash_words, mix, power, split_words
from breezeway.session import discard, materialise

#: Words of the n-grams that pieces are dealt by.
GRAM = 8
#: Ids of texts are broadcast to filter the documents up to this many (16 bytes each).
BROADCAST_IDS = 1_000_000
_ID = ["ta", "tb"]
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` words from each place on; the last ones run over the end and mean nothing."""
    out = np.zeros(len(h), dtype=np.uint64)
    for k in range(n):
        out *= _STEP
        out[:max(len(h) - k, 0)] += h[k:]
    return mix(out)


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Place of the leftmost least of the ``n`` values from each place on."""
    best, at, size = values, np.arange(len(values)), 1

    def merged(by: int) -> tuple[np.ndarray, np.ndarray]:
        there = max(len(best) - by, 0)
        later = best[by:] < best[:there]
        return (np.concatenate([np.where(later, best[by:], best[:there]), best[there:]]),
                np.concatenate([np.where(later, at[by:], at[:there]), at[there:]]))

    while size < n:
        step = min(size, n - size)
        best, at = merged(step)
        size += step
    return at


def pieces(texts: Texts, words: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """text, start, edges, n-gram and content hash of each piece; starts are words of the text."""
    h = hash_words(texts, words)
    count = np.diff(words.first)
    edges = np.maximum(count - window + 1, 0)
    text = np.repeat(np.arange(len(texts)), edges)
    begin = np.cumsum(edges) - edges
    start = np.arange(len(text)) - begin[text] + words.first[:-1][text]
    grams = _ngrams(h, gram)
    least = _least(grams, window - gram + 1)[start]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(text)))
    text, start, least = text[first], start[first], least[first]
    total = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * power("up", len(h)), out=total[1:])
    end = start + n + window - 1
    content = mix((total[end] - total[start]) * power("down", len(h) + 1)[start] + n.astype(np.uint64))
    return text, start - words.first[:-1][text], n, grams[least].view(np.int64), content.view(np.int64)


def joined(texts: Texts, words: Words, keep: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Kept words with one space between those of a text; where each text's bytes end, and where each word begins."""
    data, inside = texts.data.copy(), np.zeros(len(texts.data) + 1, dtype=np.int8)
    inside[words.begin[keep]] = 1
    inside[words.end[keep]] -= 1  # 1 - 1 where the next text's first word begins
    there = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    kept = np.flatnonzero(keep)
    between = words.end[kept[:-1][words.text[kept[1:]] == words.text[kept[:-1]]]]
    data[between] = 32
    there[between] = True
    place = np.concatenate([[0], np.cumsum(there)])
    return data[there].tobytes(), place[texts.starts], place[words.begin]


def _ids(docs: DataFrame) -> DataFrame:
    """``docs`` (text and others) with the 128 bits that a text is known by."""
    return docs.select(F.xxhash64("text").alias("ta"), F.xxhash64(F.lit(7), "text").alias("tb"), "*")


def _scan(docs: DataFrame, window: int, gram: int, with_text: bool) -> DataFrame:
    """Rows of two kinds: each piece of a text (ta, tb, start, n, gram, content), and each document
    (ta, tb, key, n_words, and its whole words as ``sha`` and, on request, ``kept``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(3), raw=True):
                words = split_words(texts)
                text, start, n, g, c = pieces(texts, words, window, gram)
                rows, at = len(text), pa.array(text + first)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(at), batch.column(1).take(at), pa.array(start.astype(np.int32)),
                    pa.array(n.astype(np.int32)), pa.array(g), pa.array(c), pa.nulls(rows, batch.column(2).type),
                    pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.string()), pa.nulls(rows, pa.string())], names)
                whole, ends, _ = joined(texts, words, np.ones(len(words), dtype=bool))
                parts = [whole[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                some, none = slice(first, first + len(texts)), lambda kind: pa.nulls(len(texts), kind)
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(i)[some] for i in (0, 1)], none(pa.int32()), none(pa.int32()), none(pa.int64()),
                    none(pa.int64()), batch.column(2)[some], pa.array(np.diff(words.first).astype(np.int64)),
                    pa.array([hashlib.sha256(p).hexdigest() for p in parts]),
                    pa.array([p.decode() for p in parts]) if with_text else none(pa.string())], names)

    names = ["ta", "tb", "start", "n", "gram", "content", "key", "n_words", "sha", "kept"]
    kind = docs.schema["key"].dataType.simpleString()
    return _ids(docs).select("ta", "tb", "key", "text").mapInArrow(
        run, f"ta bigint, tb bigint, start int, n int, gram bigint, content bigint, key {kind}, "
             "n_words bigint, sha string, kept string")


def _paths(found: DataFrame, contents: DataFrame) -> DataFrame:
    """Occurrences of maximal nonbranching paths of repeated pieces: ta, tb, start, n (edges), copies, path.

    ``found``: pieces of repeated n-grams, a row for each document; ``contents``: gram,
    content and how often each occurs.
    """
    repeated = contents.where("occurs > 1").select("gram", "content")
    once = found.groupBy(*_ID, "start", "n", "gram", "content").agg(F.count(F.lit(1)).alias("copies"))
    by_text = Window.partitionBy(*_ID).orderBy("start")
    edge = F.xxhash64("gram", "content")
    placed = once.join(repeated, ["gram", "content"]).select(*_ID, "start", "n", "copies", edge.alias("piece"))
    # the neighbours in the text; 0 stands for none
    after = F.when(F.lead("start").over(by_text) == F.col("start") + F.col("n"), F.lead("piece").over(by_text))
    before = F.when((F.lag("start").over(by_text) + F.lag("n").over(by_text)) == F.col("start"), F.lag("piece").over(by_text))
    placed = materialise(placed.select("*", F.coalesce(after, F.lit(0)).alias("after"),
                                       F.coalesce(before, F.lit(0)).alias("before")), "repeats-pieces")
    only = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).alias(c)
    ends = materialise(placed.groupBy("piece").agg(only("after"), only("before")), "repeats-ends")
    left = ends.select(F.col("piece").alias("before"), F.col("after").alias("piece")).where("piece IS NOT NULL AND piece <> 0")
    inner = ends.where("before <> 0").select("piece", "before").join(left, ["piece", "before"], "left_semi").select("piece")
    marked = placed.join(inner.withColumn("inner", F.lit(True)), "piece", "left")
    number = F.sum(F.when(F.col("inner"), 0).otherwise(1)).over(by_text)
    out = materialise(marked.withColumn("_path", number).groupBy(*_ID, "_path").agg(
        F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), F.max("copies").alias("copies"),
        F.min_by("piece", "start").alias("path")).drop("_path"), "repeats-paths")
    discard(placed, ends)
    return out


def _once(rows: DataFrame) -> DataFrame:
    """Texts (ta, tb, text), equal ones once in each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            new = []
            for i, t in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if t not in seen:
                    seen.add(t)
                    new.append(i)
            yield batch.take(pa.array(new, pa.int64()))

    return rows.mapInArrow(run, "ta bigint, tb bigint, text string")


def _read(docs: DataFrame, wanted: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work`` on the texts that ``wanted`` (ta, tb, asked: array) names: batches of ta, tb, text, asked.

    A text may come up more than once, in different tasks.
    """
    ids = wanted.select(*_ID)
    few = wanted.count() <= BROADCAST_IDS
    texts = _once(_ids(docs.select("text")).join(F.broadcast(ids) if few else ids, _ID, "left_semi"))
    both = texts.join(wanted.hint("shuffle_hash"), _ID).select(*_ID, "text", "asked")
    return both.mapInArrow(work, schema)


def _asked(column: pa.ListArray, first: int, n: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Text number and fields of the structs in the lists of ``n`` rows from ``first`` on."""
    part = column.slice(first, n)
    flat = part.flatten()
    fields = {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}
    return np.repeat(np.arange(n), part.value_lengths().to_numpy(zero_copy_only=False)), fields


def _digests(window: int) -> Callable:
    """Digest of the words of each path (``path`` not null), and of each single edge of the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(2), raw=True):
                words = split_words(texts)
                whole, ends, begin = joined(texts, words, np.ones(len(words), dtype=bool))
                text, asked = _asked(batch.column(3), first, len(texts))
                single = np.isnan(asked["path"].astype(np.float64))
                rows = np.repeat(np.arange(len(text)), np.where(single, asked["n"], 1))
                nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
                start = asked["start"][rows] + nth
                n = np.where(single[rows], 1, asked["n"][rows])
                a = words.first[text[rows]] + start
                b = a + n + window - 1
                # up to the space before the next word, or to the end of the text
                last = b == words.first[text[rows] + 1]
                stop = np.where(last, ends[text[rows] + 1], np.append(begin, 0)[np.minimum(b, len(begin))] - 1)
                found = [hashlib.blake2b(whole[i:j], digest_size=16).digest() for i, j in zip(begin[a].tolist(), stop.tolist())]
                at, which = pa.array(text[rows] + first), pa.array(rows)
                path = batch.column(3).slice(first, len(texts)).flatten().field(2).take(which)
                copies = batch.column(3).slice(first, len(texts)).flatten().field(3).take(which)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(at), batch.column(1).take(at), pa.array(start.astype(np.int32)),
                    pa.array(n.astype(np.int32)), path, copies, pa.array(found, pa.binary())],
                    ["ta", "tb", "start", "n", "path", "copies", "digest"])

    return run


def _cut(window: int, with_text: bool) -> Callable:
    """Removed words, and the digest (and text) of the kept ones, of texts with the spans to go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in chunks(batch.column(2), raw=True):
                words = split_words(texts)
                text, asked = _asked(batch.column(3), first, len(texts))
                a = words.first[text] + asked["start"]
                change = np.bincount(a, minlength=len(words) + 1) - np.bincount(
                    a + asked["n"] + window - 1, minlength=len(words) + 1)
                keep = np.cumsum(change)[:-1] == 0
                whole, ends, _ = joined(texts, words, keep)
                parts = [whole[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
                gone = np.bincount(words.text[~keep], minlength=len(texts)).astype(np.int64)
                some = slice(first, first + len(texts))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[some], batch.column(1)[some], pa.array(gone),
                    pa.array([hashlib.sha256(p).hexdigest() for p in parts]),
                    pa.array([p.decode() for p in parts]) if with_text else pa.nulls(len(texts), pa.string())],
                    ["ta", "tb", "n_removed", "cut_sha", "cut"])

    return run


def _repeated(docs: DataFrame, scanned: DataFrame, window: int) -> DataFrame:
    """Spans of texts to remove: ta, tb, start, n (edges); verified, may overlap."""
    found_in = scanned.where("start IS NOT NULL").select(*_ID, "start", "n", "gram", "content")
    # written first, so that the join's sides are plain shuffles, of which a hot n-gram's can be split
    again = materialise(found_in.groupBy("gram").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("gram"), "repeats-grams")
    found = materialise(found_in.join(again, "gram", "left_semi"), "repeats-found")
    discard(again)
    contents = materialise(found.groupBy("gram", "content").agg(
        F.count(F.lit(1)).alias("occurs"), F.min(F.struct(*_ID, "start", "n")).alias("at")), "repeats-contents")
    paths = _paths(found, contents)
    mixed = contents.groupBy("gram").agg(F.count(F.lit(1)).alias("_kinds")).where("_kinds > 1").select("gram")
    singles = contents.join(mixed, "gram", "left_semi").select("at.*", F.col("occurs").alias("copies"))
    asked = F.struct("start", "n", "path", "copies")
    wanted = materialise(
        paths.select(*_ID, asked.alias("_a")).unionByName(
            singles.withColumn("path", F.lit(None).cast("bigint")).select(*_ID, asked.alias("_a")))
        .groupBy(*_ID).agg(F.collect_list("_a").alias("asked")), "repeats-wanted")
    read = _read(docs, wanted, _digests(window), "ta bigint, tb bigint, start int, n int, path bigint, copies bigint, digest binary")
    # a text may have been read twice, so places count, not rows
    seen = materialise(read.withColumn("place", F.xxhash64(*_ID, "start")), "repeats-digests")
    elsewhere = F.min("place") != F.max("place")
    of_paths = seen.where("path IS NOT NULL")
    true_paths = materialise(of_paths.groupBy("path", "digest").agg((elsewhere | (F.max("copies") > 1)).alias("_again")).where(
        "_again").select("path", "digest"), "repeats-true")
    edges = seen.where("path IS NULL")
    true_edges = materialise(edges.groupBy("digest").agg(elsewhere.alias("_again")).where("_again").select("digest"), "repeats-true")
    out = materialise(
        of_paths.join(true_paths, ["path", "digest"], "left_semi").select(*_ID, "start", "n").unionByName(
            edges.where("copies = 1").join(true_edges, "digest", "left_semi").select(*_ID, "start", "n")), "repeats-spans")
    discard(found, contents, paths, wanted, seen, true_paths, true_edges)
    return out


def without_repeats(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 35, gram: int = GRAM, with_text: bool = False,
) -> DataFrame:
    """Per row of ``docs``: key, n_words, n_removed, kept_sha256 and, with ``with_text``, ``kept``.

    A word is removed when a window of ``window`` consecutive words of its text covers it
    whose word sequence starts anywhere else too, in another row or the same; windows are
    those of the input. Words are unchanged runs of anything but ASCII blanks; ``kept`` joins
    the others by one space, ``kept_sha256`` is its digest. A null or empty text has no
    words, one of fewer than ``window`` words keeps all. Rows of one text, whatever their
    key, all lose it if it has ``window`` words. Null keys stay null. An empty table gives an
    empty one. ``gram`` is at most ``window``.
    """
    plain = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    scanned = materialise(_scan(plain, window, gram, with_text), "repeats-scan")
    spans = _repeated(plain, scanned, window)
    wanted = materialise(spans.groupBy(*_ID).agg(F.collect_list(F.struct("start", "n")).alias("asked")), "repeats-cuts")
    discard(spans)
    cut = _read(plain, wanted, _cut(window, with_text), "ta bigint, tb bigint, n_removed bigint, cut_sha string, cut string")
    cut = materialise(cut.dropDuplicates(_ID), "repeats-cut")
    discard(wanted)
    rows = scanned.where("n_words IS NOT NULL").select(*_ID, "key", "n_words", "sha", "kept").join(cut, _ID, "left")
    out = rows.select(F.col("key").alias(key), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
                      F.coalesce("cut_sha", "sha").alias("kept_sha256"), F.coalesce("cut", "kept").alias("kept"))
    return out if with_text else out.drop("kept")
