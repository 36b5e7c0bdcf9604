"""Scoring documents with a recurrent language model that is trained on the corpus.

Counts of all training words are summed on Spark. The commonest words become the head of
the model's output; every other word belongs to a tail class by its ending, in which its
probability is its add-one count over that of the class (one count is for all unknown words
of the class). The network learns in rounds: every partition trains its own copy on its
documents of the round, and the copies are averaged by tokens. Each training document is
used in one round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breezeway.llm import gru
from breezeway.llm.textarrays import Texts, Words, chunks, hash_words, mix, split_words
from breezeway.session import materialise

#: The commonest words, whose counts every task holds. Counts of all others are joined.
LEXICON = 1 << 17
#: Counts that come to the driver in one round of finding the lexicon's least count.
HISTOGRAM = 4096
#: Tokens that a task lays on lanes at once.
TASK_TOKENS = 1 << 20
#: Longer documents of a batch are scored together, after the others.
LONG_TOKENS = 2048
#: Share of the training documents in each round, in percent, and its learning rate.
ROUNDS = ((8, 0.01), (25, 0.01), (67, 0.005))


def tail_class(texts: Texts, words: Words) -> np.ndarray:
    """Tail class of each word: a hash of its last two bytes before a final mark, and whether there is one."""
    last = texts.data[words.end - 1]
    mark = np.isin(last, np.frombuffer(b".,!?;:", dtype=np.uint8)) & (words.end - words.begin > 1)
    end = words.end - mark
    one = texts.data[end - 1].astype(np.uint64)
    two = np.where(end - words.begin > 1, texts.data[np.maximum(end - 2, 0)], 0).astype(np.uint64)
    endings = gru.TAIL_CLASSES // 2  # those with a final mark are an output class of their own
    ending = mix(one + (two << np.uint64(8))) % np.uint64(endings)
    return (ending.astype(np.int32) + endings * mark).astype(np.int32)


@dataclass
class Lexicon:
    """Counts of the commonest words, by sorted hash, and the sums over all words."""

    hashes: np.ndarray
    counts: np.ndarray
    head: np.ndarray  # token of a head word, or -1
    ends: int  # training documents
    tokens: int  # training tokens, ends too
    different: int  # different training tokens
    head_counts: np.ndarray
    tail_counts: np.ndarray
    tail_total: np.ndarray  # add-one count of each tail class

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, at, -1)


def _hashed(texts: Texts) -> tuple[Words, np.ndarray, np.ndarray]:
    words = split_words(texts)
    return words, hash_words(texts, words).view(np.int64), tail_class(texts, words)


def word_counts(docs: DataFrame) -> DataFrame:
    """hash, class, n of every word of ``docs`` (text); counted in each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, classes = [], []
            for _, texts in chunks(batch.column(0)):
                _, h, c = _hashed(texts)
                found.append(h)
                classes.append(c)
            if not found:
                continue
            h, at, n = np.unique(np.concatenate(found), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(np.concatenate(classes)[at]), pa.array(n)], ["hash", "class", "n"])

    rows = docs.select("text").mapInArrow(run, "hash bigint, class int, n bigint")
    return rows.groupBy("hash", "class").agg(F.sum("n").alias("n"))


def _kth_least(rows: DataFrame, value: Column, k: int) -> int:
    """The ``k``-th least of whole numbers, by histograms that are refined around it."""
    at = rows.select(value.alias("v"))
    low, high = at.agg(F.min("v"), F.max("v")).first()
    while low < high:
        width = (high - low) // HISTOGRAM + 1
        inside = at.where(F.col("v").between(low, high)).groupBy(F.expr(f"(v - {low}) div {width}").alias("part"))
        for row in sorted(inside.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()):
            if k <= row.n:
                break
            k -= row.n
        low, high = row.low, row.high
    return low


def commonest(counts: DataFrame, most: int) -> DataFrame:
    """The ``most`` commonest rows of ``counts``, those of one count by their hash, without a sort.

    One row more may come, where two hashes differ in the last bit alone.
    """
    if counts.count() <= most:
        return counts
    place = F.shiftrightunsigned("hash", 1)
    least = -_kth_least(counts, -F.col("n"), most)
    rest = most - counts.where(F.col("n") > least).count()
    last = _kth_least(counts.where(F.col("n") == least), place, rest)
    return counts.where((F.col("n") > least) | ((F.col("n") == least) & (place <= last)))


def lexicon(counts: DataFrame, n_docs: int) -> Lexicon:
    """The lexicon of a count table; ``n_docs`` is the number of ends."""
    top = commonest(counts, LEXICON).toPandas()
    top = top.sort_values(["n", "hash"], ascending=[False, True]).reset_index(drop=True)
    head = np.full(len(top), -1, dtype=np.int32)
    n_head = min(gru.HEAD - 1, len(top))
    head[:n_head] = np.arange(1, n_head + 1)
    head_counts, tail_counts = np.zeros(gru.HEAD), np.zeros(gru.TAIL_CLASSES)
    head_counts[gru.END] = n_docs
    head_counts[1:n_head + 1] = top["n"][:n_head]
    different = np.zeros(gru.TAIL_CLASSES)
    words, kinds = 0, 0
    for row in counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect():
        tail_counts[row["class"]], different[row["class"]] = row.n, row.kinds
        words, kinds = words + row.n, kinds + row.kinds
    np.subtract.at(tail_counts, top["class"][:n_head].to_numpy(), top["n"][:n_head].to_numpy())
    np.subtract.at(different, top["class"][:n_head].to_numpy(), 1)
    order = np.argsort(top["hash"].to_numpy())
    return Lexicon(
        top["hash"].to_numpy(dtype=np.int64)[order], top["n"].to_numpy(dtype=np.int64)[order], head[order],
        n_docs, int(words + n_docs), int(kinds + (n_docs > 0)), head_counts, tail_counts, tail_counts + different + 1)


def _tokens(lex: Lexicon, column: pa.Array) -> Iterator[tuple]:
    """Stretches of a text column: first row, model tokens, where documents begin, and per word
    its document, hash, place in the lexicon and tail class."""
    for first, texts in chunks(column):
        words, h, cls = _hashed(texts)
        place = lex.find(h)
        head = np.where(place >= 0, lex.head[place], -1) if len(lex.head) else np.full(len(h), -1)
        token = np.where(head >= 0, head, gru.HEAD + cls).astype(np.int32)
        begin = words.first + np.arange(len(texts) + 1)
        tokens = np.full(int(begin[-1]), gru.END, dtype=np.int32)
        tokens[np.arange(len(words)) + words.text] = token
        yield first, tokens, begin, words.text, h, place, cls, head >= 0


def _gathered(stretches: Iterator[tuple], most: int) -> Iterator[list[tuple]]:
    group, n = [], 0
    for s in stretches:
        group.append(s)
        n += len(s[1])
        if n >= most:
            yield group
            group, n = [], 0
    if group:
        yield group


def _joined(group: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of stretches in a row, and where their documents begin."""
    first = [np.zeros(1, dtype=np.int64)]
    for s in group:
        first.append(s[2][1:] + first[-1][-1])
    return np.concatenate([s[1] for s in group]), np.concatenate(first)


def _log10(params: dict, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """log10 probability of documents of the given sizes, one after another."""
    return gru.score(params, tokens, np.concatenate([[0], np.cumsum(sizes)])) / np.log(10)


def train(docs: DataFrame, lex: Lexicon, rounds: tuple = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters after all rounds over ``docs`` (key, text)."""
    values = gru.flat(gru.initial(lex.head_counts, lex.tail_counts))
    share = F.pmod(F.xxhash64(F.col("key"), F.lit("round")), F.lit(100))
    begin = 0
    for percent, rate in rounds:
        start = values

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            p, adam, total = gru.unflat(start), gru.Adam(rate), 0
            stretches = (s for batch in batches for s in _tokens(lex, batch.column(0)))
            for group in _gathered(stretches, TASK_TOKENS):
                tokens, first = _joined(group)
                gru.train(p, tokens, first, adam)
                total += len(tokens)
            if total:
                out = np.append(gru.flat(p).astype(np.float64), 1.0) * total
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out)], ["place", "value"])

        chosen = docs.where((share >= begin) & (share < begin + percent)).select("text")
        summed = chosen.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
        got = summed.toPandas().sort_values("place")["value"].to_numpy()
        if len(got):
            values = got[:-1] / got[-1]
        begin += percent
    return gru.unflat(values)


def score(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", training: str = "training", rounds: tuple = ROUNDS,
) -> DataFrame:
    """Score every whole text of ``docs`` with a model learned from those whose ``training`` is true.

    Returns key, training, n_tokens (words and one end), n_known (tokens seen in
    training), train_tokens, base_score (add-one unigram), score (log10 probability of the
    text under the model). A null text is empty: its end alone. Equal rows get equal
    scores; a null ``training`` counts as false. Without training documents every word is
    unknown. Words are told apart by 64-bit hashes.
    """
    plain = docs.select(F.col(key).alias("key"), F.coalesce(F.col(training), F.lit(False)).alias("training"),
                        F.col(text).alias("text"))
    learn = plain.where("training")
    counts = materialise(word_counts(learn), "word_counts")
    lex = lexicon(counts, learn.count())
    params = train(learn, lex, rounds)
    unit = np.log10(lex.tokens + lex.different + 1)
    log_class = np.log10(lex.tail_total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sizes, known = np.zeros(n, dtype=np.int64), np.full(n, int(lex.ends > 0), dtype=np.int64)
            base, model = np.full(n, np.log10(lex.ends + 1)), np.zeros(n)
            missed, long = [], []
            for group in _gathered(_tokens(lex, batch.column(3)), TASK_TOKENS):
                tokens, first = _joined(group)
                rows = group[0][0] + np.arange(len(first) - 1)
                sizes[rows] = np.diff(first)
                short = sizes[rows] <= LONG_TOKENS
                long += [(i, tokens[a:b]) for i, a, b in zip(rows[~short], first[:-1][~short], first[1:][~short])]
                if short.any():
                    kept = tokens[np.repeat(short, sizes[rows])]
                    model[rows[short]] += _log10(params, kept, sizes[rows][short])
                for at, _, begin, doc, h, place, cls, in_head in group:
                    c = np.where(place >= 0, lex.counts[place] if len(lex.counts) else 0, 0)
                    seen, size = np.log10(c + 1.0), len(begin) - 1
                    part = slice(at, at + size)
                    base[part] += np.bincount(doc, weights=seen, minlength=size)
                    known[part] += np.bincount(doc, weights=place >= 0, minlength=size).astype(np.int64)
                    model[part] += np.bincount(
                        doc, weights=np.where(in_head, 0.0, seen - log_class[cls]), minlength=size)
                    out = place < 0
                    missed.append(np.stack([doc[out] + at, h[out]], axis=1))
            if long:
                model[[i for i, _ in long]] += _log10(
                    params, np.concatenate([t for _, t in long]), np.array([len(t) for _, t in long]))
            none = [pa.nulls(n, pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:3], pa.array(sizes), pa.array(known), pa.array(base - sizes * unit), pa.array(model), *none],
                NAMES)
            pair = np.concatenate(missed) if missed else np.zeros((0, 2), dtype=np.int64)
            pair = pair[np.lexsort((pair[:, 1], pair[:, 0]))]
            new = np.ones(len(pair), dtype=bool)
            new[1:] = (pair[1:] != pair[:-1]).any(axis=1)
            places = np.flatnonzero(new)
            m, times = len(places), np.diff(np.append(places, len(pair)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(pair[places, 0])), pa.nulls(m, batch.column(1).type), pa.nulls(m, pa.bool_()),
                pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()),
                pa.nulls(m, pa.float64()), pa.array(pair[places, 1]), pa.array(times)], NAMES)

    kind = plain.schema["key"].dataType.simpleString()
    numbered = plain.select(F.monotonically_increasing_id().alias("row"), "key", "training", "text")
    scored = materialise(numbered.mapInArrow(
        run, f"row bigint, key {kind}, training boolean, n_tokens bigint, n_known bigint, base_score double, "
             "score double, hash bigint, times bigint"), "scores")
    # words beyond the lexicon: their counts are joined by hash and summed back to the row
    rare = scored.where("hash IS NOT NULL").select("row", "hash", "times").join(counts.select("hash", "n"), "hash")
    sums = rare.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("_seen"), F.sum("times").alias("_known"))
    seen, more = F.coalesce("_seen", F.lit(0.0)), F.coalesce("_known", F.lit(0))
    return scored.where("hash IS NULL").drop("hash", "times").join(sums, "row", "left").select(
        F.col("key").alias(key), F.col("training").alias(training), "n_tokens", (F.col("n_known") + more).alias("n_known"),
        F.lit(lex.tokens).cast("long").alias("train_tokens"), (F.col("base_score") + seen).alias("base_score"),
        (F.col("score") + seen).alias("score"))


NAMES = ["row", "key", "training", "n_tokens", "n_known", "base_score", "score", "hash", "times"]
