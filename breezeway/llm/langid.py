"""Language identification with string kernels.

A text is the set of byte n-grams that occur in it, n from 1 to 3, blended. The kernel of
two texts is the number of n-grams present in both over the root of the product of their
numbers, over an alphabet: the n-grams that the landmark texts have. With Nyström's
approximation a text is its kernel values with the landmarks; one ridge regression per
language against the rest gives the margins. Texts are scored in batches, by one product
of presence matrices and one of kernel values.

The best language of a text need not be its own. Whether it is known is told by two kinds of
evidence, with bounds from labelled texts that were held out: the margin over the runner-up,
and the share of the text's 3-grams that lie in the alphabet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breezeway.llm.common import sampled
from breezeway.llm.textarrays import Texts, chunks

LENGTHS = (1, 2, 3)
#: n-grams are told apart by a hash of so many bits.
HASH_BITS = 18
UNKNOWN = "und"
#: Held-out texts are dealt into so many folds.
FOLDS = 4
#: The evidence that a language asks for: this quantile over its held-out texts, times a slack
#: for the margin over the runner-up and one for the share of 3-grams. From the quantile CLEAR
#: on, the margin suffices alone: signs between words lower the share of a text, but not it.
LOW, MARGIN_SLACK, SHARE_SLACK, CLEAR = 0.01, 0.75, 0.9, 0.05
#: Held-out texts that a language's own bound needs; one with fewer takes that of all languages,
#: which needs LEAST_OF_ALL.
LEAST_HELD_OUT, LEAST_OF_ALL = 100, 20


def _codes(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and byte position of every n-gram that lies inside one text."""
    size = max(len(texts.data) - n + 1, 0)
    code = np.full(size, n * 40503, dtype=np.uint32)
    for k in range(n):
        code *= np.uint32(0x01000193)
        code ^= texts.data[k:k + size]
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    inside = np.ones(size, dtype=bool)
    for k in range(1, n):
        cut = texts.starts[1:-1] - k
        inside[cut[(cut >= 0) & (cut < size)]] = False
    return code >> np.uint32(32 - HASH_BITS), inside


def presence(texts: Texts, column: np.ndarray, width: int) -> np.ndarray:
    """Matrix of texts by alphabet n-grams: 1 where present. ``column`` maps a hash to its column or -1."""
    out = np.zeros(len(texts) * width, dtype=np.float32)
    base = np.repeat(np.arange(len(texts), dtype=np.int64) * width, np.diff(texts.starts))
    for n in LENGTHS:
        code, inside = _codes(texts, n)
        at = column[code]
        inside &= at >= 0
        out[base[:len(code)][inside] + at[inside]] = 1
    return out.reshape(len(texts), width)


def alphabet_share(texts: Texts, column: np.ndarray) -> np.ndarray:
    """Share of the 3-grams of each text, counted as often as they occur, that the alphabet has."""
    code, inside = _codes(texts, 3)
    known = inside & (column[code] >= 0)

    def of_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags)])[np.minimum(texts.starts, len(flags))])

    return of_text(known) / np.maximum(of_text(inside), 1)


def lead(margin: np.ndarray) -> np.ndarray:
    """Margin of the best language over the runner-up; 0 with one language."""
    if margin.shape[1] < 2:
        return np.zeros(len(margin))
    two = np.partition(margin, -2, axis=1)
    return two[:, -1] - two[:, -2]


@dataclass
class LanguageModel:
    """Alphabet columns by hash, landmark presence (scaled), weights and languages.

    A text is known to be of a language with ``least_lead`` and ``least_share`` at least, or
    with ``clear_lead``.
    """

    column: np.ndarray
    landmarks: np.ndarray  # alphabet x landmarks, each landmark over the root of its number of n-grams
    weights: np.ndarray  # landmarks x languages
    languages: list[str]
    least_lead: np.ndarray | None = None
    least_share: np.ndarray | None = None
    clear_lead: np.ndarray | None = None

    def known(self, margin: np.ndarray, texts: Texts) -> np.ndarray:
        """Whether there is evidence enough that each text is of its best language."""
        best, ahead = margin.argmax(axis=1), lead(margin)
        share = alphabet_share(texts, self.column)
        return (ahead >= self.clear_lead[best]) | (
            (ahead >= self.least_lead[best]) & (share >= self.least_share[best]))

    def kernel(self, texts: Texts) -> np.ndarray:
        """Kernel values of texts with the landmarks."""
        x = presence(texts, self.column, len(self.landmarks))
        return (x @ self.landmarks) / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


def fit(
    labelled: DataFrame, *, train_texts: int = 2000, per_language: int = 500, landmarks: int = 96,
    alphabet: int = 4096, ridge: float = 1e-3,
) -> LanguageModel:
    """Learn from ``labelled`` (key, text, lang), null languages aside.

    At most ``train_texts`` whole texts are used, at most ``per_language`` of a language,
    by their hash, one of each language in turn. The first ``landmarks`` of them are the
    landmarks, and the ``alphabet`` commonest of their n-grams the alphabet. Without any
    labelled text there is no language.
    """
    sample = sampled(
        labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("key", "text", "lang"), train_texts,
        ("key", "text", "lang"), "lang", per_language)

    def grams(batches):
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                own = [[] for _ in range(len(texts))]
                for n in LENGTHS:
                    code, inside = _codes(texts, n)
                    for i in range(len(texts)):
                        a, b = texts.starts[i], max(texts.starts[i + 1] - n + 1, texts.starts[i])
                        own[i].append(np.unique(code[a:b]))
                sets = [np.unique(np.concatenate(x)).astype(np.int32) for x in own]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array(sets, pa.list_(pa.int32()))], ["place", "grams"])

    marks = sample.where(F.col("place") <= landmarks).select("place", "text").mapInArrow(
        grams, "place int, grams array<int>").collect()
    marks = [np.array(r.grams, dtype=np.int64) for r in sorted(marks, key=lambda r: r.place)]
    column = np.full(1 << HASH_BITS, -1, dtype=np.int32)
    if not marks:
        return LanguageModel(column, np.zeros((1, 1), np.float32), np.zeros((1, 0)), [])
    common = np.bincount(np.concatenate(marks), minlength=1 << HASH_BITS)
    chosen = np.argsort(-common, kind="stable")[:alphabet]
    chosen = chosen[common[chosen] > 0]
    column[chosen] = np.arange(len(chosen))
    z = np.zeros((max(len(chosen), 1), len(marks)), dtype=np.float32)
    for j, g in enumerate(marks):
        at = column[g]
        z[at[at >= 0], j] = 1
    z /= np.sqrt(np.maximum(z.sum(axis=0), 1))
    model = LanguageModel(column, z, np.zeros((len(marks), 0)), [])

    def kernels(batches):
        for batch in batches:
            for first, texts in chunks(batch.column(0)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(first, len(texts)), batch.column(2).slice(first, len(texts)).cast(pa.int64()),
                     pa.array(list(model.kernel(texts)), pa.list_(pa.float32())),
                     pa.array(alphabet_share(texts, column))], ["lang", "place", "kernel", "share"])

    rows = sample.select("text", "lang", "place").mapInArrow(
        kernels, "lang string, place long, kernel array<float>, share double").collect()
    model.languages = sorted({r.lang for r in rows})
    k = np.array([r.kernel for r in rows], dtype=np.float64)
    y = np.where(np.array([r.lang for r in rows])[:, None] == np.array(model.languages)[None], 1.0, -1.0)
    among = z.T.astype(np.float64) @ z

    def solved(some: np.ndarray) -> np.ndarray:
        # every language weighs the same, and the two sides of each against-the-rest task as well
        own_k, own_y = k[some], y[some]
        share = np.array([1 / max(np.sum(own_y[:, j] > 0), 1) for j in range(y.shape[1])])
        weight = (own_y > 0) @ share
        weight *= len(weight) / weight.sum()
        left = own_k.T @ (own_k * weight[:, None]) + ridge * len(own_k) * among + 1e-8 * np.eye(len(marks))
        return np.linalg.solve(left, own_k.T @ (own_y * weight[:, None]))

    model.weights = solved(np.ones(len(k), dtype=bool))
    place = np.array([r.place for r in rows])
    # places go round the languages, so folds are dealt within each
    nth = np.zeros(len(y), dtype=np.int64)
    for j in range(y.shape[1]):
        own = np.flatnonzero(y[:, j] > 0)
        nth[own[np.argsort(place[own], kind="stable")]] = np.arange(len(own))
    margin = np.full(y.shape, -np.inf)
    for i in range(FOLDS):
        out = nth % FOLDS == i
        if out.any() and not out.all():
            margin[out] = k[out] @ solved(~out)
    best = margin.argmax(axis=1)
    right = (y[np.arange(len(y)), best] > 0) & np.isfinite(margin).all(axis=1)
    # the alphabet is that of the landmarks, so only the other texts are held out from it
    free = right & (place > landmarks)

    def bounds(values: np.ndarray, held: np.ndarray, q: float, slack: float, none: float) -> np.ndarray:
        low = lambda some: slack * np.quantile(values[some], q)
        whole = low(held) if held.sum() >= LEAST_OF_ALL else none
        own = [held & (best == j) for j in range(y.shape[1])]
        return np.array([low(some) if some.sum() >= LEAST_HELD_OUT else whole for some in own])

    model.least_share = bounds(np.array([r.share for r in rows]), free, LOW, SHARE_SLACK, -np.inf)
    if y.shape[1] > 1:
        model.least_lead = bounds(lead(margin), right, LOW, MARGIN_SLACK, -np.inf)
        model.clear_lead = bounds(lead(margin), right, CLEAR, 1.0, np.inf)
    else:
        model.least_lead, model.clear_lead = np.full(1, -np.inf), np.full(1, np.inf)
    return model


def predict(model: LanguageModel, text: Column, *, with_known: bool = False) -> Column:
    """Struct lang_pred, score of a text, and with ``with_known`` whether the evidence suffices.

    score is (1 + margin) / 2 of the best language, cut to 0 … 1. A null text, one without
    a letter, and every text under a model without languages is ``und`` with score 0 and not known.
    A model learned from fewer than LEAST_OF_ALL texts has no bounds for the evidence.
    """
    def run(column: pa.Array) -> pa.Array:
        best, score = np.zeros(len(column), dtype=np.int64), np.zeros(len(column))
        known = np.zeros(len(column), dtype=bool)
        for first, texts in chunks(column):
            margin = model.kernel(texts) @ model.weights
            best[first:first + len(texts)] = margin.argmax(axis=1)
            score[first:first + len(texts)] = np.clip((1 + margin.max(axis=1)) / 2, 0, 1)
            if with_known:
                known[first:first + len(texts)] = model.known(margin, texts)
        names = pa.array(model.languages, pa.string()).take(pa.array(best))
        fields = [names, pa.array(score), *([pa.array(known)] if with_known else [])]
        return pa.StructArray.from_arrays(fields, ["lang_pred", "score", *(["known"] if with_known else [])])

    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                    *([F.lit(False).alias("known")] if with_known else []))
    if not model.languages:
        return none
    apply = F.arrow_udf(run, f"struct<lang_pred: string, score: double{', known: boolean' if with_known else ''}>")
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), apply(text)).otherwise(none)
