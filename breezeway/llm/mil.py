"""Document quality by attention over passages.

A document is a bag of passages. Each passage is encoded from its byte and word-shape
counts; gated attention weighs the passages, and the weighted sum of their encodings is
scored. Encoder, attention and scorer are learned together from document labels:

    h = tanh(x E),  a = softmax(w · (tanh(h V) * sigmoid(h U))),  p = sigmoid(c · sum(a h))
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breezeway.llm.common import sampled
from breezeway.llm.textarrays import CHUNK_BYTES, Texts, chunks, hash_words, split_words

#: Words of a passage.
PASSAGE_WORDS = 64
SHAPES = 64
FEATURES = 256 + SHAPES + 4
HIDDEN, GATES = 24, 16


def strips(texts: Texts, size: int = CHUNK_BYTES) -> Iterator[tuple[Texts, np.ndarray | None]]:
    """One text in stretches of whole passages, of about ``size`` bytes, each with the word before it.

    A stretch is longer only where ``size`` bytes don't hold the words of a passage.
    """
    data, at, reach, before = texts.data, 0, size, None
    while True:
        end = min(at + reach, len(data))
        words = split_words(Texts(data[at:end], np.array([0, end - at])))
        n = len(words)
        if end < len(data):
            if not n:
                at = end
                continue
            n = (n - int(words.end[-1] == end - at)) // PASSAGE_WORDS * PASSAGE_WORDS
            if not n:
                reach *= 2
                continue
        elif not n and before is not None:
            return
        cut = int(words.end[n - 1]) if n else 0
        yield Texts(data[at:at + cut], np.array([0, cut])), before
        if end == len(data):
            return
        before = data[at + words.begin[n - 1]:at + cut]
        at, reach = at + cut, size


def passages(texts: Texts, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and the first passage of each text.

    Bytes keep their case. A text without words is one passage of zeros. ``before`` is the
    word that the first text goes on from, where it is a stretch of a longer one.
    """
    words = split_words(texts)
    count = np.diff(words.first)
    n = np.maximum(-(-count // PASSAGE_WORDS), 1)
    first = np.concatenate([[0], np.cumsum(n)])
    nth = np.arange(len(words)) - words.first[words.text]
    place = first[words.text] + nth // PASSAGE_WORDS
    total = int(first[-1])
    out = np.zeros((total, FEATURES), dtype=np.float32)
    if len(words):
        size = words.end - words.begin
        of_byte = np.repeat(place, size)
        solid = np.repeat(words.begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        slots = of_byte * 256 + texts.data[solid]
        out[:, :256] = np.bincount(slots, minlength=total * 256).reshape(total, 256)
        h = hash_words(texts, words)
        again = np.zeros(len(words), dtype=bool)
        again[1:] = (h[1:] == h[:-1]) & (words.text[1:] == words.text[:-1])
        if before is not None:
            one = Texts(before, np.array([0, len(before)]))
            again[0] = h[0] == hash_words(one, split_words(one))[0]
        head, tail = texts.data[words.begin].astype(np.int64), texts.data[words.end - 1].astype(np.int64)
        kind = np.searchsorted([48, 58, 65, 91, 97, 123, 128], np.arange(256), side="right")
        shape = kind[head] * 8 + kind[tail]
        out[:, 256:256 + SHAPES] = np.bincount(place * SHAPES + shape, minlength=total * SHAPES).reshape(total, SHAPES)
        per = lambda x: np.bincount(place, weights=x, minlength=total)
        n_words = np.maximum(per(np.ones(len(words))), 1)
        n_bytes = np.maximum(out[:, :256].sum(axis=1), 1)
        out[:, -4] = per(again) / n_words
        out[:, -3] = np.minimum(n_bytes / n_words, 20) / 20
        order = np.lexsort((h, place))
        equal = np.zeros(len(words), dtype=bool)
        equal[1:] = (h[order][1:] == h[order][:-1]) & (place[order][1:] == place[order][:-1])
        out[:, -2] = np.bincount(place[order], weights=equal, minlength=total) / n_words
        out[:, -1] = np.minimum(n_words / PASSAGE_WORDS, 1)
        out[:, :256] = np.sqrt(out[:, :256] / n_bytes[:, None])
        out[:, 256:256 + SHAPES] = np.sqrt(out[:, 256:256 + SHAPES] / n_words[:, None])
    return out, first


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, first[:-1], axis=0)


@dataclass
class BagModel:
    """Learned parameters by name, and the prior when nothing could be learned."""

    p: dict[str, np.ndarray]
    prior: float | None = None

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p, bag = self.p, np.repeat(np.arange(len(first) - 1), np.diff(first))
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        logit = (v * u) @ p["w"]
        top = np.maximum.reduceat(logit, first[:-1])
        raw = np.exp(logit - top[bag])
        a = raw / _sums(raw, first)[bag]
        z = _sums(a[:, None] * h, first)
        score = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))
        return {"bag": bag, "h": h, "v": v, "u": u, "a": a, "z": z, "score": score}

    def of_strips(self, parts: Iterator[np.ndarray]) -> float:
        """The score of one bag that comes in parts: attention relative to the largest so far."""
        p, top, total, z = self.p, -np.inf, 0.0, np.zeros(HIDDEN)
        for x in parts:
            h = np.tanh(x @ p["E"] + p["e"])
            logit = (np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]
            higher = max(top, float(logit.max()))
            raw, kept = np.exp(logit - higher, dtype=np.float64), np.exp(top - higher)
            total, z, top = total * kept + raw.sum(), z * kept + raw @ h, higher
        return float(1 / (1 + np.exp(-np.clip(z / total @ p["c"] + p["b"], -30, 30))))


def _gradients(m: BagModel, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    p, s = m.p, m.forward(x, first)
    d = (s["score"] - y) / len(y)
    g = {"c": s["z"].T @ d, "b": d.sum()}
    dz = d[:, None] * p["c"]
    dh = s["a"][:, None] * dz[s["bag"]]
    da = (s["h"] * dz[s["bag"]]).sum(axis=1)
    dlogit = s["a"] * (da - _sums(s["a"] * da, first)[s["bag"]])
    g["w"] = (s["v"] * s["u"]).T @ dlogit
    gate = dlogit[:, None] * p["w"]
    dv, du = gate * s["u"] * (1 - s["v"] ** 2), gate * s["v"] * s["u"] * (1 - s["u"])
    g["V"], g["U"] = s["h"].T @ dv, s["h"].T @ du
    dx = (dh + dv @ p["V"].T + du @ p["U"].T) * (1 - s["h"] ** 2)
    g["E"], g["e"] = x.T @ dx, dx.sum(axis=0)
    return g


def train(
    x: np.ndarray, first: np.ndarray, y: np.ndarray, *, epochs: int = 30, batch: int = 64, rate: float = 0.01,
    decay: float = 1e-5, seed: int = 7,
) -> BagModel:
    """Adam over shuffled batches of documents; the seed is fixed, so reruns agree."""
    r = np.random.default_rng(seed)
    scaled = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
    share = np.clip(y.mean(), 0.01, 0.99)
    model = BagModel({
        "E": scaled(FEATURES, HIDDEN) * 2, "e": np.zeros(HIDDEN), "V": scaled(HIDDEN, GATES), "U": scaled(HIDDEN, GATES),
        "w": scaled(GATES), "c": scaled(HIDDEN), "b": np.array(np.log(share / (1 - share)))})
    mean = {k: np.zeros_like(v) for k, v in model.p.items()}
    square = {k: np.zeros_like(v) for k, v in model.p.items()}
    n, step = np.diff(first), 0
    for _ in range(epochs):
        order = r.permutation(len(y))
        for at in range(0, len(y), batch):
            docs = order[at:at + batch]
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in docs])
            g = _gradients(model, x[rows].astype(np.float64), np.concatenate([[0], np.cumsum(n[docs])]), y[docs])
            step += 1
            for k, v in g.items():
                v = v + decay * model.p[k]
                mean[k] = 0.9 * mean[k] + 0.1 * v
                square[k] = 0.999 * square[k] + 0.001 * v * v
                model.p[k] = model.p[k] - rate * (mean[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, *, train_documents: int = 3000) -> BagModel:
    """Learn from ``docs`` (key, text) and their ``labels`` (key, label 0 or 1), null labels aside.

    At most ``train_documents`` labels and as many whole documents are used, by their hash;
    labels are picked first, so that no other text is moved. With labels of one kind only,
    every score is that label; without labels it is 0.5.
    """
    known = labels.where("label IN (0, 1) AND key IS NOT NULL").select("key", F.col("label").cast("int").alias("label"))
    known = known.join(docs.select("key").distinct(), "key", "left_semi")
    picked = sampled(known, train_documents, ("key", "label")).select("key", "label")
    sample = sampled(docs.select("key", "text").join(F.broadcast(picked), "key"), train_documents, ("key", "text", "label"))

    def encode(batches):
        for batch in batches:
            for at, texts in chunks(batch.column(1), raw=True):
                if len(texts) == 1:
                    bags = [b"".join(passages(*part)[0].tobytes() for part in strips(texts))]
                else:
                    x, first = passages(texts)
                    bags = [x[a:b].tobytes() for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), batch.column(2).slice(at, len(texts)),
                     pa.array(bags, pa.binary())], ["key", "label", "bag"])

    kind = sample.schema["key"].dataType.simpleString()
    rows = sample.select("key", "text", "label").mapInArrow(
        encode, f"key {kind}, label int, bag binary").collect()
    rows.sort(key=lambda r: (r.key is None, r.key, r.label, bytes(r.bag)))
    y = np.array([r.label for r in rows], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return BagModel({}, prior=float(y[0]) if len(y) else 0.5)
    bags = [np.frombuffer(r.bag, dtype=np.float32).reshape(-1, FEATURES) for r in rows]
    return train(np.concatenate(bags), np.cumsum([0, *map(len, bags)]), y)


def score(model: BagModel, text: Column) -> Column:
    """Score 0 … 1 of a text; a null text is scored as an empty one.

    However long a text is, its passages are encoded a stretch at a time.
    """
    if model.prior is not None:
        return F.lit(model.prior)
    small = BagModel({k: v.astype(np.float32) for k, v in model.p.items()})

    def run(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column))
        for at, texts in chunks(column, raw=True):
            if len(texts) == 1:
                out[at] = small.of_strips(passages(*part)[0] for part in strips(texts))
                continue
            x, first = passages(texts)
            out[at:at + len(texts)] = small.forward(x, first)["score"]
        return pa.array(out)

    return F.arrow_udf(run, "double")(F.coalesce(text, F.lit("")))
