"""The language model: counts against brute force, and its numpy parts."""

import collections

import numpy as np
import pytest
from edges import documents, empty
from pyspark.sql import functions as F

from breezeway.llm import gru, lm
from breezeway.llm.common import fold


def scored(docs):
    return lm.score(docs.withColumn("training", fold("doc_id", 7) != 2))


def test_counts_equal_brute_force_and_equal_rows_get_equal_scores(spark):
    docs = documents(spark).withColumn("training", fold("doc_id", 7) != 2)
    rows = docs.select("doc_id", "text", "training").collect()
    counts = collections.Counter()
    for r in rows:
        if r.training:
            counts.update([*(r.text or "").encode().lower().split(), None])
    total, kinds = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        tokens = [*(r.text or "").encode().lower().split(), None]
        base = sum(np.log10((counts[t] + 1) / (total + kinds + 1)) for t in tokens)
        want.append((str(r.doc_id), len(tokens), sum(counts[t] > 0 for t in tokens), total, round(base, 6)))
    got = scored(documents(spark)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_words_beyond_the_lexicon_are_joined(spark, monkeypatch):
    monkeypatch.setattr(lm, "LEXICON", 3)
    got = scored(documents(spark)).groupBy("doc_id").agg(F.first("n_known").alias("n"), F.first("base_score").alias("b"))
    monkeypatch.undo()
    want = scored(documents(spark)).groupBy("doc_id").agg(F.first("n_known").alias("n"), F.first("base_score").alias("b"))
    a, b = ({r.doc_id: (r.n, round(r.b, 6)) for r in x.collect()} for x in (got, want))
    assert a == b


def test_empty_table_and_no_training_documents(spark):
    assert scored(empty(spark)).collect() == []
    got = lm.score(documents(spark, 3).withColumn("training", F.lit(None).cast("boolean"))).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and not r.training and np.isfinite(r.score) for r in got)


def _small(seed=0):
    r = np.random.default_rng(seed)
    sizes = np.array([1, 40, 7, 1, 90, 13])
    first = np.concatenate([[0], np.cumsum(sizes)])
    tokens = r.integers(1, gru.INPUTS, first[-1]).astype(np.int32)
    tokens[first[1:] - 1] = gru.END
    return gru.initial(r.integers(1, 9, gru.HEAD), r.integers(1, 9, gru.TAIL_CLASSES)), tokens, first


def test_state_is_carried_whatever_the_window_and_lanes():
    p, tokens, first = _small()
    p["O"][:] = np.random.default_rng(1).normal(0, 0.3, p["O"].shape)
    p["C"][:] = np.random.default_rng(2).normal(0, 0.3, p["C"].shape)
    want = gru.score(p, tokens, first, window=1, n_lanes=1)
    for window, lanes in ((5, 2), (64, 3), (1000, 512)):
        assert gru.score(p, tokens, first, window=window, n_lanes=lanes) == pytest.approx(want, rel=1e-4)


def test_outputs_are_a_distribution():
    p, _, _ = _small()
    p["O"][:] = np.random.default_rng(1).normal(0, 0.3, p["O"].shape)
    s = np.repeat(np.random.default_rng(3).normal(0, 1, (1, gru.HIDDEN)), gru.INPUTS, axis=0).astype(np.float32)
    logp, _, _ = gru._outputs(p, s, np.arange(gru.INPUTS), False)
    assert np.exp(logp.astype(np.float64)).sum() == pytest.approx(1, abs=1e-4)


def test_gradients_equal_differences():
    p, tokens, first = _small(4)
    p["C"][:] = np.random.default_rng(2).normal(0, 0.3, p["C"].shape)
    p["O"][:] = np.random.default_rng(1).normal(0, 0.3, p["O"].shape)

    class Kept:
        def update(self, _, g):
            self.g = g

    kept = Kept()
    gru.train(p, tokens, first, kept, window=10**6, least_lanes=3, most_lanes=3)
    loss = lambda q: -gru.score(q, tokens, first, window=10**6, n_lanes=3).sum() / len(tokens)
    rng = np.random.default_rng(5)
    for name, g in kept.g.items():
        q = {k: v.astype(np.float64) for k, v in p.items()}
        direction = rng.normal(0, 1, g.shape) * (g != 0)
        step = 1e-4
        q[name] = q[name] + step * direction
        up = loss(q)
        q[name] = q[name] - 2 * step * direction
        assert (up - loss(q)) / (2 * step) == pytest.approx((g * direction).sum(), rel=0.02, abs=2e-4), name


def test_training_lowers_the_loss():
    p, tokens, first = _small(6)
    before = gru.score(p, tokens, first).sum()
    adam = gru.Adam(0.02)
    for _ in range(30):
        gru.train(p, tokens, first, adam, least_lanes=4)
    assert gru.score(p, tokens, first).sum() > before * 0.9


def test_commonest_words_by_histograms(spark, monkeypatch):
    """The same words as by sorting, with many ties and negative hashes."""
    from breezeway.llm import lm

    monkeypatch.setattr(lm, "HISTOGRAM", 4)
    rng = np.random.default_rng(1)
    rows = [(int(h), int(n)) for h, n in zip(rng.integers(-2**63, 2**63 - 1, 500), rng.zipf(1.7, 500))]
    df = spark.createDataFrame(rows, "hash long, n long")
    for most in (1, 7, 100, 499, 500, 600):
        got = {tuple(r) for r in lm.commonest(df, most).collect()}
        want = sorted(rows, key=lambda r: (-r[1], (r[0] % 2**64) >> 1))[:most]
        assert got == set(want)
