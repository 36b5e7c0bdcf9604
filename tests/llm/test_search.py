"""Ranked search against scores of all pairs."""

import math
import random
import re

import pytest
from edges import documents, empty

from breezeway.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, top=20):
    """(item, rank, key, score), by scoring every pair."""
    bags = [(key, t) for key, text in docs if (t := terms(text))]
    n, total = len(bags), sum(len(t) for _, t in bags)
    out = []
    for item, text in items:
        asked, scores = terms(text), []
        weight = {}
        for q in set(asked):
            df = sum(q in t for _, t in bags)
            weight[q] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
        for key, t in bags:
            m = 100 - 25 + (25 * len(t) * n) // total
            score = sum(weight[q] * ((10**9 * t.count(q)) // (1000 * t.count(q) + 12 * m)) for q in asked if q in t)
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, rank, key, -s) for rank, (s, _, _, key) in enumerate(sorted(scores)[:top], 1)]
    return out


def same(spark, docs, items, top=20):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in search.ranked(d, i, top=top).collect()]
    assert sorted(got, key=repr) == sorted(brute(docs, items, top), key=repr)
    assert got or not brute(docs, items, top)


def corpus(n=300, seed=4):
    rng = random.Random(seed)
    word = lambda: rng.choice(["Alpha", "beta", "gamma9", "dé", "x", "漢字", "The", "of", "and"]) + rng.choice(["", "s", "S"])
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 40))) + rng.choice(["", ".", " !"])) for i in range(n)]
    items = [(i, ", ".join(word() for _ in range(rng.randrange(1, 8)))) for i in range(12)]
    return docs, items


def test_all_pairs(spark):
    same(spark, *corpus())


def test_large_classes_expand_in_order(spark):
    """A third of all rows is one bag; ties are by key, null last, repeats count each."""
    docs, items = corpus(60)
    rng = random.Random(1)
    docs += [(1000 + i, rng.choice(["beta the-of", "of BETA the", "the of beta"])) for i in range(100)]
    docs += [(None, "beta the of"), (3, "Alpha gamma9"), (3, "Alpha gamma9")]
    rng.shuffle(docs)
    same(spark, docs, items + [(50, "beta beta of"), (51, "alpha"), (51, "alpha"), (52, None), (53, "unknownterm"), (54, "")])


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_TERMS", 10)
    monkeypatch.setattr(search, "SCORES_AT_ONCE", 16)
    monkeypatch.setattr(search, "BROADCAST_CLASSES", 0)
    same(spark, *corpus(80), top=3)


def test_awkward_documents(spark):
    docs = documents(spark)
    items = spark.createDataFrame([(1, "Is the"), (2, "üBER ist"), (3, "漢字 x")], "item_id long, text string")
    got = sorted(tuple(r) for r in search.ranked(docs, items).collect())
    assert got == sorted(brute([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()]))


@pytest.mark.parametrize("which", ["docs", "items"])
def test_empty_tables(spark, which):
    docs, items = empty(spark).select("doc_id", "text"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    if which == "items":
        docs, items = documents(spark), items.limit(0)
    out = search.ranked(docs, items)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0
