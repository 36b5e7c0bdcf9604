"""Mixing against exact targets."""

from collections import defaultdict

import pytest
from edges import documents, empty

from breezeway.llm import mixing


def exact_targets(sizes, weights=(3, 1, 2), share=1.5, repeat=2):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > repeat * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = repeat * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def words(text):
    return len((text or "").encode().split())


def test_targets_and_taken_words(spark):
    docs = documents(spark, 300)
    rows = mixing.mix(docs, carry=["doc_id", "source", "text"]).collect()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.mixed.size == words(r.text) and 0 <= r.mixed.copies <= 2
        sizes[r.source] += r.mixed.size
        taken[r.source] += r.mixed.size * r.mixed.copies
        largest[r.source] = max(largest[r.source], r.mixed.size)
    want = exact_targets(sizes)
    for s in sizes:
        assert all(r.mixed.target == pytest.approx(want[s]) for r in rows if r.source == s)
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1
    again = mixing.mix(docs.repartition(5), carry=["doc_id", "source", "text"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_one_source_holding_equal_rows_is_cut_exactly(spark):
    rows = [(7, "a b c d", "hot")] * 400 + [(i, "w " * (i % 9), "s%d" % (i % 3)) for i in range(200)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), carry=["source"]).collect()
    hot = [r.mixed for r in out if r.source == "hot"]
    assert abs(sum(m.copies * m.size for m in hot) - hot[0].target) <= 4


def test_larger_budgets_keep_what_smaller_ones_keep(spark):
    docs = documents(spark, 200).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    kept = [{r.doc_id for r in mixing.mix(docs, carry=["doc_id"], share=s, weights=(1,)).collect() if r.mixed.copies}
            for s in (0.3, 0.6, 0.9)]
    assert kept[0] < kept[1] < kept[2]


def test_all_columns_carried_and_empty_table(spark):
    docs = documents(spark)
    assert mixing.mix(docs).columns[:-1] == docs.columns
    assert mixing.mix(empty(spark), carry=["doc_id"]).collect() == []


def test_salted_join_equals_broadcast(spark, monkeypatch):
    docs = documents(spark)
    want = sorted(map(str, mixing.mix(docs, carry=["doc_id"]).collect()))
    monkeypatch.setattr("breezeway.llm.common.BROADCAST_ROWS", 0)
    assert sorted(map(str, mixing.mix(docs, carry=["doc_id"]).collect())) == want
