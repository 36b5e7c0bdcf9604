"""Removed spans against all windows of all texts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from edges import documents, empty

from breezeway.llm import repeats
from breezeway.llm.textarrays import chunks, split_words


def brute(rows, window=35):
    """(key, words, removed words, kept text) by counting every window."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    count = Counter(tuple(w[i:i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((key, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def found(df, **kw):
    rows = repeats.without_repeats(df, with_text=True, **kw).collect()
    assert all(r.kept_sha256 == hashlib.sha256(r.kept.encode()).hexdigest() for r in rows)
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=repr)


def same(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(df, **kw)
    assert got == brute(rows, kw.get("window", 35))
    return sum(r[2] for r in got)


def words(rng, n, kinds):
    return [f"w{rng.randrange(kinds)}" for _ in range(n)]


@pytest.mark.parametrize("window,gram,kinds", [(5, 2, 3), (6, 6, 4), (4, 1, 2), (9, 4, 2)])
def test_dense_repeats(spark, window, gram, kinds):
    """Few words, so that paths branch, cross, overlap themselves and run round."""
    rng = random.Random(window)
    rows = [(i, " ".join(words(rng, rng.randrange(0, 60), kinds))) for i in range(60)]
    rows += [(200, "a " * 300), (201, "a b " * 40), (202, "a " * (window + 1))]
    assert same(spark, rows, window=window, gram=gram)


def test_passages_copies_and_edits(spark):
    """Spans of 34 to 300 words in other surroundings, near copies, copies of copies, repeats inside a document."""
    rng = random.Random(5)
    passages = [words(rng, n, 10_000) for n in (34, 35, 36, 50, 120, 300)]
    rows = []
    for i in range(80):
        w = words(rng, rng.randrange(0, 200), 10_000)
        for p in rng.sample(passages, rng.randrange(0, 3)):
            cut = sorted(rng.sample(range(len(p) + 1), 2)) if rng.random() < 0.5 else [0, len(p)]
            at = rng.randrange(len(w) + 1)
            w[at:at] = p[cut[0]:cut[1]]
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    base = words(rng, 2000, 10_000)
    for i in range(20):
        w = list(base)
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(w))
            w[at:at + rng.randrange(2)] = words(rng, rng.randrange(2), 10_000)
        rows.append((100 + i, " ".join(w)))
    rows += [(300 + i, rows[3][1]) for i in range(50)] + [(3, rows[3][1]), (None, rows[4][1]), (None, None), (7, "")]
    assert same(spark, rows) > 20_000


def test_case_and_marks_count(spark):
    text = " ".join(f"Word{i}" for i in range(40))
    rows = [(1, text), (2, text.lower()), (3, text.replace("Word39", "Word39,")), (4, "x " + text.replace(" ", " "))]
    same(spark, rows)


def test_awkward_documents(spark):
    docs = documents(spark)
    assert found(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    out = repeats.without_repeats(empty(spark))
    assert out.count() == 0 and out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]


def test_pieces_hold_every_window_once():
    """Pieces tile the windows of a text; the n-gram of a window depends on its words alone."""
    rng = random.Random(2)
    column = pa.array([" ".join(words(rng, n, 4)) for n in (0, 3, 8, 9, 50, 400)])
    for _, texts in chunks(column, raw=True):
        split = split_words(texts)
        text, start, n, gram, _ = repeats.pieces(texts, split, 8, 3)
        all_words = column.to_pylist()
        of = {}
        for t in range(len(texts)):
            mine = text == t
            total = max(len(all_words[t].split()) - 7, 0)
            assert n[mine].sum() == total and (start[mine] == np.cumsum(n[mine]) - n[mine]).all()
            w = all_words[t].split()
            for s, m, g in zip(start[mine], n[mine], gram[mine]):
                for i in range(s, s + m):
                    assert of.setdefault(tuple(w[i:i + 8]), g) == g
                assert len({tuple(w[i:i + 8]) for i in range(s, s + m)}) == m


def test_verification_drops_what_only_the_hashes_take_for_equal(spark, monkeypatch):
    """With a content hash that tells nothing apart, the words at the coordinates decide."""
    plain = repeats.pieces

    def blind(*args):
        text, start, n, gram, content = plain(*args)
        return text, start, n, gram, np.zeros_like(content)

    monkeypatch.setattr(repeats, "pieces", blind)
    rng = random.Random(9)
    rows = [(i, " ".join(words(rng, 60, 50))) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.n_removed == 0 for r in repeats.without_repeats(df, gram=1).collect())
