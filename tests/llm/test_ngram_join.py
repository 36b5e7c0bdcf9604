"""The n-gram Jaccard join against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from breezeway.llm import ngram_join as nj

SCHEMA = "doc_id long, text string, group string, size int"


def test_spare_segments_make_up_for_empty_ones():
    """Pairs as different as the bound allows share a signature, whatever segments are empty."""
    rng = np.random.default_rng(8)
    found = with_empty = 0
    for percent in (80, 90):
        for size in (5, 9, 23, 60, 150):
            low, segments, spare = nj.bands(percent, 1 << 10)
            for _ in range(60):
                a = rng.integers(0, 1 << 63, size).astype(np.uint64)
                changed = rng.integers(0, size // 2 + 1)
                b = np.concatenate([a[changed:], rng.integers(0, 1 << 63, rng.integers(0, changed + 1)).astype(np.uint64)])
                common = size - changed
                if not len(b) or 100 * common < percent * (size + len(b) - common):
                    continue
                rows = nj.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, size, size + len(b)]), percent)
                own = [{int(g) for g, s in zip(rows["group"], rows["set"]) if s == i} for i in (0, 1)]
                assert own[0] & own[1]
                found += 1
                with_empty += len(own[0]) < 2 * segments.max()
    assert found > 100 and with_empty


def brute(rows, n=3, percent=90):
    """Component and set size of each row, by comparing all pairs."""
    def grams(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    sets = [grams(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], len(s), least[find(i)]) for i, (r, s) in enumerate(zip(rows, sets)))


def copies(rng, n, words, most_edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(most_edits + 1)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        yield " ".join(own)


def corpus(seed=3):
    rng = random.Random(seed)
    texts = [t for n, words, edits in ((60, 150, 14), (25, 40, 3), (12, 12, 1), (8, 5, 1), (5, 400, 30))
             for t in copies(rng, n, words, edits)]
    shared = " ".join(f"p{i}" for i in range(70))
    texts += [shared + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 80))) for _ in range(25)]
    texts += [None, "", "  \n\t", "one", "one", "ONE", "one two", "One\x0btwo", "a b c", "A b\nc", "é b c", "É b c"]
    texts += [texts[0]] * 3 + [texts[70]] * 2
    rng.shuffle(texts)
    return [(i, t, "clash", i) for i, t in enumerate(texts)]


@pytest.mark.parametrize("small_group,n,percent", [(64, 3, 90), (4, 3, 90), (16, 5, 80)])
def test_components_equal_brute_force(spark, monkeypatch, small_group, n, percent):
    monkeypatch.setattr(nj, "SMALL_GROUP", small_group)
    rows = corpus()
    got = nj.similar(spark.createDataFrame(rows, SCHEMA).repartition(3), n=n, percent=percent).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, n, percent)


def test_one_document_of_each_group_stays_with_its_columns(spark):
    rows = corpus(4)
    docs = spark.createDataFrame(rows + rows[:5], SCHEMA)
    kept = nj.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, c in brute(rows) if d == c)


def test_empty_table_and_null_keys(spark):
    assert nj.similar(spark.createDataFrame([], SCHEMA)).collect() == []
    got = nj.similar(spark.createDataFrame([(None, "a b c d", "", 1), (4, "a b c d", "", 1), (None, None, "", 1)], SCHEMA))
    assert sorted(map(tuple, got.collect()), key=str) == [(4, 2, 4), (None, 0, None), (None, 2, 4)]


def test_allocation_of_any_kind_keeps_all_pairs():
    """Two sets that differ in at most H n-grams share a signature, with segments at 0 and 2 too."""
    rng = np.random.default_rng(5)
    for size in (12, 60, 200):
        low, segments, _ = nj.bands(90, 1 << 10)
        band = int(np.searchsorted(low, size, side="right") - 1)
        for trial in range(40):
            a = rng.integers(0, 1 << 63, size).astype(np.uint64)
            b = a.copy()
            lost = rng.integers(0, max(1, size // 20) + 1)
            b[:lost] = rng.integers(0, 1 << 63, lost).astype(np.uint64)
            common = len(set(a.tolist()) & set(b.tolist()))
            if 100 * common < 90 * (2 * size - common):
                continue
            m = int(segments[band])
            parts = {i: (0 if i % 2 else 2) for i in range(m - m % 2)} if trial % 2 else {}
            rows = nj.signatures(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, size, 2 * size]), 90, {band: parts})
            own = [{(int(g), bool(d)) for g, s, d in zip(rows["group"], rows["set"], rows["deleted"]) if s == i}
                   for i in (0, 1)]
            assert any(g == h and not (d and e) for g, d in own[0] for h, e in own[1])


def test_allocation_moves_work_to_cheap_segments(spark):
    rows = [(1, i % 5, i, i, 100) for i in range(50)] + [(1, 3, 999, c, 100) for c in range(3000)]
    shared = spark.createDataFrame(rows, "scheme int, segment int, group long, class long, size int")
    moved = nj.allocation(shared, 90)
    assert set(moved) <= {1}
    for parts in moved.values():
        assert parts[3] == 0 and sum(a - 1 for a in parts.values()) == 0


def test_sketches_differ_in_no_more_buckets_than_sets_in_ngrams():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 3000, n).astype(np.uint64)) for n in (0, 1, 40, 900, 900, 2500)]
    sets.append(sets[3][:-5])
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    rows = nj.sketches(np.concatenate(sets), starts).view(np.uint64)
    for x, a in zip(sets, rows):
        for y, b in zip(sets, rows):
            assert sum(int(w).bit_count() for w in a ^ b) <= len(np.setxor1d(x, y))


def test_ngrams_of_pairs_that_cannot_link_are_not_read(spark, monkeypatch):
    """Half of each text is the same: the texts share segments, and their sketches show that they differ in too much."""
    read, write = [], nj.materialise

    def spy(df, label):
        out = write(df, label)
        if label in ("stars", "links"):
            read.append(out.count())
        return out

    monkeypatch.setattr(nj, "materialise", spy)
    common = [f"c{i}" for i in range(300)]
    docs = [(k, " ".join(common + [f"w{k}x{i}" for i in range(300 - k)])) for k in range(40)]
    docs += [(100 + k, " ".join([*common, *[f"w0x{i}" for i in range(300 - k)]])) for k in range(1, 4)]
    got = {r.doc_id: r.component_id for r in nj.similar(
        spark.createDataFrame(docs, "doc_id long, text string"), n=5, percent=80).collect()}
    assert got == {k: 0 if k > 100 else k for k, _ in docs}
    assert sum(read) <= 6  # the four alike; all pairs of a pivot were read before


def test_signatures_come_in_parts_that_are_all_of_them(spark):
    docs = spark.createDataFrame(corpus(5), SCHEMA).repartition(2)
    whole = nj._signature_rows(docs, 3, 90, None).collect()
    parts = [nj._signature_rows(docs, 3, 90, None, part).collect() for part in range(nj.PARTS)]
    assert sorted(map(tuple, whole)) == sorted(tuple(r) for rows in parts for r in rows)
    groups = [{r.group for r in rows} for rows in parts]
    assert all(groups) and len(set().union(*groups)) == sum(map(len, groups))


def test_ngrams_are_made_for_classes_of_pairs_alone_and_no_text_is_shuffled(spark, monkeypatch):
    """Texts of one half in common share segments, but only the few with like sketches have their n-grams read."""
    made, write, sets = [], nj.materialise, nj._sets

    def spy(docs, wanted, n, what):
        if what == "grams":
            made.append(wanted.count())
        return sets(docs, wanted, n, what)

    def no_grams(df, label):
        assert "grams" not in df.columns
        return write(df, label)

    monkeypatch.setattr(nj, "materialise", no_grams)
    monkeypatch.setattr(nj, "_sets", spy)
    common = [f"c{i}" for i in range(300)]
    docs = [(k, " ".join(common + [f"w{k}x{i}" for i in range(300 - k)])) for k in range(40)]
    docs += [(100 + k, " ".join([*common, *[f"w0x{i}" for i in range(300 - k)]])) for k in range(1, 4)]
    docs += [docs[-1], (5, docs[0][1]), (5, docs[5][1])]  # a repeated row; a key of two texts; a repeated row
    kept = nj.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"), n=5, percent=80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*range(40), 5])
    assert 0 < sum(made) <= 8
    whole = [x for x in kept._jdf.queryExecution().executedPlan().toString().split("\n") if "SortMergeJoin" in x]
    assert not whole, "documents are joined by a shuffle of their texts"


def test_pairs_are_checked_in_passes_of_few_ngrams(spark, monkeypatch):
    """With little room for n-grams at once, there are more passes and the same components."""
    tables, write = [], nj.materialise

    def spy(df, label):
        out = write(df, label)
        if label == "stars":
            tables.append(out.count())
        return out

    monkeypatch.setattr(nj, "materialise", spy)
    monkeypatch.setattr(nj, "PASS_SHARE", 0.05)
    rows = corpus(6)
    got = nj.similar(spark.createDataFrame(rows, SCHEMA).repartition(3), n=3, percent=90)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    assert len(tables) > 2 and max(tables) < sum(tables)


def test_changed_schemes_are_dealt_to_parts_by_their_share(spark, monkeypatch):
    """All schemes changed: as many n-grams as twice those of all sets, so twice PARTS; few of them: one part."""
    rows = corpus(7)
    low = nj.bands(90, 1 << 10)[0]
    sizes = spark.createDataFrame([(len(rows), 10), (len(rows), 400), (len(rows), 0)], "key long, n_shingles long")
    of = lambda size: int(np.searchsorted(low, size, side="right") - 1)
    assert nj._parts_of(sizes, 90, {of(10): {}}) == 1
    assert nj._parts_of(sizes, 90, {j: {} for j in range(of(400) + 1)}) == 2 * nj.PARTS
    read, signed = [], nj._signature_rows

    def spy(docs, n, percent, changed, part=None, parts=nj.PARTS):
        read.append((changed is not None, part, parts))
        return signed(docs, n, percent, changed, part, parts)

    monkeypatch.setattr(nj, "_signature_rows", spy)
    monkeypatch.setattr(nj, "allocation", lambda shared, percent: {
        j: {0: 0, 1: 2} for j in range(len(low)) if nj.bands(percent, 1 << 10)[1][j] > 3})
    got = nj.similar(spark.createDataFrame(rows, SCHEMA).repartition(3), n=3, percent=90)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)
    assert [part for again, part, _ in read if again] == list(range(read[-1][2])) and read[-1][2] > 1
