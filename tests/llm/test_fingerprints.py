"""Bottom-k sketches against exact sets."""

import hashlib

import pytest
from edges import documents, empty
from pyspark.sql import functions as F

from breezeway.llm import fingerprints as fp


def shingles(text):
    w = (text or "").encode().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_edited_texts_and_likeness(spark):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").distinct().collect()
    order = sorted((r for r in rows if r.doc_id is not None), key=lambda r: -r.doc_id)
    # null keys come first in descending order; of rows that share a key the least text is the next
    order = [min((r for r in rows if r.doc_id is None), key=lambda r: r.text or ""), *order]
    following = {a.doc_id: b.text or "" for a, b in zip(order, order[1:] + order[:1])}
    got = fp.compare_with_next(docs).withColumn("sha", F.sha2("edited", 256)).collect()
    assert len(got) == docs.count()
    texts = {(r.doc_id, len(r.text or "")): r.text or "" for r in rows}
    for r in got:
        text = texts[r.doc_id, r.n_chars]
        half = len(text) // 2
        edited = text[:len(text) - half] + following[r.doc_id][:half]
        assert r.sha == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(text), shingles(edited), shingles(following[r.doc_id])
        exact = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        small = len(a | b) <= fp.K
        assert r.near_edited == pytest.approx(exact(a, b), abs=1e-9 if small else 0.2)
        assert r.near_next == pytest.approx(exact(a, c), abs=1e-9 if len(a | c) <= fp.K else 0.2)
    assert len({r.fingerprint for r in got if r.doc_id == 3}) == 1
    assert fp.compare_with_next(empty(spark)).collect() == []


def test_single_document_is_its_own_next(spark):
    got = fp.compare_with_next(spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")).first()
    assert got.near_next == 1.0 and got.edited == "a b ca b c"[:11] or len(got.edited) == 11


def test_parts_merge_into_the_whole(spark):
    words = [f"w{i}" for i in range(3000)]
    parts = [(i % 2, " ".join(words[a:a + 304])) for i, a in enumerate(range(0, 2700, 300))]
    df = spark.createDataFrame(parts, "g int, text string").withColumn("s", fp.sketch(F.col("text")))
    merged = {r.g: r.s for r in fp.merge_by(df, ["g"], "s").collect()}
    for g, whole in merged.items():
        sets = set().union(*[shingles(t) for k, t in parts if k == g])
        every = df.where(F.col("g") == g).select(F.explode(fp.shingle_hashes(F.col("text"))).alias("h")).distinct()
        assert whole == sorted(r.h for r in every.collect())[:fp.K]
        n = spark.createDataFrame([(whole,)], "s array<bigint>").select(fp.distinct_count(F.col("s")).alias("n")).first().n
        assert abs(n - len(sets)) < 0.35 * len(sets)


def test_containment(spark):
    words = [f"w{i}" for i in range(1000)]
    row = spark.createDataFrame([(" ".join(words[:250]), " ".join(words), "")], "a string, b string, e string").select(
        *[fp.sketch(F.col(c)).alias(c) for c in "abe"])
    got = row.select(fp.containment(F.col("a"), F.col("b")).alias("ab"), fp.containment(F.col("b"), F.col("a")).alias("ba"),
                     fp.containment(F.col("e"), F.col("a")).alias("ea"), fp.resemblance(F.col("e"), F.col("a")).alias("r")).first()
    assert got.ab == pytest.approx(1, abs=0.3) and got.ba == pytest.approx(0.25, abs=0.15) and got.ea == 1 and got.r == 0
