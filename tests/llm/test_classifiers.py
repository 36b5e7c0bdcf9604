"""Language ID and passage attention."""

import numpy as np
import pyarrow as pa
from edges import documents, empty
from pyspark.sql import functions as F

from breezeway.llm import langid, mil
from breezeway.llm.common import fold, table
from breezeway.llm.textarrays import chunks


def test_presence_is_the_set_of_ngrams():
    texts = ["Abc", "", "über ab", None, "zzzz"]
    _, t = next(chunks(pa.array(texts)))
    column = np.arange(1 << langid.HASH_BITS, dtype=np.int32)
    got = langid.presence(t, column, 1 << langid.HASH_BITS)
    for i, text in enumerate(texts):
        raw = (text or "").encode().lower()
        grams = {raw[j:j + n] for n in langid.LENGTHS for j in range(len(raw) - n + 1)}
        assert got[i].sum() == len(grams)


def test_language_of_held_out_documents(spark, sf):
    docs = table(spark, sf, "documents").withColumn("held", fold("doc_id", 4) == 2)
    model = langid.fit(docs.where("NOT held").select(F.col("doc_id").alias("key"), "text", "lang"))
    got = docs.where("held").select("lang", langid.predict(model, F.col("text")).alias("p")).collect()
    assert len(got) > 20 and np.mean([r.lang == r.p.lang_pred for r in got]) >= 0.95
    assert all(0 <= r.p.score <= 1 for r in got)


def test_undetermined_texts_and_no_labels(spark):
    docs = documents(spark)
    model = langid.fit(docs.withColumn("key", F.col("doc_id")).select("key", "text", "lang"))
    got = docs.select("doc_id", "text", langid.predict(model, F.col("text")).alias("p")).collect()
    for r in got:
        assert (r.p.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    none = langid.fit(empty(spark).withColumn("key", F.col("doc_id")).select("key", "text", "lang"))
    assert {tuple(r.p) for r in docs.select(langid.predict(none, F.col("text")).alias("p")).collect()} == {("und", 0.0)}


def _bags(seed=0):
    r = np.random.default_rng(seed)
    sizes = np.array([1, 3, 2, 5, 1, 4])
    return r.normal(0, 0.3, (sizes.sum(), mil.FEATURES)), np.concatenate([[0], np.cumsum(sizes)]), r.integers(0, 2, 6) * 1.0


def test_gradients_equal_differences():
    x, first, y = _bags()
    model = mil.train(x, first, y, epochs=1)
    g = mil._gradients(model, x, first, y)
    rng = np.random.default_rng(1)

    def loss():
        s = model.forward(x, first)["score"]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name in g:
        kept, d = model.p[name], rng.normal(0, 1, np.shape(model.p[name]))
        model.p[name] = kept + 1e-5 * d
        up = loss()
        model.p[name] = kept - 1e-5 * d
        assert np.isclose((up - loss()) / 2e-5, (g[name] * d).sum(), rtol=1e-3, atol=1e-7), name
        model.p[name] = kept


def test_one_bad_passage_is_found_by_attention():
    r = np.random.default_rng(2)
    x, sizes, y = [], [], []
    for i in range(200):
        n, bad = r.integers(2, 9), i % 2
        bag = r.normal(0, 0.1, (n, mil.FEATURES))
        if bad:
            bag[r.integers(n), :5] += 2
        x.append(bag), sizes.append(n), y.append(bad)
    first = np.concatenate([[0], np.cumsum(sizes)])
    model = mil.train(np.concatenate(x), first, np.array(y, float))
    got = model.forward(np.concatenate(x), first)["score"]
    assert ((got > 0.5) == np.array(y)).mean() > 0.95


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").withColumn("held", fold("doc_id", 5) == 0)
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("label"))
    model = mil.fit(docs.where("NOT held").select(F.col("doc_id").alias("key"), "text"), labels)
    got = docs.where("held").select(F.col("doc_id").alias("key"), mil.score(model, F.col("text")).alias("s")).join(labels, "key").collect()
    assert len(got) > 40 and np.mean([(r.s >= 0.3) == r.label for r in got]) >= 0.95


def test_awkward_texts_and_labels(spark):
    docs = documents(spark).withColumn("key", F.col("doc_id"))
    labels = docs.select("key", F.when(F.col("key") % 5 != 4, F.col("key") % 2).cast("int").alias("label"))
    model = mil.fit(docs.select("key", "text"), labels.unionByName(labels))
    scores = docs.select("key", "text", mil.score(model, F.col("text")).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in scores)
    assert len({r.s for r in scores if not (r.text or "").split()}) == 1
    one = mil.fit(docs.select("key", "text"), labels.withColumn("label", F.lit(1)))
    assert one.prior == 1.0
    assert mil.fit(empty(spark).withColumn("key", F.col("doc_id")).select("key", "text"), labels).prior == 0.5
