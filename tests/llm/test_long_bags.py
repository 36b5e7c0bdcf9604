"""Passages of very long documents: as long as those of short ones, and scored in stretches."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from breezeway.llm import mil
from breezeway.llm.textarrays import chunks

r = random.Random(5)
WORDS = ["the", "The", "a", "a", "of,", "über", "12", "###", "x" * 300]
LONG = " ".join(r.choice(WORDS) for _ in range(30_000))


def texts(text):
    return next(chunks(pa.array([text]), raw=True))[1]


def test_passages_of_long_documents_are_of_64_words():
    x, first = mil.passages(texts(LONG))
    assert first.tolist() == [0, -(-30_000 // 64)]
    words = LONG.split()
    for i in (0, 100, 468):
        alone = mil.passages(texts(" ".join(words[64 * i:64 * i + 64])))[0][0]
        again = words[64 * i] == words[64 * i - 1] if i else False
        alone[-4] += again / len(words[64 * i:64 * i + 64])
        assert np.allclose(x[i], alone, atol=1e-6)


@pytest.mark.parametrize("text", [
    LONG, LONG + "  ", " " * 5000 + LONG[:9000] + "\n" * 5000, "", " " * 5000, "y" * 9000, "y" * 9000 + " z" * 200,
    "w " * 128, " ".join(["é"] * 641)])
@pytest.mark.parametrize("size", [50, 1000, 4096])
def test_stretches_give_all_passages(text, size):
    whole = mil.passages(texts(text))[0]
    parts = [mil.passages(*part)[0] for part in mil.strips(texts(text), size)]
    assert np.allclose(np.concatenate(parts), whole, atol=1e-6)


def test_scores_in_stretches_equal_those_of_whole_bags(spark):
    x, first = mil.passages(next(chunks(pa.array([LONG[:3000], LONG[4000:9000], "a b", "c " * 90]), raw=True))[1])
    model = mil.train(x, first, np.array([0.0, 1, 1, 0]), epochs=20)
    bag = mil.passages(texts(LONG))[0].astype(np.float64)
    want = model.forward(bag, np.array([0, len(bag)]))["score"][0]
    assert np.isclose(model.of_strips(np.array_split(bag, 13)), want, atol=1e-12)
    million = " ".join([LONG] * 4)
    assert len(million.encode()) > 1 << 20
    df = spark.createDataFrame([(million,), (LONG,), ("a b",)], "text string").coalesce(1)
    got = [row.s for row in df.select(mil.score(model, F.col("text")).alias("s")).collect()]
    for text, s in zip((million, LONG, "a b"), got):
        bag = mil.passages(texts(text))[0].astype(np.float64)
        assert np.isclose(s, model.forward(bag, np.array([0, len(bag)]))["score"][0], atol=1e-4)
