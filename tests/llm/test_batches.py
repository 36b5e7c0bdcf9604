"""Texts reach Python workers in batches of bounded bytes, with the same results."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from breezeway import session
from breezeway.llm import binary_output, ngram_join, packing

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def long_texts(spark):
    """400 texts of 32 KB in one partition, 13 MB."""
    text = F.concat_ws(". ", F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda i: F.md5(F.concat_ws("-", "id", i).cast("binary"))))
    return spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.substring(text, 1, 32_000).alias("text"))


def sizes(docs):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["bytes", "rows"])

    return docs.mapInArrow(run, "bytes long, rows long").collect()


@pytest.mark.parametrize("operator", [
    packing.pack, binary_output.pack_rows, lambda docs: ngram_join.similar(docs.limit(2))])
def test_batches_of_long_texts_are_small(spark, operator):
    docs = long_texts(spark.newSession())
    assert sum(r.rows for r in sizes(docs)) == 400 and max(r.bytes for r in sizes(docs)) > 12e6
    operator(docs)
    found = sizes(docs)
    assert sum(r.rows for r in found) == 400 and max(r.bytes for r in found) < 8e6


def test_a_limit_of_the_session_stays_and_results_do_not_depend_on_it(spark):
    rows = []
    for limit in (None, 100_000, 1 << 30):
        own = spark.newSession()
        if limit:
            own.conf.set(LIMIT, limit)
        rows.append(packing.pack(long_texts(own)).collect())
        assert int(own.conf.get(LIMIT)) == (limit or session.BATCH_BYTES)
    assert rows[0] == rows[1] == rows[2]
