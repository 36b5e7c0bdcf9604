"""The pipeline's stages and the registered queries with SQL."""

import corpus_pipeline
import duckdb
from edges import documents, empty

from breezeway.llm.queries import ORACLES, QUERIES


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs = documents(spark).repartition(3)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        out.write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert after.columns == docs.columns, name
            assert after.count() > 20 and after.count() <= 2 * docs.count()
            assert after.exceptAll(docs).count() == 0 or name == "mixing"
        docs = after
    assert docs.where("length > 1024").count() == 0


def test_stages_on_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty(spark), "").count() == 0


def test_near_copies_leave_one_document(spark):
    words = " ".join(f"w{i}" for i in range(300))
    rows = [(i, words + f" tail{i}", "en", "s", 1) for i in range(6)] + [(9, "quite another text of some words", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [0, 9]


def test_queries_equal_their_sql(spark, sf):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in ORACLES.items():
        want = con.execute(sql).df()
        got = QUERIES[name](spark, sf).toPandas()[list(want.columns)]
        a, b = (x.astype(str).sort_values(list(want.columns)).reset_index(drop=True) for x in (got, want))
        assert a.equals(b), name
