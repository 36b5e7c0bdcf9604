"""Quality rules against DuckDB and their sketches."""

import random

import duckdb
import pytest
from edges import documents, empty
from pyspark.sql import functions as F

from breezeway.llm import quality
from breezeway.llm.quality_sql import QUALITY_SQL

NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def in_duckdb(docs):
    pdf = docs.select("doc_id", "text", "lang", "source").dropna(subset=["doc_id"]).dropDuplicates(["doc_id"]).toPandas()
    con = duckdb.connect()
    con.register("documents", pdf)
    return con.execute(QUALITY_SQL).df()[NAMES]


def test_counts_and_verdicts_equal_sql(spark):
    docs = documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = quality.judge(docs).select(*NAMES).toPandas().sort_values("doc_id").reset_index(drop=True)
    want = in_duckdb(docs).sort_values("doc_id").reset_index(drop=True)
    for c in NAMES:
        assert got[c].tolist() == want[c].tolist(), c


def test_filter_keeps_what_the_verdict_keeps(spark):
    docs = documents(spark)
    out = quality.filtered(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    verdicts = quality.judge(docs).where("kept")
    assert sorted(r.doc_id or -1 for r in out.collect()) == sorted(r.doc_id or -1 for r in verdicts.collect())
    assert quality.filtered(empty(spark)).count() == quality.judge(empty(spark)).count() == 0


PROSE = "the other day and then some more of these words were with their old friends near a small quiet river bank again"


def prose(rng, n=60):
    return " ".join(rng.sample(PROSE.split(), 12)[i % 12] + rng.choice(["", "s", "ed", "ing", "ly", "er"]) + str(rng.randrange(50))
                    for i in range(n))


PLANTED = {
    "symbol_share": lambda rng: prose(rng) + " ## $$ && ** ##",
    "dup_line_share": lambda rng: prose(rng) + "\n" + "\n".join([f"line {rng.randrange(99)}", "x y"] * 2),
    "repeat_share": lambda rng: prose(rng, 40) + " alpha beta gamma delta eta theta iota kappa" * 2 + " " + prose(rng, 30),
    "same_word_share": lambda rng: prose(rng) + " very very very very very very",
    "capital_share": lambda rng: prose(rng) + " SOME CAPITAL WORDS STAND HERE AND THERE",
    "mark_share": lambda rng: prose(rng) + " !!! ??? !!!",
}


@pytest.mark.parametrize("measure", list(quality.MEASURES))
def test_each_rule_fires_in_a_clean_source_and_spares_a_usual_one(spark, measure):
    """The same text goes where nothing like it is found and stays where two fifths are like it."""
    rng = random.Random(7)
    rows = [(i, prose(rng), "en", "clean") for i in range(200)]
    rows += [(1000 + i, PLANTED[measure](rng) if i % 5 < 2 else prose(rng), "en", "usual") for i in range(200)]
    text = PLANTED[measure](rng)
    rows += [(5000, text, "en", "clean"), (6000, text, "en", "usual")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    judged = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert not judged[5000].kept and not judged[5000].base_failed and judged[6000].kept
    assert judged[5000][measure] > judged[5000][f"most_{measure}"]
    assert judged[5000][f"most_{measure}"] < judged[6000][f"most_{measure}"]
    assert sum(r.kept for r in judged.values()) >= 0.97 * len(rows)


@pytest.mark.parametrize("value,lower", [(0, 0), (31, 31), (32, 32), (33, 32), (63, 62), (64, 64), (1000, 992)])
def test_buckets_keep_leading_bits(spark, value, lower):
    assert spark.range(1).select(quality.bucket(F.lit(value)).alias("b")).first().b == lower


def test_sketches_merge(spark):
    rows = [("en", f"s{i % 3}", i * i % 900) for i in range(500)]
    one = ", ".join(f"'{m}', v" for m in quality.MEASURES)
    df = spark.createDataFrame(rows, "lang string, source string, v long").selectExpr(
        "lang", "source", f"named_struct({one}) measures")
    whole = quality.quantiles(quality.sketches(df), ["lang"], (500, 750)).where("measure = 'mark_share'").first()
    halves = quality.sketches(df.where("v % 2 = 0")).unionByName(quality.sketches(df.where("v % 2 = 1")))
    parts = quality.quantiles(halves, ["lang"], (500, 750)).where("measure = 'mark_share'").first()
    assert whole == parts
    exact = sorted(r[2] for r in rows)
    for q, got in ((0.5, whole.q0), (0.75, whole.q1)):
        true = exact[int(q * 500) - 1]
        assert true * 15 / 16 <= got <= true
