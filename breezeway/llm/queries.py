"""Registered queries of the training-data operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from breezeway.llm import (
    binary_output, fingerprints, langid, lm, merkle, mil, mixing, ngram_join, packing, quality, repeats,
    search, url_filter, url_sql,
)
from breezeway.llm.common import fold, table
from breezeway.llm.merkle_sql import MERKLE_SQL
from breezeway.llm.quality_sql import QUALITY_SQL
from breezeway.llm.search_sql import SEARCH_SQL

Query = Callable[[SparkSession, str], DataFrame]


def op1_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document, learned from six folds of seven."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 7) != 2).alias("training"))
    return lm.score(docs).select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_url_list_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List entries active when each page was fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.select(F.col("page_id").alias("key"), "url", url_sql.fetched(F.col("page_id")).alias("at"))
    return url_filter.active_entries(captures, url_sql.changes(pages)).select(
        F.col("key").alias("page_id"), "host", F.col("at").alias("fetched_at"), "blocked", "n_entries", "entry",
        F.col("since").alias("listed_at"))


def op3_pack_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judge(docs).select("doc_id", *names)


def op5_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    compared = fingerprints.compare_with_next(table(spark, sf_dir, "documents"))
    return compared.withColumn("edited_sha256", F.sha2("edited", 256)).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three folds of four."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold("doc_id", 4) == 2).alias("held_out"))
    model = langid.fit(docs.where("NOT held_out").select(F.col("doc_id").alias("key"), "text", "lang"))
    return docs.select("doc_id", "held_out", langid.predict(model, F.col("text")).alias("_p")).select(
        "doc_id", "held_out", "_p.lang_pred", "_p.score")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under Jaccard 0.9 of 3-word shingles."""
    return ngram_join.similar(table(spark, sf_dir, "documents"), n=3, percent=90)


def op8_quality_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from four folds of five."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("label"))
    model = mil.fit(docs.where("NOT held_out").select(F.col("doc_id").alias("key"), "text"), labels)
    scored = docs.select("doc_id", "held_out", mil.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_binary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed id rows of every document."""
    return binary_output.pack_rows(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, carry=["doc_id"]).select(
        "doc_id", "mixed.size", "mixed.source_size", "mixed.target",
        (F.col("mixed.copies") * F.col("mixed.size")).alias("taken"))


def op11_cut_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document without spans of 35 words that occur again."""
    return repeats.without_repeats(table(spark, sf_dir, "documents"), window=35)


def op12_search_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), top=20)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, checked against a tampered text for each third one."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = docs.select("doc_id", "lang", merkle.leaf(*fields, F.col("text")).alias("leaf"),
                       F.when(tampered, merkle.leaf(*fields, lowered)).alias("altered"))
    tree = merkle.manifest(rows, group="lang", order="doc_id", node="leaf", carry=["altered"])
    return tree.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof(F.col("siblings")).alias("proof_sha256"),
        merkle.folded(F.coalesce("altered", "leaf"), F.col("siblings")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (
    op1_recurrent_lm, op2_url_list_in_time, op3_pack_in_order, op4_quality_rules,
    op5_bottom_k, op6_language, op7_ngram_jaccard,
    op8_quality_bags, op9_binary_rows,
    op10_mix_sources, op11_cut_repeats, op12_search_bags, op13_merkle_manifest,
)}
ORACLES: dict[str, str] = {"op2_url_list_in_time": url_sql.URL_SQL, "op4_quality_rules": QUALITY_SQL,
                           "op12_search_bags": SEARCH_SQL, "op13_merkle_manifest": MERKLE_SQL}
