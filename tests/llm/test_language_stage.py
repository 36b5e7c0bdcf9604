"""The pipeline's language stage with planted texts of languages that were not learned."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from breezeway.llm import langid
from breezeway.llm.common import table

OTHER = {
    "ru": "Широкая электрификация южных губерний даст мощный толчок подъёму сельского хозяйства. " * 4,
    "zh": "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心,并应以兄弟关系的精神相对待。" * 5,
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni "
          "rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. " * 2,
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki "
          "ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. " * 2,
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és "
          "lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. " * 2,
    "letters": "xq zzkw vvpt qqj kkz wxq jjq zxv kqp wvz " * 8,
}


def planted(docs):
    rows = [(-2 - i, t, None, "s", len(t)) for i, t in enumerate(OTHER.values())]
    return docs.sparkSession.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_unlearned_languages_go_and_clean_texts_stay(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    clean = docs.where("lang IS NOT NULL AND n_chars >= 200")
    out = corpus_pipeline.language(spark, docs.unionByName(planted(docs).select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text", "lang", "source",
        F.col("n_chars").cast(docs.schema["n_chars"].dataType).alias("n_chars"))), sf)
    assert out.where("doc_id < 0").collect() == []
    assert out.join(clean.select("doc_id"), "doc_id", "left_semi").count() >= 0.99 * clean.count()


def test_a_whole_language_that_was_not_learned(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    for lang in ("de", "es", "fr"):
        hidden = docs.withColumn("was", F.col("lang")).withColumn("lang", F.when(F.col("lang") != lang, F.col("lang")))
        out = corpus_pipeline.language(spark, hidden, sf).cache()
        n = {r.was: r["count"] for r in docs.where("n_chars >= 200").groupBy(F.col("lang").alias("was")).count().collect()}
        left = {r.was: r["count"] for r in out.where("n_chars >= 200").groupBy("was").count().collect()}
        assert left.get(lang, 0) <= 0.05 * n[lang], lang
        assert all(left[k] >= 0.98 * n[k] for k in n if k not in (lang, None)), lang


def test_bounds_come_from_texts_of_every_language(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").where("n_chars >= 200")
    model = langid.fit(docs.select(F.col("doc_id").alias("key"), "text", "lang"))
    assert len(model.languages) == 4 and (model.clear_lead > 0.9).all() and (model.least_lead > 0.4).all()
