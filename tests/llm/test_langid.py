from pyspark.sql import functions as F

from panelcast.llm import langid

EN = "the cat and the dog went with other people to this house that they have on thing"
DE = "der hund und die katze gehen mit anderen menschen nicht in das haus das sie auch haben"


def test_cases_are_defined(spark):
    rows = [(i, f"{EN} {i} another line" if i % 2 else f"{DE} {i} noch eine zeile", "en" if i % 2 else "de", i) for i in range(60)]
    rows += [(100, None, "en", 1), (101, "", "de", 1), (102, "12 34 --", "en", 1), (103, EN * 2000, None, 1), (104, "漢字漢字漢字", None, 1), (None, EN, "en", 1), (1, f"{EN} 1 another line", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    out = langid.identify(docs).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 and by[i]["rejected"] for i in (100, 101, 102))
    assert by[103]["lang_pred"] == by[None]["lang_pred"] == "en" and not by[103]["rejected"]
    assert by[104]["rejected"] and by[104]["lang_pred"] in ("de", "en")
    assert all(by[i]["lang_pred"] == ("en" if i % 2 else "de") and not by[i]["rejected"] and 0 <= by[i]["score"] <= 1 for i in range(60))
    assert not langid.identify(docs.limit(0)).collect()
    untaught = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in untaught} == {"und"}


def test_only_taught_rows_matter(spark):
    """Held-out languages must not change any prediction."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    wrong = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "en").otherwise(F.col("lang")))
    again = {r["doc_id"]: r for r in langid.identify(wrong).collect()}
    assert out == again


def test_held_out_accuracy(spark):
    from panelcast.llm.queries import op4_language_id

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    r = op4_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out").agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert r[0] > 0.98 and r[1] < 0.02


def test_number_signs_are_no_letters():
    assert not langid.LETTER.search("½ ² 12 Ⅷ ①") and langid.LETTER.search("é") and langid.LETTER.search("字")
