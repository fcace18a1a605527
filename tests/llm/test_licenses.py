import pytest
from pyspark.sql import functions as F

from panelcast.llm import licenses

PROSE = [f"The {a} went to the {b} and found that the {c} was under the table in all of the rooms." for a in ("cat", "dog", "man", "boy") for b in ("house", "river", "town") for c in ("book", "key", "cup", "map")]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(i, "\n".join([t, t.upper(), t[::-1]])) for i, t in enumerate(PROSE)], "doc_id long, text string")
    return licenses.fit(docs)


def test_families_unknown_class_and_cases(spark, model):
    rows = [(1, "Some prose here.\nReleased under the MIT License.\nMore prose.", 0), (2, "licensed UNDER the apache license, version 2.0!", 0), (3, None, 0), (4, "", 0),
            (5, "You need a driver license to drive to the public house.", 0), (6, "All rights reserved.\n\nAll rights reserved.", 0), (6, "All rights reserved.\n\nAll rights reserved.", 0),
            (None, "Licensed under CC BY-NC 4.0.", 0), (7, ("plain words of the text " * 3000) + "\nThis work is licensed under the GNU General Public License, version 3.", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, paragraph int")
    out = sorted(((r["doc_id"], r["paragraph"], r["family"], r["confirmed"]) for r in licenses.scan(docs, model).collect() if r["confirmed"]), key=str)
    assert out == sorted([(1, 1, "mit", True), (2, 0, "apache-2.0", True), (None, 0, "cc-by-nc", True), (7, 1, "gpl", True)] + [(6, k, "proprietary", True) for k in (0, 2)] * 2, key=str)
    assert not licenses.scan(docs.limit(0), model).collect()


def test_needles_drop_only_unknown_paragraphs(spark, model):
    """Scoring all lines without the prefilter calls the same ones."""
    rows = [(i, t) for i, t in enumerate(PROSE + [x for texts in licenses.TEMPLATES.values() for x in texts] + licenses.NEAR_MISSES)]
    lines = spark.createDataFrame(rows, "id long, line string").withColumn("grams", licenses._grams(licenses.words_of(F.col("line"))))
    called = {r["id"] for r in licenses._probabilities(lines, model, ["id"]).filter(1 - F.col("p")[len(model.classes) - 1] >= 0.5).collect()}
    needles = set(model.needles)
    for i, text in rows:
        if i in called:
            import re

            assert needles & set(re.split(r"[^\w]+", text.lower())), text


def test_empty_corpus_still_fits(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan_licenses(docs).count() == 0


def test_every_line_counts_for_the_unknown_class(spark):
    """Many more documents and lines than a sample would hold; copies count, licence lines don't."""
    rows = [(i, "\n".join([f"the version {k % 7} of the software is a work" for k in range(5)] + ["", "Released under the MIT License.", "plain words"])) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(spark.createDataFrame([(None, None), (1, "")], "doc_id long, text string")).repartition(4)
    found = licenses.unknown_lines(docs, ["software", "version", "the software", "mit license"], ["released under the", "under the mit", "the mit license"]).collect()
    assert sum(r["n"] for r in found) == 6000 * 6
    assert {tuple(r["grams"]) for r in found} == {(), ("software", "the software", "version")}
    assert 0.2 < sum(r["n"] for r in found if r["held"]) / 36000 < 0.46


def test_accepting_probability_counts_all_held_lines(spark, model):
    mit = licenses._grams(licenses.words_of(F.lit("Released under the MIT License.")))
    held = lambda n: spark.range(1).select(F.array().cast("array<string>").alias("grams"), F.lit(100_000).alias("n")).unionByName(spark.range(1).select(mit.alias("grams"), F.lit(n).alias("n")))
    assert licenses.accepting(held(50), model) == 0.5  # fewer than a thousandth
    assert licenses.accepting(held(500), model) > 0.5


def test_registered_query_finds_every_planted_notice(spark):
    """Held against the sentences that the test tables plant; no other line may be called."""
    from panelcast.llm.queries import op9_license_scans

    planted = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit",
               "This work is licensed under the GNU General Public License, version 3.": "gpl", "All rights reserved.": "proprietary"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    want = sorted((d["doc_id"], k, planted[line]) for d in docs for k, line in enumerate((d["text"] or "").split("\n")) if line in planted)
    got = sorted((r["doc_id"], r["paragraph"], r["family"]) for r in op9_license_scans(spark, "/root/testdata/sf0.01").collect())
    assert got == want
