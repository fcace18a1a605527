import pytest
import tests_llm_brute

from panelcast.llm import decontam

ITEM = "A train from Berlin leaves at 10 hours and travels 300 km to reach Paris, while 10 hours later another train follows."
OTHER = "Plain words without any number or name stand here to be copied exactly by some document later on."
FILL = "Some quite different prose surrounds the passage and never repeats it in any way at all."


@pytest.fixture
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM, 9), (1, ITEM, 9), (2, OTHER, 9), (3, None, 9), (4, "too short", 9), (5, "", 9)], "item_id long, text string, doc_id long")


CASES = {
    10: f"{FILL}\n{ITEM}\n{FILL}",                                                       # exact
    11: f"{FILL} {ITEM.replace('10', '25').replace('300', '480').replace('Berlin', 'Madrid').replace('Paris', 'Lisbon')}",  # new numbers and names
    12: f"{FILL} {ITEM.replace('10 hours later', '99 hours later')}",                    # one of seven slots differs
    13: ITEM.upper() + " !!",                                                            # other case and punctuation
    14: FILL, 15: None, 16: "", 17: OTHER[:45], 18: f"{FILL} " * 500 + OTHER, 19: f"{OTHER} {ITEM}",
}


def found(rows):
    return {(r["doc_id"], r["item_id"]) for r in rows}


@pytest.mark.parametrize("bound", [decontam.BROADCAST_WINDOWS, 0])
def test_leaks_are_found_and_clean_documents_left(spark, benchmark, bound):
    docs = spark.createDataFrame([(k, t, 1) for k, t in CASES.items()] + [(10, CASES[10], 1), (None, OTHER, 1)], "doc_id long, text string, item_id long")
    out = decontam.leaks(docs, benchmark, bound).collect()
    assert found(out) == {(10, 1), (11, 1), (12, 1), (18, 2), (19, 1), (19, 2), (None, 2)} | ({(13, 1)} & found(out))
    flags = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in out}
    assert flags[11, 1] and not flags[10, 1] and not flags[18, 2]
    kept = decontam.clean(docs, benchmark)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {14, 15, 16, 17}


def test_slots_must_be_consistent(spark):
    """Equal item values must meet equal document values; four different ones are another text."""
    text = "take {} green apples and {} green pears then add {} ripe plums and {} ripe figs before you count them all again."
    benchmark = spark.createDataFrame([(1, text.format(7, 7, 7, 7))], "item_id long, text string")
    docs = spark.createDataFrame([(1, text.format(9, 9, 9, 9)), (2, text.format(1, 2, 3, 4)), (3, text.format(7, 7, 7, 7))], "doc_id long, text string")
    assert found(decontam.leaks(docs, benchmark).collect()) == {(1, 1), (3, 1)}


@pytest.mark.parametrize("bound", [decontam.BROADCAST_WINDOWS, 0])
def test_exact_copies_match_in_any_case_with_any_slots(spark, bound):
    sums = "12 plus 30 equals 42 and 7 times 6 equals 42"
    names = "Meet Anna Berta Carla Doris Emma Frieda Greta Hanna Ida"
    items = {1: ITEM, 2: OTHER, 3: sums, 4: names, 5: "2 + 2 = 4", 6: "Capital of France?", 7: "Yes"}
    texts = {1: f"{FILL} {ITEM.upper()} {FILL}", 2: ITEM.lower(), 3: f"{FILL} {sums.upper()}", 4: f"{FILL} {names.lower()}", 5: f"{FILL} Now 2 + 2 = 4 of course", 6: f"{FILL} CAPITAL of france",
             7: f"{FILL} Yes.", 8: OTHER.replace("exactly", "literally"), 9: OTHER.replace("number", "figure"), 10: ITEM.upper().replace("300", "480"),
             11: " ".join(OTHER.split()[:9]), 12: OTHER.replace("any", "some").replace("stand", "are").replace("exactly", "fully").replace("later", "just")}
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert found(decontam.leaks(docs, benchmark, bound).collect()) == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (8, 2), (9, 2), (10, 1)}


def test_empty_tables(spark, benchmark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    assert not decontam.leaks(docs.limit(0), benchmark).collect()
    assert not decontam.leaks(docs, benchmark.limit(0)).collect()
    assert decontam.clean(docs, benchmark.limit(0)).count() == 1


def test_registered_query_equals_brute_force(spark):
    from panelcast.llm.queries import op5_benchmark_decontamination

    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    assert found(op5_benchmark_decontamination(spark, d).collect()) == tests_llm_brute.leaks(docs, items)


def test_documents_of_one_id_or_none_are_judged_apart(spark):
    words = [f"w{k}" for k in range(40)]
    item, half, rest = " ".join(words), " ".join(words[:20]), " ".join(words[20:])
    docs = spark.createDataFrame([(None, item, 1), (None, half, 1), (None, rest, 1), (7, half, 1), (7, rest, 1), (8, item, 1), (8, "clean text", 1), (9, "other", 1)], "doc_id long, text string, `odd.name` int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()) == [(False, 8, 1), (True, None, 1)]
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("None", half), ("None", rest), ("7", half), ("7", rest), ("8", "clean text"), ("9", "other")])
