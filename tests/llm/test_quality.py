import re

from panelcast.llm import quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


PROSE = "This is a plain sentence with enough words to be read.\nAnother line of the same text follows it here, and it ends well."
TEXTS = [None, "", " \n\t", "one", PROSE, PROSE + "\nAll rights reserved.", " ".join(f"w{i % 9}" for i in range(60)) + ".",
         " ".join("a b c d e f g h".split() * 3), "Home | News | About | Contact\n" + PROSE, "\x0bvt\x0cff\x1cfs nb é ß 漢字 🙂\r\n" + PROSE,
         "\n".join(["same line here."] * 5 + [PROSE]), "THE!! WORD!! IS!! LOUD!! " * 10, " | ".join(f"item{i}" for i in range(40)), "x### y$$$ z%%% " * 12,
         " ".join(f"long{i}" for i in range(30000)) + " " + " ".join(f"long{i}" for i in range(12)) + "."]


def test_counts_equal_brute_force_and_cases_are_defined(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, PROSE, 7)], "doc_id long, text string, n_words long")
    rows = quality.report(docs).collect()
    for r in rows:
        text = PROSE if r["doc_id"] is None else TEXTS[r["doc_id"]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(text), text
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert kept == {None, 4, 5, 8, 9, 14}
    assert not quality.report(docs.limit(0)).collect()


def test_failing_lines_are_removed_and_other_columns_pass(spark):
    docs = spark.createDataFrame([(1, "Home | News | About | Contact\n" + PROSE + "\nRead more at the site.", "s")], "doc_id long, text string, lines string")
    r = quality.judge(docs).first()
    assert r["quality"]["clean_text"] == PROSE and r["lines"] == "s"


def test_oracle_sql_agrees(spark):
    import duckdb

    from panelcast.llm.queries import op3_quality_rules

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    res = con.execute(quality.REPORT_SQL)
    names = [d[0] for d in res.description]
    mine = op3_quality_rules(spark, "/root/testdata/sf0.001").select(*names).collect()
    assert sorted(map(tuple, mine)) == sorted(res.fetchall())
