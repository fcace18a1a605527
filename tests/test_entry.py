import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["labeled_rows"] > 0


def test_every_sql_key_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
