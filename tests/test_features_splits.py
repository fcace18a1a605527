import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcast.operators.features import build_features, build_sequences
from panelcast.operators.splits import SplitError, holdout_labels, rolling_folds, split_periods
from panelcast.operators.labels import add_next_period_label
from panelcast.spec import FEATURE_SETS, PRIMARY_RULE, FeatureSet

from conftest import month


def _feats(df, spec, fs=FEATURE_SETS["full_history"]):
    out, names = build_features(df, spec, fs)
    return {(r[0], r[1]): r for r in out.select(spec.entity, spec.period, *names).collect()}, names


def test_window_includes_current_row_and_no_cross_entity_lag(monthly, spec):
    f, names = _feats(monthly, spec)
    r = f[("EL002", month(0))]
    assert r["unscheduled_outages_lag_1"] is None
    assert r["unscheduled_outages_roll_3_mean"] == 0.0
    r2 = f[("EL001", month(2))]
    assert r2["unscheduled_outages_roll_3_mean"] == pytest.approx((0 + 1 + 0) / 3)


def test_future_values_cannot_change_past_features(monthly, spec):
    base, names = _feats(monthly, spec)
    future = monthly.withColumn(spec.unplanned, F.when(F.col(spec.period) > month(4), F.lit(999)).otherwise(F.col(f"`{spec.unplanned}`")))
    changed, _ = _feats(future, spec)
    for key, row in base.items():
        if key[1] <= month(4):
            assert tuple(row) == tuple(changed[key])


def test_age_missing_indicator(monthly, spec):
    df = monthly.withColumn(spec.age, F.when(F.col(spec.period) == month(3), F.lit(None)).otherwise(F.col(f"`{spec.age}`")))
    out, names = build_features(df, spec, FeatureSet("a", include_age=True))
    rows = out.where(F.col(spec.period) == month(3)).select(spec.age, "age_missing").collect()
    assert all(r[0] is None and r[1] == 1 for r in rows)


def test_minimum_history_rule():
    assert FEATURE_SETS["current_only"].minimum_history == 1
    assert FEATURE_SETS["short_history"].minimum_history == 4
    assert FEATURE_SETS["full_history"].minimum_history == 6


def test_sequences_consecutive_and_single_entity(spark, monthly, spec):
    lab = add_next_period_label(monthly, spec, PRIMARY_RULE)
    seq = build_sequences(lab, spec, 3, PRIMARY_RULE.name).collect()
    assert seq and all((r["end_period"].year * 12 + r["end_period"].month) - (r["start_period"].year * 12 + r["start_period"].month) == 2 for r in seq)


def test_holdout_split_and_guarded_labels(spark, tmp_path, monthly, spec):
    lab = add_next_period_label(monthly, spec, PRIMARY_RULE)
    marked = split_periods(lab, spec, "2025-02-01", "2025-04-01", PRIMARY_RULE.name)
    sides = {r["split"]: (r["lo"], r["hi"]) for r in marked.groupBy("split").agg(F.min(spec.period).alias("lo"), F.max(spec.period).alias("hi")).collect()}
    assert sides == {"development": (month(0), dt.date(2025, 1, 1)), "holdout": (dt.date(2025, 2, 1), dt.date(2025, 4, 1))}
    assert marked.where(F.col(PRIMARY_RULE.name).isNull()).count() == 0
    with pytest.raises(SplitError):
        split_periods(lab, spec, "2024-01-01", "2025-04-01", PRIMARY_RULE.name)
    with pytest.raises(PermissionError):
        holdout_labels(marked, "wrong", str(tmp_path / "audit"))
    assert not (tmp_path / "audit").exists()
    for _ in range(2):  # each access leaves a record before labels are returned
        assert holdout_labels(marked, "I_UNDERSTAND_THIS_ACCESSES_THE_FROZEN_TEST_SET", str(tmp_path / "audit")).count() == 6
    assert spark.read.json(str(tmp_path / "audit")).count() == 2
    (tmp_path / "file").write_text("no folder")
    with pytest.raises(Exception):
        holdout_labels(marked, "I_UNDERSTAND_THIS_ACCESSES_THE_FROZEN_TEST_SET", str(tmp_path / "file" / "audit"))


def test_rolling_folds_ordered_disjoint(monthly, spec):
    lab = add_next_period_label(monthly, spec, PRIMARY_RULE).where(F.col(PRIMARY_RULE.name).isNotNull())
    dev = lab.where(F.col(spec.period) < dt.date(2025, 2, 1))
    folds = rolling_folds(dev, spec, 1, 3)
    assert [f.name for f in folds] == ["2024-11_to_2024-11", "2024-12_to_2024-12", "2025-01_to_2025-01"]
    for f in folds:
        assert f.train.agg(F.max(spec.period)).first()[0] < f.validation_start


def test_sequence_cohort_counts(spark, monthly, spec):
    from panelcast.operators.features import sequence_cohort
    lab = add_next_period_label(monthly, spec, PRIMARY_RULE)
    seq = build_sequences(lab, spec, 3, PRIMARY_RULE.name)
    r = sequence_cohort(seq, spec, lab.select(spec.entity)).first()
    assert r["rows"] == 12 and r["entities"] == 2 and r["entities_lost"] == 0


def test_sinks_roundtrip(spark, tmp_path, monthly, spec):
    from panelcast.sources.sinks import read_metrics, write_metrics, write_table
    df = monthly.withColumnRenamed(spec.period, "period").withColumnRenamed(spec.entity, "entity_id").select("entity_id", "period")
    path = str(tmp_path / "t")
    write_table(df, path)
    assert spark.read.parquet(path).count() == 18
    with pytest.raises(Exception):
        write_table(df, path)  # refuses an existing target
    write_table(df, path, overwrite=True)
    m = spark.createDataFrame([("m", 1, 0.5)], "model string, fold int, pr_auc double")
    write_metrics(m, str(tmp_path / "m"))
    with pytest.raises(Exception):
        write_metrics(m, str(tmp_path / "m"))
    with pytest.raises(ValueError, match="partition"):
        write_table(m, str(tmp_path / "n"))
    back = read_metrics(spark, str(tmp_path / "m"), "model string, fold int, pr_auc double").collect()
    assert [tuple(r) for r in back] == [("m", 1, 0.5)]


def test_distributed_rank_exact(spark):
    from panelcast.operators.ladder import distributed_rank
    df = spark.range(0, 5000).selectExpr("id * 7919 % 5003 AS k", "cast(id * 31 % 977 AS string) AS s").dropDuplicates(["k"])
    got = {r["k"]: r["rank"] for r in distributed_rank(df.select("k"), "k", buckets=16).collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(got))}
    txt = spark.createDataFrame([(w,) for w in ["b", "a", "ab", "abc", "z", "B", "", "éa"]], "w string")
    ranks = {r["w"]: r["rank"] for r in distributed_rank(txt, "w", buckets=4).collect()}
    assert [w for w, _ in sorted(ranks.items(), key=lambda kv: kv[1])] == sorted(ranks, key=lambda w: w.encode())


def test_holdout_count_guard(spark, monthly, spec):
    from panelcast.operators.splits import SplitError, assert_holdout_counts
    expected = spark.createDataFrame([(month(6), 2), (month(7), 2)], f"`{spec.period}` date, expected_rows long")
    holdout = monthly.where(F.col(spec.period).isin(month(6), month(7)))
    assert_holdout_counts(holdout, spec, expected)
    with pytest.raises(SplitError):
        assert_holdout_counts(holdout.limit(3), spec, expected)


def test_guarded_canonical_sink(spark, tmp_path, monthly):
    from panelcast.operators.canonical import CanonicalError, write_canonical
    protected = str(tmp_path / "snapshot")
    with pytest.raises(CanonicalError):
        write_canonical(monthly, protected, protected=(protected,))
    for spelling in ("file://" + protected, "file:" + protected + "/", str(tmp_path) + "/x/../snapshot"):
        with pytest.raises(CanonicalError):
            write_canonical(monthly, spelling, protected=(protected,))
    out = str(tmp_path / "out")
    write_canonical(monthly, out)
    with pytest.raises(Exception):
        write_canonical(monthly, out)
    write_canonical(monthly, out, overwrite=True)
