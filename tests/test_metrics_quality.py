import pytest
from pyspark.sql import functions as F

from panelcast.operators.canonical import CanonicalError, check_columns, normalize_ratios
from panelcast.operators.ladder import ranking_metrics, score_ladder
from panelcast.operators.metrics import calibration_bins, operating_threshold, policy_transfer, threshold_policies
from panelcast.operators.prep import fit_medians, fit_robust
from panelcast.operators.quality import DataValidationError, validate


def preds(spark, ys, ps, fold=1):
    return spark.createDataFrame([(fold, y, float(p)) for y, p in zip(ys, ps)], "fold int, label int, score double")


def test_average_precision_and_auc_by_hand(spark):
    p = preds(spark, [0, 0, 0, 1, 1, 1], [.1, .2, .7, .4, .8, .9])
    for buckets in (1, 2, 256):
        r = ranking_metrics(score_ladder(p, buckets=buckets)).first()
        assert r["pr_auc"] == pytest.approx(0.9166667, abs=1e-6)
        assert r["roc_auc"] == pytest.approx(0.8888889, abs=1e-6)


def test_one_class_auc_is_null(spark):
    r = ranking_metrics(score_ladder(preds(spark, [1, 1], [.2, .3]))).first()
    assert r["roc_auc"] is None and r["pr_auc"] == pytest.approx(1.0)


def test_worked_threshold(spark):
    p = preds(spark, [0, 0, 0, 1, 1, 1], [.1, .2, .7, .4, .8, .9])
    assert operating_threshold(p, 0.66).first()["threshold"] == pytest.approx(0.8)


def test_bins_cover_every_row_and_empty_bins_listed(spark):
    p = preds(spark, [0, 0, 1, 1], [.1, .4, .6, .9])
    rows = calibration_bins(p).collect()
    assert len(rows) == 5 and sum(r["rows"] for r in rows) == 4
    edge = calibration_bins(preds(spark, [1], [0.6])).collect()
    assert [r["rows"] for r in edge] == [0, 0, 1, 0, 0]  # 0.6 < 0.6000000000000001


def test_four_policies_and_latest_fold_excluded(spark):
    p = preds(spark, [0, 0, 1, 1], [.1, .4, .6, .9])
    assert sorted(r["policy"] for r in threshold_policies(p).collect()) == [
        "approximately_70_percent_recall", "approximately_80_percent_recall", "best_validation_f1", "fn_cost_3x_fp"]
    base = [preds(spark, [0, 1], [.2, .8], f) for f in (1, 2, 3)]
    a = base[0].unionByName(base[1]).unionByName(base[2])
    t1 = {r["policy"]: r["threshold"] for r in policy_transfer(a.unionByName(preds(spark, [0, 1], [.1, .9], 4))).collect()}
    t2 = {r["policy"]: r["threshold"] for r in policy_transfer(a.unionByName(preds(spark, [0, 1], [.99, 1.0], 4))).collect()}
    assert t1 == t2


def test_exact_median_and_zero_iqr(spark):
    df = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0), (3.0, 0.0), (4.0, 0.0), (None, 5.0)], "x double, z double")
    med = fit_medians(df, ["x", "z"])
    assert med["x"] == 2.5
    _, scales = fit_robust(df, ["z"], med)
    assert scales["z"] == 1.0


def test_validation_rejects_duplicates_and_identity(monthly, spec):
    dup = monthly.unionByName(monthly.limit(1))
    with pytest.raises(DataValidationError, match="duplicate"):
        validate(dup, spec)
    bad = monthly.withColumn(spec.total, F.when(F.col(spec.period) == F.lit("2024-10-01").cast("date"), F.lit(999)).otherwise(F.col(f"`{spec.total}`")))
    with pytest.raises(DataValidationError, match="inconsistent"):
        validate(bad, spec)
    assert validate(monthly, spec)["rows"] == 18


def test_percent_strings_normalised(spark):
    df = spark.createDataFrame([("100%",), ("50%",), ("98.60215053763%",)], "`AM Peak Availability` string")
    got = [r[0] for r in normalize_ratios(df, ["AM Peak Availability"]).collect()]
    assert got == pytest.approx([1.0, 0.5, 0.9860215053763])


def test_missing_column_error(spark):
    with pytest.raises(CanonicalError):
        check_columns(spark.createDataFrame([(1,)], "Month int"))


def test_pairwise_correlation_matches_pairwise_complete(spark):
    import numpy as np
    import pandas as pd
    from panelcast.plans.reports import high_correlation
    rng = np.random.default_rng(7)
    a = rng.normal(size=200)
    b = a * 3 + rng.normal(scale=0.01, size=200)
    c = rng.normal(size=200)
    b[::7] = np.nan  # pairwise complete rows only
    pdf = pd.DataFrame({"a": a, "b": b, "c": c})
    df = spark.createDataFrame(pdf).repartition(3)
    got = {(r[0], r[1]): r[2] for r in high_correlation(df, ["a", "b", "c"], 0.0).collect()}
    exp = pdf.corr()
    for (x, y), v in got.items():
        assert v == pytest.approx(abs(exp.loc[x, y]), abs=1e-9)
    assert len(got) == 3


def test_pipeline_persists_and_scores_unchanged(spark, tmp_path, monthly, spec):
    from pyspark.ml import PipelineModel
    from panelcast.operators.labels import add_next_period_label
    from panelcast.operators.features import build_features
    from panelcast.plans.modeling import ModelSpec, fit_pipeline, score
    from panelcast.spec import FEATURE_SETS, PRIMARY_RULE
    lab = add_next_period_label(monthly, spec, PRIMARY_RULE).where(F.col(PRIMARY_RULE.name).isNotNull())
    df, names = build_features(lab, spec, FEATURE_SETS["short_history"])
    model = fit_pipeline(df, names, PRIMARY_RULE.name, ModelSpec("logistic", {"maxIter": 20}))
    before = [r["score"] for r in score(model, df).orderBy(f"`{spec.entity}`", spec.period).collect()]
    path = str(tmp_path / "model")
    model.write().overwrite().save(path)
    after = [r["score"] for r in score(PipelineModel.load(path), df).orderBy(f"`{spec.entity}`", spec.period).collect()]
    assert before == pytest.approx(after)
    assert all(0.0 <= p <= 1.0 for p in before)


def test_strict_parse_errors(spark):
    from panelcast.operators.canonical import canonicalize
    from panelcast.sources.tables import export_from_lineitem
    dirty = export_from_lineitem(spark, "/root/testdata/sf0.001", dirty=True)
    with pytest.raises(CanonicalError, match="Month|numeric"):
        canonicalize(dirty, start_month="1996-01-01")


def _brute_ap_auc(y, p):
    import numpy as np
    y, p = np.asarray(y), np.asarray(p)
    P, N = y.sum(), len(y) - y.sum()
    ap = 0.0
    for s in np.unique(p)[::-1]:
        hit = p >= s
        ap += y[p == s].sum() / P * (y[hit].sum() / hit.sum())
    auc = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in p[y == 1] for b in p[y == 0]) / (P * N)
    return ap, auc


def test_ladder_matches_brute_force_with_groups_and_buckets(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    rows, expect = [], {}
    for g in range(3):
        p = np.round(rng.uniform(size=120), 2)  # many ties
        y = (rng.uniform(size=120) < p).astype(int)
        rows += [(g, int(a), float(b)) for a, b in zip(y, p)]
        expect[g] = _brute_ap_auc(y, p)
    df = spark.createDataFrame(rows, "fold int, label int, score double")
    got = {r["fold"]: (r["pr_auc"], r["roc_auc"]) for r in ranking_metrics(score_ladder(df, by=["fold"], buckets=8), ["fold"]).collect()}
    for g, (ap, auc) in expect.items():
        assert got[g][0] == pytest.approx(ap, abs=1e-12)
        assert got[g][1] == pytest.approx(auc, abs=1e-12)


def test_numeric_and_text_counts(spark):
    from panelcast.operators.canonical import coerce_count
    df = spark.createDataFrame([("3", 3.0), ("3.0", 4.0), (" 7 ", None), ("2.5", 2.5), ("x", float("nan")), (None, 5.0)], "t string, d double")
    assert [r[0] for r in df.select(coerce_count("t")).collect()] == [3, 3, 7, None, None, None]
    assert [r[0] for r in df.select(coerce_count("d")).collect()] == [3, 4, None, None, None, 5]


def test_nan_does_not_decide_a_ratio_scale(spark):
    text = spark.createDataFrame([("98.5",), ("50",), ("nan",)], "r string")
    assert [r[0] for r in normalize_ratios(text, ["r"]).collect()] == [0.985, 0.5, None]
    number = spark.createDataFrame([(98.5,), (50.0,), (float("nan"),)], "r double")
    assert [r[0] for r in normalize_ratios(number, ["r"]).collect()] == [0.985, 0.5, None]


def test_age_column_is_required(monthly, spec):
    with pytest.raises(DataValidationError, match="lacks"):
        validate(monthly.drop(spec.age), spec)


def test_calibration_rule_is_anchored_on_uncalibrated(spark):
    from panelcast.plans.reports import choose_calibration
    cols = "method string, pr_auc double, brier_score double"

    def run(*rows):
        return {r["method"]: (r["eligible"], r["chosen"], r["calibration_needed"]) for r in choose_calibration(spark.createDataFrame(rows, cols)).collect()}

    # platt ranks 0.02 better: uncalibrated stays eligible, and platt's Brier gain decides
    got = run(("uncalibrated", 0.50, 0.20), ("platt", 0.52, 0.19), ("isotonic", 0.48, 0.10))
    assert got == {"uncalibrated": (True, False, True), "platt": (True, True, True), "isotonic": (False, False, True)}
    # a gain under 0.005 chooses platt but calls no need; the best Brier being uncalibrated neither
    assert run(("uncalibrated", 0.50, 0.200), ("platt", 0.50, 0.198))["platt"] == (True, True, False)
    assert run(("uncalibrated", 0.50, 0.200), ("platt", 0.50, 0.21))["uncalibrated"] == (True, True, False)


def test_readiness_uses_all_fold_means(spark):
    from panelcast.plans.reports import readiness_gate
    cols = "model string, all_fold_mean_pr_auc double, selection_mean_pr_auc double, worst_fold_pr_auc double"
    # the worst single fold is under 0.45, the mean is not
    ready = spark.createDataFrame([("a", 0.50, 0.52, 0.40), ("b", 0.47, 0.40, 0.30), ("base", 0.30, 0.60, 0.1)], cols)
    assert readiness_gate(ready, ["base"]).first()["ready"]
    assert not readiness_gate(ready.unionByName(spark.createDataFrame([("c", 0.44, 0.9, 0.44)], cols)), ["base"]).first()["ready"]


def test_latest_period_is_that_of_the_source(spark):
    import datetime as dt
    from panelcast.operators.scoring import assert_nonempty, latest_unlabeled
    from panelcast.spec import PanelSpec
    spec = PanelSpec()
    rows = [("a", dt.date(2024, 1, 1), None, True), ("a", dt.date(2024, 2, 1), None, False)]
    panel = spark.createDataFrame(rows, "entity_id string, period date, label int, ok boolean")
    batch = latest_unlabeled(panel.where("ok"), spec, "label", source=panel)
    assert batch.count() == 0
    with pytest.raises(ValueError, match="nothing to score"):
        assert_nonempty(batch)


def test_exact_fingerprint_reads_microseconds_and_all_digits(spark):
    from panelcast.functions.fingerprint import table_fingerprint
    rows = ["1.0d x, timestamp'2024-01-01 00:00:00.000001' t, array(0.1f, null) e", "1.0d x, timestamp'2024-01-01 00:00:00.000002' t, array(0.1f, null) e",
            "1.0000000001d x, timestamp'2024-01-01 00:00:00.000001' t, array(0.1f, null) e", "1.0d x, timestamp'2024-01-01 00:00:00.000001' t, array(0.10000001f, null) e",
            "1.0d x, timestamp'2024-01-01 00:00:00.000001' t, array(0.1f) e"]
    assert len({table_fingerprint(spark.sql(f"SELECT {r}"), exact=True).first()["hash_sum"] for r in rows}) == len(rows)
