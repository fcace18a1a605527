import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators.prep import fit_stats, fold_stats
from panelcast.operators.splits import rolling_folds
from panelcast.plans.logistic import Candidate, Side, fit_logistic, sides
from panelcast.plans.modeling import ModelSpec, fold_predictions
from panelcast.sources.tables import DEFAULT_PANEL as SPEC

FEATURES = ["a", "b", "c"]


def two_sides():
    return [Side(1, F.col("t") < 6, F.col("t").between(6, 7)), Side(2, F.col("t") < 8, F.col("t") >= 8)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    out = []
    for e in range(70):
        for t in range(10):
            a, b = rng.normal(), float(rng.integers(0, 4))
            out.append((e, t, float(a) if rng.random() > 0.3 else None, b, 2.0, int(a + 0.5 * b + rng.normal() > 1.5)))
    return spark.createDataFrame(out, "e int, t int, a double, b double, c double, label int").persist()


def test_statistics_of_all_folds_equal_those_of_each(rows):
    frame = rows.withColumn("empty", F.lit(None).cast("double")).withColumn("half", F.when(F.col("e") % 2 == 0, F.col("a")))
    cols = [*FEATURES, "empty", "half"]
    got = fold_stats(frame, cols, [(s.position, s.train) for s in two_sides()])
    for s in two_sides():
        own = fit_stats(frame.where(s.train), cols)
        for mine, theirs in ((got[s.position].medians, own.medians), (got[s.position].centers, own.centers), (got[s.position].scales, own.scales)):
            assert mine == {c: v if v is None else pytest.approx(v) for c, v in theirs.items()}


def prepared(rows, s, features):
    stats = fit_stats(rows.where(s.train), features)
    part = rows.where(s.train).toPandas()
    x = np.column_stack([(part[c].fillna(stats.medians[c]).to_numpy() - stats.centers[c]) / stats.scales[c] for c in features])
    y = part["label"].to_numpy()
    return x, y, np.where(y == 1, len(y) / (2.0 * y.sum()), len(y) / (2.0 * (len(y) - y.sum())))


def test_fits_are_the_optimum_of_every_fold_and_penalty(rows):
    candidates = [Candidate(("a", "b", "c"), 1.0), Candidate(("a", "b"), 0.02, "l1"), Candidate(("b", "a"), 0.1)]
    fitted = fit_logistic(rows, two_sides(), {"e": F.col("e"), "t": F.col("t")}, "label", candidates)
    assert len(fitted.fits) == 6 and all(f.done for f in fitted.fits)
    for f in fitted.fits:
        one = candidates[f.candidate]
        x, y, w = prepared(rows, two_sides()[f.fold], list(one.features))
        residual = w * (1 / (1 + np.exp(-(x @ f.beta[1:] + f.beta[0]))) - y)
        slope = x.T @ residual
        assert residual.sum() == pytest.approx(0, abs=1e-5)
        for j, b in enumerate(f.beta[1:]):
            if one.penalty == "l2":
                assert slope[j] + b / one.C == pytest.approx(0, abs=1e-4)
            elif b:
                assert slope[j] + np.sign(b) / one.C == pytest.approx(0, abs=1e-4)
            else:
                assert abs(slope[j]) <= 1 / one.C + 1e-6
    assert any(b == 0 for f in fitted.fits if f.candidate == 1 for b in f.beta[1:])
    scored = fitted.score().groupBy("model", "fold").count().collect()
    assert {(r.model, r.fold): r["count"] for r in scored} == {(m, k): 140 for m in range(3) for k in (1, 2)}


def test_scores_equal_sparks_learner_and_rows_are_read_ten_times_at_most(spark, monkeypatch):
    from panelcast.plans import logistic
    rng = np.random.default_rng(5)
    out = []
    for e in range(60):
        for t in range(24):
            a, b = rng.normal(), rng.normal()
            out.append((e, dt.date(2000 + t // 12, t % 12 + 1, 1), float(a), float(b) if rng.random() > 0.2 else None, int(a - b + rng.normal() > 0.3)))
    frame = spark.createDataFrame(out, f"{SPEC.entity} long, {SPEC.period} date, a double, b double, label int").persist()
    folds = rolling_folds(frame, SPEC, 3, 2)
    passes, real = [], logistic._sums
    monkeypatch.setattr(logistic, "_sums", lambda *x: passes.append(1) or real(*x))
    fitted = fit_logistic(frame, sides(folds), {c: F.col(c) for c in SPEC.key}, "label", [Candidate(("a", "b"))] * 6)
    assert len(passes) <= 10  # 12 fits; Spark's learner took an iteration per pass and fit
    got = {(r.fold, r[SPEC.entity], r[SPEC.period]): r.score for r in fitted.score().where("model = 5").collect()}
    own = {(r.fold, r[SPEC.entity], r[SPEC.period]): r.score for r in fold_predictions(folds, SPEC, ["a", "b"], "label", ModelSpec("logistic", {"maxIter": 300, "tol": 1e-12})).collect()}
    assert got == {k: pytest.approx(v, abs=1e-5) for k, v in own.items()} and len(own) == 360


def test_one_class_scores_are_certain(rows):
    for value in (0, 1):
        fitted = fit_logistic(rows.withColumn("label", F.lit(value)), two_sides(), {"e": F.col("e")}, "label", [Candidate(("a", "b"))])
        assert {r.score for r in fitted.score().collect()} == {float(value)}
