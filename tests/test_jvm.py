import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.plans import jvm
from panelcast.plans.boosting import BoostingParams, fit_boosting
from panelcast.plans.forest import ForestParams, fit_forests

KEY, FEATURES = ["e", "t"], ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    out = []
    for e in range(150):
        for t in range(12):
            a, b, c = rng.normal(), rng.integers(0, 6), rng.normal()
            out.append((e, t, float(a) if rng.random() > 0.1 else None, float(b), float(c), 1.0, int(a + 0.4 * b + rng.normal(scale=0.7) > 1.2)))
    return spark.createDataFrame(out, "e int, t int, a double, b double, c double, d double, label int").persist()


def both(monkeypatch, fit):
    """What a fit gives in the JVM and in numpy; the former must have been used."""
    used, real = [], jvm.mapped

    def counting(*args):
        out = real(*args)
        used.append(out is not None)
        return out

    monkeypatch.setattr(jvm, "mapped", counting)
    compiled = fit()
    assert used == [True]
    monkeypatch.setattr(jvm, "mapped", lambda *args: None)
    return compiled, fit()


def folds():
    return [(1, F.col("t") < 8), (2, F.col("t") < 10)]


@pytest.mark.parametrize("share", ["sqrt", "0.5", "1.0"])
def test_forest_in_the_jvm_equals_numpy(monkeypatch, rows, share):
    models = [ForestParams(30, 30, 1, share, 7, 64), ForestParams(28, 6, 4, share, 7, 64), ForestParams(30, 30, 4, share, 7, 64), ForestParams(9, 5, 15, share, 8, 64)]

    def fit():
        found = fit_forests(rows, folds(), FEATURES, KEY, "label", models).trees.collect()
        return {(r.model, r.fold, r.tree): tuple(bytes(r[c]) for c in ("ids", "feature", "bin", "p")) for r in found}

    got, want = both(monkeypatch, fit)
    assert got == want and len(got) == 2 * (30 + 28 + 30 + 9)


@pytest.mark.parametrize("spread", [500_000, 100])
def test_scores_of_the_jvm_equal_numpy(monkeypatch, rows, spread):
    from panelcast.plans import forest
    monkeypatch.setattr(forest, "SCORED", spread)
    monkeypatch.setattr(forest, "CHUNK", 37)
    fitted = fit_forests(rows, folds(), FEATURES, KEY, "label", [ForestParams(30, 30, 1), ForestParams(26, 3, 9), ForestParams(3, 1, 900)])

    def scores():
        found = fitted.score_folds(rows, [(1, F.col("t") >= 8), (2, F.col("t") >= 10)], KEY, "label").collect()
        return {(r.model, r.fold, r.e, r.t): r.score for r in found}

    got, want = both(monkeypatch, scores)
    assert got.keys() == want.keys() and len(got) == 3 * 150 * (4 + 2)
    assert max(abs(got[k] - want[k]) for k in got) < 1e-11


def test_boosting_in_the_jvm_equals_numpy(monkeypatch, rows):
    models = [BoostingParams(20, 0.1, 3, 10, 128), BoostingParams(12, 0.3, 5, 1, 128), BoostingParams(4, 0.5, 1, 400, 128)]

    def fit():
        return fit_boosting(rows, folds(), FEATURES, KEY, "label", models).trees

    got, want = both(monkeypatch, fit)
    assert got.keys() == want.keys() and len(got) == 6
    for k in got:
        assert len(got[k]) == len(want[k]) == models[k[0]].rounds
        for a, b in zip(got[k], want[k]):
            assert a.feature.tolist() == b.feature.tolist() and a.cut.tolist() == b.cut.tolist()
            assert np.abs(a.value - b.value).max() < 1e-6  # residuals are rounded to whole units by either's exp


def test_large_tables_stay_out_of_the_heap(monkeypatch, rows):
    assert jvm.share_of_heap(rows.sparkSession) > 0
    monkeypatch.setattr(jvm, "share_of_heap", lambda spark: 1000)
    assert jvm.mapped(rows, "Forest", [], "a int", 1001) is None
    trees = fit_forests(rows, folds(), FEATURES, KEY, "label", [ForestParams(3, 5, 5)]).trees
    assert trees.count() == 6


def test_boosting_scores_are_the_whole_model():
    """No rounds or levels are left out."""
    from panelcast.queries import BOOSTING, BOOSTING_GRID
    assert BOOSTING.params == BOOSTING_GRID[0] and BOOSTING.params["maxIter"] == 150 and BOOSTING.params["maxDepth"] == 4


def test_boosting_grid_is_whole():
    from panelcast.queries import BOOSTING_GRID, boosting_candidates
    assert [c.params for c in boosting_candidates()] == list(BOOSTING_GRID)
    assert sum(c.params["maxIter"] for c in boosting_candidates()) == 3750
