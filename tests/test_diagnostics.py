import datetime as dt
import hashlib
import time

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from panelcast.functions.fingerprint import combined_fingerprint, file_fingerprints, table_fingerprint
from panelcast.operators.ladder import rolled_up, score_tally
from panelcast.operators.metrics import brier, ece, evaluate, evaluate_tally
from panelcast.operators import prep
from panelcast.operators.prep import fit_levels, one_hot
from panelcast.operators.scoring import run_summary
from panelcast.operators.splits import fold_bounds, group_folds
from panelcast.plans import diagnostics
from panelcast.plans.diagnostics import age_pressure, disjoint_groups, shared_entities, sliced_predictions
from panelcast.plans.forest import ForestParams, fit_forests
from panelcast.plans.modeling import ModelSpec, fold_predictions, in_parallel
from panelcast.session import ship
from panelcast.sources.sinks import append_periods, replace_periods
from panelcast.spec import PanelSpec

SPEC = PanelSpec()


def panel(spark, entities, rows_of, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for e in range(entities):
        for t in range(rows_of(e)):
            a, b = rng.normal(), rng.normal()
            out.append((e, dt.date(2000 + t // 12, t % 12 + 1, 1), float(a), float(b) if rng.random() > 0.2 else None, int(a + rng.normal() > 0.3)))
    return spark.createDataFrame(out, f"{SPEC.entity} long, {SPEC.period} date, a double, age_now double, label int")


def test_groups_are_disjoint_and_even_on_patterned_ids(spark):
    frame = panel(spark, 400, lambda e: 12 if e % 4 == 0 else 3)  # a quarter of the ids holds most rows
    grouped = group_folds(frame, SPEC, 4).persist()
    sizes = [r["count"] for r in grouped.groupBy("group_fold").count().collect()]
    assert len(sizes) == 4 and sum(sizes) == frame.count() and max(sizes) <= 1.01 * min(sizes)
    assert [r.shared_entities for r in shared_entities(grouped, SPEC).collect()] == [0] * 4
    leaky = grouped.withColumn("group_fold", F.when((F.col(SPEC.entity) == 5) & (F.month(SPEC.period) == 1), 3).otherwise(F.when(F.col(SPEC.entity) == 5, 0).otherwise(F.col("group_fold"))))
    assert {r.group_fold: r.shared_entities for r in shared_entities(leaky, SPEC).collect()} == {0: 1, 1: 0, 2: 0, 3: 1}
    for f in disjoint_groups(grouped, SPEC, 4):
        assert f.train.join(f.validation, SPEC.entity, "left_semi").count() == 0


def test_learners_of_the_groups_share_one_value_count(spark, monkeypatch):
    frame = group_folds(panel(spark, 40, lambda e: 10), SPEC, 2).persist()
    forest, logistic = ForestParams(12, 5, 4, bins=16), ModelSpec("logistic", {"C": 1.0})
    counted, real = [], prep.fold_counts
    for module in (prep, diagnostics):
        monkeypatch.setattr(module, "fold_counts", lambda *a: counted.append(len(a[2])) or real(*a))
    got = {(r.learner, r.group_fold): r for r in diagnostics.entity_disjoint(frame, SPEC, ["a", "age_now"], "label", 2, logistic, forest).collect()}
    assert counted == [2] and len(got) == 4  # one count for both learners and groups
    key = list(SPEC.key)
    for f in disjoint_groups(frame, SPEC, 2):
        alone = fit_forests(f.train, [(0, F.lit(True))], ["a", "age_now"], key, "label", [forest]).score(f.validation, 0, key, "label")
        linear = fold_predictions([f], SPEC, ["a", "age_now"], "label", ModelSpec("logistic", {"maxIter": 200}))
        for learner, scored, near in (("forest", alone, 1e-9), ("logistic", linear, 1e-5)):
            want, r = evaluate(scored.withColumn("all", F.lit(0)), 0.5, by=["all"]).first(), got[learner, f.position]
            assert r.pr_auc == pytest.approx(want.pr_auc, abs=near) and r.brier_score == pytest.approx(want.brier_score, abs=near) and r.shared_entities == 0


def test_fits_side_by_side_ship_the_package_once(monkeypatch):
    class Context:
        applicationId, sent = "side-by-side", []

        def addPyFile(self, path):
            time.sleep(0.2)
            self.sent.append(path)

    session = type("Session", (), {"sparkContext": Context()})()
    monkeypatch.setattr("panelcast.session._shipped", set())
    in_parallel([lambda: ship(session)] * 4)
    assert len(Context.sent) == 1


def test_sliced_variant_equals_its_own_assembly(spark):
    frame = panel(spark, 40, lambda e: 10).persist()
    folds = disjoint_groups(group_folds(frame, SPEC, 2), SPEC, 2)
    m = ModelSpec("logistic", {"maxIter": 200})
    variants = {"both": ["a", "age_now"], "a": ["a"], "age": ["age_now"]}
    preds = sliced_predictions(folds, SPEC, ["a", "age_now"], "label", variants, m, {"age_group": F.when(F.col("age_now").isNull(), "imputed_age").otherwise("observed_age")})
    for name, features in (("a", variants["a"]), ("age", variants["age"])):
        own = {(r.fold, r[SPEC.entity], r[SPEC.period]): r.score for r in fold_predictions(folds, SPEC, features, "label", m).collect()}
        got = {(r.fold, r[SPEC.entity], r[SPEC.period]): r.score for r in preds.where(F.col("variant") == name).collect()}
        assert got.keys() == own.keys() and all(got[k] == pytest.approx(own[k], abs=1e-6) for k in own)
    table = {(r.variant, r.subgroup): r for r in age_pressure(preds, "both", "a", 2).collect()}
    assert len(table) == 9
    assert table["both", "all"].rows == frame.count() == table["both", "imputed_age"].rows + table["both", "observed_age"].rows
    assert table["age", "all"].incremental_mean_pr_auc == pytest.approx(table["both", "all"].mean_pr_auc - table["a", "all"].mean_pr_auc)
    assert table["a", "all"].mean_pr_auc > table["age", "all"].mean_pr_auc


def test_one_tally_gives_all_metrics(spark):
    rng = np.random.default_rng(4)
    rows = [(int(f), int(rng.random() < s), float(round(s, 2))) for f in range(3) for s in rng.random(200)] + [(0, None, 0.5), (1, 1, None)]
    preds = spark.createDataFrame(rows, "fold int, label int, score double")
    got = {r.fold: r for r in evaluate(preds, 0.5, by=["fold"], calibration=True).collect()}
    for fold, r in got.items():
        own = [(y, s) for f, y, s in rows if f == fold and y is not None and s is not None]
        y, s = np.array([v[0] for v in own]), np.array([v[1] for v in own])
        assert r.brier_score == pytest.approx(np.mean((s - y) ** 2))
        assert (r.true_positives, r.false_positives) == (((s >= 0.5) & (y == 1)).sum(), ((s >= 0.5) & (y == 0)).sum())
        bins = np.minimum(np.searchsorted([0.2, 0.4, 0.6000000000000001, 0.8], s, side="right"), 4)
        want = sum(abs((s - y)[bins == b].sum()) for b in range(5)) / len(s)
        assert r.expected_calibration_error == pytest.approx(want)
        assert r.roc_auc == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]))
    tally = score_tally(preds, by=["fold"])
    pooled, direct = evaluate_tally(rolled_up(tally), 0.5).first(), evaluate(preds, 0.5).first()
    assert pooled == direct
    assert brier(preds).first()["observed_prevalence"] == pytest.approx(np.mean([y for _, y, s in rows if y is not None and s is not None]))
    assert ece(preds.where("fold = 9")).collect() == [] or ece(preds.where("fold = 9")).first()[0] is None


def test_predictions_are_evaluated_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            calls.add(batch.num_rows)
            yield batch

    preds = spark.range(100).selectExpr("id % 2 AS label", "id / 100D AS score", "id % 4 AS fold").mapInArrow(counted, "label long, score double, fold long")
    evaluate(preds, 0.5, by=["fold"], calibration=True).collect()
    assert calls.value == 100


def test_appended_periods_are_new_ones_and_prune(spark, tmp_path):
    path = str(tmp_path / "periods")
    rows = spark.createDataFrame([(e, dt.date(2020, m, 1), m) for e in range(3) for m in range(1, 7)], f"{SPEC.entity} long, {SPEC.period} date, label int")
    first = append_periods(rows.where(f"{SPEC.period} <= '2020-04-01'"), path, SPEC.period)
    assert first.count() == 12
    assert append_periods(rows, path, SPEC.period).count() == 18 and append_periods(rows, path, SPEC.period).count() == 18
    late = spark.read.schema(rows.schema).parquet(path).where(F.col(SPEC.period) > dt.date(2020, 4, 1))
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan and late.count() == 6


def test_replaced_periods_leave_the_others_and_survive_a_failure(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (1, "b", 0)], "id long, period string, v int")
    replace_periods(rows, path)
    replace_periods(spark.createDataFrame([(7, "b", 1)], "id long, period string, v int"), path)
    read = lambda: sorted((r.id, r.period, r.v) for r in spark.read.schema(rows.schema).parquet(path).collect())
    assert read() == [(1, "a", 0), (2, "a", 0), (7, "b", 1)]
    with pytest.raises(Exception):
        replace_periods(spark.createDataFrame([(8, "a", 2)], rows.schema).withColumn("v", F.raise_error(F.lit("broken")).cast("int")), path)
    assert read() == [(1, "a", 0), (2, "a", 0), (7, "b", 1)]
    with pytest.raises(ValueError):
        replace_periods(rows.drop("period"), path)


def test_fingerprints_keep_values_apart_and_pin_files(spark, tmp_path):
    one = lambda a, b: table_fingerprint(spark.createDataFrame([(a, b)], "p string, q string"), exact=True).first()["hash_sum"]
    assert len({one("x|=y", "z"), one("x", "y|=z"), one("x|", "=y|=z"), one(None, "z"), one("-", "z")}) == 5
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"one")
    (tmp_path / "f" / "b.bin").write_bytes(b"two")
    files = file_fingerprints(spark, str(tmp_path / "f"))
    assert {r.file: (r.length, r.sha256) for r in files.collect()} == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in (("a.bin", b"one"), ("b.bin", b"two"))}
    before = combined_fingerprint(files).first()
    (tmp_path / "f" / "b.bin").write_bytes(b"x")
    assert combined_fingerprint(file_fingerprints(spark, str(tmp_path / "f"))).first()["digest"] != before["digest"] and before["files"] == 2


def test_a_file_is_hashed_by_several_tasks(spark, tmp_path, monkeypatch):
    from panelcast.functions import fingerprint
    (tmp_path / "g").mkdir()
    contents = {"long file.bin": bytes(range(256)) * 40 + b"end", "even.bin": b"z" * 4096, "short.bin": b"q"}
    for name, content in contents.items():
        (tmp_path / "g" / name).write_bytes(content)
    rounds, real = [], fingerprint.written
    monkeypatch.setattr(fingerprint, "written", lambda df, name: rounds.append(real(df, name)) or rounds[-1])
    files = file_fingerprints(spark, str(tmp_path / "g"), part=1000)
    assert {r.file: (r.length, r.sha256) for r in files.collect()} == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in contents.items()}
    if fingerprint._openssl():
        steps = [max(r.done for r in states.collect()) for states in rounds]
        assert len(steps) == 11 and steps[:2] == [1000, 2000]  # no task reads more than a part


def test_one_hot_has_no_cap_and_unseen_levels_are_zeros(spark):
    train = spark.range(50_000).selectExpr("concat('c', lpad(id, 6, '0')) AS c").union(spark.sql("SELECT CAST(NULL AS STRING)"))
    levels, width = fit_levels(train, "c")
    assert width == 50_000
    rows = spark.createDataFrame([("c000000",), ("c049999",), ("never",), (None,)], "c string")
    got = {r.c: r.hot for r in one_hot(rows, "c", levels, width, "c000007", "hot").collect()}
    assert {c: v.indices.tolist() for c, v in got.items()} == {"c000000": [0], "c049999": [49_999], "never": [], None: [7]}
    assert all(v.size == width for v in got.values())
    assert one_hot(rows, "c", levels, width, "c000007", "hot").select(F.size(vector_to_array("hot"))).first()[0] == width


def test_a_null_period_is_no_total(spark):
    rows = spark.createDataFrame([(1, None, 1), (1, dt.date(2020, 1, 1), 0)], f"{SPEC.entity} long, {SPEC.period} date, label int")
    assert sorted((r["scope"], r["rows"]) for r in run_summary(rows, SPEC, "label").collect()) == [("all", 2), ("period", 1), ("period", 1)]


def test_fold_bounds_step_back_from_the_last_period():
    assert fold_bounds(dt.date(2021, 2, 1), 3, 2) == [("2020-09_to_2020-11", 1, dt.date(2020, 9, 1), dt.date(2020, 11, 1)), ("2020-12_to_2021-02", 2, dt.date(2020, 12, 1), dt.date(2021, 2, 1))]
