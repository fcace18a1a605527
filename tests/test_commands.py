import datetime as dt

from pyspark.sql import functions as F

from panelcast.plans.commands import final_evaluation, score_latest, train, validate
from panelcast.plans.modeling import ModelSpec
from panelcast.queries import SPEC, TEST_RUN
from panelcast.sources.tables import panel_from_lineitem

SF = "/root/testdata/sf0.001"


def test_commands_end_to_end(spark, tmp_path):
    panel = panel_from_lineitem(spark, SF).drop("_idx")
    last = panel.agg(F.max(SPEC.period)).first()[0]
    m = last.year * 12 + last.month - 1
    start = dt.date((m - 3) // 12, (m - 3) % 12 + 1, 1)
    end = dt.date((m - 1) // 12, (m - 1) % 12 + 1, 1)
    report = validate(panel, TEST_RUN, start, end)
    assert report["source_validation"]["rows"] > 0 and len(report["folds"]) == 8
    preds, metrics = train(panel, TEST_RUN, ModelSpec("logistic", {"maxIter": 10}), start)
    assert metrics.count() == 4
    fitted, final = final_evaluation(panel, TEST_RUN, ModelSpec("forest", {"numTrees": 5, "maxDepth": 4}), start, end, 0.44,
                                     "I_UNDERSTAND_THIS_ACCESSES_THE_FROZEN_TEST_SET", str(tmp_path / "audit.log"))
    row = final.first()
    assert row["true_positives"] + row["false_negatives"] + row["false_positives"] + row["true_negatives"] > 0
    ranked, tiers = score_latest(panel, TEST_RUN, fitted)
    probs = [r["probability"] for r in ranked.collect()]
    assert probs == sorted(probs, reverse=True)
    assert sum(r["rows"] for r in tiers.collect()) == len(probs)
