"""Probability metrics (H1-H15) on a prediction table (by..., label, score).

Every metric is a sum over the score tally (``ladder.score_tally``), so predictions, often a model's
transform, are evaluated once per query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ladder import ladder_of, policy_thresholds, ranking_columns, rolled_up, score_tally, select_threshold, threshold_candidates

# Reliability bin edges equal numpy.linspace(0, 1, 6) element by element.
BIN_EDGES = (0.0, 0.2, 0.4, 0.6000000000000001, 0.8, 1.0)


def _sums(tally: DataFrame, columns: dict[str, Column], by=()) -> DataFrame:
    return tally.groupBy(*by).agg(*[c.alias(name) for name, c in columns.items()])


def _confusion_columns(threshold: Column | float) -> dict[str, Column]:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, pos, neg = F.col("score") >= t, F.col("pos"), F.col("n") - F.col("pos")
    count = lambda c, rows: F.coalesce(F.sum(F.when(c, rows)), F.lit(0))
    return {"true_positives": count(hit, pos), "false_positives": count(hit, neg), "false_negatives": count(~hit, pos), "true_negatives": count(~hit, neg)}


def _with_rates(out: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    return out.withColumns({
        "precision": F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0),
        "recall": F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0),
    })


def _brier_column() -> Column:
    """sum of (p - y)^2 over a score's rows: n p^2 - 2 p pos + pos."""
    p, pos, n = F.col("score"), F.col("pos"), F.col("n")
    return F.sum(n * p * p - 2 * p * pos + pos) / F.sum(n)


def _ece_column() -> Column:
    """sum over bins of |sum p - sum y|, over the rows: each bin's n/N |mean p - observed|."""
    bin_, gap = bin_index(F.col("score")), F.col("n") * F.col("score") - F.col("pos")
    return sum((F.abs(F.coalesce(F.sum(F.when(bin_ == i, gap)), F.lit(0.0))) for i in range(len(BIN_EDGES) - 1)), F.lit(0.0)) / F.sum("n")


def confusion(preds: DataFrame, threshold: Column | float, label: str = "label", score: str = "score", by=()) -> DataFrame:
    """H1/H2: counts at ``score >= t`` plus precision and recall (zero division -> 0)."""
    return _with_rates(_sums(score_tally(preds, label, score, by), _confusion_columns(threshold), by))


def brier(preds: DataFrame, label: str = "label", score: str = "score", by=()) -> DataFrame:
    """H5: mean squared error of the probability."""
    return _sums(score_tally(preds, label, score, by), {"brier_score": _brier_column(), "observed_prevalence": F.sum("pos") / F.sum("n"),
                                                        "mean_probability": F.sum(F.col("n") * F.col("score")) / F.sum("n")}, by)


def bin_index(score: Column) -> Column:
    """Left-closed fixed-width bins against the literal edges; p = 1 falls in the last bin."""
    inner = BIN_EDGES[1:-1]
    idx = F.lit(0)
    for e in inner:
        idx = idx + (score >= F.lit(e)).cast("int")
    return idx


def calibration_bins(preds: DataFrame, label: str = "label", score: str = "score", by=()) -> DataFrame:
    """H6: five bins per group, empty ones listed with null means."""
    tally = score_tally(preds, label, score, by)
    bin_ = bin_index(F.col("score"))
    sums = []
    for i in range(len(BIN_EDGES) - 1):
        here = bin_ == i
        sums += [F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)).alias(f"n{i}"), F.sum(F.when(here, F.col("n") * F.col("score"))).alias(f"p{i}"),
                 F.sum(F.when(here, F.col("pos"))).alias(f"y{i}")]
    rows = [F.struct(F.lit(i).alias("bin"), F.lit(BIN_EDGES[i]).alias("lower"), F.lit(BIN_EDGES[i + 1]).alias("upper"), F.col(f"n{i}").alias("rows"),
                     (F.col(f"p{i}") / F.col(f"n{i}")).alias("mean_probability"), (F.col(f"y{i}") / F.col(f"n{i}")).alias("observed_rate"))
            for i in range(len(BIN_EDGES) - 1)]
    # an empty bin's sums are null, so its means are
    return tally.groupBy(*by).agg(*sums).select(*by, F.inline(F.array(*rows)))


def ece(preds: DataFrame, label: str = "label", score: str = "score", by=()) -> DataFrame:
    """H6: expected calibration error = sum n/N |mean p - observed| over non-empty bins."""
    return _sums(score_tally(preds, label, score, by), {"expected_calibration_error": _ece_column()}, by)


def evaluate(preds: DataFrame, threshold, label: str = "label", score: str = "score", by=(), buckets: int | None = None, calibration: bool = False) -> DataFrame:
    """Full metric row per group: AP, ROC-AUC, Brier + confusion at the threshold (and ECE with ``calibration``)."""
    return evaluate_tally(score_tally(preds, label, score, by), threshold, by, buckets, calibration)


def evaluate_tally(tally: DataFrame, threshold, by=(), buckets: int | None = None, calibration: bool = False) -> DataFrame:
    """The metric row per group from its tally: one ladder and one aggregate over it."""
    pooled = not by
    if pooled:  # one group: a constant key keeps the same grouped code path
        tally, by = tally.withColumn("_all", F.lit(0)), ["_all"]
    by = list(by)
    columns = ranking_columns() | {"brier_score": _brier_column()} | _confusion_columns(threshold)
    if calibration:
        columns["expected_calibration_error"] = _ece_column()
    out = _with_rates(_sums(ladder_of(tally, by, buckets), columns, by))
    return out.drop("_all") if pooled else out


def operating_threshold(preds: DataFrame, minimum_recall: float = 0.70, label: str = "label", score: str = "score", by=(), buckets: int | None = None) -> DataFrame:
    """H7: one threshold per group from the ladder candidates."""
    return threshold_of(score_tally(preds, label, score, by), minimum_recall, by, buckets)


def threshold_of(tally: DataFrame, minimum_recall: float = 0.70, by=(), buckets: int | None = None) -> DataFrame:
    return select_threshold(threshold_candidates(ladder_of(tally, by, buckets), by), minimum_recall, by)


def threshold_policies(preds: DataFrame, label: str = "label", score: str = "score", by=(), buckets: int | None = None) -> DataFrame:
    """H8: four policies."""
    return policies_of(score_tally(preds, label, score, by), by, buckets)


def policies_of(tally: DataFrame, by=(), buckets: int | None = None) -> DataFrame:
    return policy_thresholds(threshold_candidates(ladder_of(tally, by, buckets), by), by)


def policy_transfer(preds: DataFrame, fold: str = "fold", label: str = "label", score: str = "score", buckets: int | None = None) -> DataFrame:
    """H9: policies chosen on all folds but the last, evaluated on the last fold only.
    One tally by fold serves both; one aggregate over the latest fold scores all four thresholds."""
    tally = score_tally(preds, label, score, [fold])
    last = tally.select(F.max(fold)).scalar()
    # four (policy, threshold) rows: a bounded result, fetched once
    pol = {r["policy"]: r["threshold"] for r in policies_of(rolled_up(tally.where(F.col(fold) < last)), (), buckets).collect()}
    names = ["approximately_70_percent_recall", "approximately_80_percent_recall", "best_validation_f1", "fn_cost_3x_fp"]
    counts = ("true_positives", "false_positives", "false_negatives", "true_negatives")
    at = {n: _confusion_columns(float(pol[n])) for n in names}
    sums = tally.where(F.col(fold) == last).agg(*[at[n][c].alias(f"{c}{i}") for i, n in enumerate(names) for c in counts])
    rows = [F.struct(F.lit(n).alias("policy"), F.lit(float(pol[n])).alias("threshold"), *[F.col(f"{c}{i}").alias(c) for c in counts]) for i, n in enumerate(names)]
    return _with_rates(sums.select(F.inline(F.array(*rows))))


def fold_summary(metric_table: DataFrame, metrics=("pr_auc", "roc_auc", "brier_score", "precision", "recall", "false_positives", "false_negatives"), by=()) -> DataFrame:
    """Mean, population std, min, max of each metric over folds (one row per metric)."""
    aggs = []
    for m in metrics:
        c = F.col(m).cast("double")
        aggs += [F.avg(c).alias(f"{m}__mean"), F.stddev_pop(c).alias(f"{m}__std"), F.min(c).alias(f"{m}__min"), F.max(c).alias(f"{m}__max")]
    wide = metric_table.groupBy(*by).agg(*aggs)
    rows = [F.struct(F.lit(m).alias("metric"), F.col(f"{m}__mean").alias("mean"), F.col(f"{m}__std").alias("std"),
                     F.col(f"{m}__min").alias("min"), F.col(f"{m}__max").alias("max")) for m in metrics]
    return wide.select(*by, F.inline(F.array(*rows)))
