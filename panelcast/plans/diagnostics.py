"""Diagnostics that fit models beside the rolling folds: entity-disjoint groups (F5), the age pressure test
(G17) and the prospective stage (F9, I11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.metrics import evaluate
from ..operators.prep import fold_counts
from ..operators.splits import Fold
from ..session import written
from ..spec import PanelSpec
from .forest import ForestParams, fit_forests
from .logistic import Candidate, fit_logistic, sides
from .modeling import ModelSpec, in_parallel

GROUP = "group_fold"


def disjoint_groups(grouped: DataFrame, spec: PanelSpec, k: int) -> list[Fold]:
    """The groups of ``splits.group_folds`` as folds: every other group trains, the group validates."""
    other, own = [F.col(GROUP) != g for g in range(k)], [F.col(GROUP) == g for g in range(k)]
    return [Fold(f"group_{g + 1}", g, None, None, grouped.where(other[g]), grouped.where(own[g]), grouped, other[g], own[g]) for g in range(k)]


def shared_entities(grouped: DataFrame, spec: PanelSpec) -> DataFrame:
    """(group, shared_entities): entities of a group that also occur outside it; a split is disjoint when all are 0."""
    own = grouped.select(F.col(spec.entity).alias("e"), GROUP).distinct()
    other = own.select(F.col("e").alias("e2"), F.col(GROUP).alias("g2"))
    leaked = own.join(other, (F.col("e") == F.col("e2")) & (F.col(GROUP) != F.col("g2")), "left_semi")
    return own.groupBy(GROUP).agg(F.count(F.lit(1)).alias("entities")).join(
        leaked.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n")), GROUP, "left").select(GROUP, "entities", F.coalesce("n", F.lit(0)).alias("shared_entities"))


def entity_disjoint(grouped: DataFrame, spec: PanelSpec, features: list[str], label: str, k: int, logistic: ModelSpec, forest: ForestParams, threshold: float = 0.5) -> DataFrame:
    """per learner and group: rows, entities, shared entities and the metric row, ECE included. Not a temporal validation."""
    folds = disjoint_groups(grouped, spec, k)
    training = [(f.position, f.training) for f in folds]
    counts = fold_counts(grouped, features, training)  # medians, scales and bins of both learners
    linear, fitted = in_parallel([  # the short passes of the one run beside the bins of the other
        lambda: fit_logistic(grouped, sides(folds), {c: F.col(c) for c in spec.key}, label, [Candidate.of(features, logistic.params)], counts=counts),
        lambda: fit_forests(grouped, training, features, list(spec.key), label, [forest], counts=counts)])
    scored = fitted.score_folds(grouped, [(f.position, f.validating) for f in folds], list(spec.key), label)
    preds = linear.score().select(F.lit("logistic").alias("learner"), F.col("fold").alias(GROUP), "label", "score").unionByName(
        scored.select(F.lit("forest").alias("learner"), F.col("fold").alias(GROUP), "label", "score"))
    sizes = grouped.groupBy(GROUP).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col(label).cast("double")).alias("prevalence")).join(shared_entities(grouped, spec), GROUP)
    return evaluate(preds, threshold, by=["learner", GROUP], calibration=True).join(sizes, GROUP)


def sliced_predictions(folds: list[Fold], spec: PanelSpec, features: list[str], label: str, variants: dict[str, list[str]], m: ModelSpec, extras: dict) -> DataFrame:
    """(variant, fold, key, extras, label, score): all variants of all folds in the same passes over one table; a variant
    reads its slice of the imputed and scaled features, which equals an assembly of its own, as statistics are per feature."""
    candidates = [Candidate.of(variants[name], m.params) for name in variants]
    keep = {c: F.col(c) for c in spec.key} | extras
    scored = fit_logistic(folds[0].rows, sides(folds), keep, label, candidates).score()
    name = F.element_at(F.array(*[F.lit(v) for v in variants]), F.col("model") + 1)
    return written(scored.select(name.alias("variant"), "fold", *keep, F.col("label").cast("int").alias("label"), "score"), "variants")


def age_pressure(preds: DataFrame, baseline: str, without: str, fold_count: int) -> DataFrame:
    """Per variant and subgroup (``all``, observed or imputed age) the means over folds, and what age adds
    to the full set's mean AP. A subgroup counts where both classes occur in its fold."""
    both = preds.withColumn("subgroup", F.explode(F.array(F.lit("all"), F.col("age_group"))))
    by = ["variant", "subgroup", "fold"]
    rows = both.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), (F.count_if(F.col("label") == 1) * F.count_if(F.col("label") == 0) > 0).alias("usable"))
    per = rows.join(evaluate(both, 0.5, by=by, calibration=True), by)
    usable = lambda c: F.avg(F.when(F.col("usable"), F.col(c)))
    out = per.groupBy("variant", "subgroup").agg(
        F.sum("rows").alias("rows"), F.count_if("usable").alias("usable_folds"), usable("pr_auc").alias("mean_pr_auc"), F.min(F.when(F.col("usable"), F.col("pr_auc"))).alias("worst_pr_auc"),
        usable("roc_auc").alias("mean_roc_auc"), usable("brier_score").alias("mean_brier"), usable("recall").alias("mean_recall"), usable("expected_calibration_error").alias("mean_ece"))
    whole = out.where("subgroup = 'all'").agg(F.max(F.when(F.col("variant") == baseline, F.col("mean_pr_auc"))).alias("a"), F.max(F.when(F.col("variant") == without, F.col("mean_pr_auc"))).alias("b"))
    return out.withColumn("incremental_mean_pr_auc", whole.select(F.col("a") - F.col("b")).scalar())


def stage_metrics(rows: DataFrame, spec: PanelSpec, threshold: float = 0.5) -> DataFrame:
    """One metric row per stage of (stage, entity, period, label, score)."""
    rows = written(rows, "stages")
    stats = rows.groupBy("stage").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(spec.entity).alias("entities"),
                                      F.avg(F.col("label").cast("double")).alias("prevalence"))
    return stats.join(evaluate(rows, threshold, by=["stage"]), "stage")
