"""End-to-end flows matching the reference's commands, composed from the operators.

``validate`` -> audit report; ``train`` -> fold predictions and metric table;
``final_evaluation`` -> fit on development, score the holdout behind the label gate;
``score_latest`` -> tiered, ranked batch for the period after the latest one.
Only small reports (scalars, a few rows) come back to the driver.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from ..operators.metrics import evaluate
from ..operators.quality import eligibility_audit, feature_history_audit, validate as validate_panel
from ..operators.scoring import assert_nonempty, latest_unlabeled, risk_tier, tier_counts
from ..operators.splits import holdout_labels, split_periods, fold_audit, rolling_folds
from ..spec import FEATURE_SETS, RunConfig
from .cohort import prepare_cohort
from .modeling import ModelSpec, fit_pipeline, fold_predictions, score


def validate(panel: DataFrame, cfg: RunConfig, holdout_start, holdout_end) -> dict:
    """Quality rules (raise on the first failure), eligibility and history audits, fold audit."""
    spec = cfg.spec
    report = {"source_validation": validate_panel(panel, spec)}
    report["eligibility"] = eligibility_audit(panel, spec, cfg.excluded_suffixes).first().asDict()
    report["feature_set_history"] = [r.asDict() for r in feature_history_audit(panel, spec, cfg.excluded_suffixes, FEATURE_SETS).collect()]
    dev = prepare_cohort(panel, cfg, labeled_only=True, before=F.lit(holdout_start).cast("date")).frame
    last = dev.agg(F.max(spec.period).alias("m")).first()["m"]
    report["folds"] = [r.asDict() for r in fold_audit(dev, spec, cfg.rule.name, last, cfg.validation_months, cfg.fold_count).collect()]
    return report


def train(panel: DataFrame, cfg: RunConfig, model: ModelSpec, holdout_start, threshold: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Fold predictions (fold, entity, period, label, score) and the per-fold metric table."""
    prep = prepare_cohort(panel, cfg, labeled_only=True, before=F.lit(holdout_start).cast("date"))
    folds = rolling_folds(prep.frame, cfg.spec, cfg.validation_months, cfg.fold_count)
    preds = fold_predictions(folds, cfg.spec, prep.features, prep.label, model)
    return preds, evaluate(preds, threshold, by=["fold"])


def final_evaluation(panel: DataFrame, cfg: RunConfig, model: ModelSpec, holdout_start, holdout_end, threshold: float,
                     acknowledgment: str, audit_path: str) -> tuple[PipelineModel, DataFrame]:
    """Fit once on development rows, score label-free holdout rows, then unlock labels
    through the acknowledgment gate and evaluate. ``audit_path`` is a table that each access appends to."""
    prep = prepare_cohort(panel, cfg, labeled_only=True)
    marked = split_periods(prep.frame, cfg.spec, holdout_start, holdout_end, prep.label)
    fitted = fit_pipeline(marked.where("split = 'development'"), prep.features, prep.label, model, spread_by=cfg.spec.key)
    scored = score(fitted, marked.where("split = 'holdout'").drop(prep.label)).select(cfg.spec.entity, cfg.spec.period, "score")
    labels = holdout_labels(marked, acknowledgment, audit_path).select(cfg.spec.entity, cfg.spec.period, F.col(prep.label).alias("label"))
    preds = scored.join(labels, [cfg.spec.entity, cfg.spec.period])
    return fitted, evaluate(preds, threshold)


def score_latest(panel: DataFrame, cfg: RunConfig, fitted: PipelineModel) -> tuple[DataFrame, DataFrame]:
    """Latest-period unlabeled rows with enough history: probability, tier, target period,
    ranked by probability (desc) then entity; plus tier counts with zeros."""
    prep = prepare_cohort(panel, cfg)
    batch = assert_nonempty(latest_unlabeled(prep.frame, cfg.spec, prep.label, source=panel))
    scored = score(fitted, batch).select(cfg.spec.entity, cfg.spec.period, "target_period", F.col("score").alias("probability"))
    ranked = scored.withColumn("risk_tier", risk_tier(F.col("probability"))).orderBy(F.col("probability").desc(), cfg.spec.entity)
    return ranked, tier_counts(scored, "probability")
