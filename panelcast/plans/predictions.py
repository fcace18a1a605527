"""Prediction tables: (fold, entity, period, label, score [, extras]) per validation row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.splits import assign_folds
from ..spec import PanelSpec


def rule_score(spec: PanelSpec, scale: float = 10.0) -> Column:
    """Deterministic score from a trailing-mean feature: min(1, unplanned 3-period mean / scale)."""
    from ..spec import feature_prefix
    return F.least(F.lit(1.0), F.col(f"{feature_prefix(spec.unplanned)}_roll_3_mean") / scale)


def fold_predictions(dev: DataFrame, spec: PanelSpec, label: str, score: Column, last_period, months: int, count: int,
                     extras: tuple[str, ...] = ()) -> DataFrame:
    """Validation rows of every fold with a score; no row is copied (each row validates at most one fold)."""
    a = assign_folds(dev, spec, last_period, months, count)
    return a.where(F.col("validation_fold").isNotNull()).select(
        F.col("validation_fold").alias("fold"), spec.entity, spec.period, F.col(label).alias("label"),
        score.alias("score"), "first_train_fold", *extras)
