"""Prepared cohort (E9): one parameterised chain replacing the per-stage copies.

flags -> consecutive history -> keep eligible -> label -> features -> C5
-> optional labeled / pre-holdout filter. Every window uses the same
``partitionBy(entity).orderBy(idx)``: one exchange, one sort.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..operators.features import build_features
from ..operators.history import IDX, add_consecutive_history, add_eligibility_flags
from ..operators.labels import add_next_period_label
from ..spec import FeatureSet, LabelRule, PanelSpec, RunConfig
from ..operators.splits import holdout_window


@dataclass(frozen=True)
class Prepared:
    frame: DataFrame
    features: list[str]
    label: str


def flag_and_label(panel: DataFrame, spec: PanelSpec, rule: LabelRule, excluded_suffixes=(), minimum_history: int | None = None) -> DataFrame:
    """Flags + history on the full panel, keep eligible entities, then label.
    Exclusion is per entity, so labeling after it equals labeling before it."""
    flagged = add_consecutive_history(add_eligibility_flags(panel, spec, excluded_suffixes, minimum_history), spec)
    return add_next_period_label(flagged.where("eligible_for_modeling"), spec, rule)


def prepare_cohort(
    panel: DataFrame,
    cfg: RunConfig,
    *,
    labeled_only: bool = False,
    before=None,
    feature_set: FeatureSet | None = None,
    apply_history_filter: bool = True,
) -> Prepared:
    fs = feature_set or cfg.feature_set
    labeled = flag_and_label(panel, cfg.spec, cfg.rule, cfg.excluded_suffixes)
    featured, names = build_features(labeled, cfg.spec, fs)
    out = featured
    if apply_history_filter:
        out = out.where(F.col("consecutive_history_months") >= fs.minimum_history)
    if labeled_only:
        out = out.where(F.col(cfg.rule.name).isNotNull())
    if before is not None:
        out = out.where(F.col(cfg.spec.period) < before)
    return Prepared(out.drop(IDX), names, cfg.rule.name)


def development_panel(panel: DataFrame, cfg: RunConfig, feature_set: FeatureSet | None = None) -> tuple[Prepared, object, object]:
    """Labeled, history-filtered rows before the holdout window; returns the bounds too."""
    start, end = holdout_window(panel, cfg.spec, cfg.holdout_months)
    prep = prepare_cohort(panel, cfg, labeled_only=True, before=start, feature_set=feature_set)
    return prep, start, end
