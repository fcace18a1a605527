"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver's whole tables (no id subsets, no row caps) and
derives the panel with Spark, so its work grows with the data. Limits appear
only where the operator is a top-k report.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextvars import ContextVar
from dataclasses import replace
from functools import wraps

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .operators import history, labels
from .plans.cohort import flag_and_label
from .session import checkpoint_dir, cut_lineage, written
from .sources.tables import DEFAULT_PANEL, panel_from_lineitem
from .spec import BOOSTING_GRID, FEATURE_SETS, LOCKED_FOREST, RISK_TIER_HIGH, LabelRule, RunConfig

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SPEC = DEFAULT_PANEL
RULE = LabelRule(unplanned_threshold=5, severe_threshold=0, name="label")
TEST_RUN = RunConfig(spec=SPEC, rule=RULE, feature_set=FEATURE_SETS["full_history"], excluded_suffixes=("7",))


#: Frames that the running query call has built; each call, thread and session has its own.
_BUILT: ContextVar[dict | None] = ContextVar("built", default=None)


def query(name: str):
    def deco(fn):
        @wraps(fn)
        def call(spark, sf_dir):
            outer = _BUILT.set({})
            try:
                return fn(spark, sf_dir)
            finally:
                _BUILT.reset(outer)

        REGISTRY[name] = call
        return fn
    return deco


def once(fn):
    """Frames that several parts of one query use are built (and the raw table read) once per query call."""
    @wraps(fn)
    def build(spark, sf_dir, *args):
        built = _BUILT.get()
        if built is None:
            return fn(spark, sf_dir, *args)
        key = (fn.__name__, sf_dir, *args)
        if key not in built:
            built[key] = fn(spark, sf_dir, *args)
        return built[key]
    return build


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (float sums are order dependent across engines)."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


@once
def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity-period panel, materialized once per query in the shared checkpoint folder:
    later jobs (bounds, windows, per-fold statistics, fits) read it instead of re-aggregating
    the raw table. The panel is far smaller than its source (one row per entity and period)."""
    return panel_from_lineitem(spark, sf_dir, materialize=cut_lineage)


@once
def _labeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_and_label(_panel(spark, sf_dir), SPEC, RULE, TEST_RUN.excluded_suffixes)


# --- A: sources -----------------------------------------------------------------------

@query("scan_panel")
def q_scan_panel(spark, sf_dir):
    return rounded(_panel(spark, sf_dir).drop(history.IDX))


# --- C: history -----------------------------------------------------------------------

@query("consecutive_history")
def q_consecutive_history(spark, sf_dir):
    df = history.add_consecutive_history(_panel(spark, sf_dir), SPEC)
    return df.select(SPEC.entity, SPEC.period, "consecutive_history_months")


@query("eligibility_flags")
def q_eligibility_flags(spark, sf_dir):
    df = history.add_eligibility_flags(_panel(spark, sf_dir), SPEC, TEST_RUN.excluded_suffixes, minimum_history=80)
    return df.select(SPEC.entity, SPEC.period, "eligible_for_modeling", "eligibility_reason")


# --- D: labels ------------------------------------------------------------------------

@query("next_period_label")
def q_next_period_label(spark, sf_dir):
    return _labeled(spark, sf_dir).select(SPEC.entity, SPEC.period, RULE.name)


@query("label_prevalence")
def q_label_prevalence(spark, sf_dir):
    """Flagship: prevalence of the history>=6 development panel, rows of unknown label counted apart."""
    from .operators.splits import holdout_window
    panel = _panel(spark, sf_dir)
    start, _ = holdout_window(panel, SPEC, 3)
    dev = _labeled(spark, sf_dir).where((F.col("consecutive_history_months") >= 6) & (F.col(SPEC.period) < start))
    return rounded(labels.prevalence(dev, SPEC, RULE.name))


# --- B: canonicalization and quality ---------------------------------------------------

def _orders_panel(spark, sf_dir):
    from .sources.tables import panel_from_orders
    return panel_from_orders(spark, sf_dir)


@once
def _export(spark, sf_dir, dirty=False):
    from .sources.tables import export_from_lineitem
    return export_from_lineitem(spark, sf_dir, dirty, materialize=cut_lineage)


@query("canonicalize")
def q_canonicalize(spark, sf_dir):
    from .operators.canonical import canonicalize
    return rounded(canonicalize(_export(spark, sf_dir), start_month="1996-01-01", equipment_type="Elevator"))


@query("export_order")
def q_export_order(spark, sf_dir):
    """Newest month first, then entity: the position of every canonical row in the export."""
    from .operators.canonical import canonicalize, parse_period
    from .operators.scoring import ranked
    rows = canonicalize(_export(spark, sf_dir), start_month="1996-01-01", equipment_type="Elevator").select("Month", "`Equipment Code`")
    return ranked(rows, {"d": -F.unix_date(parse_period("Month")), "e": F.col("`Equipment Code`")})


@query("parse_failures")
def q_parse_failures(spark, sf_dir):
    """B3/B4 on a dirty export: unparseable months and non-numeric counts."""
    from .operators.canonical import coerce_count, parse_period
    from .spec import EXPORT_SPEC
    src = _export(spark, sf_dir, True)
    return src.agg(
        F.count_if(parse_period("Month").isNull()).alias("unparseable_months"),
        *[F.count_if(F.col(f"`{c}`").isNotNull() & coerce_count(c).isNull()).alias(f"bad_{c.lower().replace(' ', '_')}")
          for c in EXPORT_SPEC.counts],
    )


@query("normalize_ratio")
def q_normalize_ratio(spark, sf_dir):
    from .operators.canonical import ratio_report
    from .spec import EXPORT_SPEC
    return rounded(ratio_report(_export(spark, sf_dir), EXPORT_SPEC.ratios))


@query("rule_violations")
def q_rule_violations(spark, sf_dir):
    from .operators.quality import rule_violations
    return rule_violations(_panel(spark, sf_dir), SPEC)


@query("dup_keys")
def q_dup_keys(spark, sf_dir):
    """B9 on raw shipments keyed by (supplier, ship day): many repeated keys."""
    from .operators.quality import duplicate_keys
    from .spec import PanelSpec
    from .sources.tables import read_table
    raw = read_table(spark, sf_dir, "lineitem", ["l_suppkey", "l_shipdate"])
    return duplicate_keys(raw, PanelSpec(entity="l_suppkey", period="l_shipdate"))


@query("gap_count")
def q_gap_count(spark, sf_dir):
    from .operators.quality import gap_count
    return gap_count(_orders_panel(spark, sf_dir), SPEC)


@query("history_summary")
def q_history_summary(spark, sf_dir):
    from .operators.quality import history_summary
    return rounded(history_summary(_orders_panel(spark, sf_dir), SPEC))


@query("null_profile")
def q_null_profile(spark, sf_dir):
    from .operators.quality import null_profile
    return null_profile(_panel(spark, sf_dir).drop(history.IDX))


@query("panel_profile")
def q_panel_profile(spark, sf_dir):
    from .operators.quality import panel_profile
    return panel_profile(_panel(spark, sf_dir), SPEC)


@query("eligibility_audit")
def q_eligibility_audit(spark, sf_dir):
    from .operators.quality import eligibility_audit
    return eligibility_audit(_panel(spark, sf_dir), SPEC, TEST_RUN.excluded_suffixes)


@query("feature_history_audit")
def q_feature_history_audit(spark, sf_dir):
    from .operators.quality import feature_history_audit
    return feature_history_audit(_panel(spark, sf_dir), SPEC, TEST_RUN.excluded_suffixes, FEATURE_SETS)


@query("missing_age_audit")
def q_missing_age_audit(spark, sf_dir):
    from .operators.quality import missing_age_audit
    return missing_age_audit(_panel(spark, sf_dir), SPEC, TEST_RUN.excluded_suffixes)


AGE_BAND = (1, 1)  # panel age is in months: a normal step is exactly +1


def _pre_holdout_eligible(spark, sf_dir):
    from .operators.splits import holdout_window
    panel = _panel(spark, sf_dir)
    start, _ = holdout_window(panel, SPEC, 3)
    return _labeled(spark, sf_dir).where(F.col(SPEC.period) < start)


@query("age_behavior")
def q_age_behavior(spark, sf_dir):
    from .operators.quality import age_behavior
    return rounded(age_behavior(_pre_holdout_eligible(spark, sf_dir), SPEC, AGE_BAND))


@query("age_resets")
def q_age_resets(spark, sf_dir):
    from .operators.quality import age_examples
    return rounded(age_examples(_pre_holdout_eligible(spark, sf_dir), SPEC, AGE_BAND, "reset", 20))


@query("age_anomalies")
def q_age_anomalies(spark, sf_dir):
    """The first twenty transitions outside the band that are no resets."""
    from .operators.quality import age_examples
    return rounded(age_examples(_pre_holdout_eligible(spark, sf_dir), SPEC, AGE_BAND, "anomaly", 20))


# --- C5 / E: features ---------------------------------------------------------------------

def _featured(spark, sf_dir, fs=None, age=True, season=True):
    from .operators.features import build_features
    fs = replace(fs or FEATURE_SETS["full_history"], include_age=age, include_season=season)
    return build_features(_labeled(spark, sf_dir), SPEC, fs)


@query("feature_eligibility")
def q_feature_eligibility(spark, sf_dir):
    df = history.add_feature_set_eligibility(_labeled(spark, sf_dir), SPEC, FEATURE_SETS["short_history"].minimum_history)
    return df.select(SPEC.entity, SPEC.period, "eligible_for_feature_set")


@query("panel_features")
def q_panel_features(spark, sf_dir):
    """Full history set with age and season on the eligible labeled panel."""
    df, names = _featured(spark, sf_dir)
    return rounded(df.select(SPEC.entity, SPEC.period, RULE.name, *names))


@query("lag_features")
def q_lag_features(spark, sf_dir):
    """E2 on the sparse panel: row lags, blind to gaps (hence C5 before use)."""
    from .operators.features import feature_expressions
    from .spec import FeatureSet
    exprs = feature_expressions(SPEC, FeatureSet("lags", lags=(1, 2, 3)))
    d = history.with_index(_orders_panel(spark, sf_dir), SPEC)
    return d.select(SPEC.entity, SPEC.period, *[e.alias(n) for n, e in exprs if "_lag_" in n and n.startswith("unplanned")])


@query("rolling_features")
def q_rolling_features(spark, sf_dir):
    """E3 on the sparse panel: trailing means incl. the current row, nulls skipped."""
    from .operators.features import feature_expressions
    from .spec import FeatureSet
    exprs = feature_expressions(SPEC, FeatureSet("rolls", windows=(3, 6)))
    d = history.with_index(_orders_panel(spark, sf_dir), SPEC)
    return rounded(d.select(SPEC.entity, SPEC.period, *[e.alias(n) for n, e in exprs if "_roll_" in n]))


@query("season_features")
def q_season_features(spark, sf_dir):
    """E5 on the daily panel: month of year and winter flag."""
    from .sources.tables import DAILY_PANEL, panel_from_events
    p = panel_from_events(spark, sf_dir)
    return p.select(DAILY_PANEL.entity, DAILY_PANEL.period, F.month(DAILY_PANEL.period).alias("month_of_year"),
                    F.month(DAILY_PANEL.period).isin(12, 1, 2).cast("int").alias("is_winter"))


@query("prepared_cohort")
def q_prepared_cohort(spark, sf_dir):
    """Flags -> history -> eligible -> label -> features -> C5 -> labeled, pre-holdout."""
    from .plans.cohort import development_panel
    prep, _, _ = development_panel(_panel(spark, sf_dir), TEST_RUN)
    return rounded(prep.frame.select(SPEC.entity, SPEC.period, prep.label, "consecutive_history_months", *prep.features))


@once
def _dev(spark, sf_dir, fs=None):
    """Development cohort (labeled, history >= minimum, before the holdout), materialized once."""
    from .plans.cohort import development_panel
    prep, start, end = development_panel(_panel(spark, sf_dir), TEST_RUN, fs)
    return replace(prep, frame=cut_lineage(prep.frame)), start, end


SEQ_LEN = 6


@query("sequence_windows")
def q_sequence_windows(spark, sf_dir):
    """Windows of 6 consecutive periods ending at each labeled development row, one row per step."""
    from .operators.features import build_sequences, explode_sequences
    from .operators.splits import holdout_window
    start, _ = holdout_window(_panel(spark, sf_dir), SPEC, 3)
    lab = _labeled(spark, sf_dir)
    seq = build_sequences(lab, SPEC, SEQ_LEN, RULE.name).where(F.col("end_period") < start)
    return rounded(explode_sequences(seq, SPEC))


@query("sequence_cohorts")
def q_sequence_cohorts(spark, sf_dir):
    """E8 for L in (6, 12, 24): rows, entities, entities lost vs. the labeled development panel.
    A window of L consecutive rows ends at a row iff its consecutive history >= L, so one
    pass with conditional counts replaces three array builds."""
    from .operators.splits import holdout_window
    start, _ = holdout_window(_panel(spark, sf_dir), SPEC, 3)
    dev = _labeled(spark, sf_dir).where(F.col(RULE.name).isNotNull() & (F.col(SPEC.period) < start))
    lengths = (6, 12, 24)
    per_entity = dev.groupBy(SPEC.entity).agg(
        *[F.count_if(F.col("consecutive_history_months") >= n).alias(f"r{n}") for n in lengths])
    wide = per_entity.agg(
        F.count(F.lit(1)).alias("base"),
        *[F.sum(f"r{n}").alias(f"rows{n}") for n in lengths],
        *[F.count_if(F.col(f"r{n}") > 0).alias(f"ent{n}") for n in lengths],
    )
    rows = [F.struct(F.lit(n).alias("sequence_length"), F.col(f"rows{n}").cast("bigint").alias("rows"),
                     F.col(f"ent{n}").alias("entities"), (F.col("base") - F.col(f"ent{n}")).alias("entities_lost"))
            for n in lengths]
    return wide.select(F.inline(F.array(*rows)))


# --- F: splits ---------------------------------------------------------------------------

def _labeled_feat(spark, sf_dir):
    """Labeled, history>=6 rows (all periods) with bounds of the holdout."""
    from .plans.cohort import prepare_cohort
    from .operators.splits import holdout_window
    panel = _panel(spark, sf_dir)
    start, end = holdout_window(panel, SPEC, 3)
    prep = prepare_cohort(panel, TEST_RUN, labeled_only=True)
    return prep, start, end


@query("holdout_split")
def q_holdout_split(spark, sf_dir):
    prep, start, end = _labeled_feat(spark, sf_dir)
    p = F.col(SPEC.period)
    return prep.frame.where(p <= end).select(
        SPEC.entity, SPEC.period, F.when(p < start, "development").otherwise("holdout").alias("split"))


@query("latest_split")
def q_latest_split(spark, sf_dir):
    from .operators.splits import latest_split
    prep, _, _ = _dev(spark, sf_dir)
    train, val = latest_split(prep.frame, SPEC, 3)
    return train.select(SPEC.entity, SPEC.period, F.lit("train").alias("role")).unionByName(
        val.select(SPEC.entity, SPEC.period, F.lit("validation").alias("role")))


def _last_dev_period(dev):
    return dev.select(F.max(SPEC.period)).scalar()


@query("rolling_folds")
def q_rolling_folds(spark, sf_dir):
    from .operators.splits import assign_folds
    prep, _, _ = _dev(spark, sf_dir)
    dev = prep.frame
    a = assign_folds(dev, SPEC, _last_dev_period(dev), TEST_RUN.validation_months, TEST_RUN.fold_count)
    return a.select(SPEC.entity, SPEC.period, "validation_fold", "first_train_fold", "train_fold_count")


@query("fold_audit")
def q_fold_audit(spark, sf_dir):
    from .operators.splits import fold_audit
    prep, _, _ = _dev(spark, sf_dir)
    dev = prep.frame
    last = dev.agg(F.max(SPEC.period).alias("m")).first()["m"]
    return rounded(fold_audit(dev, SPEC, RULE.name, last, TEST_RUN.validation_months, TEST_RUN.fold_count))


@query("group_folds")
def q_group_folds(spark, sf_dir):
    """entity-disjoint folds of like size; ``shared_entities`` counts entities seen in more than one fold (must be 0)."""
    from .operators.splits import group_folds
    from .plans.diagnostics import shared_entities
    prep, _, _ = _dev(spark, sf_dir)
    g = written(group_folds(prep.frame.select(*SPEC.key, RULE.name), SPEC, 4), "groups")
    per = g.groupBy("group_fold").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col(RULE.name).cast("double")).alias("prevalence"))
    return rounded(per.join(shared_entities(g, SPEC), "group_fold"))


@query("entity_disjoint_models")
def q_entity_disjoint_models(spark, sf_dir):
    """F5 with fitted models: logistic and the locked forest, each group scored by a fit on all other groups."""
    from .operators.splits import group_folds
    from .plans.diagnostics import entity_disjoint
    prep, _, _ = _dev(spark, sf_dir)
    g = written(group_folds(prep.frame, SPEC, 4), "groups")
    return entity_disjoint(g, SPEC, prep.features, RULE.name, 4, LOGISTIC, ForestParams.of(LOCKED_FOREST))


@query("holdout_counts")
def q_holdout_counts(spark, sf_dir):
    """holdout rows with feature history vs. target-eligible holdout rows per period."""
    from .operators.splits import holdout_counts
    prep, start, end = _labeled_feat(spark, sf_dir)
    p = F.col(SPEC.period)
    holdout = prep.frame.where(p.between(start, end)).drop(RULE.name)
    expected = _labeled(spark, sf_dir).where(F.col(RULE.name).isNotNull() & p.between(start, end)) \
        .groupBy(SPEC.period).agg(F.count(F.lit(1)).alias("expected_rows"))
    return holdout_counts(holdout, SPEC, expected)


@query("calibration_split")
def q_calibration_split(spark, sf_dir):
    """F8: per fold, training rows before / inside the last 3 training months (calibrator only)."""
    from .operators.splits import calibration_split_counts
    prep, _, _ = _dev(spark, sf_dir)
    dev = prep.frame
    last = dev.agg(F.max(SPEC.period).alias("m")).first()["m"]
    return calibration_split_counts(dev, SPEC, last, TEST_RUN.validation_months, TEST_RUN.fold_count, 3)


#: Periods that arrive after the earlier holdout of the prospective stage.
ARRIVED = 6


def _earlier_holdout(spark, sf_dir):
    """The holdout as it was ARRIVED periods ago; all labeled rows behind it are prospective now."""
    from .operators.splits import holdout_window
    return holdout_window(_panel(spark, sf_dir), SPEC, 3, gap=1 + ARRIVED)


@query("prospective_rows")
def q_prospective_rows(spark, sf_dir):
    """labeled rows after an earlier holdout, as a table that they were appended to holds them."""
    from .operators.splits import prospective_rows
    from .sources.sinks import append_periods
    prep, _, _ = _labeled_feat(spark, sf_dir)
    _, end = _earlier_holdout(spark, sf_dir)
    rows = written(prep.frame.select(SPEC.entity, SPEC.period, RULE.name), "labeled")
    path = f"{checkpoint_dir(spark)}/panelcast-periods-{uuid.uuid4().hex}"
    append_periods(rows.where(F.col(SPEC.period) <= end), path, SPEC.period)
    table = append_periods(rows, path, SPEC.period)  # adds the later periods alone
    return prospective_rows(table, SPEC, RULE.name, end).select(SPEC.entity, SPEC.period, RULE.name)


@query("chrono_split")
def q_chrono_split(spark, sf_dir):
    from .operators.splits import chrono_split
    prep, _, _ = _dev(spark, sf_dir)
    return chrono_split(prep.frame.select(SPEC.entity, SPEC.period), SPEC, 0.85)


# --- H: metrics on a deterministic score (exact SQL oracle) ---------------------------------

def _preds(spark, sf_dir, extras=()):
    from .plans.predictions import fold_predictions, rule_score
    prep, _, _ = _dev(spark, sf_dir)
    dev = prep.frame
    last = dev.agg(F.max(SPEC.period).alias("m")).first()["m"]
    return fold_predictions(dev, SPEC, RULE.name, rule_score(SPEC), last, TEST_RUN.validation_months, TEST_RUN.fold_count, extras)


@query("confusion")
def q_confusion(spark, sf_dir):
    from .operators.metrics import confusion
    return rounded(confusion(_preds(spark, sf_dir), 0.5, by=["fold"]))


@query("average_precision")
def q_average_precision(spark, sf_dir):
    from .operators.ladder import ranking_metrics, score_ladder
    return rounded(ranking_metrics(score_ladder(_preds(spark, sf_dir), by=["fold"]), ["fold"]).select("fold", "pr_auc"))


@query("roc_auc")
def q_roc_auc(spark, sf_dir):
    from .operators.ladder import ranking_metrics, score_ladder
    return rounded(ranking_metrics(score_ladder(_preds(spark, sf_dir), by=["fold"]), ["fold"]).select("fold", "roc_auc"))


@query("brier")
def q_brier(spark, sf_dir):
    """H5: Brier per fold and skill vs. the fold's training-prevalence constant."""
    from .operators.metrics import brier
    from .operators.splits import fold_audit
    prep, _, _ = _dev(spark, sf_dir)
    dev = prep.frame
    last = dev.agg(F.max(SPEC.period).alias("m")).first()["m"]
    prev = fold_audit(dev, SPEC, RULE.name, last, TEST_RUN.validation_months, TEST_RUN.fold_count) \
        .where("role = 'train'").select(F.col("position").alias("fold"), F.col("prevalence").alias("_prev"))
    p = written(_preds(spark, sf_dir).join(F.broadcast(prev), "fold"), "predictions")  # a k-row table is broadcast
    ref = p.groupBy("fold").agg(F.avg(F.pow(F.col("_prev") - F.col("label"), 2)).alias("reference_brier"))
    out = brier(p, by=["fold"]).select("fold", "brier_score").join(ref, "fold")
    return rounded(out.withColumn("brier_skill", 1 - F.col("brier_score") / F.col("reference_brier")))


@query("calibration_bins")
def q_calibration_bins(spark, sf_dir):
    from .operators.metrics import calibration_bins
    return rounded(calibration_bins(_preds(spark, sf_dir), by=["fold"]))


@query("ece")
def q_ece(spark, sf_dir):
    from .operators.metrics import ece
    return rounded(ece(_preds(spark, sf_dir), by=["fold"]))


@query("operating_threshold")
def q_operating_threshold(spark, sf_dir):
    """H7: pooled threshold for recall >= 0.70 (precision first), F1 fallback."""
    from .operators.metrics import operating_threshold
    return rounded(operating_threshold(_preds(spark, sf_dir), 0.70))


@query("threshold_policies")
def q_threshold_policies(spark, sf_dir):
    from .operators.metrics import threshold_policies
    return rounded(threshold_policies(_preds(spark, sf_dir)))


@query("policy_transfer")
def q_policy_transfer(spark, sf_dir):
    from .operators.metrics import policy_transfer
    return rounded(policy_transfer(_preds(spark, sf_dir)))


def _pooled_eval(spark, sf_dir):
    """One tally by fold gives the pooled threshold, the metrics per fold and the pooled ones."""
    from .operators.ladder import rolled_up, score_tally
    from .operators.metrics import evaluate_tally, threshold_of
    tally = score_tally(_preds(spark, sf_dir), by=["fold"])
    pooled = rolled_up(tally)
    t = threshold_of(pooled, 0.70).select("threshold").scalar()
    return evaluate_tally(tally, t, ["fold"]).withColumn("threshold", t), evaluate_tally(pooled, t).withColumn("threshold", t)


@query("pooled_metrics")
def q_pooled_metrics(spark, sf_dir):
    """One pooled threshold, metrics per fold plus the pooled row."""
    per_fold, pooled = _pooled_eval(spark, sf_dir)
    per = per_fold.withColumn("scope", F.concat(F.lit("fold_"), F.col("fold").cast("string"))).drop("fold")
    return rounded(per.unionByName(pooled.withColumn("scope", F.lit("pooled"))))


@query("fold_summary")
def q_fold_summary(spark, sf_dir):
    from .operators.metrics import fold_summary
    return rounded(fold_summary(_pooled_eval(spark, sf_dir)[0]))


@query("metrics_by_period")
def q_metrics_by_period(spark, sf_dir):
    """Rows, entities, positives, prevalence, AP, AUC, Brier, ECE and confusion at 0.5 per period."""
    from .operators.metrics import evaluate
    p = written(_preds(spark, sf_dir), "predictions")
    stats = p.groupBy(SPEC.period).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(SPEC.entity).alias("entities"),
                                       F.sum("label").cast("bigint").alias("positives"), F.avg(F.col("label").cast("double")).alias("prevalence"))
    return rounded(stats.join(evaluate(p, 0.5, by=[SPEC.period], calibration=True), SPEC.period))


@query("calibration_by_period")
def q_calibration_by_period(spark, sf_dir):
    """H6 inside H12: the five reliability bins of every validation period."""
    from .operators.metrics import calibration_bins
    return rounded(calibration_bins(_preds(spark, sf_dir), by=[SPEC.period]))


@query("subgroup_metrics")
def q_subgroup_metrics(spark, sf_dir):
    """Per fold and age subgroup; metrics only when both classes occur."""
    from .operators.metrics import evaluate
    p = written(_preds(spark, sf_dir, extras=(SPEC.age,)).withColumn(
        "subgroup", F.when(F.col(SPEC.age).isNull(), "imputed_age").otherwise("observed_age")), "predictions")
    by = ["fold", "subgroup"]
    sizes = p.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), (F.countDistinct("label") == 2).alias("metrics_available"))
    m = evaluate(p, 0.5, by=by).select(*by, "pr_auc", "roc_auc", "brier_score", "precision", "recall")
    out = sizes.join(m, by, "left")
    gated = [F.when(F.col("metrics_available"), F.col(c)).alias(c) for c in ("pr_auc", "roc_auc", "brier_score", "precision", "recall")]
    return rounded(out.select(*by, "rows", "metrics_available", *gated))


# --- D: remaining label operators ------------------------------------------------------------

SECOND = LabelRule(unplanned_threshold=3, severe_threshold=0, name="label_secondary")


@query("label_variants")
def q_label_variants(spark, sf_dir):
    from .operators.labels import add_label_variants
    from .plans.cohort import flag_and_label
    df = add_label_variants(flag_and_label(_panel(spark, sf_dir), SPEC, RULE, TEST_RUN.excluded_suffixes).drop(RULE.name), SPEC, RULE, SECOND)
    return df.select(SPEC.entity, SPEC.period, RULE.name, SECOND.name)


@query("current_period_label")
def q_current_period_label(spark, sf_dir):
    from .operators.labels import current_period_label
    return _panel(spark, sf_dir).select(SPEC.entity, SPEC.period, current_period_label(SPEC, RULE).alias("current_label"))


@query("prevalence_populations")
def q_prevalence_populations(spark, sf_dir):
    """Nested populations on a source truncated at the holdout start (no holdout label can exist)."""
    from .operators.splits import holdout_window
    panel = _panel(spark, sf_dir)
    start, _ = holdout_window(panel, SPEC, 3)
    safe = panel.where(F.col(SPEC.period) <= start)
    lab = flag_and_label(safe, SPEC, RULE, TEST_RUN.excluded_suffixes)
    dev = lab.where((F.col(SPEC.period) < start) & F.col(RULE.name).isNotNull())
    h = F.col("consecutive_history_months")
    pops = [("all_eligible", F.lit(True)), ("history_1", h >= 1), ("history_4", h >= 4), ("history_6", h >= 6)]
    y = F.col(RULE.name) == 1
    # per-entity partial counts first: distinct entities become plain counts (no row expansion)
    per_entity = dev.groupBy(SPEC.entity).agg(
        *[F.count_if(cond).alias(f"{name}__n") for name, cond in pops],
        *[F.count_if(cond & y).alias(f"{name}__p") for name, cond in pops])
    aggs = []
    for name, _ in pops:
        aggs += [F.sum(f"{name}__n").cast("bigint").alias(f"{name}__n"), F.sum(f"{name}__p").cast("bigint").alias(f"{name}__p"),
                 F.count_if(F.col(f"{name}__n") > 0).alias(f"{name}__e")]
    wide = per_entity.agg(*aggs)
    rows = [F.struct(F.lit(n).alias("population"), F.col(f"{n}__n").alias("labeled_rows"), F.col(f"{n}__p").alias("positive_rows"),
                     (F.col(f"{n}__n") - F.col(f"{n}__p")).alias("negative_rows"),
                     (F.col(f"{n}__p") / F.col(f"{n}__n")).alias("prevalence"), F.col(f"{n}__e").alias("entities")) for n, _ in pops]
    unlabeled = lab.where(F.col(RULE.name).isNull()).select(F.count(F.lit(1))).scalar()
    return rounded(wide.select(F.inline(F.array(*rows))).withColumn("safe_source_unlabeled_rows", unlabeled))


def _safe_flagged(spark, sf_dir):
    """The panel up to the holdout start, which only serves as the outcome of the period before; no later label exists."""
    from .operators.history import add_consecutive_history, add_eligibility_flags
    from .operators.splits import holdout_window
    panel = _panel(spark, sf_dir)
    start, _ = holdout_window(panel, SPEC, 3)
    return add_consecutive_history(add_eligibility_flags(panel.where(F.col(SPEC.period) <= start), SPEC, TEST_RUN.excluded_suffixes), SPEC), start


@query("label_decomposition")
def q_label_decomposition(spark, sf_dir):
    """D6 over development rows: clauses of the next-period label."""
    from .operators.labels import label_decomposition
    flagged, start = _safe_flagged(spark, sf_dir)
    return label_decomposition(flagged.where("eligible_for_modeling"), SPEC, RULE, before=start)


@query("prevalence_alternatives")
def q_prevalence_alternatives(spark, sf_dir):
    """Prevalence under other label definitions, with and without the excluded entities."""
    from .operators.labels import prevalence_alternatives
    flagged, start = _safe_flagged(spark, sf_dir)
    return rounded(prevalence_alternatives(flagged, SPEC, RULE, start))


# --- A: source profile, fingerprint, snapshot diff ----------------------------------------

@query("source_profile")
def q_source_profile(spark, sf_dir):
    """A5 on the raw export: rows, columns, month range, entities, duplicate keys, rows per type."""
    from .operators.canonical import parse_period
    src = _export(spark, sf_dir)
    per_type = src.groupBy(F.col("`Equipment Type`").alias("equipment_type")).agg(F.count(F.lit(1)).alias("type_rows"))
    dup = src.groupBy("`Equipment Code`", "Month").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1") \
        .select(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint")).scalar()
    stats = src.agg(F.count(F.lit(1)).alias("rows"), F.min(parse_period("Month")).alias("first_month"),
                    F.max(parse_period("Month")).alias("last_month"), F.countDistinct("`Equipment Code`").alias("entities"))
    return per_type.withColumns({
        "rows": stats.select("rows").scalar(), "columns": F.lit(len(src.columns)),
        "first_month": stats.select("first_month").scalar(), "last_month": stats.select("last_month").scalar(),
        "entities": stats.select("entities").scalar(), "duplicate_keys": dup})


@query("table_fingerprint")
def q_table_fingerprint(spark, sf_dir):
    """Order-insensitive content fingerprint of each input table (row count + hash sum); its SQL form reads
    times to the second and floats to the millionth, ``content_fingerprint`` every digit."""
    return _fingerprints(spark, sf_dir, False)


@query("content_fingerprint")
def q_content_fingerprint(spark, sf_dir):
    """The same over the whole content: microseconds and all digits of floats."""
    return _fingerprints(spark, sf_dir, True)


def _fingerprints(spark, sf_dir, exact):
    from .sources.tables import TABLES, read_table
    from .functions.fingerprint import table_fingerprint
    parts = [table_fingerprint(read_table(spark, sf_dir, t, list(cols)), exact).withColumn("table", F.lit(t)) for t, cols in TABLES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("file_fingerprints")
def q_file_fingerprints(spark, sf_dir):
    """Length and SHA-256 of every input file."""
    from .functions.fingerprint import digests, listed
    from .sources.tables import TABLES
    parts = [listed(spark, f"{sf_dir}/{t}.parquet").withColumn("table", F.lit(t)) for t in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return digests(out).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "sha256", "table")


@query("snapshot_diff")
def q_snapshot_diff(spark, sf_dir):
    """Canonical snapshot vs. a regeneration from the export; rows only on either side."""
    from .operators.canonical import canonicalize
    from .functions.fingerprint import snapshot_diff
    regenerated = canonicalize(_export(spark, sf_dir), start_month="1996-01-01", equipment_type="Elevator")
    snapshot = canonicalize(_export(spark, sf_dir), start_month="1997-01-01", equipment_type="Elevator")
    return snapshot_diff(regenerated, snapshot)


# --- J: scoring outputs -----------------------------------------------------------------------

def _latest(spark, sf_dir):
    """Unlabeled rows of the panel's latest period; the period is that of the source, not of the rows left after filters."""
    from .operators.scoring import latest_unlabeled
    return latest_unlabeled(_scored(spark, sf_dir), SPEC, RULE.name, source=_panel(spark, sf_dir))


@once
def _scored(spark, sf_dir):
    """History>=6 panel rows with the rule score (labels may be null)."""
    from .plans.cohort import prepare_cohort
    from .plans.predictions import rule_score
    prep = prepare_cohort(_panel(spark, sf_dir), TEST_RUN)
    return prep.frame.withColumn("probability", rule_score(SPEC))


@query("prediction_table")
def q_prediction_table(spark, sf_dir):
    """Holdout rows: entity, period, probability, thresholded prediction (>=), actual."""
    from .operators.scoring import prediction_table
    from .operators.splits import holdout_window
    start, end = holdout_window(_panel(spark, sf_dir), SPEC, 3)
    df = _scored(spark, sf_dir).where(F.col(SPEC.period).between(start, end) & F.col(RULE.name).isNotNull())
    return rounded(prediction_table(df, SPEC, "probability", RULE.name, 0.4433219097353501))


@query("latest_unlabeled")
def q_latest_unlabeled(spark, sf_dir):
    """The latest period's unlabeled eligible rows and the period they predict."""
    return rounded(_latest(spark, sf_dir).select(SPEC.entity, SPEC.period, "target_period", "probability"))


@query("risk_tiers")
def q_risk_tiers(spark, sf_dir):
    from .operators.scoring import risk_tier
    df = _latest(spark, sf_dir)
    return rounded(df.select(SPEC.entity, "probability", risk_tier(F.col("probability")).alias("risk_tier")))


@query("tier_counts")
def q_tier_counts(spark, sf_dir):
    from .operators.scoring import tier_counts
    return tier_counts(_latest(spark, sf_dir), "probability")


@query("scored_batch")
def q_scored_batch(spark, sf_dir):
    """Batch rows with constant metadata and optional context columns present in the source."""
    from .operators.scoring import scored_batch
    df = _latest(spark, sf_dir)
    return rounded(scored_batch(df, SPEC, "probability", model_name="rule_unplanned_r3", threshold=0.4433219097353501,
                                context=("avail_all_day", "not_a_column")))


@query("published_batch")
def q_published_batch(spark, sf_dir):
    """The scored batch published twice to a table partitioned by period, read back: its periods are replaced, not doubled."""
    from .sources.sinks import replace_periods
    path = f"{checkpoint_dir(spark)}/panelcast-published-{uuid.uuid4().hex}"
    batch = written(q_scored_batch(spark, sf_dir), "batch")
    for _ in range(2):
        replace_periods(batch, path, SPEC.period)
    return spark.read.schema(batch.schema).parquet(path).select(*batch.columns)


@query("ranked_batch")
def q_ranked_batch(spark, sf_dir):
    """Probability descending, entity ascending, with the position in that order."""
    from .operators.scoring import ranked, risk_tier
    df = _latest(spark, sf_dir).select(SPEC.entity, "probability", risk_tier(F.col("probability")).alias("risk_tier"))
    return rounded(ranked(df, {"p": -F.col("probability"), "e": F.col(SPEC.entity)}))


@query("run_summary")
def q_run_summary(spark, sf_dir):
    """Rows, entities, periods, positives, prevalence overall and per period (grouping sets)."""
    from .operators.scoring import run_summary
    from .operators.splits import holdout_window
    start, end = holdout_window(_panel(spark, sf_dir), SPEC, 3)
    df = _scored(spark, sf_dir).where(F.col(SPEC.period).between(start, end) & F.col(RULE.name).isNotNull())
    return rounded(run_summary(df, SPEC, RULE.name))


# --- G: preparation statistics (exact SQL oracle) ----------------------------------------------

def _dev_folds(spark, sf_dir, fs=None):
    from .operators.splits import rolling_folds
    prep, _, _ = _dev(spark, sf_dir, fs)
    dev = prep.frame
    return prep, dev, rolling_folds(dev, SPEC, TEST_RUN.validation_months, TEST_RUN.fold_count, check=False)


@query("median_impute")
def q_median_impute(spark, sf_dir):
    """G1: exact midpoint medians of every feature on the last fold's training rows."""
    from .operators.prep import fit_medians
    prep, dev, folds = _dev_folds(spark, sf_dir)
    med = fit_medians(folds[-1].train, prep.features)
    return rounded(spark.createDataFrame([(k, v) for k, v in med.items()], "feature string, median double"))


@query("robust_scale")
def q_robust_scale(spark, sf_dir):
    """Center and IQR scale (0 -> 1) after median imputation, last fold's training rows."""
    from .operators.prep import fit_stats, stats_table
    prep, dev, folds = _dev_folds(spark, sf_dir)
    st = fit_stats(folds[-1].train, prep.features)
    return rounded(stats_table(spark, st).drop("median"))


@query("prep_audit")
def q_prep_audit(spark, sf_dir):
    """Per fold: fit rows, date bounds and the statistics of each feature."""
    from .operators.prep import fit_stats, stats_table
    prep, dev, folds = _dev_folds(spark, sf_dir)
    parts = []
    for f in folds:
        st = fit_stats(f.train, prep.features)
        b = f.train.agg(F.count(F.lit(1)).alias("n"), F.min(SPEC.period).alias("a"), F.max(SPEC.period).alias("z")).first()
        parts.append(stats_table(spark, st, fold=f.position, fit_rows=b["n"]).withColumns(
            {"fit_start": F.lit(b["a"]), "fit_end": F.lit(b["z"])}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out)


@query("class_weights")
def q_class_weights(spark, sf_dir):
    """Balanced weights n / (2 n_c) per fold from the fold's training rows (nested-fold running sums)."""
    from .operators.splits import fold_audit
    prep, _, _ = _dev(spark, sf_dir)
    dev = prep.frame
    last = dev.agg(F.max(SPEC.period).alias("m")).first()["m"]
    tr = fold_audit(dev, SPEC, RULE.name, last, TEST_RUN.validation_months, TEST_RUN.fold_count).where("role = 'train'")
    n, p = F.col("rows"), F.col("positives")
    return rounded(tr.select(F.col("position").alias("fold"), n, p, (n / (2.0 * (n - p))).alias("weight_negative"),
                             (n / (2.0 * p)).alias("weight_positive")))


@query("onehot")
def q_onehot(spark, sf_dir):
    """Month of year one-hot from the last fold's training categories, mode-imputed, on its validation rows:
    the slots of the sparse vector and its width."""
    from .operators.prep import fit_levels, fit_mode, one_hot
    from .operators.splits import rolling_folds
    prep, _, _ = _dev(spark, sf_dir, replace(FEATURE_SETS["full_history"], include_season=True))
    folds = rolling_folds(prep.frame, SPEC, TEST_RUN.validation_months, TEST_RUN.fold_count, check=False)
    tr, va = folds[-1].train, folds[-1].validation
    levels, width = fit_levels(tr, "month_of_year")
    coded = one_hot(va.select(*SPEC.key, "month_of_year"), "month_of_year", levels, width, fit_mode(tr, "month_of_year"), "hot")
    v = vector_to_array("hot")
    return coded.select(*SPEC.key, (F.array_position(v, F.lit(1.0)) - 1).alias("slot"), F.size(v).cast("bigint").alias("width"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x).cast("int").alias("hot"))


@query("baseline_scores")
def q_baseline_scores(spark, sf_dir):
    """Constant training prevalence, same-period rule, any unplanned event; per validation row."""
    from .plans.predictions import fold_predictions
    from .operators.labels import current_period_label
    from .operators.splits import fold_audit
    prep, _, _ = _dev(spark, sf_dir)
    dev = prep.frame
    last = dev.agg(F.max(SPEC.period).alias("m")).first()["m"]
    prev = fold_audit(dev, SPEC, RULE.name, last, TEST_RUN.validation_months, TEST_RUN.fold_count) \
        .where("role = 'train'").select(F.col("position").alias("fold"), F.col("prevalence").alias("constant_prevalence"))
    p = fold_predictions(dev, SPEC, RULE.name, F.lit(0.0), last, TEST_RUN.validation_months, TEST_RUN.fold_count,
                         extras=(SPEC.unplanned, SPEC.severe)).join(F.broadcast(prev), "fold")  # k-row table
    wide = p.select("fold", SPEC.entity, SPEC.period, "label", "constant_prevalence",
                    current_period_label(SPEC, RULE).cast("double").alias("previous_period_failure"),
                    (F.col(SPEC.unplanned) >= 1).cast("double").alias("simple_outage_rule"))
    names = ["constant_prevalence", "previous_period_failure", "simple_outage_rule"]
    return rounded(wide.select("fold", SPEC.entity, SPEC.period, "label",
                               F.inline(F.array(*[F.struct(F.lit(n).alias("baseline"), F.col(n).alias("score")) for n in names]))))


@query("sequence_scale")
def q_sequence_scale(spark, sf_dir):
    """Per-channel median and robust scale over all steps of the development sequences."""
    from .operators.prep import fit_stats
    from .operators.features import build_sequences
    from .operators.splits import holdout_window
    from .spec import feature_prefix
    start, _ = holdout_window(_panel(spark, sf_dir), SPEC, 3)
    seq = build_sequences(_labeled(spark, sf_dir), SPEC, SEQ_LEN, RULE.name).where(F.col("end_period") < start)
    steps = seq.select(F.explode("steps").alias("s")).select("s.*")
    chans = [feature_prefix(c) for c in SPEC.operational]
    stats = fit_stats(steps, chans)
    rows = [(c, stats.medians[c], stats.centers[c], stats.scales[c]) for c in chans]
    return rounded(spark.createDataFrame(rows, "channel string, median double, center double, scale double"))


@query("matched_cohort")
def q_matched_cohort(spark, sf_dir):
    """Tabular development rows restricted to the keys of 12-step sequence endpoints (left semi join)."""
    from .operators.features import build_sequences
    prep, _, _ = _dev(spark, sf_dir)
    ends = build_sequences(_labeled(spark, sf_dir), SPEC, 12, RULE.name).select(SPEC.entity, F.col("end_period").alias(SPEC.period))
    return prep.frame.join(ends, [SPEC.entity, SPEC.period], "left_semi").select(SPEC.entity, SPEC.period, RULE.name)


# --- G: learned models (rows-only check: solvers differ from any SQL oracle) --------------------

from .plans.forest import ForestParams  # noqa: E402
from .plans.modeling import ModelSpec  # noqa: E402

LOGISTIC = ModelSpec("logistic", {"C": 1.0, "maxIter": 2000})
# Forests and boosting run at full size.
BOOSTING = ModelSpec("boosting", BOOSTING_GRID[0])


def boosting_candidates() -> list[ModelSpec]:
    return [ModelSpec("boosting", g) for g in BOOSTING_GRID]


def _keys() -> dict:
    return {c: F.col(c) for c in SPEC.key}


def _logistic_runs(spark, sf_dir):
    """The logistic model fitted on every fold."""
    from .plans.logistic import Candidate, fit_logistic, sides
    prep, dev, folds = _dev_folds(spark, sf_dir)
    return fit_logistic(dev, sides(folds), _keys(), RULE.name, [Candidate.of(prep.features, LOGISTIC.params)])


@query("logreg_scores")
def q_logreg_scores(spark, sf_dir):
    return _logistic_runs(spark, sf_dir).score().drop("model")


def _forest_runs(spark, sf_dir, models: list[ForestParams]):
    """(model, fold, entity, period, label, score) of full-size forests, all trees of all folds side by side."""
    from .plans.modeling import forest_predictions
    prep, dev, folds = _dev_folds(spark, sf_dir)
    return forest_predictions(dev, folds, SPEC, prep.features, RULE.name, models)


@query("forest_scores")
def q_forest_scores(spark, sf_dir):
    """The locked forest (600 trees, depth 20, leaf 15) per fold."""
    return _forest_runs(spark, sf_dir, [ForestParams.of(LOCKED_FOREST)]).drop("model")


@query("gbt_scores")
def q_gbt_scores(spark, sf_dir):
    """Boosted trees per fold (150 rounds, depth 4), all rounds in a task per fold or level by level over large folds."""
    from .plans.boosting import BoostingParams
    from .plans.modeling import boosting_predictions
    prep, dev, folds = _dev_folds(spark, sf_dir)
    return boosting_predictions(dev, folds, SPEC, prep.features, RULE.name, [BoostingParams.of(BOOSTING.params)]).drop("model")


@query("cv_predictions")
def q_cv_predictions(spark, sf_dir):
    """Per-fold metric table of the logistic model at the pooled operating threshold."""
    from .operators.metrics import evaluate, operating_threshold
    p = written(_logistic_runs(spark, sf_dir).score().drop("model"), "predictions")
    t = float(operating_threshold(p, 0.70).first()["threshold"])  # one scalar
    return evaluate(p, t, by=["fold"]).withColumn("threshold", F.lit(t))


@query("tune_select")
def q_tune_select(spark, sf_dir):
    """Logistic grid; mean AP over all folds but the last, tie-break lower std over all folds.
    All candidates of all folds are fitted in the same passes over the rows."""
    from .plans.logistic import Candidate, fit_logistic, sides
    from .plans.modeling import tune_table
    from .plans.reports import select_candidate
    from .spec import LOGISTIC_GRID
    prep, dev, folds = _dev_folds(spark, sf_dir)
    cands = [ModelSpec("logistic", {"C": C, "penalty": pen, "maxIter": 2000}) for pen, C in LOGISTIC_GRID]
    scored = fit_logistic(dev, sides(folds), _keys(), RULE.name, [Candidate.of(prep.features, c.params) for c in cands]).score()
    return select_candidate(cut_lineage(tune_table(scored, cands)), TEST_RUN.fold_count)


def _calibration_runs(spark, sf_dir, methods=("uncalibrated", "platt", "isotonic")):
    """Per fold: base model on training rows before the 3-month tail, calibrators on the tail."""
    from .plans.logistic import Candidate, Side, fit_logistic
    from .plans.modeling import isotonic_calibrate, platt_calibrate
    prep, dev, folds = _dev_folds(spark, sf_dir)
    p = F.col(SPEC.period)
    last = dev.agg(*[F.max(F.when(f.training, p)).alias(str(i)) for i, f in enumerate(folds)]).first()
    tail = [f.training & (p >= F.add_months(F.lit(last[i]), -2)) for i, f in enumerate(folds)]
    split = [Side(f.position, f.training & ~t, t | f.validating) for f, t in zip(folds, tail)]
    scored = written(fit_logistic(dev, split, _keys(), RULE.name, [Candidate.of(prep.features, LOGISTIC.params)]).score().drop("model"), "calibration")
    validating = [(F.col("fold") == f.position) & f.validating for f in folds]
    held = F.coalesce(*[F.when(F.col("fold") == f.position, f.validating) for f in folds])
    out = []
    if "uncalibrated" in methods:
        out.append(scored.where(held).withColumn("method", F.lit("uncalibrated")))
    if "platt" in methods:
        out.append(platt_calibrate(scored, held, SPEC, [f.position for f in folds]).withColumn("method", F.lit("platt")))
    if "isotonic" in methods:
        keep = [*SPEC.key, "label", "score"]
        out += [isotonic_calibrate(scored.where((F.col("fold") == f.position) & ~held).select(*keep), scored.where(v).select(*keep)).withColumns({"fold": F.lit(f.position), "method": F.lit("isotonic")})
                for f, v in zip(folds, validating)]
    out = [part.select("fold", "method", *SPEC.key, "label", "score") for part in out]
    table = out[0]
    for part in out[1:]:
        table = table.unionByName(part)
    return table


@query("platt_scores")
def q_platt_scores(spark, sf_dir):
    return _calibration_runs(spark, sf_dir, ("platt",))


@query("isotonic_scores")
def q_isotonic_scores(spark, sf_dir):
    return _calibration_runs(spark, sf_dir, ("isotonic",))


@query("isotonic_rule")
def q_isotonic_rule(spark, sf_dir):
    """G13 on the rule score: isotonic regression on each fold's calibration tail, applied to its validation rows."""
    from .plans.modeling import isotonic_calibrate
    from .plans.predictions import rule_score
    _, dev, folds = _dev_folds(spark, sf_dir)
    keep = [*SPEC.key, F.col(RULE.name).alias("label"), rule_score(SPEC).alias("score")]
    parts = [isotonic_calibrate(f.train.where(F.col(SPEC.period) >= F.add_months(F.lit(f.validation_start), -3)).select(*keep), f.validation.select(*keep))
             .select(F.lit(f.position).alias("fold"), *SPEC.key, "label", "score") for f in folds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(out)


@query("calibration_choice")
def q_calibration_choice(spark, sf_dir):
    """AP, Brier, ECE per method and fold; methods within 0.005 AP; best Brier; needed if gain >= 0.005."""
    from .plans.reports import calibration_choice
    runs = _calibration_runs(spark, sf_dir)
    return calibration_choice(runs)


@query("seed_stability")
def q_seed_stability(spark, sf_dir):
    """The locked forest over five seeds: mean/std/min of mean AP and the largest per-row score spread."""
    from .plans.reports import seed_stability
    from .spec import FOREST_SEEDS
    runs = _forest_runs(spark, sf_dir, [ForestParams.of(LOCKED_FOREST, seed) for seed in FOREST_SEEDS])
    return seed_stability(runs.withColumnRenamed("model", "seed"), [SPEC.entity, SPEC.period])


@query("coef_stability")
def q_coef_stability(spark, sf_dir):
    """Logistic coefficients per fold: mean, pop std, direction, sign stability, counter-intuitive flag."""
    from .plans.reports import coefficient_report
    coef = _logistic_runs(spark, sf_dir).coefficients().drop("model")
    return coefficient_report(coef, negative_tokens=("avail",), positive_tokens=("events",))


@query("ablation_summary")
def q_ablation_summary(spark, sf_dir):
    """Logistic AP over folds for current / short / full feature sets, with and without age."""
    from .plans.logistic import Candidate, fit_logistic, sides
    from .operators.ladder import ranking_metrics, score_ladder
    from .operators.features import feature_names
    from .operators.splits import rolling_folds
    prep, _, _ = _dev(spark, sf_dir, FEATURE_SETS["full_history"])  # same rows for every variant, built once
    base = prep.frame.withColumn("age_missing", F.col(SPEC.age).isNull().cast("int"))
    folds = rolling_folds(base, SPEC, TEST_RUN.validation_months, TEST_RUN.fold_count, check=False)
    variants = [(name, age, feature_names(SPEC, replace(FEATURE_SETS[name], include_age=age))) for name in ("current_only", "short_history", "full_history") for age in (False, True)]
    scored = fit_logistic(base, sides(folds), _keys(), RULE.name, [Candidate.of(feats, {}) for _, _, feats in variants]).score()
    m = ranking_metrics(score_ladder(scored, by=["model", "fold"]), ["model", "fold"]).groupBy("model").agg(F.avg("pr_auc").alias("mean_pr_auc"), F.min("pr_auc").alias("worst_pr_auc"))
    names = F.array(*[F.struct(F.lit(name).alias("feature_set"), F.lit(age).alias("include_age"), F.lit(len(feats)).alias("features")) for name, age, feats in variants])
    return m.select("mean_pr_auc", "worst_pr_auc", F.inline(F.array(F.element_at(names, F.col("model") + 1))))


# --- I: diagnostics over a deterministic scorer set (exact SQL oracle) -----------------------------

def zoo() -> dict:
    """Deterministic scorers (name -> score expression over the feature panel)."""
    return {
    "rule_unplanned_r3": F.least(F.lit(1.0), F.col("unplanned_events_roll_3_mean") / 10.0),
    "rule_unplanned_r6": F.least(F.lit(1.0), F.col("unplanned_events_roll_6_mean") / 10.0),
    "rule_total_r3": F.least(F.lit(1.0), F.col("total_events_roll_3_mean") / 20.0),
    "previous_period_failure": ((F.col(SPEC.unplanned) >= 5) | (F.col(SPEC.severe) > 0)).cast("double"),
    "simple_outage_rule": (F.col(SPEC.unplanned) >= 1).cast("double"),
    }


BASELINES = ["previous_period_failure", "simple_outage_rule"]


def _zoo_preds(spark, sf_dir, prep=None):
    """Validation rows x scorers (model, fold, entity, period, label, score), materialized once."""
    from .operators.splits import assign_folds
    if prep is None:
        prep, _, _ = _dev(spark, sf_dir)
    dev = prep.frame
    last = dev.select(F.max(SPEC.period)).scalar()
    a = assign_folds(dev, SPEC, last, TEST_RUN.validation_months, TEST_RUN.fold_count).where(F.col("validation_fold").isNotNull())
    rows = [F.struct(F.lit(n).alias("model"), e.alias("score")) for n, e in zoo().items()]
    return cut_lineage(a.select(F.col("validation_fold").alias("fold"), SPEC.entity, SPEC.period, F.col(RULE.name).alias("label"),
                    F.inline(F.array(*rows))))


def _zoo_summary(spark, sf_dir):
    from .plans.reports import metric_table, model_summary
    # models x 1 summary rows, reused by several scalar decisions: materialized once
    return cut_lineage(model_summary(metric_table(_zoo_preds(spark, sf_dir), 0.5), TEST_RUN.fold_count))


@query("weak_fold")
def q_weak_fold(spark, sf_dir):
    """Fold with the lowest mean AP over the rule models."""
    from .plans.reports import metric_table
    t = metric_table(_zoo_preds(spark, sf_dir).where(~F.col("model").isin(*BASELINES)), 0.5)
    per = t.groupBy("fold").agg(F.avg("pr_auc").alias("mean_pr_auc"))
    return rounded(per.agg(F.min_by("fold", "mean_pr_auc").alias("weak_fold"), F.min("mean_pr_auc").alias("mean_pr_auc")))


def _weak(z):
    """Weak fold (scalar) from zoo predictions already built in the calling query."""
    from .plans.reports import metric_table
    t = metric_table(z.where(~F.col("model").isin(*BASELINES)), 0.5)
    return t.groupBy("fold").agg(F.avg("pr_auc").alias("m")).select(F.min_by("fold", "m")).scalar()


@query("cohort_profile")
def q_cohort_profile(spark, sf_dir):
    """I4: weak fold validation vs. other folds: rows, entities, prevalence, rows at the entity's first
    development period, null share of every feature."""
    from .operators.splits import assign_folds
    prep, _, _ = _dev(spark, sf_dir)
    dev = prep.frame
    last = dev.select(F.max(SPEC.period)).scalar()
    first = dev.groupBy(SPEC.entity).agg(F.min(SPEC.period).alias("_first"))  # one row per entity
    a = assign_folds(dev, SPEC, last, TEST_RUN.validation_months, TEST_RUN.fold_count).where(F.col("validation_fold").isNotNull())
    weak = _weak(_zoo_preds(spark, sf_dir, prep))
    a = a.join(first, SPEC.entity).withColumn("cohort", F.when(F.col("validation_fold") == weak, "weak_fold").otherwise("other_folds"))
    return rounded(a.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(SPEC.entity).alias("entities"),
        F.avg(F.col(RULE.name).cast("double")).alias("prevalence"),
        F.count_if(F.col(SPEC.period) == F.col("_first")).alias("new_entity_rows"),
        *[F.avg(F.col(c).isNull().cast("double")).alias(f"null_share_{c}") for c in prep.features]))


@query("feature_drift")
def q_feature_drift(spark, sf_dir):
    """Top 15 features by |standardized mean difference| between the weak fold and the others."""
    from .operators.splits import assign_folds
    from .plans.reports import standardized_drift
    prep, _, _ = _dev(spark, sf_dir)
    dev = prep.frame
    last = dev.select(F.max(SPEC.period)).scalar()
    a = assign_folds(dev, SPEC, last, TEST_RUN.validation_months, TEST_RUN.fold_count).where(F.col("validation_fold").isNotNull())
    weak = _weak(_zoo_preds(spark, sf_dir, prep))
    return rounded(standardized_drift(a.where(F.col("validation_fold") == weak), a.where(F.col("validation_fold") != weak), prep.features))


def _weak_errors(spark, sf_dir):
    """Weak-fold rows of the primary rule score with errors at its recall-0.70 threshold from the selection folds."""
    from .operators.metrics import operating_threshold
    zall = _zoo_preds(spark, sf_dir)
    z = zall.where(F.col("model") == "rule_unplanned_r3")
    t = operating_threshold(z.where(F.col("fold") < TEST_RUN.fold_count), 0.70).select("threshold").scalar()
    w = z.where(F.col("fold") == _weak(zall))
    return w.withColumn("error", ((F.col("score") >= t).cast("int") != F.col("label")).cast("int"))


@query("error_top_entities")
def q_error_top_entities(spark, sf_dir):
    """Ten entities with most errors in the weak fold (entity ascending on ties) - a top-k report."""
    e = _weak_errors(spark, sf_dir)
    total = e.select(F.sum("error")).scalar()
    top = e.groupBy(SPEC.entity).agg(F.sum("error").cast("bigint").alias("errors")).orderBy(F.col("errors").desc(), SPEC.entity).limit(10)
    return rounded(top.withColumn("top_10_share", F.sum("errors").over(Window.partitionBy()) / F.greatest(total, F.lit(1))))


@query("error_by_period")
def q_error_by_period(spark, sf_dir):
    e = _weak_errors(spark, sf_dir)
    return e.groupBy(SPEC.period).agg(F.sum("error").cast("bigint").alias("errors"), F.count(F.lit(1)).alias("rows"))


@query("high_correlation")
def q_high_correlation(spark, sf_dir):
    """|r| >= 0.95 pairs on the last fold's training rows (pairwise complete)."""
    from .plans.reports import high_correlation
    prep, dev, folds = _dev_folds(spark, sf_dir)
    return rounded(high_correlation(folds[-1].train, prep.features))


@query("correlation_pairs")
def q_correlation_pairs(spark, sf_dir):
    """I2 at |r| >= 0.3, where the test panels do have pairs."""
    from .plans.reports import high_correlation
    prep, dev, folds = _dev_folds(spark, sf_dir)
    return rounded(high_correlation(folds[-1].train, prep.features, 0.3))


@query("candidate_ranking")
def q_candidate_ranking(spark, sf_dir):
    from .plans.reports import candidate_ranking
    return rounded(candidate_ranking(_zoo_summary(spark, sf_dir)))


@query("ranking_orders")
def q_ranking_orders(spark, sf_dir):
    """The candidates' ranks under each of the three orderings."""
    from .plans.reports import ranking_orders
    return ranking_orders(_zoo_summary(spark, sf_dir))


@query("model_comparison")
def q_model_comparison(spark, sf_dir):
    return rounded(_zoo_summary(spark, sf_dir))


@query("replace_rule")
def q_replace_rule(spark, sf_dir):
    from .plans.reports import replace_rule
    return rounded(replace_rule(_zoo_summary(spark, sf_dir), "rule_unplanned_r3", "rule_unplanned_r6"))


@query("readiness_gate")
def q_readiness_gate(spark, sf_dir):
    from .plans.reports import readiness_gate
    return rounded(readiness_gate(_zoo_summary(spark, sf_dir), BASELINES))


@query("stage_comparison")
def q_stage_comparison(spark, sf_dir):
    """Development (its last three periods), the earlier holdout and the labeled prospective rows behind it,
    for the primary rule score at 0.5."""
    from .functions.periods import add_periods
    from .plans.diagnostics import stage_metrics
    start, end = _earlier_holdout(spark, sf_dir)
    p = F.col(SPEC.period)
    stage = F.when(p > end, "prospective").when(p >= start, "holdout").when(p >= add_periods(start, -3, SPEC.grain), "development")
    rows = _scored(spark, sf_dir).where(F.col(RULE.name).isNotNull()).select(stage.alias("stage"), *SPEC.key, F.col(RULE.name).alias("label"), F.col("probability").alias("score"))
    return rounded(stage_metrics(rows.where("stage IS NOT NULL"), SPEC))


@query("age_pressure_test")
def q_age_pressure_test(spark, sf_dir):
    """Logistic with and without age, age alone, age and the current period, by observed and imputed age."""
    from .operators.features import feature_names
    from .plans.diagnostics import age_pressure, sliced_predictions
    prep, _, _ = _dev(spark, sf_dir)
    from .operators.splits import rolling_folds
    frame = prep.frame.withColumn("age_missing", F.col(SPEC.age).isNull().cast("int"))
    folds = rolling_folds(frame, SPEC, TEST_RUN.validation_months, TEST_RUN.fold_count, check=False)
    plain = feature_names(SPEC, replace(FEATURE_SETS["full_history"], include_age=False))
    aged = feature_names(SPEC, replace(FEATURE_SETS["full_history"], include_age=True))
    age = [c for c in aged if c not in plain]
    current = feature_names(SPEC, replace(FEATURE_SETS["current_only"], include_age=False))
    variants = {"full_history_with_age": aged, "full_history_without_age": plain, "age_only": age, "age_plus_current_month": [*age, *[c for c in current if c in plain]]}
    preds = sliced_predictions(folds, SPEC, aged, RULE.name, variants, LOGISTIC, {"age_group": F.when(F.col(SPEC.age).isNull(), "imputed_age").otherwise("observed_age")})
    return age_pressure(preds, "full_history_with_age", "full_history_without_age", TEST_RUN.fold_count)


@query("holdout_evaluation")
def q_holdout_evaluation(spark, sf_dir):
    """Final evaluation (J1 + H1-H6): the locked forest fitted on all development rows, scored on the holdout."""
    from .plans.forest import fit_forests
    from .plans.modeling import final_metrics
    prep, start, end = _dev(spark, sf_dir)
    labeled, _, _ = _labeled_feat(spark, sf_dir)
    holdout = cut_lineage(labeled.frame.where(F.col(SPEC.period).between(start, end)))
    fitted = fit_forests(prep.frame, [(0, F.lit(True))], prep.features, list(SPEC.key), RULE.name, [ForestParams.of(LOCKED_FOREST)])
    return final_metrics(fitted.score(holdout, 0, list(SPEC.key), RULE.name), SPEC, RISK_TIER_HIGH)


@query("fold_overlap")
def q_fold_overlap(spark, sf_dir):
    """F4 guards: date overlap, row overlap and holdout contamination per fold."""
    from .operators.splits import fold_overlap
    prep, start, end = _dev(spark, sf_dir)
    dev = prep.frame
    last = dev.agg(F.max(SPEC.period).alias("m")).first()["m"]
    return fold_overlap(dev, SPEC, last, TEST_RUN.validation_months, TEST_RUN.fold_count, start, end)


@query("forest_tune")
def q_forest_tune(spark, sf_dir):
    """The whole forest grid of eight; selection = mean AP over folds 1..3, tie-break lower std."""
    from .plans.modeling import tune_table
    from .plans.reports import select_candidate
    from .spec import FOREST_GRID
    runs = _forest_runs(spark, sf_dir, [ForestParams.of(g) for g in FOREST_GRID])
    return select_candidate(written(tune_table(runs, [ModelSpec("forest", g) for g in FOREST_GRID]), "tuning"), TEST_RUN.fold_count)


@query("gbt_tune")
def q_gbt_tune(spark, sf_dir):
    """The whole boosting grid of twelve."""
    from .plans.boosting import BoostingParams
    from .plans.modeling import boosting_predictions, tune_table
    from .plans.reports import select_candidate
    prep, dev, folds = _dev_folds(spark, sf_dir)
    cands = boosting_candidates()
    runs = boosting_predictions(dev, folds, SPEC, prep.features, RULE.name, [BoostingParams.of(c.params) for c in cands])
    return select_candidate(written(tune_table(runs, cands), "tuning"), TEST_RUN.fold_count)
