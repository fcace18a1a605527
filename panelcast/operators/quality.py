"""Validation and quality audits.

All rule counts come from one aggregation job (partial aggregates combine map
side); the validator raises on the first failed rule in the contract order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..spec import FeatureSet, PanelSpec
from .history import IDX, add_consecutive_history, entity_window, excluded_suffix, with_index


class DataValidationError(ValueError):
    pass


def rule_violations(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """B10-B12 in one pass: negatives per count column (nulls ignored), ratios
    outside [0, 1] (nulls ignored), additive identity mismatches (null counts as mismatch)."""
    aggs = [F.count_if(F.col(c) < 0).alias(f"negative_{c}") for c in spec.counts]
    aggs += [F.count_if((F.col(c) < 0) | (F.col(c) > 1)).alias(f"out_of_range_{c}") for c in spec.ratios]
    mismatch = F.coalesce(F.col(spec.total) != F.col(spec.planned) + F.col(spec.unplanned), F.lit(True))
    aggs.append(F.count_if(mismatch).alias("identity_mismatch"))
    return df.agg(*aggs)


def duplicate_keys(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows after the first per (entity, period)."""
    return df.groupBy(*spec.key).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"),
        F.count_if(F.col("_n") > 1).alias("duplicated_keys"),
    )


def gap_count(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Observed transitions and those whose step is not exactly one period."""
    w = entity_window(spec)
    nxt = F.lead(IDX).over(w)
    staged = with_index(df, spec).select((nxt - F.col(IDX)).alias("_step"))
    return staged.agg(
        F.count("_step").alias("transitions"),
        F.count_if(F.col("_step") != 1).alias("nonconsecutive_transitions"),
    )


def history_summary(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows per entity: min, exact median (midpoint), max."""
    per = df.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("_n"))
    return per.agg(
        F.min("_n").alias("history_min"),
        F.median("_n").alias("history_median"),
        F.max("_n").alias("history_max"),
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Null count for every column in one aggregate."""
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls_{c}") for c in df.columns])


def panel_profile(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows, distinct entities, first and last period."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(spec.entity).alias("entities"),
        F.min(spec.period).alias("first_period"),
        F.max(spec.period).alias("last_period"),
    )


def validate(df: DataFrame, spec: PanelSpec) -> dict:
    """Raise on the first failed rule (contract order); else return the report."""
    age = () if spec.age is None else (spec.age,)
    missing = sorted({spec.entity, spec.period, *spec.counts, *spec.ratios, *age} - set(df.columns))
    if missing:
        raise DataValidationError(f"the panel lacks required columns {missing}")
    report = (
        rule_violations(df, spec).first().asDict()
        | duplicate_keys(df, spec).first().asDict()
        | df.agg(F.count_if(F.col(spec.period).isNull()).alias("bad_periods")).first().asDict()
    )
    if report["bad_periods"]:
        raise DataValidationError("some periods are null")
    if report["duplicate_rows"]:
        raise DataValidationError(f"{report['duplicate_rows']} duplicate rows for a key of entity and period")
    for c in spec.counts:
        if report[f"negative_{c}"]:
            raise DataValidationError(f"{c} has negative counts")
    for c in spec.ratios:
        if report[f"out_of_range_{c}"]:
            raise DataValidationError(f"{c} leaves the range 0 to 1")
    if report["identity_mismatch"]:
        raise DataValidationError(f"{report['identity_mismatch']} rows with inconsistent totals")
    report |= gap_count(df, spec).first().asDict() | panel_profile(df, spec).first().asDict()
    report |= history_summary(df, spec).first().asDict()
    report["missing_values"] = null_profile(df).first().asDict()
    return report


def eligibility_audit(df: DataFrame, spec: PanelSpec, suffixes) -> DataFrame:
    """Excluded rows/entities, eligible rows/entities, newly introduced entities
    (first period after the global first period of the non-excluded panel)."""
    x = excluded_suffix(spec, suffixes)
    staged = df.select(spec.entity, spec.period, x.alias("_x"))
    first = staged.where(~F.col("_x")).select(F.min(spec.period)).scalar()
    per_entity = staged.groupBy(spec.entity, "_x").agg(F.count(F.lit(1)).alias("_n"), F.min(spec.period).alias("_first"))
    return per_entity.agg(
        F.sum(F.when(F.col("_x"), F.col("_n")).otherwise(0)).cast("bigint").alias("excluded_rows"),
        F.count_if(F.col("_x")).alias("excluded_entities"),
        F.sum(F.when(~F.col("_x"), F.col("_n")).otherwise(0)).cast("bigint").alias("eligible_rows"),
        F.count_if(~F.col("_x")).alias("eligible_entities"),
        F.count_if(~F.col("_x") & (F.col("_first") > first)).alias("newly_introduced_entities"),
    )


def feature_history_audit(df: DataFrame, spec: PanelSpec, suffixes, feature_sets: dict[str, FeatureSet]) -> DataFrame:
    """Per feature set, non-excluded rows and entities with history >= its minimum.
    Per-entity partial counts first (no distinct-aggregate row expansion), then one
    aggregate stacked into one row per set."""
    h = add_consecutive_history(df, spec).where(~excluded_suffix(spec, suffixes))
    hist = F.col("consecutive_history_months")
    per_entity = h.groupBy(spec.entity).agg(
        *[F.count_if(hist >= fs.minimum_history).alias(f"{name}__n") for name, fs in feature_sets.items()])
    aggs = []
    for name in feature_sets:
        aggs += [F.sum(f"{name}__n").cast("bigint").alias(f"{name}__rows"), F.count_if(F.col(f"{name}__n") > 0).alias(f"{name}__entities")]
    wide = per_entity.agg(*aggs)
    rows = [
        F.struct(F.lit(name).alias("feature_set"), F.lit(fs.minimum_history).alias("minimum_history"),
                 F.col(f"{name}__rows").alias("eligible_rows"), F.col(f"{name}__entities").alias("eligible_entities"))
        for name, fs in feature_sets.items()
    ]
    return wide.select(F.inline(F.array(*rows)))


def missing_age_audit(df: DataFrame, spec: PanelSpec, suffixes) -> DataFrame:
    """Null-age rows, affected entities, whether every null lies on the entity's first row.
    One row per period and entity, so "all nulls on the first row" is max(null idx) = min(idx):
    a per-entity partial aggregate replaces the row-number window."""
    d = with_index(df, spec).where(~excluded_suffix(spec, suffixes))
    miss = F.col(spec.age).isNull()
    per_entity = d.groupBy(spec.entity).agg(
        F.count_if(miss).alias("_m"), F.min(IDX).alias("_first"), F.max(F.when(miss, F.col(IDX))).alias("_last_miss"))
    return per_entity.agg(
        F.sum("_m").cast("bigint").alias("missing_rows"),
        F.count_if(F.col("_m") > 0).alias("affected_entities"),
        F.coalesce(F.bool_and((F.col("_m") == 0) | (F.col("_last_miss") == F.col("_first"))), F.lit(True)).alias("all_on_first_record"),
    )


def _age_steps(df: DataFrame, spec: PanelSpec, band: tuple[float, float]) -> DataFrame:
    w = entity_window(spec)
    d = with_index(df, spec)
    consecutive = F.coalesce(F.lag(IDX).over(w) == F.col(IDX) - 1, F.lit(False))
    delta = F.col(spec.age) - F.lag(spec.age).over(w)
    staged = d.select(spec.entity, spec.period, spec.age, consecutive.alias("_c"), delta.alias("delta"))
    observed = F.col("_c") & F.col("delta").isNotNull()
    reset = observed & (F.col("delta") < 0)
    anomaly = observed & ((F.col("delta") < band[0]) | (F.col("delta") > band[1])) & ~reset
    return staged.select("*", observed.alias("observed"), reset.alias("reset"), anomaly.alias("anomaly"))


def age_behavior(df: DataFrame, spec: PanelSpec, band: tuple[float, float]) -> DataFrame:
    """Consecutive transitions, median increment, resets, anomalies outside the band."""
    s = _age_steps(df, spec, band)
    return s.agg(
        F.count_if("observed").alias("observed_transitions"),
        F.median(F.when(F.col("observed"), F.col("delta"))).alias("median_increment"),
        F.count_if("reset").alias("resets"),
        F.count_if("anomaly").alias("anomalies"),
    )


def age_examples(df: DataFrame, spec: PanelSpec, band: tuple[float, float], kind: str = "reset", n: int = 20) -> DataFrame:
    """B20 examples: first ``n`` resets (or anomalies) by (entity, period) - a top-k report."""
    s = _age_steps(df, spec, band)
    return s.where(kind).select(spec.entity, spec.period, spec.age).orderBy(spec.entity, spec.period).limit(n)
