"""Eligibility and consecutive history.

All windows share ``partitionBy(entity).orderBy(idx)``, so Catalyst plans one
hash exchange on the entity and one sort for flags, history, labels and
features together. A panel entity holds at most one row per period, so a hot
entity is bounded by the calendar, not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.periods import period_index
from ..spec import PanelSpec

IDX = "_idx"


def entity_window(spec: PanelSpec) -> Window:
    return Window.partitionBy(spec.entity).orderBy(IDX)


def with_index(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df if IDX in df.columns else df.withColumn(IDX, period_index(spec.period, spec.grain))


def excluded_suffix(spec: PanelSpec, suffixes: tuple[str, ...] | list[str]) -> Column:
    """Entity code ends with any suffix (case sensitive); a null code is not excluded."""
    code = F.col(spec.entity).cast("string")
    hit = F.lit(False)
    for s in suffixes:
        hit = hit | code.endswith(s)
    return F.coalesce(hit, F.lit(False))


def add_eligibility_flags(df: DataFrame, spec: PanelSpec, excluded_suffixes=(), minimum_history: int | None = None) -> DataFrame:
    """``eligible_for_modeling`` and ``eligibility_reason`` (suffix > history > eligible)."""
    suffix = excluded_suffix(spec, excluded_suffixes)
    if minimum_history is not None:
        observed = F.count(spec.period).over(Window.partitionBy(spec.entity))
        short = observed < minimum_history
    else:
        short = F.lit(False)
    return (
        df.withColumn("_suffix", suffix)
        .withColumn("_short", short)
        .withColumn("eligible_for_modeling", ~(F.col("_suffix") | F.col("_short")))
        .withColumn(
            "eligibility_reason",
            F.when(F.col("_suffix"), "excluded_equipment_suffix")
            .when(F.col("_short"), "insufficient_history")
            .otherwise("eligible"),
        )
        .drop("_suffix", "_short")
    )


def add_consecutive_history(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """C4 gaps and islands: consecutive periods ending at each row.

    A run starts where the previous row is not exactly one period earlier; the
    count inside a run equals idx - run_start + 1 because run rows step by one.
    A duplicate key (step 0) also starts a run, matching the row-count rule.
    """
    w = entity_window(spec)
    df = with_index(df, spec)
    starts = F.coalesce(F.lag(IDX).over(w) != F.col(IDX) - 1, F.lit(True))
    run_start = F.max(F.when(F.col("_run_start_flag"), F.col(IDX))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        df.withColumn("_run_start_flag", starts)
        .withColumn("consecutive_history_months", (F.col(IDX) - run_start + 1).cast("int"))
        .drop("_run_start_flag")
    )


def add_feature_set_eligibility(df: DataFrame, spec: PanelSpec, minimum_history: int) -> DataFrame:
    """Eligible AND consecutive history >= minimum."""
    if "consecutive_history_months" not in df.columns:
        df = add_consecutive_history(df, spec)
    return df.withColumn(
        "eligible_for_feature_set",
        F.col("eligible_for_modeling") & (F.col("consecutive_history_months") >= minimum_history),
    )
