"""Leakage-safe labels and prevalence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..spec import LabelRule, PanelSpec
from .history import IDX, entity_window, with_index


def rule_hit(unplanned: Column, severe: Column, rule: LabelRule) -> Column:
    """Unplanned uses >=, severe uses > (two different operators on purpose)."""
    return (unplanned >= rule.unplanned_threshold) | (severe > rule.severe_threshold)


def add_next_period_label(df: DataFrame, spec: PanelSpec, rule: LabelRule, column: str | None = None) -> DataFrame:
    """1/0 when the entity's next row is exactly the next period and both next
    outcomes are known; null otherwise (never 0 for unknown)."""
    column = column or rule.name
    w = entity_window(spec)
    df = with_index(df, spec)
    nxt_idx = F.lead(IDX).over(w)
    nxt_u = F.lead(spec.unplanned).over(w)
    nxt_s = F.lead(spec.severe).over(w)
    known = F.coalesce(nxt_idx == F.col(IDX) + 1, F.lit(False)) & nxt_u.isNotNull() & nxt_s.isNotNull()
    return df.withColumn(column, F.when(known, rule_hit(nxt_u, nxt_s, rule).cast("int")))


def add_label_variants(df: DataFrame, spec: PanelSpec, primary: LabelRule, secondary: LabelRule) -> DataFrame:
    """Two rules over the same window (one sort)."""
    return add_next_period_label(add_next_period_label(df, spec, primary), spec, secondary)


def current_period_label(spec: PanelSpec, rule: LabelRule) -> Column:
    """D3: the same rule applied to the current period (persistence baseline)."""
    return F.when(
        F.col(spec.unplanned).isNotNull() & F.col(spec.severe).isNotNull(),
        rule_hit(F.col(spec.unplanned), F.col(spec.severe), rule).cast("int"),
    )


def prevalence(df: DataFrame, spec: PanelSpec, label: str, by: list[str] | None = None) -> DataFrame:
    """Labeled, positive, negative, mean, unlabeled, entities and date span."""
    lab = F.col(label)
    aggs = [
        F.count(lab).alias("labeled_rows"),
        F.count(F.when(lab == 1, 1)).alias("positive_rows"),
        F.count(F.when(lab == 0, 1)).alias("negative_rows"),
        F.avg(lab.cast("double")).alias("prevalence"),
        F.count(F.when(lab.isNull(), 1)).alias("unlabeled_rows"),
        F.countDistinct(F.when(lab.isNotNull(), F.col(spec.entity))).alias("labeled_entities"),
        F.min(F.when(lab.isNotNull(), F.col(spec.period))).alias("first_period"),
        F.max(F.when(lab.isNotNull(), F.col(spec.period))).alias("last_period"),
    ]
    return df.groupBy(*(by or [])).agg(*aggs)


def _next_clauses(df: DataFrame, spec: PanelSpec, rule: LabelRule) -> DataFrame:
    """Both clauses of the label on the next period (``_a`` unplanned, ``_b`` severe) where that period is known."""
    w = entity_window(spec)
    df = with_index(df, spec)
    nxt_u, nxt_s = F.lead(spec.unplanned).over(w), F.lead(spec.severe).over(w)
    known = F.coalesce(F.lead(IDX).over(w) == F.col(IDX) + 1, F.lit(False)) & nxt_u.isNotNull() & nxt_s.isNotNull()
    return df.withColumns({"_known": known, "_a": nxt_u >= rule.unplanned_threshold, "_b": nxt_s > rule.severe_threshold})


def label_decomposition(df: DataFrame, spec: PanelSpec, rule: LabelRule, before: Column | None = None) -> DataFrame:
    """Rows meeting clause A (unplanned), clause B (severe), both, and B-only extras,
    over rows (of periods ``before`` a bound) whose next period is known."""
    staged = _next_clauses(df, spec, rule).where("_known")
    if before is not None:
        staged = staged.where(F.col(spec.period) < before)
    a, b = F.col("_a"), F.col("_b")
    return staged.agg(
        F.count(F.lit(1)).alias("labeled_rows"),
        F.count(F.when(a, 1)).alias("unplanned_clause"),
        F.count(F.when(b, 1)).alias("severe_clause"),
        F.count(F.when(a & b, 1)).alias("both_clauses"),
        F.count(F.when(b & ~a, 1)).alias("severe_only_extra"),
        F.count(F.when(a | b, 1)).alias("positive_rows"),
    )


def prevalence_alternatives(flagged: DataFrame, spec: PanelSpec, rule: LabelRule, before: Column) -> DataFrame:
    """Prevalence on the periods ``before`` a bound under other definitions: the next-period label
    and the current-period label with the excluded entities, and the unplanned clause alone without
    them. ``flagged`` carries ``eligible_for_modeling``; exclusion is per entity, so one pass serves all."""
    now = current_period_label(spec, rule)
    rows = _next_clauses(flagged, spec, rule).where(F.col(spec.period) < before)
    hit, unplanned, current = (F.col("_a") | F.col("_b")).cast("int"), F.col("_a").cast("int"), F.coalesce(now, F.lit(0))
    cases = [("next_period_with_excluded", F.col("_known"), hit), ("current_period_with_excluded", F.lit(True), current),
             ("next_period_unplanned_only", F.col("_known") & F.col("eligible_for_modeling"), unplanned)]
    long = rows.select(spec.entity, F.inline(F.array(*[F.struct(F.lit(name).alias("definition"), F.when(cond, value).alias("value")) for name, cond, value in cases])))
    per_entity = long.where(F.col("value").isNotNull()).groupBy("definition", spec.entity).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("p"))
    return per_entity.groupBy("definition").agg(F.sum("n").alias("labeled_rows"), F.sum("p").alias("positive_rows"), F.count(F.lit(1)).alias("entities")).select(
        "definition", "labeled_rows", "positive_rows", (F.col("labeled_rows") - F.col("positive_rows")).alias("negative_rows"),
        (F.col("positive_rows") / F.col("labeled_rows")).alias("prevalence"), "entities")
