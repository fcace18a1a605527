"""Batch scoring outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.periods import add_periods
from ..spec import RISK_TIER_HIGH, RISK_TIER_MEDIUM, PanelSpec

TIERS = ("high", "medium", "low")


def prediction_table(df: DataFrame, spec: PanelSpec, prob: str, label: str, threshold: float) -> DataFrame:
    """Entity, period, probability, prediction (probability >= threshold), actual."""
    return df.select(spec.entity, spec.period, F.col(prob).alias("probability"),
                     (F.col(prob) >= threshold).cast("int").alias("predicted"), F.col(label).alias("actual"))


def latest_unlabeled(df: DataFrame, spec: PanelSpec, label: str, eligible_col: str | None = None, source: DataFrame | None = None) -> DataFrame:
    """Rows at the latest period of ``source`` (the panel before any row filter) with an unknown
    label (and eligible); target = next period. The latest period is a scalar subquery. Callers that
    must not score an empty batch pass the result through ``assert_nonempty``."""
    last = (df if source is None else source).select(F.max(spec.period)).scalar()
    cond = (F.col(spec.period) == last) & F.col(label).isNull()
    if eligible_col:
        cond = cond & F.col(eligible_col)
    return df.where(cond).withColumn("target_period", add_periods(spec.period, 1, spec.grain))


def assert_nonempty(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("nothing to score: the latest period has no row with enough history and an open label")
    return df


def risk_tier(p: Column, high: float = RISK_TIER_HIGH, medium: float = RISK_TIER_MEDIUM) -> Column:
    """>= high -> high, >= medium -> medium, else low."""
    return F.when(p >= high, "high").when(p >= medium, "medium").otherwise("low")


def ranked(df: DataFrame, order: dict[str, Column]) -> DataFrame:
    """Rows in order with their ``position`` from 1, ranked in range partitions; ``order`` has ascending, together unique keys."""
    from .ladder import distributed_rank
    keyed = df.withColumn("_o", F.struct(*[c.alias(n) for n, c in order.items()]))
    return distributed_rank(keyed, "_o", name="position").drop("_o").orderBy("position")


def tier_counts(df: DataFrame, prob: str) -> DataFrame:
    """Counts per tier, missing tiers as 0 (one aggregate, stacked)."""
    t = risk_tier(F.col(prob))
    wide = df.agg(*[F.count_if(t == name).alias(name) for name in TIERS])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("risk_tier"), F.col(n).alias("rows")) for n in TIERS])))


def scored_batch(df: DataFrame, spec: PanelSpec, prob: str, *, model_name: str, threshold: float, context=()) -> DataFrame:
    """Constant metadata plus context columns that exist in the source."""
    present = [c for c in context if c in df.columns]
    return df.select(
        spec.entity, spec.period, "target_period", F.col(prob).alias("probability"), risk_tier(F.col(prob)).alias("risk_tier"),
        (F.col(prob) >= threshold).cast("int").alias("predicted"), F.lit(model_name).alias("model_name"),
        F.lit(float(threshold)).alias("threshold"), *present)


def run_summary(df: DataFrame, spec: PanelSpec, label: str) -> DataFrame:
    """Overall and per-period rows, entities, positives, prevalence in one grouping-sets pass."""
    out = df.groupingSets([[spec.period], []], spec.period).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(spec.entity).alias("entities"),
        F.sum(F.col(label)).cast("bigint").alias("positives"), F.avg(F.col(label).cast("double")).alias("prevalence"),
        F.countDistinct(spec.period).alias("periods"), F.grouping(spec.period).alias("_all"),
    )
    return out.withColumn("scope", F.when(F.col("_all") == 1, "all").otherwise("period")).drop("_all")  # a null period is a period of its own
