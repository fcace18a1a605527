"""Time-safe features.

Lags and trailing means are row-based over ``partitionBy(entity).orderBy(idx)``;
they are only trustworthy after the consecutive-history filter (C5). All
expressions go into one ``select`` so the plan holds a single Window operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..spec import FeatureSet, PanelSpec, feature_prefix
from .history import IDX, entity_window, with_index


def feature_expressions(spec: PanelSpec, fs: FeatureSet) -> list[tuple[str, Column]]:
    """Ordered (name, expression): current, age, per column lags then rolls, season."""
    w = entity_window(spec)
    out: list[tuple[str, Column]] = [(c, F.col(c)) for c in spec.operational]
    if fs.include_age and spec.age:
        out.append((spec.age, F.col(spec.age)))
        out.append(("age_missing", F.col(spec.age).isNull().cast("int")))
    for c in spec.operational:
        prefix = feature_prefix(c)
        for k in fs.lags:
            out.append((f"{prefix}_lag_{k}", F.lag(c, k).over(w)))
        for n in fs.windows:
            out.append((f"{prefix}_roll_{n}_mean", F.avg(F.col(c).cast("double")).over(w.rowsBetween(-(n - 1), 0))))
    if fs.include_season:
        out.append(("month_of_year", F.month(spec.period)))
        out.append(("is_winter", F.month(spec.period).isin(12, 1, 2).cast("int")))
    return out


def feature_names(spec: PanelSpec, fs: FeatureSet) -> list[str]:
    return [n for n, _ in feature_expressions(spec, fs)]


def build_features(df: DataFrame, spec: PanelSpec, fs: FeatureSet) -> tuple[DataFrame, list[str]]:
    """Add the feature set to the panel; returns the frame and ordered feature names."""
    df = with_index(df, spec)
    exprs = feature_expressions(spec, fs)
    existing = set(df.columns)
    new = [e.alias(n) for n, e in exprs if n not in existing]
    return df.select("*", *new), [n for n, _ in exprs]


def build_sequences(df: DataFrame, spec: PanelSpec, length: int, label: str, channels: tuple[str, ...] | None = None) -> DataFrame:
    """Per labeled row, the last ``length`` rows as an array of channel structs,
    kept only when those periods are exactly consecutive. Returns start, end, label.

    The window frame is bounded (``length`` rows), so memory per row is bounded
    even for an entity holding a third of the data.
    """
    channels = channels or spec.operational
    w = entity_window(spec)
    df = with_index(df, spec)
    frame = w.rowsBetween(-(length - 1), 0)
    steps = F.collect_list(F.struct(*[F.col(c).cast("double").alias(feature_prefix(c)) for c in channels])).over(frame)
    first_idx = F.first(IDX).over(frame)
    count = F.count(F.lit(1)).over(frame)
    start = F.first(spec.period).over(frame)
    return (
        df.select(
            spec.entity,
            spec.period,
            label,
            IDX,
            steps.alias("steps"),
            first_idx.alias("_first_idx"),
            count.alias("_n"),
            start.alias("start_period"),
        )
        .where((F.col("_n") == length) & (F.col(IDX) - F.col("_first_idx") == length - 1) & F.col(label).isNotNull())
        .select(spec.entity, "start_period", F.col(spec.period).alias("end_period"), label, "steps")
    )


def explode_sequences(seq: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row per (entity, end period, step) for hashing against a SQL oracle."""
    return seq.select(
        spec.entity, "start_period", "end_period", F.posexplode("steps").alias("step", "s")
    ).select(spec.entity, "start_period", "end_period", "step", "s.*")


def sequence_cohort(seq: DataFrame, spec: PanelSpec, base_entities: DataFrame) -> DataFrame:
    """E8 for one length: rows, entities, entities lost relative to a base set.
    Per-entity counts on both sides meet in one full outer join on the entity key."""
    per_seq = seq.groupBy(spec.entity).agg(F.count(F.lit(1)).alias("_rows"))
    base = base_entities.select(spec.entity).distinct().withColumn("_base", F.lit(True))
    both = per_seq.join(base, spec.entity, "full")
    return both.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).cast("bigint").alias("rows"),
        F.count("_rows").alias("entities"),
        F.count_if(F.col("_base") & F.col("_rows").isNull()).alias("entities_lost"),
    )
