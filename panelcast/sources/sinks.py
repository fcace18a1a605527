"""Sinks (A2, A3).

Tables are written as Parquet partitioned by period, so later fold and holdout
filters prune whole directories. Metric tables are JSON lines that later stages
read back with an explicit schema. Writes refuse an existing target unless
``overwrite`` is given (see also ``operators.canonical.write_canonical``, A4).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def write_table(df: DataFrame, path: str, *, partition_by: tuple[str, ...] = ("period",), overwrite: bool = False,
                fmt: str = "parquet") -> None:
    """A2: predictions / canonical / comparison tables; one directory per period."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    missing = [c for c in partition_by if c not in df.columns]
    if missing:
        raise ValueError(f"no column {missing} to partition by; pass partition_by=() for one directory")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def replace_periods(df: DataFrame, path: str, partition_by: str = "period") -> None:
    """A2: publish a batch: its periods replace those of the table, all others stay. Files are staged below the
    table and published when the job commits, so a failed write leaves the table as it was."""
    if partition_by not in df.columns:
        raise ValueError(f"no column {partition_by!r} to partition by")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path)


def append_periods(df: DataFrame, path: str, period: str = "period") -> DataFrame:
    """add the periods that the table does not hold yet and return the table. A batch sent again adds nothing.
    The periods at hand are read off the directory names (a row per period)."""
    spark = df.sparkSession
    try:
        held = spark.read.schema(df.schema).parquet(path).select(F.col(period).alias("_held")).distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        held = None
    new = df if held is None else df.join(held, F.col(period).eqNullSafe(F.col("_held")), "left_anti")
    new.write.mode("append").partitionBy(period).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_metrics(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """A3: metric table as JSON lines (small: models x folds x metrics rows)."""
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def read_metrics(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A3 reload: the metric table written by an earlier stage."""
    r = spark.read
    if schema:
        r = r.schema(schema)
    return r.json(path)
