"""A1: panels and exports as CSV files, with an explicit schema.

Files are read with a header that must name the schema's columns, and a malformed row or a missing
file is an error instead of a null or an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.periods import nan_to_null
from ..spec import CANONICAL_COLUMNS, EXPORT_SPEC, PanelSpec


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(header=True, mode="FAILFAST", enforceSchema=False, nullValue="").csv(path)


def read_export_csv(spark: SparkSession, path: str, columns=CANONICAL_COLUMNS) -> DataFrame:
    """A raw export: every column as text, for ``canonicalize`` to parse strictly."""
    return _read(spark, path, ", ".join(f"`{c}` string" for c in columns))


def read_panel_csv(spark: SparkSession, path: str, spec: PanelSpec = EXPORT_SPEC, period_format: str = "yyyy-MM-dd") -> DataFrame:
    """A canonical panel: key, counts as whole numbers, ratios and age as doubles; NaN means unknown."""
    doubles = (*spec.ratios, *((spec.age,) if spec.age else ()))
    schema = [f"`{spec.period}` string", f"`{spec.entity}` string", *(f"`{c}` bigint" for c in spec.counts), *(f"`{c}` double" for c in doubles)]
    df = _read(spark, path, ", ".join(schema))
    return df.withColumns({spec.period: F.to_date(F.col(f"`{spec.period}`"), period_format), **{c: nan_to_null(F.col(f"`{c}`")) for c in doubles}})
