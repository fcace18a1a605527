"""Canonicalization of a raw export (B1-B8): contract, projection, strict parsing,
ratio normalization, filter and export order.

Column decisions (ratio scale) need one small aggregate over the *unfiltered*
source; everything else is per-row native expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.periods import nan_to_null
from ..spec import CANONICAL_COLUMNS, EXPORT_SPEC, PanelSpec

MONTH_FORMAT = "MM/dd/yyyy"


class CanonicalError(ValueError):
    pass


def check_columns(df: DataFrame, required=CANONICAL_COLUMNS) -> None:
    """B1: missing columns listed in contract order."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise CanonicalError(f"the export lacks {missing}")


def parse_period(col: str = "Month", fmt: str = MONTH_FORMAT) -> Column:
    """Strict parse; null marks an unparseable value."""
    return F.try_to_date(F.col(f"`{col}`").cast("string"), fmt)


def coerce_count(col: str) -> Column:
    """A number, or text that is one ("3", "3.0"), to bigint; null for anything else (caller counts failures)."""
    number = F.trim(F.col(f"`{col}`").cast("string")).try_cast("double")
    return F.when((number == F.floor(number)) & (F.abs(number) < 2**53), number.try_cast("bigint"))


def _ratio_raw(df: DataFrame, col: str) -> tuple[Column, Column]:
    """Per-row value and percent flag: strings are trimmed, a trailing '%' divides that row by 100."""
    c = F.col(f"`{col}`")
    if not dict(df.dtypes)[col].startswith("string"):
        return nan_to_null(c.cast("double")), F.lit(False)
    text = F.trim(c.cast("string"))
    pct = F.coalesce(text.endswith("%"), F.lit(False))
    value = F.regexp_replace(text, "%+$", "").try_cast("double")
    value = nan_to_null(value)  # a NaN is an unknown ratio and must not win the column's maximum
    return F.when(pct, value / 100.0).otherwise(value), pct


def ratio_scales(df: DataFrame, cols) -> dict[str, float]:
    """B5 column decision: one aggregate of per-column max; max in (1, 100] scales the
    whole column by 1/100, max > 100 is an error."""
    exprs = []
    for c in cols:
        v, _ = _ratio_raw(df, c)
        exprs.append(F.max(v).alias(c))
    maxima = df.agg(*exprs).first().asDict()
    scales = {}
    for c in cols:
        m = maxima[c]
        if m is not None and m > 1.0:
            if m <= 100.0:
                scales[c] = 100.0
            else:
                raise CanonicalError(f"{c} reaches {m}, above a percentage")
        else:
            scales[c] = 1.0
    return scales


def normalize_ratios(df: DataFrame, cols, scales: dict[str, float] | None = None) -> DataFrame:
    scales = scales or ratio_scales(df, cols)
    out = {}
    for c in cols:
        v, _ = _ratio_raw(df, c)
        out[c] = v / scales[c] if scales[c] != 1.0 else v
    return df.withColumns(out)


def ratio_report(df: DataFrame, cols) -> DataFrame:
    """Per ratio column: percent-suffixed rows, unparseable rows, column max, and mixed
    encoding ('%' rows beside plain rows > 1, which the scale rule would divide twice).
    One aggregate over the source, stacked into one row per column."""
    aggs, rows = [], []
    for i, c in enumerate(cols):
        v, pct = _ratio_raw(df, c)
        raw = F.col(f"`{c}`")
        aggs += [
            F.count_if(pct).alias(f"p{i}"),
            F.count_if(raw.isNotNull() & v.isNull()).alias(f"u{i}"),
            F.max(v).alias(f"m{i}"),
            F.count_if(~pct & (v > 1)).alias(f"g{i}"),
        ]
        rows.append(F.struct(
            F.lit(c).alias("column"), F.col(f"p{i}").alias("percent_rows"), F.col(f"u{i}").alias("unparseable_rows"),
            F.col(f"m{i}").alias("max_value"), ((F.col(f"p{i}") > 0) & (F.col(f"g{i}") > 0)).alias("mixed_encoding"),
        ))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def canonicalize(
    source: DataFrame,
    *,
    start_month: str = "2021-01-01",
    equipment_type: str = "Elevator",
    spec: PanelSpec = EXPORT_SPEC,
    columns=CANONICAL_COLUMNS,
    type_column: str = "Equipment Type",
    strict: bool = True,
) -> DataFrame:
    """B1 -> B6 (the sink applies the order, B7). Keeps the original month text; counts become bigint, ratios proportions."""
    check_columns(source, columns)
    canonical = source.select(*[F.col(f"`{c}`") for c in columns])
    parsed = parse_period(spec.period)
    counts = {c: coerce_count(c) for c in spec.counts}
    if strict:
        bad = canonical.agg(
            F.count_if(parsed.isNull()).alias("months"),
            *[F.count_if(F.col(f"`{c}`").isNotNull() & counts[c].isNull()).alias(c) for c in spec.counts],
        ).first().asDict()
        if bad.pop("months"):
            raise CanonicalError(f"{spec.period}: some values are no {MONTH_FORMAT} date (Month)")
        for c, n in bad.items():
            if n:
                raise CanonicalError(f"{n} values of {c} are not numeric counts")
    canonical = normalize_ratios(canonical.withColumns(counts), spec.ratios)
    return (
        canonical.withColumn("_parsed", parsed)
        .where((F.col(f"`{type_column}`") == equipment_type) & (F.col("_parsed") >= F.lit(start_month).cast("date")))
        .drop("_parsed")
    )


def export_order(df: DataFrame, spec: PanelSpec = EXPORT_SPEC) -> DataFrame:
    """Newest month first, then entity; a range sort for the sink, not for later operators."""
    return df.orderBy(parse_period(spec.period).desc(), F.col(f"`{spec.entity}`"))


def write_canonical(df: DataFrame, path: str, *, protected: tuple[str, ...] = (), overwrite: bool = False) -> None:
    """Refuse a protected path, however it is spelled, and an existing output unless ``overwrite``."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def qualified(p: str) -> str:
        """Scheme, authority and normalized path as the path's own file system names it."""
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(p)
        return hadoop.getFileSystem(conf).makeQualified(hadoop).toString().rstrip("/")

    if qualified(path) in {qualified(p) for p in protected}:
        raise CanonicalError(f"{path} is protected and is not written")
    export_order(df).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
