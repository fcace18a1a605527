"""Readers for the driver's parquet tables and derived entity-period panels.

Every builder reads only the columns it needs (``ReadSchema`` shows the pruning)
and aggregates with a partial, map-side combine before the single shuffle on
(entity, period). Rows per panel key are bounded by the calendar, so a hot
entity cannot produce an unbounded group downstream.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.periods import period_index, to_period
from ..spec import PanelSpec

#: The given tables and their columns.
TABLES = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"), "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "embeddings": ("vec_id", "embedding", "label"), "pages": ("page_id", "url", "html"), "benchmark": ("item_id", "text"),
    "labels": ("doc_id", "quality", "toxic"), "conversations": ("conv_id", "turn", "role", "text"),
}
#: Columns of floating numbers, of number lists and of times among them.
FLOATS = ("c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "value")
FLOAT_LISTS, TIMES = ("embedding",), ("o_orderdate", "l_shipdate", "ts")

DEFAULT_PANEL = PanelSpec()
DAILY_PANEL = PanelSpec(grain="day", ratios=("value_mean", "value_share"), age=None)


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def _with_age(panel: DataFrame, spec: PanelSpec, marker: str) -> DataFrame:
    """Periods since the entity's last marked period; null before the first mark.
    The period index ``_idx`` stays on the panel so later entity windows reuse this sort."""
    w = Window.partitionBy(spec.entity).orderBy("_idx").rowsBetween(Window.unboundedPreceding, 0)
    last_mark = F.max(F.when(F.col(marker), F.col("_idx"))).over(w)
    return (
        panel.withColumn("_idx", period_index(spec.period, spec.grain))
        .withColumn(spec.age, (F.col("_idx") - last_mark).cast("double"))
        .drop(marker)
    )


def panel_from_lineitem(spark: SparkSession, sf_dir: str, materialize=None) -> DataFrame:
    """Dense monthly panel: supplier x ship month.

    total = lines; planned = return flag 'N'; unplanned = other flags;
    severe = flag 'R' with quantity >= 49; availability = mean(1 - discount)
    over line-number subsets (null when the subset is empty); age = months
    since the last month holding a full-quantity (50) line.
    """
    spec = DEFAULT_PANEL
    li = read_table(
        spark, sf_dir, "lineitem",
        ["l_suppkey", "l_shipdate", "l_returnflag", "l_quantity", "l_discount", "l_linenumber"],
    ).where(F.col("l_suppkey").isNotNull() & F.col("l_shipdate").isNotNull())
    avail = 1.0 - F.col("l_discount")
    panel = li.groupBy(
        F.col("l_suppkey").alias(spec.entity), to_period("l_shipdate").alias(spec.period)
    ).agg(
        F.count(F.lit(1)).alias(spec.total),
        F.count(F.when(F.col("l_returnflag") == "N", 1)).alias(spec.planned),
        F.count(F.when(F.col("l_returnflag") != "N", 1)).alias(spec.unplanned),
        F.count(F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 49), 1)).alias(spec.severe),
        F.avg(F.when(F.col("l_linenumber") == 1, avail)).alias(spec.ratios[0]),
        F.avg(F.when(F.col("l_linenumber") >= 5, avail)).alias(spec.ratios[1]),
        F.avg(avail).alias(spec.ratios[2]),
        F.max(F.col("l_quantity") >= 50).alias("_mark"),
    )
    # ``materialize`` (e.g. a reliable checkpoint) cuts the lineage after the aggregate and
    # before the age window, so the age window and all later entity windows share one exchange.
    if materialize is not None:
        panel = materialize(panel)
    return _with_age(panel, spec, "_mark")


def panel_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse monthly panel with many gaps: customer x order month."""
    spec = DEFAULT_PANEL
    o = read_table(spark, sf_dir, "orders", ["o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "o_totalprice"]) \
        .where(F.col("o_custkey").isNotNull() & F.col("o_orderdate").isNotNull())
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    panel = o.groupBy(
        F.col("o_custkey").alias(spec.entity), to_period("o_orderdate").alias(spec.period)
    ).agg(
        F.count(F.lit(1)).alias(spec.total),
        F.count(F.when(~urgent, 1)).alias(spec.planned),
        F.count(F.when(urgent, 1)).alias(spec.unplanned),
        F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias(spec.severe),
        F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias(spec.ratios[0]),
        F.avg(F.when(F.col("o_orderstatus") == "O", 1.0).otherwise(0.0)).alias(spec.ratios[1]),
        F.avg(F.when(F.col("o_orderstatus") != "P", 1.0).otherwise(0.0)).alias(spec.ratios[2]),
        F.max(F.col("o_totalprice") >= 300000).alias("_mark"),
    )
    return _with_age(panel, spec, "_mark")


def panel_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily panel: user x event day (proves the period grain is a parameter)."""
    spec = DAILY_PANEL
    e = read_table(spark, sf_dir, "events", ["user_id", "ts", "event_type", "value"]) \
        .where(F.col("user_id").isNotNull() & F.col("ts").isNotNull())
    return e.groupBy(
        F.col("user_id").alias(spec.entity), to_period("ts", "day").alias(spec.period)
    ).agg(
        F.count(F.lit(1)).alias(spec.total),
        F.count(F.when(F.col("event_type") != "error", 1)).alias(spec.planned),
        F.count(F.when(F.col("event_type") == "error", 1)).alias(spec.unplanned),
        F.count(F.when((F.col("event_type") == "error") & (F.col("value") >= 90), 1)).alias(spec.severe),
        F.avg(F.col("value") / 100.0).alias(spec.ratios[0]),
        F.avg(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)).alias(spec.ratios[1]),
    )


def export_from_lineitem(spark: SparkSession, sf_dir: str, dirty: bool = False, materialize=None) -> DataFrame:
    """A raw 22-column "official export" derived from the lineitem panel.

    Month is text (MM/dd/yyyy), counts are text, the AM ratio is a percent string
    with '%' on every third entity, the PM ratio is percent numbers without '%'
    (column max > 1 -> whole column / 100), the all-day ratio is a plain proportion.
    Every fourth entity is an escalator. ``dirty`` adds unparseable months and
    counts at deterministic keys for the strict-parse rules.
    """
    p = panel_from_lineitem(spark, sf_dir, materialize)
    e = F.col("entity_id")
    hours = F.dayofmonth(F.last_day("period")).cast("double") * 24.0
    am, pm, day = (F.col(c) for c in DEFAULT_PANEL.ratios)
    month_text = F.date_format("period", "MM/dd/yyyy")
    total_text = F.col("total_events").cast("string")
    if dirty:
        month_text = F.when((e % 97 == 0) & (F.month("period") == 1), F.lit("bad")).otherwise(month_text)
        total_text = F.when((e % 89 == 0) & (F.month("period") == 2), F.lit("n/a")).otherwise(total_text)
    am_text = F.when(
        e % 3 == 0, F.concat((am * 100.0).cast("decimal(9,4)").cast("string"), F.lit("%"))
    ).otherwise(am.cast("decimal(9,6)").cast("string"))
    return p.select(
        month_text.alias("Month"),
        F.concat(F.lit("B"), (e % 5).cast("string")).alias("Borough"),
        F.when(e % 4 == 0, "Escalator").otherwise("Elevator").alias("Equipment Type"),
        F.concat(F.lit("EQ"), F.lpad(e.cast("string"), 6, "0")).alias("Equipment Code"),
        total_text.alias("Total Outages"),
        F.col("planned_events").cast("string").alias("Scheduled Outages"),
        F.col("unplanned_events").cast("string").alias("Unscheduled Outages"),
        F.col("severe_events").cast("string").alias("Entrapments"),
        F.col("age").alias("Time Since Major Improvement"),
        am_text.alias("AM Peak Availability"),
        (am * hours).alias("AM Peak Hours Available"),
        hours.alias("AM Peak Total Hours"),
        (pm * 100.0).cast("decimal(9,4)").cast("string").alias("PM Peak Availability"),
        (pm * hours).alias("PM Peak Hours Available"),
        hours.alias("PM Peak Total Hours"),
        day.cast("decimal(9,6)").cast("string").alias("24-Hour Availability"),
        (day * hours).alias("24-Hour Hours Available"),
        hours.alias("24-Hour Total Hours"),
        F.concat(F.lit("Station "), (e % 50).cast("string")).alias("Station Name"),
        (e % 50).alias("Station MRN"),
        F.concat(F.lit("Complex "), (e % 25).cast("string")).alias("Station Complex Name"),
        (e % 25).alias("Station Complex MRN"),
    )
