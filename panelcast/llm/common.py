"""Helpers shared by the corpus operators: written tables, hot-key joins and distributed ranks."""

from __future__ import annotations

import math
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import panelcast
from panelcast.session import checkpoint_dir

#: Words everywhere in this package: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A key counts as hot when it holds more than this share of the rows, so at most 1/share keys are hot.
HOT_SHARE = 1 / 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; they need not share the driver's folders."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(panelcast.__file__).resolve().parent
    path = Path(tempfile.mkdtemp()) / "panelcast.zip"  # on the driver, which serves the file to executors
    with zipfile.ZipFile(path, "w") as out:
        for part in sorted(root.rglob("*.py")):
            out.write(part, part.relative_to(root.parent))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder, visible to the driver and every executor."""
    return f"{checkpoint_dir(spark).rstrip('/')}/panelcast-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: it survives lost executors
    and, unlike a checkpoint, stays compressed and keeps column pruning."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_join(rows: DataFrame, lookup: DataFrame, keys: list[str], n_col: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``lookup`` (unique ``keys``; ``n_col`` rows have each key).

    Keys with more than HOT_SHARE of the rows are at most 1/HOT_SHARE by count, so that part of the
    lookup is broadcast with a proven bound and their rows stay where they are; all others shuffle.
    """
    bar = max(1000, int(total * HOT_SHARE))
    hot, cold = lookup.filter(F.col(n_col) > bar), lookup.filter(F.col(n_col) <= bar)
    hot_rows = rows.join(F.broadcast(hot), keys)
    cold_rows = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return hot_rows.unionByName(cold_rows)


def rank_within(df: DataFrame, key: str, order: list[Column], salt: list[Column], total: int, out: str) -> DataFrame:
    """Gapless ranks from 0 within ``key``, also when one key holds most rows.

    Rows are dealt into about sqrt(total) salted buckets per key; a bucket ranks its own rows and a
    running sum over the (key, bucket) counts gives its start. No window sees more than about
    sqrt(total) rows. Equal rows get different ranks in any order.
    """
    buckets = max(1, math.isqrt(max(total, 1)))
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*salt), F.lit(buckets)).cast("int"))
    starts = dealt.groupBy(key, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    run = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(key, "__bucket", F.coalesce(F.sum("__n").over(run), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(key, "__bucket").orderBy(*order)
    ranked = dealt.withColumn("__row", F.row_number().over(inside).cast("long") - 1)
    return (ranked.join(starts, [key, "__bucket"])
            .withColumn(out, F.col("__start") + F.col("__row")).drop("__bucket", "__start", "__row"))
