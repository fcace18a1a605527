"""Training-fold preprocessing statistics.

Statistics are fitted on training rows only, in one aggregate each, and come
back as a handful of scalars per feature. They are applied as native column
expressions; ``as_sql_stage`` turns them into a persistable pipeline stage.

Quantiles are exact and distributed (``ValueCounts``): no reducer holds a feature's values.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, SQLTransformer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.periods import nan_to_null
from ..session import cut_lineage, written


@dataclass(frozen=True)
class Stats:
    medians: dict[str, float | None]
    centers: dict[str, float]
    scales: dict[str, float]


class ValueCounts:
    """Exact quantiles of many columns without one buffer per column.

    ``groupBy(feature, value)`` combines map side; the counts are range partitioned by (feature, value)
    and written once, and running counts need a row per (feature, range) plus an order inside a range.
    Only ranks and their values (a few per feature) reach the driver.
    """

    def __init__(self, df: DataFrame, cols):
        self.cols = list(cols)
        spark = df.sparkSession
        pairs = F.inline(F.array(*[F.struct(F.lit(i).alias("f"), nan_to_null(F.col(f"`{c}`").cast("double")).alias("v")) for i, c in enumerate(self.cols)]))
        counts = df.select(pairs).groupBy("f", "v").agg(F.count(F.lit(1)).alias("n"))
        ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
        counts = cut_lineage(counts.repartitionByRange(ranges, "f", "v").withColumn("p", F.spark_partition_id()))
        sums = counts.groupBy("f").agg(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))).alias("known"), F.sum(F.when(F.col("v").isNull(), F.col("n"))).alias("null")).collect()
        self.known = {i: 0 for i in range(len(self.cols))} | {r["f"]: r["known"] or 0 for r in sums}
        self.nulls = {r["f"]: r["null"] or 0 for r in sums}
        known = counts.where("v IS NOT NULL")
        before = Window.partitionBy("f").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        starts = known.groupBy("f", "p").agg(F.sum("n").alias("m")).select("f", "p", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"))
        inside = Window.partitionBy("f", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        self.running = known.join(starts, ["f", "p"]).select("f", "v", "n", (F.col("start") + F.sum("n").over(inside)).alias("upto"))

    def at(self, ranks: dict[int, set[int]]) -> dict[tuple[int, int], float]:
        """(feature, rank from 0) -> value."""
        rows = [(f, r) for f, wanted in ranks.items() for r in wanted]
        if not rows:
            return {}
        asked = self.running.sparkSession.createDataFrame(rows, "f int, r long")
        hit = self.running.join(F.broadcast(asked), "f").where((F.col("upto") - F.col("n") <= F.col("r")) & (F.col("r") < F.col("upto")))
        return {(x["f"], x["r"]): x["v"] for x in hit.select("f", "r", "v").collect()}

    def quantiles(self, probs, fill: dict[int, float | None] | None = None) -> dict[int, list[float | None]]:
        """Linear interpolation between ranks; with ``fill``, as if the nulls of a feature held that value."""
        below: dict[int, tuple[int, int]] = {}
        if fill:
            spots = self.running.sparkSession.createDataFrame([(f, v) for f, v in fill.items() if v is not None], "f int, m double")
            rows = self.running.join(F.broadcast(spots), "f").groupBy("f").agg(
                F.sum(F.when(F.col("v") < F.col("m"), F.col("n"))).alias("less"), F.sum(F.when(F.col("v") == F.col("m"), F.col("n"))).alias("same")).collect()
            below = {r["f"]: (r["less"] or 0, r["same"] or 0) for r in rows}
        size = {f: n + (self.nulls.get(f, 0) if fill else 0) for f, n in self.known.items()}

        def source(f: int, rank: int) -> int | None:
            """Rank among the known values; None: the filled value."""
            if not fill or not self.nulls.get(f, 0):
                return rank
            less, same = below.get(f, (0, 0))
            if rank < less:
                return rank
            return None if rank < less + same + self.nulls[f] else rank - self.nulls[f]

        spans = {f: [(math.floor(p * (n - 1)), math.ceil(p * (n - 1)), p * (n - 1)) for p in probs] for f, n in size.items() if n}
        found = self.at({f: {s for lo, hi, _ in span for s in (source(f, lo), source(f, hi)) if s is not None} for f, span in spans.items()})

        def value(f: int, rank: int) -> float:
            s = source(f, rank)
            return fill[f] if s is None else found[f, s]

        return {f: [value(f, lo) + (value(f, hi) - value(f, lo)) * (at - lo) for lo, hi, at in spans[f]] if f in spans else [None] * len(probs) for f in size}


def fold_counts(df: DataFrame, cols, folds: list[tuple[int, Column]]) -> DataFrame:
    """(k, f, v, n, upto, total): per fold and feature number the rows of every known value and up to it.

    One value count serves all folds: a value keeps its rows per fold, and a running count per fold gives its rank there.
    """
    pairs = F.inline(F.array(*[F.struct(F.lit(i).alias("f"), nan_to_null(F.col(f"`{c}`").cast("double")).alias("v")) for i, c in enumerate(cols)]))
    ks = range(len(folds))
    values = df.select(*[inside.cast("int").alias(f"m{k}") for k, (_, inside) in enumerate(folds)], pairs).where("v IS NOT NULL")
    counts = values.groupBy("f", "v").agg(*[F.sum(f"m{k}").alias(f"n{k}") for k in ks])
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = written(counts.repartitionByRange(ranges, "f", "v").withColumn("p", F.spark_partition_id()), "value-counts")
    before = Window.partitionBy("f").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.groupBy("f", "p").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in ks]).select(
        "f", "p", *[F.coalesce(F.sum(f"n{k}").over(before), F.lit(0)).alias(f"a{k}") for k in ks], *[F.sum(f"n{k}").over(Window.partitionBy("f")).alias(f"t{k}") for k in ks])
    inside = Window.partitionBy("f", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = counts.join(starts, ["f", "p"]).withColumns({f"u{k}": F.col(f"a{k}") + F.sum(f"n{k}").over(inside) for k in ks})
    return run.select("f", "v", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("n"), F.col(f"u{k}").alias("upto"), F.col(f"t{k}").alias("total")) for k in ks]))).where("n > 0")


def fold_bins(df: DataFrame, cols, folds: list[tuple[int, Column]], bins: int, counts: DataFrame | None = None) -> dict[tuple[int, int], tuple[list[float], float | None]]:
    """(fold, feature number) -> (least value of each quantile bin, exact midpoint median) over the fold's rows.

    Only bounds come back: folds x features x bins rows at most. ``counts``: ``fold_counts`` of the same rows, columns and folds.
    """
    run = fold_counts(df, cols, folds) if counts is None else counts
    at = lambda rank: F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("v")))
    rows = run.groupBy("k", "f", F.expr(f"(upto - n) * {bins} div total").alias("bin")).agg(
        F.min("v").alias("low"), at(F.expr("(total - 1) div 2")).alias("lo"), at(F.expr("total div 2")).alias("hi")).collect()
    out = {(fold, i): ([], None) for fold, _ in folds for i in range(len(cols))}
    for r in sorted(rows, key=lambda r: r["low"]):
        spot = folds[r["k"]][0], r["f"]
        out[spot][0].append(r["low"])
    middle: dict = {}
    for r in rows:
        spot = folds[r["k"]][0], r["f"]
        middle.setdefault(spot, [None, None])
        middle[spot] = [v if r[c] is None else r[c] for v, c in zip(middle[spot], ("lo", "hi"))]
    return {spot: (lows or [0.0], (middle[spot][0] + middle[spot][1]) / 2 if spot in middle else None) for spot, (lows, _) in out.items()}


def fit_medians(train: DataFrame, cols) -> dict[str, float | None]:
    """G1: exact midpoint medians (not ml.Imputer, which returns an element)."""
    if not cols:
        return {}
    found = ValueCounts(train, cols).quantiles([0.5])
    return {c: found[i][0] for i, c in enumerate(cols)}


def impute(cols, medians: dict) -> dict[str, Column]:
    return {c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c] if medians[c] is not None else 0.0)) for c in cols}


def _robust(counts: ValueCounts, medians: dict) -> tuple[dict, dict]:
    filled = {i: medians[c] if medians[c] is not None else 0.0 for i, c in enumerate(counts.cols)}
    centers, scales = {}, {}
    for i, (q1, q2, q3) in counts.quantiles([0.25, 0.5, 0.75], filled).items():
        iqr = 0.0 if q1 is None else q3 - q1
        centers[counts.cols[i]] = 0.0 if q2 is None else q2
        scales[counts.cols[i]] = iqr if iqr != 0 else 1.0
    return centers, scales


def fit_robust(train: DataFrame, cols, medians: dict) -> tuple[dict, dict]:
    """center = median, scale = IQR with linear interpolation; IQR 0 -> 1. Fitted after imputation."""
    return _robust(ValueCounts(train, cols), medians)


def fit_stats(train: DataFrame, cols, scale: bool = True) -> Stats:
    """G1 and G2 from one pass of value counts."""
    if not cols:
        return Stats({}, {}, {})
    counts = ValueCounts(train, cols)
    med = {c: q[0] for c, q in zip(counts.cols, (counts.quantiles([0.5])[i] for i in range(len(counts.cols))))}
    centers, scales = _robust(counts, med) if scale else ({c: 0.0 for c in cols}, {c: 1.0 for c in cols})
    return Stats(med, centers, scales)


def fold_stats(df: DataFrame, cols, folds: list[tuple[int, Column]], counts: DataFrame | None = None) -> dict[int, Stats]:
    """G1 and G2 of every fold from one value count: the same numbers as ``fit_stats`` over each fold's rows.

    The filled value is the median, so its place among the known values is known; a quartile's rank over the filled
    column is its rank among the known values, that rank less the nulls, or the filled value itself. ``counts``:
    ``fold_counts`` of the same rows, columns and folds.
    """
    cols = list(cols)
    run = (fold_counts(df, cols, folds) if counts is None else counts).withColumnRenamed("k", "k_")
    spark = df.sparkSession
    counted = df.agg(*[F.count_if(inside) for _, inside in folds]).first()
    at = lambda rank: F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("v")))
    rows = run.groupBy("k_", "f").agg(F.max("total").alias("known"), at(F.expr("(total - 1) div 2")).alias("lo"), at(F.expr("total div 2")).alias("hi")).collect()
    middle = {(r["k_"], r["f"]): (r["known"], (r["lo"] + r["hi"]) / 2) for r in rows}
    spans = {}
    for (k, f), (known, m) in middle.items():
        n = counted[k]
        spans[k, f] = [(math.floor(p * (n - 1)), math.ceil(p * (n - 1)), p * (n - 1)) for p in (0.25, 0.5, 0.75)]
    asked = [(k, f, m, [r for lo, hi, _ in spans[k, f] for r in (lo, hi)], counted[k] - known) for (k, f), (known, m) in middle.items()]
    found = {}
    if asked:
        spots = F.broadcast(spark.createDataFrame(asked, "k_ int, f int, m double, ranks array<long>, nulls long"))  # a row per fold and feature
        rank = lambda i: F.col("ranks")[i]
        rows = run.join(spots, ["k_", "f"]).groupBy("k_", "f").agg(
            F.sum(F.when(F.col("v") < F.col("m"), F.col("n")).otherwise(0)).alias("less"), F.sum(F.when(F.col("v") == F.col("m"), F.col("n")).otherwise(0)).alias("same"),
            F.first("nulls").alias("nulls"), *[at(rank(i)).alias(f"low{i}") for i in range(6)], *[at(rank(i) - F.col("nulls")).alias(f"high{i}") for i in range(6)]).collect()
        found = {(r["k_"], r["f"]): r for r in rows}
    out = {}
    for k, (fold, _) in enumerate(folds):
        medians, centers, scales = {}, {}, {}
        for f, c in enumerate(cols):
            if (k, f) not in middle:  # no known value: all filled with 0
                medians[c], centers[c], scales[c] = None, 0.0, 1.0
                continue
            r, m = found[k, f], middle[k, f][1]
            values = []
            for i, wanted in enumerate(x for lo, hi, _ in spans[k, f] for x in (lo, hi)):
                inside = r["less"] <= wanted < r["less"] + r["same"] + r["nulls"]
                values.append(m if inside and r["nulls"] else r[f"low{i}"] if wanted < r["less"] or not r["nulls"] else r[f"high{i}"])
            q1, q2, q3 = (values[2 * i] + (values[2 * i + 1] - values[2 * i]) * (spot - lo) for i, (lo, _, spot) in enumerate(spans[k, f]))
            medians[c], centers[c], scales[c] = m, q2, (q3 - q1) or 1.0
        out[fold] = Stats(medians, centers, scales)
    return out


def apply_stats(df: DataFrame, stats: Stats) -> DataFrame:
    imp = impute(list(stats.medians), stats.medians)
    return df.withColumns({c: (imp[c] - F.lit(stats.centers[c])) / F.lit(stats.scales[c]) for c in stats.medians})


def as_sql_stage(stats: Stats) -> SQLTransformer:
    """The fitted statistics as a pipeline stage (persists with PipelineModel.save)."""
    def lit(v):
        return repr(float(v)) if v is not None else "0.0"
    exprs = [
        f"(coalesce(CAST(`{c}` AS DOUBLE), {lit(stats.medians[c])}) - {lit(stats.centers[c])}) / {lit(stats.scales[c])} AS `{c}__prep`"
        for c in stats.medians
    ]
    return SQLTransformer(statement="SELECT *, " + ", ".join(exprs) + " FROM __THIS__")


def stats_table(spark, stats: Stats, **keys) -> DataFrame:
    """The statistics as rows (feature, median, center, scale) plus constant keys."""
    rows = [(c, stats.medians[c], float(stats.centers[c]), float(stats.scales[c])) for c in stats.medians]
    df = spark.createDataFrame(rows, "feature string, median double, center double, scale double")
    return df.withColumns({k: F.lit(v) for k, v in keys.items()})


def class_weight_values(train: DataFrame, label: str) -> tuple[float, float]:
    """Balanced weights n / (2 n_c) for classes 0 and 1."""
    r = train.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("p")).first()
    n, p = r["n"], r["p"]
    neg = n - p
    return (n / (2.0 * neg) if neg else 0.0, n / (2.0 * p) if p else 0.0)


def class_weight(label: str, weights: tuple[float, float]) -> Column:
    return F.when(F.col(label) == 1, F.lit(weights[1])).otherwise(F.lit(weights[0]))


def fit_mode(train: DataFrame, col: str):
    """G3 imputation: most frequent value, lowest on ties."""
    return train.agg(F.mode(F.col(col), deterministic=True).alias("m")).first()["m"]


def fit_levels(train: DataFrame, col: str) -> tuple[DataFrame, int]:
    """The training categories as a table (level, slot) in ascending order and their number; nothing is collected."""
    from .ladder import distributed_rank
    levels = train.select(F.col(col).alias("level")).where("level IS NOT NULL").distinct()
    ranked = written(distributed_rank(levels, "level", name="_r").select("level", (F.col("_r") - 1).cast("double").alias("slot")), "levels")
    return ranked, ranked.count()


def one_hot(df: DataFrame, col: str, levels: DataFrame, width: int, fill, out: str) -> DataFrame:
    """A sparse indicator vector of ``width`` slots; nulls take ``fill``, an unseen category gives all zeros.
    Categories come by a left join, so their number is not bounded by a task or the driver."""
    unseen = float(width)
    coded = df.withColumn("_level", F.coalesce(F.col(col), F.lit(fill))).join(levels, F.col("_level") == F.col("level"), "left").withColumn("_slot", F.coalesce("slot", F.lit(unseen)))
    sizes = df.sparkSession.createDataFrame([(unseen,)], "_slot double")
    encoder = OneHotEncoder(inputCol="_slot", outputCol=out, dropLast=True).fit(sizes)  # the slot of unseen categories is the dropped last one
    return encoder.transform(coded).drop("_level", "level", "slot", "_slot")
