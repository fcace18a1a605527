"""Score ladder: cumulative positives / rows at or above every distinct score,
per group, without a single-partition global window.

1. ``groupBy(by, score)`` combines map side: one row per distinct score. This tally is written and
   serves all metrics: average precision, ROC-AUC, Brier, calibration, confusion and policies.
2. Equi-depth buckets over the distinct scores (approximate quantiles; a cut point
   per ROWS_PER_BUCKET distinct scores reaches the driver) keep every bucket about the same
   size even when scores pile up in a narrow range or one group is hot.
3. Per-(group, bucket) totals are tiny; their running offsets come from a
   window over at most ``buckets`` rows per group.
4. A window partitioned by (group, bucket) adds the in-bucket prefix.
The offsets table (groups x buckets rows) is joined by key; AQE broadcasts it
from its measured runtime size.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage, written

BUCKET = "_bucket"
ROWS_PER_BUCKET = 50_000


def _cuts(g: DataFrame, score: str, buckets: int) -> list[float]:
    if buckets <= 1:
        return []
    probs = [i / buckets for i in range(1, buckets)]
    qs = g.approxQuantile(score, probs, 1.0 / (4 * buckets))
    return sorted({q for q in qs if q is not None})


def score_tally(preds: DataFrame, label: str = "label", score: str = "score", by: list[str] | tuple = ()) -> DataFrame:
    """The sufficient statistics of every metric here: (by..., score, pos, n), written once.

    Predictions are evaluated for this table alone, whatever is asked of it later; rows without a label
    or a score are left out.
    """
    known = preds.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return written(known.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")), "tally")


def rolled_up(tally: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """The tally of coarser groups."""
    return tally.groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))


def score_ladder(preds: DataFrame, label: str = "label", score: str = "score", by: list[str] | tuple = (), buckets: int | None = None) -> DataFrame:
    """The ladder of a prediction table, see ``ladder_of``."""
    return ladder_of(score_tally(preds, label, score, by), by, buckets)


def ladder_of(tally: DataFrame, by: list[str] | tuple = (), buckets: int | None = None) -> DataFrame:
    """Rows: by..., score, pos, n, cum_pos (score >= s), cum_n, total_pos, total_n.
    Without ``buckets`` their number follows from ROWS_PER_BUCKET and the distinct scores."""
    by, g, score = list(by), tally, "score"
    cuts = _cuts(g, score, buckets or max(1, math.ceil(g.count() / ROWS_PER_BUCKET)))
    if cuts:
        splits = [float("-inf"), *cuts, float("inf")]
        gb = Bucketizer(splits=splits, inputCol=score, outputCol=BUCKET, handleInvalid="keep").transform(g)
    else:
        gb = g.withColumn(BUCKET, F.lit(0.0))
    tot = gb.groupBy(*by, BUCKET).agg(F.sum("pos").alias("_bpos"), F.sum("n").alias("_bn"))
    above = Window.partitionBy(*by).orderBy(F.col(BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    off = tot.select(
        *by, BUCKET,
        F.coalesce(F.sum("_bpos").over(above), F.lit(0)).alias("_off_pos"),
        F.coalesce(F.sum("_bn").over(above), F.lit(0)).alias("_off_n"),
        F.sum("_bpos").over(whole).alias("total_pos"),
        F.sum("_bn").over(whole).alias("total_n"),
    )
    inner = Window.partitionBy(*by, BUCKET).orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return gb.join(off, [*by, BUCKET]).select(
        *by, score, "pos", "n",
        (F.col("_off_pos") + F.sum("pos").over(inner)).alias("cum_pos"),
        (F.col("_off_n") + F.sum("n").over(inner)).alias("cum_n"),
        "total_pos", "total_n",
    )


def ranking_columns() -> dict[str, Column]:
    """Step-wise average precision and ROC-AUC with half credit for ties, as aggregates over a ladder.

    AP = sum_s pos_s * precision_s / P; AUC = sum_s neg_s * (above_s + pos_s / 2) / (P * N).
    AUC is null for a one-class group; AP is null without positives.
    """
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    above = F.col("cum_pos") - pos
    P = F.first("total_pos")
    N = F.first("total_n") - F.first("total_pos")
    return {"pr_auc": F.when(P > 0, F.sum(pos * (F.col("cum_pos") / F.col("cum_n"))) / P),
            "roc_auc": F.when((P > 0) & (N > 0), F.sum(neg * (above + pos / 2.0)) / (P * N))}


def ranking_metrics(ladder: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """(by..., pr_auc, roc_auc, positives, rows)."""
    return ladder.groupBy(*by).agg(*[c.alias(name) for name, c in ranking_columns().items()], F.first("total_pos").alias("positives"), F.first("total_n").alias("rows"))


def threshold_candidates(ladder: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """Candidates {0, 1} U distinct scores with tp, fp, fn, tn, precision, recall, f1."""
    by = list(by)
    base = ladder.select(*by, F.col("score").alias("threshold"), F.col("cum_pos").alias("tp"), F.col("cum_n").alias("pp"),
                         "total_pos", "total_n")
    s, edges = F.col("score"), (0.0, 1.0)
    aggs = [agg for i, t in enumerate(edges) for agg in (
        F.coalesce(F.sum(F.when(s >= t, F.col("pos"))), F.lit(0)).alias(f"tp{i}"), F.coalesce(F.sum(F.when(s >= t, F.col("n"))), F.lit(0)).alias(f"pp{i}"),
        F.max(s == t).alias(f"there{i}"))]
    at = [F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"pp{i}").alias("pp"), F.col(f"there{i}").alias("there")) for i, t in enumerate(edges)]
    ends = ladder.groupBy(*by).agg(*aggs, F.sum("pos").alias("total_pos"), F.sum("n").alias("total_n"), F.count(F.lit(1)).alias("_rows")).where("_rows > 0")
    ends = ends.select(*by, "total_pos", "total_n", F.inline(F.array(*at))).where("NOT there").drop("there")  # an edge that is a score is in the ladder
    cand = base.unionByName(ends)
    tp, pp = F.col("tp"), F.col("pp")
    prec = F.when(pp > 0, tp / pp).otherwise(0.0)
    rec = F.when(F.col("total_pos") > 0, tp / F.col("total_pos")).otherwise(0.0)
    out = cand.select(
        *by, "threshold", "tp", (pp - tp).alias("fp"), (F.col("total_pos") - tp).alias("fn"),
        (F.col("total_n") - F.col("total_pos") - (pp - tp)).alias("tn"), prec.alias("precision"), rec.alias("recall"),
    )
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12))
    return out.withColumn("f1", f1)


def select_threshold(cands: DataFrame, minimum_recall: float, by: list[str] | tuple = ()) -> DataFrame:
    """Among candidates with recall >= r: max (precision, recall, threshold); otherwise
    max (f1, recall) with the lowest threshold on ties. One distributed aggregate."""
    t = F.col("threshold")
    meets = F.col("recall") >= minimum_recall
    return cands.groupBy(*by).agg(
        F.coalesce(
            F.max_by(t, F.when(meets, F.struct("precision", "recall", "threshold"))),
            F.max_by(t, F.struct("f1", "recall", (-t).alias("neg_t"))),
        ).alias("threshold")
    )


def policy_thresholds(cands: DataFrame, by: list[str] | tuple = ()) -> DataFrame:
    """H8: four operating policies as (by..., policy, threshold)."""
    t = F.col("threshold")

    def recall_goal(r):
        return F.coalesce(
            F.max_by(t, F.when(F.col("recall") >= r, F.struct("precision", "recall", "threshold"))),
            F.max_by(t, F.struct("f1", "recall", (-t).alias("neg_t"))),
        )

    cost = 3 * F.col("fn") + F.col("fp")
    wide = cands.groupBy(*by).agg(
        recall_goal(0.70).alias("approximately_70_percent_recall"),
        recall_goal(0.80).alias("approximately_80_percent_recall"),
        F.max_by(t, F.struct("f1", "recall", (-t).alias("neg_t"))).alias("best_validation_f1"),
        F.min_by(t, F.struct(cost.alias("cost"), (-F.col("recall")).alias("neg_r"), t.alias("t"))).alias("fn_cost_3x_fp"),
    )
    names = ["approximately_70_percent_recall", "approximately_80_percent_recall", "best_validation_f1", "fn_cost_3x_fp"]
    rows = [F.struct(F.lit(n).alias("policy"), F.col(n).alias("threshold")) for n in names]
    return wide.select(*by, F.inline(F.array(*rows)))


def distributed_rank(df: DataFrame, col: str, buckets: int | None = None, name: str = "rank") -> DataFrame:
    """1-based rank by ascending ``col`` (unique values) without a single-partition window: rows are range
    partitioned on the value itself (``buckets`` ranges, by default the session's shuffle partitions) and
    written once, so ranges stand; offsets are running counts over the ranges."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(n, col).withColumn(BUCKET, F.spark_partition_id()))
    sizes = ranged.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("_bn"))
    before = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = sizes.select(BUCKET, F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(BUCKET).orderBy(col)
    return ranged.join(offsets, BUCKET).withColumn(name, F.col("_off") + F.row_number().over(inner)).drop(BUCKET, "_off")
