"""Operators over metric tables and diagnostics.

Metric tables are small (models x folds rows); they are still Spark frames so
that the same code runs from any stage, and selection rules are SQL orderings
or ``max_by`` / ``min_by`` aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.ladder import ranking_metrics, score_ladder
from ..operators.metrics import evaluate
from ..spec import CALIBRATION_GAIN, MATERIAL_AP_GAIN, MINIMUM_AP


def select_candidate(table: DataFrame, fold_count: int, key: str = "candidate") -> DataFrame:
    """Mean AP over folds 1..k-1, std over all folds; best = max (mean, -std)."""
    agg = table.groupBy(key, *[c for c in table.columns if c not in (key, "fold", "pr_auc", "roc_auc", "positives", "rows")]).agg(
        F.avg(F.when(F.col("fold") < fold_count, F.col("pr_auc"))).alias("selection_mean_pr_auc"),
        F.stddev_pop("pr_auc").alias("std_pr_auc"),
        F.avg("pr_auc").alias("mean_pr_auc"),
    )
    best = agg.select(F.max_by(key, F.struct(F.col("selection_mean_pr_auc"), -F.col("std_pr_auc")))).scalar()
    return agg.withColumn("selected", F.col(key) == best)


def seed_stability(runs: DataFrame, key: list[str]) -> DataFrame:
    """Per seed mean AP over folds; across seeds mean/std/min; max over rows of the score spread."""
    per = ranking_metrics(score_ladder(runs, by=["seed", "fold"]), ["seed", "fold"]).groupBy("seed").agg(F.avg("pr_auc").alias("m"))
    spread = runs.groupBy(*key, "fold").agg((F.max("score") - F.min("score")).alias("_d")).select(F.max("_d")).scalar()
    return per.agg(F.avg("m").alias("mean_pr_auc_across_seeds"), F.stddev_pop("m").alias("std_mean_pr_auc_across_seeds"),
                   F.min("m").alias("minimum_mean_pr_auc_across_seeds")).withColumn("maximum_prediction_difference", spread)


def calibration_choice(runs: DataFrame, ap_tolerance: float = 0.005, gain: float = CALIBRATION_GAIN) -> DataFrame:
    """Per method mean AP / Brier / ECE over folds, then ``choose_calibration``."""
    per = evaluate(runs, 0.5, by=["method", "fold"], calibration=True).groupBy("method").agg(
        F.avg("pr_auc").alias("pr_auc"), F.avg("brier_score").alias("brier_score"), F.avg("expected_calibration_error").alias("ece"))
    return choose_calibration(per, ap_tolerance, gain)


def choose_calibration(per: DataFrame, ap_tolerance: float = 0.005, gain: float = CALIBRATION_GAIN) -> DataFrame:
    """H15 rule on a (method, pr_auc, brier_score, ...) table: methods whose AP is within the tolerance
    of the *uncalibrated* AP are eligible, the lowest Brier among them is chosen, and calibration is
    needed when that is another method and gains at least ``gain`` Brier over uncalibrated."""
    w = Window.partitionBy()  # a row per method
    plain = F.col("method") == "uncalibrated"
    ap, brier = (F.max(F.when(plain, F.col(c))).over(w) for c in ("pr_auc", "brier_score"))
    marked = per.withColumns({"eligible": F.col("pr_auc") >= ap - ap_tolerance, "_gain": brier - F.col("brier_score")})
    chosen = F.min_by("method", F.when(F.col("eligible"), F.col("brier_score"))).over(w)
    out = marked.withColumn("chosen", F.col("method") == chosen)
    return out.withColumn("calibration_needed", F.max(F.col("chosen") & ~plain & (F.col("_gain") >= gain)).over(w)).drop("_gain")


def coefficient_report(coef: DataFrame, negative_tokens=("availability",), positive_tokens=("outage", "entrapment"), eps=1e-10) -> DataFrame:
    """Per feature mean, pop std, direction, sign stability (|v| > eps), expected sign, counter-intuitive."""
    v = F.col("value")
    nz = F.abs(v) > eps
    agg = coef.groupBy("feature").agg(
        F.avg(v).alias("mean_coefficient"), F.stddev_pop(v).alias("std_coefficient"),
        F.count_if(nz & (v > 0)).alias("_pos"), F.count_if(nz & (v < 0)).alias("_neg"))
    low = F.lower(F.col("feature"))
    neg = F.lit(False)
    for t in negative_tokens:
        neg = neg | low.contains(t)
    pos = F.lit(False)
    for t in positive_tokens:
        pos = pos | low.contains(t)
    expected = F.when(neg, "negative").when(pos, "positive")
    m = F.col("mean_coefficient")
    direction = F.when(m > 0, "positive").when(m < 0, "negative").otherwise("zero")
    return agg.select(
        "feature", "mean_coefficient", "std_coefficient", direction.alias("direction"),
        ((F.col("_pos") == 0) | (F.col("_neg") == 0)).alias("stable_direction"), expected.alias("expected_direction"),
        (expected.isNotNull() & (F.abs(m) > 1e-6) & (direction != expected)).alias("counterintuitive"),
    ).orderBy(F.abs(F.col("mean_coefficient")).desc())


def pairwise_moments(df: DataFrame, features: list[str]) -> DataFrame:
    """Pairwise-complete co-moments for every feature pair in one pass.

    Values are shifted by the column means (one small aggregate) for numerical
    stability. Each task turns its Arrow batches into masked numpy Gram matrices
    (d x d, independent of the row count) and emits one row per pair. A
    ``groupBy(i, j)`` sums the partials (combined map side). Rows are never paired.
    """
    import numpy as np
    import pandas as pd

    means = df.agg(*[F.avg(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)]).first()
    shift = np.array([means[f"m{i}"] if means[f"m{i}"] is not None else 0.0 for i in range(len(features))])
    d = len(features)
    iu, ju = np.triu_indices(d, k=1)
    cols = [F.col(f).cast("double").alias(f"c{i}") for i, f in enumerate(features)]

    def partial(batches):
        n = np.zeros((d, d)); sa = np.zeros((d, d)); saa = np.zeros((d, d)); sab = np.zeros((d, d))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - shift
            m = ~np.isnan(x)
            x0 = np.where(m, x, 0.0)
            mf = m.astype(float)
            n += mf.T @ mf
            sa += x0.T @ mf
            saa += (x0 * x0).T @ mf
            sab += x0.T @ x0
        yield pd.DataFrame({"i": iu, "j": ju, "n": n[iu, ju], "sa": sa[iu, ju], "sb": sa[ju, iu],
                            "saa": saa[iu, ju], "sbb": saa[ju, iu], "sab": sab[iu, ju]})

    schema = "i long, j long, n double, sa double, sb double, saa double, sbb double, sab double"
    parts = df.select(*cols).mapInPandas(partial, schema)
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])


def high_correlation(df: DataFrame, features: list[str], threshold: float = 0.95) -> DataFrame:
    """|r| >= threshold over pairwise-complete rows (two passes: means, co-moments)."""
    mom = pairwise_moments(df, features)
    n, sa, sb = F.col("n"), F.col("sa"), F.col("sb")
    cov = n * F.col("sab") - sa * sb
    va = n * F.col("saa") - sa * sa
    vb = n * F.col("sbb") - sb * sb
    r = F.when((n > 1) & (va > 0) & (vb > 0), cov / F.sqrt(va * vb))
    names = F.array(*[F.lit(f) for f in features])
    return mom.select(
        F.element_at(names, (F.col("i") + 1).cast("int")).alias("feature_a"),
        F.element_at(names, (F.col("j") + 1).cast("int")).alias("feature_b"),
        F.abs(r).alias("absolute_correlation"),
    ).where(F.col("absolute_correlation") >= threshold)


def metric_table(preds: DataFrame, threshold: float = 0.5, model: str = "model") -> DataFrame:
    """(model, fold, pr_auc, roc_auc, brier_score, tp, fp, fn, tn, precision, recall) for many models at once."""
    return evaluate(preds, threshold, by=[model, "fold"])


def model_summary(table: DataFrame, fold_count: int, model: str = "model") -> DataFrame:
    """Selection-fold mean, all-fold mean/std/worst, latest fold operating numbers per model."""
    sel = F.col("fold") < fold_count
    last = F.col("fold") == fold_count
    return table.groupBy(model).agg(
        F.avg(F.when(sel, F.col("pr_auc"))).alias("selection_mean_pr_auc"),
        F.avg("pr_auc").alias("all_fold_mean_pr_auc"), F.stddev_pop("pr_auc").alias("all_fold_std_pr_auc"),
        F.min("pr_auc").alias("worst_fold_pr_auc"),
        F.max(F.when(last, F.col("pr_auc"))).alias("latest_fold_pr_auc"),
        F.max(F.when(last, F.col("precision"))).alias("latest_precision"),
        F.max(F.when(last, F.col("recall"))).alias("latest_recall"),
        F.max(F.when(last, F.col("false_positives"))).alias("latest_false_positives"),
        F.max(F.when(last, F.col("false_negatives"))).alias("latest_false_negatives"),
    )


def candidate_ranking(summary: DataFrame, materiality: float = MATERIAL_AP_GAIN, model: str = "model") -> DataFrame:
    """Order by (selection mean desc, std asc, model); flag candidates within ``materiality`` of the best."""
    best = summary.select(F.max("selection_mean_pr_auc")).scalar()
    w = Window.orderBy(F.col("selection_mean_pr_auc").desc(), F.col("all_fold_std_pr_auc").asc(), F.col(model))  # models x 1 rows
    return summary.select(model, "selection_mean_pr_auc", "all_fold_std_pr_auc", F.row_number().over(w).alias("rank"),
                          (F.col("selection_mean_pr_auc") >= best - materiality).alias("within_materiality"))


def ranking_orders(summary: DataFrame, model: str = "model") -> DataFrame:
    """Ranks under all three orderings: (selection mean, -std), (all-fold mean, worst, -std), (all-fold mean, latest)."""
    std = F.col("all_fold_std_pr_auc")
    orders = {"by_selection": [F.col("selection_mean_pr_auc").desc(), std.asc()],
              "by_worst_fold": [F.col("all_fold_mean_pr_auc").desc(), F.col("worst_fold_pr_auc").desc(), std.asc()],
              "by_latest_fold": [F.col("all_fold_mean_pr_auc").desc(), F.col("latest_fold_pr_auc").desc()]}
    return summary.select(model, *[F.row_number().over(Window.orderBy(*o, F.col(model))).alias(name) for name, o in orders.items()])  # a row per model


def replace_rule(summary: DataFrame, incumbent: str, challenger: str, gain: float = MATERIAL_AP_GAIN, model: str = "model") -> DataFrame:
    """Replace when the challenger gains >= ``gain`` selection AP, or has fewer FN and no more FP on the latest fold.
    Compares exactly two summary rows (fetched once; bounded)."""
    rows = {r[model]: r for r in summary.where(F.col(model).isin(incumbent, challenger)).collect()}
    unknown = {incumbent, challenger} - rows.keys()
    if unknown:
        raise ValueError(f"not in the summary: {sorted(unknown)}")
    i, c = rows[incumbent], rows[challenger]
    d = c["selection_mean_pr_auc"] - i["selection_mean_pr_auc"]
    rep = d >= gain or (c["latest_false_negatives"] < i["latest_false_negatives"] and c["latest_false_positives"] <= i["latest_false_positives"])
    return summary.sparkSession.createDataFrame([(incumbent, challenger, float(d), bool(rep))],
                                                "incumbent string, challenger string, selection_gain double, replace boolean")


def readiness_gate(summary: DataFrame, baselines: list[str], minimum_ap: float = MINIMUM_AP, model: str = "model") -> DataFrame:
    """The weakest candidate's all-fold mean AP beats the best baseline's and reaches the minimum."""
    isb = F.col(model).isin(*baselines)
    return summary.agg(
        F.max(F.when(isb, F.col("all_fold_mean_pr_auc"))).alias("best_baseline_pr_auc"),
        F.min(F.when(~isb, F.col("all_fold_mean_pr_auc"))).alias("weakest_model_pr_auc"),
    ).withColumn("ready", (F.col("weakest_model_pr_auc") > F.col("best_baseline_pr_auc")) & (F.col("weakest_model_pr_auc") >= minimum_ap))


def standardized_drift(a: DataFrame, b: DataFrame, features: list[str], top: int = 15) -> DataFrame:
    """SMD per feature (weak vs others), pooled population std over both, 0 when std is 0; top by |SMD|."""
    tagged = a.select(*[F.col(f).cast("double").alias(f) for f in features], F.lit(True).alias("_w")).unionByName(
        b.select(*[F.col(f).cast("double").alias(f) for f in features], F.lit(False).alias("_w")))
    aggs = []
    for i, f in enumerate(features):
        aggs += [F.avg(F.when(F.col("_w"), F.col(f))).alias(f"w{i}"), F.avg(F.when(~F.col("_w"), F.col(f))).alias(f"o{i}"),
                 F.stddev_pop(f).alias(f"s{i}")]
    wide = tagged.agg(*aggs)
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f"w{i}").alias("weak_fold_mean"), F.col(f"o{i}").alias("other_folds_mean"),
                     F.when(F.col(f"s{i}") == 0, 0.0).otherwise((F.col(f"w{i}") - F.col(f"o{i}")) / F.col(f"s{i}")).alias("standardized_mean_difference"))
            for i, f in enumerate(features)]
    return wide.select(F.inline(F.array(*rows))).orderBy(F.abs(F.col("standardized_mean_difference")).desc(), "feature").limit(top)
