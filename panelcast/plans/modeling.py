"""Per-fold model fitting with Spark ML.

Each fold is fitted on its training rows only: statistics (G1/G2), class
weights (G5) and the learner. The fold loop runs on the driver (k small), every
fit and transform is distributed. Predictions of all folds form one table
(fold, entity, period, label, score).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.prep import as_sql_stage, class_weight, class_weight_values, fit_stats
from ..operators.splits import Fold
from ..session import written
from ..spec import PanelSpec
from .boosting import BoostingParams, fit_boosting
from .forest import ForestParams, fit_forests


@dataclass(frozen=True)
class ModelSpec:
    kind: str  # "logistic" | "forest" | "boosting"
    params: dict = field(default_factory=dict)
    seed: int = 42

    @property
    def scaled(self) -> bool:
        return self.kind == "logistic"


def _learner(m: ModelSpec, weight_sum: float):
    p = dict(m.params)
    if m.kind == "logistic":
        C = p.pop("C", 1.0)
        penalty = p.pop("penalty", "l2")
        # sklearn minimises 1/2|b|^2 + C * sum(w * loss); Spark: sum(w*loss)/sum(w) + regParam * penalty
        return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", standardization=False,
                                  regParam=1.0 / (C * weight_sum), elasticNetParam=1.0 if penalty == "l1" else 0.0,
                                  maxIter=p.pop("maxIter", 100), **p)
    if m.kind == "forest":
        return RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", seed=m.seed,
                                      numTrees=p.pop("numTrees", 50), maxDepth=p.pop("maxDepth", 10),
                                      minInstancesPerNode=p.pop("minInstancesPerNode", 5),
                                      featureSubsetStrategy=p.pop("featureSubsetStrategy", "sqrt"), maxBins=p.pop("maxBins", 64),
                                      # larger node groups per pass: fewer passes over the data per tree level
                                      maxMemoryInMB=p.pop("maxMemoryInMB", 1024), cacheNodeIds=p.pop("cacheNodeIds", False), **p)
    if m.kind == "boosting":
        return GBTClassifier(featuresCol="features", labelCol="label", seed=m.seed, maxIter=p.pop("maxIter", 50),
                             maxDepth=p.pop("maxDepth", 3), stepSize=p.pop("stepSize", 0.1),
                             minInstancesPerNode=p.pop("minInstancesPerNode", 20), maxBins=p.pop("maxBins", 64),
                             maxMemoryInMB=p.pop("maxMemoryInMB", 1024), cacheNodeIds=p.pop("cacheNodeIds", False), **p)
    raise ValueError(m.kind)


FIT_WORKERS = 4  # independent fits in flight at once: a small fit is driver-bound, a large one fills the cluster by itself


def in_parallel(jobs: list[Callable], workers: int = FIT_WORKERS) -> list:
    """Results of independent fits, in order, with at most ``workers`` running."""
    if workers <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(lambda job: job(), jobs))


@dataclass(frozen=True)
class FoldPrep:
    """Training-fold statistics shared by every candidate fitted on the same rows."""
    stats: object
    weights: tuple[float, float]
    rows: int


def prepare_fold(train: DataFrame, features: list[str], label: str, scaled: bool) -> FoldPrep:
    stats = fit_stats(train, features, scale=scaled)
    w = class_weight_values(train, label)
    n = train.count()
    return FoldPrep(stats, w, n)


def fit_pipeline(train: DataFrame, features: list[str], label: str, m: ModelSpec, prepared: FoldPrep | None = None,
                 spread_by: tuple[str, ...] = ()) -> PipelineModel:
    """Statistics + assembler + learner fitted on ``train``; persistable with ``.save``."""
    if m.kind in ("forest", "boosting"):
        # one explicit layout: bagging follows partitions, so scores depend on this count alone, not on cores or data size
        train = train.repartition(int(train.sparkSession.conf.get("spark.sql.shuffle.partitions")), *spread_by)
    prepared = prepared or prepare_fold(train, features, label, m.scaled)
    stats, w = prepared.stats, prepared.weights
    staged = train.withColumn("label", F.col(label).cast("double")).withColumn("weight", class_weight(label, w))
    # balanced weights sum to the row count when both classes occur: n0*n/(2 n0) + n1*n/(2 n1) = n
    weight_sum = float(prepared.rows) if all(w) else staged.agg(F.sum("weight")).first()[0]
    stages = [as_sql_stage(stats), VectorAssembler(inputCols=[f"{c}__prep" for c in features], outputCol="features"),
              _learner(m, weight_sum)]
    return Pipeline(stages=stages).fit(staged)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("score", vector_to_array("probability")[1])


def fold_predictions(folds: list[Fold], spec: PanelSpec, features: list[str], label: str, m: ModelSpec,
                     keep_models: list | None = None, prepared: dict | None = None, workers: int = FIT_WORKERS) -> DataFrame:
    """Fit per fold on its training rows, score its validation rows, union."""
    parts = []
    models = in_parallel([lambda f=f: fit_pipeline(f.train, features, label, m, (prepared or {}).get(f.position), spec.key) for f in folds], workers)
    for f, model in zip(folds, models):
        if keep_models is not None:
            keep_models.append((f, model))
        parts.append(score(model, f.validation).select(
            F.lit(f.position).alias("fold"), spec.entity, spec.period, F.col(label).alias("label"), "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def coefficients(spark, models: list, features: list[str]) -> DataFrame:
    """Coefficient table (fold, feature, value) of fitted logistic pipelines (I1 input)."""
    rows = []
    for f, model in models:
        coef = model.stages[-1].coefficients.toArray()
        rows += [(f.position, feat, float(v)) for feat, v in zip(features, coef)]
    return spark.createDataFrame(rows, "fold int, feature string, value double")


def platt_calibrate(scored: DataFrame, held: Column, spec: PanelSpec, folds: list[int], eps: float = 1e-6) -> DataFrame:
    """Per fold a logistic fit on the clipped logit of its calibration scores, applied to its held-out rows (``held``)."""
    from .logistic import Candidate, Side, fit_logistic
    p = F.least(F.greatest(F.col("score"), F.lit(eps)), F.lit(1 - eps))
    own = [F.col("fold") == f for f in folds]
    split = [Side(f, mine & ~held, mine & held) for f, mine in zip(folds, own)]
    fitted = fit_logistic(scored.withColumn("_logit", F.log(p / (1 - p))), split, {c: F.col(c) for c in spec.key}, "label", [Candidate(("_logit",))], balanced=False, scaled=False)
    return fitted.score().drop("model")


def isotonic_calibrate(cal: DataFrame, target: DataFrame) -> DataFrame:
    """Isotonic regression on calibration scores; outside the fitted range it clips."""
    va = VectorAssembler(inputCols=["score"], outputCol="features")
    model = Pipeline(stages=[va, IsotonicRegression(featuresCol="features", labelCol="label", predictionCol="calibrated")]).fit(
        cal.withColumn("label", F.col("label").cast("double")))
    return model.transform(target).withColumn("score", F.least(F.greatest(F.col("calibrated"), F.lit(0.0)), F.lit(1.0))) \
        .drop("features", "calibrated")


def final_metrics(preds: DataFrame, spec: PanelSpec, threshold: float) -> DataFrame:
    """Final evaluation of (entity, period, label, score): rows, entities, prevalence, AP / ROC-AUC / Brier /
    confusion at the locked threshold and ECE in one metric row. The predictions are cut once."""
    from ..operators.metrics import evaluate
    preds = written(preds, "predictions").withColumn("_all", F.lit(0))
    stats = preds.groupBy("_all").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(spec.entity).alias("entities"),
                                      F.avg(F.col("label").cast("double")).alias("prevalence"))
    return stats.join(evaluate(preds, threshold, by=["_all"], calibration=True), "_all").drop("_all").withColumn("threshold", F.lit(float(threshold)))


def forest_predictions(dev: DataFrame, folds: list[Fold], spec: PanelSpec, features: list[str], label: str, models: list[ForestParams]) -> DataFrame:
    """G7 / G10 for any number of forests at once: (model, fold, entity, period, label, score), written once."""
    fitted = fit_forests(dev, [(f.position, F.col(spec.period) < F.lit(f.validation_start)) for f in folds], features, list(spec.key), label, models)
    return written(fitted.score_folds(folds[0].rows, [(f.position, f.validating) for f in folds], list(spec.key), label), "forest-scores")


def boosting_predictions(dev: DataFrame, folds: list[Fold], spec: PanelSpec, features: list[str], label: str, models: list[BoostingParams]) -> DataFrame:
    """G8 / G10 for any number of boosted models at once: (model, fold, entity, period, label, score), written once."""
    parts = []
    for bins in sorted({m.bins for m in models}):
        own = [i for i, m in enumerate(models) if m.bins == bins]
        fitted = fit_boosting(dev, [(f.position, F.col(spec.period) < F.lit(f.validation_start)) for f in folds], features, list(spec.key), label, [models[i] for i in own])
        number = F.element_at(F.array(*[F.lit(i) for i in own]), F.col("model") + 1)
        parts += [fitted.score(f.validation, f.position, list(spec.key), label).withColumn("fold", F.lit(f.position)).withColumn("model", number) for f in folds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return written(out.select("model", "fold", *spec.key, "label", "score"), "boosting-scores")


def tune_table(preds: DataFrame, candidates: list[ModelSpec]) -> DataFrame:
    """Per candidate (``model`` is its number) and fold AP / ROC-AUC, from one ladder over all of them."""
    from ..operators.ladder import ranking_metrics, score_ladder
    table = ranking_metrics(score_ladder(preds, by=["model", "fold"]), ["model", "fold"]).withColumnRenamed("model", "candidate")
    names = F.array(*[F.struct(F.lit(m.kind).alias("kind"), F.lit(repr(sorted(m.params.items()))).alias("params")) for m in candidates])
    return table.withColumn("_m", F.element_at(names, F.col("candidate") + 1)).withColumns({"kind": F.col("_m.kind"), "params": F.col("_m.params")}).drop("_m")


def tune(folds: list[Fold], spec: PanelSpec, features: list[str], label: str, candidates: list[ModelSpec]) -> DataFrame:
    """G11 for any Spark ML learner: the fold statistics are fitted side by side and shared by the candidates."""
    kinds = sorted({m.scaled for m in candidates})
    stats = in_parallel([lambda f=f, k=k: prepare_fold(f.train, features, label, k) for k in kinds for f in folds])
    shared = {(k, f.position): x for (k, f), x in zip([(k, f) for k in kinds for f in folds], stats)}
    scored = in_parallel([lambda m=m: fold_predictions(folds, spec, features, label, m, prepared={f.position: shared[m.scaled, f.position] for f in folds}, workers=1) for m in candidates])
    out = None
    for i, p in enumerate(scored):
        p = p.withColumn("model", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return tune_table(out, candidates)
