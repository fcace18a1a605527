"""Weighted logistic regression of many folds, feature sets and penalties at once.

One pass over the rows adds up loss, gradient and Hessian of every fit still running: each task keeps their sums
(a (d + 1) x (d + 1) matrix a fit, whatever its rows), and the sums of all tasks meet by fit. A Newton step needs
nothing else, so a fit takes some ten passes, whatever its rows, and nothing is kept in memory. An l1 penalty is
handled by a proximal Newton step (coordinate descent on the same d x d model). The optimum is that of Spark's
learner with standardization off: sum(w * loss) + (|b|^2 / 2 or |b|) / C, intercept free.

Rows carry two bit masks: the folds that train on them and the folds that score them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.prep import Stats, fold_stats
from ..operators.splits import Fold
from ..session import ship, written

PASSES, TOLERANCE = 100, 1e-13


@dataclass(frozen=True)
class Side:
    """A fold: rows to train on and rows to score."""
    position: int
    train: Column
    scored: Column


def sides(folds: list[Fold]) -> list[Side]:
    return [Side(f.position, f.training, f.validating) for f in folds]


@dataclass(frozen=True)
class Candidate:
    """A feature set (names) with its penalty."""
    features: tuple[str, ...]
    C: float = 1.0
    penalty: str = "l2"

    @staticmethod
    def of(features: list[str], params: dict) -> "Candidate":
        return Candidate(tuple(features), params.get("C", 1.0), params.get("penalty", "l2"))


@dataclass
class Fit:
    """The state of one (candidate, fold): the intercept comes first in ``beta``."""
    candidate: int
    fold: int
    columns: np.ndarray
    strength: float
    l1: bool
    beta: np.ndarray
    step: np.ndarray | None = None
    rate: float = 1.0
    promise: float = 0.0
    value: float = np.inf
    done: bool = False

    def penalty(self, beta: np.ndarray) -> float:
        return self.strength * (np.abs(beta[1:]).sum() if self.l1 else 0.5 * (beta[1:] ** 2).sum())

    @property
    def trial(self) -> np.ndarray:
        return self.beta if self.step is None else self.beta + self.rate * self.step

    def take(self, loss: float, gradient: np.ndarray, hessian: np.ndarray) -> None:
        """Accept the trial point or shorten the step; then ask for the next point."""
        at = self.trial
        value = loss + self.penalty(at)
        if self.step is not None and not value <= self.value + 1e-4 * self.rate * self.promise + 1e-11 * abs(self.value):
            self.rate /= 2
            self.done = self.rate < 1e-10
            self.step = None if self.done else self.step
            return
        self.beta, self.value, self.rate = at, value, 1.0
        self.step = _l1_step(at, gradient, hessian, self.strength) if self.l1 else _l2_step(at, gradient, hessian, self.strength)
        if self.l1:
            self.promise = float(gradient @ self.step) + self.penalty(at + self.step) - self.penalty(at)
        else:
            self.promise = float((gradient + np.concatenate([[0.0], self.strength * at[1:]])) @ self.step)
        if -self.promise <= TOLERANCE * max(1.0, abs(value)):
            self.beta, self.step, self.done = at + self.step, None, True


def _l2_step(beta: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, strength: float) -> np.ndarray:
    ridge = np.full(len(beta), strength)
    ridge[0] = 0.0
    a = hessian + np.diag(ridge + 1e-12 * max(1e-300, hessian[0, 0]))
    return -np.linalg.solve(a, gradient + ridge * beta)


def _l1_step(beta: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, strength: float) -> np.ndarray:
    """Least point of the quadratic model plus the penalty, by coordinate descent."""
    curve = np.diag(hessian) + 1e-12 * max(1e-300, hessian[0, 0])
    new, slope = beta.copy(), gradient.copy()
    for _ in range(2000):
        moved = 0.0
        for j in range(len(beta)):
            goal = new[j] - slope[j] / curve[j]
            if j:
                goal = np.sign(goal) * max(0.0, abs(goal) - strength / curve[j])
            change = goal - new[j]
            if change:
                new[j] = goal
                slope += hessian[:, j] * change
                moved = max(moved, abs(change) * np.sqrt(curve[j]))
        if moved < 1e-9:
            break
    return new - beta


def _matrix(batch: pa.RecordBatch, first: int, width: int) -> np.ndarray:
    x = np.empty((batch.num_rows, width))
    for j in range(width):
        x[:, j] = batch.column(first + j).to_numpy(zero_copy_only=False)  # null: nan
    return x


def _prepared(x: np.ndarray, fill: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return (np.where(np.isnan(x), fill, x) - center) / scale


@dataclass
class Logistic:
    """Fitted candidates over folds, with the rows that the folds score."""
    table: DataFrame
    kept: list[str]
    features: list[str]
    sides: list[Side]
    shapes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    fits: list[Fit]

    def score(self) -> DataFrame:
        """(model, fold, kept columns, label, score): every candidate on the scored rows of every fold."""
        width, kept, shapes = len(self.features), len(self.kept) + 1, self.shapes
        fits = [(f.candidate, f.fold, f.columns, f.beta) for f in self.fits]
        positions = [s.position for s in self.sides]
        kinds = {f.name: f.dataType.simpleString() for f in self.table.schema.fields}
        names = [*self.kept, "label"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = batch.column(kept + 1).to_numpy(zero_copy_only=False)
                x = _matrix(batch, kept + 2, width)
                for k in range(len(positions)):
                    own = (out >> k) & 1 == 1
                    if not own.any():
                        continue
                    z, part = _prepared(x[own], *shapes[k]), batch.filter(pa.array(own))
                    for candidate, fold, columns, beta in fits:
                        if fold == k:
                            with np.errstate(over="ignore", invalid="ignore"):
                                margin = z[:, columns] @ beta[1:] + beta[0]
                                score = 1.0 / (1.0 + np.exp(-margin))
                            n = part.num_rows
                            yield pa.record_batch([pa.array(np.full(n, candidate, dtype=np.int32)), pa.array(np.full(n, positions[k], dtype=np.int32)), *[part.column(c) for c in range(kept)], pa.array(score)],
                                                  names=["model", "fold", *names, "score"])

        schema = "model int, fold int, " + ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double"
        return self.table.where("_out > 0").mapInArrow(run, schema)

    def coefficients(self) -> DataFrame:
        """(model, fold, feature, value)."""
        rows = [(f.candidate, self.sides[f.fold].position, self.features[c], float(v)) for f in self.fits for c, v in zip(f.columns, f.beta[1:])]
        return self.table.sparkSession.createDataFrame(rows, "model int, fold int, feature string, value double")


def _sums(table: DataFrame, start: int, width: int, shapes: list, weights: list, fits: list[Fit]) -> dict[int, np.ndarray]:
    """Loss, gradient and Hessian of every fit at its trial point, in one pass."""
    asked = [(i, f.fold, f.columns, f.trial) for i, f in enumerate(fits) if not f.done]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {i: np.zeros(1 + len(b) + len(b) ** 2) for i, _, _, b in asked}
        for batch in batches:
            y = np.asarray(batch.column(start - 3).to_numpy(zero_copy_only=False), dtype=float)
            inside = batch.column(start - 2).to_numpy(zero_copy_only=False)
            x = _matrix(batch, start, width)
            for k in sorted({fold for _, fold, _, _ in asked}):
                own = (inside >> k) & 1 == 1
                if not own.any():
                    continue
                z, t = _prepared(x[own], *shapes[k]), y[own]
                w = np.where(t == 1, weights[k][1], weights[k][0])
                for i, fold, columns, b in asked:
                    if fold != k:
                        continue
                    a = np.concatenate([np.ones((len(t), 1)), z if len(columns) == width else z[:, columns]], axis=1)
                    margin = a @ b
                    p = 0.5 * (1.0 + np.tanh(0.5 * margin))
                    q = w * p * (1.0 - p)
                    total[i] += np.concatenate([[(w * (np.logaddexp(0.0, margin) - t * margin)).sum()], a.T @ (w * (p - t)), ((a * q[:, None]).T @ a).ravel()])
        yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["fit", "sums"])

    def added(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fit": [key[0]], "sums": [sum(np.frombuffer(v) for v in group["sums"]).tobytes()]})

    parts = table.where("_in > 0").mapInArrow(run, "fit int, sums binary")
    return {r["fit"]: np.frombuffer(r["sums"]) for r in parts.groupBy("fit").applyInPandas(added, "fit int, sums binary").collect()}


def fit_logistic(rows: DataFrame, sides: list[Side], keep: dict[str, Column], label: str, candidates: list[Candidate], balanced: bool = True, scaled: bool = True,
                 counts: DataFrame | None = None) -> Logistic:
    """Fit every candidate on every fold. ``keep`` names the columns that scores carry on. Statistics and class
    weights are those of a fold's training rows; without ``scaled`` features enter as they are. ``counts``: ``fold_counts``
    of the candidates' features over the training rows of ``sides``."""
    spark = rows.sparkSession
    ship(spark)
    features = list(dict.fromkeys(c for one in candidates for c in one.features))
    bits = lambda of: sum((F.when(of(s), F.lit(1 << k)).otherwise(F.lit(0)) for k, s in enumerate(sides)), F.lit(0))
    narrow = rows.select(*[c.alias(n) for n, c in keep.items()], F.col(label).alias("label"), bits(lambda s: s.train).cast("int").alias("_in"), bits(lambda s: s.scored).cast("int").alias("_out"),
                         *[F.col(f"`{c}`").cast("double").alias(f"_x{j}") for j, c in enumerate(features)])
    table = written(narrow, "design")
    inside = [(k, F.col("_in").bitwiseAND(F.lit(1 << k)) != 0) for k in range(len(sides))]
    sums = table.agg(*[F.count_if(c) for _, c in inside], *[F.count_if(c & (F.col("label") == 1)) for _, c in inside]).first()
    sizes = [(sums[k], sums[len(sides) + k]) for k in range(len(sides))]
    weights = [((n / (2.0 * (n - p)) if n > p else 0.0, n / (2.0 * p) if p else 0.0) if balanced else (1.0, 1.0)) for n, p in sizes]
    columns = [f"_x{j}" for j in range(len(features))]
    stats = fold_stats(table, columns, inside, counts) if scaled else {k: Stats({}, {}, {}) for k, _ in inside}
    array = lambda values, none: np.asarray([none if values.get(c) is None else values[c] for c in columns], dtype=float)
    shapes = [(array(stats[k].medians, 0.0), array(stats[k].centers, 0.0), array(stats[k].scales, 1.0)) for k, _ in inside]
    place = {c: j for j, c in enumerate(features)}
    fits = []
    for i, one in enumerate(candidates):
        for k, (n, p) in enumerate(sizes):
            fit = Fit(i, k, np.asarray([place[c] for c in one.features]), 1.0 / one.C, one.penalty == "l1", np.zeros(len(one.features) + 1))
            if p in (0, n):  # one class alone: as certain as Spark's learner
                fit.beta[0], fit.done = (np.inf if p else -np.inf), True
            fits.append(fit)
    start = len(keep) + 3
    for _ in range(PASSES):
        if all(f.done for f in fits):
            break
        for i, v in _sums(table, start, len(features), shapes, weights, fits).items():
            size = len(fits[i].beta)
            fits[i].take(v[0], v[1:1 + size], v[1 + size:].reshape(size, size))
    return Logistic(table, list(keep), features, sides, shapes, fits)
