"""Toxicity by a classifier chain of linear models.

The categories are predicted one after another. The model of a category is a logistic regression on
hashed words and word beginnings, chosen by chi-square, plus the probabilities of all earlier
categories. While training, those probabilities are out-of-fold, so a later model sees them as noisy
as they will be on new texts. Fitting uses at most ``TRAIN_ROWS`` labelled documents (the bound of the
classifier's sample); all documents are scored whole.

Defined cases: a null or empty text has no features and is never flagged; labels that are null in a
category, or whose document is missing, teach nothing; an id labelled twice takes the higher label;
repeated documents score alike; a category with one class predicts that class's share; without
labels all probabilities are 0; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import ship

CHAIN = ("quality", "toxic")
TRAIN_ROWS = 12_000
BITS = 18
FEATURES = 3000                # kept by chi-square
MIN_DOCS = 4
FOLDS = 3
BEGINNINGS = (4, 5)
RIDGE = 1.0
STEPS = 150
CACHE_WORDS = 500_000
_WORD = re.compile(r"[^\W_]+")


class WordFeatures(dict):
    """Word -> hashed ids of the word and its beginnings, remembered per worker."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE_WORDS:
            self.clear()
        named = [f"={word}", *(f"{word[:k]}*" for k in BEGINNINGS if len(word) >= k)]
        self[word] = made = tuple(xxhash.xxh32_intdigest(x) >> (32 - BITS) for x in named)
        return made


_FEATURES = WordFeatures()


def text_features(text: str | None) -> np.ndarray:
    """Sorted distinct feature ids of the whole text."""
    words = set(_WORD.findall((text or "").lower()))
    return np.unique(np.fromiter((i for w in words for i in _FEATURES[w]), dtype=np.int32))


@dataclass
class Linear:
    weights: np.ndarray        # by feature id
    earlier: np.ndarray        # by earlier category
    bias: float

    def scores(self, rows: list[np.ndarray], before: np.ndarray) -> np.ndarray:
        z = np.array([self.weights[r].sum() for r in rows]) if rows else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z + before @ self.earlier + self.bias, -30, 30)))


def fit_linear(rows: list[np.ndarray], before: np.ndarray, y: np.ndarray) -> Linear:
    """Ridge logistic regression by accelerated gradient steps on the chi-square-chosen features."""
    n, share = len(y), float(y.mean()) if len(y) else 0.0
    weights, earlier = np.zeros(1 << BITS, dtype=np.float32), np.zeros(before.shape[1])
    if not 0 < share < 1:
        return Linear(weights, earlier, 30.0 if share else -30.0)
    at = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    seen = np.bincount(at, minlength=1 << BITS).astype(float)
    hit = np.bincount(at, weights=y[row], minlength=1 << BITS)
    gap = hit - seen * share
    chi = np.where((seen >= MIN_DOCS) & (seen < n), gap ** 2 / np.maximum(seen * share * (1 - share) * (1 - seen / n), 1e-9), 0.0)
    chosen = np.sort(np.argsort(-chi, kind="stable")[:FEATURES])
    chosen = chosen[chi[chosen] > 0]
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    inside = place[at] >= 0
    col, row = place[at[inside]], row[inside]
    d = len(chosen)
    # step size from a bound of the curvature, each coordinate scaled by its own count
    scale = 1 / (0.25 * np.concatenate([np.bincount(col, minlength=d), (before ** 2).sum(axis=0), [n]]) * 8 + RIDGE)
    w = np.zeros(d + before.shape[1] + 1)
    w[-1] = np.log(share / (1 - share))
    look, last, k = w.copy(), w.copy(), 1.0
    for _ in range(STEPS):
        z = np.bincount(row, weights=look[:d][col], minlength=n) + before @ look[d:-1] + look[-1]
        r = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        grad = np.concatenate([np.bincount(col, weights=r[row], minlength=d), before.T @ r, [r.sum()]])
        grad[:-1] += RIDGE * look[:-1]
        w = look - scale * grad
        if grad @ (w - last) > 0:  # restart the momentum when it points uphill
            k = 1.0
        step = (1 + np.sqrt(1 + 4 * k * k)) / 2
        look, last, k = w + (k - 1) / step * (w - last), w, step
    weights[chosen] = w[:d]
    return Linear(weights, w[d:-1], float(w[-1]))


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, fold: np.ndarray) -> tuple[list[Linear], float]:
    """The models in chain order and the flag threshold of the last category (best F1 out of fold)."""
    before = np.zeros((len(rows), 0))
    models, cut = [], 0.5
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        models.append(fit_linear(rows, before, y))
        out = np.zeros(len(rows))
        for f in range(FOLDS):
            test = np.nonzero(fold == f)[0]
            train = np.nonzero(fold != f)[0]
            part = fit_linear([rows[i] for i in train], before[train], y[train])
            out[test] = part.scores([rows[i] for i in test], before[test])
        if c == labels.shape[1] - 1 and 0 < y.sum() < len(y):
            order = np.argsort(-out, kind="stable")
            good = np.cumsum(y[order])
            f1 = 2 * good / (np.arange(1, len(y) + 1) + y.sum())
            best = int(np.argmax(f1))
            below = out[order[best + 1]] if best + 1 < len(order) else 0.0
            cut = float((out[order[best]] + below) / 2)
        before = np.column_stack([before, out])
    return models, cut


@dataclass
class Chain:
    categories: tuple[str, ...]
    models: list[Linear] = field(default_factory=list)
    cut: float = 0.5

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        before = np.zeros((len(rows), 0))
        for m in self.models:
            before = np.column_stack([before, m.scores(rows, before)])
        return before if self.models else np.zeros((len(rows), len(self.categories)))


def fit(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CHAIN, train_rows: int = TRAIN_ROWS) -> Chain:
    ship(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in categories]).dropna()
    marks = marks.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories])
    sample = marks.withColumn("at", F.xxhash64("doc_id")).orderBy("at", "doc_id").limit(train_rows)  # the bounded sample
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [text_features(t.as_py()).tobytes() for t in b.column(0)]
            yield pa.record_batch([*b.columns[1:], pa.array(made, pa.binary())], names=[*b.schema.names[1:], "features"])

    def train(group: pd.DataFrame) -> pd.DataFrame:
        # repeated documents teach once; the sample bounds this one group
        group = group.sort_values(["at", "doc_id", "features"]).drop_duplicates(["doc_id", "features"]).head(train_rows)
        made, cut = fit_chain([np.frombuffer(x, dtype=np.int32) for x in group["features"]], group[list(categories)].to_numpy(),
                              group["at"].to_numpy().astype(np.int64) % FOLDS)
        return pd.DataFrame({"category": range(len(made)), "weights": [m.weights.tobytes() for m in made], "earlier": [m.earlier.tolist() for m in made],
                             "bias": [m.bias for m in made], "cut": cut})

    names = ", ".join(f"{c} int" for c in categories)
    found = (rows.select("text", "doc_id", *categories, "at").mapInArrow(features, f"doc_id long, {names}, at long, features binary")
             .withColumn("one", F.lit(1)).groupBy("one").applyInPandas(train, "category int, weights binary, earlier array<double>, bias double, cut double").collect())
    found.sort(key=lambda r: r["category"])  # one row a category
    models = [Linear(np.frombuffer(r["weights"], dtype=np.float32), np.array(r["earlier"]), r["bias"]) for r in found]
    return Chain(categories, models, found[0]["cut"] if found else 0.5)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, p_<category>..., <last category>) of every document."""
    last = chain.categories[-1]
    ship(docs.sparkSession)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_features(t.as_py()) for t in b.column(1)]
            p = chain.predict(rows)
            flag = np.array([len(r) > 0 for r in rows], dtype=bool) & (p[:, -1] >= chain.cut) & (len(chain.models) > 0)
            yield pa.record_batch([b.column(0), *(pa.array(p[:, c]) for c in range(p.shape[1])), pa.array(flag)],
                                  names=["doc_id", *(f"p_{c}" for c in chain.categories), last])

    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in chain.categories) + f", {last} boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(predict, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
