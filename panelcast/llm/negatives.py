"""Hard-negative mining by maximum inner product with length buckets and coordinate pruning (LEMP).

Vectors are cut into buckets of like length. Within a bucket whose longest vector has length l, a score of
at least t with an anchor of length a needs a cosine of at least t / (a l). By that bound, whole buckets are
skipped, and every coordinate of a unit vector gets a feasible range: if the anchor's coordinate is cos(x)
and the bound is cos(y), the other one's lies between cos(x + y) and cos(x - y). The ranges of the anchor's
largest coordinates (its focus) are read off the bucket's sorted coordinate lists; only rows found in all
of them are verified with the exact integer product.

Both searches have a threshold before they start: the anchor's answer in one block of the fullest bucket.
Anchors travel only to blocks that can still reach it, in blocks against blocks, so a task sees at most
about ``BLOCK`` rows and ``ANCHORS`` anchors; equal lengths, labels or vectors only make more blocks.

Defined cases: rows with a null id, label or vector or with a null or non-finite component take no part;
rows equal in id, label and vector count once, rows that share an id only are different rows; shorter
vectors are filled up with zeros; an empty table gives an empty result; other columns are ignored. Scores
are exact while they fit a long.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import ship, written

#: Rows of a block, anchors of a block, and anchors scored at once.
BLOCK, ANCHORS, AT_ONCE = 16_384, 4_096, 64
#: Lengths of one bucket differ at most by this factor (buckets of few rows are joined with the next shorter one).
RATIO = 1.1
#: Focus coordinates of an anchor.
FOCUS = 4
#: Below any score.
NONE = -(1 << 62)

VECTORS = "vec_id long, label long, vec binary, norm double"
ROW = "vec_id long, key long, label long, vec binary, norm double"


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """The rows that take part, components as floor(scale * x): (vec_id, key, label, vec, norm, bucket)."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for vec_id, label, vector in zip(*(batch.column(k) for k in range(3))):
                x = vector.values if vector.is_valid else None
                if x is None or not vec_id.is_valid or not label.is_valid or x.null_count:
                    continue
                x = x.to_numpy(zero_copy_only=False)
                if not np.isfinite(x).all():
                    continue
                whole = np.floor(scale * x)
                for column, value in zip(out, (vec_id.as_py(), label.as_py(), whole.astype("<i8").tobytes(), float(np.sqrt(whole @ whole)))):
                    column.append(value)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.float64())],
                                  names=["vec_id", "label", "vec", "norm"])

    whole = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
                        F.col("embedding").cast("array<double>").alias("embedding")).select("vec_id", "label", "embedding").mapInArrow(run, VECTORS)
    whole = whole.dropDuplicates(["vec_id", "label", "vec"])
    bucket = F.when(F.col("norm") > 0, F.floor(F.log("norm") / math.log(RATIO))).otherwise(-1).cast("int")
    return whole.select("vec_id", F.xxhash64("label", "vec").alias("key"), "label", "vec", "norm", bucket.alias("bucket"))


class Bucket:
    """Rows of one length bucket with their sorted coordinate lists."""

    def __init__(self, ids: np.ndarray, keys: np.ndarray, labels: np.ndarray, vectors: np.ndarray, norms: np.ndarray):
        self.ids, self.keys, self.labels, self.vectors, self.norms = ids, keys, labels, vectors, norms
        self.longest = float(norms.max()) if len(norms) else 0.0
        self.unit = vectors / np.where(norms > 0, norms, 1)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    def feasible(self, anchor: np.ndarray, length: float, least: int) -> np.ndarray | None:
        """Positions of the rows that may score ``least`` or more with the anchor; None: all of them."""
        if least <= 0 or not len(self.ids):
            return None
        reach = length * self.longest
        cosine = (least - 0.5) / reach if reach else 2.0  # scores are whole numbers; the half leaves room for rounding
        if cosine > 1:
            return np.empty(0, dtype=np.int64)
        unit, angle = anchor / length, math.acos(cosine)
        hits, lists = None, 0
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            own = math.acos(max(-1.0, min(1.0, unit[f])))
            low = math.cos(own + angle) if own + angle < math.pi else -1.0
            high = math.cos(own - angle) if own > angle else 1.0
            order, values = self.sorted(int(f))
            a, b = np.searchsorted(values, low - 1e-9, "left"), np.searchsorted(values, high + 1e-9, "right")
            if b - a < len(order):  # a range that holds all rows prunes none
                hits = np.zeros(len(order), dtype=np.uint8) if hits is None else hits
                hits[order[a:b]] += 1
                lists += 1
        return None if hits is None else np.flatnonzero(hits == lists)

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """The first ``k`` of the scored rows, as positions in ``rows``: by score, ties by id."""
        if len(scores) > k:
            bar = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = np.flatnonzero(scores >= bar)
        else:
            near = np.arange(len(scores))
        return near[np.lexsort((self.keys[rows[near]], self.ids[rows[near]], -scores[near]))[:k]]

    def scored(self, anchors: np.ndarray, lengths: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, rows, exact scores) for every anchor, rows that can't reach ``least`` left out."""
        small = len(self.ids) and np.abs(self.vectors).max() * max(1.0, np.abs(anchors).max()) * anchors.shape[1] < 2 ** 53
        kind = np.float64 if small else np.int64
        vectors, whole = self.vectors.astype(kind), []
        for i in range(len(anchors)):
            rows = self.feasible(anchors[i], lengths[i], int(least[i]))
            if rows is None:
                whole.append(i)
            else:
                yield i, rows, (vectors[rows] @ anchors[i].astype(kind)).astype(np.int64)
        every = np.arange(len(self.ids))
        for at in range(0, len(whole), AT_ONCE):
            some = whole[at:at + AT_ONCE]
            scores = (anchors[some].astype(kind) @ vectors.T).astype(np.int64)
            for i, s in zip(some, scores):
                yield i, every, s


def _matrix(vecs: pd.Series, width: int) -> np.ndarray:
    if not len(vecs):
        return np.zeros((0, width))
    if all(len(v) == 8 * width for v in vecs):
        return np.frombuffer(b"".join(vecs), dtype="<i8").reshape(len(vecs), width)
    return np.stack([np.frombuffer(v.ljust(8 * width, b"\0"), dtype="<i8") for v in vecs])


def _both(anchors: pd.DataFrame, rows: pd.DataFrame) -> tuple[np.ndarray, Bucket]:
    width = max([1, *(len(v) // 8 for v in anchors["vec"]), *(len(v) // 8 for v in rows["vec"])])
    return _matrix(anchors["vec"], width), Bucket(rows["vec_id"].to_numpy(), rows["key"].to_numpy(), rows["label"].to_numpy(), _matrix(rows["vec"], width), rows["norm"].to_numpy())


def _same_label(anchors: pd.DataFrame, rows: pd.DataFrame, k: int) -> Iterator[tuple[int, Bucket, np.ndarray, np.ndarray]]:
    """For every anchor, its first ``k`` other rows of its label in this block: (anchor, bucket, rows, scores)."""
    vectors, block = _both(anchors, rows)
    labels, ids, keys = anchors["label"].to_numpy(), anchors["vec_id"].to_numpy(), anchors["key"].to_numpy()
    least, lengths = anchors["least"].to_numpy(), anchors["norm"].to_numpy()
    for label in np.unique(labels):
        own, of = np.flatnonzero(labels == label), np.flatnonzero(block.labels == label)
        part = Bucket(block.ids[of], block.keys[of], block.labels[of], block.vectors[of], block.norms[of])
        for i, at, scores in part.scored(vectors[own], lengths[own], least[own]):
            i = own[i]
            keep = (scores >= least[i]) & ~((part.ids[at] == ids[i]) & (part.keys[at] == keys[i]))
            at, scores = at[keep], scores[keep]
            first = part.best(at, scores, k)
            yield i, part, at[first], scores[first]


def _other_label(anchors: pd.DataFrame, rows: pd.DataFrame, k: int) -> Iterator[tuple[int, int, Bucket, np.ndarray, np.ndarray]]:
    """For every anchor and interval, its first ``k`` rows of other labels with a score inside."""
    vectors, block = _both(anchors, rows)
    labels, low, high = anchors["label"].to_numpy(), list(anchors["low"]), list(anchors["high"])
    for i, at, scores in block.scored(vectors, anchors["norm"].to_numpy(), np.asarray([min(x) for x in low])):
        keep = (scores >= min(low[i])) & (scores <= max(high[i])) & (block.labels[at] != labels[i])
        at, scores = at[keep], scores[keep]
        for j, (a, b) in enumerate(zip(low[i], high[i])):
            inside = np.flatnonzero((scores >= a) & (scores <= b))
            first = inside[block.best(at[inside], scores[inside], k)]
            yield i, j, block, at[first], scores[first]


Meet = Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]


class Blocks:
    """The rows in blocks: a group of neighbouring length buckets, dealt by hash into parts of about ``BLOCK`` rows."""

    def __init__(self, vectors: DataFrame):
        counts = vectors.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).collect()  # as many rows as lengths have magnitudes
        self.groups: list[dict] = []
        for r in sorted(counts, key=lambda r: -r.bucket):
            if not self.groups or self.groups[-1]["n"] >= BLOCK // 4:
                self.groups.append({"n": 0, "top": r.top, "buckets": []})
            self.groups[-1]["n"] += r.n
            self.groups[-1]["buckets"].append(r.bucket)
        for g in self.groups:
            g["parts"] = max(1, math.ceil(g["n"] / BLOCK))
        self.vectors = vectors

    def _by_bucket(self, values: list[int]) -> Column:
        """The value of a row's group; groups go from long to short, so the first that reaches down to its bucket."""
        out = F.lit(values[-1])
        for g, value in list(zip(self.groups, values))[-2::-1]:
            out = F.when(F.col("bucket") >= g["buckets"][-1], F.lit(value)).otherwise(out)
        return out

    def rows(self, anchor_parts: int) -> DataFrame:
        parts = self._by_bucket([g["parts"] for g in self.groups])
        return (self.vectors.withColumn("g", self._by_bucket(list(range(len(self.groups)))))
                .withColumn("part", F.pmod(F.xxhash64("vec_id", "key"), parts).cast("int"))
                .withColumn("ap", F.explode(F.sequence(F.lit(0), F.lit(anchor_parts - 1)))))

    def seed(self, anchors: DataFrame) -> DataFrame:
        """Every anchor meets one block of the fullest group."""
        fullest = max(range(len(self.groups)), key=lambda k: self.groups[k]["n"])
        return anchors.withColumn("g", F.lit(fullest)).withColumn("part", F.pmod(F.xxhash64("key", "vec_id"), F.lit(self.groups[fullest]["parts"])).cast("int"))

    def reachable(self, anchors: DataFrame, least: Column) -> DataFrame:
        """Every anchor meets all blocks whose longest row may score ``least`` with it."""
        groups = F.array(*[F.struct(F.lit(k).alias("g"), F.lit(g["parts"]).alias("parts"), F.lit(float(g["top"])).alias("top")) for k, g in enumerate(self.groups)])
        near = F.filter(groups, lambda b: (least <= 0) | (F.col("norm") * b["top"] >= least - F.lit(0.5)))
        return (anchors.withColumn("b", F.explode(near)).withColumn("g", F.col("b.g"))
                .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("b.parts") - 1))).drop("b"))

    def meet(self, anchors: DataFrame, anchor_parts: int, what: Meet, schema: str) -> DataFrame:
        dealt = anchors.withColumn("ap", F.pmod(F.xxhash64("vec_id", "key"), F.lit(anchor_parts)).cast("int"))
        dealt = dealt.select(*[F.col(c).alias(c) for c in dealt.columns])  # columns of its own: both sides stem from one table
        keys = ["g", "part", "ap"]
        return dealt.groupBy(*keys).cogroup(self.rows(anchor_parts).groupBy(*keys)).applyInPandas(what, schema)


def hard_negatives(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, scale: int = 256, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has vec_id, embedding and label; anchors are the rows whose id ``every`` divides. A negative's
    score lies between ``low`` and ``high`` percent of the positive's.
    """
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark = rows.sparkSession
    vectors = written(quantised(rows, scale), "vectors")
    blocks = Blocks(vectors)
    anchors = vectors.filter(F.col("vec_id") % every == 0).drop("bucket")
    n = anchors.count()
    if not n:
        return spark.createDataFrame([], out)
    parts = math.ceil(n / ANCHORS)

    def seed_same(a: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        a = a.assign(least=NONE)
        least = a["least"].to_numpy(copy=True)
        for i, _, _, scores in _same_label(a, r, positives) if len(a) and len(r) else ():
            if len(scores) == positives:
                least[i] = scores[-1]
        return a.assign(least=least)[["vec_id", "key", "label", "vec", "norm", "least"]]

    def same(a: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"anchor_id": a["vec_id"].iat[i], "anchor_key": a["key"].iat[i], "positive_id": part.ids[at], "positive_key": part.keys[at], "positive_score": scores})
                 for i, part, at, scores in (_same_label(a, r, positives) if len(a) and len(r) else ()) if len(at)]
        return pd.concat(found) if found else pd.DataFrame(columns=["anchor_id", "anchor_key", "positive_id", "positive_key", "positive_score"])

    def seed_other(a: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        raised = [np.array(x) for x in a["low"]]
        for i, j, _, _, scores in _other_label(a, r, negatives) if len(a) and len(r) else ():
            if len(scores) == negatives:
                raised[i][j] = scores[-1]
        return a.assign(low=pd.Series(raised, index=a.index, dtype=object))[["vec_id", "key", "label", "vec", "norm", "low", "high", "positive"]]

    def other(a: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"anchor_id": a["vec_id"].iat[i], "anchor_key": a["key"].iat[i], "positive_score": a["positive"].iat[i][j], "negative_id": block.ids[at],
                               "negative_key": block.keys[at], "negative_score": scores})
                 for i, j, block, at, scores in (_other_label(a, r, negatives) if len(a) and len(r) else ()) if len(at)]
        return pd.concat(found) if found else pd.DataFrame(columns=["anchor_id", "anchor_key", "positive_score", "negative_id", "negative_key", "negative_score"])

    anchor = ["anchor_id", "anchor_key"]
    seeded = written(blocks.meet(blocks.seed(anchors), parts, seed_same, f"{ROW}, least long"), "anchors")
    found = blocks.meet(blocks.reachable(seeded, F.col("least")), parts, same,
                        "anchor_id long, anchor_key long, positive_id long, positive_key long, positive_score long")
    first = Window.partitionBy(*anchor).orderBy(F.desc("positive_score"), "positive_id", "positive_key")
    chosen = written(found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives), "positives")

    # one interval per score: low * p <= 100 * n <= high * p in whole numbers
    p = F.col("positive_score")
    below = lambda x: f"({x} - pmod({x}, 100)) div 100"  # noqa: E731  floor(x / 100)
    spans = chosen.select(*anchor, p).distinct().withColumn("low", -F.expr(below(f"(-{low} * positive_score)"))).withColumn("high", F.expr(below(f"({high} * positive_score)")))
    spans = spans.filter("low <= high").groupBy(*anchor).agg(F.collect_list(F.struct(p, "low", "high")).alias("s"))
    spans = spans.select(F.col("anchor_id").alias("vec_id"), F.col("anchor_key").alias("key"), F.col("s.low").alias("low"), F.col("s.high").alias("high"), F.col("s.positive_score").alias("positive"))
    more = "low array<long>, high array<long>, positive array<long>"
    asked = written(blocks.meet(blocks.seed(anchors.join(spans, ["vec_id", "key"])), parts, seed_other, f"{ROW}, {more}"), "intervals")
    found = blocks.meet(blocks.reachable(asked, F.array_min("low")), parts, other,
                        "anchor_id long, anchor_key long, positive_score long, negative_id long, negative_key long, negative_score long")
    first = Window.partitionBy(*anchor, "positive_score").orderBy(F.desc("negative_score"), "negative_id", "negative_key")
    hard = found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
    return chosen.drop("place").join(hard, [*anchor, "positive_score"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def relabelled(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """The registered query's label noise: where ``every`` divides the id, the next label."""
    moved = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return rows.select("vec_id", "embedding", moved.alias("label"))


#: The same by all pairs of anchors and rows.
SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM v a JOIN v r ON a.vec_id <> r.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, (row_number() OVER w)::INTEGER AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
"""
