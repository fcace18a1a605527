"""Near duplicates by a signature-coordinate inverted join, confirmed on the full shingle sets.

Texts with equal shingle sets form one class. A class is posted under each of its ``COORDS`` MinHash
coordinate values. Two sets at the required similarity agree in ``MATCHES`` coordinates or more, but
for a chance of about 1e-8 (a binomial tail), so after ordering a class's values from rare to
frequent, its COORDS - MATCHES + 1 rarest ones must meet (prefix); the frequent lists are skipped.

Links are only needed as far as they connect: a list first links its members to two leaders, links
that hold are merged to components, and only then pairs of different components inside a list are
taken, each once. Copies inside a component are never expanded to pairs. Of the pairs of different
components only those are left out that cannot be similar: parity sketches bound the symmetric
difference of two sets from below. Every candidate is counted on its signature and confirmed on full
sets.

Defined cases: a null or empty text (no words) has no shingles and is linked with nothing; fewer
words than a shingle form one shingle; repeated rows share a component; an id with several texts
links whatever any of its texts links; a null doc_id gets the component of its text's class (null if
no row of the class has an id); ties do not arise; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import hot_join, ship, written

SHINGLE = 5
SIMILARITY = 80                # per cent, inclusive
COORDS, MATCHES = 32, 12
SKETCH_BITS = 2048
CACHE_WORDS = 1_000_000
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64)
_PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordIds(dict):
    """64-bit ids of words, remembered per worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = made = xxhash.xxh64_intdigest(word)
        return made


_IDS = WordIds()


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of the ASCII-lower-cased words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=1)], dtype=np.uint64)
    ids = np.fromiter(map(_IDS.__getitem__, words), dtype=np.uint64, count=len(words))
    n = len(ids) - size + 1
    h = ids[:n] * _PLACE[0]
    for k in range(1, size):
        h += ids[k:k + n] * _PLACE[k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def signature(h: np.ndarray) -> np.ndarray:
    low = np.full(COORDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 4096):
        low = np.minimum(low, (h[None, at:at + 4096] * _MUL[:, None] + _ADD[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def features(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, digest, sig) of every row; digest and sig are null without shingles."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, sigs = [], [], []
            for text in batch.column(1):
                h = shingles(text.as_py(), size)
                counts.append(len(h))
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                sigs.append(signature(h) if len(h) else None)
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()),
                                   pa.array(sigs, pa.list_(pa.int32()))], names=["doc_id", "n_shingles", "digest", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(make, "doc_id long, n_shingles long, digest binary, sig array<int>")


def prefixes(classes: DataFrame, total: int) -> DataFrame:
    """(rep, key): the rare coordinate-value pairs of each class that a partner must meet."""
    key = F.shiftleft(F.col("c").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit((1 << 32) - 1)))
    posted = classes.select("rep", F.posexplode("sig").alias("c", "v")).select("rep", key.alias("key"))
    shared = written(posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    met = hot_join(posted, shared, ["key"], "n", total * COORDS)
    # values of one class only are the rarest; what is left of the prefix goes to shared values, rare first
    left = COORDS - MATCHES + 1 - (COORDS - F.size("all"))
    rare = F.slice(F.sort_array("all"), 1, F.greatest(left, F.lit(0)))
    return met.groupBy("rep").agg(F.collect_list(F.struct("n", "key")).alias("all")).select("rep", F.explode(rare).alias("x")).select("rep", F.col("x.key").alias("key"))


def agreeing(a: str, b: str):
    """Number of equal signature coordinates, as generated code instead of a lambda."""
    return sum((F.get(F.col(a), F.lit(k)) == F.get(F.col(b), F.lit(k))).cast("int") for k in range(COORDS))


def confirmed(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, size: int, similarity: int) -> DataFrame:
    """Pairs (x, y) that agree on MATCHES coordinates and reach the similarity on full sets."""
    both = (pairs.join(sigs.select(F.col("rep").alias("x"), F.col("sig").alias("sx")), "x")
            .join(sigs.select(F.col("rep").alias("y"), F.col("sig").alias("sy")), "y")
            .filter(agreeing("sx", "sy") >= MATCHES).select("x", "y").distinct())
    both = (both.join(texts.select(F.col("rep").alias("x"), F.col("text").alias("tx")), "x")
            .join(texts.select(F.col("rep").alias("y"), F.col("text").alias("ty")), "y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.empty(0, dtype=np.uint64)  # rows of one y stand together after the join
        for batch in batches:
            xs, ys = [], []
            for x, y, tx, ty in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                right = ty.as_py()
                if right != last:
                    last, held = right, shingles(right, size)
                mine = shingles(tx.as_py(), size)
                same = len(np.intersect1d(mine, held, assume_unique=True))
                if 100 * same >= similarity * (len(mine) + len(held) - same) and same:
                    xs.append(x)
                    ys.append(y)
            yield pa.record_batch([pa.array(xs, pa.int64()), pa.array(ys, pa.int64())], names=["x", "y"])

    return both.select("x", "y", "tx", "ty").mapInArrow(check, "x long, y long").distinct()


def parity_sketches(texts: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """(rep, odd): for each of SKETCH_BITS shingle buckets whether the class holds an odd number, as longs.

    A shingle in just one of two sets flips one bit of the difference of their sketches, and two may
    only cancel out, so the differing bits never exceed the size of the symmetric difference."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = []
            for text in batch.column(1):
                at = (shingles(text.as_py(), size) * _PLACE[-1]) >> np.uint64(65 - SKETCH_BITS.bit_length())
                odd.append(np.packbits((np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64))
            yield pa.record_batch([batch.column(0), pa.array(odd, pa.list_(pa.int64()))], names=["rep", "odd"])

    return texts.join(reps, "rep", "left_semi").select("rep", "text").mapInArrow(make, "rep long, odd array<long>")


def components(links: DataFrame) -> DataFrame:
    """(rep, component) of every linked class: least label over links, with pointer jumps, until it stands."""
    edges = written(links.select(F.col("x").alias("u"), F.col("y").alias("w")).unionByName(links.select(F.col("y").alias("u"), F.col("x").alias("w"))), "edges")
    labels = written(edges.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("u").alias("w"), F.col("component").alias("other")), "w").groupBy("u").agg(F.min("other").alias("other"))
        step = labels.join(near, "u").select("u", "component", F.least("component", "other").alias("next"))
        hop = labels.select(F.col("u").alias("next"), F.col("component").alias("jump"))
        new = written(step.join(hop, "next", "left").select("u", F.coalesce(F.least("next", "jump"), "next").alias("component"),
                                                            F.col("component").alias("was")), "labels")
        labels = new.select("u", "component")
        if not new.filter("component <> was").limit(1).count():
            return labels.withColumnRenamed("u", "rep")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    ship(docs.sparkSession)
    feats = written(features(docs, size), "features")
    classes = written(feats.filter("n_shingles > 0").groupBy("digest", "sig", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_docs")), "classes")
    total = classes.count()
    named = classes.filter("rep IS NOT NULL")
    posted = written(prefixes(named.select("rep", "sig"), total), "prefixes")
    sigs = named.select("rep", "sig")
    texts = written(docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
                    .join(posted.select("rep").distinct(), "rep", "left_semi"), "texts")

    lists = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("a"),
                                      F.min_by("rep", F.xxhash64("rep", "key")).alias("b")).filter("n > 1")
    lists = written(lists, "lists")
    met = hot_join(posted, lists, ["key"], "n", total)
    star = met.select("rep", F.explode(F.array("a", "b")).alias("y")).filter("rep <> y").select(F.greatest("rep", "y").alias("x"), F.least("rep", "y").alias("y")).distinct()
    links = written(confirmed(star, sigs, texts, size, similarity), "links")
    merged = components(links)

    # lists that still hold several components: their members outside the list's main component meet all others
    placed = hot_join(posted, lists.select("key", "n"), ["key"], "n", total).join(merged, "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("component"))
    placed = written(placed, "placed")
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("key", "main")
    open_lists = written(placed.join(main, "key"), "open")
    open_reps = open_lists.select("rep").distinct()
    several = named.groupBy("rep").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("rep")  # one id with several texts: no bound
    odd = parity_sketches(texts, open_reps, size).join(several, "rep", "left_anti")
    sides = written(named.select("rep", "sig", "n_shingles").join(open_reps, "rep", "left_semi").join(odd, "rep", "left"), "sides")
    able = open_lists.join(sides, "rep")
    one = able.filter("component <> main").select("key", F.col("rep").alias("x"), F.col("component").alias("cx"), F.col("sig").alias("sx"), F.col("odd").alias("ox"), F.col("n_shingles").alias("nx"))
    two = able.select("key", F.col("rep").alias("y"), F.col("component").alias("cy"), F.col("sig").alias("sy"), F.col("odd").alias("oy"), F.col("n_shingles").alias("ny"),
                      (F.col("component") == F.col("main")).alias("in_main"))
    # |x & y| / |x | y| >= s means |x ^ y| <= (1 - s) / (1 + s) * (|x| + |y|)
    apart = sum(F.bit_count(F.get("ox", F.lit(k)).bitwiseXOR(F.get("oy", F.lit(k)))) for k in range(SKETCH_BITS // 64))
    possible = F.coalesce((100 + similarity) * apart <= (100 - similarity) * (F.col("nx") + F.col("ny")), F.lit(True))
    meets = (one["key"] == two["key"]) & (F.col("cx") != F.col("cy")) & (F.col("in_main") | (F.col("x") > F.col("y"))) & possible & (agreeing("sx", "sy") >= MATCHES)
    rest = one.join(two, meets).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()
    more = written(confirmed(rest, sigs, texts, size, similarity), "links")
    merged = components(links.unionByName(more))

    final = classes.join(merged, "rep", "left").select("digest", "n_docs", F.coalesce("component", "rep").alias("component_id"))
    whole = hot_join(feats.filter("n_shingles > 0").select("doc_id", "n_shingles", "digest"), final, ["digest"], "n_docs", total)
    alone = feats.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    out = ["doc_id", "n_shingles", "component_id"]
    return whole.select(*out).unionByName(alone.select(*out)).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
