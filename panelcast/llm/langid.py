"""Language identification by nearest clustered centroids of normalised TF-IDF n-gram vectors.

Document frequencies come from every training document. The centroids of a language are spherical
k-means clusters of at most ``SAMPLE_PER_LANG`` of its documents (chosen by a hash of the id). A text
gets the language of the nearest centroid by cosine, and is rejected when even that one is farther
than nearly all short snippets of the language's own sample (a short text has few n-grams, and so a
low cosine, without being foreign).

Defined cases: a null text or one without letters is ``und`` with score 0 and rejected; a text of any
length is read whole; rows without a language or doc_id teach nothing; repeated rows are predicted
alike; ties take the alphabetically first language; without training rows all texts are ``und``; an
empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import ship

UND = "und"
DIMS = 1 << 13
CLUSTERS = 4
SAMPLE_PER_LANG = 400          # bound of the clustering sample
ROUNDS = 12
#: Rejection: this quantile of the own-language cosines of the sample's snippets, times the slack.
REJECT_QUANTILE, REJECT_SLACK, SNIPPET = 0.005, 0.6, 64
CHUNK = 1 << 20
LETTER = regex.compile(r"\p{L}")
_ONLY_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def ngram_counts(text: str) -> np.ndarray:
    """Hashed counts of byte bi- and trigrams of the lower-cased letters."""
    data = b" " + text.lower().encode().translate(_ONLY_LETTERS) + b" "
    out = np.zeros(DIMS, dtype=np.int64)
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    for at in range(0, len(data), CHUNK):
        a = np.frombuffer(data[at:at + CHUNK + 2], dtype=np.uint8).astype(np.uint32)
        two = (a[:-1] << np.uint32(8)) | a[1:]
        three = (two[:-1] << np.uint32(8)) | a[2:]
        two, three = two[:CHUNK][two[:CHUNK] != 0x2020], three[three != 0x202020]
        grams = np.concatenate([(two * np.uint32(2246822519)) >> shift, (three * np.uint32(2654435761)) >> shift])
        out += np.bincount(grams, minlength=DIMS)
    return out


def vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (np.log1p(counts) * idf).astype(np.float32)
    norm = float(np.sqrt((v * v).sum()))
    return v / norm if norm else v


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids; starts at the mean's nearest row, then at the rows farthest from the chosen ones."""
    picked = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(picked) < min(k, len(x)):
        picked.append(int(np.argmin((x @ x[picked].T).max(axis=1))))
    c = x[picked]
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


@dataclass
class Model:
    langs: list[str]           # of each centroid
    centroids: np.ndarray      # (centroids, DIMS)
    floors: np.ndarray         # rejection cosine of each centroid's language
    idf: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not LETTER.search(text):
            return UND, 0.0, True
        near = self.centroids @ vector(ngram_counts(text), self.idf)
        best = int(near.argmax())
        score = float(min(max(near[best], 0.0), 1.0))
        return self.langs[best], score, score < self.floors[best]


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32 of the id's text leaves 1 modulo 3; never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """Learn from ``text`` and non-null ``lang`` of the rows given (doc_id only orders the sample)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, langs = np.zeros(DIMS, dtype=np.int64), {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist()):
                df += ngram_counts(text.as_py()) > 0
                langs[lang] = langs.get(lang, 0) + 1
        at = np.nonzero(df)[0]
        yield pa.record_batch([pa.array(at, pa.int32()), pa.nulls(len(at), pa.string()), pa.array(df[at], pa.int64())], names=["dim", "lang", "n"])
        yield pa.record_batch([pa.nulls(len(langs), pa.int32()), pa.array(list(langs), pa.string()), pa.array(list(langs.values()), pa.int64())], names=["dim", "lang", "n"])

    # at most DIMS rows and one per language reach the driver
    seen = rows.select("text", "lang").mapInArrow(frequencies, "dim int, lang string, n long").groupBy("dim", "lang").agg(F.sum("n").alias("n")).collect()
    per_lang = {r["lang"]: r["n"] for r in seen if r["lang"] is not None}
    total = sum(per_lang.values())
    idf = np.log((1 + total) / (1 + np.zeros(DIMS)))
    for r in seen:
        if r["dim"] is not None:
            idf[r["dim"]] = np.log((1 + total) / (1 + r["n"])) + 0.05
    idf = idf.astype(np.float32)
    if not per_lang:
        return Model([], np.zeros((0, DIMS), np.float32), np.zeros(0), idf)

    share = F.create_map(*[F.lit(v) for lang, n in sorted(per_lang.items()) for v in (lang, min(1.0, 2 * SAMPLE_PER_LANG / n))])
    order = F.xxhash64(F.col("doc_id").cast("string"))
    sample = rows.filter(F.pmod(order, F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20)).withColumn("at", order)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, parts = [], []
            for t in b.column(0):
                text = t.as_py()
                mid = max(0, (len(text) - SNIPPET) // 2)
                whole.append(vector(ngram_counts(text), idf).tobytes())
                parts.append(vector(ngram_counts(text[mid:mid + SNIPPET]), idf).tobytes())
            yield pa.record_batch([b.column(1), b.column(2), pa.array(whole, pa.binary()), pa.array(parts, pa.binary())], names=["lang", "at", "v", "snippet"])

    def cluster(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["at", "v"]).head(SAMPLE_PER_LANG)
        x = np.stack([np.frombuffer(v, dtype=np.float32) for v in group["v"]])
        c = spherical_kmeans(x, CLUSTERS)
        parts = np.stack([np.frombuffer(v, dtype=np.float32) for v in group["snippet"]])
        near = (parts[parts.any(axis=1)] @ c.T).max(axis=1)
        floor = float(np.quantile(near, REJECT_QUANTILE)) * REJECT_SLACK if len(near) else 0.0
        return pd.DataFrame({"lang": group["lang"].iloc[0], "c": [row.tobytes() for row in c], "floor": floor})

    found = (sample.select("text", "lang", "at").mapInArrow(vectors, "lang string, at long, v binary, snippet binary")
             .groupBy("lang").applyInPandas(cluster, "lang string, c binary, floor double").collect())  # CLUSTERS rows a language
    found.sort(key=lambda r: (r["lang"], bytes(r["c"])))
    return Model([r["lang"] for r in found], np.stack([np.frombuffer(r["c"], dtype=np.float32) for r in found]),
                 np.array([r["floor"] for r in found]), idf)


def predictor(model: Model):
    """A pandas UDF: text -> (lang_pred, score, rejected)."""
    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t if isinstance(t, str) else None) for t in text], columns=["lang_pred", "score", "rejected"])

    return predict


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every document, learned from those not held out."""
    model = fit(docs.filter(~held_out(F.col("doc_id"))))
    p = F.col("p")
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predictor(model)(F.col("text").cast("string")).alias("p")).select(
        "doc_id", "held_out", p["lang_pred"].alias("lang_pred"), p["score"].alias("score"), p["rejected"].alias("rejected"))
