"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

A piece has a length of 1 to ``capacity`` tokens, so the whole instance is a histogram of at most
``capacity`` rows, whatever the corpus size. The reduction and the best-fit pass run on that
histogram (equal lengths in bulk) and yield a bounded list of bin patterns with multiplicities;
Spark then gives every piece its rank among the pieces of its length and reads its bin off the plan.

Defined cases: null and empty texts are one end token; equal or repeated documents are packed once
per row; a null doc_id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import rank_within, ship, written

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
#: Distinct words a worker remembers with their ids; beyond it the memory is emptied and filled again.
CACHE_WORDS = 1_000_000

PIECES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()),
                       T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                       T.StructField("ids_crc32", T.LongType())])


class WordTokenizer:
    """Token ids of a text as little-endian uint32 bytes, the same as the tokenizer's own encode.

    White space separates tokens in this vocabulary, so ids are looked up word by word and each
    distinct word is encoded once per worker. The strings of added tokens are cut out first and have their own ids.
    """

    _loaded: dict[str, "WordTokenizer"] = {}

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = {t: np.asarray([i], dtype="<u4").tobytes() for t, i in added.items()}
        self.at_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.model = self.tokenizer.model
        # fixed value: the vocabulary's own split pattern
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.separator = regex.compile("[\x1c-\x1f]")
        self.space = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level alphabet: printable bytes stand for themselves
        hidden = [b for b in range(256) if b not in shown]
        self.letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.words: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str | None) -> "WordTokenizer":
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _encode(self, word: str) -> bytes:
        if max(word) < "ɐ":  # below the combining marks: lower case and NFC act letter by letter
            ids: list[int] = []
            for part in self.split.findall(word.lower()):
                ids += [t.id for t in self.model.tokenize("".join([self.letter[b] for b in part.encode()]))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return np.asarray(ids, dtype="<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if any([t in text for t in self.added]):
            return b"".join([self.added[part] if part in self.added else self.ids(part) for part in self.at_added.split(text)])
        lowered = text.lower() if not text or max(text) < "ɐ" else text
        words = lowered.split()
        if self.separator.search(lowered):  # white space to str.split, but not to the tokenizer
            words = [w for w in self.space.split(lowered) if w]
        known = self.words
        if len(known) > CACHE_WORDS:
            known.clear()
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = self._encode(w)
            return b"".join([known[w] for w in words])


def tokenised_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, ids_crc32). Only longer documents are cut."""
    ship(docs.sparkSession)
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = WordTokenizer.load(tokenizer_path)
        step = 4 * capacity
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tok.ids(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    for column, value in zip(out, (doc, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()),
                                   pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())], names=PIECES.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


Pattern = tuple[int, list[tuple[int, int]]]


def dominance_reduction(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """Martello-Toth reduction on a histogram of lengths: (fixed bins, what is left).

    From the longest length down, w with free room r = capacity - w is fixed
    - alone, if nothing else fits beside it;
    - with the longest fitting length v, if v = r, if no two others fit together, or if no three do
      and no fitting pair is longer than v: any other content of that bin can swap places with v.
    Fixing removes items only, so a condition that holds once holds for all equal pairs.
    """
    left = {w: n for w, n in counts.items() if n > 0}
    sizes = sorted(left)
    fixed: list[Pattern] = []

    def take(w: int, n: int) -> None:
        left[w] -= n
        if not left[w]:
            del left[w]
            sizes.pop(bisect_left(sizes, w))

    def smallest(k: int, w: int) -> list[int]:
        out: list[int] = []
        for s in sizes:
            out += [s] * min(k, left[s] - (s == w))
            if len(out) >= k:
                break
        return out[:k]

    def best_pair(room: int, w: int) -> int:
        lo, hi, best = 0, len(sizes) - 1, 0
        while lo <= hi:
            a, b = sizes[lo], sizes[hi]
            if a + b > room or left[b] == (b == w):
                hi -= 1
                continue
            if left[a] - (a == w) >= 1 + (a == b):
                best = max(best, a + b)
            lo += 1
        return best

    for w in sorted(left, reverse=True):
        while w in left:
            room = capacity - w
            k = bisect_left(sizes, room + 1) - 1
            while k >= 0 and left[sizes[k]] - (sizes[k] == w) < 1:
                k -= 1
            if k < 0:
                fixed.append((left[w], [(w, 1)]))
                take(w, left[w])
                continue
            v = sizes[k]
            few = smallest(3, w)
            if not (v == room or sum(few[:2]) > room or len(few) < 2 or ((len(few) < 3 or sum(few) > room) and best_pair(room, w) <= v)):
                break
            n = left[w] // 2 if v == w else min(left[w], left[v])
            fixed.append((n, [(w, 2)] if v == w else [(w, 1), (v, 1)]))
            take(w, 2 * n if v == w else n)
            if v != w:
                take(v, n)
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram: each length goes to the fullest bins that take it, in bulk."""
    open_bins: dict[int, list[list]] = {}  # free room -> [multiplicity, content]
    rooms: list[int] = []

    def put(room: int, n: int, content: list[tuple[int, int]]) -> None:
        if n:
            if room not in open_bins:
                open_bins[room] = []
                insort(rooms, room)
            open_bins[room].append([n, content])

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            at = bisect_left(rooms, w)
            room = rooms[at] if at < len(rooms) else capacity
            each = room // w
            if at < len(rooms):
                m, content = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(at)
            else:
                m, content = -(-n // each), []
            whole = min(m, n // each)
            put(room - each * w, whole, [*content, (w, each)])
            n -= whole * each
            if whole < m and 0 < n < each:
                put(room - n * w, 1, [*content, (w, n)])
                n, m = 0, m - 1
            put(room, m - whole, content)
    return [(m, content) for room in open_bins for m, content in open_bins[room]]


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, left = dominance_reduction(counts, capacity)
    return fixed + best_fit(left, capacity)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add (sequence_id, offset) to pieces with a ``length`` of 1 to ``capacity``."""
    ship(pieces.sparkSession)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    keys, firsts, each, bases, offsets = [], [], [], [], []
    given: dict[int, int] = {}
    base = 0
    for m, content in plan_bins(counts, capacity):
        offset = 0
        for w, k in content:
            keys.append((w << 48) + given.get(w, 0))
            firsts.append(given.get(w, 0))
            each.append(k)
            bases.append(base)
            offsets.append(offset)
            given[w] = given.get(w, 0) + m * k
            offset += w * k
        base += m
    order = np.argsort(np.asarray(keys, dtype=np.int64), kind="stable")
    key, first, per, seq, off = (np.asarray(x, dtype=np.int64)[order] for x in (keys, firsts, each, bases, offsets))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        w, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted(key, (w << 48) + r, side="right") - 1
        inner = r - first[at]
        return pd.DataFrame({"sequence_id": seq[at] + inner // per[at], "offset": off[at] + inner % per[at] * w})

    ranked = rank_within(pieces, "length", [F.col("doc_id"), F.col("piece")], [F.col("doc_id"), F.col("piece")], sum(counts.values()), "__rank")
    return ranked.withColumn("__at", place("length", "__rank")).select(
        *pieces.columns, F.col("__at.sequence_id").alias("sequence_id"), F.col("__at.offset").alias("offset"))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """Tokenise, cut and pack: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    The pieces (a few numbers each) are written once, so texts are tokenised once."""
    return pack(written(tokenised_pieces(docs, capacity, tokenizer_path), "pieces"), capacity)
