"""Benchmark decontamination on template windows with a slot check.

Words are canonicalised: numbers, units after a number and names (title case inside a sentence)
become typed placeholders, the rest is stripped of outer punctuation and lower-cased. Windows of
five canonical words are hash-joined with the benchmark's windows. Hits on one diagonal (document
position minus item position) are one occurrence; it counts if its slots are consistent, that is if
equal item values meet equal document values. A document leaks an item when consistent occurrences
cover enough of the words in the item's windows, so questions with new numbers or names are caught
as well. Equal words within a window's length beside a hit are covered too, so that an edited word
counts once, not in each window around it.

Windows with fewer than three plain words carry no template. Each item therefore has a second,
case-blind set of windows: names are plain words there, and windows still under three plain words
are taken word by word, as is an item of two to four words as a whole.
The better coverage of both sets counts, so exact copies match in any case and with any slots.

Defined cases: null and empty texts or items, and items of one word, match nothing; repeated rows
and items count once; one item_id with several texts leaks through any of them; a null doc_id is reported as null;
empty tables give an empty result; texts are read whole; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import ship, written

WINDOW = 5
NEAR = 3 * WINDOW
MIN_PLAIN = 3
MIN_COVERAGE = 0.8
MIN_CONSISTENCY = 0.8
#: Distinct benchmark windows (8 bytes each) up to which tasks filter their own windows; beyond it they shuffle.
BROADCAST_WINDOWS = 2_000_000
CACHE_WORDS = 1_000_000
# fixed values: unit words
UNITS = ("% percent mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds ounce ounces "
         "ml l litre litres liter liters gallon gallons second seconds sec minute minutes min hour hours hr day days week weeks month months year years "
         "dollar dollars cent cents euro euros usd eur $ € £ degree degrees celsius fahrenheit kelvin volt volts watt watts joule joules hz khz mhz "
         "ghz mph kmh byte bytes kb mb gb tb").split()
_TITLE, _ENDS, _NUMBER, _UNIT = 1, 2, 4, 8
_FLAGS = np.uint64(15)
_NUM_ID, _UNIT_ID, _NAME_ID = (np.uint64(16 * k) for k in (1, 2, 3))
_CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
_PLACE = np.random.default_rng(77).integers(0, 1 << 62, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _PLACE[::-1] * np.uint64(3)   # keeps the sizes under WINDOW apart
_UNIT_SET = frozenset(UNITS)


class Words(dict):
    """Token -> 60-bit id of its canonical form and four flags, remembered per worker; id 0: punctuation."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        m = _CORE.search(token)
        core = m[0] if m else ""
        lower = core.lower()
        code = xxhash.xxh64_intdigest(lower or token) & ~15 if core or token in _UNIT_SET else 0
        if core and core[0].isdigit():
            code |= _NUMBER
        if lower in _UNIT_SET or token in _UNIT_SET:
            code |= _UNIT
        if len(core) > 1 and core[0].isupper() and core[1:].islower():
            code |= _TITLE
        if not token[-1].isalnum():
            code |= _ENDS
        self[token] = code
        return code


_WORDS = Words()


class Windows(NamedTuple):
    """Windows of a text in order of position; a slot value is 0 where the word stands for itself."""
    pos: np.ndarray
    h: np.ndarray
    slots: np.ndarray          # (windows, WINDOW)


def _hashed(form: np.ndarray, size: int) -> np.ndarray:
    n = len(form) - size + 1
    h = form[:n] * _PLACE[0]
    for k in range(1, size):
        h += form[k:k + n] * _PLACE[k]
    if size < WINDOW:
        h += _SHORT[size]
    h ^= h >> np.uint64(31)
    return h


def _plain(slot: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(slot == 0, WINDOW).sum(axis=1, dtype=np.int8)


def text_windows(text: str | None, short: Iterable[int] = ()) -> tuple[Windows, Windows, np.ndarray, list[Windows], np.ndarray]:
    """Template windows, case-blind windows, where the latter differ from the former (by position), windows of
    the ``short`` sizes, and the case-blind words."""
    tokens = (text or "").replace("\n", " . ").split()
    codes = np.fromiter(map(_WORDS.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    ends = (codes & np.uint64(_ENDS)) > 0
    start = np.ones(len(codes), dtype=bool)
    start[1:] = ends[:-1]
    words = (codes >> np.uint64(4)) > 0
    codes, start = codes[words], start[words]
    value = codes & ~_FLAGS
    fewer = []
    for size in short:
        n = max(0, len(codes) - size + 1)
        fewer.append(Windows(np.arange(n), _hashed(value, size) if n else value[:0], np.zeros((n, WINDOW), dtype=np.uint64)))
    none = Windows(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64), np.empty((0, WINDOW), dtype=np.uint64))
    if len(codes) < WINDOW:
        return none, none, np.empty(0, dtype=bool), fewer, value
    number = (codes & np.uint64(_NUMBER)) > 0
    unit = np.zeros(len(codes), dtype=bool)
    unit[1:] = number[:-1] & ((codes[1:] & np.uint64(_UNIT)) > 0)
    name = ~number & ~unit & ~start & ((codes & np.uint64(_TITLE)) > 0)
    typed = number | unit
    form = value.copy()
    form[number], form[unit] = _NUM_ID, _UNIT_ID
    slot = np.where(typed, value, np.uint64(0))
    # case-blind: numbers and units are typed where three plain words are left, otherwise all words are exact
    views = np.lib.stride_tricks.sliding_window_view
    h, slots = _hashed(form, WINDOW), views(slot, WINDOW)
    exact = _plain(slot) < MIN_PLAIN
    differs = exact
    if exact.any():
        h, slots = np.where(exact, _hashed(value, WINDOW), h), np.where(exact[:, None], np.uint64(0), slots)
    blind = Windows(np.arange(len(h)), h, slots)
    if not name.any():
        at = np.nonzero(~exact)[0]
        return Windows(at, h[at], slots[at]), blind, differs, fewer, value
    form[name] = _NAME_ID
    slot = np.where(name, value, slot)
    at = np.nonzero(_plain(slot) >= MIN_PLAIN)[0]
    differs = exact | views(name, WINDOW).any(axis=1)
    return Windows(at, _hashed(form, WINDOW)[at], views(slot, WINDOW)[at]), blind, differs, fewer, value


def _near(words: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """The words from WINDOW before each position to 2 * WINDOW - 1 behind it, 0 beyond the text."""
    padded = np.concatenate([np.zeros(WINDOW, dtype=np.uint64), words, np.zeros(2 * WINDOW, dtype=np.uint64)])
    return np.lib.stride_tricks.sliding_window_view(padded, NEAR)[pos]


def _list(parts: list[np.ndarray], size: int) -> pa.Array:
    flat = np.concatenate([np.ascontiguousarray(x).view(np.int64).reshape(-1) for x in parts])
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, size), pa.int32()), pa.array(flat))


def _batch(ids: list[pa.Array], keep: list[np.ndarray], parts: list[Windows], near: list[np.ndarray], more: dict[str, list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    rows_at = pa.array(np.concatenate(keep))
    return pa.record_batch([*(x.take(rows_at) for x in ids), pa.array(np.concatenate([w.pos for w in parts])), pa.array(np.concatenate([w.h.view(np.int64) for w in parts])),
                            _list([w.slots for w in parts], WINDOW), _list(near, NEAR), *(pa.array(np.concatenate(x)) for x in more.values())],
                           names=[*names, "pos", "h", "slots", "near", *more])


def _item_windows(items: DataFrame) -> DataFrame:
    """Rows (item_id, variant, pos, h, slots, near, kind, size, n_windows, n_words): kind 0 by template, 1 case-blind."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, parts, near = [], [], []
            more: dict[str, list[np.ndarray]] = {"kind": [], "size": [], "n_windows": [], "n_words": []}
            for row, text in enumerate(batch.column(2)):
                templates, blind, differs, fewer, words = text_windows(text.as_py(), range(2, WINDOW))
                n = len(words)
                sets = [(0, WINDOW, templates)] + ([(1, WINDOW, blind)] if differs.any() else []) if n >= WINDOW else [(1, n, fewer[n - 2])] if n >= 2 else []
                for kind, size, w in sets:
                    covered = np.zeros(n, dtype=bool)
                    for k in range(size):
                        covered[w.pos + k] = True
                    keep.append(np.full(len(w.pos), row, dtype=np.int64))
                    parts.append(w)
                    near.append(_near(np.where(covered, words, np.uint64(0)), w.pos))
                    for c, v in zip(more, (kind, size, len(w.pos), int(covered.sum()))):
                        more[c].append(np.full(len(w.pos), v, dtype=np.int64))
            if keep:
                yield _batch([batch.column(0), batch.column(1)], keep, parts, near, more, ["item_id", "variant"])

    return items.select("item_id", "variant", "text").mapInArrow(
        make, "item_id long, variant long, pos long, h long, slots array<long>, near array<long>, kind long, size long, n_windows long, n_words long")


def _windows(rows: DataFrame, wanted: np.ndarray | None, short: list[int]) -> DataFrame:
    """Rows (doc_id, doc_key, pos, h, slots, near) of the windows of ``text``; only the sorted hashes ``wanted``, if given."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, parts, near = [], [], []
            for row, text in enumerate(batch.column(2)):
                templates, blind, differs, fewer, words = text_windows(text.as_py(), short)
                for w in (templates, Windows(*(x[differs] for x in blind)) if differs.any() else None, *fewer):
                    if w is None:
                        continue
                    if wanted is not None and len(w.h):
                        h = w.h.view(np.int64)
                        at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                        hit = wanted[at] == h if len(wanted) else np.zeros(len(h), dtype=bool)
                        if not hit.any():
                            continue
                        w = Windows(*(x[hit] for x in w))
                    keep.append(np.full(len(w.pos), row, dtype=np.int64))
                    parts.append(w)
                    near.append(_near(words, w.pos))
            if keep:
                yield _batch([batch.column(0), batch.column(1)], keep, parts, near, {}, ["doc_id", "doc_key"])

    return rows.select("doc_id", "doc_key", "text").mapInArrow(make, "doc_id long, doc_key long, pos long, h long, slots array<long>, near array<long>")


def leaks(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, coverage, reparameterised) of every leaked item; coverage is by words.

    A document is an id with its text: rows of one id, or of none, that hold different texts are judged apart.
    """
    return _leaks(docs, benchmark, broadcast_windows).drop("doc_key")


def _leaks(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """``leaks`` with the key of the document's text."""
    ship(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    items = items.withColumn("variant", F.xxhash64("text"))
    known = written(_item_windows(items), "templates").withColumnsRenamed({"pos": "item_pos", "slots": "item_slots", "near": "item_near"})
    short = sorted(r["size"] for r in known.filter(F.col("size") < WINDOW).select("size").distinct().collect())  # at most three sizes
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("doc_key"), F.col("text").cast("string").alias("text"))
    distinct = known.select("h").distinct()
    if distinct.count() <= broadcast_windows:  # the bound is checked before anything is sent to the tasks
        wanted = np.sort(np.array([r["h"] for r in distinct.collect()], dtype=np.int64))
        hits = _windows(rows, wanted, short)
        # the templates of a checked number of windows; a row more for each item that shares a window
        met = hits.join(F.broadcast(known) if known.count() <= 2 * broadcast_windows else known, "h")
    else:
        met = _windows(rows, None, short).join(known, "h")

    pairs = F.filter(F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"] != 0)
    item = ["item_id", "variant", "kind", "size", "n_windows", "n_words"]
    # the words of the window itself, and those around it that are equal
    same = F.zip_with("item_near", "near", lambda a, b: (a == b) & (a != 0))
    words = F.filter(F.transform(same, lambda x, k: F.when(x | k.between(WINDOW, WINDOW + F.col("size") - 1), (F.col("item_pos") + k - WINDOW).cast("int"))), lambda x: x.isNotNull())
    one = met.withColumn("words", words).groupBy("doc_id", "doc_key", *item, (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(
        F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_set("words"))).alias("words"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
    values = F.size(F.array_distinct(F.transform("pairs", lambda x: x["a"])))
    consistent = one.filter(values >= MIN_CONSISTENCY * F.size("pairs"))
    found = consistent.groupBy("doc_id", "doc_key", *item).agg(
        F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.size(F.array_distinct(F.flatten(F.collect_set("words")))).alias("n"), F.max(F.exists("pairs", lambda x: x["a"] != x["b"])).alias("reparameterised"))
    found = found.withColumn("n_matched", F.size("at").cast("long")).withColumn("coverage", F.col("n") / F.col("n_words")).filter(F.col("coverage") >= MIN_COVERAGE)
    best = F.max_by(F.struct("n_windows", "n_matched", "coverage", "reparameterised"), F.struct("coverage", -F.col("kind"), "variant"))
    return found.groupBy("doc_id", "doc_key", "item_id").agg(best.alias("b")).select(
        "doc_id", "doc_key", "item_id", "b.n_windows", "b.n_matched", "b.coverage", "b.reparameterised")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with all their columns."""
    found = _leaks(docs, benchmark).select(F.col("doc_id").alias("__leaked_id"), F.col("doc_key").alias("__leaked_key")).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__leaked_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__leaked_key"))
    return docs.join(found, same, "left_anti")
