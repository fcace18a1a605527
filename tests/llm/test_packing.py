import random
import zlib

import numpy as np
import pytest

from panelcast.llm import packing


def item_best_fit(items, capacity):
    rooms = []
    for w in sorted(items, reverse=True):
        fits = [r for r in rooms if r >= w]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else capacity) - w)
    return len(rooms)


def least_bins(items, capacity):
    """Brute force over set partitions of a few items."""
    best = len(items)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= items[k]:
                rooms[i] -= items[k]
                go(k + 1, rooms)
                rooms[i] += items[k]
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best


def histogram(items):
    counts = {}
    for w in items:
        counts[w] = counts.get(w, 0) + 1
    return counts


@pytest.mark.parametrize("seed", range(40))
def test_plan_packs_every_piece_and_bulk_best_fit_equals_item_best_fit(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 20, 64])
    items = [rnd.randint(1, capacity) for _ in range(rnd.randint(0, 80))]
    plan = packing.plan_bins(histogram(items), capacity)
    got = {}
    for m, content in plan:
        assert m > 0 and 0 < sum(w * k for w, k in content) <= capacity
        for w, k in content:
            got[w] = got.get(w, 0) + m * k
    assert got == histogram(items)
    assert sum(m for m, _ in packing.best_fit(histogram(items), capacity)) == item_best_fit(items, capacity)


@pytest.mark.parametrize("seed", range(60))
def test_fixed_sets_are_part_of_an_optimum(seed):
    rnd = random.Random(100 + seed)
    items = [rnd.randint(2, 12) for _ in range(9)]
    fixed, left = packing.dominance_reduction(histogram(items), 12)
    rest = [w for w, n in left.items() for _ in range(n)]
    assert sum(m for m, _ in fixed) + (least_bins(rest, 12) if rest else 0) == least_bins(items, 12)


def test_word_ids_equal_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    tok = packing.WordTokenizer.load(None)
    for text in ["", " ", "Hello, World!! 123 it's", "É́tude  naïve\tcafé ΑΣ ß İ ﬁ 漢字かな 🙂🙂 à", "tab\x0bx y z\x1cq", "<|endoftext|> it'll  don't", "UPPER İstanbul 🙂 Ünder"]:
        want = np.asarray(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert tok.ids(text) == want, text


def test_documents_are_cut_packed_and_gapless(spark):
    rows = [(1, "one two three", "x"), (2, None, "x"), (3, "", None), (4, "word " * 45, "x"), (4, "word " * 45, "x"), (None, "free", "x"), (5, "a b " * 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    out = packing.pack_documents(docs, capacity=16).toPandas()
    assert set(out.columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert len(out[out.doc_id == 4]) == 6 and out.doc_id.isna().sum() == 1
    assert (out.start == out.piece * 16).all()
    assert out[out.doc_id.isin([2, 3])].ids_crc32.tolist() == [zlib.crc32(b"\0\0\0\0")] * 2
    for _, seq in out.sort_values("offset").groupby("sequence_id"):
        assert (seq.offset == seq.length.cumsum() - seq.length).all() and seq.length.sum() <= 16
    assert out.sequence_id.nunique() >= -(-out.length.sum() // 16)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_registered_query_packs_near_the_lower_bound(spark):
    from panelcast.llm.queries import op2_best_fit_packing

    out = op2_best_fit_packing(spark, "/root/testdata/sf0.001").toPandas()
    assert out.doc_id.nunique() == 200
    assert out.sequence_id.nunique() <= -(-out.length.sum() // packing.CAPACITY) + 1


def test_strings_of_added_tokens_have_their_ids():
    tok = packing.WordTokenizer.load(None)
    from tokenizers import Tokenizer
    import public_tokenizers
    whole = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    for text in ("hello <|endoftext|> x", "a<|EndOfText|>b", "A<|startoftext|>b <|endoftext|><|endoftext|>", "<|endoftext|>"):
        assert np.frombuffer(tok.ids(text), dtype="<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
