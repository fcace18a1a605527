import random
import re
from itertools import combinations

import pytest

from panelcast.llm import neardup


def shingle_set(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)}


def brute(rows, size, similarity=80):
    sets = [shingle_set(t, size) for _, t in rows]
    at = {i: i for i in range(len(rows))}

    def find(a):
        while at[a] != a:
            a = at[a]
        return a

    for a, b in combinations(range(len(rows)), 2):
        same = len(sets[a] & sets[b])
        if same and 100 * same >= similarity * len(sets[a] | sets[b]):
            at[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=str)


def near_copies(rnd, n):
    base = [f"w{rnd.randint(0, 400)}" for _ in range(80)]
    for _ in range(n):
        words = list(base)
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 10**6)}"
        yield " ".join(words)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    texts = [t for _ in range(4) for t in near_copies(rnd, 25)]
    shared = " ".join(f"s{i}" for i in range(50))
    texts += [shared + " " + " ".join(f"y{rnd.randint(0, 10**6)}" for _ in range(k)) for k in (8, 9, 10, 30, 60) for _ in range(5)]
    texts += [texts[0]] * 30 + [texts[3].upper(), "a b", "A B", "a b c d", None, "", " \n ", "solo"]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n long")
    out = neardup.near_duplicates(docs, size=4).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str) == brute(rows, 4)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_nulls_repeated_rows_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "only null here now"), (None, None), (3, "q " * 3000), (4, "q " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs, size=4).collect()), key=str)
    assert out == sorted([(None, 7, False), (7, 7, True), (7, 7, True), (None, None, False), (None, None, False), (3, 3, True), (4, 3, False)], key=str)
    assert not neardup.near_duplicates(docs.limit(0)).collect()


def test_registered_query_equals_brute_force(spark):
    from panelcast.llm.queries import op10_minhash_near_dedup

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    out = op10_minhash_near_dedup(spark, "/root/testdata/sf0.001").collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str) == brute(rows, 4)
