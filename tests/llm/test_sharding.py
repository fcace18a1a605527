import random
import zlib

import pytest

from panelcast.llm import sharding


@pytest.mark.parametrize("k", [2, 3, 16])
def test_differencing_assigns_each_sum_once_and_beats_greedy(k):
    rnd = random.Random(k)
    weights = [rnd.randint(1, 10**6) for _ in range(400)]
    parts = sharding.differencing([[w] for w in weights], k)
    sums, greedy = [0] * k, [0] * k
    for w, p in zip(weights, parts):
        assert sorted(p) == list(range(k))
        sums[p[0]] += w
    for w in sorted(weights, reverse=True):
        greedy[greedy.index(min(greedy))] += w
    assert max(sums) - min(sums) <= max(greedy) - min(greedy)
    assert sharding.differencing([], k) == []


def test_tuples_are_combined_in_opposite_order():
    parts = sharding.differencing([[9, 1, 0], [0, 8, 2]], 3)
    sums = [0, 0, 0]
    for p, values in zip(parts, [[9, 1, 0], [0, 8, 2]]):
        for to, v in zip(p, values):
            sums[to] += v
    assert sorted(sums) == [3, 8, 9]


@pytest.mark.parametrize("small", [False, True])
def test_documents_are_placed_whole_even_and_gapless(spark, monkeypatch, small):
    if small:  # several blocks and super-blocks, few single groups
        for name, value in (("BLOCK", 20), ("SUPER_BLOCKS", 3), ("HEAVY", 64), ("RESERVE", 20)):
            monkeypatch.setattr(sharding, name, value)
    rnd = random.Random(5)
    texts = ["é" * rnd.randint(0, 300) + str(i) for i in range(300)] + ["copy of a text"] * 40 + [None, "", None]
    docs = spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)] + [(0, texts[0], 3), (None, "x", 3)], "doc_id long, text string, shard long")
    out = sharding.shard_documents(docs).toPandas()
    assert len(out) == len(texts) + 2
    for r in out.dropna().itertuples():
        data = (texts[int(r.doc_id)] or "").encode()
        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
    sums = out.groupby("shard")["size"].sum()
    assert len(sums) == 16 and sums.max() - sums.min() <= (600 if small else 40)
    assert out.groupby("text_crc32").shard.nunique().max() == 1
    assert all(sorted(s) == list(range(len(s))) for _, s in out.groupby("shard").slot)


def test_a_group_beyond_a_shard_is_split_and_empty_table(spark):
    docs = spark.createDataFrame([(i, "the same long text " * 3) for i in range(400)] + [(1000 + i, f"t{i}") for i in range(50)], "doc_id long, text string")
    out = sharding.shard_documents(docs).toPandas()
    sums = out.groupby("shard")["size"].sum()
    assert sums.max() < 1.25 * sums.mean() and len(out) == 450
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_registered_query_is_even(spark):
    from panelcast.llm.queries import op6_karmarkar_karp_sharding

    out = op6_karmarkar_karp_sharding(spark, "/root/testdata/sf0.01").toPandas()
    sums = out.groupby("shard")["size"].sum()
    assert len(out) == 1000 and sums.max() - sums.min() <= 16 and set(out.law) == {"bytes"} and out.grown_shard.isna().all()
