import numpy as np
import pytest

from panelcast.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, scale=256, every=50):
    kept = {}
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        kept[vec_id, label, tuple(int(np.floor(scale * float(np.float32(x)))) for x in vector)] = 1
    out = []
    for a in kept:
        if a[0] % every:
            continue
        score = lambda r: sum(x * y for x, y in zip(a[2], r[2]))  # noqa: B023, E731
        ranked = sorted((r for r in kept if r != a), key=lambda r: (-score(r), r[0]))  # noqa: B023
        for p in [r for r in ranked if r[1] == a[1]][:5]:
            fit = [r for r in ranked if r[1] != a[1] and 50 * score(p) <= 100 * score(r) <= 95 * score(p)][:3]
            out += [(a[0], p[0], k + 1, r[0], score(p), score(r)) for k, r in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, **more):
    got = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), **more)
    return sorted(tuple(r) for r in got.select(*COLUMNS).collect())


def vectors(seed, n, width, spread, labels):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, width))
    label = rng.integers(0, labels, n)
    x = centres[label] * rng.uniform(0.2, 1, n)[:, None] + spread * rng.normal(size=(n, width))
    x *= rng.lognormal(sigma=0.7, size=n)[:, None]
    return [(i, [float(v) for v in x[i]], int(label[i])) for i in range(n)]


@pytest.mark.parametrize("seed, width, spread", [(1, 6, 0.2), (2, 12, 0.8), (3, 2, 0.3)])
def test_small_blocks_equal_all_pairs(spark, monkeypatch, seed, width, spread):
    monkeypatch.setattr(negatives, "BLOCK", 60)
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    rows = vectors(seed, 500, width, spread, 4)
    want = brute(rows, every=20)
    assert len(want) > 50
    assert mined(spark, rows, every=20) == want


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [0.9, 0.1], 1), (2, [0.9, 0.1], 1), (3, [0.8, 0.0], 2), (4, [0.8, 0.0], 2), (5, [0.8], 3), (6, [0.8, 0.0], 2),
            (7, [9.0, None], 2), (8, [nan, 1.0], 1), (9, [inf, 1.0], 2), (10, None, 1), (11, [1.0, 1.0], None), (None, [1.0, 1.0], 1),
            (1, [0.9, 0.1], 1), (50, [0.0, 0.0], 2), (51, [], 1), (100, [-1.0, 0.0], 1), (3, [0.7, 0.0], 2)]
    got = mined(spark, rows)
    assert got == brute(rows)
    assert [r[3] for r in got if r[:2] == (0, 1)] == [3, 4, 5]  # ties go by id, a short vector is filled up with zeros
    clash = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{SCHEMA}, score int, part string")
    assert negatives.hard_negatives(clash).count() == len(got)


def test_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1)]) == []
    assert mined(spark, [(50, None, 1)]) == []


def test_equal_vectors_and_one_label(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 40)
    rows = [(i, [0.5, 0.25], 0) for i in range(300)] + [(300 + i, [0.4, 0.3 - i / 1000], 1) for i in range(60)]
    assert mined(spark, rows) == brute(rows)


def test_feasible_ranges_lose_nothing_and_prune():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 5))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None] * rng.lognormal(sigma=0.02, size=(4000, 1)))
    bucket = negatives.Bucket(np.arange(4000), np.arange(4000), np.zeros(4000, dtype=int), x, np.linalg.norm(x, axis=1))
    pruned = 0
    for a in x[:40] * 2:
        scores = (x @ a).astype(int)
        for bar in (np.sort(scores)[-3], np.sort(scores)[-30], np.sort(scores)[-500], 0, -5):
            rows = bucket.feasible(a, float(np.linalg.norm(a)), int(bar))
            found = set(range(4000)) if rows is None else set(rows.tolist())
            assert set(np.flatnonzero(scores >= bar).tolist()) <= found
            pruned += len(found) < 2000
    assert pruned > 40
    assert len(bucket.feasible(x[0], float(np.linalg.norm(x[0])), 1 << 40)) == 0


def test_query_equals_all_pairs_on_a_whole_table(spark):
    at = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
    got = queries.REGISTRY["op11_hard_negatives"](spark, at)
    assert dict(got.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == brute(rows)
