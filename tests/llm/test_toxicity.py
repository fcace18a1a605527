import random

import numpy as np

from panelcast.llm import toxicity


def make(n, seed=0):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic, good = i % 5 == 0, i % 3 != 0
        words = [f"word{rnd.randint(0, 80)}" for _ in range(30)] + (["vilex" + rnd.choice("abcdef")] * 2 if toxic else []) + ([] if good else ["junkjunk"])
        rnd.shuffle(words)
        rows.append((i, " ".join(words), 0.5))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def test_chain_feeds_earlier_probabilities_and_uses_out_of_fold():
    """The second category is only visible through the first one's features' probability."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 600)
    rows = [np.array([5 if v else 7], dtype=np.int32) for v in y]
    labels = np.column_stack([y, y])
    models, cut = toxicity.fit_chain(rows, labels, np.arange(600) % toxicity.FOLDS)
    assert len(models[1].earlier) == 1 and models[1].earlier[0] > 0
    p = toxicity.Chain(("a", "b"), models, cut).predict(rows)
    assert ((p[:, 1] >= cut) == y).all()


def test_linear_model_is_near_its_optimum():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 40, 6)).astype(np.int32) for _ in range(500)]
    y = np.array([(3 in r) or (rng.random() < 0.1) for r in rows], dtype=float)
    before = rng.random((500, 1))
    m = toxicity.fit_linear(rows, before, y)
    r = m.scores(rows, before) - y
    used = np.nonzero(m.weights)[0]
    grad = np.array([sum(r[i] for i, x in enumerate(rows) if k in x) + toxicity.RIDGE * m.weights[k] for k in used])
    assert np.abs(grad).max() < 0.5 and abs(r.sum()) < 0.5


def test_cases_are_defined(spark):
    rows, labels = make(300)
    rows += [(1000, None, 0.1), (1001, "", 0.1), (None, "word1 vilexa vilexb", 0.1), (1002, "vilexc " * 5000, 0.1), (5, rows[5][1], 0.1)]
    labels += [(0, 1, 0), (7, None, 1), (8, 1, None), (9999, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.classify(docs, marks).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: r for r in out}
    assert not by[1000]["toxic"] and not by[1001]["toxic"] and by[None]["toxic"] and by[1002]["toxic"]
    assert sum(by[i]["toxic"] == (i % 5 == 0) for i in range(300)) >= 297
    assert not toxicity.classify(docs.limit(0), marks).collect()
    untaught = toxicity.classify(docs, marks.limit(0)).collect()
    assert not any(r["toxic"] for r in untaught) and {r["p_toxic"] for r in untaught} == {0.0}


def test_registered_query_on_unseen_labels(spark):
    """Held-out accuracy: a chain taught on two thirds of the labels, read on the rest."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.fit(docs, labels.filter("doc_id % 3 <> 0"))
    seen = toxicity.score(docs, chain).withColumnRenamed("toxic", "flag").join(labels.filter("doc_id % 3 = 0"), "doc_id").toPandas()
    assert seen[seen.toxic == 1].flag.mean() > 0.9 and seen[seen.toxic == 0].flag.mean() < 0.02
