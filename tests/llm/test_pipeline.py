import random

import pytest

import corpus_pipeline as cp
from panelcast.llm import packing


def sentence(rnd, words):
    return " ".join(rnd.choice(words) for _ in range(12)).capitalize() + "."


@pytest.fixture
def corpus(spark, tmp_path):
    rnd = random.Random(4)
    en = [f"{a}{b}" for a in ("the", "wor", "thing", "ing") for b in ("ly", "er", "tion", "ness", "s")]
    de = [f"{a}{b}" for a in ("das", "der", "keit", "ung") for b in ("lich", "heit", "en", "ß", "ä")]
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(sentence(rnd, en if i % 2 else de) for _ in range(5)), "en" if i % 2 else "de", "s", 0, "extra"))
    item = "What happens when seven wise gardeners water one old tree in the middle of a dry summer night?"
    rows += [(100, rows[3][1] + " More.", "en", "s", 0, "extra"), (101, "too short", "en", "s", 0, "extra"), (102, rows[5][1].replace("\n", "\n" + item + "\n", 1) + "\n" + sentence(rnd, en), "en", "s", 0, "extra"),
             (103, None, None, "s", None, None), (104, "", "en", "s", 0, "extra"), (105, "\n".join("漢字 かな 文字 です。" * 3 for _ in range(9)), "en", "s", 0, "extra"), (7, rows[7][1], "en", "s", 0, "extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), docs


def test_stages_keep_columns_and_take_effect(spark, corpus):
    sf_dir, docs = corpus
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality_rules", "language_id", "near_dedup", "benchmark_decontamination", "best_fit_packing"]
    now, kept = docs, []
    for name, stage in cp.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        kept.append(sorted(r["doc_id"] for r in now.collect()))
    clean = list(range(60))
    assert not {101, 103, 104} & set(kept[0]) and set(clean + [100, 102]) <= set(kept[0])
    assert set(clean + [100]) <= set(kept[1])
    assert 100 not in kept[2] and kept[2].count(7) == 1 and set(clean) <= set(kept[2])
    assert 102 not in kept[3] and set(clean) <= set(kept[3])
    packed = cp.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == set(kept[3])
    assert all(0 < r["length"] <= packing.CAPACITY for r in packed)


def test_near_dedup_keeps_one_row_of_every_group(spark):
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(40)) for w in "abcd")
    rows = [(1, a), (None, a + " more"), (None, b), (None, b), (None, b + " more"), (2, c), (2, d), (2, d), (3, c + " more"), (4, d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = cp.near_dedup(spark, docs, "").collect()
    assert sorted(r["text"].split()[0] for r in out) == ["a0", "b0", "c0", "d0"]
    assert {r["doc_id"] for r in out if r["text"][0] == "a"} == {1} and {r["doc_id"] for r in out if r["text"][0] == "b"} == {None}


def test_empty_documents(spark, corpus):
    sf_dir, docs = corpus
    now = docs.limit(0)
    for _, stage in cp.STAGES:
        now = stage(spark, now, sf_dir)
        assert now.count() == 0


def test_run_equals_brute_force_stages(spark):
    """On the smallest table: quality by its SQL form, near copies and leaks by all pairs, then tokens by the tokenizer."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from tests_llm_brute import components, leaks

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    first = cp.language_id(spark, cp.quality_rules(spark, docs, d), d).collect()
    texts = {r["doc_id"]: r["text"] for r in first}
    least = components(list(texts.items()), 5)
    alone = {k: v for k, v in texts.items() if least[k] == k}
    items = [tuple(r) for r in spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {doc for doc, _ in leaks(list(alone.items()), items)}
    want = {k: v for k, v in alone.items() if k not in bad}
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    out = {}
    for r in cp.run(spark, d).collect():
        out.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert set(out) == set(want)
    for k, text in want.items():
        ids = np.asarray(tok.encode(text, add_special_tokens=False).ids + [0], dtype="<u4")
        assert sorted(out[k]) == [(j, at, len(ids[at:at + 2048]), zlib.crc32(ids[at:at + 2048].tobytes())) for j, at in enumerate(range(0, len(ids), 2048))]
