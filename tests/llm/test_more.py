"""Limits that wrong labels do not move, maximal repeats, ids with several texts, held-out calibration."""

import random
import zlib

import numpy as np
import pytest
from small import DOC_SCHEMA, near, rows, words

from seqloom.llm import ann, langid, minhash, substr

SAY = {"aa": "lorem ipsum dolor sit amet consectetur".split(), "bb": "zwei kurze worte hier unten drunter".split()}
FOREIGN = "qxzv jkwq zzxq vvkj hxwq".split()
SCHEMA = "doc_id long, text string, lang string"


def learned(i):
    return zlib.crc32(str(i).encode()) % 5 != 0


def speech(rng, lang, n=25):
    return " ".join(rng.choice(SAY[lang]) for _ in range(n))


def test_a_few_wrong_labels_do_not_move_the_limit(spark):
    rng = random.Random(3)
    items = [(i, speech(rng, k), k) for i in range(900) for k in [rng.choice(["aa", "bb"])]]
    bad = [(1000 + i, " ".join(rng.choice(FOREIGN) for _ in range(25)), "aa") for i in range(4)]
    asked = [(2000 + i, " ".join(rng.choice(FOREIGN) for _ in range(25)), None) for i in range(20)]
    clean, spoilt = (langid.fit(spark.createDataFrame(x, SCHEMA)).limits for x in (items, items + bad))
    assert spoilt["aa"] < 1.3 * clean["aa"]
    out = langid.keep_known(spark.createDataFrame(items + asked, SCHEMA)).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(900))


def test_a_language_of_few_documents_is_learned(spark):
    rng = random.Random(5)
    few = [i for i in range(5000, 5100) if learned(i)][:2]
    items = [(i, speech(rng, "aa"), "aa") for i in range(300)] + [(i, speech(rng, "bb"), "bb") for i in few] + [(9000, speech(rng, "bb"), None)]
    table = spark.createDataFrame(items, SCHEMA)
    got = {r["doc_id"]: r for r in langid.identify(table).collect()}
    assert got[9000]["lang_pred"] == "bb" and not any(r["rejected"] for r in got.values())


def test_without_a_label_documents_with_letters_stay(spark):
    table = spark.createDataFrame([(1, "some words", None), (2, "12 .", None), (3, None, None), (4, "", None), (5, "é", None)], SCHEMA)
    assert sorted(r["doc_id"] for r in langid.keep_known(table).collect()) == [1, 5]


@pytest.mark.parametrize("length", (35, 50))
def test_maximal_repeats(spark, length):
    items = sorted({(r[0], r[1]) for r in rows()}, key=str)
    seen: dict = {}
    for _, t in [r[:2] for r in rows()]:
        w = words(t)
        for s in range(len(w) - length + 1):
            seen[tuple(w[s : s + length])] = seen.get(tuple(w[s : s + length]), 0) + 1
    want = []
    for i, t in items:
        w = words(t)
        again = [seen[tuple(w[s : s + length])] > 1 for s in range(len(w) - length + 1)]
        for s, x in enumerate(again):
            if x and not (s and again[s - 1]):
                end = next((e for e in range(s, len(again)) if not again[e]), len(again))
                want.append((i, s, end - s - 1 + length))
    got = substr.maximal_repeats(spark.createDataFrame(rows(), DOC_SCHEMA).repartition(3), length)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 10
    assert substr.maximal_repeats(spark.createDataFrame([], DOC_SCHEMA), length).count() == 0


def test_an_id_with_two_texts_is_linked_by_both(spark):
    rng = random.Random(8)
    one, two = (" ".join(f"w{rng.randrange(3000)}" for _ in range(80)) for _ in range(2))
    items = [(1, one), (5, one + " x"), (5, two), (9, two + " y"), (5, two), (7, "alone in the table here")]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(items, "doc_id long, text string"), 5, 80).collect()}
    assert got == {1: 1, 5: 1, 9: 1, 7: 7}
    kept = minhash.keep_one(spark.createDataFrame([(1, one), (1, one), (1, two), (2, one)], "doc_id long, text string"), 5, 80).collect()
    assert sorted(map(tuple, kept)) == sorted([(1, one), (1, two)])


def test_thousands_of_copies(spark):
    """Exact copies and near copies of one text, by far the largest group of the table."""
    rng = random.Random(6)
    base = [f"w{rng.randrange(500)}" for _ in range(60)]
    items = {i: " ".join(base) for i in range(600)}
    for i in range(600, 700):
        w = list(base)
        w[rng.randrange(60)] = f"n{i}"
        items[i] = " ".join(w)
    items |= {i: " ".join(f"z{rng.randrange(900)}" for _ in range(40)) for i in range(700, 760)}
    got = minhash.near_duplicates(spark.createDataFrame(list(items.items()), "doc_id long, text string").repartition(4), 3, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == near(items, 3, 80)


def test_index_is_calibrated_on_vectors_that_fit_no_centroid():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 16))
    index = ann.Index(x, 1500, 5)  # nearly a list for each vector
    assert len(index.centroids) == 1500 and index.ratio < 10
    assert ann.Index(x[:50], 8, 5).ratio >= 1


def test_recall_with_many_lists(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(ann, "LIST_ROWS", 16)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.astype(np.float32).tolist())], "vec_id long, embedding array<float>").repartition(3)
    got = ann.nearest(table, F.col("vec_id") % 50 == 0).toPandas()
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    hit = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:5]) & set(got[got.query_id == q].vec_id))
    assert (got.groupby("query_id").size() == 5).all() and hit / 300 >= 0.9
