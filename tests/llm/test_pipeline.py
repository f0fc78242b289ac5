"""The pipeline, stage by stage, against what each stage should keep of its own input."""

import os
import random

import public_tokenizers
from small import near, prose, repeated_words, words
from test_texts import check_packing

import corpus_pipeline
from seqloom.llm import langid, mixing


def corpus() -> list[tuple]:
    rng = random.Random(8)
    say = {"aa": [f"{a}{b}" for a in ("lo", "mi", "sa", "ter") for b in ("rem", "do", "lin", "va", "nu")], "bb": [f"{a}{b}" for a in ("zw", "kr", "sch", "pf") for b in ("eit", "uch", "ort", "ung", "aft")]}
    one = lambda k, n: " ".join(rng.choice(say[k]) for _ in range(n))
    out = []
    for i in range(160):
        k = rng.choice(["aa", "bb"])
        out.append([i, one(k, rng.randrange(30, 160)), k, rng.choice(["s1", "s2", None]), 0])
    passage = one("aa", 70)
    for i in range(20, 30):
        out[i][1] = f"{out[i][1]} {passage} {one('aa', 4)}"
    out += [[200 + i, out[i][1] + " " + rng.choice(say[out[i][2]]), out[i][2], "s1", 0] for i in range(12)]
    out += [[300, None, "aa", "s1", 0], [301, "", None, None, 0], [302, prose(rng, 40).replace("w", "7"), "bb", "s2", 0], [303, "12 34 " * 20, "aa", "s2", 0]]
    return [(*r[:4], len(r[1] or "")) for r in out]


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    table = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string, n_chars long")
    docs = table
    seen = {}
    for name, f in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        rows_before = docs.collect()
        out = f(spark, docs, "")
        if name != "packing":
            assert out.columns == table.columns
        path = os.path.join(tmp_path, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        rows = docs.collect()
        after = seen[name] = {r["doc_id"]: r for r in rows}
        if name == "language":
            verdict = {r["doc_id"]: r for r in langid.predict(table, langid.fit(table)).collect()}
            assert set(after) == {i for i, r in verdict.items() if not r["rejected"]}
            assert not {300, 301, 302, 303} & set(after) and len(after) >= 0.98 * 172
        elif name == "near_duplicates":
            assert set(after) == {i for i, (_, c) in near({i: r["text"] for i, r in before.items()}, 5, 80).items() if c == i} and len(after) < len(before)
        elif name == "repeated_passages":
            assert {i: " ".join(words(r["text"])) for i, r in after.items()} == {i: kept for i, _, _, kept in repeated_words([(i, r["text"]) for i, r in before.items()], 50)}
            assert all(r["n_chars"] == len(r["text"]) for r in rows) and any(after[i]["text"] != before[i]["text"] for i in after)
        elif name == "mixing":
            copies = {r["doc_id"]: r["__mix_copies"] for r in mixing.mix(spark.createDataFrame(rows_before)).collect()}
            assert {i: sum(r["doc_id"] == i for r in rows) for i in copies} == copies
        else:
            pieces = rows
            assert check_packing(pieces, [(r["doc_id"], r["text"]) for r in rows_before], Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))) < 0.02


def test_nothing_goes_through(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, "")
    assert docs.count() == 0
