"""Operators on documents against brute force, round trips and held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from small import DOC_SCHEMA, near, repeated_words, rows, words

from seqloom.llm import _words as W
from seqloom.llm import langid, minhash, mixing, packing, substr, tokens

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOC_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


# 2: substring dedup


def test_repeats_digest(docs):
    got = sorted(tuple(r)[:4] for r in substr.remove_repeats(docs, 35, digest=True).collect())
    want = sorted((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in repeated_words([r[:2] for r in rows()], 35))
    assert got == want and sum(r[2] for r in got) > 500


def test_repeats_keep_columns_and_white_space(docs):
    out = substr.remove_repeats(docs, 50)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], " ".join(words(r["text"]))) for r in out.collect()))
    assert got == sorted((i, kept) for i, _, _, kept in repeated_words([r[:2] for r in rows()], 50))


def test_repeats_of_nothing(none, spark):
    assert substr.remove_repeats(none, 35, digest=True).count() == 0
    same = " ".join(f"q{i}" for i in range(40))
    unnamed = spark.createDataFrame([(None, same), (None, same), (None, None), (1, "a b")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substr.remove_repeats(unnamed, 35, digest=True).collect())
    assert got == [("1", 2, 0), ("None", 0, 0), ("None", 40, 40), ("None", 40, 40)]


def test_common_anchor_is_dealt_to_all_tasks(spark):
    """A passage that most documents share is compared in many tasks; windows seen once in a task meet the others."""
    rng = random.Random(4)
    shared = [f"s{i}" for i in range(45)]
    items = [(i, " ".join([f"a{rng.random()}" for _ in range(rng.randrange(9))] + shared[: rng.choice((36, 40, 45))] + [f"b{rng.random()}" for _ in range(9)])) for i in range(3000)]
    items += [(9000 + i, " ".join([f"x{i}", *shared[i : i + 35], f"y{i}"])) for i in range(8)]
    got = {r["doc_id"]: r["n_removed"] for r in substr.remove_repeats(spark.createDataFrame(items, "doc_id long, text string").repartition(4), 35, digest=True).collect()}
    assert got == {i: gone for i, _, gone, _ in repeated_words(items, 35)}


# 3: packing


def check_packing(pieces, items, tokenizer):
    """Every id in one piece, sequences gapless, little padding. items: (id, text) rows."""
    want = sorted((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in items)
    by_id: dict = {}
    for i, ids in want:
        by_id.setdefault(i, []).append(ids)
    assert sum(p["length"] for p in pieces) == sum(len(ids) for _, ids in want)
    for i, copies in by_id.items():
        own = [p for p in pieces if p["doc_id"] == i]
        assert {p["doc_tokens"] for p in own} == {len(c) for c in copies}
        assert sum(p["length"] for p in own) == sum(map(len, copies))
        if len(set(copies)) == 1:
            covered = np.zeros(len(copies[0]), int)
            for p in own:
                covered[p["start"] : p["start"] + p["length"]] += 1
                assert p["ids_crc32"] == zlib.crc32(np.array(copies[0][p["start"] : p["start"] + p["length"]], "<u4").tobytes())
            assert (covered == len(copies)).all()
    seqs: dict = {}
    for p in pieces:
        assert p["length"] > 0
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    padded = 0
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 4096
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    return padded / max(1, sum(p["length"] for p in pieces))


def test_packing_is_a_round_trip(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    pieces = packing.pack(docs, VOCABULARY).collect()
    assert check_packing(pieces, [r[:2] for r in rows()], tokenizer) < 0.01
    assert sorted(map(str, packing.pack(docs, VOCABULARY).collect())) == sorted(map(str, pieces))
    assert packing.pack(none, VOCABULARY).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_encoder_equals_the_tokenizer(seed):
    from tokenizers import Tokenizer

    tokenizer, enc, rng = Tokenizer.from_file(VOCABULARY), packing.Encoder(VOCABULARY), random.Random(seed)
    parts = ["Hello", "don't", "it's", "don'", "t.", ",,", "...", "a.b", "e\u0301", "\u00c9t\u00e9.", "\u4e2d\u6587,", "\u0130x", "<|endoftext|>", "<|end", "oftext|>", "12.5", "x,y", "\U0001f600", "\xa0", "\u2028", "\x0b", "\x1c", "\x00", "  ", "\n\n", "\u00df.", "\u00d7.", "Z.a", "'ll", "we'", "\u00ad", "\u212b"]
    items = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n", "\t"]) for _ in range(rng.randrange(40))) for _ in range(150)]
    data = [t.encode() for t in items]
    buf, offsets = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])])
    ids, to = enc.encode(buf, offsets)
    for i, t in enumerate(items):
        assert ids[to[i] : to[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_first_fit_decreasing_takes_the_first_bin_that_fits():
    rng = random.Random(2)
    for _ in range(20):
        lengths = [rng.randrange(1, 50) for _ in range(rng.randrange(60))]
        free, bins = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            at = next((k for k, f in enumerate(free) if f >= lengths[i]), len(free))
            if at == len(free):
                free.append(50)
                bins.append([])
            free[at] -= lengths[i]
            bins[at].append(i)
        assert packing.first_fit_decreasing(lengths, 50) == bins


# 4: language


def test_kneser_ney_sums_to_one():
    model = langid.Model({"a": {"abab": 5, "abba": 2, "b": 1}, "b": {"xyz": 3, "ab": 1}})
    for context in ("", "a", "ab", "abb", "q"):
        total = np.zeros(2)
        for c in "abxyz":
            total += np.exp(-(model.score([context + c]) - ends(model, context + c) - (model.score([context]) - ends(model, context) if context else 0))[0])
        space = np.exp(-ends(model, context)) if context else 0
        unseen = np.exp(-(model.score([context + "?"]) - ends(model, context + "?") - (model.score([context]) - ends(model, context) if context else 0))[0])
        if context:
            assert np.allclose(total + space + (langid.ALPHABET - 6) * unseen, 1, atol=1e-4)


def ends(model, word):
    """-ln p of the space after the word: the score less that of the word's characters alone."""
    codes, place, _ = langid._codes([word])
    h, p = langid._hashes(codes, model.order), np.full(len(model.langs), 1 / langid.ALPHABET)
    at, n_place = len(codes) - 1, len(codes) - 1
    for n, (grams, disc, ctx, low) in enumerate(model.tables, 1):
        if n_place >= n - 1:
            i, j = np.flatnonzero(grams == h[n][at]), np.flatnonzero(ctx == h[n - 1][at - 1])
            p = (disc[i[0]] if len(i) else 0) + (low[j[0]] if len(j) else 1) * p
    return -np.log(p)


def test_language_of_held_out_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = {r["doc_id"]: r for r in langid.identify(table).collect()}
    true = {r["doc_id"]: r["lang"] for r in table.collect()}
    held = [i for i in true if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(held) == sorted(i for i, r in out.items() if r["held_out"])
    assert np.mean([out[i]["lang_pred"] == true[i] for i in held]) > 0.98
    assert sum(r["rejected"] for r in out.values()) < 0.01 * len(out)


def test_language_is_learned_from_allowed_labels_only(spark):
    rng = random.Random(1)
    say = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "zwei kurze worte hier unten".split()}
    items = [(i, " ".join(rng.choice(say[k]) for _ in range(rng.randrange(1, 30))), k) for i in range(60) for k in [rng.choice(["aa", "bb"])]]
    items += [(100, None, "aa"), (101, "", "bb"), (102, "12 34 !!", "aa"), (103, "zwei", None), (None, "dolor", None), (104, "lorem " * 50_000, None), (5, items[5][1], items[5][2])]
    schema = "doc_id long, text string, lang string"
    out = langid.identify(spark.createDataFrame(items, schema)).collect()
    got = {r["doc_id"]: r["lang_pred"] for r in out}
    assert len(out) == len(items) and all(got[i] == k for i, _, k in items[:60])
    assert [got[i] for i in (100, 101, 102, 103, None, 104)] == ["und", "und", "und", "bb", "aa", "aa"]
    assert all(0 <= r["score"] <= 1 for r in out)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    turned = [(i, t, ("bb" if k == "aa" else "aa") if held(i) else k) for i, t, k in items]
    assert sorted(map(str, langid.identify(spark.createDataFrame(turned, schema)).collect())) == sorted(map(str, out))
    unknown = langid.identify(spark.createDataFrame([(1, "text", None)], schema)).collect()
    assert [r["lang_pred"] for r in unknown] == ["und"]
    assert langid.keep_known(spark.createDataFrame([], schema)).count() == 0


def test_rejected_documents_go_and_columns_stay(spark):
    rng = random.Random(1)
    items = [(i, " ".join(rng.choice("lorem ipsum dolor sit amet".split()) for _ in range(20)), "aa" if i % 2 else None, 1, 2) for i in range(150)]
    items += [(900, "qxzv jkwq zzxq vvkj " * 5, None, 1, 2), (901, None, "aa", 1, 2), (902, "lorem ipsum", None, 1, 2)]
    table = spark.createDataFrame(items, "doc_id long, text string, lang string, `__best` int, id int")
    out = langid.keep_known(table)
    assert out.columns == table.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [*range(150), 902] and {r["lang"] for r in out.collect()} == {"aa"}


# 5: token counts


def greedy(word, first, more):
    """Pieces by greedy longest match, built one by one; None if it cannot be written."""
    at, n, vocabulary = 0, 0, first
    while at < len(word) or not n:
        size = next((k for k in range(len(word) - at, -1 if vocabulary is first else 0, -1) if word[at : at + k] in vocabulary), None)
        if size is None:
            return None
        at, n, vocabulary = at + size, n + 1, more
    return n


def test_automaton_equals_greedy_longest_match():
    rng = random.Random(3)
    letters = "abc"
    for _ in range(200):
        some = lambda k: {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(k)}
        first, more = some(8), some(8)
        if rng.random() < 0.5:
            first.add("")
        a = tokens.Automaton(sorted(first), sorted(more))
        for _ in range(60):
            word = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 14)))
            want = greedy(word, first, more)
            assert a.count(word) == (-1 if want is None else want), (word, first, more)


def test_token_counts(docs, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    first, more = map(set, tokens.vocabulary(path))
    got = sorted(tuple(r) for r in tokens.count_tokens(docs, path).collect())
    want, known = [], {}
    for i, t, *_ in rows():
        n = [known.setdefault(w, greedy(w, first, more)) for w in words(t)]
        want.append((i, len(n), sum(x or 1 for x in n), sum(x is None for x in n)))
    assert got == sorted(want)
    assert tokens.count_tokens(none, path).count() == 0


# 6: near duplicates


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, k, percent):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, k, percent).collect()}
    want = near({r[0]: r[1] for r in rows()}, k, percent)
    assert got == {(i, n, c, i == c) for i, (n, c) in want.items()}
    assert len({c for _, c in want.values()}) < len(want) - 10


def test_large_buckets_are_compared_whole(spark, monkeypatch):
    """A group of near copies larger than a block, which the smallest member is not like."""
    monkeypatch.setattr(minhash, "TILE", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    items = {}
    for i in range(90):
        w = list(base)
        for at in rng.sample(range(60), rng.choice((1, 2, 3))):
            w[at] = f"z{rng.random()}"
        items[i] = " ".join(w)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(list(items.items()), "doc_id long, text string"), 3, 85).collect()}
    assert got == near(items, 3, 85)


def test_keep_one_and_nothing(docs, none, spark):
    out = minhash.keep_one(docs)
    want = near({r[0]: r[1] for r in rows()}, 5, 80)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert minhash.near_duplicates(none).count() == 0
    unnamed = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in minhash.keep_one(unnamed).collect()) == ["3", "None"]


def test_every_coordinate_fills_and_estimates_concentrate():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 50, 1000):
        one = rng.integers(0, 2**63, n).astype(np.uint64)
        other = one.copy()
        other[: n // 5] = rng.integers(0, 2**63, n // 5).astype(np.uint64)
        s = minhash.sketches(np.concatenate([one, other]), np.array([0, n, 2 * n]), 96)
        assert (s != np.iinfo(np.uint64).max).all()
        true = (n - n // 5) / (n + n // 5)
        assert abs((s[0] == s[1]).mean() - true) < 0.2
    assert (minhash.sketches(one, np.array([0, 0, n]), 96)[0] == np.iinfo(np.uint64).max).all()


# 8: mixing


def test_mix(docs, none):
    import duckdb
    import pandas as pd

    from seqloom.llm import queries

    unique = docs.dropDuplicates(["doc_id"])
    out = mixing.mix(unique, keep=["doc_id", "source"]).toPandas()
    documents = pd.DataFrame([r[:4] for r in {r[0]: r for r in rows()}.values()], columns=["doc_id", "text", "lang", "source"])  # noqa: F841
    want = duckdb.sql(queries.OP8_SQL).df().sort_values("doc_id")
    out = out.sort_values("doc_id")
    assert out["__mix_size"].tolist() == want["size"].tolist() == [len(words(t)) for t in documents.text]
    assert (out["__mix_copies"] * out["__mix_size"]).tolist() == want["taken"].tolist()
    assert np.allclose(out["__mix_target"], want["target"])
    assert out["__mix_copies"].max() <= 3
    for _, own in out.groupby(out["source"].fillna("")):
        assert abs((own["__mix_copies"] * own["__mix_size"]).sum() - own["__mix_target"].iloc[0]) <= 3 * own["__mix_size"].max()
    assert mixing.mix(none).count() == 0
    both = mixing.mixed_documents(docs)
    assert both.columns == docs.columns and sorted(map(str, both.collect())) == sorted(map(str, mixing.mixed_documents(docs.repartition(7)).collect()))


def test_targets_stop_and_are_shared_again(spark):
    sizes = {"a": 10, "b": 1000, "c": 20, "d": 500, None: 5, "e": 0}
    out = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long"), [1, 2, 3], 3.0).collect()}
    weight = dict(zip(["a", "b", "c", "d", "e", None], [1, 2, 3, 1, 2, 3]))
    stopped: set = set()
    while True:  # reshare until none is above
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in stopped)
        target = {s: 3 * sizes[s] if s in stopped else rest * weight[s] / sum(weight[x] for x in sizes if x not in stopped) for s in sizes}
        more = {s for s in sizes if target[s] > 3 * sizes[s]}
        if not more:
            break
        stopped |= more
    assert {k: round(v, 6) for k, v in out.items()} == {k: round(v, 6) for k, v in target.items()}


# words


def test_words_and_hashes():
    items = [b"", b" a  b\x0bc", b"a", "\u00e9 \xa0x\u2003y".encode(), b"ab a", b"\x00 \x1c"]
    buf, offsets = np.frombuffer(b"".join(items), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in items])])
    starts, ends, first = W.spans(buf, offsets)
    got = [[bytes(buf[s:e]).decode() for s, e in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])] for i in range(len(items))]
    assert got == [words(t.decode()) for t in items]
    h = W.word_hashes(buf, starts, ends)
    flat = [w for g in got for w in g]
    assert len(set(h.tolist())) == len(set(flat))
