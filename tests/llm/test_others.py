"""Operators on conversations, pages and embeddings against SQL, tables of cases and brute force."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from small import components

from seqloom.llm import ann, chat, queries, urls, vecdedup

NAN, INF = float("nan"), float("inf")


# 1: chat


def test_perspectives(spark):
    turns = [
        (1, 0, "system", "Be kind."), (1, 1, "Ann", "Hi"), (1, 2, "Bob Lee", "a <|end|> b"), (1, 3, "Ann", None), (1, None, "Ann", "early"), (1, 3, "Ann", None),
        (2, 0, "system", "alone"), (3, 5000, "", "x" * 70_000), (3, -3, None, ""), (None, 1, "Cy", "who"), (4, 1, "\u00c9va", "\u00e9"), (4, 1, "Dan", "tie"), (4, 1, "Dan", "a tie"),
    ]
    turns += [(9, i, f"p{i % 3}", f"t{i}") for i in range(2500)]
    schema = "conv_id long, turn long, role string, text string, name string, block int"
    table = spark.createDataFrame([(*t, "x", 1) for t in turns], schema)
    got = chat.perspectives(table).toPandas()
    conversations = pd.DataFrame(turns, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    want = duckdb.sql(queries.OP1_SQL).df()
    plain = lambda d: sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False))
    assert plain(got) == plain(want)
    for _, side in got[got.conv_id == 1].groupby("perspective"):
        side = side.sort_values("pos")
        whole = "".join(side.segment)
        for r in side.itertuples():
            assert whole[r.start : r.end] == r.segment
            assert (whole[r.mask_start : r.mask_end] != "") == (r.shown_as == "assistant")
            assert not r.mask_start < r.mask_end or whole[r.mask_start : r.mask_end].endswith("<|end|>\n") and "assistant" not in whole[r.mask_start : r.mask_end]
    assert set(got[got.conv_id == 1].perspective) == {"Ann", "Bob_Lee"} and 2 not in set(got.conv_id)
    assert chat.perspectives(spark.createDataFrame([], schema)).count() == 0


# 7: URLs


def test_hosts_paths_and_rules(spark):
    cases = [
        (1, "http://Ex.ORG/a?b#c", "ex.org", "/a", "org/", "allow"), (2, None, "", "", None, None), (3, "no scheme/x", "", "", None, None), (4, "http://", "", "", None, None),
        (5, "https://example.org/es/1", "example.org", "/es/1", "example.org/es/", "block"), (6, "https://m.example.org/en/12", "m.example.org", "/en/12", "example.org/en/1", "block"),
        (7, "https://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"), (8, "https://a.com/fr/#x", "a.com", "/fr/", "com/fr/", "allow"), (9, "https://a.com/de/?q", "a.com", "/de/", "com/de/", "block"),
        (10, "https://a.com/FR/", "a.com", "/FR/", None, None), (11, "https://xcom/de/", "xcom", "/de/", None, None), (12, "x://y://z/q", "y:", "//z/q", None, None), (13, "https://a.org?x", "a.org", "", None, None),
        (14, "https://\u00c9.ORG/p", "\u00c9.org", "/p", "org/", "allow"), (None, "http://com/de/a\nb", "com", "/de/a\nb", "com/de/", "block"), (16, "", "", "", None, None), (1, "http://Ex.ORG/a?b#c", "ex.org", "/a", "org/", "allow"),
    ]
    out = urls.judge(spark.createDataFrame([(c[0], c[1], "<p>", "clash", 1.0) for c in cases], "page_id long, url string, html string, rule string, score double")).collect()
    got = sorted((str(r["page_id"]), r["host"], r["path"], str(r["rule"]), r["verdict"] if r["rule"] else "-") for r in out)
    assert got == sorted((str(c[0]), c[2], c[3], str(c[4]), c[5] or "-") for c in cases)
    assert {r["verdict"] for r in out} <= {"allow", "block"} and all((r["score"] is None) == (r["rule"] is not None) for r in out)
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_regression_on_hosts_it_has_not_seen():
    table = urls.labelled()
    held = {h for i, h in enumerate(sorted({h for h, _, _ in table})) if i % 5 == 0}
    w = urls.train([t for t in table if t[0] not in held])
    rest = [t for t in table if t[0] in held]
    p = urls.scores(w, [h for h, _, _ in rest], [q for _, q, _ in rest])
    assert np.mean((p >= 0.5) == np.array([b for _, _, b in rest])) > 0.8


# 9 and 10: vectors


def vectors(seed: int, n: int, dim: int = 16) -> list[list]:
    """(vec_id, embedding, label): clusters about the threshold, copies, and everything that takes no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 12), dim))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * rng.choice([0.05, 0.25, 0.4], (n, 1))
    out = [[i, [float(c) for c in np.float32(v)], int(rng.integers(0, 3))] for i, v in enumerate(x)]
    out[3][2] = None
    for k in range(5, 10):
        out[k][1:] = out[4][1:]
    odd = [[None] * dim, None, [0.0] * dim, [NAN] * dim, [1.0] * (dim - 1) + [INF], [1.0] * (dim - 1) + [None], [], [1.0, 0.5], [1.0, 0.5], [2.0, 1.0]]
    return out + [[n + i, v, 1] for i, v in enumerate(odd)]


def usable(v) -> bool:
    return bool(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)


def cosine(a, b) -> float:
    a, b = np.array(a), np.array(b)
    return float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))


def test_vector_links(spark):
    rows = vectors(1, 400)
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, id int, cell int").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vecdedup.near_duplicates(table).collect()}
    links = [(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[2] is not None and a[2] == b[2] and usable(a[1]) and usable(b[1]) and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= 0.93]
    comp = components([r[0] for r in rows], links)
    n = {r[0]: 0 for r in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert len(links) > 300 and got == {i: (n[i], comp[i], comp[i] == i) for i in n}
    assert vecdedup.near_duplicates(table.limit(0)).count() == 0
    unnamed = vecdedup.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((str(r["vec_id"]), r["n_links"]) for r in unnamed) == [("1", 1), ("2", 1), ("None", 0)]


def test_full_cells_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vecdedup, "TILE", 16)
    rng = np.random.default_rng(2)
    x = np.float32(rng.normal(size=8) + 0.2 * rng.normal(size=(150, 8)))
    got = {r["vec_id"]: r["n_links"] for r in vecdedup.near_duplicates(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    assert got == dict(enumerate(((u @ u.T >= 0.93).sum(1) - 1).tolist()))


@pytest.mark.parametrize("k", [5])
def test_nearest_of_few_is_exact(spark, k):
    rows = vectors(3, 200)
    rows += [r[:] for r in rows[:3]]  # repeated rows
    from pyspark.sql import functions as F

    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, list int, rank int").repartition(3)
    got = {}
    for r in ann.nearest(table, F.col("vec_id") % 5 == 0, k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    part = {r[0]: r[1] for r in rows if usable(r[1])}
    want = {}
    for q in part:
        if q % 5 == 0:
            best = sorted(((-cosine(part[q], v), i) for i, v in part.items() if i != q and len(v) == len(part[q])))[:k]
            want[q] = [(i, round(-s, 9)) for s, i in best]
    assert {q: [(i, round(s, 9)) for _, i, s in sorted(v)] for q, v in got.items()} == {q: v for q, v in want.items() if v}
    assert all([r for r, _, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())
    assert ann.nearest(table.limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_recall_against_brute_force(spark):
    from pyspark.sql import functions as F

    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = table.toPandas()
    u, ids = np.array(x.embedding.tolist(), float), x.vec_id.to_numpy()
    u /= np.linalg.norm(u, axis=1)[:, None]
    got = ann.nearest(table, F.col("vec_id") % 50 == 0).toPandas().groupby("query_id").vec_id.apply(set).to_dict()
    hits = []
    for i in np.flatnonzero(ids % 50 == 0):
        s = u @ u[i]
        s[i] = -9
        hits += [v in got[ids[i]] for v in ids[np.lexsort((ids, -s))[:5]]]
    assert np.mean(hits) >= 0.9
