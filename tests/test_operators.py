"""Operators against plain lists, at several numbers of partitions."""

import itertools
import operator
import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import aggregating as A
from seqloom.operators import elementwise as E
from seqloom.operators import flow, geometry, nested
from seqloom.operators import scanning as S
from seqloom.operators import searching as Q
from seqloom.operators import selecting as P
from seqloom.operators import sorting as O
from seqloom.plans.order import Seq, running, with_next, with_pos

R = random.Random(4)
CASES = {
    "empty": [],
    "one": [5],
    "equal": [3] * 40,
    "sorted": list(range(60)),
    "reversed": list(range(60, 0, -1)),
    "random": [R.randrange(6) for _ in range(300)],
    "nulls": [None, 1, None, None, 2, 2, None],
}


PARTS = [(c, 3) for c in CASES] + [(c, n) for c in ("random", "nulls") for n in (1, 8)]


@pytest.fixture(params=PARTS, ids=lambda p: f"{p[0]}-{p[1]}")
def seq(request, spark):
    name, parts = request.param
    values = CASES[name]
    df = spark.createDataFrame([(i * 3, v) for i, v in enumerate(values)], "k long, v long").repartition(parts)
    return values, Seq(df, "k", block=16)


def one(df):
    return df.first()[0]


def test_positions_scans_and_neighbours(seq):
    values, s = seq
    got = {r["pos"]: r["v"] for r in s.select("v").collect()}
    assert got == dict(enumerate(values))
    plain = [v or 0 for v in values]
    w = Seq(s.df.withColumn("v", F.coalesce("v", F.lit(0))), "k", block=16)
    inc = [r["scan"] for r in sorted(S.inclusive_scan(w, "v", 10).collect(), key=lambda r: r["k"])]
    assert inc == [10 + x for x in itertools.accumulate(plain)]
    exc = [r["scan"] for r in sorted(S.exclusive_scan(w, "v", 10).collect(), key=lambda r: r["k"])]
    assert exc == [10 + x for x in itertools.accumulate(plain[:-1], initial=0)][: len(plain)]
    top = [r["scan"] for r in sorted(S.inclusive_scan(w, "v", kind="max").collect(), key=lambda r: r["k"])]
    assert top == list(itertools.accumulate(plain, max))
    nxt = {r["pos"]: r["b"] for r in with_next(w.indexed(), "pos", {"b": ("v", 2)}, 8).collect()}
    assert nxt == {i: plain[i + 2] if i + 2 < len(plain) else None for i in range(len(plain))}


def test_searches(seq):
    values, s = seq
    find = lambda needle: [i for i in range(len(values) - len(needle) + 1) if values[i : i + len(needle)] == needle]
    for needle in ([3, 3], [2, 2, None], values[14:19], [9] * 30):
        if not needle:
            continue
        hits = find(needle)
        assert sorted(r["pos"] for r in Q.occurrences(s, "v", needle).collect()) == hits
        assert one(Q.search(s, "v", needle)) == (hits[0] if hits else None)
        assert one(Q.find_end(s, "v", needle)) == (hits[-1] if hits else None)
    pairs = [i for i in range(len(values) - 1) if values[i] == values[i + 1]]
    assert one(Q.adjacent_find(s, "v")) == (pairs[0] if pairs else None)
    runs = find([3] * 4)
    assert one(Q.search_n(s, "v", 4, 3)) == (runs[0] if runs else None)


def test_order_and_partition(seq):
    values, s = seq
    low = [v if v is not None else -1 for v in values]
    assert one(S.is_sorted(s, "v")) == all(a <= b for a, b in zip(low, low[1:]))
    kept = [i for i in range(len(values)) if i == 0 or values[i] != values[i - 1]]
    assert sorted(r["pos"] for r in S.unique(s, "v", "v").collect()) == kept
    pred, true = F.col("v") > 2, [v is not None and v > 2 for v in values]
    want = [v for v, t in zip(values, true) if t] + [v for v, t in zip(values, true) if not t]
    got = {r["pos"]: r["v"] for r in P.stable_partition(s, pred, "v").collect()}
    assert [got[i] for i in range(len(values))] == want
    assert one(P.is_partitioned(s, pred)) == all(not b or a for a, b in zip(true, true[1:]))
    assert one(P.partition_point(s.df, pred)) == sum(true)
    both = P.partition_copy(s, pred, "v").collect()
    assert [r["v"] for r in sorted((r for r in both if r["matched"]), key=lambda r: r["pos"])] == [v for v, t in zip(values, true) if t]
    back = {r["pos"]: r["v"] for r in E.reverse(s, "v").collect()}
    assert [back[i] for i in range(len(values))] == values[::-1]
    assert one(P.all_of(s.df, pred)) == all(true)
    assert one(P.any_of(s.df, pred)) == any(true)
    assert one(P.none_of(s.df, pred)) == (not any(true))


def test_ordered_folds(spark):
    words = [R.choice("abc") for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(words)), "k long, v string").repartition(5)
    s = Seq(df, "k", block=7)
    assert one(A.reduce_ordered(s, "v", operator.add, "string")) == "".join(words)
    got = sorted(S.scan_with(s, "v", operator.add, "", "string").collect(), key=lambda r: r["k"])
    assert [r["scan"] for r in got] == list(itertools.accumulate(words))
    assert one(A.reduce_ordered(s.where(F.lit(False)), "v", operator.add, "string")) is None
    merged = A.for_each_merge(df.withColumn("v", F.length("v").cast("long")), "v", lambda: 0, operator.add, operator.add, "long")
    assert one(merged) == 50
    product = running(spark.range(1, 11), ["id"], {"p": ("product", F.col("id"))}, 4)
    assert sorted(r["p"] for r in product.collect())[-1] == 3628800


def test_positions_by_text_keys(spark):
    words = sorted({"".join(R.choices("xyz", k=4)) for _ in range(60)})
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(6)
    assert {r["w"]: r["pos"] for r in with_pos(df, ["w"]).collect()} == {w: i for i, w in enumerate(words)}
    assert O.nth_element_deep(df, 7, ["w"]).first()["w"] == words[7] == O.nth_element(df, 7, "w").first()["w"]
    assert [r["w"] for r in O.partial_sort(df, 5, "w").collect()] == words[:5]


def test_two_sequences(spark):
    def frame(values, name):
        return spark.createDataFrame(list(enumerate(values)), f"pos long, {name} long").repartition(3)

    lists = [[], [1], [1, 3], [1, None]]
    key = lambda x: [(-1 if v is None else v) for v in x]
    for a, b in itertools.product(lists, repeat=2):
        x, y = frame(a, "a"), frame(b, "b")
        assert one(Q.equal(x, y, "a", "b")) == (a == b[: len(a)])
        wrong = [i for i in range(len(a)) if i >= len(b) or a[i] != b[i]]
        assert one(Q.mismatch(x, y, "a", "b")) == (wrong[0] if wrong else None)
        assert one(Q.lexicographical_compare(x, y, "a", "b")) == (key(a) < key(b))
    assert one(A.inner_product(frame(range(10), "a"), frame(range(10), "b"), "a", "b", 42)) == 285 + 42
    assert one(A.inner_product(frame([], "a"), frame([], "b"), "a", "b", 42)) == 42
    swapped = E.swap_ranges(frame([1, 2], "a"), frame([3, 4], "b"), "a", "b").orderBy("pos").collect()
    assert [(r["a"], r["b"]) for r in swapped] == [(3, 1), (4, 2)]
    needles = spark.createDataFrame([(3,), (9,)], "w long")
    assert one(Q.find_first_of(Seq(frame([5, 3, 9], "a"), "pos", dense=True, pos="p"), "a", needles, "w")) == 1


def test_extremum_ties_and_empty(spark):
    df = spark.createDataFrame([(1, 5), (2, 9), (3, 9)], "k long, v long")
    assert A.extremum(df, "v", "k").first()["k"] == 3
    assert A.extremum(df.filter("k > 9"), "v", "k").first()["k"] is None


def test_kmp_text(spark):
    texts = ["aaaa", "", None, "abcabc", "a.a.a", "xx"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for needle in ("aa", "abc", ".", "a.a", ""):
        want = [[i for i in range(len(t or "")) if needle and (t or "").startswith(needle, i)] for t in texts]
        assert [r["positions"] for r in Q.kmp(df, "t", needle).orderBy("i").collect()] == want
        assert [r["hits"] for r in Q.kmp_count(df, "t", needle).orderBy("i").collect()] == list(map(len, want))


def test_arrays(spark):
    df = spark.sql("SELECT array(1L, 2L, 3L) AS v")
    a = F.col("v")
    row = df.select(nested.push_back(a, F.lit(4).cast("long")), nested.pop_back(a), nested.insert(a, 1, 9), nested.erase(a, 0, 2), nested.resize(a, 5, 0), nested.resize(a, 1, 0), nested.at(a, 5), nested.back(a), nested.clear(a), nested.pop_back(nested.clear(a))).first()
    assert list(row) == [[1, 2, 3, 4], [1, 2], [1, 9, 2, 3], [3], [1, 2, 3, 0, 0], [1], None, 3, [], []]


def test_flow(spark):
    assert flow.then(lambda: 1 / 0, lambda r: r.has_error)
    assert flow.any_of(lambda: 1 / 0, lambda: 7) == (1, 7)
    with pytest.raises(flow.CombinedError) as e:
        flow.any_of(lambda: 1 / 0, lambda: [][0])
    assert len(e.value.errors) == 2
    got = flow.parallel_invoke(spark, lambda: spark.range(9).count(), lambda: 1 / 0)
    assert got[0].get() == 9 and got[1].has_error
    word = lambda n: flow.if_(n, lambda x: x < 1, lambda _: "a").else_if(lambda x: x < 2, lambda _: "b").else_(lambda _: "c")
    assert [word(n) for n in range(3)] == ["a", "b", "c"]


def test_timeout_and_interrupt(spark):
    slow = spark.range(4).repartition(4).mapInPandas(lambda it: (__import__("time").sleep(30) or x for x in it), "id long")
    assert isinstance(flow.parallel_invoke(spark, slow.count, timeout=2)[0].error, TimeoutError)
    job = flow.Interruptible(spark, slow.count)
    __import__("time").sleep(2)
    job.interrupt()
    assert job.wait(25).has_error


def test_polygons(spark):
    tri = [(0.0, 0.0), (4.0, 0.0), (0.0, 4.0)]
    box = [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]
    ring = lambda r: [{"x": x, "y": y} for x, y in r]
    df = spark.createDataFrame([(1, ring(tri), ring(box))], f"id long, a {geometry.RING}, b {geometry.RING}")
    assert geometry.intersection(df, "a", "b").select(geometry.ring_area("ring")).first()[0] == pytest.approx(2.0)
    both = df.select(F.explode(F.array("a", "b")).alias("ring"))
    total = geometry.union_all(both, "ring", 1.5).agg(F.sum(geometry.ring_area("piece"))).first()[0]
    assert total == pytest.approx(8 + 4 - 2)
    assert geometry.intersection_all(both, "ring").select(geometry.ring_area("ring")).first()[0] == pytest.approx(2.0)


def test_plan_has_no_single_partition_of_rows(spark):
    s = Seq(spark.range(1000).withColumnRenamed("id", "k"), "k", block=16)
    plan = S.inclusive_scan(s, "k")._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window" in x]
    assert windows and any("_block" in x.split("windowspecdefinition")[-1] for x in windows)
