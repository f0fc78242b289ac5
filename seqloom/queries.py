"""One query for each operator over the test tables, with SQL that says the same."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import topics
from .operators import aggregating as A
from .operators import elementwise as E
from .operators import flow, geometry, nested
from .operators import scanning as S
from .operators import searching as Q
from .operators import selecting as P
from .operators import sorting as O
from .plans.order import Seq
from .sources import generate as G

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
LINE_SQL = ", ".join(LINE)


def query(sql: str | None, *names: str):
    """Register a query under its name and further ones."""

    def add(f):
        for name in (f.__name__.removesuffix("_"), *names):
            QUERIES[name] = f
            if sql:
                SQL[name] = sql
        return f

    return add


def events(spark: SparkSession, d: str) -> Seq:
    return Seq(G.table(spark, d, "events"), "event_id", dense=True)


def orders(spark: SparkSession, d: str) -> Seq:
    return Seq(G.table(spark, d, "orders"), "o_orderkey", dense=True)


def lines(spark: SparkSession, d: str) -> Seq:
    return Seq(G.table(spark, d, "lineitem"), *LINE)


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


# Sources and elements


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS revenue FROM lineitem")
def transform_unary(spark, d):
    df = E.transform(G.table(spark, d, "lineitem"), "revenue", lambda p, x: F.round(p * 100).cast("long") * (100 - F.round(x * 100).cast("long")), "l_extendedprice", "l_discount")
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "revenue")


@query("SELECT event_id, ts, user_id, event_type, CAST(round(value * 100) AS BIGINT) + 1 AS value FROM events")
def for_in_place(spark, d):
    df = E.for_each_in_place(G.table(spark, d, "events"), "value", lambda v: F.round(v * 100).cast("long"))
    return E.for_each_in_place(df, "value", lambda v: v + 1).select("event_id", "ts", "user_id", "event_type", "value")


@query("SELECT o_orderkey, 7 AS x FROM orders")
def fill(spark, d):
    return G.fill(orders(spark, d).df, "x", 7).select("o_orderkey", "x")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 + 42 AS x FROM orders")
def iota(spark, d):
    return G.iota(orders(spark, d).indexed(), "pos", 42, "x").select("o_orderkey", "x")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) * 31 % 1000 AS x FROM orders")
def generate(spark, d):
    return G.generate(orders(spark, d).indexed(), "pos", lambda p: p * 31 % 1000, "x").select("o_orderkey", "x")


@query("SELECT range AS pos, 2 * range * range + 1 AS value FROM range(100000)")
def lazy_irange(spark, d):
    return G.lazy_irange(spark, 0, 100000, lambda i: 2 * i * i + 1)


@query("SELECT range AS pos, 0 AS value FROM range(50000)")
def make_range(spark, d):
    return G.make_range(spark, 50000, 0)


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'tap' ELSE event_type END AS event_type FROM events")
def replace(spark, d):
    return E.replace(events(spark, d).df, "event_type", "click", "tap").select("event_id", "event_type")


@query("SELECT event_id, CASE WHEN event_type LIKE 'p%' THEN 'p' ELSE event_type END AS event_type FROM events")
def replace_if(spark, d):
    return E.replace_if(events(spark, d).df, "event_type", lambda c: c.startswith("p"), "p").select("event_id", "event_type")


@query("SELECT event_id, event_type, CASE WHEN event_type = 'view' THEN 'seen' ELSE event_type END AS kind FROM events")
def replace_copy(spark, d):
    return E.replace(events(spark, d).df, "event_type", "view", "seen", "kind").select("event_id", "event_type", "kind")


@query("SELECT event_id, value, CASE WHEN value > 50 THEN 50.0::DOUBLE ELSE value END AS capped FROM events")
def replace_copy_if(spark, d):
    return E.replace_if(events(spark, d).df, "value", lambda c: c > 50, 50.0, "capped").select("event_id", "value", "capped")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey, o_totalprice FROM orders", "move", "move_if_noexcept")
def copy(spark, d):
    return E.copy(orders(spark, d), "o_orderkey", "o_totalprice")


@query("SELECT row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS pos, o_orderkey, o_totalprice FROM orders")
def reverse(spark, d):
    return E.reverse(orders(spark, d), "o_orderkey", "o_totalprice")


# Selection


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'purchase' AND value > 10")
def find_all(spark, d):
    return P.find_all(events(spark, d).df, (F.col("event_type") == "purchase") & (F.col("value") > 10)).select("event_id", "event_type", "value")


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, event_id, value FROM events WHERE value > 30")
def copy_if(spark, d):
    return P.copy_if(events(spark, d), F.col("value") > 30, "event_id", "value")


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, event_id, event_type FROM events WHERE event_type <> 'click'")
def remove_copy(spark, d):
    return P.remove_copy(events(spark, d), F.col("event_type") == "click", "event_id", "event_type")


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, event_id, value FROM events WHERE NOT (value > 30)")
def remove_copy_if(spark, d):
    return P.remove_copy(events(spark, d), F.col("value") > 30, "event_id", "value")


def _quantifier(name, f, pred, cond, empty):
    sql = f"SELECT {cond} AS result FROM events"
    QUERIES[name] = lambda spark, d: f(events(spark, d).df, pred())
    SQL[name] = sql
    QUERIES[f"{name}_empty"] = lambda spark, d: f(events(spark, d).df.filter("event_id < 0"), pred())
    SQL[f"{name}_empty"] = f"SELECT {empty} AS result"


_quantifier("all_of", P.all_of, lambda: F.col("value") >= 0, "bool_and(value >= 0)", "true")
_quantifier("any_of", P.any_of, lambda: F.col("event_type") == "refund", "bool_or(event_type = 'refund')", "false")
_quantifier("none_of", P.none_of, lambda: F.col("value") > 1e9, "NOT bool_or(value > 1e9)", "true")


@query("SELECT row_number() OVER (ORDER BY o_totalprice > 200000 DESC, o_orderkey) - 1 AS pos, o_orderkey, o_totalprice FROM orders")
def stable_partition(spark, d):
    return P.stable_partition(orders(spark, d), F.col("o_totalprice") > 200000, "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice > 200000 AS first FROM orders")
def partition(spark, d):
    return P.partition(orders(spark, d).df, F.col("o_totalprice") > 200000).select("o_orderkey", "first")


@query("SELECT count(*) FILTER (o_totalprice > 200000) AS point FROM orders")
def partition_point(spark, d):
    return P.partition_point(orders(spark, d).df, F.col("o_totalprice") > 200000)


@query("SELECT o_totalprice > 200000 AS matched, row_number() OVER (PARTITION BY o_totalprice > 200000 ORDER BY o_orderkey) - 1 AS pos, o_orderkey FROM orders")
def partition_copy(spark, d):
    return P.partition_copy(orders(spark, d), F.col("o_totalprice") > 200000, "o_orderkey")


@query("SELECT coalesce(max(o_orderkey) FILTER (o_orderkey < 500) < min(o_orderkey) FILTER (NOT o_orderkey < 500), true) AS result FROM orders")
def is_partitioned(spark, d):
    return P.is_partitioned(orders(spark, d), F.col("o_orderkey") < 500)


@query("SELECT coalesce(max(o_orderkey) FILTER (o_totalprice > 200000) < min(o_orderkey) FILTER (NOT o_totalprice > 200000), true) AS result FROM orders")
def is_partitioned_not(spark, d):
    return P.is_partitioned(orders(spark, d), F.col("o_totalprice") > 200000)


# Aggregation


@query("SELECT count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem", "count")
def count_if(spark, d):
    return A.count_if(G.table(spark, d, "lineitem"), F.col("l_returnflag") == "R")


@query("SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem")
def reduce_sum(spark, d):
    return A.reduce(G.table(spark, d, "lineitem"), F.sum(F.col("l_quantity").cast("long")).alias("total"))


@query("SELECT CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, max(l_quantity) AS most, min(l_shipdate) AS first FROM lineitem")
def reduce_map_combine(spark, d):
    return A.reduce(G.table(spark, d, "lineitem"), F.sum(cents("l_extendedprice")).alias("cents"), F.max("l_quantity").alias("most"), F.min("l_shipdate").alias("first"))


@query("SELECT string_agg(n_name, '|' ORDER BY n_nationkey) AS result FROM nation")
def reduce_ordered(spark, d):
    return A.reduce_ordered(Seq(G.table(spark, d, "nation"), "n_nationkey", block=4), "n_name", lambda a, b: f"{a}|{b}", "string")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey DESC LIMIT 1")
def extremum_min(spark, d):
    return A.extremum(orders(spark, d).df, "o_totalprice", "o_orderkey", largest=False).select("o_orderkey", "o_totalprice")


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 1")
def extremum_max_row(spark, d):
    return A.extremum(orders(spark, d).df, "o_totalprice", "o_orderkey")


@query("SELECT count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents, min(value) AS low, max(value) AS high FROM events")
def for_each_stats(spark, d):
    return A.for_each(events(spark, d).df, n=F.count(F.lit(1)), cents=F.sum(cents("value")), low=F.min("value"), high=F.max("value"))


@query("SELECT CAST(sum(user_id % 7) AS BIGINT) AS result FROM events")
def for_each_merge(spark, d):
    return A.for_each_merge(events(spark, d).df, "user_id", lambda: 0, lambda s, v: s + v % 7, lambda a, b: a + b, "long")


@query("SELECT user_id, list(event_id ORDER BY event_id) AS items FROM events GROUP BY user_id")
def group_by(spark, d):
    return A.group_by(events(spark, d), "user_id", "event_id", "items")


@query("SELECT user_id, event_id, event_id - min(event_id) OVER (PARTITION BY user_id) AS since FROM events")
def grouped_transform(spark, d):
    return A.grouped_transform(events(spark, d).df, "user_id", "since", lambda w: F.col("event_id") - F.min("event_id").over(w)).select("user_id", "event_id", "since")


@query("SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name DESC) - 1 AS place FROM nation")
def grouped_for(spark, d):
    def place(pdf):
        pdf = pdf.sort_values("n_name", ascending=False)
        return pdf[["n_regionkey", "n_nationkey"]].assign(place=range(len(pdf)))

    return A.grouped_for(G.table(spark, d, "nation"), "n_regionkey", place, "n_regionkey int, n_nationkey int, place long")


@query("SELECT CAST(sum(CAST(round(a.o_totalprice * 100) AS BIGINT) * (b.o_custkey % 10)) + 42 AS BIGINT) AS result FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1")
def inner_product(spark, d):
    o = orders(spark, d)
    a = o.select(cents("o_totalprice").alias("a"))
    b = o.df.filter("o_orderkey > 0").select((F.col("o_orderkey") - 1).alias("pos"), (F.col("o_custkey") % 10).alias("b"))
    return A.inner_product(a, b, "a", "b", 42)


# Positions of two sequences


@query("SELECT a.o_orderkey AS pos, a.o_custkey + b.o_custkey AS value FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1")
def transform_binary(spark, d):
    o = orders(spark, d)
    b = o.df.filter("o_orderkey > 0").select((F.col("o_orderkey") - 1).alias("pos"), F.col("o_custkey").alias("c"))
    return E.transform_zip("value", lambda x, y: x + y, (o.indexed(), "o_custkey"), (b, "c"))


@query("SELECT p_partkey AS pos, p_size + c_nationkey + CAST(o_custkey AS BIGINT) AS value FROM part JOIN customer ON p_partkey = c_custkey JOIN orders ON o_orderkey = p_partkey")
def transform_nary(spark, d):
    p, c = Seq(G.table(spark, d, "part"), "p_partkey", dense=True), Seq(G.table(spark, d, "customer"), "c_custkey", dense=True)
    return E.transform_zip("value", lambda x, y, z: x + y + z, (p.indexed(), "p_size"), (c.indexed(), "c_nationkey"), (orders(spark, d).indexed(), "o_custkey"))


@query("SELECT p_partkey AS pos, c_name AS p_name, p_name AS c_name FROM part JOIN customer ON p_partkey = c_custkey")
def swap_ranges(spark, d):
    p, c = Seq(G.table(spark, d, "part"), "p_partkey", dense=True), Seq(G.table(spark, d, "customer"), "c_custkey", dense=True)
    return E.swap_ranges(p.indexed(), c.indexed(), "p_name", "c_name")


def _shifted(spark, d):
    """Part sizes, and the same with one changed in the middle."""
    p = Seq(G.table(spark, d, "part"), "p_partkey", dense=True).indexed()
    return p.select("pos", F.col("p_size").alias("a")), p.select("pos", F.when(F.col("pos") == 150, 0).otherwise(F.col("p_size")).alias("b"))


@query("SELECT count(*) = 0 AS result FROM part WHERE p_partkey = 150 AND p_size <> 0")
def equal(spark, d):
    return Q.equal(*_shifted(spark, d), "a", "b")


@query("SELECT min(p_partkey) AS pos FROM part WHERE p_partkey = 150 AND p_size <> 0")
def mismatch(spark, d):
    return Q.mismatch(*_shifted(spark, d), "a", "b")


@query("SELECT coalesce((SELECT p_size < 0 FROM part WHERE p_partkey = 150 AND p_size <> 0), false) AS result")
def lexicographical_compare(spark, d):
    return Q.lexicographical_compare(*_shifted(spark, d), "a", "b")


# Searches

NEXT = "SELECT event_id AS pos, event_type AS a, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (ORDER BY event_id)"


@query(f"SELECT min(pos) AS pos FROM ({NEXT}) WHERE a = b")
def adjacent_find(spark, d):
    return Q.adjacent_find(events(spark, d), "event_type")


@query("SELECT min(event_id) AS pos FROM events WHERE event_type IN ('purchase', 'refund')")
def find_first_of(spark, d):
    return Q.find_first_of(events(spark, d), "event_type", spark.createDataFrame([("purchase",), ("refund",)], ["w"]), "w")


@query(f"SELECT min(pos) AS pos FROM ({NEXT}) WHERE a = 'click' AND b = 'view' AND c = 'purchase'")
def search(spark, d):
    return Q.search(events(spark, d), "event_type", ["click", "view", "purchase"])


@query(f"SELECT max(pos) AS pos FROM ({NEXT}) WHERE a = 'click' AND b = 'view' AND c = 'purchase'")
def find_end(spark, d):
    return Q.find_end(events(spark, d), "event_type", ["click", "view", "purchase"])


@query(f"SELECT pos FROM ({NEXT}) WHERE a = 'click' AND b = 'click'")
def kmp_sequence(spark, d):
    return Q.occurrences(events(spark, d), "event_type", ["click", "click"])


@query(f"SELECT min(pos) AS pos FROM ({NEXT}) WHERE a = 'click' AND b = 'click' AND c = 'click'")
def search_n(spark, d):
    return Q.search_n(events(spark, d), "event_type", 3, "click")


@query("SELECT doc_id, list_filter(range(0, length(coalesce(text, ''))), lambda i: substr(text, i + 1, 3) = 'ere') AS positions FROM documents")
def kmp_text(spark, d):
    return Q.kmp(G.table(spark, d, "documents"), "text", "ere").select("doc_id", "positions")


@query("SELECT doc_id, len(list_filter(range(0, length(coalesce(text, ''))), lambda i: substr(text, i + 1, 4) = 'enen'))::BIGINT AS hits FROM documents")
def kmp_text_count(spark, d):
    return Q.kmp_count(G.table(spark, d, "documents"), "text", "enen").select("doc_id", "hits")


# Scans


@query("SELECT event_id, CAST(100 + sum(CAST(round(value * 100) AS BIGINT)) OVER (ORDER BY event_id) AS BIGINT) AS scan FROM events", "transform_inclusive_scan")
def inclusive_scan(spark, d):
    return S.transform_inclusive_scan(events(spark, d), cents("value"), 100).select("event_id", "scan")


@query("SELECT event_id, CAST(7 + coalesce(sum(user_id) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan FROM events")
def exclusive_scan(spark, d):
    return S.exclusive_scan(events(spark, d), "user_id", 7).select("event_id", "scan")


@query("SELECT event_id, CAST(coalesce(sum(user_id * 2) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan FROM events")
def transform_exclusive_scan(spark, d):
    return S.transform_exclusive_scan(events(spark, d), F.col("user_id") * 2).select("event_id", "scan")


@query(f"SELECT {LINE_SQL}, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (ORDER BY {LINE_SQL} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS scan FROM lineitem")
def partial_sum(spark, d):
    seq = Seq(G.table(spark, d, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("long")), *LINE)
    return S.partial_sum(seq, "l_quantity").select(*LINE, "scan")


@query("SELECT event_id, max(value) OVER (ORDER BY event_id) AS scan FROM events")
def scan_max(spark, d):
    return S.inclusive_scan(events(spark, d), "value", kind="max").select("event_id", "scan")


@query("SELECT event_id, bit_xor(user_id) OVER (ORDER BY event_id) AS scan FROM events")
def scan_xor(spark, d):
    return S.inclusive_scan(events(spark, d), "user_id", kind="xor").select("event_id", "scan")


@query("SELECT event_id, bit_xor(user_id) OVER (ORDER BY event_id) AS scan FROM events")
def scan_generic(spark, d):
    return S.scan_with(events(spark, d), "user_id", lambda a, b: a ^ b, 0, "long").select("event_id", "scan")


@query("SELECT CAST(sum(user_id) AS BIGINT) AS total FROM events")
def scan_total(spark, d):
    return S.scan_total(events(spark, d), F.col("user_id"))


# Order


@query("SELECT true AS result")
def is_sorted(spark, d):
    return S.is_sorted(events(spark, d), "ts")


@query("SELECT NOT coalesce(bool_or(value < before), false) AS result FROM (SELECT value, lag(value) OVER (ORDER BY event_id) AS before FROM events)")
def is_sorted_not(spark, d):
    return S.is_sorted(events(spark, d), "value")


@query("SELECT NOT coalesce(bool_or(ts > before), false) AS result FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS before FROM events)")
def is_reverse_sorted(spark, d):
    return S.is_sorted(events(spark, d), "ts", reverse=True)


@query("SELECT event_id AS pos, event_type FROM (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before")
def unique(spark, d):
    return S.unique(events(spark, d), "event_type", "event_type")


@query("SELECT DISTINCT user_id FROM events")
def unique_sorted(spark, d):
    return events(spark, d).df.select("user_id").distinct()


SORTED = "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos, o_orderkey, o_totalprice FROM orders"
SORTS = ("sort", "stable_sort", "boost_stable_sort", "spreadsort", "indirect_sort", "intro_sort", "spin_sort", "quicksort", "quick_spreadsort", "quick_spin_sort", "quick_indirect_sort", "quick_intro_sort", "sort2", "stable_sort2", "spreadsort2", "sort_inplace", "stable_sort_inplace", "spreadsort_inplace", "sort_move_inplace", "stable_sort_move_inplace", "spreadsort_move_inplace")


@query(SORTED, *SORTS[1:])
def sort(spark, d):
    """All sorts are one: what they differ in is how they work, not what they give."""
    return O.sorted_positions(orders(spark, d).df, ["o_totalprice", "o_orderkey"], "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def partial_sort(spark, d):
    return O.partial_sort(orders(spark, d).df, 100, F.col("o_totalprice").desc(), "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET 700")
def nth_element(spark, d):
    return O.nth_element(orders(spark, d).df, 700, "o_totalprice", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET 1000")
def nth_element_deep(spark, d):
    return O.nth_element_deep(orders(spark, d).df, 1000, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT row_number() OVER (ORDER BY acctbal, src, key) - 1 AS pos, src, key, acctbal FROM (SELECT 0 AS src, c_custkey AS key, c_acctbal AS acctbal FROM customer UNION ALL SELECT 1, s_suppkey, s_acctbal FROM supplier)")
def merge(spark, d):
    a = G.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("acctbal"))
    b = G.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("acctbal"))
    return O.sorted_positions(O.concat(a, b), ["acctbal", "src", "key"], "src", "key", "acctbal")


@query("SELECT src, key FROM (SELECT 0 AS src, c_custkey AS key FROM customer UNION ALL SELECT 1, s_suppkey FROM supplier UNION ALL SELECT 2, p_partkey FROM part)")
def merge_containers(spark, d):
    cols = (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))
    return O.concat(*[G.table(spark, d, t).select(F.col(c).alias("key")) for t, c in cols])


# Arrays


@query("SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS inner, unnest(embedding) AS value FROM embeddings")
def flatten(spark, d):
    return nested.flatten(G.table(spark, d, "embeddings"), "vec_id", "embedding")


@query("SELECT vec_id, flatten([[1, 2], [label], []]) AS flat FROM embeddings")
def flatten_row(spark, d):
    e = F.array(F.array(F.lit(1), F.lit(2)), F.array("label"), F.array().cast("array<int>"))
    return G.table(spark, d, "embeddings").select("vec_id", nested.flatten_row(e).alias("flat"))


VEC = "SELECT vec_id, [CAST(vec_id % 5 AS BIGINT), 3, vec_id, 4] AS v FROM embeddings"


def _vec(spark, d):
    return G.table(spark, d, "embeddings").select("vec_id", F.array(F.col("vec_id") % 5, F.lit(3).cast("long"), F.col("vec_id"), F.lit(4).cast("long")).alias("v"))


def _vector(name, f, sql):
    QUERIES[f"vector_{name}"] = lambda spark, d: _vec(spark, d).select("vec_id", f(F.col("v")).alias("x"))
    SQL[f"vector_{name}"] = f"SELECT vec_id, {sql} AS x FROM ({VEC})"


_vector("push_back", lambda v: nested.push_back(v, F.lit(9).cast("long")), "list_append(v, 9)")
_vector("pop_back", nested.pop_back, "v[1:3]")
_vector("insert", lambda v: nested.insert(v, 1, 7, 8), "[v[1], 7, 8] || v[2:4]")
_vector("erase", lambda v: nested.erase(v, 1, 3), "[v[1], v[4]]")
_vector("resize", lambda v: nested.resize(v, 6, 0), "v || [0, 0]")
_vector("resize_down", lambda v: nested.resize(v, 2, 0), "v[1:2]")
_vector("at", lambda v: nested.at(v, 2), "v[3]")
_vector("front", nested.front, "v[1]")
_vector("back", nested.back, "v[4]")
_vector("size", nested.size, "CAST(len(v) AS BIGINT)")
_vector("empty", nested.empty, "len(v) = 0")
_vector("clear", nested.clear, "CAST([] AS BIGINT[])")
_vector("reverse", F.reverse, "list_reverse(v)")
_vector("compare", lambda v: nested.less(v, F.array(F.lit(2), F.lit(3), F.lit(50), F.lit(4)).cast("array<bigint>")), "v < [2, 3, 50, 4]")
_vector("assign", lambda v: nested.assign(3, 5), "[5, 5, 5]")


# Composition


@query("SELECT CAST(4000000 * sum(CASE WHEN range % 2 = 0 THEN 1 ELSE -1 END * (1000000 // (2 * range + 1))) AS BIGINT) AS result FROM range(1000)")
def invoke_pi(spark, d):
    """Pi as four times the sum of a generated sequence, in whole numbers."""
    terms = G.lazy_irange(spark, 0, 1000, lambda i: F.when(i % 2 == 0, 1).otherwise(-1) * F.expr("1000000L DIV (2 * id + 1)"))
    return flow.invoke(A.reduce(terms, F.sum("value").alias("result")), lambda c: c * 4000000)


@query("SELECT count(*) AS n FROM events WHERE event_type = 'click'")
def then(spark, d):
    return flow.then(lambda: events(spark, d).df, lambda r: r.get().filter(F.col("event_type") == "click")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (SELECT count(*) FROM events) AS a, (SELECT count(*) FROM orders) AS b")
def all_of_results(spark, d):
    n = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    return flow.all_of(n(events(spark, d).df, "a"), n(orders(spark, d).df, "b"))


@query("SELECT event_id, CASE WHEN value > 50 THEN 0 ELSE 1 END AS index, CASE WHEN value > 50 THEN value ELSE CAST(user_id AS DOUBLE) END AS value FROM events")
def any_of_values(spark, d):
    first = flow.first_value(F.when(F.col("value") > 50, F.col("value")), F.col("user_id").cast("double"))
    return events(spark, d).df.select("event_id", first.alias("r")).select("event_id", "r.index", "r.value")


@query("SELECT CASE WHEN count(*) > 100 THEN 'many' ELSE 'few' END AS result FROM orders")
def if_then_else(spark, d):
    n = flow.scalar(orders(spark, d).df.agg(F.count(F.lit(1))))
    word = flow.if_then_else(n, lambda x: x > 100, lambda _: "many", lambda _: "few")
    return spark.createDataFrame([(word,)], "result string")


@query("SELECT CASE WHEN count(*) < 10 THEN 'tiny' WHEN count(*) < 1000000 THEN 'middling' ELSE 'large' END AS result FROM customer")
def if_else_chain(spark, d):
    n = flow.scalar(G.table(spark, d, "customer").agg(F.count(F.lit(1))))
    word = flow.if_(n, lambda x: x < 10, lambda _: "tiny").else_if(lambda x: x < 1000000, lambda _: "middling").else_(lambda _: "large")
    return spark.createDataFrame([(word,)], "result string")


@query("SELECT 0 AS task, (SELECT count(*) FROM events) AS n UNION ALL SELECT 1, (SELECT count(*) FROM orders)")
def parallel_invoke(spark, d):
    got = flow.parallel_invoke(spark, events(spark, d).df.count, orders(spark, d).df.count)
    return spark.createDataFrame([(i, x.get()) for i, x in enumerate(got)], "task int, n long")


# Topics


def _topics(spark, d):
    return events(spark, d).df.select("event_id", F.concat_ws("/", "event_type", F.pmod("user_id", F.lit(10)).cast("string"), "user_id").alias("topic"))


TOPICS = "SELECT event_id, topic FROM (SELECT event_id, event_type || '/' || user_id % 10 || '/' || user_id AS topic FROM events)"


@query(f"{TOPICS} WHERE topic = 'click/3/3'")
def topic_exact(spark, d):
    return _topics(spark, d).filter(topics.exact_topic(F.col("topic"), "click/3/3"))


@query(f"{TOPICS} WHERE topic = 'click/3' OR starts_with(topic, 'click/3/')")
def topic_channel(spark, d):
    return _topics(spark, d).filter(topics.channel_topic(F.col("topic"), "click/3/"))


@query(f"{TOPICS} WHERE regexp_matches(topic, '^click/[^/]+/17(/.*)?$')")
def topic_wildcard(spark, d):
    return _topics(spark, d).filter(topics.channel_topic(F.col("topic"), "click/./17"))


@query("SELECT event_id, event_type FROM events WHERE event_type = 'purchase' OR starts_with(event_type, 'purchase/')")
def stream_subscribe(spark, d):
    """A subscription to a file stream, run to the end of what is there."""
    df = spark.readStream.schema(G.table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    kept = df.filter(topics.channel_topic(F.col("event_type"), "purchase")).select("event_id", "event_type")
    at = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="seqloom-")
    out = f"{at}/bus-{abs(hash((d, id(df))))}"
    kept.writeStream.format("parquet").option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(kept.schema).parquet(out)


# Geometry, over all orders. Each 2,000 ids have a field of the plane of their own, so the plane grows with the ids and boxes of two fields never meet.

FIELD = 2000
BOXES_WHOLE = f"SELECT o_orderkey AS id, o_orderkey // {FIELD} * 128 + o_custkey % 97 AS minx, o_orderkey % 89 AS miny, o_orderkey // {FIELD} * 128 + o_custkey % 97 + 1 + o_orderkey % 7 AS maxx, o_orderkey % 89 + 1 + o_custkey % 5 AS maxy FROM orders"


def _boxes_whole(spark, d):
    k, c = F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long")
    x, y = F.floor(k / FIELD) * 128 + c % 97, k % 89
    return orders(spark, d).df.select(k.alias("id"), x.alias("minx"), y.alias("miny"), (x + 1 + k % 7).alias("maxx"), (y + 1 + c % 5).alias("maxy"))


def _ring():
    x, y, X, Y = (F.col(c).cast("double") for c in ("minx", "miny", "maxx", "maxy"))
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.array(p(x, y), p(X, y), p(X, Y), p(x, Y))


@query(f"SELECT max(minx) AS minx, max(miny) AS miny, min(maxx) AS maxx, min(maxy) AS maxy, max(minx) >= min(maxx) OR max(miny) >= min(maxy) AS empty FROM ({BOXES_WHOLE})")
def geo_box_intersection_whole(spark, d):
    return geometry.box_intersection(_boxes_whole(spark, d), "minx", "miny", "maxx", "maxy")


AREA_WHOLE = f"SELECT count(*) AS area FROM (SELECT DISTINCT x, unnest(range(miny, maxy)) AS y FROM (SELECT unnest(range(minx, maxx)) AS x, miny, maxy FROM ({BOXES_WHOLE})))"


@query(AREA_WHOLE)
def geo_box_union_area_whole(spark, d):
    return geometry.box_union_area(_boxes_whole(spark, d))


@query(f"WITH b AS ({BOXES_WHOLE}) SELECT a.id AS a_id, b.id AS b_id, greatest(a.minx, b.minx) AS minx, greatest(a.miny, b.miny) AS miny, least(a.maxx, b.maxx) AS maxx, least(a.maxy, b.maxy) AS maxy FROM b a JOIN b ON a.id // {FIELD} = b.id // {FIELD} AND a.id < b.id AND a.minx < b.maxx AND b.minx < a.maxx AND a.miny < b.maxy AND b.miny < a.maxy")
def geo_box_overlaps_whole(spark, d):
    b = _boxes_whole(spark, d)
    return geometry.box_overlaps(b, b, 8).filter("a_id < b_id")


@query(AREA_WHOLE)
def geo_polygon_union_whole(spark, d):
    pieces = geometry.union_all(_boxes_whole(spark, d).select(_ring().alias("ring")), "ring", 8.0)
    return pieces.agg(F.round(F.coalesce(F.sum(geometry.ring_area("piece")), F.lit(0.0))).cast("long").alias("area"))


@query(f"WITH b AS ({BOXES_WHOLE}) SELECT a.id, greatest(0, least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * greatest(0, least(a.maxy, b.maxy) - greatest(a.miny, b.miny)) AS area FROM b a JOIN b ON b.id = a.id + 89")
def geo_polygon_intersection_whole(spark, d):
    r = _boxes_whole(spark, d).select("id", _ring().alias("ring"))
    both = r.select("id", F.col("ring").alias("a")).join(r.select((F.col("id") - 89).alias("id"), F.col("ring").alias("b")), "id")
    return geometry.intersection(both, "a", "b").select("id", F.round(geometry.ring_area("ring")).cast("long").alias("area"))


@query("SELECT greatest(0, min(200 + o_orderkey % 7) - max(o_custkey % 97)) * greatest(0, min(200 + o_custkey % 5) - max(o_orderkey % 89)) AS area FROM orders")
def geo_polygon_intersection_all_whole(spark, d):
    """Boxes that all hold a common middle, so that no task can stop early."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    wide = orders(spark, d).df.select((c % 97).alias("minx"), (k % 89).alias("miny"), (200 + k % 7).alias("maxx"), (200 + c % 5).alias("maxy"))
    out = geometry.intersection_all(wide.select(_ring().alias("ring")), "ring")
    return out.select(F.round(geometry.ring_area("ring")).cast("long").alias("area"))


# The flagship


def revenue_by_supplier(line: DataFrame, top: int = 10) -> DataFrame:
    """Select, transform, reduce by key and keep the top: suppliers by revenue of returned lines, in hundredths of cents."""
    returned = P.find_all(line, F.col("l_returnflag") == "R")
    priced = E.transform(returned, "revenue", lambda p, x: F.round(p * 100).cast("long") * (100 - F.round(x * 100).cast("long")), "l_extendedprice", "l_discount")
    return O.partial_sort(priced.groupBy("l_suppkey").agg(F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("n")), top, F.col("revenue").desc(), "l_suppkey")


@query("SELECT l_suppkey, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS BIGINT) AS revenue, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_suppkey ORDER BY revenue DESC, l_suppkey LIMIT 10")
def flagship_revenue(spark, d):
    return revenue_by_supplier(G.table(spark, d, "lineitem"))



