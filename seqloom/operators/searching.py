"""Searches that return positions: 0-based, null for not found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.order import POS_BLOCK, Seq, running, with_next, zipped

Equal = Callable[[Column, Column], Column]


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def find_first_of(seq: Seq, col: str, wanted: DataFrame, wanted_col: str, eq: Equal | None = None) -> DataFrame:
    """First position whose element equals any of the other range: a semi join, by hash for equality; a comparison of one's own scans the other range."""
    a, b = seq.select(F.col(col).alias("_a")), wanted.select(F.col(wanted_col).alias("_b")).distinct()
    hit = a.join(b, (eq or _same)(F.col("_a"), F.col("_b")), "left_semi")
    return hit.agg(F.min(seq.pos).alias("pos"))


def adjacent_find(seq: Seq, col: str, pred: Equal = _same) -> DataFrame:
    """First position i with pred(a[i], a[i + 1])."""
    a = seq.select(F.col(col).alias("_a"))
    n = a.agg(F.max(seq.pos).alias("_last"))
    two = with_next(a, seq.pos, {"_b": ("_a", 1)}).crossJoin(F.broadcast(n))
    return two.filter((F.col(seq.pos) < F.col("_last")) & pred(F.col("_a"), F.col("_b"))).agg(F.min(seq.pos).alias("pos"))


def occurrences(seq: Seq, col: str, needle: list, eq: Equal = _same) -> DataFrame:
    """(pos) of every occurrence of ``needle``, overlapping ones too; none for an empty needle. Matches across blocks count."""
    if not needle:
        return seq.df.sparkSession.createDataFrame([], "pos long")
    a = seq.select(F.col(col).alias("_a"))
    m = len(needle)
    if m == 1:
        hit = a.filter(eq(F.col("_a"), F.lit(needle[0])))
    elif m <= min(16, POS_BLOCK):
        # Followers come with whether they exist, as a value may be null.
        a = a.withColumn("_a", F.struct(F.col("_a").alias("v")))
        ahead = with_next(a, seq.pos, {f"_a{k}": ("_a", k) for k in range(1, m)})
        hit = ahead.filter(eq(F.col("_a")["v"], F.lit(needle[0])))
        for k in range(1, m):
            hit = hit.filter(F.col(f"_a{k}").isNotNull() & eq(F.col(f"_a{k}")["v"], F.lit(needle[k])))
    else:  # long needles: each element votes for the begin it fits
        ns = seq.df.sparkSession.createDataFrame([(j, v) for j, v in enumerate(needle)], ["_j", "_n"])
        votes = a.join(F.broadcast(ns), eq(F.col("_a"), F.col("_n"))).groupBy((F.col(seq.pos) - F.col("_j")).alias(seq.pos))
        hit = votes.agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") == m)
    return hit.select(F.col(seq.pos).alias("pos"))


def search(seq: Seq, col: str, needle: list, eq: Equal = _same) -> DataFrame:
    """First occurrence; an empty needle is found at 0."""
    if not needle:
        return seq.df.sparkSession.sql("SELECT 0L AS pos")
    return occurrences(seq, col, needle, eq).agg(F.min("pos").alias("pos"))


def find_end(seq: Seq, col: str, needle: list, eq: Equal = _same) -> DataFrame:
    """Last occurrence; an empty needle is found at the end: null."""
    return occurrences(seq, col, needle, eq).agg(F.max("pos").alias("pos"))


def search_n(seq: Seq, col: str, count: int, value, eq: Equal = _same) -> DataFrame:
    """First run of at least ``count`` consecutive matches. Runs are told apart by the number of rows before them that do not match."""
    a = seq.indexed().withColumn("_m", F.coalesce(eq(F.col(col), F.lit(value)), F.lit(False)))
    runs = running(a.select(seq.pos, "_m"), [seq.pos], {"_run": ("sum", (~F.col("_m")).cast("long"))}, POS_BLOCK)
    found = runs.filter("_m").groupBy("_run").agg(F.min(seq.pos).alias("_p"), F.count(F.lit(1)).alias("_n"))
    return found.filter(F.col("_n") >= count).agg(F.min("_p").alias("pos"))


def mismatch(a: DataFrame, b: DataFrame, col_a: str, col_b: str, pos: str = "pos") -> DataFrame:
    """First position of a where b differs or ends."""
    both = a.select(pos, F.col(col_a).alias("_a")).join(b.select(pos, F.col(col_b).alias("_b"), F.lit(True).alias("_there")), pos, "left")
    return both.filter(F.col("_there").isNull() | ~F.col("_a").eqNullSafe(F.col("_b"))).agg(F.min(pos).alias("pos"))


def equal(a: DataFrame, b: DataFrame, col_a: str, col_b: str, pos: str = "pos") -> DataFrame:
    """Whether b begins with a."""
    return mismatch(a, b, col_a, col_b, pos).select(F.col("pos").isNull().alias("result"))


def lexicographical_compare(a: DataFrame, b: DataFrame, col_a: str, col_b: str, pos: str = "pos") -> DataFrame:
    """Whether a comes before b in dictionary order: decided by the first position that differs or where one ends."""
    x = a.select(pos, F.struct(F.col(col_a).alias("v")).alias("_a"))
    y = b.select(pos, F.struct(F.col(col_b).alias("v")).alias("_b"))
    both = zipped(x, y, pos, "full").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    first = both.agg(F.min_by(F.struct("_a", "_b"), pos).alias("d"))
    d = F.col("d")
    return first.select(F.coalesce(F.when(d.isNull(), False).when(d["_a"].isNull(), True).when(d["_b"].isNull(), False).otherwise(d["_a"] < d["_b"]), F.lit(False)).alias("result"))


def kmp(df: DataFrame, text: str, needle: str, out: str = "positions") -> DataFrame:
    """Array of the 0-based places of every occurrence in a string, overlapping ones too; an empty needle matches nothing.

    The text is split before each occurrence, by a look-ahead; lengths add up to places.
    """
    if not needle:
        return df.withColumn(out, F.array().cast("array<bigint>"))
    c = F.coalesce(F.col(text), F.lit(""))
    sizes = F.transform(F.split(c, f"(?={_escaped(needle)})", -1), lambda p: F.length(p).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all"))
    ends = F.aggregate(sizes, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.array_append(s["all"], s["at"] + n).alias("all")), lambda s: F.slice(s["all"], 1, F.greatest(F.size(s["all"]) - 1, F.lit(0))))
    first = F.when(F.startswith(c, F.lit(needle)), F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.array_union(first, ends))


def _escaped(needle: str) -> str:
    import re

    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", needle)


def kmp_count(df: DataFrame, text: str, needle: str, out: str = "hits") -> DataFrame:
    """Number of occurrences, overlapping ones too, by a look-ahead."""
    if not needle:
        return df.withColumn(out, F.lit(0).cast("long"))
    return df.withColumn(out, F.coalesce(F.regexp_count(F.col(text), F.lit(f"(?={_escaped(needle)})")), F.lit(0)).cast("long"))
