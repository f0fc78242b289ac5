"""Sorts, top-k, selection and merging. Many names, one implementation: a range partitioned sort with spill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.order import with_pos


def sort(df: DataFrame, *keys: str | Column, stable_by: tuple[str, ...] = ()) -> DataFrame:
    """Rows in order; ``stable_by`` (the old position) ends the order of a stable sort."""
    return df.orderBy(*keys, *stable_by)


stable_sort = sort
quicksort = spreadsort = indirect_sort = intro_sort = spin_sort = boost_stable_sort = sort
sort2 = stable_sort2 = spreadsort2 = sort
sort_inplace = stable_sort_inplace = spreadsort_inplace = sort
sort_move_inplace = stable_sort_move_inplace = spreadsort_move_inplace = sort
quick_spreadsort = quick_spin_sort = quick_indirect_sort = quick_intro_sort = sort


def sorted_positions(df: DataFrame, keys: list[str], *cols: str, pos: str = "pos") -> DataFrame:
    """What a sort does to each row: its position in the order, without one task seeing all rows."""
    return with_pos(df, keys, pos).select(pos, *cols)


def partial_sort(df: DataFrame, k: int, *keys: str | Column) -> DataFrame:
    """The first k rows in order: a heap of k in each task."""
    return df.orderBy(*keys).limit(k)


def nth_element(df: DataFrame, n: int, *keys: str | Column) -> DataFrame:
    """The row at position n of the order."""
    return df.orderBy(*keys).offset(n).limit(1)


def nth_element_deep(df: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The same for an n too deep for one task's heap: by positions."""
    return with_pos(df, keys, "_pos").filter(F.col("_pos") == n).drop("_pos")


def merge(a: DataFrame, b: DataFrame, key: str, *ties: str) -> DataFrame:
    """The union of two sequences by key; of equals the first sequence's come first, each in its own order. ``src`` tells them apart."""
    both = a.withColumn("src", F.lit(0)).unionByName(b.withColumn("src", F.lit(1)))
    return both.orderBy(key, "src", *ties)


def concat(*frames: DataFrame) -> DataFrame:
    """Sequences one after the other: ``src`` and their own order give the order."""
    out = None
    for i, df in enumerate(frames):
        df = df.withColumn("src", F.lit(i))
        out = df if out is None else out.unionByName(df)
    return out
