"""Arrays in rows: flattening, and the vector's operations as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flatten(df: DataFrame, key: str, arr: str, out: str = "value") -> DataFrame:
    """(key, inner, value): each element with its place; (key, inner) is the order of the flat sequence."""
    return df.select(key, F.posexplode(arr).alias("inner", out)).withColumn("inner", F.col("inner").cast("long"))


def flatten_row(arr: str | Column) -> Column:
    return F.flatten(arr)


def make(n: Column | int, value) -> Column:
    return F.array_repeat(F.lit(value), n)


def push_back(arr: Column, value) -> Column:
    return F.array_append(arr, F.lit(value) if not isinstance(value, Column) else value)


def pop_back(arr: Column) -> Column:
    return F.slice(arr, 1, F.greatest(F.size(arr) - 1, F.lit(0)))


def at(arr: Column, i: int) -> Column:
    """0-based; null beyond the end."""
    return F.try_element_at(arr, F.lit(i + 1))


def front(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(1))


def back(arr: Column) -> Column:
    return F.try_element_at(arr, F.lit(-1))


def insert(arr: Column, i: int, *values) -> Column:
    """Values before the 0-based place i."""
    return F.concat(F.slice(arr, 1, i), F.array(*[F.lit(v) for v in values]), F.slice(arr, i + 1, F.greatest(F.size(arr) - i, F.lit(0))))


def erase(arr: Column, first: int, last: int | None = None) -> Column:
    """Without the elements from first up to, not with, last."""
    last = first + 1 if last is None else last
    return F.concat(F.slice(arr, 1, first), F.slice(arr, last + 1, F.greatest(F.size(arr) - last, F.lit(0))))


def resize(arr: Column, n: int, fill) -> Column:
    return F.concat(F.slice(arr, 1, n), F.array_repeat(F.lit(fill), F.greatest(F.lit(n) - F.size(arr), F.lit(0))))


def size(arr: Column) -> Column:
    return F.size(arr).cast("long")


def empty(arr: Column) -> Column:
    return F.size(arr) == 0


def clear(arr: Column) -> Column:
    return F.slice(arr, 1, 0)


def assign(n: int, value) -> Column:
    return F.array_repeat(F.lit(value), n)


def less(a: Column, b: Column) -> Column:
    """Lexicographic."""
    return a < b
