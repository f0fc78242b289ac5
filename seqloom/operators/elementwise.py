"""One output for each input element."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.order import Seq, zipped


def for_each_in_place(df: DataFrame, col: str, f: Callable[[Column], Column]) -> DataFrame:
    """Every value of ``col`` replaced by f of it; several of these fuse into one projection."""
    return df.withColumn(col, f(F.col(col)))


def for_chunks(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """The chunk form: f gets batches of a partition. Only where no Column expression says the same."""
    return df.mapInPandas(f, schema)


def transform(df: DataFrame, out: str, f: Callable[..., Column], *cols: str) -> DataFrame:
    """A new column: f of one or more columns of the same row."""
    return df.withColumn(out, f(*[F.col(c) for c in cols]))


def transform_zip(out: str, f: Callable[..., Column], *seqs: tuple[DataFrame, str], pos: str = "pos") -> DataFrame:
    """(pos, out): f of the values at equal positions of two or more sequences, given as (frame with pos, column)."""
    names = [f"_v{i}" for i in range(len(seqs))]
    frames = [df.select(pos, F.col(c).alias(n)) for (df, c), n in zip(seqs, names)]
    both = frames[0]
    for x in frames[1:]:
        both = zipped(both, x, pos)
    return both.select(pos, f(*[F.col(n) for n in names]).alias(out))


def replace(df: DataFrame, col: str, old, new, out: str | None = None) -> DataFrame:
    """Values equal to ``old`` (null-safe) become ``new``; in another column with ``out``."""
    return replace_if(df, col, lambda c: c.eqNullSafe(F.lit(old)), new, out)


def replace_if(df: DataFrame, col: str, pred: Callable[[Column], Column], new, out: str | None = None) -> DataFrame:
    """Values for which pred is true become ``new``; a null predicate is false."""
    return df.withColumn(out or col, F.when(pred(F.col(col)), F.lit(new)).otherwise(F.col(col)))


def copy(seq: Seq, *cols: str) -> DataFrame:
    """The sequence as it is; moving is the same, as frames do not change."""
    return seq.select(*cols)


def reverse(seq: Seq, *cols: str) -> DataFrame:
    """The rows with positions counted from the end."""
    df = seq.indexed()
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    return df.crossJoin(F.broadcast(n)).select((F.col("_n") - 1 - F.col(seq.pos)).alias(seq.pos), *cols)


def swap_ranges(a: DataFrame, b: DataFrame, col_a: str, col_b: str, pos: str = "pos") -> DataFrame:
    """(pos, col_a, col_b) with the two columns exchanged by position."""
    both = zipped(a.select(pos, F.col(col_a).alias("_a")), b.select(pos, F.col(col_b).alias("_b")), pos)
    return both.select(pos, F.col("_b").alias(col_a), F.col("_a").alias(col_b))
