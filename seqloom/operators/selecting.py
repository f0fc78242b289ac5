"""Filters, quantifiers, and partitions by a predicate. A null predicate is false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.order import Seq, running, with_pos


def _true(pred: Column) -> Column:
    return F.coalesce(pred, F.lit(False))


def find_all(df: DataFrame, pred: Column) -> DataFrame:
    return df.filter(pred)


def copy_if(seq: Seq, pred: Column, *cols: str) -> DataFrame:
    """Matching rows with their new positions."""
    kept = seq.df.filter(pred)
    return with_pos(kept, seq.keys, seq.pos, seq.block).select(seq.pos, *cols)


def remove_copy(seq: Seq, pred: Column, *cols: str) -> DataFrame:
    """Rows for which pred is not true, with their new positions."""
    return copy_if(seq, ~_true(pred), *cols)


def all_of(df: DataFrame, pred: Column) -> DataFrame:
    """One row ``result``; empty: true."""
    return df.agg(F.coalesce(F.bool_and(_true(pred)), F.lit(True)).alias("result"))


def any_of(df: DataFrame, pred: Column) -> DataFrame:
    """One row ``result``; empty: false."""
    return df.agg(F.coalesce(F.bool_or(_true(pred)), F.lit(False)).alias("result"))


def none_of(df: DataFrame, pred: Column) -> DataFrame:
    """One row ``result``; empty: true."""
    return df.agg((~F.coalesce(F.bool_or(_true(pred)), F.lit(False))).alias("result"))


def any_of_early(df: DataFrame, pred: Column) -> bool:
    """The same on the driver, ending the scan at the first match."""
    return len(df.filter(pred).limit(1).take(1)) > 0


def stable_partition(seq: Seq, pred: Column, *cols: str) -> DataFrame:
    """Rows with their positions once matching rows are first, order kept: matches before a row, or all matches and the others before it."""
    rows = seq.df.withColumn("_p", _true(pred))
    total = rows.agg(F.count_if("_p").alias("_m"))
    counted = running(rows, seq.keys, {"_t": ("sum", F.col("_p").cast("long")), "_f": ("sum", (~F.col("_p")).cast("long"))}, seq.block)
    place = F.when(F.col("_p"), F.col("_t") - 1).otherwise(F.col("_m") + F.col("_f") - 1)
    return counted.crossJoin(F.broadcast(total)).select(place.cast("long").alias(seq.pos), *cols)


def partition(df: DataFrame, pred: Column, name: str = "first") -> DataFrame:
    """Rows with the side they are on; the order within a side is free. The point is partition_point()."""
    return df.withColumn(name, _true(pred))


def partition_point(df: DataFrame, pred: Column) -> DataFrame:
    return df.agg(F.count_if(_true(pred)).alias("point"))


def partition_copy(seq: Seq, pred: Column, *cols: str) -> DataFrame:
    """Both outputs: (matched, pos within it)."""
    rows = seq.df.withColumn("matched", _true(pred))
    counted = running(rows, seq.keys, {"_t": ("sum", F.col("matched").cast("long")), "_f": ("sum", (~F.col("matched")).cast("long"))}, seq.block)
    return counted.select("matched", (F.when(F.col("matched"), F.col("_t")).otherwise(F.col("_f")) - 1).cast("long").alias(seq.pos), *cols)


def is_partitioned(seq: Seq, pred: Column) -> DataFrame:
    """Whether no match follows a row that does not match; empty: true."""
    key = F.struct(*seq.keys)
    p = _true(pred)
    ends = seq.df.agg(F.max(F.when(p, key)).alias("t"), F.min(F.when(~p, key)).alias("f"))
    return ends.select(F.coalesce(F.col("t") < F.col("f"), F.lit(True)).alias("result"))
