"""Reductions, extremes, inner products, grouped work."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.order import WIDE, Seq, _blocked, zipped


def reduce(df: DataFrame, *aggs: Column) -> DataFrame:
    """Built-in aggregates, partial in each task and final after one shuffle of partials."""
    return df.agg(*aggs)


def reduce_ordered(seq: Seq, col: str, f: Callable, kind: str, out: str = "result") -> DataFrame:
    """Fold with any associative f, commutative or not: each block in order, then the partials of WIDE blocks in order, then theirs.

    Empty: no partials, one null row. Blocks are bounded by the keys' block width; the last fold sees one value for WIDE blocks.
    """
    keys = seq.keys

    def folded(name: str, by: list[str], value: str) -> Callable:
        def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            values = pdf.sort_values(by)[value].tolist()
            total = values[0]
            for v in values[1:]:
                total = f(total, v)
            return pd.DataFrame({name: [key[0]], "_p": [total]})

        return one

    cut = _blocked(seq.df.withColumn("_v", F.col(col).cast(kind)), keys, seq.block).select("_block", *keys, "_v")
    partial = cut.groupBy("_block").applyInPandas(folded("_block", keys, "_v"), f"_block long, _p {kind}")
    wide = partial.withColumn("_wide", F.floor(F.col("_block") / WIDE))
    wide = wide.groupBy("_wide").applyInPandas(folded("_wide", ["_block"], "_p"), f"_wide long, _p {kind}")
    done = wide.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(folded("_one", ["_wide"], "_p"), f"_one int, _p {kind}").withColumnRenamed("_p", out)
    return done.agg(F.first(out).alias(out))


def count_if(df: DataFrame, pred: Column) -> DataFrame:
    return df.agg(F.count_if(pred).alias("n"))


def extremum(df: DataFrame, value: str, *ties: str, largest: bool = True) -> DataFrame:
    """The whole row of the largest (smallest) value; ties: the row whose tie keys are largest. Empty: one null row."""
    cols = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    sign = F.struct(F.col(value), *ties) if largest else F.struct(-F.col(value), *ties)
    return df.agg(F.max_by(cols, sign).alias("r")).select("r.*")


def inner_product(a: DataFrame, b: DataFrame, col_a: str, col_b: str, init: int = 0, pos: str = "pos", op: Callable[[Column, Column], Column] = lambda x, y: x * y, red: Callable[[Column], Column] = F.sum) -> DataFrame:
    """init and red over op of values at equal positions; empty: init."""
    both = zipped(a.select(pos, F.col(col_a).alias("_a")), b.select(pos, F.col(col_b).alias("_b")), pos)
    return both.agg((F.coalesce(red(op(F.col("_a"), F.col("_b"))), F.lit(0)) + F.lit(init)).alias("result"))


def for_each(df: DataFrame, **states: Column) -> DataFrame:
    """A functor with state, merged over chunks: several aggregates at once."""
    return df.agg(*[c.alias(n) for n, c in states.items()])


def for_each_merge(df: DataFrame, col: str, start: Callable, step: Callable, merge: Callable, kind: str) -> DataFrame:
    """A functor of one's own: a state for each batch by ``step``, then all states by ``merge``; ``start()`` is its identity."""

    def local(batches):
        state = start()
        for pdf in batches:
            for v in pdf[col]:
                state = step(state, v)
        yield pd.DataFrame({"s": [state]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        state = start()
        for s in pdf["s"]:
            state = merge(state, s)
        return pd.DataFrame({"result": [state]})

    return df.select(col).mapInPandas(local, f"s {kind}").withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(total, f"result {kind}")


def group_by(seq: Seq, key: str, value: str, out: str = "items") -> DataFrame:
    """(key, items): the values of each key in order. Input need not be sorted."""
    rows = seq.df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*seq.keys, F.col(value).alias("_v")))).alias("_g"))
    return rows.select(key, F.transform("_g", lambda s: s["_v"]).alias(out))


def grouped_for(df: DataFrame, key: str, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f sees whole groups. For what a Column can say use grouped_transform: a group is then not held in memory."""
    return df.groupBy(key).applyInPandas(f, schema)


def grouped_transform(df: DataFrame, key: str, out: str, f: Callable[[Window], Column]) -> DataFrame:
    """One output a row, from its group."""
    return df.withColumn(out, f(Window.partitionBy(key)))


