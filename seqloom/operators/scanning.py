"""Prefix computations, and what follows from a row's neighbour."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.order import WIDE, Seq, _blocked, running, with_next

COMBINE: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, b: a + b,
    "count": lambda a, b: a + b,
    "product": lambda a, b: a * b,
    "xor": lambda a, b: a.bitwiseXOR(b),
    "min": F.least,
    "max": F.greatest,
}


def scan(seq: Seq, value: Column, kind: str = "sum", init=None, inclusive: bool = True, out: str = "scan") -> DataFrame:
    """``seq`` with the running value in ``out``; ``init`` comes before all elements."""
    df = running(seq.df, seq.keys, {out: (kind, value)}, seq.block, inclusive)
    return df if init is None else df.withColumn(out, COMBINE[kind](F.lit(init), F.col(out)))


def inclusive_scan(seq: Seq, col: str, init=None, kind: str = "sum", out: str = "scan") -> DataFrame:
    return scan(seq, F.col(col), kind, init, True, out)


def exclusive_scan(seq: Seq, col: str, init=None, kind: str = "sum", out: str = "scan") -> DataFrame:
    return scan(seq, F.col(col), kind, init, False, out)


def transform_inclusive_scan(seq: Seq, value: Column, init=None, kind: str = "sum", out: str = "scan") -> DataFrame:
    return scan(seq, value, kind, init, True, out)


def transform_exclusive_scan(seq: Seq, value: Column, init=None, kind: str = "sum", out: str = "scan") -> DataFrame:
    return scan(seq, value, kind, init, False, out)


def partial_sum(seq: Seq, col: str, out: str = "scan") -> DataFrame:
    return scan(seq, F.col(col), "sum", None, True, out)


def scan_total(seq: Seq, value: Column, kind: str = "sum") -> DataFrame:
    """The total without init, as one row."""
    fold = {"sum": F.sum, "count": F.count, "product": F.product, "xor": F.bit_xor, "min": F.min, "max": F.max}
    return seq.df.agg(fold[kind](value).alias("total"))


def scan_with(seq: Seq, col: str, f: Callable, identity, kind: str, out: str = "scan") -> DataFrame:
    """(keys, out) of an inclusive scan with any associative f: blocks are folded, the partials scanned in order, and each block scanned from its offset.

    The partials of WIDE blocks are folded again, so the scan that one task does
    sees one value for WIDE blocks; blocks are bounded by the width of the sequence's key blocks.
    """
    keys = seq.keys
    cut = _blocked(seq.df.withColumn("_v", F.col(col).cast(kind)), keys, seq.block).select("_block", *keys, "_v")

    def folded(name: str, by: list[str], value: str) -> Callable:
        def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            total = identity
            for v in pdf.sort_values(by)[value].tolist():
                total = f(total, v)
            return pd.DataFrame({name: [key[0]], "_p": [total]})

        return one

    def offsets(name: str) -> Callable:
        def one(key: tuple, pdf: pd.DataFrame, start: pd.DataFrame | None = None) -> pd.DataFrame:
            pdf = pdf.sort_values(name)
            total, at = identity if start is None else start["_o"].iloc[0], []
            for v in pdf["_p"].tolist():
                at.append(total)
                total = f(total, v)
            return pd.DataFrame({name: pdf[name], "_o": at})

        return one

    def local(key: tuple, pdf: pd.DataFrame, off: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(keys)
        total, got = off["_o"].iloc[0], []
        for v in pdf["_v"].tolist():
            total = f(total, v)
            got.append(total)
        return pdf[keys].assign(**{out: got})

    partial = cut.groupBy("_block").applyInPandas(folded("_block", keys, "_v"), f"_block long, _p {kind}")
    partial = partial.withColumn("_wide", F.floor(F.col("_block") / WIDE))
    wide = partial.groupBy("_wide").applyInPandas(folded("_wide", ["_block"], "_p"), f"_wide long, _p {kind}").withColumn("_one", F.lit(0))
    first = wide.groupBy("_one").applyInPandas(lambda key, pdf: offsets("_wide")(key, pdf), f"_wide long, _o {kind}")
    before = partial.groupBy("_wide").cogroup(first.groupBy("_wide")).applyInPandas(lambda key, pdf, start: offsets("_block")(key, pdf, start), f"_block long, _o {kind}")
    types = ", ".join(f"{k} {seq.df.schema[k].dataType.simpleString()}" for k in keys)
    return cut.groupBy("_block").cogroup(before.groupBy("_block")).applyInPandas(local, f"{types}, {out} {kind}")


def _pairs(seq: Seq, col: str) -> DataFrame:
    """(pos, _a, _b) of every two neighbours, with their values in structs."""
    a = seq.select(F.struct(F.col(col).alias("v")).alias("_a"))
    return with_next(a, seq.pos, {"_b": ("_a", 1)}).filter(F.col("_b").isNotNull())


def is_sorted(seq: Seq, col: str, reverse: bool = False) -> DataFrame:
    """No element comes before its forerunner; equal neighbours are in order; nulls come first. Empty: true."""
    less = (F.col("_a") < F.col("_b")) if reverse else (F.col("_b") < F.col("_a"))
    return _pairs(seq, col).agg((~F.coalesce(F.bool_or(less), F.lit(False))).alias("result"))


def unique(seq: Seq, col: str, *cols: str, eq: Callable[[Column, Column], Column] = lambda a, b: a.eqNullSafe(b)) -> DataFrame:
    """Consecutive duplicates less all but the first, with (old) positions; equal to distinct on sorted input only."""
    df = seq.indexed()
    gone = _pairs(seq, col).filter(eq(F.col("_a")["v"], F.col("_b")["v"])).select((F.col(seq.pos) + 1).alias(seq.pos))
    return df.join(gone, seq.pos, "left_anti").select(seq.pos, *cols)
