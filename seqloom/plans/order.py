"""Sequences: a DataFrame with a total order, and the distributed plans that the order needs.

A window without ``partitionBy`` runs in one task. Everything here works in
blocks instead: rows are cut by the leading key (or by position) into blocks
that fit a task, each block is one window partition, and the blocks' totals, one
row each, give what lies before a block. All of it is one lazy plan.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct leading keys in a block, and positions in a block of a sequence with positions.
KEY_BLOCK, POS_BLOCK = 1 << 15, 1 << 15
#: Blocks whose totals are put in order in one task.
WIDE = 4096
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def stage(df: DataFrame) -> DataFrame:
    """``df`` written to the folder in spark.checkpoint.dir (a temporary one only where that is unset) and read again."""
    spark = df.sparkSession
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    path = f"{at}/seq-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _sort(keys: list[str | Column]) -> list[Column]:
    return [F.col(k).asc_nulls_first() if isinstance(k, str) else k for k in keys]


class Seq:
    """Rows of ``df`` in the total order of ``keys`` (names; nulls first).

    The keys must tell all rows apart; ties are broken arbitrarily. ``dense``
    promises that the first key already is the position 0..n-1.
    """

    def __init__(self, df: DataFrame, *keys: str, dense: bool = False, block: int = KEY_BLOCK, pos: str = "pos"):
        if not keys:
            raise ValueError("a sequence needs the keys of its order")
        missing = [k for k in keys if k not in df.columns]
        if missing:
            raise ValueError(f"no such columns: {missing}")
        self.df, self.keys, self.dense, self.block, self.pos = df, list(keys), dense, block, pos

    def indexed(self) -> DataFrame:
        """The rows with their 0-based position."""
        if self.dense:
            return self.df.withColumn(self.pos, F.col(self.keys[0]).cast("long"))
        return with_pos(self.df, self.keys, self.pos, self.block)

    def select(self, *cols) -> DataFrame:
        return self.indexed().select(self.pos, *cols)

    def where(self, condition: Column) -> Seq:
        return Seq(self.df.filter(condition), *self.keys, block=self.block, pos=self.pos)


def _blocked(df: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``_block``: rows of one block are next to each other in the order, and blocks are ordered by it."""
    if isinstance(df.schema[keys[0]].dataType, INTEGRAL):
        return df.withColumn("_block", F.coalesce(F.floor(F.col(keys[0]) / width), F.lit(-(1 << 60))))
    # Other keys: ranges from a sample. The number is written down, as a recomputed task might draw it anew.
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(df.repartitionByRange(n, *_sort(keys)).withColumn("_block", F.spark_partition_id().cast("long")))


def running(df: DataFrame, keys: list[str], sums: dict[str, tuple[str, Column]], width: int = KEY_BLOCK, inclusive: bool = True) -> DataFrame:
    """``df`` with running values in the order of ``keys``. sums: name -> (``sum``, ``min``, ``max``, ``count``, ``product``, ``xor``, value).

    Two passes: each block by itself, then the totals of the blocks before it.
    Exclusive values at the start are null (count and sum: 0, product: 1).
    """
    fold: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "product": F.product, "xor": F.bit_xor}
    join: dict[str, Callable[[Column, Column], Column]] = {"sum": lambda a, b: a + b, "count": lambda a, b: a + b, "product": lambda a, b: a * b, "xor": lambda a, b: a.bitwiseXOR(b), "min": F.least, "max": F.greatest}
    start = {"sum": 0, "count": 0, "product": 1, "xor": 0}
    again = {"count": F.sum}
    cut = _blocked(df, keys, width)
    for name, (_, value) in sums.items():
        cut = cut.withColumn(f"_v_{name}", value)
    w = Window.partitionBy("_block").orderBy(*_sort(keys)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    totals = cut.groupBy("_block").agg(*[fold[k](F.col(f"_v_{n}")).alias(f"_t_{n}") for n, (k, _) in sums.items()])
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # over one row a block
    totals = totals.select("_block", *[again.get(k, fold[k])(F.col(f"_t_{n}")).over(before).alias(f"_b_{n}") for n, (k, _) in sums.items()])
    out = cut
    for n, (k, _) in sums.items():
        out = out.withColumn(n, fold[k](F.col(f"_v_{n}")).over(w))
    out = out.join(totals, "_block")
    for n, (k, _) in sums.items():
        own, past = F.col(n), F.col(f"_b_{n}")
        if k in start:
            value = join[k](F.coalesce(past, F.lit(start[k])), F.coalesce(own, F.lit(start[k])))
        else:
            value = join[k](past, own)  # least and greatest skip nulls
        out = out.withColumn(n, value)
    return out.drop("_block", *[f"_v_{n}" for n in sums], *[f"_b_{n}" for n in sums])


def with_pos(df: DataFrame, keys: list[str], pos: str = "pos", width: int = KEY_BLOCK) -> DataFrame:
    """``df`` with the 0-based position of each row in the order of ``keys``."""
    cut = _blocked(df, keys, width)
    counts = cut.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_block").orderBy(*_sort(keys))) - 1
    return cut.withColumn(pos, own).join(counts, "_block").withColumn(pos, (F.col(pos) + F.col("_before")).cast("long")).drop("_block", "_before")


def with_next(df: DataFrame, pos: str, cols: dict[str, tuple[str, int]], width: int = POS_BLOCK) -> DataFrame:
    """``df`` with values of the rows at pos + k: name -> (column, k), k > 0; null beyond the end.

    Blocks of ``width`` positions; the first rows of a block also go to the
    block before it, so every row finds its followers in its own block.
    """
    far = max(k for _, k in cols.values())
    if far > width:
        raise ValueError("rows farther apart than a block")
    b = F.floor(F.col(pos) / width)
    both = F.when(F.col(pos) % width < far, F.array(b, b - 1)).otherwise(F.array(b))
    out = df.withColumn("_block", F.explode(both))
    w = Window.partitionBy("_block").orderBy(pos)
    for name, (c, k) in cols.items():
        out = out.withColumn(name, F.lead(c, k).over(w))
    return out.filter(F.col("_block") == b).drop("_block")


def zipped(a: DataFrame, b: DataFrame, pos: str = "pos", how: str = "inner") -> DataFrame:
    """Rows of two sequences side by side by position; other columns must differ in name."""
    return a.join(b, pos, how)
