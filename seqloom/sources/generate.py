"""Generated sequences and tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lazy_irange(spark: SparkSession, first: int, last: int, f: Callable[[Column], Column], out: str = "value") -> DataFrame:
    """(pos, value): f(i) for i from first up to, not with, last; computed where it is read."""
    return spark.range(first, last).select((F.col("id") - first).alias("pos"), f(F.col("id")).alias(out))


def make_range(spark: SparkSession, n: int, value=None, out: str = "value") -> DataFrame:
    return lazy_irange(spark, 0, n, lambda _: F.lit(value), out)


def iota(df: DataFrame, pos: str, start: int, out: str) -> DataFrame:
    return df.withColumn(out, F.col(pos) + F.lit(start))


def fill(df: DataFrame, col: str, value) -> DataFrame:
    return df.withColumn(col, F.lit(value))


def generate(df: DataFrame, pos: str, f: Callable[[Column], Column], out: str) -> DataFrame:
    """Generators are functions of the position, so a task that runs again gives the same."""
    return df.withColumn(out, f(F.col(pos)))


def random_column(seed: int) -> Column:
    return F.rand(seed)


def write(df: DataFrame, path: str, *partition_by: str) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
