"""Durations of named tasks as a DataFrame."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Diagnostics:
    """What was posted, started and finished under a name, and whether it failed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.items = spark, []

    @contextmanager
    def task(self, name: str) -> Iterator[None]:
        began, failed = time.time(), True
        try:
            yield
            failed = False
        finally:
            self.items.append((name, began, time.time(), failed))

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.items, "name string, started double, finished double, failed boolean")

    def summary(self) -> DataFrame:
        took = F.col("finished") - F.col("started")
        return self.frame().groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(took).alias("total_s"), F.avg(took).alias("avg_s"), F.min(took).alias("min_s"), F.max(took).alias("max_s"), F.count_if("failed").alias("failed"))
