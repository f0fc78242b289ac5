"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: a lost executor costs its running tasks, never the
    work behind the table, and a non-deterministic partition number that is
    stored in the table stays as it was written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have in any case."""
    have = {c.lower() for c in df.columns}
    while base.lower() in have:
        base += "_"
    return base


def plain_names(df: DataFrame, *known: str) -> DataFrame:
    """``df`` with all columns but ``known`` renamed by place, so that no name of theirs clashes with an operator's own."""
    return df.select(*[F.col(f"`{c}`").alias(c if c in known else f"c{i}_") for i, c in enumerate(df.columns)])


def returning(run: Callable) -> Callable:
    """``run`` for mapInArrow, which at its end gives free memory back: workers live on, and other stages need it."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def bound_batches(spark: SparkSession, size: str = "4m", rows: int = 512) -> None:
    """Arrow batches to Python by bytes as well as by rows, and few rows at once from Parquet, so that long texts fill neither a worker nor an executor."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    except Exception:  # a Spark before 4.1 knows rows only
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
