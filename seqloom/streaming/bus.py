"""Publish and subscribe over a folder that all can read; timers by triggers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


@dataclass
class Bus:
    """One folder of event files. Publishing appends a file; each subscription is a streaming query with its own checkpoint.

    What a handler returns for a batch is kept in ``outcomes`` under its
    checkpoint: False says that it did not take the batch, anything else (also
    nothing) that it did.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    outcomes: dict[str, dict[int, bool]] = field(default_factory=dict)

    def publish(self, events: DataFrame) -> None:
        events.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write.mode("append").parquet(self.path)

    def stream(self, topic: Callable[[Column], Column] | None = None, column: str = "topic") -> DataFrame:
        df = self.spark.readStream.schema(self.schema).parquet(self.path)
        return df.filter(topic(F.col(column))) if topic else df

    def handled(self) -> dict[str, int]:
        """For each subscription the number of batches that its handler took."""
        return {at: sum(batches.values()) for at, batches in self.outcomes.items()}

    def subscribe(self, handler: Callable[[DataFrame, int], bool | None], checkpoint: str, topic: Callable[[Column], Column] | None = None, every: str | None = None) -> StreamingQuery:
        """``handler`` gets each micro-batch; stop() of the query unsubscribes. every: ``10 seconds``; else all that is there, then the end."""
        seen = self.outcomes.setdefault(checkpoint, {})

        def deliver(df: DataFrame, n: int) -> None:
            seen[n] = handler(df, n) is not False  # a batch that comes again is counted once

        w = self.stream(topic).writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
        return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def timer(spark: SparkSession, every: str, tick: Callable[[int], None], checkpoint: str) -> StreamingQuery:
    """``tick(batch)`` in processing time until stop()."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().writeStream.foreachBatch(lambda _, n: tick(n)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def windowed_counts(events: DataFrame, at: str, width: str, late: str, *keys: str) -> DataFrame:
    """Events by tumbling window and key, with a watermark for what comes late."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *keys).agg(F.count(F.lit(1)).alias("n"))
