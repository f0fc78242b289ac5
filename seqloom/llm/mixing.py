"""Mix sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import plain_names, stage

#: Rows of the table of sources and tasks up to which it is broadcast; beyond, it is joined by a shuffle.
MOST_BROADCAST = 100_000


def n_words(text: Column) -> Column:
    """Number of maximal runs of bytes other than space and 0x09-0x0D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], most: float) -> DataFrame:
    """(source, source_size, target, ratio) from (source, size) rows, one row a source.

    Sources in code point order, null last, weigh ``weights``, repeating, and
    share the sum of all sizes. A target stops at ``most`` times its source's
    size; what is above is shared again by weight. Sorted by ``size / weight``
    the sources that stop are a prefix, so one pass over the sources finds them.
    The work after the first aggregation is on one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("long"))
    # The order of (cap / weight), ties by source, and what all sources and the ones before have.
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = (
        per.withColumn("_size_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("_weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_size", F.sum("source_size").over(everything))
        .withColumn("_weight", F.sum("weight").over(everything))
        .withColumn("_free", F.col("_size") - F.lit(most) * F.col("_size_before"))
        .withColumn("_stops", F.col("weight") * F.col("_free") > F.lit(most) * F.col("source_size") * (F.col("_weight") - F.col("_weight_before")))
        .withColumn("_level", F.min(F.when(~F.col("_stops"), F.struct(F.col("source_size") / F.col("weight"), F.col("_weight_before"), F.col("_free")))).over(everything))
    )
    level = F.col("_level")
    shared = F.col("weight") * level["_free"] / (F.col("_weight") - level["_weight_before"])
    per = per.withColumn("target", F.when(F.col("_stops") | level.isNull(), F.lit(most) * F.col("source_size")).otherwise(shared).cast("double"))
    return per.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("ratio"))


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append partition number and rank within partition and source; rows come sorted by source."""
    from pyspark import TaskContext

    pid, last, seen = TaskContext.get().partitionId(), None, 0
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column(b.schema.get_field_index("__mix_source")).fill_null("").to_pylist()
        null = b.column(b.schema.get_field_index("__mix_null")).to_pylist()
        rank = np.empty(len(key), np.int64)
        for i, k in enumerate(zip(null, key)):
            if k != last:
                last, seen = k, 0
            seen += 1
            rank[i] = seen
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(key), pid, np.int32)), pa.array(rank)], names=[*b.schema.names, "__mix_pid", "__mix_rank"])


def mix(df: DataFrame, weights: list[int] = (1, 2, 3), most: float = 3.0, keep: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` (doc_id, text, source) with __mix_size, __mix_source_size, __mix_target and __mix_copies.

    A document's expected copies are target / size of its source. Documents of a
    source are ordered by (size, doc_id); the prefix sum of the expected copies
    plus one offset, drawn from the source's name, gives a copy at each integer
    boundary that it crosses. Ordering by size keeps the words taken within
    about one long document of the target, and reruns agree.

    The order is a range partitioning of the whole table by (source, size,
    doc_id), so a source with a third of all rows is spread over as many tasks;
    each task ranks its rows, and the tasks' counts by source (at most one row a
    task and source) give the ranks before. Rows are never gathered by source.

    Null text: size 0. Null source: a source of its own, after all others.
    Repeated rows and doc_ids: each row counts for itself. Empty table: empty.
    A source whose texts hold no words: target 0. Input columns stay as they
    are; names beginning with ``__mix_`` are reserved.
    """
    spark = df.sparkSession
    cols = keep or df.columns
    rows = df.select(*[F.col(f"`{c}`") for c in cols], n_words(F.col("text")).alias("__mix_size"), F.col("source").isNull().alias("__mix_null"), F.col("source").cast("string").alias("__mix_source"), F.col("doc_id").alias("__mix_id"))
    n = max(1, min(2000, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ordered = rows.repartitionByRange(n, "__mix_null", "__mix_source", "__mix_size", "__mix_id").sortWithinPartitions("__mix_null", "__mix_source", "__mix_size", "__mix_id")
    schema = T.StructType([*rows.schema.fields, T.StructField("__mix_pid", T.IntegerType()), T.StructField("__mix_rank", T.LongType())])
    ranked = stage(ordered.mapInArrow(_rank, schema), "mix")
    targets = source_targets(ranked.select(F.col("__mix_source").alias("source"), F.col("__mix_size").alias("size")), list(weights), most)
    counts = ranked.groupBy("__mix_source", "__mix_pid").agg(F.max("__mix_rank").alias("n"))
    upto = Window.partitionBy("__mix_source").orderBy("__mix_pid").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("__mix_source").alias("s"), F.col("__mix_pid").alias("p"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n"))
    offsets = before.join(targets, F.col("s").eqNullSafe(F.col("source"))).select("s", "p", "n", "source_size", "target", "ratio")
    # At most one row for each task and one more for each source; broadcast only as long as that is few.
    offsets = stage(offsets, "offsets")
    few = offsets.count() <= MOST_BROADCAST
    out = ranked.join(F.broadcast(offsets) if few else offsets, F.col("__mix_source").eqNullSafe(F.col("s")) & (F.col("__mix_pid") == F.col("p")))
    # 16 random bits: with them rank * ratio + offset is exact wherever the ratio is the whole number 3.
    offset = F.conv(F.substring(F.md5(F.coalesce(F.col("__mix_source"), F.lit(""))), 1, 4), 16, 10).cast("double") / 65536.0
    rank = F.col("n") + F.col("__mix_rank")
    copies = (F.floor(rank * F.col("ratio") + offset) - F.floor((rank - 1) * F.col("ratio") + offset)).cast("long")
    return out.select(*[F.col(f"`{c}`") for c in cols], "__mix_size", F.col("source_size").alias("__mix_source_size"), F.col("target").alias("__mix_target"), copies.alias("__mix_copies"))


def mixed_documents(df: DataFrame, weights: list[int] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of ``df``."""
    safe = plain_names(df, "doc_id", "text", "source")
    out = mix(safe, weights, most).filter(F.col("__mix_copies") > 0)
    out = out.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies"))))
    return out.select(*safe.columns).toDF(*df.columns)
