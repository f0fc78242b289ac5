"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._store import stage


def _marked(e: DataFrame, name: str) -> tuple[DataFrame, tuple[int, int]]:
    """The table written, and the number of its rows with a sum of their hashes, taken while it is written."""
    seen = Observation()
    e = stage(e.observe(seen, F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)), F.lit(0)).alias("h")), name)
    return e, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component_id) of every node of ``edges`` (u, v): the smallest id that it reaches.

    Each round ties the neighbours of a node to the smallest of them, first the
    larger neighbours, then the smaller; the number of rounds grows with the
    logarithm of the longest chain. Minima are aggregated before the shuffle and
    joined back, so that a node with very many edges is never gathered in one
    task. Each round is a written table. Self loops and repeated edges do no
    harm; no edges: an empty table.
    """
    e, mark = _marked(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        if not mark[0]:
            break
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        tied = large.join(low, F.col("u") == F.col("w")).select("v", "m").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, now = _marked(tied.unionAll(low.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), "small")
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionAll(e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
