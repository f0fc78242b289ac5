"""Approximate nearest neighbours: balanced posting lists with replicated boundary vectors."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import bound_batches, stage
from .vecdedup import valid

#: Lists at most; vectors a list has about. Vectors that the index is fitted on: so many, or so many for each list if that is more.
MOST_LISTS, LIST_ROWS, SAMPLE, LIST_SAMPLE = 16_384, 256, 20_000, 8
#: A vector is also put in lists whose centroid is at most so much farther than its nearest, in so many lists at most.
SPREAD, REPLICAS = 1.03, 3
#: Recall that the pruning ratio is calibrated to; vectors of the sample that only calibrate it; neighbours of a centroid in the graph.
RECALL, HELD_OUT, DEGREE = 0.985, 300, 24
#: Members of a list, and queries, that are compared at once.
TILE, QUERY_TILE = 4096, 1024


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (x @ c.T), 0))


def blocks(n: int, width: int) -> list[slice]:
    """Rows 0..n-1 in blocks, each of about four million entries of a table ``width`` wide."""
    step = max(1, (4 << 20) // max(1, width))
    return [slice(at, at + step) for at in range(0, n, step)]


class Index:
    """Balanced centroids, a graph over them, and the distance ratio up to which lists are searched."""

    def __init__(self, sample: np.ndarray, lists: int, k: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        whole = unit(sample.astype(np.float64))
        # Vectors that calibrate fit no centroid: one that does may be a centroid itself, at no distance from it.
        held = np.zeros(len(whole), bool)
        if len(whole) > 4 * HELD_OUT:
            held[rng.choice(len(whole), HELD_OUT, replace=False)] = True
        x = whole[~held]
        lists = max(1, min(lists, len(x)))
        c = x[rng.choice(len(x), lists, replace=False)]
        size = np.zeros(lists)
        for _ in range(8):  # balanced k-means: a list's size adds to its distance
            full = 0.2 * (size / max(1, len(x) / lists) - 1).clip(-1, 2)[None, :]
            near = np.concatenate([(2 - 2 * (x[s] @ c.T) + full).argmin(1) for s in blocks(len(x), lists)])
            size = np.bincount(near, minlength=lists).astype(float)
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            some = np.einsum("ij,ij->i", total, total) > 1e-12
            c[some] = unit(total[some])
        self.centroids = c
        close = []
        for s in blocks(lists, lists):
            d = distances(c[s], c)
            d[np.arange(len(d)), np.arange(s.start, s.start + len(d))] = np.inf
            close.append(np.argsort(d, axis=1, kind="stable")[:, : min(DEGREE, lists - 1)])
        close = np.concatenate(close)
        self.edges = [sorted({*row.tolist(), (i + 1) % lists, (i + lists // 2) % lists} - {i}) for i, row in enumerate(close)]
        for i in range(lists):  # both ways
            for j in close[i].tolist():
                if i not in self.edges[j]:
                    self.edges[j].append(i)
        self.ratio = self.calibrate(whole, np.flatnonzero(held) if held.any() else np.arange(len(whole)), k)

    def calibrate(self, x: np.ndarray, some: np.ndarray, k: int) -> float:
        """The smallest ratio at which the lists searched hold RECALL of the nearest k in the sample ``x``, for its rows ``some``."""
        if len(self.centroids) == 1 or len(x) < 3:
            return np.inf
        need = []
        for q in some.tolist():
            s = x @ x[q]
            s[q] = -np.inf
            near = np.argpartition(-s, min(k, len(x) - 2))[:k]
            own = distances(x[q : q + 1], self.centroids)[0]
            d = distances(x[near], self.centroids)
            need += [own[list_].min() / max(own.min(), 1e-9) for list_ in self.homes(d)]
        return float(np.quantile(need, RECALL))

    def homes(self, d: np.ndarray) -> list[list[int]]:
        """Lists of each vector: its nearest, and up to REPLICAS within SPREAD."""
        n = min(REPLICAS, d.shape[1])
        at = np.argpartition(d, n - 1, axis=1)[:, :n]
        at = np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, 1), axis=1, kind="stable"), 1)
        own = np.take_along_axis(d, at, 1)
        ok = own <= own[:, :1] * SPREAD
        ok[:, 0] = True
        return [r[o].tolist() for r, o in zip(at, ok)]

    def search(self, q: np.ndarray) -> list[int]:
        """Lists whose centroids lie within the ratio of the nearest, by best-first search in the graph."""
        c = self.centroids
        measure = lambda ids: np.sqrt(np.maximum(2 - 2 * (c[ids] @ q), 0)).tolist()
        start = sorted({0, len(c) // 3, 2 * len(c) // 3})
        seen, found = set(start), {}
        heap = list(zip(measure(start), start))
        heapq.heapify(heap)
        best, stale = np.inf, 0
        while heap:
            d, i = heapq.heappop(heap)
            if d > best * self.ratio:
                stale += 1
                if stale > DEGREE:
                    break
            found[i] = d
            best = min(best, d)
            new = [j for j in self.edges[i] if j not in seen]
            if new:
                seen.update(new)
                for d2, j in zip(measure(new), new):
                    heapq.heappush(heap, (d2, j))
        return [i for i, d in found.items() if d <= best * self.ratio]

    def cover(self, q: np.ndarray, sizes: np.ndarray, need: int) -> list[int]:
        """Lists to search so that they are home to ``need`` ids at least, or all lists if there are not so many.

        Where search() finds too few, as for a vector that is all of its own
        list, the ratio counts from the farthest list that the ids take.
        ``sizes``: for each list the ids whose nearest list it is, so copies in
        further lists do not count twice.
        """
        found = self.search(q)
        if sizes[found].sum() >= need:
            return found
        d = np.sqrt(np.maximum(2 - 2 * (self.centroids @ q), 0))
        order = np.argsort(d, kind="stable")
        last = np.searchsorted(np.cumsum(sizes[order]), need)
        if last >= len(order) or np.isinf(self.ratio):
            return np.flatnonzero(sizes).tolist()
        near = np.flatnonzero((d <= d[order[last]] * max(self.ratio, 1.0)) & (sizes > 0)).tolist()
        return sorted({*found, *order[: last + 1].tolist(), *near})


def nearest(df: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest rows of each query by cosine; the query's own row is no candidate.

    The index is fitted on about SAMPLE rows, or LIST_SAMPLE for each list if
    that is more (MOST_LISTS bounds both), chosen by a hash of vec_id; every
    row is put in lists. Equal vectors are one member with its k + 1 smallest
    vec_ids, which is all that any query can need. Lists are cut in blocks of
    about TILE members and queries of a list in blocks of QUERY_TILE, so a very
    full list is many tasks. Each task keeps k for each query, in double
    precision; ties go to the smaller vec_id. A query whose lists are home to
    fewer than k others goes on to the next nearest lists. Centroids (at most
    MOST_LISTS) and the sizes of lists are all that is broadcast.

    Null or zero vectors and those with null or non-finite components take no
    part. Vectors of another length than the most common are compared only with
    their like. Repeated rows: a vec_id is one candidate. Fewer candidates than
    k: all. Empty table: empty. Other columns are dropped.
    """
    spark = df.sparkSession
    bound_batches(spark)
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = rows.filter(valid() & F.col("vec_id").isNotNull()).withColumn("dim", F.size("embedding"))
    # One row for each distinct vector: its smallest ids.
    ids = rows.groupBy("embedding", "dim", F.pmod(F.xxhash64("vec_id"), F.lit(256)).alias("salt")).agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    members = stage(ids.groupBy("embedding", "dim").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")), "members")
    sizes = {r["dim"]: r["n"] for r in members.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    schema = "query_id long, rank int, vec_id long, score double"
    out = None
    for dim, n in sorted(sizes.items()):
        lists = min(MOST_LISTS, max(1, n // LIST_ROWS))
        most = max(SAMPLE, LIST_SAMPLE * lists)
        share = min(1.0, most / n)
        u = F.pmod(F.xxhash64(F.col("ids")[0], F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
        own = members.filter(F.col("dim") == dim)
        sample = own.filter(u < share).orderBy(F.col("ids")[0]).limit(2 * most).select("embedding").toPandas()["embedding"]
        if not len(sample):
            sample = own.select("embedding").limit(1).toPandas()["embedding"]
        index = Index(np.array(sample.tolist(), np.float64), lists, k)
        part = _search(own, rows.filter(F.col("dim") == dim).filter("is_query").select("vec_id", "embedding"), index, k)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def _search(members: DataFrame, queries: DataFrame, index: Index, k: int) -> DataFrame:
    shared = members.sparkSession.sparkContext.broadcast(index)

    def to_lists(batches):
        index = shared.value
        for b in batches:
            x = np.array(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1)
            rows, lists, first = [], [], []
            for at in range(0, len(x), 1024):
                for i, own in enumerate(index.homes(distances(unit(x[at : at + 1024]), index.centroids))):
                    rows += [at + i] * len(own)
                    lists += own
                    first += [True] + [False] * (len(own) - 1)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), b.column(0).take(take), b.column(1).take(take), pa.array(first, pa.bool_())], names=["list", "ids", "embedding", "first"])

    def to_probes(batches):
        index = shared.value
        for b in batches:
            x = unit(np.array(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1))
            rows, lists = [], []
            for i, q in enumerate(x):
                own = index.cover(q, sizes.value, k + 1)  # the query's own id may be one
                rows += [i] * len(own)
                lists += own
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), b.column(0).take(take), b.column(1).take(take)], names=["list", "query_id", "embedding"])

    posting = stage(members.select("ids", "embedding").mapInArrow(to_lists, "list int, ids array<long>, embedding array<float>, first boolean"), "posting")
    home = np.zeros(len(index.centroids), np.int64)
    for r in posting.filter("first").groupBy("list").agg(F.sum(F.size("ids")).alias("n")).collect():
        home[r["list"]] = r["n"]
    sizes = members.sparkSession.sparkContext.broadcast(home)
    probes = stage(queries.dropDuplicates(["vec_id"]).select("vec_id", "embedding").mapInArrow(to_probes, "list int, query_id long, embedding array<float>"), "probes")
    # One row a list: at most MOST_LISTS.
    full = posting.groupBy("list").agg(F.ceil(F.count("*") / TILE).cast("long").alias("blocks"))
    asked = probes.groupBy("list").agg(F.ceil(F.count("*") / QUERY_TILE).cast("long").alias("asks"))
    cut = F.broadcast(full.join(asked, "list"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = posting.join(cut, "list").withColumn("b", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("blocks"))).withColumn("a", each("asks")).select("list", "a", "b", "ids", "embedding")
    right = probes.join(cut, "list").withColumn("a", F.pmod(F.xxhash64("query_id"), F.col("asks"))).withColumn("b", each("blocks")).select("list", "a", "b", "query_id", "embedding")

    def compare(m: pa.Table, q: pa.Table) -> pa.Table:
        none = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not m.num_rows or not q.num_rows:
            return pa.table(none)
        flat = lambda t: np.array(t.column("embedding").combine_chunks().flatten(), np.float64).reshape(t.num_rows, -1)
        x, y = flat(m), flat(q)
        nx, ny = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
        ids, names = m.column("ids").to_pylist(), q.column("query_id").to_pylist()
        n = min(len(ids), k + 1)  # the query's own vector may be one
        out_q, out_v, out_s = [], [], []
        for at in range(0, len(y), 256):
            s = (y[at : at + 256] @ x.T) / nx[None, :]
            cut = -np.partition(-s, n - 1, axis=1)[:, n - 1]
            i, j = np.nonzero(s >= (cut - 1e-9 * (1 + np.abs(cut)))[:, None])  # all that may tie at the end
            exact = np.einsum("ij,ij->i", y[at + i], x[j]) / (ny[at + i] * nx[j])
            order = np.lexsort((np.fromiter((ids[c][0] for c in j.tolist()), np.int64, len(j)), -exact, i))
            have = [0] * len(s)
            best: dict[int, list[tuple[float, int]]] = {}
            for o in order.tolist():
                r, score = int(i[o]), float(exact[o])
                own = best.setdefault(r, [])
                if have[r] >= k and score < own[k - 1][0]:
                    continue
                new = [(score, v) for v in ids[int(j[o])] if v != names[at + r]]
                own += new
                have[r] += len(new)
            for r, own in best.items():
                own.sort(key=lambda p: (-p[0], p[1]))
                for score, v in own[:k]:
                    out_q.append(names[at + r])
                    out_v.append(v)
                    out_s.append(score)
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    found = left.groupBy("list", "a", "b").cogroup(right.groupBy("list", "a", "b")).applyInArrow(compare, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
