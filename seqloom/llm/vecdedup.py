"""Near-duplicate vectors by collision counting on one-dimensional projections."""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._store import bound_batches, stage

#: Projections that are counted, and the chance to miss a pair at the threshold by its count and by its cells.
PROJECTIONS, MISS_COUNT, MISS_CELLS = 32, 1e-7, 1e-6
#: Cell width and window half-width in deviations of a projected difference at the threshold.
CELL, WINDOW = 8.0, 2.0
#: Half-width, in the same deviations, of the window of the sorted projection; beyond it no pair is counted.
REACH = 5.5
#: A projection of a unit vector, N(0, 1), is kept in a byte: so wide is a step.
STEP = 10 / 256
#: Members of a cell that are compared at once; larger cells go in blocks. Members that a cell has about. Members of smaller cells that go to Python together.
TILE, CELL_ROWS, BUNDLE = 512, 256, 8192
#: Rows of the table of large cells up to which it is broadcast; beyond, it is joined by a shuffle.
MOST_BROADCAST = 100_000


def valid(v: str = "embedding"):
    """Not null, no null or non-finite component, not zero."""
    x = F.col(v)
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))) & F.exists(x, lambda c: c != 0)
    return F.coalesce(ok, F.lit(False))


def least_count(m: int, p: float, miss: float) -> int:
    """The largest count that a pair with collision chance p reaches on m projections but for a chance of ``miss``."""
    below = 0.0
    for t in range(m + 1):
        below += comb(m, t) * p**t * (1 - p) ** (m - t)
        if below > miss:
            return t
    return m


def plan(largest: int, cosine: float) -> tuple[int, int, float]:
    """Projections in a cell, rounds of cells, and deviation of a projected difference, for the largest label.

    Chances are for a pair at the threshold (near) and for orthogonal vectors
    (far) to fall in one cell of a randomly shifted grid. Cells of g projections
    hold about CELL_ROWS of the unrelated members; the rounds follow from g.
    """
    sigma = np.sqrt(2 - 2 * cosine)
    d = np.abs(np.random.default_rng(1).normal(size=200_000))
    near, far = (np.maximum(0, 1 - d * s / (CELL * sigma)).mean() for s in (sigma, np.sqrt(2)))
    g = max(1, int(np.ceil(np.log(max(largest / CELL_ROWS, 1.001)) / -np.log(far))))
    return g, int(np.ceil(np.log(MISS_CELLS) / np.log(1 - near**g))), float(sigma)


def linked(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, cx: np.ndarray, cy: np.ndarray, same: bool, turn: int, window: float, least: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) that collide on ``least`` projections, shared no cell in an earlier round and reach the cosine in double precision."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    nx, ny = np.sqrt(np.einsum("ij,ij->i", x, x)), np.sqrt(np.einsum("ij,ij->i", y, y))
    # Bytes: a window is one subtraction modulo 256 and one comparison. What wraps around is verified, never lost.
    w, reach = np.uint8(min(127, np.ceil(window / STEP) + 1)), int(np.ceil(REACH / WINDOW * window / STEP)) + 1
    order = np.argsort(py[:, 0], kind="stable")  # the first projection is sorted: only its window is counted at all
    first = py[order, 0].astype(np.int64)
    by = np.argsort(px[:, 0], kind="stable")
    for at in range(0, len(by), 128):
        rows = by[at : at + 128]
        lo, hi = np.searchsorted(first, int(px[rows[0], 0]) - reach, "left"), np.searchsorted(first, int(px[rows[-1], 0]) + reach, "right")
        cols = order[lo:hi]
        if not len(cols):
            continue
        n = np.zeros((len(rows), len(cols)), np.uint8)
        ax, by_ = np.ascontiguousarray(px[rows].T + w)[:, :, None], np.ascontiguousarray(py[cols].T)[:, None, :]
        for j in range(px.shape[1]):
            n += (ax[j] - by_[j]) <= 2 * w
        i, k = np.nonzero(n >= least)
        i, k = rows[i], cols[k]
        if same:
            i, k = i[i < k], k[i < k]
        for s in range(0, len(i), 20_000):
            a, b = i[s : s + 20_000], k[s : s + 20_000]
            keep = ~(cx[a, :turn] == cy[b, :turn]).any(1)
            a, b = a[keep], b[keep]
            good = np.einsum("ij,ij->i", x[a], y[b]) / (nx[a] * ny[b]) >= cosine
            out.append((a[good], b[good]))
    cat = lambda z: np.concatenate(z) if z else np.zeros(0, np.int64)
    return cat([a for a, _ in out]), cat([b for _, b in out])


def linked_in_cells(x: np.ndarray, p: np.ndarray, cells: np.ndarray, cell: np.ndarray, turn: np.ndarray, window: float, least: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that linked() would give within each of many small cells.

    Rows stand by falling size of their cells and within one by the first
    projection; each is compared with the one s places on, for s = 1, 2, ...
    Only cells with more than s members are left by then, and they come first.
    """
    w, reach = np.uint8(min(127, np.ceil(window / STEP) + 1)), int(np.ceil(REACH / WINDOW * window / STEP)) + 1
    _, inverse, sizes = np.unique(cell, return_inverse=True, return_counts=True)
    order = np.lexsort((p[:, 0], inverse, -sizes[inverse]))
    of, size = inverse[order], sizes[inverse][order]
    q = np.ascontiguousarray(p[order].T)
    first = q[0].astype(np.int16)
    pairs = []
    for s in range(1, int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -s, "left"))  # rows of cells with more than s members
        near = ((q[:, : n - s] - q[:, s:n] + w) <= 2 * w).sum(0, dtype=np.uint8) >= least
        i = np.flatnonzero(near)
        i = i[(of[i] == of[i + s]) & (first[i + s] - first[i] <= reach)]
        if len(i):
            pairs.append((order[i], order[i + s]))
    cat = lambda z: np.concatenate(z) if z else np.zeros(0, np.int64)
    a, b = cat([i for i, _ in pairs]), cat([k for _, k in pairs])
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    earlier = np.arange(cells.shape[1])
    keep = []
    for at in range(0, len(a), 20_000):
        i, k = a[at : at + 20_000], b[at : at + 20_000]
        some = np.flatnonzero(np.einsum("ij,ij->i", x[i], x[k]) / (norm[i] * norm[k]) >= cosine)
        i, k = i[some], k[some]
        keep.append(at + some[~((cells[i] == cells[k]) & (earlier < turn[i][:, None])).any(1)])
    kept = cat(keep)
    return a[kept], b[kept]


def roots(n: int, a: list[int], b: list[int]) -> list[int]:
    """Smallest number that each of 0..n-1 reaches by pairs (a, b)."""
    up = list(range(n))
    for i, k in zip(a, b):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        if i != k:
            up[max(i, k)] = min(i, k)
    for i in range(n):
        up[i] = up[up[i]]
    return up


def near_duplicates(df: DataFrame, cosine: float = 0.93, seed: int = 3) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``df`` (vec_id, embedding, label).

    Vectors of one label are linked at this cosine or more. Equal vectors are one
    class with a multiplicity; only one of them goes on. In each of several
    rounds the classes of a label fall into cells of a shifted grid over a few
    projections; within a cell all 1-D projections are compared by windows
    centred on each member, collisions are counted, and pairs with enough of
    them are verified in double precision. A pair is counted in the first round
    that brings it together. Small cells go to Python many at once. Tasks put out, for each member, the sum of its
    partners' multiplicities and one tie to the cell's components: never pairs.
    Large cells are compared in blocks, all against all. The number of
    projections in a cell follows the largest label, so cells stay small and the
    work grows as about n ** 1.2; the chance to miss a link of just this cosine
    is about 1e-6, and less above it.

    Null labels, null or zero vectors and those with null or non-finite
    components: n_links 0, a component of their own. Null vec_id: the same, null. Vectors of another length
    than their label's others are compared among themselves. Repeated rows are
    vectors of their own. Empty table: empty. Other columns are dropped.
    """
    spark = df.sparkSession
    bound_batches(spark)
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").cast("string").alias("label"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & valid()
    whole = rows.filter(fit).withColumn("label", F.concat_ws("|", F.size("embedding").cast("string"), "label"))
    classes = stage(whole.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("many")), "classes")
    # The rep stands for its class only within its label and vector: repeated vec_ids cannot mix classes.
    member = whole.join(classes, ["label", "embedding"]).select("vec_id", "rep", "many")
    top, total = classes.groupBy("label").count().agg(F.max("count"), F.sum("count")).first()
    g, rounds, sigma = plan(top or 0, cosine)
    bundles = max(1, -(-(total or 0) * rounds // BUNDLE))
    window = WINDOW * sigma
    from statistics import NormalDist

    least = least_count(PROJECTIONS, 2 * NormalDist().cdf(WINDOW) - 1, MISS_COUNT)

    def project(batches):
        for b in batches:
            sizes = np.array([len(v) for v in b.column(2)])
            for d in np.unique(sizes):
                some = pa.array(np.flatnonzero(sizes == d))
                t = b.take(some)
                x = np.array(t.column(2).flatten(), np.float64).reshape(-1, d)
                u = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                rng = np.random.default_rng([seed, int(d)])
                p = np.einsum("ij,jk->ik", u, rng.normal(size=(int(d), PROJECTIONS)))
                p = np.clip(np.floor(p / STEP) + 128, 0, 255).astype(np.uint8)
                grid, shift = rng.normal(size=(int(d), rounds * g)), rng.random(rounds * g)
                cell = np.floor(np.einsum("ij,jk->ik", u, grid) / (CELL * sigma) + shift).astype(np.int64).reshape(len(u), rounds, g)
                mix = rng.integers(1, 2**62, g) * 2 + 1
                h = ((cell * mix).sum(2) ^ ((cell * mix).sum(2) >> 29)).astype(np.int32)
                lists = lambda a, kind: pa.ListArray.from_arrays(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1], pa.array(a.reshape(-1), kind))
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary()), t.column(3), pa.array([r.tobytes() for r in p], pa.binary()), lists(h, pa.int32())], names=["rep", "label", "vec", "many", "proj", "cells"])

    base = stage(classes.select("rep", "label", "embedding", "many").mapInArrow(project, "rep long, label string, vec binary, many long, proj binary, cells array<int>"), "projected")
    cells = base.select("label", F.posexplode("cells").alias("turn", "cell"))
    sizes = stage(cells.groupBy("label", "turn", "cell").agg(F.count("*").alias("m")).filter(F.col("m") > TILE), "large-cells")
    few = sizes.count() <= MOST_BROADCAST
    spread = base.select("*", F.posexplode("cells").alias("turn", "cell")).join(F.broadcast(sizes) if few else sizes, ["label", "turn", "cell"], "left")
    spread = spread.withColumn("blocks", F.coalesce(F.ceil(F.col("m") / TILE), F.lit(1)).cast("long")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    # A small cell goes with others; a large one is known by itself, and so is each pair of its blocks.
    name = F.xxhash64("label", "turn", "cell")
    spread = spread.withColumn("name", name).withColumn("bundle", F.when(F.col("blocks") == 1, F.pmod("name", F.lit(bundles))).otherwise(-1))
    spread = spread.withColumn("large", F.when(F.col("blocks") > 1, F.struct("label", "turn", "cell")))
    spread = spread.select(F.length("vec").alias("width"), "bundle", "large", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "name", "turn", "rep", "many", "vec", "proj", "cells")

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        own, rep, many = (t.column(c).to_numpy() for c in ("own", "rep", "many"))
        wide = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind).reshape(len(own), -1)
        x, p, cells = wide("vec", np.float32).astype(np.float64), wide("proj", np.uint8), t.column("cells").combine_chunks().flatten().to_numpy().reshape(len(own), -1)
        a, b, turn = t.column("a")[0].as_py(), t.column("b")[0].as_py(), t.column("turn").to_numpy()
        if t.column("bundle")[0].as_py() >= 0:
            i, k = linked_in_cells(x, p, cells, t.column("name").to_numpy(), turn, window, least, cosine)
        else:
            left, right = np.flatnonzero(own == a), np.flatnonzero(own == b)
            i, k = linked(x[left], x[right], p[left], p[right], cells[left], cells[right], a == b, int(turn[0]), window, least, cosine)
            i, k = left[i], right[k]
        links = np.bincount(i, many[k], len(own)) + np.bincount(k, many[i], len(own))
        order = np.argsort(rep, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        root = np.array(roots(len(own), rank[i].tolist(), rank[k].tolist()), np.int64)
        hub = rep[order][root[rank]] if len(own) else rep
        some = np.flatnonzero(links > 0)
        return pa.table({"id": pa.array(rep[some]), "links": pa.array(links[some].astype(np.int64)), "hub": pa.array(hub[some])})

    found = stage(spread.groupBy("width", "bundle", "large", "a", "b").applyInArrow(compare, "id long, links long, hub long"), "found")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    comps = components(found.filter("id <> hub").select(F.col("id").alias("u"), F.col("hub").alias("v")))
    done = member.join(links, F.col("rep") == F.col("id"), "left").drop("id").join(comps, F.col("rep") == F.col("id"), "left")
    done = done.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    rest = rows.filter(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
