"""Concave polygons and polygons with holes, held against rasters of their insides."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import geometry

L = [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]
BOX = [(0.2, 1.2), (0.8, 1.2), (0.8, 1.8), (0.2, 1.8)]
COMB = [(0, 0), (3, 0), (3, 2), (2, 2), (2, 0.5), (1, 0.5), (1, 2), (0, 2), (0, 0)]  # closed
HOLED = [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (1, 3), (3, 3), (3, 1)]]


def ring(points):
    return [(float(x), float(y)) for x, y in points]


def inside(rings, n=400, size=4.0):
    """By crossings, for the middles of n x n squares."""
    at = (np.arange(n) + 0.5) * size / n
    X, Y = np.meshgrid(at, at)
    odd = np.zeros((n, n), bool)
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
            if ay != by:
                odd ^= ((ay > Y) != (by > Y)) & (X < ax + (Y - ay) * (bx - ax) / (by - ay))
    return odd


def raster(mask, size=4.0):
    return float(mask.mean()) * size * size


def union(spark, polygons, cell):
    df = spark.createDataFrame([(p,) for p in polygons], f"p {geometry.PIECES}")
    return geometry.union_all(df, "p", cell).agg(F.sum(geometry.ring_area("piece"))).first()[0]


def test_box_in_an_l_counts_once(spark):
    df = spark.createDataFrame([(ring(L),), (ring(BOX),)], f"ring {geometry.RING}")
    assert geometry.union_all(df, "ring", 5.0).agg(F.sum(geometry.ring_area("piece"))).first()[0] == pytest.approx(3.0)


def test_polygons_against_a_raster(spark):
    shapes = [[ring(L)], [ring(COMB)], [ring(r) for r in HOLED]]
    masks = [inside(s) for s in shapes]
    assert union(spark, shapes, 1.5) == pytest.approx(raster(masks[0] | masks[1] | masks[2]), abs=0.02)
    pairs = [(shapes[i], shapes[j], raster(masks[i] & masks[j])) for i in range(3) for j in range(3)]
    df = spark.createDataFrame(pairs, f"a {geometry.PIECES}, b {geometry.PIECES}, want double")
    for r in geometry.intersection_pieces(df, "a", "b").select("want", geometry.pieces_area("pieces").alias("got")).collect():
        assert r["got"] == pytest.approx(r["want"], abs=0.02)
    every = spark.createDataFrame([(s,) for s in shapes], f"p {geometry.PIECES}").repartition(2)
    got = geometry.intersection_all_pieces(every, "p").select(geometry.pieces_area("pieces")).first()[0]
    assert got == pytest.approx(raster(masks[0] & masks[1] & masks[2]), abs=0.02)


def test_random_stars(spark):
    rng = np.random.default_rng(3)
    for _ in range(40):
        t = np.sort(rng.uniform(0, 2 * np.pi, 11))
        r = rng.uniform(0.3, 1.9, 11)
        p = [(2 + a * np.cos(b), 2 + a * np.sin(b)) for a, b in zip(r, t)]
        pieces = geometry.convex_pieces([p])
        assert sum(map(geometry.area, pieces)) == pytest.approx(raster(inside([p])), abs=0.05)
        assert all(geometry.area(x) > 0 for x in pieces)


def test_one_ring_results_refuse_concave_rings(spark):
    df = spark.createDataFrame([(ring(L), ring(BOX))], f"a {geometry.RING}, b {geometry.RING}")
    with pytest.raises(Exception, match="not convex"):
        geometry.intersection(df, "a", "b").collect()


@pytest.mark.parametrize("parts,deepest", ((6, 10), (6, 1)))
def test_full_cells_are_quartered(spark, monkeypatch, parts, deepest):
    """Many rings in one cell of the grid: quartered, and in blocks where no more quartering is allowed."""
    monkeypatch.setattr(geometry, "CELL_PARTS", parts)
    monkeypatch.setattr(geometry, "DEEPEST", deepest)
    rng = np.random.default_rng(7)
    boxes = [[ring([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])] for x, y, w, h in zip(*rng.integers(0, 30, (2, 60)) / 10, *rng.integers(1, 10, (2, 60)) / 10)]
    tri = [[ring([(1, 1), (3, 1.5), (2, 3)])]] * 5
    shapes = boxes + tri + [[], None]
    assert union(spark, shapes, 4.0) == pytest.approx(raster(np.any([inside(s) for s in boxes + tri], axis=0)), abs=0.02)
    assert union(spark, [[ring([(0, 0), (4, 0), (4, 4), (0, 4)])], *boxes], 4.0) == pytest.approx(16.0)
