"""The union of many polygons: how much is written and put out, and what the boxes' pieces hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_concave import inside, raster, ring

from seqloom.operators import geometry


def box(x, y, w, h):
    return ring([(x, y), (x + w, y), (x + w, y + h), (x, y + h)])


def area(spark, rings, cell):
    df = spark.createDataFrame([(r,) for r in rings], f"ring {geometry.RING}")
    return geometry.union_all(df, "ring", cell).agg(F.sum(geometry.ring_area("piece"))).first()[0]


def test_parts_of_a_cell_are_written_together(spark, monkeypatch):
    """Rows written follow the cells that a task meets, not the rings' parts: before, 3,000 boxes were 5,293 rows."""
    written = []
    own = geometry.stage
    monkeypatch.setattr(geometry, "stage", lambda df: written.append(own(df)) or written[-1])
    rng = np.random.default_rng(5)
    x, y, w, h = *rng.integers(0, 80, (2, 3000)), *rng.integers(1, 8, (2, 3000))
    want = np.zeros((90, 90), bool)
    for a, b, c, d in zip(x, y, w, h):
        want[a : a + c, b : b + d] = True
    df = spark.createDataFrame([(box(*b),) for b in zip(x, y, w, h)], f"ring {geometry.RING}").coalesce(1)
    assert geometry.union_all(df, "ring", 8.0).agg(F.sum(geometry.ring_area("piece"))).first()[0] == want.sum()
    assert written[0].count() < 500


def test_rings_that_share_an_edge_end_early(spark):
    """Parts that are alike in a quarter count once: before, there were 8,192 pieces along the edge."""
    rings = [ring([(0, 0), (4, 4), (0, 4 - i / 10)]) for i in range(12)]
    df = spark.createDataFrame([(r,) for r in rings], f"ring {geometry.RING}")
    pieces = geometry.union_all(df, "ring", 4.0).select(geometry.ring_area("piece").alias("area")).toPandas()["area"]
    assert pieces.sum() == pytest.approx(8.0)
    assert len(pieces) < 1500


def test_pieces_of_boxes(monkeypatch):
    """In two boxes of the grid, many parts and few at once, far from the origin too: pieces are convex, hold each point of a ring once, and no other."""
    rng = np.random.default_rng(6)
    for at_once, far in ((1 << 14, 0), (7, 0), (64, 1 << 20)):
        monkeypatch.setattr(geometry, "AT_ONCE", at_once)
        rings, of = [], []
        for i in range(80):
            t = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 8)))
            x, y = rng.uniform(1, 3, 2)
            rings.append([(x + 4 * (far + i % 2) + np.cos(a), y + np.sin(a)) for a in t])
            of.append(i % 2)
        flat = np.array([p for r in rings for p in r])
        r = geometry.rings_of(flat[:, 0], flat[:, 1], np.array([len(p) for p in rings]))
        got = list(geometry.unite_boxes(r, np.array(of), np.zeros(2, int), np.array([far, far + 1]), np.zeros(2, int), 4.0))
        assert all(geometry.convex_rows(p).all() for p, _ in got)
        pieces = [list(zip(x[:n], y[:n])) for p, _ in got for x, y, n in zip(*p)]
        points = np.column_stack([rng.uniform(4 * far, 4 * far + 8, 400), rng.uniform(0, 4, 400)])
        held = lambda p: np.all([(b[0] - a[0]) * (points[:, 1] - a[1]) - (b[1] - a[1]) * (points[:, 0] - a[0]) > 0 for a, b in zip(p, p[1:] + p[:1])], axis=0)
        assert (np.sum([held(p) for p in pieces], axis=0) == np.any([held(p) for p in rings], axis=0)).all()


def test_rings_of_many_corners(spark):
    """Cut where a row of parts would get wide; clockwise and closed rings count as the others."""
    t = np.linspace(0, 2 * np.pi, 600, endpoint=False)
    circle = [(float(2 + np.cos(a)), float(2 + np.sin(a))) for a in t]
    whole = 300 * np.sin(2 * np.pi / 600)
    assert area(spark, [circle, circle[::-1], circle + circle[:1], circle[100:] + circle[:100]], 5.0) == pytest.approx(whole)
    assert area(spark, [circle, box(1.5, 1.5, 1, 1)], 0.75) == pytest.approx(whole)
    star = [(float(2 + r * np.cos(a)), float(2 + r * np.sin(a))) for a, r in zip(np.linspace(0, 2 * np.pi, 24, endpoint=False).tolist(), [0.8, 1.8] * 12)]
    assert area(spark, [star, circle, []], 1.0) == pytest.approx(raster(inside([star]) | inside([circle])), abs=0.02)


def test_copies_and_covering_rings_in_a_full_cell(spark, monkeypatch):
    monkeypatch.setattr(geometry, "CELL_PARTS", 50)
    tri = ring([(1, 1), (3, 1.5), (2, 3)])
    assert area(spark, [tri] * 400, 4.0) == pytest.approx(1.75)
    assert area(spark, [tri] * 400 + [box(0, 0, 4, 4)] * 3 + [box(4, 0, 1, 1)], 4.0) == pytest.approx(17.0)


def test_corners_that_are_no_numbers_are_an_error(spark):
    for bad in (float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="null or not finite"):
            area(spark, [[(0.0, 0.0), (1.0, 0.0), (1.0, bad)]], 4.0)
