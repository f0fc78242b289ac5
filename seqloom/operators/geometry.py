"""Union and intersection of polygons.

Axis-aligned boxes need no Python. Convex rings are clipped exactly. Any other
polygon, concave or with holes, is first cut into disjoint convex pieces, and
results that need not be convex are sets of such pieces, which is what area and
membership need. A polygon is a ring, or an array of rings of which the inside
is what an odd number of them hold: the outer ring, then its holes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.order import stage

RING = "array<struct<x:double,y:double>>"
PIECES = f"array<{RING}>"
Point = tuple[float, float]
#: Parts of a box that are united one by one; parts of a cell that one task unites; times that a fuller cell is quartered.
FEW, CELL_PARTS, DEEPEST = 2, 2048, 10
#: Times that a box is quartered in memory; parts that are worked on at once; corners of a part, beyond which it is cut; corners of a row of parts.
DEPTH, AT_ONCE, CORNERS, ROW = 12, 1 << 14, 64, 1 << 10
#: Area of what is taken for a line or point; rounding of an area that is taken for the whole box.
NONE, ROUNDED = 1e-12, 1 - 1e-12


def box_intersection(df: DataFrame, minx: str, miny: str, maxx: str, maxy: str) -> DataFrame:
    """The box common to all boxes; ``empty`` if there is none."""
    out = df.agg(F.max(minx).alias("minx"), F.max(miny).alias("miny"), F.min(maxx).alias("maxx"), F.min(maxy).alias("maxy"))
    return out.withColumn("empty", F.coalesce((F.col("minx") >= F.col("maxx")) | (F.col("miny") >= F.col("maxy")), F.lit(True)))


def box_overlaps(a: DataFrame, b: DataFrame, cell: int) -> DataFrame:
    """Pairs of boxes (id, minx, miny, maxx, maxy in whole numbers) that overlap, and their common box. An equi-join on grid cells; a pair is kept in the cell of its common box's corner alone."""

    def cells(df: DataFrame, p: str) -> DataFrame:
        named = df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "minx", "miny", "maxx", "maxy")])
        x = F.sequence(F.floor(F.col(f"{p}_minx") / cell), F.floor(F.col(f"{p}_maxx") / cell))
        y = F.sequence(F.floor(F.col(f"{p}_miny") / cell), F.floor(F.col(f"{p}_maxy") / cell))
        return named.withColumn("cx", F.explode(x)).withColumn("cy", F.explode(y))

    both = cells(a, "a").join(cells(b, "b"), ["cx", "cy"])
    both = both.withColumn("minx", F.greatest("a_minx", "b_minx")).withColumn("miny", F.greatest("a_miny", "b_miny")).withColumn("maxx", F.least("a_maxx", "b_maxx")).withColumn("maxy", F.least("a_maxy", "b_maxy"))
    own = (F.floor(F.col("minx") / cell) == F.col("cx")) & (F.floor(F.col("miny") / cell) == F.col("cy"))
    return both.filter((F.col("minx") < F.col("maxx")) & (F.col("miny") < F.col("maxy")) & own).select("a_id", "b_id", "minx", "miny", "maxx", "maxy")


def box_union_area(df: DataFrame, cell: int = 1) -> DataFrame:
    """Area that whole-number boxes cover together: distinct unit cells of a grid."""
    x = F.sequence(F.floor(F.col("minx") / cell), F.ceil(F.col("maxx") / cell) - 1)
    y = F.sequence(F.floor(F.col("miny") / cell), F.ceil(F.col("maxy") / cell) - 1)
    solid = df.filter((F.col("minx") < F.col("maxx")) & (F.col("miny") < F.col("maxy")))
    covered = solid.select(F.explode(x).alias("cx"), "miny", "maxy").select("cx", F.explode(y).alias("cy")).distinct()
    return covered.agg((F.count(F.lit(1)) * cell * cell).cast("long").alias("area"))


def area(ring: list[Point]) -> float:
    """Signed; counter-clockwise is positive."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def cut(ring: list[Point], a: Point, b: Point) -> list[Point]:
    """The part of a convex ring left of the line through a and b."""
    out: list[Point] = []
    side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    for p, q in zip(ring, ring[1:] + ring[:1]):
        s, t = side(p), side(q)
        if s >= 0:
            out.append(p)
        if (s > 0 > t) or (s < 0 < t):
            f = s / (s - t)
            out.append((p[0] + f * (q[0] - p[0]), p[1] + f * (q[1] - p[1])))
    return out if len(out) > 2 and abs(area(out)) > 1e-12 else []


def convex_intersection(p: list[Point], q: list[Point]) -> list[Point]:
    for a, b in zip(q, q[1:] + q[:1]):
        p = cut(p, a, b)
        if not p:
            return []
    return p


def _near(p: list[Point], q: list[Point]) -> bool:
    box = lambda r: (min(x for x, _ in r), min(y for _, y in r), max(x for x, _ in r), max(y for _, y in r))
    a, b = box(p), box(q)
    return a[0] < b[2] and b[0] < a[2] and a[1] < b[3] and b[1] < a[3]


def _points(ring) -> list[Point]:
    """Counter-clockwise, without points that repeat the one before, as closed rings do."""
    out = [(r["x"], r["y"]) for r in ring]
    out = [p for p, q in zip(out, out[-1:] + out[:-1]) if p != q]
    return out if area(out) > 0 else out[::-1]


def is_convex(ring: list[Point]) -> bool:
    """Of a counter-clockwise ring: no turn to the right, and once around."""
    if len(ring) < 3:
        return False
    ahead = ring[1:] + ring[:1]
    for a, b, c in zip(ring, ahead, ahead[1:] + ahead[:1]):
        s, t = (b[0] - a[0]) * (c[1] - b[1]), (b[1] - a[1]) * (c[0] - b[0])
        if s - t < -1e-12 * (abs(s) + abs(t)):  # points on a line may be rounded
            return False
    up = [p < q for p, q in zip(ring, ahead)]
    return sum(a != b for a, b in zip(up, up[1:] + up[:1])) == 2


def convex_pieces(rings: list[list[Point]]) -> list[list[Point]]:
    """Disjoint convex pieces of what an odd number of rings hold: trapezoids between neighbouring corners' and crossings' x."""
    rings = [r for r in rings if len(r) > 2]
    if len(rings) == 1 and is_convex(rings[0]):
        return rings
    edges = sorted((min(p, q), max(p, q)) for r in rings for p, q in zip(r, r[1:] + r[:1]) if p[0] != q[0])
    xs = {x for r in rings for x, _ in r}
    for i, (a, b) in enumerate(edges):
        for c, d in edges[i + 1 :]:
            if c[0] >= b[0]:
                break
            e, f = (b[1] - a[1]) / (b[0] - a[0]), (d[1] - c[1]) / (d[0] - c[0])
            if e != f:
                x = (c[1] - f * c[0] - a[1] + e * a[0]) / (e - f)
                if c[0] < x < min(b[0], d[0]):
                    xs.add(x)
    cuts, out, live, at = sorted(xs), [], [], 0
    for x0, x1 in zip(cuts, cuts[1:]):
        while at < len(edges) and edges[at][0][0] <= x0:
            live.append(edges[at])
            at += 1
        live = [e for e in live if e[1][0] > x0]
        y = lambda e, x: e[1][1] if x == e[1][0] else e[0][1] + (x - e[0][0]) * (e[1][1] - e[0][1]) / (e[1][0] - e[0][0])
        here = sorted((y(e, x0) + y(e, x1), y(e, x0), y(e, x1)) for e in live)
        for (_, a0, a1), (_, b0, b1) in zip(here[::2], here[1::2]):
            corners = [(x0, a0), (x1, a1), (x1, b1), (x0, b0)]
            piece = [p for p, q in zip(corners, corners[-1:] + corners[:-1]) if p != q]
            if len(piece) > 2 and area(piece) > 1e-12:
                out.append(piece)
    return out


def _polygon(value) -> list[list[Point]]:
    """Convex pieces of a ring, or of an array of rings; none of null."""
    if value is None or not len(value):
        return []
    nested = not (hasattr(value[0], "keys") or hasattr(value[0], "x"))
    return convex_pieces([_points(r) for r in (value if nested else [value])])


def _convex(ring) -> list[Point]:
    """The ring of a column that must be convex; lines and points are empty."""
    p = _points(ring)
    if abs(area(p)) <= 1e-12:
        return []
    if not is_convex(p):
        raise ValueError("the ring is not convex; use intersection_pieces or intersection_all_pieces")
    return p


def common_pieces(a: list[list[Point]], b: list[list[Point]]) -> list[list[Point]]:
    return [x for p in a for q in b if _near(p, q) and (x := convex_intersection(p, q))]


def _rows(ring: list[Point]) -> list[dict]:
    return [{"x": x, "y": y} for x, y in ring]


def _bounds(rings: pa.Array) -> tuple[np.ndarray, ...]:
    """Least and most x and y of each ring; those of a null or empty one meet no other."""
    offsets, flat = rings.offsets.to_numpy(), rings.flatten()
    begin = np.cumsum(np.concatenate([[0], np.diff(offsets)]))  # flatten() leaves out what lies under nulls
    n = np.diff(begin)
    some, out = np.flatnonzero(n), []
    for name in ("x", "y"):
        v = flat.field(name).to_numpy(zero_copy_only=False)
        for f, none in ((np.minimum, np.inf), (np.maximum, -np.inf)):
            own = np.full(len(n), none)
            if len(some):
                own[some] = f.reduceat(v, begin[:-1][some])
            out.append(own)
    return tuple(out)


# Many convex rings at once: (x, y, n), a row of x and of y for each ring, n corners and then the last one again.

Rings = tuple[np.ndarray, np.ndarray, np.ndarray]


def rings_of(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> Rings:
    """Rings from their corners one after another."""
    at = (np.cumsum(n) - n)[:, None] + np.minimum(np.arange(n.max(initial=0)), n[:, None] - 1)
    return x[at], y[at], n


def corners_of(r: Rings) -> tuple[np.ndarray, np.ndarray]:
    x, y, n = r
    real = np.arange(x.shape[1]) < n[:, None]
    return x[real], y[real]


def least(v: np.ndarray) -> np.ndarray:
    """Of each row; by columns, as rows are short."""
    return reduce(np.minimum, v.T, np.full(len(v), np.inf))


def most(v: np.ndarray) -> np.ndarray:
    return reduce(np.maximum, v.T, np.full(len(v), -np.inf))


def _take(r: Rings, rows: np.ndarray) -> Rings:
    x, y, n = (v[rows] for v in r)
    wide = n.max(initial=0)
    return x[:, :wide], y[:, :wide], n


def _wide(v: np.ndarray, wide: int) -> np.ndarray:
    return v if v.shape[1] == wide else np.concatenate([v, np.repeat(v[:, -1:], wide - v.shape[1], axis=1)], axis=1)


def _join(parts: list[Rings]) -> Rings:
    wide = max(p[0].shape[1] for p in parts)
    x, y = (np.concatenate([_wide(p[i], wide) for p in parts if len(p[2])] or [np.zeros((0, wide))]) for i in (0, 1))
    return x, y, np.concatenate([p[2] for p in parts])


def areas(r: Rings) -> np.ndarray:
    """Signed; from the first corner, so that rings far from the origin lose nothing."""
    x, y = r[0].T[1:] - r[0].T[:1], r[1].T[1:] - r[1].T[:1]
    return reduce(np.add, x[:-1] * y[1:] - x[1:] * y[:-1], np.zeros(len(r[2]))) / 2


def solid(r: Rings) -> np.ndarray:
    """Rows of rings that hold more than a line or point."""
    rows = np.flatnonzero(r[2] > 2)
    return rows[np.abs(areas(_take(r, rows))) > NONE]


def side(r: Rings, s: np.ndarray) -> Rings:
    """The part of each convex ring where s, linear in the plane and given at the corners, is not negative. Rings that lie beyond have fewer than three corners left."""
    x, y, n = r
    real = np.arange(x.shape[1]) < n[:, None]
    before = np.roll(s, 1, axis=1)
    cross = real & (((before > 0) & (s < 0)) | ((before < 0) & (s > 0)))
    keep = np.stack([cross, real & (s >= 0)], axis=2).reshape(len(n), -1)
    f = np.divide(before, before - s, out=np.zeros_like(s), where=cross)
    both = [np.stack([(p := np.roll(v, 1, axis=1)) + f * (v - p), v], axis=2).reshape(len(n), -1) for v in (x, y)]
    left = keep.sum(1)
    keep &= (left > 2)[:, None]
    x, y, m = rings_of(both[0][keep], both[1][keep], left[left > 2])
    if len(m) == len(n):
        return x, y, m
    out = [np.zeros((len(n), x.shape[1])) for _ in range(2)]
    out[0][left > 2], out[1][left > 2] = x, y
    return *out, np.where(left > 2, left, 0)


def _cut_rows(r: Rings, rows: np.ndarray, s: np.ndarray) -> Rings:
    """``side`` of some rows in place of them."""
    if not len(rows):
        return r
    cut_off = side(_take(r, rows), s[:, : r[2][rows].max(initial=0)])
    x, y = (_wide(v, max(cut_off[0].shape[1], v.shape[1])).copy() for v in r[:2])
    for v, c in ((x, cut_off[0]), (y, cut_off[1])):
        v[rows, : c.shape[1]] = c
        v[rows, c.shape[1] :] = c[:, -1:] if c.shape[1] else 0.0
    n = r[2].copy()
    n[rows] = cut_off[2]
    return x, y, n


def _beside(r: Rings, axis: int, mid: np.ndarray, sign: np.ndarray) -> Rings:
    """The part of each ring below its line along an axis where the sign is 1, above it where it is -1."""
    s = (mid[:, None] - r[axis]) * sign[:, None]
    rows = np.flatnonzero((least(s) < 0) & (r[2] > 2))
    if not len(rows):
        return r
    out = list(_cut_rows(r, rows, s[rows]))
    at, v = mid[rows, None], out[axis][rows]
    v = np.where(np.abs(v - at) <= 1e-15 * np.abs(at), at, v)  # crossings lie on the line itself
    out[axis][rows] = np.where(sign[rows, None] > 0, np.minimum(v, at), np.maximum(v, at))
    return tuple(out)


def convex_rows(r: Rings) -> np.ndarray:
    """``is_convex`` of each counter-clockwise ring."""
    x, y, n = r
    j = np.arange(x.shape[1])
    real, k = j < n[:, None], np.maximum(n, 1)[:, None]
    ahead = lambda v: np.take_along_axis(v, (j + 1) % k, axis=1)
    dx, dy = ahead(x) - x, ahead(y) - y
    s, t = dx * ahead(dy), dy * ahead(dx)
    up = (x < ahead(x)) | ((x == ahead(x)) & (y < ahead(y)))
    turns = ((up != ahead(up)) & real).sum(1)
    return (n > 2) & ~((s - t < -1e-12 * (np.abs(s) + np.abs(t))) & real).any(1) & (turns == 2)


def first_corner(r: Rings) -> Rings:
    """Rings from their least corner on, so equal ones are written alike."""
    x, y, n = r
    if not len(n):
        return r
    x, y = x + 0.0, y + 0.0  # no -0.0
    first = np.where(x == least(x)[:, None], y, np.inf).argmin(1)
    j = np.minimum(np.arange(x.shape[1]), n[:, None] - 1)
    at = (first[:, None] + j) % n[:, None]
    return np.take_along_axis(x, at, axis=1), np.take_along_axis(y, at, axis=1), n


def distinct_rows(r: Rings, group: np.ndarray) -> np.ndarray:
    """Rows of rings from ``first_corner``, one of equal ones of a group."""
    h = group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for v in r[:2]:
        for c in v.T:
            bits = c.astype(np.float64).view(np.uint64)
            h = ((h << np.uint64(7)) | (h >> np.uint64(57))) ^ (bits ^ (bits >> np.uint64(29)))
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
    order = np.argsort(h, kind="stable")
    same = (h[order][1:] == h[order][:-1]) & (group[order][1:] == group[order][:-1])
    maybe = np.flatnonzero(same)
    p, q = order[maybe], order[maybe + 1]
    same[maybe] = (r[0][p] == r[0][q]).all(1) & (r[1][p] == r[1][q]).all(1)
    return np.sort(order[np.concatenate([[True], ~same])[: len(order)]])


def differences(p: Rings, q: Rings) -> tuple[Rings, np.ndarray]:
    """Each p without the q of its row, as convex pieces, and the row of each: what lies outside each edge in turn."""
    qx, qy, k = q
    left, rows = p, np.arange(len(p[2]))
    out, of = [_take(p, rows[:0])], [rows[:0]]
    for e in range(k.max(initial=0)):
        f = np.where(e + 1 < k[rows], e + 1, 0)
        ax, ay, bx, by = qx[rows, e], qy[rows, e], qx[rows, f], qy[rows, f]
        s = (bx - ax)[:, None] * (left[1] - ay[:, None]) - (by - ay)[:, None] * (left[0] - ax[:, None])
        cuts = np.flatnonzero((e < k[rows]) & (least(s) < 0))
        if not len(cuts):
            continue
        outside = side(_take(left, cuts), -s[cuts][:, : left[2][cuts].max()])
        some = solid(outside)
        out.append(_take(outside, some))
        of.append(rows[cuts[some]])
        left = _cut_rows(left, cuts, s[cuts])
        stay = np.ones(len(rows), bool)
        stay[cuts] = False
        stay[cuts[solid(_take(left, cuts))]] = True
        stay = np.flatnonzero(stay)
        left, rows = _take(left, stay), rows[stay]
        if not len(rows):
            break
    return _join(out), np.concatenate(of)


def unite_few(r: Rings, box: np.ndarray) -> tuple[Rings, np.ndarray]:
    """Disjoint convex pieces of the union of each box's rings, one ring after another, and the box of each piece."""
    order = np.argsort(box, kind="stable")
    r, box = _take(r, order), box[order]
    first = np.searchsorted(box, box)
    place = np.arange(len(box)) - first
    done = [(_take(r, np.flatnonzero(place == 0)), box[place == 0])]
    rows = np.flatnonzero(place > 0)
    left, at, of = _take(r, rows), first[rows], rows
    i = 0
    while len(of):  # those that come after ring i lose what it holds
        q = _take(r, at + i)
        near = np.logical_and.reduce([(least(left[i]) < most(q[i])) & (least(q[i]) < most(left[i])) for i in (0, 1)])
        meet, free = np.flatnonzero(near), np.flatnonzero(~near)
        pieces, row = differences(_take(left, meet), _take(q, meet))
        left, at, of = _join([_take(left, free), pieces]), np.concatenate([at[free], at[meet][row]]), np.concatenate([of[free], of[meet][row]])
        i += 1
        last = of - at == i
        done.append((_take(left, np.flatnonzero(last)), box[of[last]]))
        more = np.flatnonzero(~last)
        left, at, of = _take(left, more), at[more], of[more]
    return _join([d[0] for d in done]), np.concatenate([d[1] for d in done])


def box_rings(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> Rings:
    return np.stack([x0, x1, x1, x0], axis=1), np.stack([y0, y0, y1, y1], axis=1), np.full(len(x0), 4)


def unite_boxes(r: Rings, group: np.ndarray, level: np.ndarray, cx: np.ndarray, cy: np.ndarray, cell: float) -> Iterator[tuple[Rings, np.ndarray]]:
    """Disjoint convex pieces of the union of the rings in each box of the grid, and the group of each piece, by quarters of the boxes.

    ``group`` counts from 0 and points into level, cx and cy. A box that one
    ring covers is done, whatever else is there; few rings are united one by
    one; else the quarters are united by themselves. So the work follows the
    outlines in a box, not the square of the number of rings. All boxes of a
    depth go together, AT_ONCE parts at a time, and the deepest go first.
    """
    todo = [(r, group, np.arange(len(level)), level, cx, cy, 0)]
    full = []
    while todo:
        r, box, root, level, cx, cy, depth = todo.pop()
        size = cell / np.exp2(level)
        covers = areas(r) >= (size * size)[box] * ROUNDED
        covered = np.zeros(len(root), bool)
        covered[box[covers]] = True
        if covered.any():
            full.append(tuple(v[covered] for v in (root, level, cx, cy)))
            rest = np.flatnonzero(~covered[box])
            r, box = _take(r, rest), box[rest]
        count = np.bincount(box, minlength=len(root))
        many = np.flatnonzero(count[box] > FEW)
        if len(many):
            alike = first_corner(_take(r, many))
            some = distinct_rows(alike, box[many])
            few = np.flatnonzero(count[box] <= FEW)
            r, box = _join([_take(r, few), _take(alike, some)]), np.concatenate([box[few], box[many[some]]])
            count = np.bincount(box, minlength=len(root))
        end = (count[box] <= FEW) | (depth == DEPTH)
        if end.any():
            few = np.flatnonzero(end)
            pieces, of = unite_few(_take(r, few), box[few])
            yield pieces, root[of]
        rest = np.flatnonzero(~end)
        if not len(rest):
            continue
        r, box = _take(r, rest), box[rest]
        mx, my = ((2 * c[box] + 1) * (size[box] / 2) for c in (cx, cy))
        lower, upper = (least(r[0]) < mx, most(r[0]) > mx), (least(r[1]) < my, most(r[1]) > my)
        row, quarter = np.nonzero(np.stack([lower[0] & upper[0], lower[1] & upper[0], lower[0] & upper[1], lower[1] & upper[1]], axis=1))
        order = np.argsort(box[row] * 4 + quarter, kind="stable")
        row, quarter = row[order], quarter[order]
        key = box[row] * 4 + quarter
        at = 0
        while at < len(row):
            to = min(at + AT_ONCE, len(row))
            to = len(row) if to == len(row) else max(np.searchsorted(key, key[to]), np.searchsorted(key, key[at], side="right"))  # boxes stay whole
            took, q = row[at:to], quarter[at:to]
            part = _take(r, took)
            i, j = q & 1, q >> 1
            for axis, mid, which in ((0, mx[took], i), (1, my[took], j)):
                sign = 1.0 - 2 * which
                part = _beside(part, axis, mid, sign)
            some = solid(part)
            if len(some):
                part, own = _take(part, some), key[at:to][some]
                keys, child = np.unique(own, return_inverse=True)
                old, q = keys >> 2, keys & 3
                todo.append((part, child, root[old], level[old] + 1, 2 * cx[old] + (q & 1), 2 * cy[old] + (q >> 1), depth + 1))
            at = to
    if full:
        yield _full_boxes(*(np.concatenate(v) for v in zip(*full)), cell)


def _full_boxes(root: np.ndarray, level: np.ndarray, cx: np.ndarray, cy: np.ndarray, cell: float) -> tuple[Rings, np.ndarray]:
    """Boxes that are covered, four quarters as one."""
    out, own, at = [], [v[:0] for v in (root, cx, cy)], level.max()
    while at >= level.min() or len(own[0]):
        own = [np.concatenate([u, v[level == at]]) for u, v in zip(own, (root, cx, cy))]
        up = own[0], own[1] >> 1, own[2] >> 1
        order = np.lexsort(up)
        up, own = [v[order] for v in up], [v[order] for v in own]
        begin = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([v[1:] != v[:-1] for v in up])])[: len(order)])
        n = np.diff(np.append(begin, len(order)))
        whole = np.repeat(n == 4, n)
        out.append([v[~whole] for v in own] + [np.full((~whole).sum(), at)])
        own, at = [v[begin[n == 4]] for v in up], at - 1
    root, cx, cy, level = (np.concatenate(v) for v in zip(*out))
    size = cell / np.exp2(level)
    return box_rings(cx * size, cy * size, (cx + 1) * size, (cy + 1) * size), root


def _convex_rings(column: pa.Array) -> Iterator[Rings]:
    """Convex pieces of a column of polygons, those with about as many corners together. Rings that are convex need no Python of their own."""
    column = column.drop_null()
    if pa.types.is_list(column.type.value_type):
        n = np.diff(column.offsets.to_numpy())
        others = column.filter(pa.array(n > 1))
        column = column.filter(pa.array(n == 1)).flatten().drop_null()
    else:
        others = column.slice(0, 0)
    offsets, corners = column.offsets.to_numpy(), column.values
    n = np.diff(offsets).astype(np.int64)
    if corners.null_count:
        raise ValueError("a corner of a ring is null")
    x, y = (corners.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("x", "y"))
    x, y = x[offsets[0] : offsets[-1]], y[offsets[0] : offsets[-1]]
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        raise ValueError("a corner of a ring is null or not finite")
    odd, begin = [], np.cumsum(n) - n
    width = np.ceil(np.log2(np.maximum(n, 8)))
    for w in np.unique(width[n > 2]).tolist():
        rows = np.flatnonzero((width == w) & (n > 2))
        step = max(1, (AT_ONCE << 4) >> int(w))
        for own in (rows[i : i + step] for i in range(0, len(rows), step)):
            at = begin[own][:, None] + np.minimum(np.arange(n[own].max()), n[own][:, None] - 1)
            r = x[at], y[at], n[own]
            keep = (np.arange(at.shape[1]) < r[2][:, None]) & ((r[0] != np.roll(r[0], 1, axis=1)) | (r[1] != np.roll(r[1], 1, axis=1)))  # closed rings repeat a point
            m = keep.sum(1)
            some = m > 2
            own, r = own[some], rings_of(r[0][keep & some[:, None]], r[1][keep & some[:, None]], m[some])
            back = areas(r) < 0
            j = np.arange(r[0].shape[1])
            turn = np.where(back[:, None], np.maximum(r[2][:, None] - 1 - j, 0), j)
            r = np.take_along_axis(r[0], turn, axis=1), np.take_along_axis(r[1], turn, axis=1), r[2]
            convex = convex_rows(r)
            odd += own[~convex].tolist()
            if convex.any():
                yield _take(r, np.flatnonzero(convex))
    pieces = [p for v in chain(others.to_pylist(), column.take(pa.array(odd, pa.int64())).to_pylist()) for p in _polygon(v)]
    for i in range(0, len(pieces), AT_ONCE):
        own = pieces[i : i + AT_ONCE]
        flat = np.array([c for p in own for c in p])
        yield rings_of(flat[:, 0], flat[:, 1], np.array([len(p) for p in own]))


def intersection(df: DataFrame, a: str, b: str, out: str = "ring") -> DataFrame:
    """The common part of two convex rings of a row; an empty array if there is none. Other rings whose bounds meet are an error: see ``intersection_pieces``."""

    @F.arrow_udf(RING)
    def clip(x: pa.Array, y: pa.Array) -> pa.Array:
        x, y = (v.cast(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))) for v in (x, y))
        p, q = _bounds(x.fill_null([])), _bounds(y.fill_null([]))
        near = np.flatnonzero((p[0] < q[1]) & (q[0] < p[1]) & (p[2] < q[3]) & (q[2] < p[3]))
        rows = [[]] * len(x)
        for i, r, s in zip(near.tolist(), x.take(pa.array(near)).to_pylist(), y.take(pa.array(near)).to_pylist()):
            rows[i] = _rows(convex_intersection(_convex(r), _convex(s)))
        return pa.array(rows, x.type)

    return df.withColumn(out, clip(F.col(a), F.col(b)))


def intersection_pieces(df: DataFrame, a: str, b: str, out: str = "pieces") -> DataFrame:
    """The common part of two polygons of a row, as disjoint convex pieces."""

    @F.pandas_udf(PIECES)
    def clip(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[_rows(r) for r in common_pieces(_polygon(p), _polygon(q))] for p, q in zip(x, y)])

    return df.withColumn(out, clip(F.col(a), F.col(b)))


def union_all(df: DataFrame, ring: str, cell: float, out: str = "piece") -> DataFrame:
    """Disjoint convex pieces whose union is that of all polygons of the frame, with the cell (cx, cy) that each lies in.

    Rings are cut at a grid, a row holds the parts of a cell that a task met
    together, and each cell is united by itself, so the work is spread by place
    and pieces of different cells never overlap. Cells that hold more than
    CELL_PARTS parts, unless one of them covers the cell, are quartered again
    and again before any is gathered, up to DEEPEST times, and equal parts of a
    quarter become one; beyond that (rings that all pass through one point)
    parts are first united in blocks. Null and empty polygons add
    nothing. Empty table: empty. Other columns are dropped.
    """
    key = ["level", "cx", "cy"]
    kinds = "level int, cx bigint, cy bigint, n bigint, covers boolean, corners binary, points binary"

    def table(r: Rings, level: np.ndarray, cx: np.ndarray, cy: np.ndarray, covers: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
        """A row for each of the runs of rings that begin there; points are x and y in turn."""
        n = np.diff(np.append(begin, len(level)))
        ends = np.concatenate([[0], np.cumsum(r[2])]).astype(np.int32)
        binary = lambda at, data: pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
        at = np.append(begin, len(level))
        columns = [pa.array(v[begin]) for v in (level.astype(np.int32), cx, cy)] + [pa.array(n), pa.array(np.logical_or.reduceat(covers, begin) if len(begin) else covers)]
        columns += [binary(at * 4, r[2].astype(np.int32).tobytes()), binary(ends[at] * 16, np.stack(corners_of(r), axis=1).tobytes())]
        return pa.RecordBatch.from_arrays(columns, names=[*key, "n", "covers", "corners", "points"])

    def unpacked(b: pa.RecordBatch | pa.Table) -> tuple[Rings, np.ndarray, list[np.ndarray]]:
        """Rings, the row of each, and the key of each row."""
        n = np.frombuffer(b"".join(b.column("corners").to_pylist()), np.int32).astype(np.int64)
        points = np.frombuffer(b"".join(b.column("points").to_pylist()), np.float64).reshape(-1, 2)
        return rings_of(points[:, 0], points[:, 1], n), np.repeat(np.arange(b.num_rows), b.column("n").to_numpy()), [b.column(c).to_numpy() for c in key]

    def parts_of(r: Rings, level: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> tuple:
        """What is left of rings in their boxes; boxes that a ring covers have that part alone, and parts of many corners are cut."""
        size = cell / np.exp2(level)
        x0, y0, x1, y1 = cx * size, cy * size, (cx + 1) * size, (cy + 1) * size
        for axis, low, high in ((0, x0, x1), (1, y0, y1)):
            r = _beside(_beside(r, axis, high, np.ones(len(size))), axis, low, -np.ones(len(size)))
        some = solid(r)
        r, (level, cx, cy, size, x0, y0, x1, y1) = _take(r, some), (v[some] for v in (level, cx, cy, size, x0, y0, x1, y1))
        covers = areas(r) >= size * size * ROUNDED
        if (r[2] > CORNERS).any():
            fans = [(i, [0, *range(k, min(k + CORNERS - 1, m))]) for i, m in enumerate(r[2].tolist()) for k in range(1, m - 1, CORNERS - 2)]
            rows, n = np.array([i for i, _ in fans]), np.array([len(at) for _, at in fans])
            at = np.concatenate([at for _, at in fans])
            r = rings_of(r[0][np.repeat(rows, n), at], r[1][np.repeat(rows, n), at], n)
            level, cx, cy, covers, x0, y0, x1, y1 = (v[rows] for v in (level, cx, cy, covers, x0, y0, x1, y1))
        if covers.any():
            box = box_rings(x0[covers], y0[covers], x1[covers], y1[covers])
            rest = np.flatnonzero(~covers)
            order = np.concatenate([rest, np.flatnonzero(covers)])
            r = _join([_take(r, rest), box])
            level, cx, cy, covers = (v[order] for v in (level, cx, cy, covers))
        return first_corner(r), level, cx, cy, covers

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in _convex_rings(b.column(0)):
                low, high = ([(f(v) // cell).astype(np.int64) for v in r[:2]] for f in (least, most))
                wide, tall = high[0] - low[0] + 1, high[1] - low[1] + 1
                ends = np.cumsum(wide * tall)
                step = max(1, (AT_ONCE << 4) // max(r[0].shape[1], 16))
                for begin in range(0, int(ends[-1]), step):
                    one = np.arange(begin, min(begin + step, ends[-1]))
                    row = np.searchsorted(ends, one, side="right")
                    one = one - (ends[row] - (wide * tall)[row])
                    cx, cy = low[0][row] + one // tall[row], low[1][row] + one % tall[row]
                    own, level, cx, cy, covers = parts_of(_take(r, row), np.zeros(len(row), np.int64), cx, cy)
                    if not len(cx):
                        continue
                    order = np.lexsort((~covers, cy, cx))
                    own, cx, cy, covers = _take(own, order), cx[order], cy[order], covers[order]
                    new = np.concatenate([[True], (cx[1:] != cx[:-1]) | (cy[1:] != cy[:-1])])
                    some = np.flatnonzero(new | ~covers[new][np.cumsum(new) - 1])  # of a covered cell the part that covers it
                    own, new = _take(own, some), new[some]
                    new[1:] |= np.diff(np.cumsum(own[2]) // ROW) > 0
                    yield table(own, level[some], cx[some], cy[some], covers[some], np.flatnonzero(new))

    def quarters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, row, (level, cx, cy) = unpacked(b)
            for begin in range(0, len(row), AT_ONCE):
                at = np.repeat(np.arange(begin, min(begin + AT_ONCE, len(row))), 4)
                i, own = np.arange(len(at)) % 4, row[at]
                part, level4, cx4, cy4, covers = parts_of(_take(r, at), level[own] + 1, 2 * cx[own] + (i & 1), 2 * cy[own] + (i >> 1))
                yield table(part, level4, cx4, cy4, covers, np.arange(len(cx4)))

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Rings, np.ndarray, list[np.ndarray]]]:
        """Whole groups of rows, which come sorted by what tells groups apart, as many as hold AT_ONCE parts, or one."""
        kept, n = [], 0
        for b in chain(batches, [None]):
            if b is not None:
                kept.append(b)
                n += sum(b.column("n").to_pylist())
            if not kept or (n < AT_ONCE and b is not None):
                continue
            t = pa.Table.from_batches(kept).combine_chunks()
            names = [c for c in t.schema.names if c not in ("n", "corners", "points")]
            own, size = [t.column(c).to_numpy() for c in names], t.column("n").to_numpy()
            new = np.concatenate([[True], np.logical_or.reduce([v[1:] != v[:-1] for v in own])])
            begin = np.append(np.flatnonzero(new), t.num_rows)
            stop = len(begin) - 1 - (b is not None)  # the last group may go on
            ends, at = np.cumsum(size)[begin[1:] - 1], 0
            while at < stop:
                to = min(max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")), at + 1), stop)
                rings, row, keys = unpacked(t.slice(begin[at], begin[to] - begin[at]))
                yield rings, (np.cumsum(new[begin[at] : begin[to]]) - 1)[row], [v[begin[at:to] - begin[at]] for v in keys]
                at = to
            kept, n = (t.slice(begin[stop]).to_batches(), int(size[begin[stop] :].sum())) if b is not None else ([], 0)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, group, (level, cx, cy) in groups(batches):
            for pieces, of in unite_boxes(r, group, level.astype(np.int64), cx, cy, cell):
                x, y = corners_of(pieces)
                ends = pa.array(np.concatenate([[0], np.cumsum(pieces[2])]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"]))
                yield pa.RecordBatch.from_arrays([pa.array(v[of] >> level[of]) for v in (cx, cy)] + [lists], names=["cx", "cy", out])

    def unite_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, group, at in groups(batches):
            for pieces, of in unite_boxes(r, group, at[0].astype(np.int64), *at[1:], cell):
                level, cx, cy = (v[of] for v in at)
                yield table(pieces, level, cx, cy, np.zeros(len(of), bool), np.arange(len(of)))

    def met(parts: DataFrame, *by: str) -> DataFrame:
        """Groups meet by their keys and go through a worker one after another, without a call for each."""
        return parts.select(*by, "n", "corners", "points").repartition(*by).sortWithinPartitions(*by)

    def united(parts: DataFrame) -> DataFrame:
        return met(parts, *key).mapInArrow(unite, f"cx bigint, cy bigint, {out} {RING}")

    parts = stage(df.select(ring).mapInArrow(cells, kinds))
    done = []
    for depth in range(DEEPEST + 1):
        counts = parts.groupBy(*key).agg(F.sum("n").alias("parts"), F.max("covers").alias("covered"))
        full = stage(counts.filter(F.col("parts") > CELL_PARTS).select(*key, "covered"))
        if full.isEmpty():
            done.append(united(parts))
            break
        one = parts.filter("covers").join(full.filter("covered"), key, "left_semi").dropDuplicates(key)  # one part that covers a cell is all of it
        done.append(united(parts.join(full, key, "left_anti").unionByName(one)))
        rest = parts.join(full.filter("NOT covered"), key, "left_semi")
        if depth == DEEPEST:
            blocks = met(rest.withColumn("salt", F.pmod(F.xxhash64("points"), F.lit(64))), *key, "salt").mapInArrow(unite_blocks, kinds)
            done.append(united(blocks))
            break
        parts = stage(rest.mapInArrow(quarters, kinds).distinct())
    return reduce(DataFrame.unionByName, done)


def intersection_all(df: DataFrame, ring: str, out: str = "ring") -> DataFrame:
    """The part common to all convex rings: partial in each task, then the partials. Other rings are an error: see ``intersection_all_pieces``."""

    def fold(rings, check=_points) -> list[Point] | None:
        total = None
        for r in rings:
            p = check(r) if r is not None else []
            total = p if total is None else convex_intersection(total, p)
            if not total:
                return []
        return total

    def local(batches):
        rings = [_rows(x) for pdf in batches if (x := fold(pdf[ring], _convex)) is not None]
        total = fold(rings)
        if total is not None:
            yield pd.DataFrame({out: [_rows(total)]})

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({out: [_rows(fold(pdf[out]))]})

    return df.select(ring).mapInPandas(local, f"{out} {RING}").withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(final, f"{out} {RING}")


def intersection_all_pieces(df: DataFrame, polygon: str, out: str = "pieces") -> DataFrame:
    """The part common to all polygons, as disjoint convex pieces: partial in each task, then the partials."""

    def fold(total, sets):
        for p in sets:
            total = p if total is None else common_pieces(total, p)
            if not total:
                return []
        return total

    def local(batches):
        total = None
        for pdf in batches:
            total = fold(total, map(_polygon, pdf[polygon]))
        if total is not None:
            yield pd.DataFrame({out: [[_rows(p) for p in total]]})

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({out: [[_rows(p) for p in fold(None, ([_points(r) for r in v] for v in pdf[out]))]]})

    return df.select(polygon).mapInPandas(local, f"{out} {PIECES}").withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(final, f"{out} {PIECES}")


def pieces_area(pieces: str | Column) -> Column:
    """Area of disjoint pieces together."""
    r = F.col(pieces) if isinstance(pieces, str) else pieces
    return F.aggregate(F.transform(r, ring_area), F.lit(0.0), lambda s, v: s + v)


def ring_area(ring: str | Column) -> Column:
    """Area of a ring by the shoelace formula, without Python."""
    r = F.col(ring) if isinstance(ring, str) else ring
    nxt = F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    return F.abs(F.aggregate(F.zip_with(r, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)) / 2
