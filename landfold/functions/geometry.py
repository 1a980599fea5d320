"""Geometry on rings: a polygon is an array of rings, outer first, a ring an array of (x, y) structs, closed. Sums over one ring
are column expressions; hulls, clipping, simplification and geodesic areas are Arrow functions over NumPy."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = "struct<x: double, y: double>"
RING, POLYGON = f"array<{POINT}>", f"array<array<{POINT}>>"
#: Fixed values of the WGS84 ellipsoid.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563


def ring_from(points: list[tuple]) -> Column:
    return F.array(*[F.struct(F.lit(0.0) + x, F.lit(0.0) + y) for x, y in points]).cast(RING)


def box_ring(minx: str, miny: str, maxx: str, maxy: str) -> Column:
    """Counter-clockwise."""
    a, b, c, d = (F.col(v) for v in (minx, miny, maxx, maxy))
    return ring_from([(a, b), (c, b), (c, d), (a, d), (a, b)])


def segments(ring) -> Column:
    ring = F.col(ring) if isinstance(ring, str) else ring
    n = F.size(ring)
    return F.when(n > 1, F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array().cast(f"array<struct<a: {POINT}, b: {POINT}>>"))


def signed_area(ring) -> Column:
    """Shoelace: above 0 for counter-clockwise rings."""
    return F.aggregate(segments(ring), F.lit(0.0), lambda t, s: t + (s.a.x * s.b.y - s.b.x * s.a.y)) / 2


def ring_length(ring) -> Column:
    return F.aggregate(segments(ring), F.lit(0.0), lambda t, s: t + F.sqrt(F.pow(s.b.x - s.a.x, F.lit(2)) + F.pow(s.b.y - s.a.y, F.lit(2))))


def polygon_area(polygon: str) -> Column:
    """The outer ring's less those of the holes."""
    outer = F.abs(signed_area(F.col(polygon)[0]))
    holes = F.aggregate(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.lit(0.0), lambda t, r: t + F.abs(signed_area(r)))
    return outer - holes


def centroid(ring) -> Column:
    total = signed_area(ring)
    part = lambda k: F.aggregate(segments(ring), F.lit(0.0), lambda t, s: t + (s.a[k] + s.b[k]) * (s.a.x * s.b.y - s.b.x * s.a.y))
    return F.struct((part("x") / (6 * total)).alias("x"), (part("y") / (6 * total)).alias("y"))


def bounds(ring) -> Column:
    ring = F.col(ring) if isinstance(ring, str) else ring
    xs, ys = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def oriented(ring, clockwise: bool = False) -> Column:
    area = signed_area(ring)
    ring = F.col(ring) if isinstance(ring, str) else ring
    return F.when((area < 0) != F.lit(clockwise), F.reverse(ring)).otherwise(ring)


def without_holes(polygons: str) -> Column:
    return F.transform(polygons, lambda p: F.slice(p, 1, 1))


def fill_small_holes(polygon: str, limit) -> Column:
    """Holes of at least the limit stay; a NULL or negative limit changes nothing."""
    limit = F.lit(limit) if not isinstance(limit, Column) else limit
    kept = F.filter(polygon, lambda r, k: (k == 0) | (F.abs(signed_area(r)) >= limit))
    return F.when(limit.isNull() | (limit < 0), F.col(polygon)).otherwise(kept)


def has_holes(polygons: str) -> Column:
    return F.exists(polygons, lambda p: F.size(p) > 1)


def rounded(ring: str, digits: int) -> Column:
    """Coordinates rounded, without a negative zero."""
    r = lambda v: F.round(v, digits) + 0.0
    return F.transform(ring, lambda p: F.struct(r(p.x).alias("x"), r(p.y).alias("y")))


def inside(x, y, ring) -> Column:
    """Point in ring by crossings."""
    crossed = lambda s: ((s.a.y > y) != (s.b.y > y)) & (x < (s.b.x - s.a.x) * (y - s.a.y) / (s.b.y - s.a.y) + s.a.x)
    return F.size(F.filter(segments(ring), crossed)) % 2 == 1


def quantised(ring: str, origin_x, origin_y, scale_x, scale_y, top: int) -> Column:
    """Points on a grid of whole numbers from 0 to top."""
    q = lambda v, o, s: F.greatest(F.lit(0), F.least(F.lit(top), F.round((v - o) / s))).cast("bigint")
    return F.transform(ring, lambda p: F.struct(q(p.x, origin_x, scale_x).alias("x"), q(p.y, origin_y, scale_y).alias("y")))


def deltas(ring: Column) -> Column:
    """First point, then differences; points that repeat their predecessor go, and NULL for less than four points left."""
    n = F.size(ring)
    kept = F.filter(ring, lambda p, k: (k == 0) | (F.get(ring, k - 1) != p))
    diff = F.transform(kept, lambda p, k: F.when(k == 0, p).otherwise(F.struct((p.x - F.get(kept, k - 1).x).alias("x"), (p.y - F.get(kept, k - 1).y).alias("y"))))
    return F.when((n > 0) & (F.size(kept) >= 4), diff)


def geodesic_area(lons: np.ndarray, lats: np.ndarray) -> float:
    """Square metres of a ring on the ellipsoid: edges as straight lines in longitude and sine of the authalic latitude, each
    cut into short pieces. Within 1e-6 of the exact area for rings of some kilometres."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)
    q = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - np.log((1 - e * s) / (1 + e * s)) / (2 * e))
    t = np.linspace(0, 1, 17)
    lon = (np.radians(lons[:-1, None]) * (1 - t) + np.radians(lons[1:, None]) * t).ravel()
    lat = (np.radians(lats[:-1, None]) * (1 - t) + np.radians(lats[1:, None]) * t).ravel()
    h = q(np.sin(lat)) / 2
    return abs(float(np.sum((lon[1:] - lon[:-1]) * (h[1:] + h[:-1]) / 2))) * SEMI_MAJOR**2


#: Where the metric plane of the queries lies: metres to degrees about a fixed point.
PLANE_SCALE, PLANE_LON, PLANE_LAT = 100_000, -7, 33


def _authalic(sine: Column) -> Column:
    """The part of the ellipsoid's area between the equator and a latitude, by the sine of it, in squared semi-axes for two
    radians of longitude."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)
    return (sine / (1 - sine * sine * e2) - F.log((1 - sine * e) / (1 + sine * e)) / (2 * e)) * (1 - e2)


def band_area_m2(lat0: Column, lat1: Column, degrees: float) -> Column:
    """Square metres between two latitudes over so many degrees of longitude."""
    return F.abs(_authalic(F.sin(F.radians(lat1))) - _authalic(F.sin(F.radians(lat0)))) * (math.radians(degrees) / 2 * SEMI_MAJOR**2)


def cell_area_m2(row: str, size: int) -> Column:
    """Of a cell of the metric plane, by its row."""
    lat = lambda k: (F.col(row) + k) * size / PLANE_SCALE + PLANE_LAT
    return band_area_m2(lat(0), lat(1), size / PLANE_SCALE)


def authalic_sql(s: str) -> str:
    """_authalic for the SQL twins."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)
    return f"(({s} / (1 - {s} * {s} * {e2!r}::DOUBLE) - ln((1 - {s} * {e!r}::DOUBLE) / (1 + {s} * {e!r}::DOUBLE)) / {2 * e!r}::DOUBLE) * {1 - e2!r}::DOUBLE)"


def cell_area_sql(row: str, size: int) -> str:
    """cell_area_m2 for the SQL twins."""
    sine = lambda k: f"sin(radians(({row} + {k}) * {size} / {PLANE_SCALE}.0::DOUBLE + {PLANE_LAT}))"
    return f"abs({authalic_sql(sine(1))} - {authalic_sql(sine(0))}) * {math.radians(size / PLANE_SCALE) / 2 * SEMI_MAJOR**2!r}::DOUBLE"


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise, without the closing point."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(rows: np.ndarray) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def least_rectangle(points: np.ndarray) -> tuple[float, float]:
    """Short and long side of the smallest rectangle about the points, a side of which lies on the hull."""
    hull = convex_hull(points)
    if len(hull) < 3:
        return 0.0, float(np.hypot(*(hull.max(0) - hull.min(0)))) if len(hull) else 0.0
    edges = np.roll(hull, -1, axis=0) - hull
    angles = np.arctan2(edges[:, 1], edges[:, 0])
    c, s = np.cos(angles), np.sin(angles)
    x, y = hull[:, :1], hull[:, 1:]
    u, v = x * c + y * s, y * c - x * s
    w, h = np.ptp(u, axis=0), np.ptp(v, axis=0)
    k = int(np.argmin(w * h))
    return float(min(w[k], h[k])), float(max(w[k], h[k]))


def convex_hulls(points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """convex_hull for many sets of finite points side by side, (sets, points, 2), of which the first `sizes` count: corners and
    their number."""
    k = np.arange(points.shape[1])
    xy = np.where((k < sizes[:, None])[:, :, None], points, np.inf)
    xy = np.take_along_axis(xy, np.lexsort((xy[:, :, 1], xy[:, :, 0]), axis=1)[:, :, None], 1)
    halves = []
    for places in (np.broadcast_to(k, xy.shape[:2]), np.maximum(sizes[:, None] - 1 - k, 0)):
        out, n = np.zeros(xy.shape[:2], np.int64), np.zeros(len(xy), np.int64)
        for j in range(xy.shape[1]):
            rows = back = np.flatnonzero(j < sizes)
            while len(back := back[n[back] > 1]):
                a, b, p = (xy[back, at] for at in (out[back, n[back] - 2], out[back, n[back] - 1], places[back, j]))
                back = back[(b[:, 0] - a[:, 0]) * (p[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[:, 0] - a[:, 0]) <= 0]
                n[back] -= 1
            out[rows, n[rows]] = places[rows, j]
            n[rows] += 1
        halves.append((out, n - 1))
    (low, n), (high, m) = halves
    k = np.arange(max(1, int((n + m).max())))
    at = np.where(k < n[:, None], low[:, np.minimum(k, low.shape[1] - 1)], np.take_along_axis(high, np.clip(k - n[:, None], 0, high.shape[1] - 1), 1))
    return np.take_along_axis(xy, at[:, :, None], 1), n + m


def least_rectangles(points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """least_rectangle for many sets of finite points side by side."""
    hulls, n = convex_hulls(points, sizes)
    k = np.arange(hulls.shape[1])
    there = k < n[:, None]
    edges = np.take_along_axis(hulls, np.where(k + 1 < n[:, None], k + 1, 0)[:, :, None], 1) - hulls
    angles = np.arctan2(*np.where(there, edges.transpose(2, 0, 1), 0.0)[::-1])
    c, s = np.cos(angles)[:, None, :], np.sin(angles)[:, None, :]
    x, y = (np.where(there, hulls[:, :, v], hulls[:, :1, v])[:, :, None] for v in (0, 1))
    w, h = np.ptp(x * c + y * s, axis=1), np.ptp(y * c - x * s, axis=1)
    best = np.argmin(np.where(there, w * h, np.inf), axis=1)
    w, h = w[np.arange(len(w)), best], h[np.arange(len(h)), best]
    flat = np.hypot(*(np.ptp(v[:, :, 0], axis=1) for v in (x, y)))
    return np.where(n < 3, 0.0, np.minimum(w, h)), np.where(n < 3, flat, np.maximum(w, h))


def thinnesses(xy: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Short by long side of the least rectangle about rings that lie behind each other in xy, and whether there is one; those of
    up to FEW points go side by side."""
    short, long = np.zeros(len(sizes)), np.zeros(len(sizes))
    alone = _alone(xy, starts, sizes)
    for rows in _alongside(np.where(alone, 0, sizes), 2):
        short[rows], long[rows] = least_rectangles(_padded(xy, starts[rows], sizes[rows]), sizes[rows])
    for k in np.flatnonzero(alone).tolist():
        short[k], long[k] = least_rectangle(xy[starts[k] : starts[k] + sizes[k]])
    there = long != 0
    return short / np.where(there, long, 1.0), there


def _alone(xy: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rings that don't go side by side: of more than FEW points, or with some that aren't finite."""
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(xy).all(1))])
    return (sizes > FEW) | (odd[starts + sizes] > odd[starts])


def clip_to_box(ring: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """A closed ring cut by each side of the box in turn; empty if nothing is left."""
    pts = ring[:-1]
    for axis, limit, keep_above in ((0, box[0], True), (1, box[1], True), (0, box[2], False), (1, box[3], False)):
        out: list = []
        for a, b in zip(pts, np.roll(pts, -1, axis=0), strict=True):
            in_a, in_b = ((p[axis] >= limit) if keep_above else (p[axis] <= limit) for p in (a, b))
            if in_a:
                out.append(a)
            if in_a != in_b:
                t = (limit - a[axis]) / (b[axis] - a[axis])
                out.append(a + t * (b - a))
        pts = np.array(out)
        if not len(pts):
            return np.zeros((0, 2))
    return np.vstack([pts, pts[:1]])


def _halved(rings: list[np.ndarray], axis: int, limit: float, keep_above: bool) -> list[np.ndarray]:
    """Closed rings, outer ones counter-clockwise and holes clockwise, cut by a line. What is left of a ring are chains between
    crossings of the line; sorted along it, the crossings bound the inside by twos, and each chain goes on, along the line,
    with the one that begins at the other end of such a piece."""
    out, chains, crossings = [], [], []  # crossings: place along the line, chain, whether the chain ends there
    for ring in rings:
        points = ring[:-1]
        inside = points[:, axis] >= limit if keep_above else points[:, axis] <= limit
        if inside.all():
            out.append(ring)
        if inside.all() or not inside.any():
            continue
        following = np.roll(points, -1, axis=0)
        turns = np.flatnonzero(inside != np.roll(inside, -1))
        a, b = points[turns], following[turns]
        at = a + ((limit - a[:, axis]) / (b[:, axis] - a[:, axis]))[:, None] * (b - a)
        at[:, axis] = limit
        entries = np.flatnonzero(~inside[turns])
        for k in entries.tolist():
            last = (k + 1) % len(turns)
            first, stop = int(turns[k]) + 1, int(turns[last])
            if stop < first:
                stop += len(points)
            chain = np.vstack([at[k], points[np.arange(first, stop + 1) % len(points)], at[last]])
            crossings += [(at[k][1 - axis], len(chains), False), (at[last][1 - axis], len(chains), True)]
            chains.append(chain)
    crossings.sort()
    # Where an end and a beginning share a place, what comes first along the line may be either: the pieces are the same.
    onward = {}
    for one, two in zip(crossings[::2], crossings[1::2], strict=True):
        if one[2] == two[2]:
            return out + _untwisted(chains, crossings)
        end, begin = (one, two) if one[2] else (two, one)
        onward[end[1]] = begin[1]
    return out + _joined(chains, onward)


def _untwisted(chains: list[np.ndarray], crossings: list[tuple[float, int, bool]]) -> list[np.ndarray]:
    """The same where places tie: ends and beginnings are sorted apart, and meet in their order."""
    ends, begins = ([c[1] for c in crossings if c[2] == e] for e in (True, False))
    return _joined(chains, dict(zip(ends, begins, strict=True)))


def _joined(chains: list[np.ndarray], onward: dict[int, int]) -> list[np.ndarray]:
    rings, left = [], set(onward)
    while left:
        start = k = min(left)
        parts = []
        while True:
            left.discard(k)
            parts.append(chains[k])
            k = onward[k]
            if k == start:
                break
        ring = np.vstack(parts)
        ring = ring[np.concatenate([[True], (np.diff(ring, axis=0) != 0).any(1)])]
        if (ring[0] != ring[-1]).any():
            ring = np.vstack([ring, ring[:1]])
        if len(ring) > 3 and ring_area(ring):
            rings.append(ring)
    return rings


def ring_area(ring: np.ndarray) -> float:
    """Above 0 for counter-clockwise rings."""
    x, y = (ring - ring[0]).T
    return float(x[:-1] @ y[1:] - x[1:] @ y[:-1]) / 2


def within_ring(x: float, y: float, ring: np.ndarray) -> bool:
    a, b = ring[:-1], ring[1:]
    cut = (a[:, 1] <= y) != (b[:, 1] <= y)
    a, b = a[cut], b[cut]
    return bool(((a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])) <= x).sum() % 2)


def clip_polygon(rings: list[np.ndarray], box: tuple[float, float, float, float]) -> list[list[np.ndarray]]:
    """A polygon (closed rings, the outer one first) cut to a box: its parts, each with the holes that it keeps. Rings may have
    either direction; they are turned first."""
    rings = [r if (ring_area(r) > 0) == (k == 0) else r[::-1] for k, r in enumerate(rings) if len(r) > 3]
    for axis, limit, above in ((0, box[0], True), (1, box[1], True), (0, box[2], False), (1, box[3], False)):
        if any(r[:, axis].min() < limit if above else r[:, axis].max() > limit for r in rings):
            rings = _halved(rings, axis, limit, above)
    outer = [[r] for r in rings if ring_area(r) > 0]
    for hole in (r for r in rings if ring_area(r) < 0):
        x, y = hole[:-1].mean(0) if len(hole) < 5 else hole[0] + (hole[1] - hole[0]) / 2
        owners = [p for p in outer if within_ring(x, y, p[0])] or outer[:1]
        if owners:  # a hole without an outer ring is in nothing
            min(owners, key=lambda p: ring_area(p[0])).append(hole)
    return outer


def crossing_segments(ring: np.ndarray) -> np.ndarray:
    """Pairs (k, l), k < l, of segments of a closed ring that meet other than at the point that neighbours share."""
    a, b = ring[:-1], ring[1:]
    n, found = len(a), []
    low, high = np.minimum(a, b), np.maximum(a, b)
    side = lambda p, q, r: np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))
    for start in range(0, n, 256):
        k, m = np.arange(start, min(n, start + 256))[:, None], np.arange(n)[None, :]
        near = (m > k + 1) & ~((k == 0) & (m == n - 1)) & (low[k] <= high[m]).all(-1) & (low[m] <= high[k]).all(-1)
        k, m = (np.broadcast_to(x, near.shape)[near] for x in (k, m))
        p, q, r, s = a[k], b[k], a[m], b[m]
        hit = (side(p, q, r) * side(p, q, s) <= 0) & (side(r, s, p) * side(r, s, q) <= 0)
        found.append(np.stack([k[hit], m[hit]], 1))
    return np.concatenate(found) if found else np.zeros((0, 2), int)


def simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Points that lie off the line of their neighbours by more than the tolerance; the ring itself if under four are left. A cut
    that would make the ring meet itself is undone: its farthest point comes back, until no two cuts meet."""
    keep = np.zeros(len(ring), bool)
    keep[[0, -1]] = True
    far = int(np.argmax(np.hypot(*(ring - ring[0]).T)))
    keep[far] = True
    todo = [(0, far), (far, len(ring) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        line, rest = ring[b] - ring[a], ring[a + 1 : b] - ring[a]
        size = np.hypot(*line)
        off = np.abs(line[0] * rest[:, 1] - line[1] * rest[:, 0]) / size if size else np.hypot(*rest.T)
        k = int(np.argmax(off))
        if off[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    if keep.sum() < 4:
        return ring
    while True:
        kept = np.flatnonzero(keep)
        again = False
        for k in np.unique(crossing_segments(ring[kept])).tolist():
            a, b = kept[k], kept[k + 1]
            if b - a > 1:
                line, rest = ring[b] - ring[a], ring[a + 1 : b] - ring[a]
                keep[a + 1 + int(np.argmax(np.abs(line[0] * rest[:, 1] - line[1] * rest[:, 0])))] = again = True
        if not again:
            return ring[kept]


def simplified_rings(xy: np.ndarray, starts: np.ndarray, sizes: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """simplified for rings that lie behind each other in xy; those of up to FEW points go side by side, and one by one only
    where cuts would meet."""
    parts, alone = [], _alone(xy, starts, sizes)
    for rows in _alongside(np.where(alone, 0, sizes), 2):
        points, n = _padded(xy, starts[rows], sizes[rows]), sizes[rows]
        keep = _kept_side_by_side(points, n, tolerance)
        left = keep.sum(1)
        order = np.argsort(~keep, axis=1, kind="stable")[:, : int(left.max())]
        points = np.take_along_axis(points, order[:, :, None], 1)
        cut = np.flatnonzero(left < n)
        met = cut[_cuts_meet(points[cut], left[cut], order[cut])]
        alone[rows[met]] = True
        left[met] = 0
        parts.append((rows, points, left))
    for k in np.flatnonzero(alone).tolist():
        ring = simplified(xy[starts[k] : starts[k] + sizes[k]], tolerance)
        parts.append((np.array([k]), ring[None], np.array([len(ring)])))
    return _gathered(len(sizes), parts)


def _kept_side_by_side(points: np.ndarray, sizes: np.ndarray, tolerance: float) -> np.ndarray:
    """Which of the first `sizes` points of (rings, points, 2) stay: between two that do, the farthest from their line comes back
    while it is farther than the tolerance; all where under four would."""
    k, rows = np.arange(points.shape[1]), np.arange(len(points))
    there = k < sizes[:, None]
    keep = np.zeros(there.shape, bool)
    keep[:, 0] = keep[rows, sizes - 1] = True
    off = np.hypot(*(points - points[:, :1]).transpose(2, 0, 1))
    keep[rows, np.argmax(np.where(there, off, -1.0), axis=1)] = True
    todo = there & ~keep
    while todo.any():
        before = np.maximum.accumulate(np.where(keep, k, 0), axis=1)
        after = np.minimum.accumulate(np.where(keep, k, len(k) - 1)[:, ::-1], axis=1)[:, ::-1]
        r, i = np.nonzero(todo)
        a = before[r, i]
        line, rest = (points[r, after[r, i]] - points[r, a]).T, (points[r, i] - points[r, a]).T
        size = np.hypot(*line)
        off = np.where(size > 0, np.abs(line[0] * rest[1] - line[1] * rest[0]) / np.where(size > 0, size, 1.0), np.hypot(*rest))
        new = np.append(True, (np.diff(r) != 0) | (np.diff(a) != 0))
        most, own = np.maximum.reduceat(off, np.flatnonzero(new)), np.cumsum(new) - 1
        first = np.flatnonzero(off == most[own])
        first = first[np.append(True, np.diff(own[first]) != 0)]
        far = most > tolerance
        keep[r[first[far]], i[first[far]]] = True
        todo[r, i] = far[own]
        todo &= ~keep
    return np.where(keep.sum(1)[:, None] < 4, there, keep)


def _cuts_meet(points: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether a segment of a ring meets another that isn't its neighbour, one of the two being a cut: places are those of the
    points in the ring before."""
    a, b, n = points[:, :-1], points[:, 1:], sizes[:, None, None] - 1
    k, m = np.arange(a.shape[1])[:, None], np.arange(a.shape[1])
    cut = np.diff(places, axis=1) > 1
    low, high = np.minimum(a, b), np.maximum(a, b)
    near = (m > k + 1) & (m < n) & ~((k == 0) & (m == n - 1)) & (cut[:, :, None] | cut[:, None, :])
    near &= (low[:, :, None] <= high[:, None]).all(-1) & (low[:, None] <= high[:, :, None]).all(-1)
    r, k, m = np.nonzero(near)
    p, q, s, t = a[r, k], b[r, k], a[r, m], b[r, m]
    side = lambda p, q, r: np.sign((q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0]))
    found = np.zeros(len(points), bool)
    found[r[(side(p, q, s) * side(p, q, t) <= 0) & (side(s, t, p) * side(s, t, q) <= 0)]] = True
    return found


def clip_to_boxes(rings: list[np.ndarray], boxes: np.ndarray) -> list[np.ndarray]:
    """clip_to_box for many closed rings, each with a box of its own: rings of about the same length go side by side."""
    sizes = np.array([len(r) for r in rings], np.int64)
    xy, left, _ = _clipped_flat(np.concatenate([np.zeros((0, 2)), *rings]), np.cumsum(sizes) - sizes, sizes, boxes)
    ends = np.cumsum(left).tolist()
    return [xy[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905


def _clipped_flat(xy: np.ndarray, starts: np.ndarray, sizes: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for rings that lie behind each other in xy: points and sizes of what is left, and areas of that, summed up as
    signed_area does."""
    areas, parts = np.zeros(len(sizes)), []
    for rows in _alongside(np.maximum(sizes - 1, 0)):
        n = sizes[rows] - 1
        points, left = _clipped_side_by_side(_padded(xy, starts[rows], n), n, boxes[rows])
        if not left.any():
            continue
        points = np.concatenate([points, points[:, :1]], 1)
        points[np.arange(len(rows)), left] = points[:, 0]
        left += left > 0
        areas[rows] = _areas(points, left)
        parts.append((rows, points, left))
    return *_gathered(len(sizes), parts), areas


def _alongside(sizes: np.ndarray, weight: int = 1) -> Iterator[np.ndarray]:
    """Rows of rings of about the same length, not above SIDE_BY_SIDE corners (to the power of `weight`) at a time; those
    without corners are left out."""
    classes = np.ceil(np.log2(np.maximum(sizes, 1)))
    for c in np.unique(classes[sizes > 0]):
        rows = np.flatnonzero((classes == c) & (sizes > 0))
        step = max(1, SIDE_BY_SIDE >> int(c) * weight)
        yield from (rows[k : k + step] for k in range(0, len(rows), step))


def _padded(xy: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(rings, corners, 2); what stands beyond a ring's size means nothing."""
    return xy[np.minimum(starts[:, None] + np.arange(sizes.max()), len(xy) - 1)]


def _gathered(n: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Parts of (rows, padded points, sizes) as n rings behind each other, and the sizes of these."""
    sizes = np.zeros(n, np.int64)
    for rows, _, left in parts:
        sizes[rows] = left
    starts, xy = np.cumsum(sizes) - sizes, np.zeros((int(sizes.sum()), 2))
    for rows, points, left in parts:
        k = np.arange(points.shape[1])
        there = k < left[:, None]
        xy[(starts[rows, None] + k)[there]] = points[there]
    return xy, sizes


def _areas(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Above 0 for counter-clockwise rings; edge by edge, as signed_area sums up."""
    x, y = points[:, :, 0], points[:, :, 1]
    total = np.zeros(len(points))
    for k in range(points.shape[1] - 1):
        total += np.where(k + 1 < sizes, x[:, k] * y[:, k + 1] - x[:, k + 1] * y[:, k], 0.0)
    return total / 2


def _clipped_side_by_side(points: np.ndarray, sizes: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """points: (rings, corners, 2), of which the first `sizes` of a ring count."""
    for axis, side, keep_above in ((0, 0, True), (1, 1, True), (0, 2, False), (1, 3, False)):
        limit, k = boxes[:, side, None], np.arange(points.shape[1])
        there = k < sizes[:, None]
        following = np.take_along_axis(points, np.where(k + 1 < sizes[:, None], k + 1, 0)[:, :, None], axis=1)
        a, b = points[:, :, axis], following[:, :, axis]
        in_a, in_b = ((v >= limit if keep_above else v <= limit) & there for v in (a, b))
        cut = in_a != in_b
        t = (limit - a) / np.where(cut, b - a, 1)
        both = np.stack([points, points + t[:, :, None] * (following - points)], 2).reshape(len(points), -1, 2)
        kept = np.stack([in_a, cut], 2).reshape(len(points), -1)
        sizes = kept.sum(1)
        points = np.zeros((len(both), int(sizes.max(initial=0)), 2))
        points[np.arange(points.shape[1]) < sizes[:, None]] = both[kept]
    return points, sizes


RING_TYPE = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
ARROW_RING = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
#: Corners of rings, or pairs of them, that are worked on side by side; points of a ring up to which hulls and simplification are.
SIDE_BY_SIDE, FEW = 1 << 18, 64


def _arrays(rings: pa.Array) -> list[np.ndarray | None]:
    """Rings of an Arrow array as (n, 2) views of one array, None for NULL."""
    xy = np.stack([v.to_numpy(zero_copy_only=False).astype(float) for v in rings.flatten().flatten()], 1)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False)).tolist()
    return [xy[a:b] if there else None for a, b, there in zip([0, *ends], ends, rings.is_valid().to_pylist())]  # noqa: B905


def _ring_list(rings: list[np.ndarray]) -> pa.Array:
    return _listed(np.concatenate([np.zeros((0, 2)), *rings]), np.array([len(r) for r in rings], np.int64))


def _listed(xy: np.ndarray, sizes: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
    """Rings that lie behind each other; NULL where they aren't there."""
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"])
    gaps = None if there is None or there.all() else pa.array(~there)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), points, mask=gaps)


def _flat(rings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rings of an Arrow array behind each other: points (n, 2), starts, sizes (0 for NULL), and whether a ring is there."""
    xy = np.stack([v.to_numpy(zero_copy_only=False).astype(float) for v in rings.flatten().flatten()], 1)
    sizes = pc.fill_null(pc.list_value_length(rings), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return xy, np.cumsum(sizes) - sizes, sizes, rings.is_valid().to_numpy(zero_copy_only=False)


def _each(keys: list[bytes | None], of: Callable[[int], object], packed: Callable[[list], pa.Array]) -> pa.Array:
    """The results of a batch: rows of one key are worked out once, NULL for None."""
    places: dict[bytes, int] = {}
    at, made = [], []
    for k, key in enumerate(keys):
        if key is not None and key not in places:
            places[key] = len(made)
            made.append(of(k))
        at.append(None if key is None else places[key])
    return packed(made).take(pa.array(at, pa.int64()))


def _over_rings(of: Callable[[np.ndarray], object], kind: T.DataType) -> Callable:
    """An Arrow function over a column of rings; NULL for NULL. Equal rings of a batch are worked on once."""
    packed = (lambda made: pa.array(made, pa.float64())) if kind == T.DoubleType() else _ring_list

    def run(rings: pa.Array) -> pa.Array:
        found = _arrays(rings)
        return _each([None if r is None else r.tobytes() for r in found], lambda k: of(found[k]), packed)

    run.__annotations__ = {"rings": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


def geodesic_area_of(ring) -> Column:
    """Of rings in degrees."""
    return _over_rings(lambda r: geodesic_area(*r.T), T.DoubleType())(ring)


def thinness_of(ring) -> Column:
    """Short by long side of the smallest rectangle."""

    def run(rings: pa.Array) -> pa.Array:
        xy, starts, sizes, _ = _flat(rings)
        found, there = thinnesses(xy, starts, sizes)
        return pa.array(found, mask=~there)

    run.__annotations__ = {"rings": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.DoubleType())(ring)


def clipped_ring(ring, box: tuple[float, float, float, float]) -> Column:
    return _over_rings(lambda r: clip_to_box(r, box), RING_TYPE)(ring)


def clipped_parts(rings, box: tuple[float, float, float, float]) -> Column:
    """Of polygons (arrays of rings) the parts inside a box: an array of polygons."""

    def run(polygons: pa.Array) -> pa.Array:
        flat = _arrays(polygons.flatten())
        ends = np.cumsum(pc.fill_null(pc.list_value_length(polygons), 0).to_numpy(zero_copy_only=False)).tolist()
        found = [flat[a:b] if there else None for a, b, there in zip([0, *ends], ends, polygons.is_valid().to_pylist())]  # noqa: B905
        keys = [None if p is None else b"".join(x for r in p for x in (len(r).to_bytes(8), r.tobytes())) for p in found]
        return _each(keys, lambda k: clip_polygon(found[k], box), packed)

    def packed(made: list) -> pa.Array:
        parts = [part for polygon in made for part in polygon]
        listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), _ring_list([r for part in parts for r in part]))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, made)]), pa.int32()), listed)

    run.__annotations__ = {"polygons": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.ArrayType(T.ArrayType(RING_TYPE)))(rings)


def simplified_ring(ring, tolerance: float) -> Column:
    def run(rings: pa.Array) -> pa.Array:
        xy, starts, sizes, there = _flat(rings)
        return _listed(*simplified_rings(xy, starts, sizes, tolerance), there)

    run.__annotations__ = {"rings": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, RING_TYPE)(ring)


def clipped_to(ring, minx, miny, maxx, maxy) -> Column:
    """A ring cut to a box of its own row, with its area: (ring, area)."""

    def run(rings: pa.Array, a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        xy, starts, sizes, there = _flat(rings)
        boxes = np.stack([v.to_numpy(zero_copy_only=False).astype(float) for v in (a, b, c, d)], 1)
        cut, left, areas = _clipped_flat(xy, starts, sizes, boxes)
        return pa.StructArray.from_arrays([_listed(cut, left, there), pa.array(areas, mask=~there)], ["ring", "area"])

    run.__annotations__ = {**dict.fromkeys(("rings", "a", "b", "c", "d"), pa.Array), "return": pa.Array}
    return F.arrow_udf(run, T.StructType([T.StructField("ring", RING_TYPE), T.StructField("area", T.DoubleType())]))(ring, minx, miny, maxx, maxy)
