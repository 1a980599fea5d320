"""Rings cut and simplified, against plain versions; no Spark."""

from __future__ import annotations

import math

import numpy as np
import pytest

from landfold.functions import geometry as G


def star(rng, n, r=100.0):
    angles = np.sort(rng.uniform(0, 2 * math.pi, n))
    radii = r * rng.uniform(0.25, 1, n)
    ring = np.stack([radii * np.cos(angles), radii * np.sin(angles)], 1) + rng.uniform(-30, 30, 2)
    return np.vstack([ring, ring[:1]])


def area(parts):
    return sum(G.ring_area(r) for part in parts for r in part)


def test_u_shape_gives_two_parts():
    u = np.array([(0, 0), (30, 0), (30, 30), (20, 30), (20, 10), (10, 10), (10, 30), (0, 30), (0, 0)], float)
    for ring in (u, u[::-1]):
        parts = G.clip_polygon([ring], (-5, 15, 50, 50))
        assert sorted(round(G.ring_area(p[0])) for p in parts) == [150, 150] and all(len(p) == 1 for p in parts)
        assert [round(area(G.clip_polygon([ring], box))) for box in ((-5, -5, 50, 5), (0, 0, 30, 30), (12, 15, 18, 25), (40, 0, 50, 5))] == [150, 700, 0, 0]


def test_holes_are_cut_or_kept():
    square = np.array([(0, 0), (40, 0), (40, 40), (0, 40), (0, 0)], float)
    hole = np.array([(10, 10), (30, 10), (30, 30), (10, 30), (10, 10)], float)
    (kept,) = G.clip_polygon([square, hole], (-1, -1, 35, 41))
    assert len(kept) == 2 and area([kept]) == 35 * 40 - 400
    (cut,) = G.clip_polygon([square, hole], (-1, -1, 20, 41))
    assert len(cut) == 1 and area([cut]) == 20 * 40 - 200
    assert sorted(area([p]) for p in G.clip_polygon([square, hole], (-1, 15, 41, 25))) == [100, 100]


def test_clips_of_random_polygons():
    """Against the count of small cells inside polygon and box."""
    rng = np.random.default_rng(6)
    grid = np.stack(np.meshgrid(np.arange(-150, 150) + 0.5, np.arange(-150, 150) + 0.5), -1).reshape(-1, 2)
    for k in range(60):
        outer = star(rng, int(rng.integers(4, 14)))
        rings = [outer] + ([0.3 * (outer - outer[:-1].mean(0)) + outer[:-1].mean(0)] if k % 2 and np.hypot(*(outer - outer[:-1].mean(0)).T).min() > 5 else [])
        low = rng.uniform(-80, 20, 2)
        box = (*low, *(low + rng.uniform(20, 120, 2)))
        odd = np.zeros(len(grid), bool)
        for ring in rings:
            for a, b in zip(ring, ring[1:], strict=False):
                cut = (a[1] <= grid[:, 1]) != (b[1] <= grid[:, 1])
                odd[cut] ^= a[0] + (grid[cut, 1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) <= grid[cut, 0]
        want = (odd & (grid >= box[:2]).all(1) & (grid <= box[2:]).all(1)).sum()
        length = sum(np.hypot(*np.diff(r, axis=0).T).sum() for r in rings) + 2 * (box[2] - box[0] + box[3] - box[1])
        assert abs(area(G.clip_polygon(rings, box)) - want) < length * 0.25 + 3


@pytest.mark.parametrize("tolerance", [1.0, 8.0, 40.0])
def test_simplified_rings_never_cross_themselves(tolerance):
    rng = np.random.default_rng(9)
    fewer = 0
    for _ in range(120):
        ring = star(rng, int(rng.integers(5, 90)))
        if len(G.crossing_segments(ring)):
            continue
        out = G.simplified(ring, tolerance)
        fewer += len(out) < len(ring)
        assert not len(G.crossing_segments(out)) and (out[0] == out[-1]).all() and len(out) >= 4
        assert {tuple(p) for p in out.tolist()} <= {tuple(p) for p in ring.tolist()}
    assert fewer > 20


def test_a_spike_that_plain_cuts_would_cross():
    ring = np.array([(0, 0), (50, -6), (100, 0), (100, 40), (52, 40), (50, -3), (48, 40), (0, 40), (0, 0)], float)
    assert not len(G.crossing_segments(ring))
    out = G.simplified(ring, 8.0)
    assert not len(G.crossing_segments(out)) and (50.0, -6.0) in {tuple(p) for p in out.tolist()}


def test_clipped_side_by_side():
    """Rings of many lengths, each with a box of its own, as one by one."""
    rng = np.random.default_rng(5)
    rings = [np.zeros((0, 2))]
    for n in [3, 3, 4, 5, 8, 9, 40, 300] * 12:
        points = rng.random((n, 2)) * 20 - 10
        rings.append(np.vstack([points, points[:1]]))
    low = rng.random((len(rings), 2)) * 12 - 12
    boxes = np.hstack([low, low + rng.random((len(rings), 2)) * 14])
    found = G.clip_to_boxes(rings, boxes)
    assert len(found) == len(rings) and any(len(f) for f in found)
    for ring, box, got in zip(rings, boxes, found, strict=True):
        want = G.clip_to_box(ring, tuple(box)) if len(ring) else ring
        assert np.array_equal(got, want)


def test_equal_rings_are_worked_on_once():
    calls = []
    rows = [b"a", None, b"b", b"a", b"a", None]
    got = G._each(rows, lambda k: calls.append(k) or float(k), lambda made: G.pa.array(made, G.pa.float64()))
    assert got.to_pylist() == [0, None, 2, 0, 0, None] and calls == [0, 2]
    ring = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 0.0}]
    listed = G.pa.array([ring, None, [], ring], G.ARROW_RING)
    assert [None if r is None else r.tolist() for r in G._arrays(listed.slice(1))] == [None, [], [[0, 0], [1, 0], [0, 0]]]
    assert G._ring_list([np.zeros((0, 2)), np.array([[1.0, 2.0]])]).to_pylist() == [[], [{"x": 1.0, "y": 2.0}]]


def test_clips_with_gaps_and_areas():
    """Arrow rings with a NULL and an empty one, each cut to a box of its own: rings and areas as one by one."""
    rng = np.random.default_rng(8)
    rings = [star(rng, int(rng.integers(3, 70))) for _ in range(60)]
    rows = [None if k % 7 == 0 else [] if k % 7 == 1 else [{"x": x, "y": y} for x, y in r.tolist()] for k, r in enumerate(rings)]
    xy, starts, sizes, there = G._flat(G.pa.array([None, *rows], G.ARROW_RING).slice(1))
    boxes = np.tile([-40.0, -40.0, 50.0, 30.0], (60, 1)) + rng.uniform(-30, 30, (60, 1))
    cut, left, areas = G._clipped_flat(xy, starts, sizes, boxes)
    got = G._listed(cut, left, there).to_pylist()
    for k, row in enumerate(rows):
        want = G.clip_to_box(rings[k], tuple(boxes[k])) if row else np.zeros((0, 2))
        assert (got[k] is None) == (row is None) and [(p["x"], p["y"]) for p in got[k] or []] == [tuple(p) for p in want.tolist()]
        assert math.isclose(areas[k], G.ring_area(want) if len(want) else 0.0, abs_tol=1e-6)


def behind_each_other(rings):
    sizes = np.array([len(r) for r in rings], np.int64)
    return np.concatenate(rings), np.cumsum(sizes) - sizes, sizes


def test_least_rectangles_side_by_side(monkeypatch):
    """As one by one, without a call for each: rings of many lengths, with points that repeat, on a line, all one, or none."""
    rng = np.random.default_rng(11)
    rings = [star(rng, n) for n in [3, 4, 5, 7, 12, 30, 60] * 20] + [rng.integers(0, 4, (n, 2)).astype(float) for n in [1, 2, 3, 5, 9, 20] * 20]
    rings += [np.zeros((0, 2)), np.ones((4, 2)), np.arange(8.0).reshape(4, 2), star(rng, 200)]
    want = []
    for r in rings:
        hull = G.convex_hull(r) if len(r) else r
        n = len(hull)
        got, left = G.convex_hulls(r[None], np.array([len(r)])) if len(r) else (np.zeros((1, 0, 2)), [0])
        assert left[0] == n if n > 2 else left[0] < 3
        assert n < 3 or np.array_equal(got[0, :n], hull)
        want.append(G.least_rectangle(r) if len(r) else (0.0, 0.0))
    calls = []
    plain = G.least_rectangle
    monkeypatch.setattr(G, "least_rectangle", lambda p: calls.append(len(p)) or plain(p))
    found, there = G.thinnesses(*behind_each_other(rings))
    assert calls == [201]
    for (short, long), got, ok in zip(want, found, there, strict=True):
        assert ok == (long != 0) and (not ok or math.isclose(got, short / long, rel_tol=1e-12, abs_tol=1e-12))


@pytest.mark.parametrize("tolerance", [0.5, 8.0, 40.0])
def test_simplified_side_by_side(monkeypatch, tolerance):
    """As one by one, with calls for long rings and those whose cuts meet alone."""
    rng = np.random.default_rng(12)
    spike = np.array([(0, 0), (50, -6), (100, 0), (100, 40), (52, 40), (50, -3), (48, 40), (0, 40), (0, 0)], float)
    rings = [spike, np.zeros((0, 2)), np.ones((1, 2)), np.ones((6, 2)), star(rng, 150)]
    rings += [star(rng, n) for n in [3, 4, 5, 8, 13, 30, 62] * 30] + [rng.integers(0, 30, (n, 2)).astype(float) for n in (2, 3, 4, 6, 9)]
    want = [G.simplified(r, tolerance) if len(r) else r for r in rings]
    calls = []
    plain = G.simplified
    monkeypatch.setattr(G, "simplified", lambda p, t: calls.append(len(p)) or plain(p, t))
    xy, left = G.simplified_rings(*behind_each_other(rings), tolerance)
    ends = np.cumsum(left)
    for w, a, b in zip(want, [0, *ends], ends, strict=False):
        assert np.array_equal(xy[a:b], w)
    assert 151 in calls and len(calls) < 100 and (tolerance != 8.0 or 9 in calls)
