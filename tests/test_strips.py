"""Packed strips against sets of cells."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from landfold.operators import strips as S


def cells(strips, keys=("k",)):
    return {tuple(r) for r in S.cells_of(strips, list(keys)).collect()}


def make(spark, rows):
    return S.of_cells(spark.createDataFrame(sorted(rows), "k int, cx bigint, cy bigint"), ["k"])


@pytest.fixture(scope="module")
def spots():
    """Two keys' blobs and single cells about the squares' borders, below zero too."""
    rng = random.Random(11)
    out = set()
    for k in (1, 2):
        for _ in range(25):
            x, y = rng.choice([-70, -3, 0, 58, 61, 64, 120, 130]) + rng.randrange(8), rng.choice([-66, -2, 0, 60, 63, 64, 127, 200]) + rng.randrange(6)
            w, h = rng.randrange(1, 9), rng.randrange(1, 7)
            out |= {(k, a, b) for a in range(x, x + w) for b in range(y, y + h)}
    return out


def grown(cells_, radius, square=False):
    r = int(radius)
    steps = [(x, y) for x in range(-r, r + 1) for y in range(-r, r + 1) if square or x * x + y * y <= radius * radius]
    return {(k, x + a, y + b) for k, x, y in cells_ for a, b in steps}


def shrunk(cells_, radius, square=False):
    r = int(radius)
    steps = [(x, y) for x in range(-r, r + 1) for y in range(-r, r + 1) if square or x * x + y * y <= radius * radius]
    return {(k, x, y) for k, x, y in cells_ if all((k, x + a, y + b) in cells_ for a, b in steps)}


@pytest.mark.parametrize(("radius", "square"), [(0, False), (1, False), (2.5, False), (2, True), (70, False)])
def test_morphology(spark, spots, radius, square):
    some = {c for c in spots if c[0] == 2 or radius < 9 or c[1:] == (61, 63)} if radius < 9 else {(1, 5, 5), (1, 63, 64)}
    strips = make(spark, some)
    assert cells(S.dilate(strips, ["k"], radius, square)) == grown(some, radius, square)
    assert cells(S.erode(strips, ["k"], radius, square)) == shrunk(some, radius, square)
    if not square:
        assert cells(S.close(strips, ["k"], radius)) == shrunk(grown(some, radius), radius)
    if 1 <= radius < 9 and not square:
        assert cells(S.edge_band(strips, ["k"], radius)) == grown(some, radius) - shrunk(some, radius)


def test_overlay_and_measures(spark, spots):
    rng = random.Random(1)
    other = {(k, x + rng.randrange(3), y) for k, x, y in spots if rng.random() < 0.5}
    a, b = make(spark, spots), make(spark, other)
    assert cells(a) == spots
    assert cells(S.intersection(a, b, ["k"])) == spots & other
    assert cells(S.difference(a, b, ["k"])) == spots - other
    assert cells(S.union(a.unionByName(b), ["k"])) == spots | other
    assert cells(S.clipped(a, (-5, 1, 130, 64))) == {c for c in spots if -5 <= c[1] <= 130 and 1 <= c[2] <= 64}
    assert {r.k: r.area for r in S.area(a.unionByName(b), ["k"], 10).collect()} == {k: 100 * sum(c[0] == k for c in spots | other) for k in (1, 2)}
    for r in S.measures(a, ["k"], 10).collect():
        own = [c for c in spots if c[0] == r.k]
        assert r.cells == len(own)
        assert math.isclose(r.centre_x, 10 * (sum(c[1] for c in own) / len(own) + 0.5)) and math.isclose(r.centre_y, 10 * (sum(c[2] for c in own) / len(own) + 0.5))
    for r in S.overlap(a, b, ["k"], ["k"]).collect():
        own = {c for c in spots if c[0] == r.k}
        assert r.cells == len(own) and math.isclose(r.overlap, len(own & other) / len(own))


def test_growth_of_strips(spark, spots):
    rows = [(k, t, x, y) for k, x, y in spots for t in ({hash((x, y)) % 4, 3} if x % 3 else {hash((y, x)) % 4})]
    frame = spark.createDataFrame(rows, "k int, t int, cx bigint, cy bigint")
    steps = spark.createDataFrame([(k, t) for k in (1, 2) for t in range(5)], "k int, t int")
    got = {(r.k, r.t): (r.added_area, r.total_area) for r in S.growth(S.of_cells(frame, ["k", "t"]), steps, ["k"], "t", 1).collect()}
    seen = defaultdict(set)
    for t in range(5):
        for k in (1, 2):
            now = {(x, y) for kk, tt, x, y in rows if kk == k and tt == t} - seen[k]
            seen[k] |= now
            assert got[k, t] == (len(now), len(seen[k]))


def brute_labels(spots):
    left, out = set(spots), {}
    while left:
        todo = [left.pop()]
        part = list(todo)
        while todo:
            k, x, y = todo.pop()
            for c in ((k, x + 1, y), (k, x - 1, y), (k, x, y + 1), (k, x, y - 1)):
                if c in left:
                    left.discard(c)
                    todo.append(c)
                    part.append(c)
        least = min(y * (1 << 31) + x for _, x, y in part)
        out |= dict.fromkeys(part, least)
    return out


@pytest.mark.parametrize("one_task", [0, 50_000])
def test_labels(spark, spots, monkeypatch, one_task):
    monkeypatch.setattr(S, "ONE_TASK_EDGES", one_task)
    snake = {(3, x, y) for y in range(0, 140, 2) for x in range(140)} | {(3, 139 if y % 4 == 1 else 0, y) for y in range(1, 138, 2)}
    every = spots | snake
    got = {(r.k, r.cx, r.cy): r.label for r in S.label_cells(make(spark, every), ["k"]).collect()}
    assert got == brute_labels(every)
    assert len({v for c, v in got.items() if c[0] == 3}) == 1


def inside(x, y, rings):
    """Even-odd over all rings; an edge counts for y within its half-open span, and for x at or beyond its crossing."""
    n = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay <= y) != (by <= y):
                n += ax + (y - ay) * (bx - ax) / (by - ay) <= x
    return n % 2 == 1


def test_polygons_to_cells(spark, monkeypatch):
    """Slanted rings with holes and islands in them, several parts, concave ones, closed or open, in either direction."""
    monkeypatch.setattr(S, "BAND", 16)
    rng = random.Random(4)

    def star(x, y, r, n):
        turn = rng.random()
        return [(x + r * rng.uniform(0.5, 1) * math.cos(2 * math.pi * (k / n + turn)), y + r * rng.uniform(0.5, 1) * math.sin(2 * math.pi * (k / n + turn))) for k in range(n)]

    features = []
    for k in range(40):
        x, y, r = rng.uniform(-900, 900), rng.uniform(-900, 900), rng.choice([4, 60, 300, 900])
        rings = [star(x, y, r, rng.randrange(3, 12))]
        if k % 2:
            rings.append([(a, b) for a, b in star(x, y, r / 3, 5)][:: rng.choice([1, -1])])
        if k % 4 == 3:
            rings += [star(x, y, r / 9, 4), star(x + 3 * r, y, r / 2, 6)]
        features.append((k, [ring + ring[:1] if k % 3 else ring for ring in rings]))
    rows = [(k, [[{"x": x, "y": y} for x, y in ring] for ring in rings]) for k, rings in features]
    rows += [(90, []), (91, None), (92, [[{"x": 1.0, "y": 1.0}, {"x": 90.0, "y": 1.0}]]), (93, [[{"x": 1.0, "y": 5.0}, {"x": 90.0, "y": 5.0}, {"x": 50.0, "y": 5.0}]])]
    frame = spark.createDataFrame(rows, "k int, rings array<array<struct<x: double, y: double>>>")
    size, want = 10, set()
    for k, rings in features:
        xs, ys = [p[0] for r in rings for p in r], [p[1] for r in rings for p in r]
        for cy in range(math.floor(min(ys) / size) - 1, math.ceil(max(ys) / size) + 1):
            for cx in range(math.floor(min(xs) / size) - 1, math.ceil(max(xs) / size) + 1):
                if inside((cx + 0.5) * size, (cy + 0.5) * size, rings):
                    want.add((k, cx, cy))
    assert len(want) > 20_000
    assert cells(S.union(S.of_features(frame, ["k"], size), ["k"])) == want


def test_boxes_and_nulls(spark):
    boxes = spark.createDataFrame([(None, 0, 0, 1290, 30), (1, 5, 5, 4, 9), (2, -30, -30, -10, 0)], "k int, minx int, miny int, maxx int, maxy int")
    found = S.of_features(boxes, ["k"], 10)
    assert cells(found) == {(None, x, y) for x in range(129) for y in range(3)} | {(2, x, y) for x in (-3, -2) for y in (-3, -2, -1)}
    assert {(r.k, r.label) for r in S.label(found, ["k"]).collect()} == {(None, 0), (2, -3 * (1 << 31) - 3)}
    assert S.morphed(found.where("false"), ["k"], (2, False, False)).count() == 0
    assert S.label(found.where("false"), ["k"]).count() == 0


@pytest.mark.parametrize("one_task", [0, 50_000])
def test_holes_over_squares(spark, monkeypatch, one_task):
    """Holes inside a square, over squares, over whole empty squares; holes with islands; bays; sets closed by corners alone."""
    monkeypatch.setattr(S, "ONE_TASK_EDGES", one_task)
    frame = lambda x0, y0, x1, y1, t: {(x, y) for x in range(x0, x1) for y in range(y0, y1) if not (x0 + t <= x < x1 - t and y0 + t <= y < y1 - t)}
    whole = frame(-100, -90, 400, 300, 2) | frame(150, 100, 158, 106, 1) | frame(0, 0, 64, 64, 1) | {(30, 30)}
    bay = frame(500, 0, 800, 200, 3) - {(x, y) for x in range(797, 800) for y in range(90, 93)} | frame(520, 20, 540, 30, 1)
    corners = {(900 + k, 100 + k) for k in range(100)} | {(900 + k, 100 - k) for k in range(100)} | {(999 + k, 199 - k) for k in range(100)} | {(999 + k, 1 + k) for k in range(100)}
    some = {(1, *c) for c in whole | bay} | {(2, *c) for c in corners}
    got = cells(S.filled(make(spark, some), ["k"]))
    (x0, x1), (y0, y1) = ((min(v) - 1, max(v) + 1) for v in ([c[i] for c in some] for i in (1, 2)))
    want = set()
    for k in (1, 2):
        own = {c[1:] for c in some if c[0] == k}
        seen, todo = {(x0, y0)}, [(x0, y0)]
        while todo:
            x, y = todo.pop()
            near = {c for c in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)) if x0 <= c[0] <= x1 and y0 <= c[1] <= y1 and c not in own and c not in seen}
            seen |= near
            todo += near
        want |= {(k, x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1) if (x, y) not in seen}
    assert got == want
    assert (1, 100, 200) in got and (1, 600, 100) not in got and (1, 530, 25) in got and (2, 999, 100) in got
