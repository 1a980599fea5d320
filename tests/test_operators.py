"""Operators on small literal inputs with answers worked out by hand."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from landfold.functions import geometry as G
from landfold.functions import grid
from landfold.functions import values as V
from landfold.operators import cells as C
from landfold.operators import blocks, exports, graph, metrics, raster, records, strips
from landfold.sources.views import view
from landfold.streaming import jobs


def pixels(spark, array, raster_name="t1"):
    a = np.asarray(array, float)
    return spark.createDataFrame([(raster_name, r, c, float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])], "raster string, row bigint, col bigint, p double")


def block(shape, rows, cols):
    a = np.zeros(shape)
    a[rows[0] : rows[1] + 1, cols[0] : cols[1] + 1] = 1
    return a


def on(df):
    return {(r.row, r.col) for r in df.collect()}


def new_mask(spark, t1, t2, dilation, change=None):
    both = raster.pair(pixels(spark, t1).unionByName(pixels(spark, t2, "t2")))
    ch = pixels(spark, np.ones(np.shape(t1)) if change is None else change).select("row", "col", F.col("p").alias("change"))
    return raster.new_objects(both.join(ch, ["row", "col"]), "change", 0.5, 0.5, dilation)


def test_threshold_counts(spark):
    px = pixels(spark, [[0.01, 0.10], [0.90, 0.99]])
    assert px.where("p >= 0.05").count() == 3 and px.where("p >= 0.95").count() == 1


def test_new_object_mask(spark):
    got = new_mask(spark, [[0.1, 0.8], [0.1, 0.2]], [[0.8, 0.9], [0.9, 0.1]], 0, [[0.9, 0.9], [0.4, 0.9]])
    assert on(got) == {(0, 0)}


def test_dilation_removes_sliver(spark):
    t1, t2 = block((5, 5), (1, 3), (1, 3)), block((5, 5), (0, 3), (1, 3))
    assert on(new_mask(spark, t1, t2, 0)) == {(0, 1), (0, 2), (0, 3)}
    assert on(new_mask(spark, t1, t2, 1)) == set()


@pytest.mark.parametrize(("distance", "left"), [(0, {(r, 7) for r in range(2, 7)}), (2, set())])
def test_core_distance(spark, distance, left):
    t1, t2 = block((9, 9), (2, 6), (2, 4)), block((9, 9), (2, 6), (5, 7))
    mask = new_mask(spark, t1, t2, 2)
    far = raster.far_components(raster.label_mask(mask), pixels(spark, t2).where("p > 0 AND col <= 6").select("row", "col"), distance, 1)
    assert on(far) == left


def test_chunked_equals_unchunked(spark):
    rng = np.random.default_rng(0)
    px = pixels(spark, rng.random((40, 23)))
    assert {tuple(r) for r in raster.pixels_of(raster.chunks(px, 16)).select("row", "col", "p").collect()} == {tuple(r) for r in px.select("row", "col", "p").collect()}


def test_components_partition_the_set(spark):
    rng = random.Random(1)
    cells = {(rng.randrange(30), rng.randrange(30)) for _ in range(420)}
    frame = spark.createDataFrame(sorted(cells), "cx bigint, cy bigint")
    got = {(r.cx, r.cy): r.label for r in graph.label_cells(frame, []).collect()}
    want, left = {}, set(cells)
    while left:
        seed = min(left, key=lambda c: (c[1], c[0]))
        todo, part = [seed], {seed}
        while todo:
            x, y = todo.pop()
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if n in left and n not in part:
                    part.add(n)
                    todo.append(n)
        left -= part
        want |= dict.fromkeys(part, seed[1] * (1 << 31) + seed[0])
    assert got == want


def test_long_path_is_one_component(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    assert {r.root for r in graph.components(edges).collect()} == {0}
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert graph.components(none).count() == 0


def test_overlay_invariants(spark):
    rng = random.Random(2)
    some = lambda: spark.createDataFrame([(1, rng.randrange(20), rng.randrange(20)) for _ in range(80)], "k int, cx bigint, cy bigint")
    a, b = some().cache(), some().cache()
    n = lambda df: df.count()
    assert n(C.union(a.unionByName(b), ["k"])) == n(C.difference(a, b, ["k"])) + n(C.union(b, ["k"]))
    assert n(C.intersection(a, b, ["k"])) + n(C.difference(a, b, ["k"])) == n(C.union(a, ["k"]))
    assert n(C.dilate(a, ["k"], 2)) >= n(C.union(a, ["k"])) >= n(C.erode(a, ["k"], 1))
    assert n(C.difference(a, C.close(a, ["k"], 2), ["k"])) == 0
    assert n(C.erode(C.dilate(a, ["k"], 1, True), ["k"], 1, True)) >= n(C.union(a, ["k"]))


def test_fold_is_monotone(spark):
    boxes = spark.createDataFrame([("p", 1, 0, 0, 40, 40), ("p", 3, 20, 20, 60, 60)], "project string, position int, minx bigint, miny bigint, maxx bigint, maxy bigint")
    steps = spark.createDataFrame([("p", 0), ("p", 1), ("p", 2), ("p", 3)], "project string, position int")
    got = [(r.position, r.added_area, r.total_area) for r in C.growth(C.cells_of_boxes(boxes, ["project", "position"], 10), steps, ["project"], "position", 10).orderBy("position").collect()]
    assert got == [(0, 0, 0), (1, 1600, 1600), (2, 0, 1600), (3, 1200, 2800)]


def test_growth_blocks_and_roads(spark):
    near = spark.createDataFrame([(1, 1, 0, 0, 4, 4), (1, 2, 9, 0, 13, 4), (1, 3, 60, 0, 64, 4)], "k int, id bigint, minx bigint, miny bigint, maxx bigint, maxy bigint")
    pairs = graph.connector(graph.close_pairs(near, "id", ["k"], 20))
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 2)]
    roads = lambda *lines: spark.createDataFrame(list(lines), "x1 double, y1 double, x2 double, y2 double")
    assert graph.unblocked(pairs, roads((6.0, -900.0, 6.0, 900.0))).count() == 0
    assert graph.unblocked(pairs, roads((6.0, 50.0, 6.0, 900.0), (-90.0, -10.0, 90.0, -10.0))).count() == 1
    assert graph.unblocked(pairs, roads((0.0, -700.0, 13.0, 705.0))).count() == 0  # aslant, between the two
    assert graph.unblocked(pairs, roads((20.0, -700.0, 33.0, 705.0))).count() == 1


def crosses(a, b, c, d):
    """Closed segments, by exact arithmetic."""
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    sign = lambda v: (v > 0) - (v < 0)
    over = lambda k: max(min(a[k], b[k]), min(c[k], d[k])) <= min(max(a[k], b[k]), max(c[k], d[k]))
    return sign(side(a, b, c)) * sign(side(a, b, d)) <= 0 and sign(side(c, d, a)) * sign(side(c, d, b)) <= 0 and over(0) and over(1)


def test_barriers_by_brute_force(spark):
    rng = random.Random(8)
    point = lambda: (float(rng.randrange(0, 3000)), float(rng.randrange(0, 3000)))
    lines = []
    for k in range(150):
        x, y = point()
        lines.append((k, k + 1000, x, y, x + rng.randrange(-60, 61), y + rng.randrange(-60, 61)))
    bars = [(*point(), *point()) for _ in range(25)]
    pairs = spark.createDataFrame(lines, "a bigint, b bigint, x1 double, y1 double, x2 double, y2 double")
    got = {r.a for r in graph.unblocked(pairs, spark.createDataFrame(bars, "x1 double, y1 double, x2 double, y2 double"), 128.0).collect()}
    want = {a for a, _, *l in lines if l[:2] == l[2:] or not any(crosses(l[:2], l[2:], r[:2], r[2:]) for r in bars)}
    assert got == want and 0 < len(got) < 150


def brute_labels(cells, eight=False):
    steps = [(x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if (x or y) and (eight or not (x and y))]
    out = {}
    for seed in sorted(cells, key=lambda c: (c[0], c[2], c[1])):
        todo = [] if seed in out else [seed]
        while todo:
            k, x, y = todo.pop()
            if (k, x, y) in out:
                continue
            out[k, x, y] = seed[2] * (1 << 31) + seed[1]
            todo += [c for i, j in steps if (c := (k, x + i, y + j)) in cells and c not in out]
    return out


@pytest.mark.parametrize("eight", [False, True])
@pytest.mark.parametrize("one_task", [0, 50_000])
def test_labels_across_squares(spark, monkeypatch, eight, one_task):
    """Components that pass many squares, under keys with nulls, by the star rounds and in one task."""
    rng = random.Random(3)
    cells = {(k, x, y) for k in ("a", None) for x in range(-7, 30) for y in range(-5, 27) if rng.random() < 0.57}
    monkeypatch.setattr(graph, "ONE_TASK_EDGES", one_task)
    frame = spark.createDataFrame([*cells, *list(cells)[:40]], "k string, cx bigint, cy bigint")
    got = graph.label_cells(frame, ["k"], size=8, eight=eight).collect()
    want = brute_labels({(k or "", x, y) for k, x, y in cells}, eight)
    assert len(got) == len(cells) and {(r.k or "", r.cx, r.cy): r.label for r in got} == want


def test_running_numbers(spark):
    frame = spark.range(500).withColumn("h", F.xxhash64("id"))
    got = sorted(graph.numbered(frame, ["h"], "n").collect(), key=lambda r: r.h)
    assert [r.n for r in got] == list(range(1, 501))


def test_road_split_keeps_touching_parts(spark):
    """A road beside a feature takes off the far part of its buffer; one over the whole feature leaves the buffer uncut."""
    source = strips.of_cells(spark.createDataFrame([(1, 0, 0), (2, 100, 0)], "id bigint, cx bigint, cy bigint"), ["id"])
    roads = spark.createDataFrame([(15.0, -900.0, 15.0, 900.0), (1005.0, -900.0, 1005.0, 900.0)], "x1 double, y1 double, x2 double, y2 double")
    got = {}
    for r in strips.cells_of(blocks.road_split(source, "id", 2, roads, 10), ["id", "uncut"]).collect():
        got.setdefault((r.id, r.uncut), set()).add((r.cx, r.cy))
    disc = {(x, y) for x in range(-2, 3) for y in range(-2, 3) if x * x + y * y <= 4}
    assert got == {(1, False): {c for c in disc if c[0] < 1}, (2, True): {(100 + x, y) for x, y in disc}}


def test_timing_summary(spark):
    rows = spark.createDataFrame([("r", k, "predict", float(v)) for k, v in enumerate((10, 20, 30, 40))], "run string, tile bigint, field string, ms double")
    fields = spark.createDataFrame([("predict",), ("absent",)], "field string")
    got = {r.field: r for r in metrics.timing_summary(rows, fields, "field", "ms", ["run"]).collect()}
    p = got["predict"]
    assert (p.n, p.mean, p.median, p.p90, p.p95, p.most, p.least, p.total) == (4, 25, 25, 37, 38.5, 40, 10, 100)
    assert (got["absent"].n, got["absent"].mean, got["absent"].total) == (0, None, 0)


def test_probability_stats_of_nothing(spark):
    assert metrics.probability_stats(spark.createDataFrame([("r", None)], "raster string, p double"), ["raster"]).count() == 0


def test_window_starts(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(grid.inference_offsets(F.lit(2048), F.lit(1024), 128)) == [0, 768, 1024]
    assert get(grid.inference_offsets(F.lit(1024), F.lit(1024), 128)) == [0]
    assert get(grid.sliding_positions(10, 4, 3)) == [0, 3, 6]
    assert get(grid.sliding_positions(11, 4, 3)) == [0, 3, 6, 7]
    with pytest.raises(Exception, match="overlap"):
        get(grid.inference_offsets(F.lit(100), F.lit(10), 5))


def test_outline_of_a_ring_with_a_hole(spark):
    a = block((5, 5), (0, 4), (0, 4)) - block((5, 5), (2, 2), (2, 2))
    rings = raster.outlines(raster.label_mask(pixels(spark, a).where("p > 0").select("row", "col"))).orderBy("ring").collect()
    assert [len(r.points) for r in rings] == [5, 5]
    area = rings and [r[0] for r in spark.createDataFrame(rings).select(G.signed_area("points")).collect()]
    assert sorted(map(abs, area)) == [1, 25]


def test_ring_functions():
    ring = np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], float)
    assert G.least_rectangle(ring) == (4, 4)
    turned = ring @ np.array([[0.6, 0.8], [-0.8, 0.6]])
    assert np.allclose(G.least_rectangle(turned * [1, 1]), (4, 4))
    assert len(G.clip_to_box(ring, (10, 10, 20, 20))) == 0
    cut = G.clip_to_box(ring, (2, 2, 9, 9))
    assert {tuple(p) for p in cut} == {(2, 2), (4, 2), (4, 4), (2, 4)}
    band = G.geodesic_area(np.array([0, 1, 1, 0, 0.0]), np.array([0, 0, 1, 1, 0.0]))
    assert abs(band / 12308778361.469 - 1) < 1e-4  # the square degree at the equator


def test_memory_growth(spark):
    rows = [("up", k, 100.0 + 2 * k) for k in range(100)] + [("flat", k, 100.0 + k % 3) for k in range(100)] + [("short", k, 9.0 * k) for k in range(15)]
    got = {r.run: r.grows for r in metrics.memory_growth(spark.createDataFrame(rows, "run string, k int, mb double"), "run", "k", "mb").collect()}
    assert got == {"up": True, "flat": False, "short": False}


def test_value_functions(spark):
    get = lambda c: spark.range(1).select(c).first()[0]
    assert str(get(V.source_date(F.lit(20220112)))) == "2022-01-12" and str(get(V.source_date(F.lit(1641945600000)))) == "2022-01-12"
    assert get(V.source_date(F.lit(20229912))) is None
    assert get(V.safe_label(F.lit(" Été, 2020! "), "x")) == "Ete_2020" and get(V.safe_label(F.lit("日本"), "layer")) == "layer"
    assert get(V.service_name(F.lit("WB_2018_R01"))) == "metadata_2018_r01"
    with pytest.raises(Exception, match="not a release id"):
        get(V.service_name(F.lit("other")))
    assert get(V.human_bytes(F.lit(512))) == "512 B" and get(V.human_bytes(F.lit(2048))) == "2.0 KB"


def test_upsert_and_children(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 0)], "k int, v string, n int")
    assert {(r.k, r.v) for r in records.upsert(old, new, ["k"], "n").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {(r.k, r.v) for r in records.replace_children(old, new, "k").collect()} == {(1, "a"), (2, "c"), (3, "d")}


def changed_square() -> raster.Predictor:
    def predictor(tile, t1, t2, masks):
        assert t1.shape == t2.shape == (tile["y1"] - tile["y0"], tile["x1"] - tile["x0"]) and masks[0].all()
        p = np.abs(t2 - t1) / 255
        return p, p >= 0.2, {"index": tile["index"]}

    return predictor


def test_tiled_prediction_of_whole_windows(spark):
    """A square of 20 pixels that is new at the second date, by tiles of 32 that overlap by 4."""
    t1, t2 = np.zeros((64, 64)), block((64, 64), (20, 39), (20, 39)) * 255
    px = pixels(spark, t1).unionByName(pixels(spark, t2, "t2"))
    headers = spark.createDataFrame([("t1-t2", 64, 64, 32)], "raster string, height bigint, width bigint, size bigint")
    windows = grid.windows(headers, lambda c: grid.inference_offsets(c, F.col("size"), 4), "size")
    patches = raster.predict(windows, raster.paired_chunks(px, size=16), 16, changed_square)
    done = patches.select("index", "h", "w", "metadata").collect()
    assert sorted(r["index"] for r in done) == list(range(windows.count())) and all((r.h, r.w) == (32, 32) and r.metadata == {"index": str(r["index"])} for r in done)
    found = raster.mosaic_pixels(raster.mosaic(patches, 16)).collect()
    assert len(found) == 64 * 64 and {(r.row, r.col) for r in found if r.mask} == {(y, x) for y in range(20, 40) for x in range(20, 40)}
    starts = [0, 24, 32]
    assert all(r.writes == sum(a <= r.row < a + 32 for a in starts) * sum(a <= r.col < a + 32 for a in starts) for r in found)
    regions = raster.tile_regions(spark.createDataFrame([("m", r.row, r.col, r.p) for r in found if r.mask], "raster string, row bigint, col bigint, p double"), 32).collect()
    assert sorted((r.tile_row, r.tile_col, r.pixels) for r in regions) == [(0, 0, 144), (0, 1, 96), (1, 0, 96), (1, 1, 64)]


def flat(level):
    def make():
        return lambda tile, t1, t2, masks: (np.full(t1.shape[-2:], level), np.ones(t1.shape[-2:], bool), {})

    return make


def test_predictors_of_one_closure_differ(spark):
    """Two models of the same factory, and a partial, in one session."""
    from functools import partial

    px = pixels(spark, np.ones((4, 4))).unionByName(pixels(spark, np.ones((4, 4)), "t2"))
    windows = spark.createDataFrame([("t1-t2", 0, 0, 4, 0, 4)], "raster string, index bigint, y0 bigint, y1 bigint, x0 bigint, x1 bigint")
    chunked = raster.paired_chunks(px, size=4)
    assert [raster.predict(windows, chunked, 4, m).first().p[0] for m in (flat(0.1), flat(0.9), partial(flat(0.5)))] == [0.1, 0.9, 0.5]


def test_windows_and_pixels_that_are_missing(spark):
    """A window without a chunk comes out masked; gaps stay where they are."""
    gaps = spark.createDataFrame([("t1", 0, 0, 1.0), ("t1", 0, 1, 2.0), ("t1", 1, 1, 3.0)], "raster string, row bigint, col bigint, p double")
    assert sorted((r.row, r.col, r.p) for r in raster.pixels_of(raster.chunks(gaps, 4)).collect()) == [(0, 0, 1.0), (0, 1, 2.0), (1, 1, 3.0)]
    assert raster.chunks(gaps, 4).first()["values"] == [1.0, 2.0, None, 3.0]
    both = gaps.unionByName(gaps.withColumn("raster", F.lit("t2")))
    windows = spark.createDataFrame([("t1-t2", 0, 0, 2, 0, 2), ("t1-t2", 1, 50, 52, 50, 53)], "raster string, index bigint, y0 bigint, y1 bigint, x0 bigint, x1 bigint")
    got = {r["index"]: (r.h, r.w, r.mask) for r in raster.predict(windows, raster.paired_chunks(both, size=4), 4, flat(0.9)).collect()}
    assert got == {0: (2, 2, [True, True, False, True]), 1: (2, 3, [False] * 6)}


def test_last_window_stays(spark):
    rows = [("r", 1, 0, 0, 1, 3, [1.0, 1.0, 1.0], [True] * 3, {}), ("r", 0, 0, 1, 1, 3, [0.0, 0.0, 0.0], [False] * 3, {})]
    got = raster.mosaic_pixels(raster.mosaic(spark.createDataFrame(rows, raster.PATCH), 2)).orderBy("col").collect()
    assert [(r.col, r.p, r.writes) for r in got] == [(0, 1.0, 1), (1, 1.0, 2), (2, 1.0, 2), (3, 0.0, 1)]


def test_a_part_of_a_pair_that_is_missing_is_masked(spark):
    px = pixels(spark, np.ones((4, 4))).unionByName(pixels(spark, np.ones((4, 3)), "t2"))
    windows = spark.createDataFrame([("t1-t2", 0, 0, 4, 0, 4)], "raster string, index bigint, y0 bigint, y1 bigint, x0 bigint, x1 bigint")
    patch = raster.predict(windows, raster.paired_chunks(px, size=4), 4, everything).first()
    assert [x for k, x in enumerate(patch.mask) if k % 4 == 3] == [False] * 4 and sum(patch.mask) == 12


def everything() -> raster.Predictor:
    return lambda tile, t1, t2, masks: (t1, np.ones(t1.shape, bool), {})


@pytest.mark.parametrize("values", [[1.0], [3.0, 1.0], [5.0] * 50, [float(v % 97) for v in range(1000)], [1e-9, 1e9, None, float("nan"), 7.0]])
def test_percentiles_by_sorting(spark, values):
    frame = spark.createDataFrame([("g", v) for v in values] + [("h", 2.0)], "g string, v double")
    levels = (0.0, 0.01, 0.5, 0.9, 0.95, 1.0)
    got = {r.g: r.q for r in metrics.percentiles(frame, ["g"], "v", levels, bins=16).collect()}
    plain = [v for v in values if v is not None and v == v]
    assert np.allclose(got["g"], [np.percentile(plain, q * 100) for q in levels]) and got["h"] == [2.0] * len(levels)


def test_first_that_fits_by_brute_force(spark):
    rng = random.Random(4)
    offers = [(rng.randrange(3), k, rng.randrange(2000)) for k in range(200)]
    wanted = [(k, rng.randrange(4), rng.randrange(2100)) for k in range(150)]
    got = records.first_that_fits(spark.createDataFrame(wanted, "id int, k int, need int"), spark.createDataFrame(offers, "k int, v int, size int"), "k", "need", "size", "v", 100).collect()
    assert {(r.id, r.v) for r in got} == {(i, min((v for o, v, size in offers if o == k and size >= need), default=None)) for i, k, need in wanted} and len(got) == 150


def test_override_outside_the_area_is_an_error(spark):
    boxes = lambda *rows: spark.createDataFrame(list(rows), "k int, minx bigint, miny bigint, maxx bigint, maxy bigint")
    base, inside, outside = boxes((1, 0, 0, 10, 10), (2, 0, 0, 10, 10)), boxes((2, 5, 5, 30, 30)), boxes((2, 500, 500, 510, 510))
    got = records.override_layer(base, inside, "k", (0, 0, 20, 20))
    assert {tuple(r) for r in got.select("k", "minx", "miny", "maxx", "maxy").collect()} == {(1, 0, 0, 10, 10), (2, 5, 5, 20, 20)}
    with pytest.raises(ValueError, match="inside"):
        records.override_layer(base, outside, "k", (0, 0, 20, 20))


def test_payloads_are_split_and_found_again(spark):
    rows = spark.createDataFrame([(1, "x" * 50), (2, "short"), (3, None), (4, "x" * 50)], "id int, body string")
    main, side = records.split_payloads(rows, "body", 10, "tag/1")
    assert {(r.id, r.storage, r.payload) for r in main.collect()} == {(1, "external", None), (2, "inline", "short"), (3, "inline", None), (4, "external", None)}
    assert [(r.bytes, r.schema_tag, r.payload) for r in side.collect()] == [(50, "tag/1", "x" * 50)]


def test_nested_leaves_below_the_depth_stay_as_text(spark):
    doc = '{"a": {"b": {"c": 1}}, "d": [2, {"e": 3}]}'
    got = {r.field_path: r.value for r in exports.walk_json(spark.createDataFrame([(1, doc)], "id int, doc string"), "doc", ["id"], 2).collect()}
    assert got == {"$.a.b": '{"c":1}', "$.d[0]": "2", "$.d[1]": '{"e":3}'}


def test_areas_without_a_told_system(spark):
    texts = ["POLYGON ((0 0, 111319.49 0, 111319.49 111325.14, 0 0))", '{"type":"Polygon","coordinates":[[[1,2],[3,2],[3,4],[1,2]]]}', "POLYGON ((190 0, 200 0, 200 5, 190 0))", "nothing"]
    got = exports.imported_areas(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text").orderBy("id").collect()
    assert [(r.crs, r.valid) for r in got] == [("EPSG:3857", True), ("EPSG:4326", True), ("EPSG:4326", False), ("EPSG:4326", False)]
    assert abs(got[0].bounds.maxx - 1) < 1e-5 and abs(got[0].bounds.maxy - 1) < 1e-3


def test_a_runner_that_fails_marks_its_pair(spark):
    from landfold.plans import files as plans

    pairs = spark.createDataFrame([(1, 5.0, 3.0), (2, 5.0, None)], "release int, total double, before double")
    got = {r.release: (r.changed, r.error) for r in plans.run_pairs(pairs, plans.growing, "changed double").collect()}
    assert got == {1: (2.0, None), 2: (None, "no milestone before")}


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """State, watermark and the table of completed tiles are carried over batches and a restart; late events are dropped."""
    rows = lambda *hours: spark.createDataFrame([(f"2024-01-01 {h:02d}:00:00", h % 3) for h in hours], "t string, tile int").selectExpr("CAST(t AS timestamp) AS ts", "0 AS run_id", "tile")
    src, windows, tiles = (f"file://{tmp_path}/{n}" for n in ("src", "windows", "tiles"))
    stream = lambda: jobs.file_stream(spark, rows(0).schema, src)
    counted = lambda: jobs.windowed_metrics(stream().selectExpr("ts", "'n' AS name", "1.0 AS value"), "1 hour", "10 minutes")
    once = lambda: jobs.completed_once(stream(), "1 hour")
    done = lambda: (sorted((r.start.hour, r.n) for r in jobs.run(counted(), "append", "w", windows).collect()), sorted(r.tile for r in jobs.run(once(), "append", "o", tiles, ("run_id", "tile")).collect()))
    rows(0, 0, 1).coalesce(1).write.mode("append").parquet(src)
    rows(4, 5).coalesce(1).write.mode("append").parquet(src)
    assert done() == ([(0, 2), (1, 1)], [0, 1, 2])
    rows(1, 5, 9).coalesce(1).write.mode("append").parquet(src)  # the first is too late for its window
    assert done() == ([(0, 2), (1, 1), (4, 1), (5, 2)], [0, 1, 2])


def test_a_refreshed_summary_goes_on_after_a_restart(spark, tmp_path):
    """Summaries each 25 rows and at the end; a call with nothing new returns the last one."""
    seen = []

    def summary(rows):
        seen.append(rows.count())
        return rows.agg(F.count("*").alias("n"), F.sum("v").alias("total"))

    add = lambda low, high: spark.range(low, high).select(F.col("id").alias("v")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: jobs.file_stream(spark, "v bigint", f"{tmp_path}/in")
    told = lambda: tuple(jobs.refreshed(stream(), "r", summary, 25, f"{tmp_path}/base").first())
    for low in (0, 10, 20):
        add(low, low + 10)
    assert told() == (30, 435) and seen == [30]  # the third batch completes 25, and nothing is left
    assert told() == (30, 435) and seen == [30]
    add(30, 40)
    assert told() == (40, 780) and seen == [30, 40]


def test_json_stream_drops_broken_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "x", "value": 1}\n{broken\n{"name": "x", "value": 2}\n')
    stream = jobs.json_stream(spark, f"file://{tmp_path}", "name string, value double")
    got = jobs.run(stream.groupBy("name").agg(F.count("*").alias("n")), "complete", "json").collect()
    assert [(r.name, r.n) for r in got] == [("x", 2)]


def test_growth_envelope_of_every_project(spark):
    from landfold.plans import growth

    sf_dir = "/root/testdata/sf0.001"
    boxes = view(spark, sf_dir, "v_feature").where("layer = 'additions'").select("project", "minx", "miny", "maxx", "maxy").collect()
    got = {r.project: r for r in growth.QUERIES["fn33_growth_envelope"](spark, sf_dir).collect()}
    assert set(got) == {b.project for b in boxes} and all(r.covered for r in got.values())
    disc = lambda n: [(x, y) for x in range(-n, n + 1) for y in range(-n, n + 1) if x * x + y * y <= n * n]
    grown = lambda s, n: {(x + i, y + j) for x, y in s for i, j in disc(n)}
    shrunk = lambda s, n: {(x, y) for x, y in s if all((x + i, y + j) in s for i, j in disc(n))}
    for project in (0, 3, 21):
        base = {(x, y) for b in boxes if b.project == project for x in range(b.minx // 10, b.maxx // 10) for y in range(b.miny // 10, b.maxy // 10)}
        shut = base | shrunk(grown(base, 2), 2)
        (x0, x1), (y0, y1) = ((min(v) - 1, max(v) + 1) for v in zip(*shut, strict=True))
        seen, todo = {(x0, y0)}, [(x0, y0)]
        while todo:
            x, y = todo.pop()
            near = {(x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)} - seen - shut
            near = {(i, j) for i, j in near if x0 <= i <= x1 and y0 <= j <= y1}
            seen |= near
            todo += near
        whole = {(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1)} - seen
        smooth = grown(shrunk(whole, 1), 1)
        cut = {(x, y) for x, y in (smooth if base <= smooth else whole) if 5 <= x <= 394 and 5 <= y <= 394}
        assert (got[project].cells, got[project].smoothed) == (len(cut), base <= smooth)
        assert abs(got[project].area_m2 / len(cut) / 103.6 - 1) < 0.01  # a cell of 0.0001 degrees at 33 degrees north


def test_holes_are_filled(spark):
    """A hole closed by a corner alone, an island inside a hole, and a bay that stays open."""
    ring = {(x, y) for x in range(7) for y in range(7) if not (0 < x < 6 and 0 < y < 6)} | {(3, 3)}
    corner = {(20, 21), (21, 20), (22, 21), (21, 22)}
    bay = {(30, 0), (30, 1), (30, 2), (31, 2), (32, 2), (32, 1), (32, 0)}
    frame = spark.createDataFrame([(1, x, y) for x, y in ring | corner | bay], "k int, cx bigint, cy bigint")
    got = {(r.cx, r.cy) for r in exports.filled(frame, ["k"]).collect()}
    assert got == {(x, y) for x in range(7) for y in range(7)} | corner | {(21, 21)} | bay


def test_paths_are_resolved_to_any_depth(spark):
    from landfold.sources.files import resolved

    want = {
        "a/b/c/d/e/f/../../../../../../x": "x", "/a/./b/../c": "/a/c", "../a/../b": "../b", "file:///a/b/../../c": "file:///c", "a/../../b": "../b", "/../x": "/../x", "./a": "a", "plain": "plain",
    }
    got = {r.path: r.to for r in spark.createDataFrame([(p,) for p in want], "path string").select("path", resolved(F.col("path")).alias("to")).collect()}
    assert got == want


def test_metric_lines_keep_decimals(spark):
    rows = [("gauge", "g", "x", 0.5, 1), ("counter", "c", 'a"\\\n', 12.0, 1), ("histogram", "h", "x", 2.25, 7), ("gauge", "z", "x", -0.0, 1)]
    merged = spark.createDataFrame(rows, "kind string, name string, label string, value double, observations bigint")
    lines = {r.line for r in metrics.metric_lines(merged).collect()}
    assert lines == {'g{label="x"} 0.5', 'c{label="a\\"\\\\\\n"} 12', 'h_count{label="x"} 7', 'h_sum{label="x"} 2.25', 'z{label="x"} 0'}


def test_known_points_in_utm(spark):
    """A tower whose place is well known, a point on a central meridian, and both ways to under a millimetre."""
    at = lambda lon, lat, epsg: spark.range(1).select(*[v.alias(n) for n, v in zip("xy", grid.project_utm(F.lit(lon), F.lit(lat), F.lit(epsg)), strict=True)]).first()
    tower = at(-79.387139, 43.642566, 32617)
    assert abs(tower.x - 630084) < 1 and abs(tower.y - 4833438) < 1.5
    middle = at(-9.0, 0.0, 32729)
    assert abs(middle.x - 500_000) < 1e-6 and abs(middle.y - 10_000_000) < 1e-6
    rng = random.Random(8)
    rows = [(lon, rng.uniform(-84, 84)) for lon in (rng.uniform(-180, 180) for _ in range(300))]
    frame = spark.createDataFrame(rows, "lon double, lat double").withColumn("epsg", grid.utm_epsg("lon", "lat"))
    x, y = grid.reproject("lon", "lat", F.lit(4326), "epsg")
    lon, lat = grid.reproject("x", "y", "epsg", F.lit(4326))
    for r in frame.withColumns({"x": x, "y": y}).withColumns({"lon2": lon, "lat2": lat}).collect():
        assert abs(r.lat2 - r.lat) * 111_320 < 1e-3 and abs(r.lon2 - r.lon) * 111_320 < 1e-3
    mx, my = grid.reproject(F.lit(-79.387139), F.lit(43.642566), F.lit(4326), F.lit(3857))
    ux, uy = grid.reproject(mx, my, F.lit(3857), F.lit(32617))
    row = spark.range(1).select(ux.alias("x"), uy.alias("y"), grid.reproject(mx, my, F.lit(3857), F.lit(1234))[0].alias("none")).first()
    assert abs(row.x - tower.x) < 1e-3 and abs(row.y - tower.y) < 1e-3 and row.none is None


def test_ring_distances(spark):
    """Apart, touching at a corner, crossing, one within another, and one inside another's hole."""
    box = lambda x0, y0, x1, y1: [{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]
    slanted = [{"x": 30.0, "y": 0.0}, {"x": 40.0, "y": 10.0}, {"x": 30.0, "y": 20.0}]
    rows = [
        (1, 1, [box(0, 0, 10, 10)]), (1, 2, [slanted]), (1, 3, [box(10, 10, 14, 14)]), (1, 4, [box(5, -5, 6, 30)]), (1, 5, [box(2, 2, 3, 3)]),
        (2, 6, [box(0, 0, 100, 100), box(20, 20, 80, 80)]), (2, 7, [box(45, 45, 55, 55)]), (2, 8, [box(22, 40, 24, 44)]), (1, 9, [box(9000, 0, 9001, 1)]), (3, 10, None), (3, 11, []),
    ]
    frame = spark.createDataFrame(rows, "k int, id bigint, rings array<array<struct<x: double, y: double>>>")
    found = {(r.a, r.b): r for r in graph.ring_pairs(frame, "id", ["k"], 25).collect()}
    link = found[6, 8]
    assert (link.x1, link.x2) == (20.0, 22.0) and link.y1 == link.y2 and 40 <= link.y1 <= 44
    assert found[1, 2].distance == 20.0 and (found[1, 2].x1, found[1, 2].x2) == (10.0, 30.0)
    assert [found[p].distance for p in ((1, 3), (1, 4), (1, 5))] == [0.0, 0.0, 0.0] and found[6, 7].distance == 25.0 and found[4, 5].distance == 2.0
    assert not any(9 in p or 10 in p or 11 in p for p in found)


def generated_in_broadcast(df):
    """Whether the plan broadcasts what an explode gives, whose size the planner can't know."""
    lines = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple").splitlines()
    deep = lambda line: len(line) - len(line.lstrip(" :+-"))
    for k, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = itertools.takewhile(lambda x: deep(x) > deep(line), lines[k + 1 :])
            if any("Generate" in x for x in below):
                return True
    return False


def test_resampling_joins_no_grid(spark):
    """Against a plain version, with gaps and several scales; no row of the target is sent to all tasks."""
    rng = np.random.default_rng(4)
    a = rng.random((9, 7))
    a[rng.random(a.shape) < 0.2] = np.nan
    frame = pixels(spark, a).where("NOT isnan(p)")
    for scale, nearest in ((2.0, False), (2.0, True), (3.0, True), (1.5, False), (0.75, False), (0.5, True)):
        found = raster.resample(frame, scale, nearest)
        assert not generated_in_broadcast(found)
        want = {}
        for r in range(int(9 // scale)):
            for c in range(int(7 // scale)):
                y, x = (r + 0.5) * scale - 0.5, (c + 0.5) * scale - 0.5
                y0, x0 = (int(np.floor(v + 0.5 * nearest)) for v in (y, x))
                near = [(y0, x0, 1.0)] if nearest else [(y0 + i, x0 + j, abs(1 - i - y + y0) * abs(1 - j - x + x0)) for i in (0, 1) for j in (0, 1)]
                near = [(a[i, j], w) for i, j, w in near if w > 0 and 0 <= i < 9 and 0 <= j < 7 and not np.isnan(a[i, j])]
                if near:
                    want[r, c] = sum(v * w for v, w in near) / sum(w for _, w in near)
        got = {(x["row"], x["col"]): x["p"] for x in found.collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_features_alike_are_paired_once(spark):
    """Boxes and rings with copies against all pairs; copies are met as one, and NULL keys are alike to none."""
    rng = random.Random(6)
    spots = [(rng.randrange(0, 400), rng.randrange(0, 400), rng.randrange(5, 40), rng.randrange(5, 40)) for _ in range(25)]
    rows = [(None if k % 19 == 0 else k % 2, k, *(lambda x, y, w, h: (x, y, x + w, y + h))(*spots[rng.randrange(25)])) for k in range(160)]
    frame = spark.createDataFrame(rows, "k int, id bigint, minx bigint, miny bigint, maxx bigint, maxy bigint")
    far = lambda a, b: max(a[2] - b[4], b[2] - a[4], 0) ** 2 + max(a[3] - b[5], b[3] - a[5], 0) ** 2
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[0] is not None and a[0] == b[0] and far(a, b) <= 400}
    shapes = graph.alike(frame, "id", ["k"], graph.BOX)
    assert shapes.count() < 70
    pairs = graph.close_pairs(shapes, "id", ["k"], 20).select("a", "b")
    own = shapes.where("members > 1").select(F.col("id").alias("a"), F.col("id").alias("b"))
    found = [(r.a, r.b) for r in graph.of_members(pairs.unionByName(own), frame, "id", shapes, ["k", *graph.BOX]).collect()]
    assert len(found) == len(want) and set(found) == want
    rooted = graph.with_shape_roots(frame, "id", graph.with_roots(shapes, "id", pairs), ["k", *graph.BOX])
    plain = {r.id: r.root for r in graph.with_roots(frame, "id", graph.close_pairs(frame, "id", ["k"], 20).select("a", "b")).collect()}
    assert {r.id: r.root for r in rooted.collect()} == plain and len(plain) == 160


def test_polygons_alike_are_paired_once(spark):
    """Polygons with copies: the same distances as between all, from plans that broadcast nothing that was exploded."""
    rng = random.Random(12)
    ring = lambda x, y, s: [{"x": float(x + dx * s), "y": float(y + dy * s)} for dx, dy in ((0, 0), (3, 1), (2, 4), (-1, 2))]
    spots = [(rng.randrange(0, 300), rng.randrange(0, 300), rng.randrange(3, 12)) for _ in range(14)]
    rows = [(k % 2, k, [ring(*spots[rng.randrange(14)])]) for k in range(60)]
    kind = "k int, id bigint, rings array<array<struct<x: double, y: double>>>"
    found = graph.ring_pairs(spark.createDataFrame(rows, kind), "id", ["k"], 25)
    got = {(r.a, r.b): r.distance for r in found.collect()}
    alone = {}
    for k in (0, 1):  # each pair of unlike ones as a frame's only two
        unlike = {str(r[2]): r for r in rows if r[0] == k}
        told = graph.ring_pairs(spark.createDataFrame(list(unlike.values()), kind), "id", ["k"], 25).collect()
        of = {r[1]: str(r[2]) for r in unlike.values()}
        alone |= {(k, frozenset((of[r.a], of[r.b]))): r.distance for r in told}
    want = {}
    for a in rows:
        for b in rows:
            if a[1] < b[1] and a[0] == b[0]:
                d = 0.0 if a[2] == b[2] else alone.get((a[0], frozenset((str(a[2]), str(b[2])))))
                if d is not None:
                    want[a[1], b[1]] = d
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    shapes = graph.alike(spark.createDataFrame(rows, kind), "id", ["k"], ["rings"])
    assert shapes.count() <= 28 and not generated_in_broadcast(graph.ring_links(shapes, "id", ["k"], 25))

def test_tiles_of_boxes(spark):
    """Against every tile by hand: boxes on tiles' borders, over several tiles, without extent, and NULL ones."""
    from landfold.functions.geometry import clip_to_box, ring_area
    from landfold.plans.geometry import LEVELS, feature_tiles

    boxes = [(0, 0, 128, 128), (100, 100, 300, 140), (512, 0, 520, 10), (-10, -10, 10, 10), (5, 5, 5, 50), (5, 5, 50, 5), (250, 250, 262, 262), None]
    df = spark.createDataFrame([(k, *(b or [None] * 4)) for k, b in enumerate(boxes)], "id long, minx long, miny long, maxx long, maxy long")
    got = feature_tiles(df)
    assert "signed" not in got._jdf.queryExecution().optimizedPlan().toString() and "aggregate(" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for k, b in enumerate(boxes):
        for z, size in LEVELS.items():
            for tx in range(-2, 8) if b else ():
                for ty in range(-2, 8):
                    a, c, d, e = b
                    ring = np.array([(a, c), (d, c), (d - (d - a) * 0.25, e), (a, e), (a, c)], float)
                    cut = clip_to_box(ring, (tx * size, ty * size, (tx + 1) * size, (ty + 1) * size))
                    if len(cut) and ring_area(cut) > 0:
                        want[k, z, tx, ty] = round(ring_area(cut), 6)
    rows = got.collect()
    found = {(r.id, r.z, r.tx, r.ty): round(float(ring_area(np.array([(p.x, p.y) for p in r.cut]))), 6) for r in rows}
    assert len(rows) == len(found) and found == want


def test_parts_of_polygons_in_a_batch(spark):
    """Copies, NULL and empty polygons, and the same points as one ring or two: each row gets its own parts."""
    square, hole = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)]
    points = lambda ring: [{"x": float(x), "y": float(y)} for x, y in ring]
    rows = [[square, hole], [square + hole], [square], None, [], [square, hole], [square, []], [[], square]]
    df = spark.createDataFrame([(k, None if r is None else [points(x) for x in r]) for k, r in enumerate(rows)], "id long, rings array<array<struct<x: double, y: double>>>").coalesce(1)
    got = {r.id: r.parts for r in df.select("id", G.clipped_parts("rings", (-1.0, -1.0, 9.0, 9.0)).alias("parts")).collect()}
    assert {k: None if v is None else [len(p) for p in v] for k, v in got.items()} == {0: [2], 1: [1], 2: [1], 3: None, 4: [], 5: [2], 6: [1], 7: []}
    assert got[0] == got[5] and len(got[1][0][0]) == 10
    measured = df.select("id", G.clipped_ring(F.col("rings")[0], (1, 1, 9, 9)).alias("r")).where("id IN (0, 2, 3)").collect()
    assert {r.id: None if r.r is None else [(p.x, p.y) for p in r.r] for r in measured} == {0: [(4, 1), (4, 4), (1, 4), (1, 1), (4, 1)], 2: [(4, 1), (4, 4), (1, 4), (1, 1), (4, 1)], 3: None}
