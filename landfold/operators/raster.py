"""Rasters: pixel rows (raster, row, col, value) for neighbourhoods, chunk rows with arrays for per-pixel work."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landfold.functions.geometry import cell_area_m2
from landfold.operators import cells as C
from landfold.operators.graph import label_cells, label_chunks, whole_groups


def to_cells(pixels: DataFrame) -> DataFrame:
    return pixels.withColumnsRenamed({"col": "cx", "row": "cy"})


def to_pixels(cells: DataFrame) -> DataFrame:
    return cells.withColumnsRenamed({"cx": "col", "cy": "row"})


def _placed(cells: str, field: Callable[[Column], Column], h: Column, w: Column, row0: Column, col0: Column) -> Column:
    """Values of cells (structs with row, col) in row-major order; NULL where a place has no cell."""
    full = F.transform(F.array_sort(cells), lambda x: field(x))
    at = F.map_from_entries(F.transform(cells, lambda x: F.struct(((x.row - row0) * w + x.col - col0).cast("int").alias("k"), field(x).alias("v"))))
    return F.when(F.size(cells) == h * w, full).otherwise(F.transform(F.sequence(F.lit(0), (h * w - 1).cast("int")), lambda k: F.try_element_at(at, k)))


def chunks(pixels: DataFrame, size: int = 32, bands: tuple[str, ...] = ("p",)) -> DataFrame:
    """(raster, chunk_row, chunk_col, row0, col0, h, w, values): values in row-major order, NULL for pixels that aren't there.
    With several bands, values has an array for each, and `valid` is where all of them have a value: a bit a pixel in numbers of
    64, or NULL where that is everywhere."""
    at = pixels.withColumns({"chunk_row": F.floor(F.col("row") / size), "chunk_col": F.floor(F.col("col") / size)})
    place = [F.min("row").alias("row0"), F.min("col").alias("col0"), (F.max("row") - F.min("row") + 1).alias("h"), (F.max("col") - F.min("col") + 1).alias("w")]
    found = at.groupBy("raster", "chunk_row", "chunk_col").agg(F.collect_list(F.struct("row", "col", *bands)).alias("_c"), *place)
    put = lambda field: _placed("_c", field, F.col("h"), F.col("w"), F.col("row0"), F.col("col0"))
    names = ["raster", "chunk_row", "chunk_col", "row0", "col0", "h", "w"]
    if len(bands) == 1:
        return found.select(*names, put(lambda x: x[bands[0]]).alias("values"))
    there = F.transform(put(lambda x: F.array(*[x[b] for b in bands])), lambda v: v.isNotNull() & ~F.exists(v, lambda x: x.isNull()))
    whole = found.select(*names, F.array(*[put(itemgetter(b)) for b in bands]).alias("values"), there.alias("_valid"))
    word = lambda k: F.aggregate(F.transform(F.slice("_valid", k * 64 + 1, 64), lambda v, j: F.when(v, F.call_function("shiftleft", F.lit(1).cast("bigint"), j)).otherwise(0)), F.lit(0).cast("bigint"), lambda t, x: t.bitwiseOR(x))
    packed = F.transform(F.sequence(F.lit(0), F.ceil(F.size("_valid") / 64).cast("int") - 1), word)
    return whole.select(*names, "values", F.when(F.exists("_valid", lambda v: ~v), packed).alias("valid"))


def pixels_of(chunked: DataFrame) -> DataFrame:
    """(raster, row, col, p) of the pixels that have a value."""
    rows = chunked.select("raster", "row0", "col0", "w", F.posexplode("values").alias("k", "p")).where("p IS NOT NULL")
    return rows.select("raster", (F.col("row0") + F.floor(F.col("k") / F.col("w"))).alias("row"), (F.col("col0") + F.col("k") % F.col("w")).alias("col"), "p")


def threshold(values: str, valid: str, t: float) -> Column:
    """Chunk arrays: value at least t and valid."""
    return F.zip_with(values, valid, lambda p, v: (p >= t) & v)


def probability_gain(t1: str, t2: str) -> Column:
    """Chunk arrays: t2 less t1, within 0 and 1."""
    return F.zip_with(t1, t2, lambda a, b: F.greatest(F.lit(0.0), F.least(F.lit(1.0), b - a)))


def pair(pixels: DataFrame, a: str = "t1", b: str = "t2") -> DataFrame:
    """Both dates' values in one row per pixel."""
    one = lambda r: F.max(F.when(F.col("raster") == r, F.col("p")))
    return pixels.groupBy("row", "col").agg(one(a).alias("p1"), one(b).alias("p2"))


def aligned(headers: DataFrame, a: str, b: str) -> DataFrame:
    """headers: (raster, height, width, crs, transform). The pair with its mismatches, in this order; none if aligned. A raster
    that isn't there differs in everything."""
    fields = ("height", "width", "crs", "transform")
    one, two = (headers.where(F.col("raster") == r).select(F.lit(1).alias("_k"), F.struct(*fields).alias(f"_{k}")) for k, r in (("a", a), ("b", b)))
    differs = [F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), f) for f in fields]
    return one.join(two, "_k", "full").select(F.lit(a).alias("t1"), F.lit(b).alias("t2"), F.array_compact(F.array(*differs)).alias("mismatches"))


def dilate_mask(mask: DataFrame, pixels: int, bounds: tuple[int, int] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """3 x 3 dilation, repeated: all within a Chebyshev radius; 0 or below changes nothing. bounds: height and width."""
    out = to_pixels(C.dilate(to_cells(mask), list(keys), pixels, square=True))
    return out.where(F.col("row").between(0, bounds[0] - 1) & F.col("col").between(0, bounds[1] - 1)) if bounds else out


def label_mask(mask: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """4-connected components."""
    return to_pixels(label_cells(to_cells(mask), list(keys)))


def large_components(labelled: DataFrame, min_pixels: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Those of at least min_pixels."""
    big = labelled.groupBy(*keys, "label").count().where(F.col("count") >= min_pixels)
    return labelled.join(big, [*keys, "label"], "left_semi")


def far_components(labelled: DataFrame, reference: DataFrame, distance: float, min_pixels: int) -> DataFrame:
    """Components with at least max(1, min_pixels) pixels whose Euclidean distance to the reference mask is at least
    `distance`. A distance of 0 or below, or an empty reference, keeps all."""
    if distance <= 0:
        return labelled
    near = [o for o in C.disc(distance) if o[0] ** 2 + o[1] ** 2 < distance**2]
    close_by = to_pixels(C._spread(to_cells(reference).select("cx", "cy"), [], near)).distinct()
    core = labelled.join(close_by, ["row", "col"], "left_anti").groupBy("label").count().where(F.col("count") >= max(1, min_pixels))
    return labelled.join(core, "label", "left_semi")


def new_objects(both: DataFrame, change: str, t: float, object_t: float, dilation: int, bounds: tuple[int, int] | None = None) -> DataFrame:
    """Change, on an object at t2, off the dilated objects of t1; both: row, col, p1, p2 and the change's column."""
    old = dilate_mask(both.where(F.col("p1") >= object_t).select("row", "col"), dilation, bounds)
    now = both.where((F.col(change) >= t) & (F.col("p2") >= object_t)).select("row", "col")
    return now.join(old, ["row", "col"], "left_anti")


def regions(labelled: DataFrame, pixels: DataFrame, size: int = 10) -> DataFrame:
    """One row per component: pixels, mean and greatest probability over its own pixels (values that aren't numbers don't
    count), extent, centroid, and the area on the ellipsoid of a grid of the metric plane whose pixels are `size` wide."""
    joined = labelled.join(pixels.select("row", "col", F.nanvl("p", F.lit(None).cast("double")).alias("p")), ["row", "col"])
    return joined.groupBy("label").agg(F.sum(cell_area_m2("row", size)).alias("area_m2"), F.count("*").alias("pixels"), F.avg("p").alias("mean_p"), F.max("p").alias("max_p"), F.min("row").alias("row0"), F.max("row").alias("row1"), F.min("col").alias("col0"), F.max("col").alias("col1"), (F.avg("col") + 0.5).alias("centre_x"), (F.avg("row") + 0.5).alias("centre_y"))


def boundary_edges(labelled: DataFrame, keys: list[str] | tuple = ()) -> DataFrame:
    """Directed unit edges (x1, y1, x2, y2) of the components' outlines, the inside on the right: a cell's side is an edge if
    the neighbour across it isn't of the component. An edge between two cells of one component would show up twice."""
    c, r = F.col("col"), F.col("row")
    side = lambda x1, y1, x2, y2: F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    sides = labelled.select(*keys, "label", F.explode(F.array(side(c, r, c + 1, r), side(c + 1, r, c + 1, r + 1), side(c + 1, r + 1, c, r + 1), side(c, r + 1, c, r))).alias("e")).select(*keys, "label", "e.*")
    lo = F.struct(F.least("x1", "x2").alias("x"), F.least("y1", "y2").alias("y"), (F.col("x1") == F.col("x2")).alias("v"))
    once = sides.groupBy(*keys, "label", lo.alias("at")).agg(F.count("*").alias("n"), F.first(F.struct("x1", "y1", "x2", "y2")).alias("e")).where("n = 1")
    return once.select(*keys, "label", "e.*")


def _rings(edges: np.ndarray) -> list[list[tuple[int, int]]]:
    """Closed rings of one component's edges (rows of x1, y1, x2, y2, sorted by y1, x1)."""
    after: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x1, y1, x2, y2 in edges.tolist():
        after.setdefault((x1, y1), []).append((x2, y2))
    rings = []
    for start in list(after):
        while start in after:
            ring, at, came = [start], start, (1, 0)
            while True:
                options = after[at]
                # at a corner where two parts touch, turn towards the inside, so that rings don't cross
                nxt = min(options, key=lambda p: {(came[0], came[1]): 1, (-came[1], came[0]): 0, (came[1], -came[0]): 2}.get((p[0] - at[0], p[1] - at[1]), 3))
                options.remove(nxt)
                if not options:
                    del after[at]
                step = (nxt[0] - at[0], nxt[1] - at[1])
                if step == came and len(ring) > 1:
                    ring[-1] = nxt
                else:
                    ring.append(nxt)
                at, came = nxt, step
                if at == start:
                    break
            rings.append(ring)
    return rings


def outlines(labelled: DataFrame, keys: list[str] | tuple = ()) -> DataFrame:
    """(keys, label, ring, points): closed rings chained from the boundary edges, the outer one first. One component's outline is
    held by one task; it is as long as its edge, not its area."""
    group = [*keys, "label"]
    dealt = boundary_edges(labelled, keys).repartition(*group).sortWithinPartitions(*group, "y1", "x1", "y2", "x2")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, group):
            edges = np.stack([rows[c].to_numpy() for c in ("x1", "y1", "x2", "y2")], axis=1)
            found = [_rings(part) for part in np.split(edges, starts[1:])]
            own = pa.array(np.repeat(starts, [len(f) for f in found]))
            rings = [ring for f in found for ring in f]
            points = np.array([p for ring in rings for p in ring], float).reshape(-1, 2)
            ends = pa.array(np.cumsum([0, *map(len, rings)]), pa.int32())
            listed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], ["x", "y"]))
            number = pa.array([k for f in found for k in range(len(f))], pa.int32())
            yield pa.RecordBatch.from_arrays([*(rows[c].take(own).combine_chunks() for c in group), number, listed], [*group, "ring", "points"])

    kinds = "".join(f"`{k}` {labelled.schema[k].dataType.simpleString()}, " for k in group)
    return dealt.mapInArrow(over, kinds + "ring int, points array<struct<x: double, y: double>>")


#: (tile, t1, t2, masks) -> (probability, mask, metadata): a window's place, both dates' values and validity as arrays of its
#: shape (values of several bands with the band as the first axis), and what a model makes of them. The masks are those of both
#: dates, and of the area where there is one.
Predictor = Callable[[dict, np.ndarray, np.ndarray, tuple[np.ndarray, ...]], tuple[np.ndarray, np.ndarray, dict]]
PATCH = "raster string, index bigint, y0 bigint, x0 bigint, h bigint, w bigint, p array<double>, mask array<boolean>, metadata map<string, string>"
_MADE: dict = {}
#: Predictors that a worker process keeps.
MADE_MOST = 8


def _made(token: str, make: Callable[[], Predictor]) -> Predictor:
    """One predictor for each worker process and call of predict()."""
    if token not in _MADE:
        while len(_MADE) >= MADE_MOST:
            del _MADE[next(iter(_MADE))]
        _MADE[token] = make()
    return _MADE[token]


def paired_chunks(pixels: DataFrame, a: str = "t1", b: str = "t2", size: int = 32, bands: tuple[str, ...] = ("p",)) -> DataFrame:
    """Chunks of both dates side by side: (raster, chunk_row, chunk_col, row0, col0, h, w, v1, v2, m1, m2), the masks being where
    a date has a value in all bands; an array of a mask is NULL where that is everywhere. With several bands v1 and v2 have
    an array for each."""
    one = lambda r, c: F.max(F.when(F.col("raster") == r, F.col(c)))
    both = pixels.groupBy("row", "col").agg(*[one(r, c).alias(f"{c}_{k}") for k, r in ((1, a), (2, b)) for c in bands])
    both = both.withColumns({"chunk_row": F.floor(F.col("row") / size), "chunk_col": F.floor(F.col("col") / size)})
    names = [f"{c}_{k}" for k in (1, 2) for c in bands]
    place = [F.min("row").alias("row0"), F.min("col").alias("col0"), (F.max("row") - F.min("row") + 1).alias("h"), (F.max("col") - F.min("col") + 1).alias("w")]
    found = both.groupBy("chunk_row", "chunk_col").agg(F.collect_list(F.struct("row", "col", *names)).alias("_c"), *place)
    put = lambda c: _placed("_c", lambda x: x[c], F.col("h"), F.col("w"), F.col("row0"), F.col("col0"))
    found = found.withColumns({n: put(n) for n in names})
    out = []
    for k in (1, 2):
        own = [F.col(f"{c}_{k}") for c in bands]
        values = own[0] if len(bands) == 1 else F.array(*own)
        there = F.transform(own[0], lambda v: v.isNotNull())
        for band in own[1:]:
            there = F.zip_with(there, band, lambda t, v: t & v.isNotNull())
        out += [values.alias(f"v{k}"), F.when(F.exists(there, lambda v: ~v), there).alias(f"m{k}")]
    return found.select(F.lit(f"{a}-{b}").alias("raster"), "chunk_row", "chunk_col", "row0", "col0", "h", "w", *out)


def with_area(chunked: DataFrame, area: DataFrame, size: int = 32) -> DataFrame:
    """Chunks with the strips (sx, cy, bits) of an area that lie in them, as `area`; empty where it has none there."""
    first = lambda add: F.floor((F.col("sx") * 64 + add) / size)
    met = area.select("sx", "cy", "bits", F.floor(F.col("cy") / size).alias("chunk_row"), F.explode(F.sequence(first(0), first(63))).alias("chunk_col"))
    listed = met.groupBy("chunk_row", "chunk_col").agg(F.collect_list(F.struct(F.col("sx").cast("bigint").alias("sx"), F.col("cy").cast("bigint").alias("cy"), "bits")).alias("area"))
    joined = chunked.join(listed, ["chunk_row", "chunk_col"], "left")
    return joined.withColumn("area", F.coalesce("area", F.array().cast(listed.schema["area"].dataType)))


def predict(windows: DataFrame, chunked: DataFrame, size: int, make: Callable[[], Predictor]) -> DataFrame:
    """Windows (raster, index, y0, y1, x0, x1) over paired chunks of `size`: PATCH rows, one for each window.

    Each window names the chunks that it touches, meets them by an equi-join, and is put together whole before the predictor
    sees it; `make` is called once in a worker process for each call of predict(). Chunks and pixels that aren't there leave
    their part of the masks off, also of a window without any chunk. Where chunks have an `area`, patches are off outside it."""
    token = uuid.uuid4().hex
    n_bands = 0
    if chunked.schema["v1"].dataType.simpleString() == "array<array<double>>":
        first = chunked.select(F.size("v1").alias("n")).first()
        n_bands = first.n if first else 1
    has_area = "area" in chunked.columns

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows.iloc[0]
        tile = {c: head[c] if c == "raster" else int(head[c]) for c in ("raster", "index", "y0", "y1", "x0", "x1")}
        h, w = tile["y1"] - tile["y0"], tile["x1"] - tile["x0"]
        values = {c: np.zeros((n_bands, h, w) if n_bands else (h, w)) for c in ("v1", "v2")}
        masks = {c: np.zeros((h, w), bool) for c in ("m1", "m2")}
        area = np.zeros((h, w), bool)
        for c in rows[rows.row0.notna()].itertuples(index=False):
            row0, col0, ch, cw = int(c.row0), int(c.col0), int(c.h), int(c.w)
            top, bottom = max(tile["y0"], row0), min(tile["y1"], row0 + ch)
            left, right = max(tile["x0"], col0), min(tile["x1"], col0 + cw)
            if has_area:
                for s in c.area:
                    if tile["y0"] <= s["cy"] < tile["y1"]:
                        on = np.flatnonzero(np.unpackbits(np.array([s["bits"]], "<i8").view(np.uint8), bitorder="little")) + s["sx"] * 64 - tile["x0"]
                        area[s["cy"] - tile["y0"], on[(on >= 0) & (on < w)]] = True
            if top >= bottom or left >= right:
                continue
            source = slice(top - row0, bottom - row0), slice(left - col0, right - col0)
            target = slice(top - tile["y0"], bottom - tile["y0"]), slice(left - tile["x0"], right - tile["x0"])
            for name, whole in values.items():
                found = getattr(c, name)
                part = np.array([np.asarray(x, float) for x in found] if n_bands else found, float).reshape((n_bands, ch, cw) if n_bands else (ch, cw))
                whole[(..., *target)] = np.nan_to_num(part[(..., *source)])
            for name, whole in masks.items():
                found = getattr(c, name)
                whole[target] = True if found is None else np.asarray(found, bool).reshape(ch, cw)[source]
        both = (masks["m1"], masks["m2"], area) if has_area else (masks["m1"], masks["m2"])
        p, mask, told = _made(token, make)(tile, values["v1"], values["v2"], both)
        mask = np.asarray(mask, bool) & np.logical_and.reduce(both)
        return pd.DataFrame([(tile["raster"], tile["index"], tile["y0"], tile["x0"], h, w, np.asarray(p, float).ravel(), mask.ravel(), {k: str(v) for k, v in told.items()})], columns=[f.split()[0] for f in PATCH.split(", ", 8)])

    span = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / size), F.floor((F.col(high) - 1) / size)))
    wanted = windows.select("raster", "index", "y0", "y1", "x0", "x1").withColumn("chunk_row", span("y0", "y1")).withColumn("chunk_col", span("x0", "x1"))
    return wanted.join(chunked, ["raster", "chunk_row", "chunk_col"], "left").groupBy("raster", "index").applyInPandas(run, PATCH)


def mosaic(patches: DataFrame, size: int) -> DataFrame:
    """PATCH rows laid over one another in the order of their index, the last one's values staying: chunks (raster, chunk_row,
    chunk_col, row0, col0, h, w, p, mask, writes). Patches are cut at the chunks' borders and only arrays are exchanged."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch.itertuples(index=False):
                p, mask = np.asarray(t.p).reshape(t.h, t.w), np.asarray(t.mask).reshape(t.h, t.w)
                for r in range(t.y0 // size, (t.y0 + t.h - 1) // size + 1):
                    for c in range(t.x0 // size, (t.x0 + t.w - 1) // size + 1):
                        rows = slice(max(0, r * size - t.y0), min(t.h, (r + 1) * size - t.y0))
                        cols = slice(max(0, c * size - t.x0), min(t.w, (c + 1) * size - t.x0))
                        part = p[rows, cols]
                        out.append((t.raster, r, c, t.index, t.y0 + rows.start, t.x0 + cols.start, *part.shape, part.ravel(), mask[rows, cols].ravel()))
            yield pd.DataFrame(out, columns=["raster", "chunk_row", "chunk_col", "index", "y0", "x0", "h", "w", "p", "mask"])

    def lay(parts: pd.DataFrame) -> pd.DataFrame:
        row0, col0 = int(parts.y0.min()), int(parts.x0.min())
        shape = int((parts.y0 + parts.h).max()) - row0, int((parts.x0 + parts.w).max()) - col0
        p, mask, writes = np.full(shape, np.nan), np.zeros(shape, bool), np.zeros(shape, int)
        for t in parts.sort_values("index").itertuples(index=False):
            at = slice(t.y0 - row0, t.y0 - row0 + t.h), slice(t.x0 - col0, t.x0 - col0 + t.w)
            p[at], mask[at] = np.reshape(t.p, (t.h, t.w)), np.reshape(t.mask, (t.h, t.w))
            writes[at] += 1
        first = parts.iloc[0]
        return pd.DataFrame([(first.raster, first.chunk_row, first.chunk_col, row0, col0, *shape, p.ravel(), mask.ravel(), writes.ravel())], columns=["raster", "chunk_row", "chunk_col", "row0", "col0", "h", "w", "p", "mask", "writes"])

    place = "raster string, chunk_row bigint, chunk_col bigint"
    parts = patches.mapInPandas(cut, f"{place}, index bigint, y0 bigint, x0 bigint, h bigint, w bigint, p array<double>, mask array<boolean>")
    return parts.groupBy("raster", "chunk_row", "chunk_col").applyInPandas(lay, f"{place}, row0 bigint, col0 bigint, h bigint, w bigint, p array<double>, mask array<boolean>, writes array<bigint>")


def mosaic_pixels(chunked: DataFrame) -> DataFrame:
    """(raster, row, col, p, mask, writes) of a mosaic, without what no patch has written."""
    zipped = F.posexplode(F.arrays_zip("p", "mask", "writes")).alias("k", "v")
    rows = chunked.select("raster", "row0", "col0", "w", zipped).where("v.writes > 0")
    return rows.select("raster", (F.col("row0") + F.floor(F.col("k") / F.col("w"))).alias("row"), (F.col("col0") + F.col("k") % F.col("w")).alias("col"), "v.*")


def tile_regions(mask: DataFrame, size: int) -> DataFrame:
    """mask: (raster, row, col, p). Regions within tiles of `size`, not joined across their borders: (raster, tile_row, tile_col,
    label, pixels, extent), and mean_probability, which is over the tile's whole mask and not the region's."""
    cells = to_cells(mask)
    found = label_chunks(cells, ["raster"], size).withColumn("label", F.col("ny") * (1 << 31) + F.col("nx"))
    extent = [f(c).alias(n) for f, c, n in ((F.min, "cy", "row0"), (F.max, "cy", "row1"), (F.min, "cx", "col0"), (F.max, "cx", "col1"))]
    regions_ = found.groupBy("raster", "by", "bx", "label").agg(F.count("*").alias("pixels"), *extent)
    tile = cells.groupBy("raster", F.floor(F.col("cy") / size).alias("by"), F.floor(F.col("cx") / size).alias("bx")).agg(F.avg("p").alias("mean_probability"))
    return regions_.join(tile, ["raster", "by", "bx"]).withColumnsRenamed({"by": "tile_row", "bx": "tile_col"})


def tile_polygons(mask: DataFrame, size: int) -> DataFrame:
    """tile_regions() with each region's polygon: `rings`, its closed rings, the outer one first, in pixels."""
    place = ["raster", "tile_row", "tile_col"]
    found = label_chunks(to_cells(mask), ["raster"], size).withColumn("label", F.col("ny") * (1 << 31) + F.col("nx"))
    labelled = found.select("raster", F.col("by").alias("tile_row"), F.col("bx").alias("tile_col"), "label", F.col("cx").alias("col"), F.col("cy").alias("row"))
    rings = outlines(labelled, place).groupBy(*place, "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda r: r.points).alias("rings"))
    return tile_regions(mask, size).join(rings, [*place, "label"])


def resample(pixels: DataFrame, scale: float, nearest: bool) -> DataFrame:
    """Values on a grid whose pixels are `scale` source pixels wide and that ends where each raster does: the nearest source
    pixel, or the weighted mean of those of four that are there.

    Each source pixel says itself which pixels it has a share in, so that no grid is written out; what is joined is a row for
    each raster."""
    sizes = pixels.groupBy("raster").agg(F.floor((F.max("row") + 1) / scale).cast("bigint").alias("_h"), F.floor((F.max("col") + 1) / scale).cast("bigint").alias("_w"))

    reach = 0.5 if nearest else 1.0  # of a place beyond the source pixel's middle

    def dealt(rows: DataFrame, source: str, limit: str) -> DataFrame:
        """Along one axis: rows with the pixel (_k_source) that they have a share in, and its weight."""
        s, k = F.col(source), F.col(f"_k_{source}")
        first = F.greatest(F.floor((s - reach + 0.5) / scale - 0.5), F.lit(0).cast("bigint"))
        last = F.least(F.ceil((s + reach + 0.5) / scale - 0.5), F.col(limit) - 1)
        rows = rows.where(last >= first).withColumn(f"_k_{source}", F.explode(F.sequence(first, last)))
        place = (k + 0.5) * scale - 0.5
        weight = F.when(F.floor(place + 0.5) == s, 1.0) if nearest else F.when(F.floor(place) == s, 1 - (place - F.floor(place))).when(F.floor(place) + 1 == s, place - F.floor(place))
        return rows.withColumn(f"_w_{source}", weight).where(F.col(f"_w_{source}") > 0)

    shared = dealt(dealt(pixels.join(F.broadcast(sizes), "raster"), "row", "_h"), "col", "_w")
    weight = F.col("_w_row") * F.col("_w_col")
    return shared.groupBy("raster", F.col("_k_row").alias("row"), F.col("_k_col").alias("col")).agg((F.sum(F.col("p") * weight) / F.sum(weight)).alias("p"))
