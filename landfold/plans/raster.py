"""Queries of raster operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from landfold.functions import grid
from landfold.functions.geometry import cell_area_sql, ring_length, signed_area
from landfold.operators import raster as P
from landfold.operators import strips as S
from landfold.operators.graph import numbered
from landfold.plans.base import Registry
from landfold.plans.growth import SIZE

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle
#: What two dates of a raster are.
PAIR = {"release_t1": "t1", "release_t2": "t2", "date_t1": "2020-01-01", "date_t2": "2021-01-01"}
#: Columns of a raster; its rows grow with the table.
WIDTH = 64
_T1 = "(SELECT row, col, p FROM v_pixel WHERE raster = 't1')"
_BOTH = "bo AS (SELECT row, col, max(CASE WHEN raster = 't1' THEN p END) AS p1, max(CASE WHEN raster = 't2' THEN p END) AS p2 FROM v_pixel GROUP BY row, col)"
_MASK = "m AS (SELECT row, col FROM v_pixel WHERE raster = 't1' AND p >= 0.62)"
#: Components by a recursive walk.
_LABEL = "m AS (SELECT row, col FROM v_pixel WHERE raster = 't1' AND p >= 0.68), walk(row, col, label) AS (SELECT row, col, row * 2147483648 + col FROM m UNION SELECT m.row, m.col, label FROM walk w, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(dy, dx), m WHERE m.row = w.row + dy AND m.col = w.col + dx), lab AS (SELECT row, col, min(label)::BIGINT AS label FROM walk GROUP BY row, col)"


def t1(s):
    return s.v_pixel.where("raster = 't1'")


def mask(s, t: float = 0.62):
    return t1(s).where(F.col("p") >= t).select("row", "col")


def labelled(s):
    return P.label_mask(mask(s, 0.68))


def chunk_sql(inner: str) -> str:
    return f"SELECT raster, CAST(floor(row / 32) AS BIGINT) AS chunk_row, CAST(floor(col / 32) AS BIGINT) AS chunk_col, {inner} FROM v_pixel GROUP BY ALL"


@R.add("ras_chunks", chunk_sql("min(row) AS row0, min(col) AS col0, max(row) - min(row) + 1 AS h, max(col) - min(col) + 1 AS w, count(*) AS n, round(sum(p), 6) AS total, round(arg_max(p, (row, col)), 6) AS last"))
def chunked(s):
    found = P.chunks(s.v_pixel)
    return found.select("raster", "chunk_row", "chunk_col", "row0", "col0", "h", "w", F.size("values").cast("bigint").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.element_at("values", -1), 6).alias("last"))


@R.add("flt01_threshold", "SELECT raster, row, col FROM v_pixel WHERE p >= 0.62 AND (row + col) % 9 <> 0")
def flt01(s):
    """Chunk arrays against a threshold and a validity mask, then the pixels that pass."""
    c = P.chunks(s.v_pixel)
    at = lambda k: (F.col("row0") + F.floor(k / F.col("w")) + F.col("col0") + k % F.col("w")) % 9 != 0
    c = c.withColumn("valid", F.transform("values", lambda v, k: at(k))).withColumn("values", P.threshold("values", "valid", 0.62))
    return P.pixels_of(c).where("p").drop("p")


@R.add("ras01_dilation", f"WITH {_MASK} SELECT DISTINCT row + dy AS row, col + dx AS col FROM m, range(-2, 3) a(dx), range(-2, 3) b(dy) WHERE row + dy BETWEEN 0 AND (SELECT max(row) FROM v_pixel) AND col + dx BETWEEN 0 AND {WIDTH - 1}")
def ras01(s):
    grown = P.dilate_mask(mask(s), 2).where(F.col("col").between(0, WIDTH - 1) & (F.col("row") >= 0))
    return grown.join(F.broadcast(s.v_pixel.agg(F.max("row").alias("last"))), F.col("row") <= F.col("last")).drop("last")


@R.add("ras02_components", f"WITH RECURSIVE {_LABEL} SELECT row, col, label FROM lab")
def ras02(s):
    return labelled(s)


@R.add("ras03_small_components", f"WITH RECURSIVE {_LABEL} SELECT label, count(*) AS pixels, dense_rank() OVER (ORDER BY label) AS region FROM lab GROUP BY label HAVING count(*) >= 3")
def ras03(s):
    kept = P.large_components(labelled(s), 3).groupBy("label").agg(F.count("*").alias("pixels"))
    return numbered(kept, ["label"], "region")


@R.add("ras04_edge_suppression", f"WITH RECURSIVE {_LABEL}, ref AS (SELECT row, col FROM v_pixel WHERE raster = 't2' AND p >= 0.85), near AS (SELECT DISTINCT row + dy AS row, col + dx AS col FROM ref, range(-2, 3) a(dx), range(-2, 3) b(dy) WHERE dx * dx + dy * dy < 4), far AS (SELECT label, count(*) AS n FROM lab ANTI JOIN near USING (row, col) GROUP BY label HAVING count(*) >= 2) SELECT row, col, label FROM lab SEMI JOIN far USING (label)")
def ras04(s):
    ref = s.v_pixel.where("raster = 't2' AND p >= 0.85").select("row", "col")
    return P.far_components(labelled(s), ref, 2, 2).select("row", "col", "label")


@R.add("ras05_probability_gain", f"WITH {_BOTH} SELECT row, col, round(greatest(0, least(1, p2 - p1)), 9) AS gain FROM bo")
def ras05(s):
    c = P.chunks(s.v_pixel).drop("h")
    a, b = (c.where(F.col("raster") == r).select("chunk_row", "chunk_col", "row0", "col0", "w", F.col("values").alias(k)) for r, k in (("t1", "v1"), ("t2", "v2")))
    both = a.join(b.select("chunk_row", "chunk_col", "v2"), ["chunk_row", "chunk_col"]).withColumns({"values": P.probability_gain("v1", "v2"), "raster": F.lit("gain")})
    return P.pixels_of(both).select("row", "col", F.round("p", 9).alias("gain"))


@R.add("flt02_new_objects", f"WITH {_BOTH}, old AS (SELECT DISTINCT row + dy AS row, col + dx AS col FROM bo, range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE p1 >= 0.55) SELECT row, col FROM bo ANTI JOIN old USING (row, col) WHERE p2 - p1 >= 0.2 AND p2 >= 0.55")
def flt02(s):
    both = P.pair(s.v_pixel).withColumn("change", F.col("p2") - F.col("p1"))
    return P.new_objects(both, "change", 0.2, 0.55, 1)


@R.add("flt03_area_mask", f"WITH {_BOTH}, n AS (SELECT count(*) FILTER (WHERE col BETWEEN 10 AND 40) AS inside FROM bo) SELECT row, col, round(CASE WHEN inside = 0 OR col BETWEEN 10 AND 40 THEN p1 ELSE 0 END, 9) AS p1 FROM bo, n")
def flt03(s):
    """The area's mask on the data; an area that covers no pixel leaves them as they are."""
    both = P.pair(s.v_pixel)
    inside = F.col("col").between(10, 40)
    total = F.broadcast(both.agg(F.count_if(inside).alias("inside")))
    return both.crossJoin(total).select("row", "col", F.round(F.when((F.col("inside") == 0) | F.col("col").between(10, 40), F.col("p1")).otherwise(0.0), 9).alias("p1"))


@R.add("flt04_crop_skip", "SELECT raster, band, CASE WHEN inside = 0 THEN 'outside_aoi' WHEN valid = 0 THEN 'no_valid_paired' WHEN valid / n < 0.5 THEN 'low_valid' END AS reason, round(inside / n, 6) AS aoi_ratio, round(valid / n, 6) AS valid_ratio FROM (SELECT raster, CAST(floor(row / 8) AS BIGINT) AS band, count(*) AS n, count(*) FILTER (WHERE (row // 8) % 5 <> 0) AS inside, count(*) FILTER (WHERE p > 0.5) AS valid FROM v_pixel GROUP BY ALL)")
def flt04(s):
    band = F.floor(F.col("row") / 8)
    w = s.v_pixel.withColumn("band", band).groupBy("raster", "band").agg(F.count("*").alias("n"), F.count_if(F.floor(F.col("row") / 8) % 5 != 0).alias("inside"), F.count_if(F.col("p") > 0.5).alias("valid"))
    reason = F.when(F.col("inside") == 0, "outside_aoi").when(F.col("valid") == 0, "no_valid_paired").when(F.col("valid") / F.col("n") < 0.5, "low_valid")
    return w.select("raster", "band", reason.alias("reason"), F.round(F.col("inside") / F.col("n"), 6).alias("aoi_ratio"), F.round(F.col("valid") / F.col("n"), 6).alias("valid_ratio"))


@R.add("ras06_difference_predictor", f"WITH {_BOTH} SELECT row, col, round((abs(floor(p2 * 255) - floor(p1 * 255)) + abs(floor(p2 * 200) - floor(p1 * 200)) + abs(floor(p2 * 100) - floor(p1 * 100))) / 3 / 255, 6) AS p FROM bo")
def ras06(s):
    """Mean absolute difference of three bands over 255: a deterministic stand-in for a model."""
    both = P.pair(s.v_pixel)
    bands = [F.abs(F.floor(F.col("p2") * k) - F.floor(F.col("p1") * k)) for k in (255, 200, 100)]
    return both.select("row", "col", F.round((bands[0] + bands[1] + bands[2]) / 3 / 255, 6).alias("p"))


@R.add("ras07_synthetic_predictor", f"WITH w AS (SELECT raster, unnest(range(0, n // 16)) AS k FROM (SELECT raster, max(row) + 1 AS n FROM v_pixel GROUP BY raster)) SELECT raster, k AS index, k * 16 + 4 AS row0, k * 16 + 11 AS row1 FROM w WHERE k % 3 = 0")
def ras07(s):
    """A square in every third window."""
    w = s.v_pixel.groupBy("raster").agg(F.floor((F.max("row") + 1) / 16).alias("n")).where("n > 0").select("raster", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("index"))
    return w.where("index % 3 = 0").select("raster", "index", (F.col("index") * 16 + 4).alias("row0"), (F.col("index") * 16 + 11).alias("row1"))


def _rising() -> P.Predictor:
    """The query's model: what the second date has more, and a hundredth of the window's number; on where that is over 0.3."""

    def predictor(tile, t1, t2, masks):
        p = np.clip(t2 - t1, 0, 1) + tile["index"] % 10 / 100
        return p, p >= 0.3, {"pixels": int((masks[0] & masks[1]).sum())}

    return predictor


_WINDOWS = f"""{_BOTH}, h AS (SELECT max(row) + 1 AS height FROM bo), o AS (SELECT *, list_sort(list_distinct(list_concat(list_filter(range(0, height, 24), lambda v: v + 32 < height), [greatest(0, height - 32)]))) AS ys FROM h),
    y AS (SELECT *, unnest(ys) AS y0, generate_subscripts(ys, 1) - 1 AS i FROM o), w AS (SELECT i * 3 + j AS index, y0, x0 FROM y, (VALUES (0, 0), (1, 24), (2, 32)) x(j, x0)), pr AS (SELECT index, row, col, greatest(0, least(1, p2 - p1)) + (index % 10) / 100.0 AS q FROM bo JOIN w ON row >= y0 AND row < y0 + 32 AND col >= x0 AND col < x0 + 32)"""


@R.add("ras08_tiled_prediction", f"WITH {_WINDOWS} SELECT row, col, round(arg_max(q, index), 6) AS p, arg_max(q, index) >= 0.3 AS mask, count(*) AS writes FROM pr GROUP BY row, col")
def ras08(s):
    """Overlapping windows of both dates: the last window's value stays, while statistics count overlaps as often as they
    come."""
    patches = P.predict(windows(s), P.paired_chunks(s.v_pixel), 32, _rising)
    return P.mosaic_pixels(P.mosaic(patches, 32)).select("row", "col", F.round("p", 6).alias("p"), "mask", "writes")


@R.add("udf01_patch_predictor", f"WITH {_WINDOWS} SELECT index, min(row) AS y0, min(col) AS x0, count(*) AS pixels, count(*) FILTER (WHERE q >= 0.3) AS mask_pixels, round(sum(q), 4) AS total FROM pr GROUP BY index")
def udf01(s):
    """What the model says of each window, whole: its place, pixels and metadata."""
    found = P.predict(windows(s), P.paired_chunks(s.v_pixel), 32, _rising)
    total = F.aggregate("p", F.lit(0.0), lambda t, x: t + x)
    return found.select("index", "y0", "x0", F.col("metadata")["pixels"].cast("bigint").alias("pixels"), F.size(F.filter("mask", lambda m: m)).cast("bigint").alias("mask_pixels"), F.round(total, 4).alias("total"))


#: Three bands of each date, the third missing where the column is a multiple of 7; an area of slanted polygons.
_BANDS = {"r": "p", "g": "1 - p", "b": "CASE WHEN col % 7 <> 0 THEN p * p END"}
_BAND_SQL = ", ".join(f"{e} AS {c}" for c, e in _BANDS.items())


def _mean_gain() -> P.Predictor:
    """The query's model of three bands: the mean gain, on inside the area and where both dates have all bands."""

    def predictor(tile, t1, t2, masks):
        p = np.clip(t2 - t1, 0, 1).mean(axis=0)
        return p, p >= 0.05, {"bands": len(t1), "area": int(masks[2].sum())}

    return predictor


_AREA_SQL = "a AS (SELECT (row + col) % 64 < 40 AND row % 50 < 45 AS inside, row, col FROM (SELECT DISTINCT row, col FROM v_pixel))"


@R.add("udf01_band_predictor", f"WITH {_WINDOWS}, {_AREA_SQL}, v AS (SELECT raster, row, col, {_BAND_SQL} FROM v_pixel), two AS (SELECT row, col, {', '.join(f'max(CASE WHEN raster = {r!r} THEN {c} END) AS {c}{k}' for k, r in ((1, 't1'), (2, 't2')) for c in _BANDS)} FROM v GROUP BY row, col), g AS (SELECT row, col, (greatest(0, least(1, r2 - r1)) + greatest(0, least(1, g2 - g1)) + greatest(0, least(1, coalesce(b2, 0) - coalesce(b1, 0)))) / 3 AS q, b1 IS NOT NULL AND b2 IS NOT NULL AS valid FROM two) SELECT index, '3' AS bands, count(*) FILTER (WHERE inside) AS area_pixels, count(*) FILTER (WHERE inside AND valid AND q >= 0.05) AS mask_pixels FROM w JOIN g ON row >= y0 AND row < y0 + 32 AND col >= x0 AND col < x0 + 32 JOIN a USING (row, col) GROUP BY index")
def udf01_bands(s):
    """Windows of three bands, with the missing ones masked, inside an area given as packed strips."""
    px = s.v_pixel.select("raster", "row", "col", *[F.expr(e).alias(c) for c, e in _BANDS.items()])
    places = s.v_pixel.select(F.col("col").alias("cx"), F.col("row").alias("cy")).distinct()
    area = S.of_cells(places.where("(cy + cx) % 64 < 40 AND cy % 50 < 45"), [])
    chunked = P.with_area(P.paired_chunks(px, bands=tuple(_BANDS)), area)
    found = P.predict(windows(s), chunked, 32, _mean_gain)
    return found.select("index", F.col("metadata")["bands"].alias("bands"), F.col("metadata")["area"].cast("bigint").alias("area_pixels"), F.size(F.filter("mask", lambda m: m)).cast("bigint").alias("mask_pixels"))


@R.add("src07_band_chunks", f"SELECT raster, row // 32 AS chunk_row, col // 32 AS chunk_col, round(sum(r), 6) AS r, round(sum(g), 6) AS g, round(sum(b), 6) AS b, CASE WHEN count(*) FILTER (WHERE b IS NULL) > 0 THEN count(b) END AS valid FROM (SELECT raster, row, col, p AS r, 1 - p AS g, CASE WHEN col >= 32 OR col % 7 <> 0 THEN p * p END AS b FROM v_pixel) GROUP BY ALL")
def src07_bands(s):
    """Chunks of three bands with a packed mask of validity, which is NULL where all pixels are valid."""
    third = F.expr("CASE WHEN col >= 32 OR col % 7 <> 0 THEN p * p END")
    c = P.chunks(s.v_pixel.select("raster", "row", "col", F.col("p").alias("r"), (1 - F.col("p")).alias("g"), third.alias("b")), bands=("r", "g", "b"))
    total = lambda k: F.round(F.aggregate(F.col("values")[k], F.lit(0.0), lambda t, x: t + F.coalesce(x, F.lit(0.0))), 6)
    bits = F.aggregate("valid", F.lit(0).cast("bigint"), lambda t, x: t + F.bit_count(x).cast("bigint"))
    return c.select("raster", "chunk_row", "chunk_col", total(0).alias("r"), total(1).alias("g"), total(2).alias("b"), bits.alias("valid"))


def windows(s):
    height = s.v_pixel.agg((F.max("row") + 1).alias("height"), F.lit(WIDTH).cast("bigint").alias("width"))
    headers = height.withColumns({"raster": F.lit("t1-t2"), "size": F.lit(32).cast("bigint")})
    return grid.windows(headers, lambda c: grid.inference_offsets(c, F.col("size"), 4), "size")


@R.add("ras10_rasterise", f"SELECT project, cx AS col, cy AS row FROM (SELECT DISTINCT project, cx, unnest(range(CAST(ceil(miny / 20.0 - 0.5) AS BIGINT), CAST(ceil(maxy / 20.0 - 0.5) AS BIGINT))) AS cy FROM (SELECT *, unnest(range(CAST(ceil(minx / 20.0 - 0.5) AS BIGINT), CAST(ceil(maxx / 20.0 - 0.5) AS BIGINT))) AS cx FROM v_feature))")
def ras10(s):
    """Features to a mask, a pixel being on where its centre is inside."""
    from landfold.operators.cells import cells_of_boxes

    return P.to_pixels(cells_of_boxes(s.v_feature, ["project"], 2 * SIZE).distinct())


@R.add("ras11_vectorise", f"""WITH RECURSIVE {_LABEL} SELECT row_number() OVER (ORDER BY label) AS region_id, label, count(*) AS pixels, round(sum({cell_area_sql('row', SIZE)}), 2) AS area_m2, round(avg(p), 6) AS mean_p, round(max(p), 6) AS max_p, min(row) AS row0, max(row) AS row1, min(col) AS col0, max(col) AS col1, round(avg(col) + 0.5, 6) AS centre_x, round(avg(row) + 0.5, 6) AS centre_y,
    't1' AS release_t1, 't2' AS release_t2, '2020-01-01' AS date_t1, '2021-01-01' AS date_t2 FROM lab JOIN {_T1} USING (row, col) GROUP BY label""")
def ras11(s):
    """Regions with their numbers, sizes, probabilities, and the releases and dates compared."""
    found = numbered(P.regions(labelled(s), t1(s), SIZE), ["label"], "region_id").withColumns({c: F.lit(v) for c, v in PAIR.items()})
    return found.withColumns({"area_m2": F.round("area_m2", 2), **{c: F.round(c, 6) for c in ("mean_p", "max_p", "centre_x", "centre_y")}})


@R.add("ras11_outlines", f"""WITH RECURSIVE {_LABEL} SELECT label, CAST(sum(4 - (SELECT count(*) FROM lab b WHERE b.label = a.label AND abs(a.row - b.row) + abs(a.col - b.col) = 1)) AS DOUBLE) AS perimeter, CAST(count(*) AS DOUBLE) AS area FROM lab a GROUP BY label""")
def ras11_outlines(s):
    """Rings of each region, measured: the length of all rings, and the area within them, holes taken off."""
    rings = P.outlines(labelled(s))
    n = F.size("points")
    seg = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.struct(F.col("points")[k - 1].alias("a"), F.col("points")[k].alias("b")))
    length = F.aggregate(seg, F.lit(0.0), lambda t, e: t + F.abs(e.a.x - e.b.x) + F.abs(e.a.y - e.b.y))
    twice = F.aggregate(seg, F.lit(0.0), lambda t, e: t + e.a.x * e.b.y - e.b.x * e.a.y)
    return rings.groupBy("label").agg(F.sum(length).alias("perimeter"), F.sum(twice / 2).alias("area"))


@R.add("ras12_tile_vectorise", """WITH RECURSIVE m AS (SELECT raster, row // 32 AS tile_row, col // 32 AS tile_col, row, col, p FROM v_pixel WHERE p >= 0.68), walk(raster, tile_row, tile_col, row, col, label) AS (SELECT raster, tile_row, tile_col, row, col, row * 2147483648 + col FROM m
    UNION SELECT m.raster, m.tile_row, m.tile_col, m.row, m.col, label FROM walk w, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(dy, dx), m WHERE m.raster = w.raster AND m.tile_row = w.tile_row AND m.tile_col = w.tile_col AND m.row = w.row + dy AND m.col = w.col + dx),
    lab AS (SELECT raster, tile_row, tile_col, row, col, min(label)::BIGINT AS label FROM walk GROUP BY ALL), t AS (SELECT raster, tile_row, tile_col, avg(p) AS mean_p FROM m GROUP BY ALL)
    SELECT raster, tile_row, tile_col, label, count(*) AS pixels, min(row) AS row0, max(row) AS row1, min(col) AS col0, max(col) AS col1, round(any_value(mean_p), 6) AS mean_probability FROM lab JOIN t USING (raster, tile_row, tile_col) GROUP BY raster, tile_row, tile_col, label""")
def ras12(s):
    """One feature for each region of each tile, with the mean over the tile's whole mask; regions end at the tile's border."""
    return P.tile_regions(s.v_pixel.where("p >= 0.68"), 32).withColumn("mean_probability", F.round("mean_probability", 6))


#: Components within tiles by a recursive walk.
_TILE_LABEL = """WITH RECURSIVE m AS (SELECT raster, row // 32 AS tile_row, col // 32 AS tile_col, row, col, p FROM v_pixel WHERE p >= 0.68), walk(raster, tile_row, tile_col, row, col, label) AS (SELECT raster, tile_row, tile_col, row, col, row * 2147483648 + col FROM m
    UNION SELECT m.raster, m.tile_row, m.tile_col, m.row, m.col, label FROM walk w, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(dy, dx), m WHERE m.raster = w.raster AND m.tile_row = w.tile_row AND m.tile_col = w.tile_col AND m.row = w.row + dy AND m.col = w.col + dx),
    lab AS (SELECT raster, tile_row, tile_col, row, col, min(label)::BIGINT AS label FROM walk GROUP BY ALL)"""


@R.add("ras12_tile_polygons", f"{_TILE_LABEL} SELECT raster, tile_row, tile_col, label, CAST(count(*) AS DOUBLE) AS area, CAST(sum(4 - (SELECT count(*) FROM lab b WHERE b.raster = a.raster AND b.tile_row = a.tile_row AND b.tile_col = a.tile_col AND b.label = a.label AND abs(a.row - b.row) + abs(a.col - b.col) = 1)) AS DOUBLE) AS perimeter, min(row) AS row0 FROM lab a GROUP BY ALL")
def ras12_polygons(s):
    """Polygons of the tiles' regions, measured: area within the rings, holes taken off, and the length of all rings."""
    found = P.tile_polygons(s.v_pixel.where("p >= 0.68"), 32)
    total = lambda f: F.aggregate("rings", F.lit(0.0), lambda t, r: t + f(r))
    return found.select("raster", "tile_row", "tile_col", "label", total(signed_area).alias("area"), total(ring_length).alias("perimeter"), "row0")


@R.add("ras13_mosaic", "SELECT release, z, x, y, (x - x0) * 256 AS col0, (y - y0) * 256 AS row0, n FROM (SELECT release, z, x, y, count(*) AS n FROM v_tile_check WHERE status = 'available' GROUP BY ALL) JOIN (SELECT release, z, min(x) AS x0, min(y) AS y0 FROM v_tile_check GROUP BY release, z) USING (release, z)")
def ras13(s):
    """Places of available tiles in their mosaic; missing ones leave holes. The chunk table is the mosaic."""
    tiles = s.v_tile_check
    origin = tiles.groupBy("release", "z").agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    there = tiles.where("status = 'available'").groupBy("release", "z", "x", "y").agg(F.count("*").alias("n"))
    return there.join(origin, ["release", "z"]).select("release", "z", "x", "y", ((F.col("x") - F.col("x0")) * 256).alias("col0"), ((F.col("y") - F.col("y0")) * 256).alias("row0"), "n")


_SIZES = "SELECT raster, max(row) + 1 AS height FROM v_pixel GROUP BY raster"


@R.add("ras14_resample", f"SELECT raster, row // 2 AS row, col // 2 AS col, round(avg(p), 6) AS p FROM v_pixel JOIN ({_SIZES}) USING (raster) WHERE row < height // 2 * 2 GROUP BY ALL")
def ras14(s):
    """Bilinear to pixels twice as wide: the mean of four."""
    return P.resample(s.v_pixel, 2.0, nearest=False).withColumn("p", F.round("p", 6))


@R.add("ras14_resample_nearest", f"SELECT raster, (row - 1) // 3 AS row, (col - 1) // 3 AS col FROM v_pixel JOIN ({_SIZES}) USING (raster) WHERE row % 3 = 1 AND col % 3 = 1 AND row < height // 3 * 3 AND col < {WIDTH} // 3 * 3 AND p > 0.5")
def ras14_nearest(s):
    return P.resample(s.v_pixel, 3.0, nearest=True).where("p > 0.5").drop("p")


@R.add("ras16_padding_alpha", "SELECT raster, row, col, floor(p * 255) % 7 <> 0 OR floor(p * 100) % 5 <> 0 AS opaque FROM v_pixel")
def ras16(s):
    """Opaque where any band differs from 0."""
    bands = F.array(F.floor(F.col("p") * 255) % 7, F.floor(F.col("p") * 100) % 5)
    return s.v_pixel.select("raster", "row", "col", F.exists(bands, lambda b: b != 0).alias("opaque"))


@R.add("ras18_window_activity", "SELECT raster, count(*) AS windows, count(*) FILTER (WHERE active) AS nonzero, count(*) FILTER (WHERE lower_half) AS lower_half, count(*) FILTER (WHERE lower_half AND active) AS lower_nonzero FROM (SELECT raster, row // 8 AS w, bool_or(p > 0.95) AS active, (row // 8) % 2 = 1 AS lower_half FROM v_pixel GROUP BY ALL) GROUP BY raster")
def ras18(s):
    w = s.v_pixel.withColumn("w", F.floor(F.col("row") / 8)).groupBy("raster", "w").agg(F.bool_or(F.col("p") > 0.95).alias("active")).withColumn("lower", F.col("w") % 2 == 1)
    return w.groupBy("raster").agg(F.count("*").alias("windows"), F.count_if("active").alias("nonzero"), F.count_if("lower").alias("lower_half"), F.count_if(F.col("lower") & F.col("active")).alias("lower_nonzero"))


@R.add("ras19_pixel_audit", "SELECT raster, round(100.0 * count(*) FILTER (WHERE p < 0.05) / greatest(count(*), 1), 4) AS black, round(100.0 * count(*) FILTER (WHERE p < 0.05 AND col % 2 = 0) / greatest(count(*), 1), 4) AS black_valid, round(100.0 * count(*) FILTER (WHERE col % 2 = 0) / greatest(count(*), 1), 4) AS valid FROM v_pixel WHERE col BETWEEN 4 AND 59 GROUP BY raster")
def ras19(s):
    inside = s.v_pixel.where(F.col("col").between(4, 59))
    share = lambda c: F.round(100.0 * F.count_if(c) / F.greatest(F.count("*"), F.lit(1)), 4)
    black, valid = F.col("p") < 0.05, F.col("col") % 2 == 0
    return inside.groupBy("raster").agg(share(black).alias("black"), share(black & valid).alias("black_valid"), share(valid).alias("valid"))


@R.add("ras20_alpha_audit", "SELECT raster, min(m)::BIGINT AS least, max(m)::BIGINT AS most, count(*) FILTER (WHERE m = 0) AS zero, count(*) FILTER (WHERE m = 255) AS full, count(*) FILTER (WHERE m = 255 AND p < 0.05) AS black_valid, count(*) FILTER (WHERE m NOT IN (0, 255)) = 0 AND count(*) FILTER (WHERE m = 255 AND p < 0.05) = 0 AS passed FROM (SELECT raster, p, CASE WHEN p >= 0.1 THEN 255 ELSE 0 END AS m FROM v_pixel) GROUP BY raster")
def ras20(s):
    m = F.when(F.col("p") >= 0.1, 255).otherwise(0).cast("bigint")
    a = s.v_pixel.withColumn("m", m).groupBy("raster").agg(F.min("m").alias("least"), F.max("m").alias("most"), F.count_if(F.col("m") == 0).alias("zero"), F.count_if(F.col("m") == 255).alias("full"), F.count_if((F.col("m") == 255) & (F.col("p") < 0.05)).alias("black_valid"), F.count_if(~F.col("m").isin(0, 255)).alias("_odd"))
    return a.withColumn("passed", (F.col("_odd") == 0) & (F.col("black_valid") == 0)).drop("_odd")


@R.add("ras21_grid_comparison", f"WITH {_BOTH} SELECT row // 32 AS band, round(max(abs(p1 - p2)), 6) AS most, round(avg(abs(p1 - p2)), 6) AS mean, count(*) FILTER (WHERE (p1 >= 0.6) <> (p2 >= 0.6)) AS mismatches FROM bo GROUP BY band")
def ras21(s):
    d = F.abs(F.col("p1") - F.col("p2"))
    return P.pair(s.v_pixel).groupBy(F.floor(F.col("row") / 32).alias("band")).agg(F.round(F.max(d), 6).alias("most"), F.round(F.avg(d), 6).alias("mean"), F.count_if((F.col("p1") >= 0.6) != (F.col("p2") >= 0.6)).alias("mismatches"))


@R.add("src07_window_scan", "SELECT raster, row, col, round(p, 9) AS p, p > 0.5 AS mask FROM v_pixel WHERE row BETWEEN 8 AND 23 AND col BETWEEN 16 AND 47")
def src07(s):
    """A window read from chunks: chunks that it touches, then the pixels inside."""
    c = P.chunks(s.v_pixel).where((F.col("row0") <= 23) & (F.col("row0") + F.col("h") > 8) & (F.col("col0") <= 47) & (F.col("col0") + F.col("w") > 16))
    px = P.pixels_of(c).where(F.col("row").between(8, 23) & F.col("col").between(16, 47))
    return px.select("raster", "row", "col", F.round("p", 9).alias("p"), (F.col("p") > 0.5).alias("mask"))


_HEADER = "SELECT raster, max(row) + 1 AS height, max(col) + 1 AS width, CASE raster WHEN 't1' THEN 'EPSG:3857' ELSE 'EPSG:32629' END AS crs, CASE raster WHEN 't1' THEN [10.0, 0.0, 0.0, 0.0, -10.0, 1000.0] ELSE [10.0, 0.0, 0.0, 0.0, -10.0, 1000.0 + min(row)] END AS transform FROM v_pixel WHERE raster = 't1' OR row > 0 GROUP BY raster"


@R.add("src08_aligned_pair", f"WITH h AS ({_HEADER}) SELECT list_filter([CASE WHEN a.height <> b.height THEN 'height' END, CASE WHEN a.width <> b.width THEN 'width' END, CASE WHEN a.crs <> b.crs THEN 'crs' END, CASE WHEN a.transform <> b.transform THEN 'transform' END], lambda x: x IS NOT NULL) AS mismatches FROM (SELECT * FROM h WHERE raster = 't1') a, (SELECT * FROM h WHERE raster = 't2') b")
def src08(s):
    """Two rasters' headers: what they don't agree in; the second one here begins a row later and is in another system."""
    first = F.col("raster") == "t1"
    shift = F.when(first, F.lit(1000.0)).otherwise(1000.0 + F.min("row"))
    transform = F.array(*[F.lit(v) for v in (10.0, 0.0, 0.0, 0.0, -10.0)], shift)
    h = s.v_pixel.where("raster = 't1' OR row > 0").groupBy("raster").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"), transform.alias("transform")).withColumn("crs", F.when(first, "EPSG:3857").otherwise("EPSG:32629"))
    return P.aligned(h, "t1", "t2").select("mismatches")
