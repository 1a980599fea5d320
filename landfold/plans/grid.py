"""Queries of the tile grid and projections."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from landfold.functions import grid as G
from landfold.plans.base import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle

#: Points of the queries: degrees from order keys.
LONLAT = "(SELECT o_orderkey AS id, CAST((o_orderkey * 37) % 3600 AS DOUBLE) / 10 - 180 AS lon, CAST((o_orderkey * 53) % 1600 AS DOUBLE) / 10 - 80 AS lat, CAST(8 + o_orderkey % 8 AS INT) AS z FROM orders)"
FRACTION = "(lon + 180) / 360 * pow(2.0, z) AS tx, (1 - ln(tan(radians({lat})) + 1 / cos(radians({lat}))) / pi()) / 2 * pow(2.0, z) AS ty"


def points(s):
    return s.orders.selectExpr("o_orderkey AS id", "CAST((o_orderkey * 37) % 3600 AS DOUBLE) / 10 - 180 AS lon", "CAST((o_orderkey * 53) % 1600 AS DOUBLE) / 10 - 80 AS lat", "CAST(8 + o_orderkey % 8 AS INT) AS z")


def rounded(c, n: int = 6):
    return F.round(c, n)


@R.add("fn01_tile_fraction", f"SELECT id, round(tx, 5) AS tx, round(ty, 5) AS ty FROM (SELECT id, {FRACTION.format(lat='lat')} FROM {LONLAT})")
def fn01(s):
    x, y = G.tile_fraction("lon", "lat", "z")
    return points(s).select("id", rounded(x, 5).alias("tx"), rounded(y, 5).alias("ty"))


@R.add("fn02_tile_range", f"""SELECT id, CAST(floor(x0) AS BIGINT) AS x_min, CAST(floor(x1) AS BIGINT) AS x_max, CAST(floor(y0) AS BIGINT) AS y_min, CAST(floor(y1) AS BIGINT) AS y_max, CAST((floor(x1) - floor(x0) + 1) * (floor(y1) - floor(y0) + 1) AS BIGINT) AS n_tiles
    FROM (SELECT id, (lon + 180) / 360 * pow(2.0, z) AS x0, (lon + 0.33 + 180) / 360 * pow(2.0, z) AS x1, (1 - ln(tan(radians(lat + 0.21)) + 1 / cos(radians(lat + 0.21))) / pi()) / 2 * pow(2.0, z) AS y0, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * pow(2.0, z) AS y1 FROM (SELECT id, lon + 0.01 AS lon, lat + 0.013 AS lat, z FROM {LONLAT}))""")
def fn02(s):
    p = points(s).selectExpr("id", "lon + 0.01 AS lon", "lat + 0.013 AS lat", "z")
    p = p.withColumn("t", G.tile_range(F.col("lon"), F.col("lat"), F.col("lon") + 0.33, F.col("lat") + 0.21, "z"))
    return p.select("id", "t.*", G.tile_count(F.col("t")).alias("n_tiles"))


@R.add("fn03_tile_bounds_mercator", f"""SELECT event_id, round(x * s - {G.HALF_SPAN}, 4) AS minx, round({G.HALF_SPAN} - (y + 1) * s, 4) AS miny, round((x + 1) * s - {G.HALF_SPAN}, 4) AS maxx, round({G.HALF_SPAN} - y * s, 4) AS maxy
    FROM (SELECT *, {2 * G.HALF_SPAN} / pow(2.0, z) AS s FROM v_tile_check)""")
def fn03(s):
    b = s.v_tile_check.withColumn("b", G.tile_bounds_mercator("z", "x", "y"))
    return b.select("event_id", *[rounded(F.col(f"b.{k}"), 4).alias(k) for k in ("minx", "miny", "maxx", "maxy")])


@R.add("fn04_tile_span", f"SELECT event_id, round({2 * G.HALF_SPAN} / pow(2.0, z), 4) AS span, round(x * {2 * G.HALF_SPAN} / pow(2.0, z) - {G.HALF_SPAN}, 4) AS minx FROM v_tile_check")
def fn04(s):
    b = G.tile_bounds_mercator("z", "x", "y")
    return s.v_tile_check.select("event_id", rounded(b.maxx - b.minx, 4).alias("span"), rounded(b.minx, 4).alias("minx"))


@R.add("fn06_scene_tile_count", "SELECT release, sum((x % 7 + 1) * (y % 5 + 1))::BIGINT AS tiles FROM v_tile_check GROUP BY release")
def fn06(s):
    span = F.struct(F.col("x").alias("x_min"), (F.col("x") + F.col("x") % 7).alias("x_max"), F.col("y").alias("y_min"), (F.col("y") + F.col("y") % 5).alias("y_max"))
    return s.v_tile_check.withColumn("span", span).groupBy("release").agg(F.sum(G.tile_count(F.col("span"))).alias("tiles"))


@R.add("fn05_tile_bounds_degrees", """SELECT event_id, round(x / n * 360 - 180, 6) AS minx, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / n)))), 6) AS miny, round((x + 1) / n * 360 - 180, 6) AS maxx, round(degrees(atan(sinh(pi() * (1 - 2 * y / n)))), 6) AS maxy
    FROM (SELECT *, pow(2.0, z) AS n FROM v_tile_check)""")
def fn05(s):
    b = s.v_tile_check.withColumn("b", G.tile_bounds_degrees("z", "x", "y"))
    return b.select("event_id", *[rounded(F.col(f"b.{k}")).alias(k) for k in ("minx", "miny", "maxx", "maxy")])


@R.add("fn07_pixel_size", f"SELECT event_id, round({2 * G.HALF_SPAN} / pow(2.0, z) / 256, 6) AS size, round(greatest(0.01, pow({2 * G.HALF_SPAN} / pow(2.0, z) / 256, 2)), 4) AS area FROM v_tile_check")
def fn07(s):
    return s.v_tile_check.select("event_id", rounded(G.pixel_size("z")).alias("size"), rounded(G.pixel_area("z"), 4).alias("area"))


@R.add("fn08_sliding_positions", """SELECT id, unnest(list_sort(list_distinct(CASE WHEN len <= 64 THEN [0] ELSE list_concat(range(0, len - 63, 48), [len - 64]) END))) AS start FROM (SELECT o_orderkey AS id, 40 + o_orderkey % 300 AS len FROM orders)""")
def fn08(s):
    rows = s.orders.selectExpr("o_orderkey AS id", "40 + o_orderkey % 300 AS len")
    return rows.select("id", F.explode(G.sliding_positions("len", 64, 48)).alias("start"))


RASTERS = "SELECT c_custkey AS raster, 500 + c_custkey % 700 AS width, 300 + c_custkey % 500 AS height, 256 AS size, 32 AS margin FROM customer"


@R.add("fn10_inference_tiles", f"""WITH r AS ({RASTERS}), o AS (SELECT *, list_sort(list_distinct(list_concat(list_filter(range(0, width, size - 2 * margin), lambda v: v + size < width), [greatest(0, width - size)]))) AS xs, list_sort(list_distinct(list_concat(list_filter(range(0, height, size - 2 * margin), lambda v: v + size < height), [greatest(0, height - size)]))) AS ys FROM r),
    y AS (SELECT *, unnest(ys) AS y0, generate_subscripts(ys, 1) - 1 AS i FROM o), x AS (SELECT *, unnest(xs) AS x0, generate_subscripts(xs, 1) - 1 AS j FROM y)
    SELECT raster, i * len(xs) + j AS index, y0, least(y0 + size, height) AS y1, x0, least(x0 + size, width) AS x1 FROM x""")
def fn10(s):
    rasters = s.customer.selectExpr("c_custkey AS raster", "500 + c_custkey % 700 AS width", "300 + c_custkey % 500 AS height", "256L AS size")
    return G.windows(rasters, lambda c: G.inference_offsets(c, F.col("size"), 32), "size")


@R.add("fn09_patch_windows", f"""WITH r AS ({RASTERS}), o AS (SELECT *, list_sort(list_distinct(list_concat(range(0, width - size + 1, 192), [width - size]))) AS xs, list_sort(list_distinct(list_concat(range(0, height - size + 1, 192), [height - size]))) AS ys FROM r)
    SELECT raster, len(xs) * len(ys) AS n_patches, list_max(xs) AS last_x, list_max(ys) AS last_y FROM o""")
def fn09(s):
    rasters = s.customer.selectExpr("c_custkey AS raster", "500 + c_custkey % 700 AS width", "300 + c_custkey % 500 AS height", "256L AS size")
    w = G.windows(rasters, lambda c: G.sliding_positions(c, F.col("size"), 192), "size")
    return w.groupBy("raster").agg(F.count("*").alias("n_patches"), F.max("x0").alias("last_x"), F.max("y0").alias("last_y"))


@R.add("fn11_slide_crops", "SELECT id, unnest(list_transform(range(0, CAST(greatest(ceil((len - 100) / 60.0), 0) AS BIGINT) + 1), lambda k: greatest(0, least(k * 60, len - 100)))) AS start FROM (SELECT o_orderkey AS id, 90 + o_orderkey % 400 AS len FROM orders)")
def fn11(s):
    rows = s.orders.selectExpr("o_orderkey AS id", "90 + o_orderkey % 400 AS len")
    return rows.select("id", F.explode(G.slide_crops("len", 100, 60)).alias("start"))


@R.add("fn12_utm_zone", f"SELECT id, CAST((CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END) + least(floor((lon + 180) / 6) + 1, 60) AS INT) AS epsg FROM {LONLAT}")
def fn12(s):
    return points(s).select("id", G.utm_epsg("lon", "lat").alias("epsg"))


@R.add("fn13_web_mercator", f"""SELECT id, round(x, 3) AS x, round(y, 3) AS y, round(x / {G.HALF_SPAN} * 180, 6) AS lon, round(degrees(2 * atan(exp(y / {G.HALF_SPAN} * pi())) - pi() / 2), 6) AS lat
    FROM (SELECT id, lon / 180 * {G.HALF_SPAN} AS x, ln(tan(pi() / 4 + radians(lat) / 2)) / pi() * {G.HALF_SPAN} AS y FROM {LONLAT})""")
def fn13(s):
    x, y = G.project_mercator("lon", "lat")
    p = points(s).select("id", x.alias("x"), y.alias("y"))
    lon, lat = G.unproject_mercator("x", "y")
    return p.select("id", rounded(F.col("x"), 3).alias("x"), rounded(F.col("y"), 3).alias("y"), rounded(lon).alias("lon"), rounded(lat).alias("lat"))


def _utm_sql() -> str:
    """East and north by the same series, about the point's own zone."""
    sums = lambda first, second: " + ".join(f"{f!r}::DOUBLE * {first}({2 * k} * xi) * {second}({2 * k} * eta)" for k, f in enumerate(G.UTM_FORWARD, 1))
    e = math.sqrt(1 / 298.257223563 * (2 - 1 / 298.257223563))
    return f"""z AS (SELECT id, lon, lat, least(floor((lon + 180) / 6) + 1, 60) AS zone, sin(radians(lat)) AS s FROM {LONLAT}), t AS (SELECT *, radians(lon - (zone * 6 - 183)) AS away, sinh(atanh(s) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * s)) AS t FROM z),
        p AS (SELECT *, atan2(t, cos(away)) AS xi, asinh(sin(away) / sqrt(t * t + cos(away) * cos(away))) AS eta FROM t)
        SELECT id, CAST(CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END + zone AS INT) AS epsg, round(500000 + {G.UTM_RADIUS!r}::DOUBLE * (eta + {sums('cos', 'sinh')}), 3) AS x, round({G.UTM_RADIUS!r}::DOUBLE * (xi + {sums('sin', 'cosh')}) + CASE WHEN lat >= 0 THEN 0 ELSE 10000000 END, 3) AS y, round(lon, 7) AS lon, round(lat, 7) AS lat FROM p"""


@R.add("fn13_utm", f"WITH {_utm_sql()}")
def fn13_utm(s):
    """Degrees to each point's UTM zone, and back."""
    p = points(s).where("abs(lat) < 89").withColumn("epsg", G.utm_epsg("lon", "lat"))
    x, y = G.reproject("lon", "lat", F.lit(4326), "epsg")
    p = p.select("id", "epsg", x.alias("x"), y.alias("y"))
    lon, lat = G.reproject("x", "y", "epsg", F.lit(4326))
    return p.select("id", "epsg", rounded(F.col("x"), 3).alias("x"), rounded(F.col("y"), 3).alias("y"), rounded(lon, 7).alias("lon"), rounded(lat, 7).alias("lat"))


@R.add("fn14_zoom_range", f"SELECT event_id, CAST(greatest(0, least(22, round(log2({2 * G.HALF_SPAN / 256} / (value + 0.013))))) AS INT) AS zoom FROM v_tile_check")
def fn14(s):
    return s.v_tile_check.select("event_id", G.zoom_for(F.col("value") + 0.013).cast("int").alias("zoom"))


@R.add("fn16_tile_validity", "SELECT event_id, x - 200 >= 0 AND x - 200 < pow(2.0, z - 4) AND y >= 0 AND y < pow(2.0, z - 4) AS valid FROM v_tile_check")
def fn16(s):
    return s.v_tile_check.select("event_id", G.is_tile(F.col("z") - 4, F.col("x") - 200, F.col("y")).alias("valid"))


@R.add("fn18_export_crs", f"SELECT id, CASE WHEN lon BETWEEN -17.5 AND -0.5 AND lat BETWEEN 20.0 AND 36.5 THEN 32629 ELSE CAST((CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END) + least(floor((lon + 180) / 6) + 1, 60) AS INT) END AS epsg FROM {LONLAT}")
def fn18(s):
    """A fixed zone inside a box of degrees, elsewhere the point's own."""
    inside = F.col("lon").between(-17.5, -0.5) & F.col("lat").between(20.0, 36.5)
    return points(s).select("id", F.when(inside, F.lit(32629)).otherwise(G.utm_epsg("lon", "lat")).alias("epsg"))


@R.add("fn20_min_object_pixels", "SELECT o_orderkey AS id, CAST(greatest(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 END, CASE WHEN o_orderkey % 3 = 1 THEN ceil(o_orderkey % 50 / 2.25) END, 4), 1) AS BIGINT) AS pixels FROM orders")
def fn20(s):
    return s.orders.select(F.col("o_orderkey").alias("id"), G.min_object_pixels(F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 END"), F.expr("CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey % 50 END"), F.lit(2.25), 4).alias("pixels"))


@R.add("join01_tiles_in_area", "SELECT z, x, y, count(*) AS n FROM v_tile_check WHERE x BETWEEN 100 AND 420 AND y BETWEEN 50 AND 700 AND (x - 100) * 2 <= (y - 50) GROUP BY z, x, y")
def join01(s):
    """Tiles whose box meets the area: first the box, then the area's edge."""
    inside = F.col("x").between(100, 420) & F.col("y").between(50, 700)
    return s.v_tile_check.where(inside).where("(x - 100) * 2 <= (y - 50)").groupBy("z", "x", "y").agg(F.count("*").alias("n"))
