"""Queries of geometry functions on rings."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landfold.functions import geometry as G
from landfold.operators.timeline import stable_id
from landfold.plans.base import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.oracle
#: A quadrilateral about each feature's box, with one corner pulled in, so that it isn't a box itself.
QUAD = "(minx, miny), (maxx, miny), (maxx - (maxx - minx) * 0.25, maxy), (minx, maxy)"


#: Levels of the tile pyramid of the plane: tiles of so many metres.
LEVELS = {1: 512, 2: 256, 3: 128}
AREA_OF_A_UNIT = math.radians(1 / G.PLANE_SCALE) / 2 * G.SEMI_MAJOR**2


def authalic_sql(y: str) -> str:
    return G.authalic_sql(f"sin(radians({y} / {G.PLANE_SCALE}.0::DOUBLE + {G.PLANE_LAT}))")


def feature_tiles(boxes):
    """Quadrilaterals of boxes under the tiles (z, tx, ty) that they share a part of, with that part as `cut`."""
    levels = F.explode(F.array(*[F.struct(F.lit(z).alias("z"), F.lit(m).cast("bigint").alias("size")) for z, m in LEVELS.items()]))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / F.col("size")), F.floor(F.col(b) / F.col("size"))))
    t = with_quads(boxes).withColumn("level", levels).select("*", "level.*").drop("level").withColumn("tx", span("minx", "maxx")).withColumn("ty", span("miny", "maxy"))
    box = [F.col("tx") * F.col("size"), F.col("ty") * F.col("size"), (F.col("tx") + 1) * F.col("size"), (F.col("ty") + 1) * F.col("size")]
    t = t.where((F.col("minx") < box[2]) & (F.col("miny") < box[3]) & (F.col("maxx") > box[0]) & (F.col("maxy") > box[1]))  # others share no area
    whole = (F.col("minx") >= box[0]) & (F.col("miny") >= box[1]) & (F.col("maxx") <= box[2]) & (F.col("maxy") <= box[3])
    # Nothing to clip; the area is above 0 where the box's is, a test that costs nothing wherever the planner puts it.
    inner = t.where(whole & (F.col("minx") < F.col("maxx")) & (F.col("miny") < F.col("maxy"))).withColumnRenamed("ring", "cut")
    parts = t.where(~whole).withColumn("_cut", G.clipped_to("ring", *box)).where("_cut.area > 0").withColumn("cut", F.col("_cut.ring")).drop("ring", "_cut")
    return inner.unionByName(parts)


def with_quads(boxes):
    a, b, c, d = (F.col(v) for v in ("minx", "miny", "maxx", "maxy"))
    return boxes.withColumn("ring", G.ring_from([(a, b), (c, b), (c - (c - a) * 0.25, d), (a, d), (a, b)]))


def quads(s):
    return with_quads(s.v_feature)


@R.add("fn22_planar_measures", """SELECT feature_id, (w + w * 0.75) / 2 * h AS area, round(minx + (w * w + w * 0.75 * w + 0.75 * w * 0.75 * w) / (3 * (w + 0.75 * w)), 6) AS cx, round(miny + h * (w + 2 * 0.75 * w) / (3 * (w + 0.75 * w)), 6) AS cy, round(w + 0.75 * w + h + sqrt(0.0625 * w * w + h * h), 6) AS perimeter FROM (SELECT *, CAST(maxx - minx AS DOUBLE) AS w, CAST(maxy - miny AS DOUBLE) AS h FROM v_feature)""")
def fn22(s):
    c = G.centroid("ring")
    return quads(s).select("feature_id", G.signed_area("ring").alias("area"), F.round(c.x, 6).alias("cx"), F.round(c.y, 6).alias("cy"), F.round(G.ring_length("ring"), 6).alias("perimeter"))


@R.add("fn22_bounds", "SELECT feature_id, CAST(minx AS DOUBLE) AS minx, CAST(miny AS DOUBLE) AS miny, CAST(maxx AS DOUBLE) AS maxx, CAST(maxy AS DOUBLE) AS maxy FROM v_feature")
def fn22_bounds(s):
    return quads(s).withColumn("b", G.bounds("ring")).select("feature_id", "b.*")


@R.add("fn23_orientation", "SELECT feature_id, true AS ccw, CASE WHEN feature_id % 2 = 0 THEN 1 ELSE -1 END AS was FROM v_feature")
def fn23(s):
    q = quads(s).withColumn("ring", F.when(F.col("feature_id") % 2 == 0, F.col("ring")).otherwise(F.reverse("ring")))
    fixed = q.withColumn("fixed", G.oriented("ring"))
    return fixed.select("feature_id", (G.signed_area("fixed") > 0).alias("ccw"), F.signum(G.signed_area("ring")).cast("int").alias("was"))


@R.add("fn21_geodesic_area", f"SELECT feature_id, round(abs({authalic_sql('maxy')} - {authalic_sql('miny')}) * (maxx - minx) * {AREA_OF_A_UNIT!r}::DOUBLE, 2) AS area FROM v_feature")
def fn21(s):
    """Metres become degrees about a fixed point; areas on the ellipsoid. The twin is the closed form for boxes."""
    boxes = s.v_feature.withColumn("ring", F.transform(G.box_ring("minx", "miny", "maxx", "maxy"), lambda p: F.struct((p.x / G.PLANE_SCALE + G.PLANE_LON).alias("x"), (p.y / G.PLANE_SCALE + G.PLANE_LAT).alias("y"))))
    return boxes.select("feature_id", F.round(G.geodesic_area_of("ring"), 2).alias("area"))


@R.add("fn24_thinness", "SELECT feature_id, round(least(maxx - minx, maxy - miny) / greatest(maxx - minx, maxy - miny), 6) AS thin FROM v_feature")
def fn24(s):
    """Boxes turned aslant: their smallest rectangle isn't that of their bounds."""
    turned = F.transform(G.box_ring("minx", "miny", "maxx", "maxy"), lambda p: F.struct((p.x * 0.6 - p.y * 0.8).alias("x"), (p.x * 0.8 + p.y * 0.6).alias("y")))
    return s.v_feature.withColumn("ring", turned).select("feature_id", F.round(G.thinness_of("ring"), 6).alias("thin"))


def holed(s):
    """A hole of 2 x 2 in every third feature's box, of 4 x 4 in every fifth."""
    a, b = F.col("minx"), F.col("miny")
    hole = lambda n: G.ring_from([(a + 1, b + 1), (a + 1, b + 1 + n), (a + 1 + n, b + 1 + n), (a + 1 + n, b + 1), (a + 1, b + 1)])
    outer = F.array(G.box_ring("minx", "miny", "maxx", "maxy"))
    rings = F.concat(outer, F.when(F.col("feature_id") % 3 == 0, F.array(hole(2))).otherwise(F.array().cast(G.POLYGON)), F.when(F.col("feature_id") % 5 == 0, F.array(hole(4))).otherwise(F.array().cast(G.POLYGON)))
    return s.v_feature.withColumn("polygon", rings)


_HOLES = "CASE WHEN feature_id % 3 = 0 THEN 4 ELSE 0 END"
_BIG = "CASE WHEN feature_id % 5 = 0 THEN 16 ELSE 0 END"
_BOX = "CAST((maxx - minx) * (maxy - miny) AS DOUBLE)"


@R.add("fn25_remove_holes", f"SELECT feature_id, {_BOX} AS area FROM v_feature")
def fn25(s):
    p = holed(s).withColumn("polygons", F.array("polygon")).withColumn("parts", G.without_holes("polygons"))
    return p.select("feature_id", F.explode("parts").alias("part")).withColumn("area", G.polygon_area("part")).where("area > 0").select("feature_id", "area")


@R.add("fn26_fill_small_holes", f"SELECT feature_id, {_BOX} - ({_BIG}) AS area FROM v_feature")
def fn26(s):
    return holed(s).withColumn("filled", G.fill_small_holes("polygon", 10.0)).select("feature_id", G.polygon_area("filled").alias("area"))


@R.add("fn27_has_holes", "SELECT feature_id, feature_id % 3 = 0 OR feature_id % 5 = 0 AS holes FROM v_feature")
def fn27(s):
    return holed(s).withColumn("polygons", F.array("polygon")).select("feature_id", G.has_holes("polygons").alias("holes"))


@R.add("fn28_part_count", "SELECT project, release, count(*) AS parts FROM v_feature GROUP BY project, release")
def fn28(s):
    """Parts of multi-polygons, counted without gathering them."""
    parts = holed(s).withColumn("polygons", F.array("polygon"))
    return parts.groupBy("project", "release").agg(F.sum(F.size("polygons")).cast("bigint").alias("parts"))


@R.add("fn29_clip_rectangle", """WITH q AS (SELECT feature_id, greatest(minx, 1000) AS l, greatest(miny, 1000)::DOUBLE AS a, least(maxy, 2000)::DOUBLE AS b, maxx, miny, (maxx - minx) * 0.25::DOUBLE / (maxy - miny) AS k FROM v_feature WHERE minx < 2000 AND maxy > 1000 AND miny < 2000 AND maxx > 1000),
    y AS (SELECT *, greatest(a, least(b, miny + (maxx - 2000) / k)) AS u, greatest(a, least(b, miny + (maxx - l) / k)) AS v FROM q) SELECT feature_id, round((2000 - l) * (u - a) + (v - u) * ((maxx - k * (u - miny) - l) + (maxx - k * (v - miny) - l)) / 2, 6) AS area FROM y WHERE (2000 - l) * (u - a) + (v - u) * ((maxx - k * (u - miny) - l) + (maxx - k * (v - miny) - l)) / 2 > 0""")
def fn29(s):
    """Quadrilaterals with an aslant side, clipped to a box."""
    near = quads(s).where("maxx > 1000 AND minx < 2000 AND maxy > 1000 AND miny < 2000")
    return near.withColumn("c", G.clipped_ring("ring", (1000, 1000, 2000, 2000))).select("feature_id", F.round(G.signed_area("c"), 6).alias("area")).where("area > 0")


@R.add("fn29_clip_parts", "SELECT feature_id, CASE WHEN feature_id % 2 = 0 THEN 2 ELSE 1 END AS parts, CASE WHEN feature_id % 2 = 0 THEN 0 ELSE 1 END AS holes, round(CASE WHEN feature_id % 2 = 0 THEN 2 * 0.25e0 * 0.5e0 ELSE 0.8e0 - 0.04e0 END * (1 + feature_id % 9) * (1 + feature_id % 7), 6) AS area FROM v_feature")
def fn29_parts(s):
    """Cuts to a box: a U on its feet has two parts left above its floor, a square keeps the hole that the cut misses."""
    w, h = 1 + F.col("feature_id") % 9, 1 + F.col("feature_id") % 7
    ring = lambda corners: G.ring_from([(w * x, h * (y - 0.5)) for x, y in corners])
    u = ring([(0, 0), (1, 0), (1, 1), (0.75, 1), (0.75, 0.25), (0.25, 0.25), (0.25, 1), (0, 1), (0, 0)])
    square, hole = ring([(0, 0.3), (1, 0.3), (1, 1.3), (0, 1.3), (0, 0.3)]), ring([(0.4, 0.8), (0.6, 0.8), (0.6, 1), (0.4, 1), (0.4, 0.8)])
    f = s.v_feature.select("feature_id", F.when(F.col("feature_id") % 2 == 0, F.array(u)).otherwise(F.array(square, hole)).alias("rings"))
    f = f.withColumn("parts", G.clipped_parts("rings", (-100.0, 0.0, 100.0, 100.0)))
    area = F.aggregate("parts", F.lit(0.0), lambda t, p: t + F.aggregate(p, F.lit(0.0), lambda v, r: v + G.signed_area(r)))
    holes = F.aggregate("parts", F.lit(0), lambda t, p: t + F.size(p) - 1)
    return f.select("feature_id", F.size("parts").alias("parts"), holes.alias("holes"), F.round(area, 6).alias("area"))


@R.add("fn34_simplify", "SELECT feature_id, CAST(5 AS BIGINT) AS points FROM v_feature")
def fn34(s):
    """Points on a side go, corners stay."""
    a, b, c, d = (F.col(v) for v in ("minx", "miny", "maxx", "maxy"))
    ring = G.ring_from([(a, b), ((a + c) / 2, b), (c, b), (c, (b + d) / 2), (c, d), (a, d), (a, b)])
    return s.v_feature.withColumn("ring", ring).withColumn("t", G.simplified_ring("ring", 0.5)).select("feature_id", F.size("t").cast("bigint").alias("points"))


@R.add("fn35_coordinate_rounding", "SELECT feature_id, list_sort(list_distinct([round(minx / 7.0, 3), round(maxx / 7.0, 3)])) AS xs FROM v_feature")
def fn35(s):
    ring = F.transform(G.box_ring("minx", "miny", "maxx", "maxy"), lambda p: F.struct((p.x / 7).alias("x"), (p.y / 7).alias("y")))
    return s.v_feature.withColumn("ring", ring).select("feature_id", F.array_sort(F.array_distinct(F.transform(G.rounded("ring", 3), lambda p: p.x))).alias("xs"))


@R.add("fn36_canonical_keys", """SELECT feature_id, substr(sha256('{"layer":"' || layer || '","minx":' || CAST(minx AS VARCHAR) || ',"project":' || CAST(project AS VARCHAR) || '}'), 1, 24) AS key FROM v_feature""")
def fn36(s):
    """SHA-256 of JSON with sorted keys, its first 24 digits."""
    return s.v_feature.select("feature_id", F.substring(F.sha2(F.to_json(F.struct("layer", "minx", "project")), 256), 1, 24).alias("key"))


@R.add("fn37_geometry_hash", "SELECT project, sha256(string_agg(CAST(minx AS VARCHAR) || ',' || CAST(miny AS VARCHAR), ';' ORDER BY minx, miny, feature_id)) AS hash FROM v_feature WHERE layer = 'blocks' GROUP BY project")
def fn37(s):
    """Over coordinates in an order that doesn't depend on the rows'."""
    point = F.struct("minx", "miny", "feature_id")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(point)), lambda p: F.concat_ws(",", p.minx.cast("string"), p.miny.cast("string"))), ";")
    return s.v_feature.where("layer = 'blocks'").groupBy("project").agg(F.sha2(text, 256).alias("hash"))


@R.add("fn38_quantise", "SELECT feature_id, CAST(greatest(0, least(999, round(minx / 4.0))) AS BIGINT) AS qx, CAST(greatest(0, least(999, round(miny / 4.0))) AS BIGINT) AS qy FROM v_feature")
def fn38(s):
    boxes = s.v_feature.withColumn("ring", G.box_ring("minx", "miny", "maxx", "maxy"))
    q = boxes.withColumn("q", G.quantised("ring", F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(4.0), 999))
    return q.select("feature_id", F.col("q")[0].x.alias("qx"), F.col("q")[0].y.alias("qy"))


@R.add("fn39_delta_rings", "SELECT feature_id, CAST(minx AS BIGINT) AS x0, maxx - minx AS dx, maxy - miny AS dy, CAST(5 AS BIGINT) AS n FROM v_feature")
def fn39(s):
    boxes = s.v_feature.withColumn("ring", G.box_ring("minx", "miny", "maxx", "maxy"))
    q = boxes.withColumn("q", G.quantised("ring", F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), 100000))
    d = q.withColumn("d", G.deltas(F.col("q")))
    return d.select("feature_id", F.col("d")[0].x.alias("x0"), F.col("d")[1].x.alias("dx"), F.col("d")[2].y.alias("dy"), F.size("d").cast("bigint").alias("n"))


@R.add("fn40_arc_indexes", "SELECT project, feature_id, ring_no, row_number() OVER (PARTITION BY project ORDER BY release, feature_id, ring_no) - 1 AS arc FROM (SELECT *, unnest(range(1 + CASE WHEN feature_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN feature_id % 5 = 0 THEN 1 ELSE 0 END)) AS ring_no FROM v_feature)")
def fn40(s):
    """All rings, holes too, numbered within their project."""
    rings = holed(s).select("project", "release", "feature_id", F.posexplode("polygon").alias("ring_no", "ring"))
    return rings.select("project", "feature_id", F.col("ring_no").cast("bigint").alias("ring_no"), (F.row_number().over(W.partitionBy("project").orderBy("release", "feature_id", "ring_no")) - 1).cast("bigint").alias("arc"))


@R.add("snk05_topology_table", """WITH f AS (SELECT *, year(release_date) AS y FROM v_feature WHERE layer <> 'blocks'), w AS (SELECT project, min(minx)::DOUBLE AS x0, min(miny)::DOUBLE AS y0, (max(maxx) - min(minx)) / 9999.0::DOUBLE AS sx, (max(maxy) - min(miny)) / 9999.0::DOUBLE AS sy FROM f GROUP BY project),
    q AS (SELECT f.*, w.x0, w.y0, w.sx, w.sy, round((minx - x0) / sx)::BIGINT AS a, round((miny - y0) / sy)::BIGINT AS b, round((maxx - x0) / sx)::BIGINT AS c, round((maxy - y0) / sy)::BIGINT AS d FROM f JOIN w USING (project))
    SELECT feature_id, CAST(y AS VARCHAR) || '-' || layer || '-' || lpad(CAST(row_number() OVER (PARTITION BY project, y, layer ORDER BY release, feature_id) AS VARCHAR), 6, '0') AS id, row_number() OVER (PARTITION BY project ORDER BY release, feature_id) - 1 AS arc,
    a || ',' || b || ' ' || (c - a) || ',0 0,' || (d - b) || ' ' || (a - c) || ',0 0,' || (b - d) AS deltas, release, strftime(release_date, '%Y-%m-%d') AS day, layer, round((maxx - minx) * (maxy - miny) / 10000.0, 4) AS area_ha, x0 AS translate_x, y0 AS translate_y, round(sx, 9) AS scale_x, round(sy, 9) AS scale_y FROM q""")
def snk05(s):
    """Shared topology: stable ids, properties, and each ring as an arc of whole-number deltas on its project's grid of 10,000
    steps, with the grid's scale and origin."""
    f = s.v_feature.where("layer <> 'blocks'").withColumn("ring", G.box_ring("minx", "miny", "maxx", "maxy"))
    x, y = (((F.max(f"max{v}") - F.min(f"min{v}")) / 9999).alias(f"scale_{v}") for v in "xy")
    frame = f.groupBy("project").agg(F.min("minx").cast("double").alias("translate_x"), F.min("miny").cast("double").alias("translate_y"), x, y)
    # A frame for each project: joined as any table is, broadcast by Spark where it is small.
    q = f.join(frame, "project").withColumn("arc_ring", G.quantised("ring", F.col("translate_x"), F.col("translate_y"), F.col("scale_x"), F.col("scale_y"), 9999))
    deltas = F.array_join(F.transform(G.deltas(F.col("arc_ring")), lambda p: F.concat_ws(",", p.x.cast("string"), p.y.cast("string"))), " ")
    arc = (F.row_number().over(W.partitionBy("project").orderBy("release", "feature_id")) - 1).cast("bigint")
    return q.select("feature_id", stable_id(["project"], F.year("release_date"), "layer", ["release", "feature_id"]).alias("id"), arc.alias("arc"), deltas.alias("deltas"), "release", F.date_format("release_date", "yyyy-MM-dd").alias("day"), "layer", F.round(G.signed_area("ring") / 10000, 4).alias("area_ha"),
                    "translate_x", "translate_y", F.round("scale_x", 9).alias("scale_x"), F.round("scale_y", 9).alias("scale_y"))


@R.add("fn41_box_polygon", "SELECT feature_id, CAST((maxx - minx) * (maxy - miny) AS DOUBLE) AS area, CAST(5 AS BIGINT) AS points FROM v_feature")
def fn41(s):
    b = s.v_feature.withColumn("ring", G.box_ring("minx", "miny", "maxx", "maxy"))
    return b.select("feature_id", G.signed_area("ring").alias("area"), F.size("ring").cast("bigint").alias("points"))


@R.add("fn43_geometry_family", "SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'point' WHEN 1 THEN 'point' WHEN 2 THEN 'line' WHEN 3 THEN 'line' ELSE 'polygon' END AS family FROM orders")
def fn43(s):
    kind = F.element_at(F.array(*[F.lit(k) for k in ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    family = F.when(kind.endswith("Point"), "point").when(kind.endswith("LineString"), "line").when(kind.endswith("Polygon"), "polygon").otherwise("mixed")
    return s.orders.select(F.col("o_orderkey").alias("id"), family.alias("family"))


@R.add("join04_hole_assignment", "SELECT a.feature_id AS hole, min(b.feature_id) AS outer_id FROM v_feature a JOIN v_feature b ON a.project = b.project AND b.layer = 'effective' AND a.layer = 'additions' AND a.minx + 1 > b.minx AND a.minx + 1 < b.maxx AND a.miny + 1 > b.miny AND a.miny + 1 < b.maxy GROUP BY a.feature_id")
def join04(s):
    """A hole belongs to the outer ring that contains its representative point. Boxes alike stand for each other, by their
    least id, and so do points; they meet in a bucket of the lattice, and every hole gets what its point has found."""
    box, spot = ["minx", "miny", "maxx", "maxy"], ["project", "px", "py"]
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 100), F.floor(F.col(b) / 100)))
    outer = s.v_feature.where("layer = 'effective'").groupBy("project", *box).agg(F.min("feature_id").alias("outer_id"))
    outer = outer.withColumn("outer_ring", G.box_ring(*box)).withColumn("bx", span("minx", "maxx")).withColumn("by", span("miny", "maxy"))
    hole = s.v_feature.where("layer = 'additions'").select("project", F.col("feature_id").alias("hole"), (F.col("minx") + 1).alias("px"), (F.col("miny") + 1).alias("py"))
    spots = hole.select(*spot).distinct().withColumns({"bx": F.floor(F.col("px") / 100), "by": F.floor(F.col("py") / 100)})
    met = spots.hint("merge").join(outer.drop(*box), ["project", "bx", "by"]).where(G.inside(F.col("px"), F.col("py"), F.col("outer_ring")))
    found = met.groupBy(*spot).agg(F.min("outer_id").alias("outer_id"))
    return hole.join(found, spot).groupBy("hole").agg(F.min("outer_id").alias("outer_id"))


@R.add("fn55_feature_area", "SELECT feature_id, CASE WHEN feature_id % 3 = 0 THEN score WHEN feature_id % 3 = 1 THEN p ELSE CAST((maxx - minx) * (maxy - miny) AS DOUBLE) END AS area FROM v_feature")
def fn55(s):
    """The first property that can be read as a number, else the geometry's area."""
    f = s.v_feature.withColumn("ring", G.box_ring("minx", "miny", "maxx", "maxy"))
    told = F.when(F.col("feature_id") % 3 == 0, F.col("score").cast("string")).otherwise("n/a")
    other = F.when(F.col("feature_id") % 3 == 1, F.col("p").cast("string"))
    return f.select("feature_id", F.coalesce(told.try_cast("double"), other.try_cast("double"), G.signed_area("ring")).alias("area"))
