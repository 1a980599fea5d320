"""Documents in and out: GeoJSON payloads, WKT, nested JSON, holes of cell sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landfold.functions.geometry import bounds
from landfold.functions.grid import project_mercator, unproject_mercator
from landfold.operators import cells as C
from landfold.operators.graph import label_cells
from landfold.sources.staging import staged

GEOMETRY = "struct<type: string, coordinates: string>"


def as_payloads(features: DataFrame) -> DataFrame:
    """Features as the payloads that callers send: collections, features, bare geometries, other things."""
    ring = F.to_json(F.array(F.array(F.array("minx", "miny"), F.array("maxx", "miny"), F.array("maxx", "maxy"), F.array("minx", "maxy"), F.array("minx", "miny"))))
    k = F.col("feature_id") % 8
    kind = F.when(k == 1, "Point").otherwise("Polygon")
    geometry = F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), ring, F.lit("}"))
    feature = F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), geometry, F.lit("}"))
    whole = F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}"))
    k4 = F.col("feature_id") % 4
    return features.select("feature_id", F.when(k4 == 0, whole).when(k4 == 1, feature).when(k4 == 2, geometry).otherwise("not json").alias("payload"))


def polygon_payloads(rows: DataFrame) -> DataFrame:
    """One row per polygonal geometry of a payload (FeatureCollection, Feature or bare geometry); the rest is skipped."""
    kind = F.get_json_object("payload", "$.type")
    features = F.from_json(F.get_json_object("payload", "$.features"), "array<string>")
    one = F.when(kind == "FeatureCollection", features).when(kind == "Feature", F.array("payload")).otherwise(F.array(F.concat(F.lit('{"geometry":'), "payload", F.lit("}"))))
    each = rows.where(kind.isNotNull()).withColumn("feature", F.explode(one))
    typed = each.withColumns({"type": F.get_json_object("feature", "$.geometry.type"), "coordinates": F.get_json_object("feature", "$.geometry.coordinates")})
    return typed.where(F.col("type").isin("Polygon", "MultiPolygon") & (F.length("coordinates") > 2)).drop("feature")


def wkt_ring(text: Column) -> Column:
    """The outer ring of a WKT polygon."""
    inner = F.regexp_extract(text, r"POLYGON\s*\(\(([^)]*)\)", 1)
    pair = lambda p: F.split(F.trim(p), r"\s+")
    return F.transform(F.split(inner, ","), lambda p: F.struct(pair(p)[0].cast("double").alias("x"), pair(p)[1].cast("double").alias("y")))


def walk_json(rows: DataFrame, doc: str, keys: list[str], depth: int) -> DataFrame:
    """(keys, field_path, value) for every leaf of the documents; what is nested deeper than `depth` is one value, as text."""
    rows = rows.select(*keys, F.expr(f"try_parse_json({doc})").alias("v"), F.lit("$").alias("field_path"))
    done = None
    for _ in range(depth):
        kids = rows.lateralJoin(rows.sparkSession.tvf.variant_explode_outer(F.col("v").outer()))
        kids = kids.select(*keys, F.col("value").alias("v"), F.when(F.col("key").isNotNull(), F.concat("field_path", F.lit("."), "key")).otherwise(F.concat("field_path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).alias("field_path"))
        kind = F.schema_of_variant("v")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        leaves = kids.where(~nested & F.col("v").isNotNull()).select(*keys, "field_path", F.try_variant_get("v", "$", "string").alias("value"))
        done = leaves if done is None else done.unionByName(leaves)
        rows = kids.where(nested)
    return done.unionByName(rows.select(*keys, "field_path", F.to_json("v").alias("value")))


#: Keys of metadata that hold a path or an address, and those that hold a request's hash.
PATH_KEYS = ("path", "url", "artifact_url", "artifactUrl", "download_url", "downloadUrl", "download_bundle_path", "downloadable_zip_path", "temporal_project_bundle_path",
             "cog_path", "cogPath", "canonical_cog_path", "canonicalCogPath", "source_path", "sourcePath", "display_path", "displayPath")
HASH_KEYS = ("pair_request_hash", "pairRequestHash")


def json_references(rows: DataFrame, doc: str, keys: list[str], depth: int) -> DataFrame:
    """References in nested documents: (keys, reason, field_path, request_hash), a row for each. A known key of a hash or of a path
    gives its own name as the reason; any other text with /requests/ in it counts as text. The hash is that of a hash key, or
    what follows /requests/ in a path: each such hash of a text, once; what lies below `depth` is one text."""
    leaves = walk_json(rows, doc, keys, depth).where("value <> ''")
    key = F.regexp_extract("field_path", r"([A-Za-z_]+)$", 1)
    in_path = F.array_distinct(F.regexp_extract_all("value", F.lit(r"/requests/([^/\"\\\s]+)"), F.lit(1)))
    reason = F.when(key.isin(*HASH_KEYS, *PATH_KEYS), key).when(F.col("value").contains("/requests/"), "text")
    found = leaves.withColumns({"reason": reason, "request_hash": F.explode_outer(F.when(key.isin(*HASH_KEYS), F.array("value")).otherwise(in_path))})
    return found.where("reason IS NOT NULL").select(*keys, "reason", "field_path", "request_hash")


def metric_lines(roads: DataFrame) -> DataFrame:
    """roads: type, crs and lines (arrays of points). Only lines with a reference system stay, degrees become Web-Mercator
    metres; another system is an error."""
    known = roads.where(F.col("type").isin("LineString", "MultiLineString") & F.col("crs").isNotNull())

    def point(p: Column) -> Column:
        x, y = project_mercator(p.x, p.y)
        return F.struct(x.alias("x"), y.alias("y"))

    projected = F.transform("lines", lambda line: F.transform(line, point))
    bad = F.raise_error(F.concat(F.lit("unknown reference system "), "crs")).cast("array<array<struct<x: double, y: double>>>")
    return known.withColumn("lines", F.when(F.col("crs") == "EPSG:3857", F.col("lines")).when(F.col("crs") == "EPSG:4326", projected).otherwise(bad)).withColumn("crs", F.lit("EPSG:3857"))


def imported_areas(rows: DataFrame, text: str, told: Column | None = None) -> DataFrame:
    """Areas given as WKT or GeoJSON polygons: adds ring (in degrees), crs, bounds and valid. The system is the one told, else
    metres where a coordinate is beyond those of degrees; bounds must be ordered, finite and within the earth's."""
    geo = F.from_json(F.get_json_object(text, "$.coordinates"), "array<array<array<double>>>")
    ring = F.coalesce(F.transform(F.get(geo, F.lit(0)), lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))), F.when(F.col(text).rlike(r"^\s*POLYGON"), wkt_ring(F.col(text))))
    read = rows.withColumn("ring", ring)
    far = F.exists("ring", lambda p: (F.abs(p.x) > 360) | (F.abs(p.y) > 180))
    crs = F.coalesce(told if told is not None else F.lit(None).cast("string"), F.when(far, "EPSG:3857").otherwise("EPSG:4326"))

    def degrees(p: Column) -> Column:
        lon, lat = unproject_mercator(p.x, p.y)
        return F.struct(lon.alias("x"), lat.alias("y"))

    read = read.withColumn("crs", crs).withColumn("ring", F.when(F.col("crs") == "EPSG:3857", F.transform("ring", degrees)).otherwise(F.col("ring")))
    read = read.withColumn("bounds", bounds("ring"))
    b = F.col("bounds")
    return read.withColumn("valid", F.coalesce((b.minx >= -180) & (b.maxx <= 180) & (b.miny >= -90) & (b.maxy <= 90) & (b.minx < b.maxx) & (b.miny < b.maxy), F.lit(False)))


def manifest(wanted: DataFrame, own: DataFrame, told: DataFrame, keys: list[str], file_keys: list[str], group: str) -> DataFrame:
    """One entry for each wanted layer: exists, feature_count, bbox and types, computed (own: keys, n, bbox) unless recorded (told:
    file_keys, told, size, age_h, sha), and one fingerprint over the entries of each group."""
    entries = wanted.join(own, keys, "left").join(told, file_keys, "left")
    there = F.col("n").isNotNull()
    entries = entries.select(*wanted.columns, there.alias("exists"), F.coalesce("told", "n", F.lit(0)).alias("feature_count"), "bbox", F.when(there, F.array(F.lit("Polygon"))).otherwise(F.array().cast("array<string>")).alias("types"), "size", "age_h", "sha")
    entries = staged(entries, "manifest-entries")
    rest = [k for k in keys if k != group]
    line = F.concat_ws("|", *rest, F.col("feature_count").cast("string"), F.coalesce("sha", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct(*rest, line.alias("line"))))
    prints = entries.groupBy(group).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x.line), ";"), 256).alias("fingerprint"))
    return entries.join(prints, group)


def filled(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells and their holes. A hole lies within one component (of cells that share a side or a corner), so each component's
    complement is sought inside its own bounds, and the parts of it that don't reach these bounds are holes."""
    whole = C.union(cells, keys)
    labelled = staged(label_cells(whole, keys, eight=True).withColumnRenamed("label", "_of"), "fill-components")
    own = [*keys, "_of"]
    box = labelled.groupBy(*own).agg(F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1"), F.count("*").alias("n"))
    # Only what is at least three cells wide and high, and not full, can have a hole.
    box = box.where("x1 - x0 >= 2 AND y1 - y0 >= 2 AND n < (x1 - x0 + 1) * (y1 - y0 + 1)")
    grid = box.withColumn("cx", F.explode(F.sequence("x0", "x1"))).withColumn("cy", F.explode(F.sequence("y0", "y1")))
    outside = staged(grid.join(labelled, [*own, *C.CELL], "left_anti"), "fill-complement")
    labels = staged(label_cells(outside.select(*own, *C.CELL), own), "fill-labels")
    edge = outside.where("cx = x0 OR cx = x1 OR cy = y0 OR cy = y1").join(labels, [*own, *C.CELL]).select(*own, "label").distinct()
    holes = labels.join(edge, [*own, "label"], "left_anti").select(*keys, *C.CELL)
    return whole.unionByName(holes).distinct()


def merged_payloads(rows: DataFrame, keys: list[str], getter: Callable[[], Column]) -> DataFrame:
    """(keys, merged): the features of the payloads that the getter, an expression over the row's columns, gives as an array."""
    return rows.select(*keys, F.flatten(getter()).alias("merged"))
