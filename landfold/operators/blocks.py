"""Growth on the lattice: merged regions, buffers in parts, blocks, envelopes, road-bound buffers, and cell sets as polygons.

Sets of cells, as strips, stand for geometries; measures on the ellipsoid count each cell with the area of its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landfold.functions.geometry import segments
from landfold.operators import strips as S
from landfold.operators.graph import numbered, split_segments
from landfold.operators.raster import outlines
from landfold.sources.staging import staged


def ring_area(points: str) -> Column:
    """Above 0 for outer rings, below for holes."""
    return F.aggregate(segments(points), F.lit(0.0), lambda t, e: t + e.a.x * e.b.y - e.b.x * e.a.y) / 2


def ring_length(points: str) -> Column:
    return F.aggregate(segments(points), F.lit(0.0), lambda t, e: t + F.abs(e.a.x - e.b.x) + F.abs(e.a.y - e.b.y))


def polygons(strips: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Sets of cells to polygons: (keys, label, ring, points), one polygon for each component, its outer ring first."""
    labelled = S.label_cells(strips, keys).withColumnsRenamed({"cx": "col", "cy": "row"})
    scaled = F.transform("points", lambda p: F.struct((p.x * size).alias("x"), (p.y * size).alias("y")))
    return outlines(labelled, keys).withColumn("points", scaled)


def buffer_parts(strips: DataFrame, keys: list[str], distances: tuple[int, ...], size: int) -> DataFrame:
    """(keys, buffer_m, label, area, buffer_id): the parts of the buffers by each distance, numbered over all keys."""
    source, grown = staged(S.union(strips, keys), "buffer-source"), None
    for d in distances:
        own = S.dilate(source, keys, d / size).withColumn("buffer_m", F.lit(d))
        grown = own if grown is None else grown.unionByName(own)
    parts = S.label(grown, [*keys, "buffer_m"]).groupBy("buffer_m", *keys, "label").agg((F.sum(F.col("x1") - F.col("x0")) * size * size).alias("area"))
    # One running number over all rows by range; the least of each distance is taken off.
    placed = numbered(parts, ["buffer_m", *keys, "label"], "_n")
    first = placed.groupBy("buffer_m").agg(F.min("_n").alias("_first"))
    return placed.join(F.broadcast(first), "buffer_m").withColumn("buffer_id", F.col("_n") - F.col("_first") + 1).drop("_n", "_first")


def merged_regions(sources: DataFrame, keys: list[str], source: str, radius: float, size: int) -> DataFrame:
    """sources: strips (keys, source). Regions of the closed union: label, region_id within the keys, area, the number of
    sources in it and the least of these."""
    whole = S.union(sources, keys)
    labels = staged(S.label(S.close(whole, keys, radius), keys), "regions")
    area = labels.groupBy(*keys, "label").agg((F.sum(F.col("x1") - F.col("x0")) * size * size).alias("area"))
    regions = S.run_strips(labels, [*keys, "label"]).withColumnRenamed("bits", "_b")
    members = sources.join(regions, [*keys, *S.STRIP]).where(F.col("bits").bitwiseAND(F.col("_b")) != 0).select(*keys, "label", source).distinct()
    told = members.groupBy(*keys, "label").agg(F.count("*").alias("sources"), F.min(source).alias("first_source"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("label")).cast("bigint")
    return area.join(told, [*keys, "label"]).withColumn("region_id", place)


def closed_blocks(strips: DataFrame, keys: list[str], gap: float, size: int) -> DataFrame:
    """Each block closed over gaps of up to `gap`; 0 or below gives the plain union."""
    return S.close(S.union(strips, keys), keys, max(0.0, gap / 2 / size))


def growth_blocks(members: DataFrame, keys: list[str], gap: float, size: int, area: tuple[int, int, int, int]) -> DataFrame:
    """members: features with their block's root; where there is a column `members`, a row stands for so many of them. One row
    per block with anything inside the area: block_id by root within the keys, members, area on the ellipsoid, centre."""
    own = [*keys, "root"]
    found = S.measures(S.clipped(closed_blocks(S.of_features(members, own, size), own, gap, size), area), own, size).drop("cells")
    told = members.groupBy(*own).agg((F.sum("members") if "members" in members.columns else F.count("*")).alias("members"))
    return found.join(told, own).withColumn("block_id", F.row_number().over(W.partitionBy(*keys).orderBy("root")).cast("bigint"))


def growth_envelope(strips: DataFrame, keys: list[str], bridge: float, size: int, area: tuple[int, int, int, int]) -> DataFrame:
    """(keys, cells, area_m2, smoothed, uncovered, covered): the union bridged over gaps and without holes; smoothed (opened by
    one cell) where the smooth set still covers all of the union; clipped to the area. covered: whether what is left of the
    union outside is within the tolerance, the greater of 0.05 and a billionth of the area, in square metres."""
    source = staged(S.union(strips, keys), "envelope-source")
    whole = staged(S.filled(S.close(source, keys, bridge), keys), "envelope-filled")
    smooth = staged(S.morphed(whole, keys, (1, False, True), (1, False, False)), "envelope-smooth")
    rough = S.difference(source, smooth, keys).select(*keys).distinct()
    chosen = smooth.join(rough, keys, "left_anti").withColumn("smoothed", F.lit(True)).unionByName(whole.join(rough, keys, "left_semi").withColumn("smoothed", F.lit(False)))
    cut = staged(S.clipped(chosen, area), "envelope")
    lost = S.difference(S.clipped(source, area), cut, keys).groupBy(*keys).agg(F.sum(S.count()).alias("uncovered"))
    told = cut.groupBy(*keys).agg(F.first("smoothed").alias("smoothed"))
    found = S.measures(cut, keys, size).drop("centre_x", "centre_y").join(told, keys)
    found = found.join(lost, keys, "left").withColumn("uncovered", F.coalesce("uncovered", F.lit(0)))
    return found.withColumns({"covered": F.col("uncovered") * size * size <= F.greatest(F.lit(0.05), F.col("area_m2") * 1e-9), "area_m2": F.round("area_m2", 2)})


def road_cells(roads: DataFrame, size: int) -> DataFrame:
    """Cells that segments (x1, y1, x2, y2) pass through, as (cx, cy)."""
    short = split_segments(roads, float(size))
    bound = lambda f, v: F.floor(f(f"{v}1", f"{v}2") / size)
    span = lambda v: F.explode(F.sequence(bound(F.least, v), bound(F.greatest, v)))
    boxes = short.withColumn("cx", span("x")).withColumn("cy", span("y"))
    # The piece's line against the cell: corners on both sides of it, or on it.
    side = lambda dx, dy: F.signum((F.col("x2") - F.col("x1")) * ((F.col("cy") + dy) * size - F.col("y1")) - (F.col("y2") - F.col("y1")) * ((F.col("cx") + dx) * size - F.col("x1")))
    corners = [side(dx, dy) for dx in (0, 1) for dy in (0, 1)]
    return boxes.where((F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)).select("cx", "cy").distinct()


def road_split(sources: DataFrame, key: str, radius: float, roads: DataFrame, size: int) -> DataFrame:
    """sources: strips (key). Buffers by `radius` cells, cut by roads: strips (key, uncut). Of a cut buffer the parts that touch
    the source stay; a buffer of which nothing would stay is left uncut."""
    source = staged(S.union(sources, [key]), "road-sources")
    grown = staged(S.dilate(source, [key], radius), "road-buffers")
    barred = S.of_cells(road_cells(roads, size), []).withColumnRenamed("bits", "_b")
    left = grown.join(barred, S.STRIP, "left").withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_b", F.lit(0).cast("bigint"))))).where("bits <> 0").drop("_b")
    parts = staged(S.run_strips(S.label(left, [key]), [key, "label"]), "road-parts")
    met = parts.join(source.withColumnRenamed("bits", "_s"), [key, *S.STRIP]).where(F.col("bits").bitwiseAND(F.col("_s")) != 0)
    touching = met.select(key, "label").distinct()
    kept = S.union(parts.join(touching, [key, "label"], "left_semi"), [key]).withColumn("uncut", F.lit(False))
    whole = grown.join(touching.select(key), key, "left_anti").withColumn("uncut", F.lit(True))
    return kept.unionByName(whole.select(kept.columns))
