"""Geometry on a metric lattice: a geometry is a set of cells (cx, cy) under some key columns, so that overlay, buffers and
areas are joins, distinct and counts. Against vector overlay the error is at most about the outline's length times the cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL = ["cx", "cy"]


def cells_of_boxes(boxes: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Cells whose centre lies in the box (minx, miny, maxx, maxy, in whole units); one row per box and cell."""

    def span(low: str, high: str):
        first, last = F.ceil(F.col(low) / size - 0.5), F.ceil(F.col(high) / size - 0.5) - 1
        return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))

    return boxes.select(*keys, F.explode(span("minx", "maxx")).alias("cx"), "miny", "maxy").select(*keys, "cx", F.explode(span("miny", "maxy")).alias("cy"))


def union(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.select(*keys, *CELL).distinct()


def intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return union(a, keys).join(b.select(*keys, *CELL).distinct(), [*keys, *CELL], "left_semi")


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return union(a, keys).join(b.select(*keys, *CELL), [*keys, *CELL], "left_anti")


def disc(radius: float, square: bool = False) -> list[tuple[int, int]]:
    """Offsets within a Euclidean radius, or a square of that half side."""
    r = int(radius)
    return [(x, y) for x in range(-r, r + 1) for y in range(-r, r + 1) if square or x * x + y * y <= radius * radius]


def _spread(cells: DataFrame, keys: list[str], offsets: list[tuple[int, int]]) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in offsets])
    moved = cells.select(*keys, *CELL, F.explode(steps).alias("o"))
    return moved.select(*keys, (F.col("cx") + F.col("o.x")).alias("cx"), (F.col("cy") + F.col("o.y")).alias("cy"))


def dilate(cells: DataFrame, keys: list[str], radius: float, square: bool = False) -> DataFrame:
    """Cells within the radius; a radius of 0 or below changes nothing. Squares go in two passes, a row of offsets each."""
    if radius <= 0:
        return union(cells, keys)
    if square:
        r = range(-int(radius), int(radius) + 1)
        return _spread(_spread(cells, keys, [(x, 0) for x in r]).distinct(), keys, [(0, y) for y in r]).distinct()
    return _spread(cells, keys, disc(radius)).distinct()


def erode(cells: DataFrame, keys: list[str], radius: float, square: bool = False) -> DataFrame:
    """Cells all of whose neighbours within the radius are there; counted, so that no complement is needed."""
    if radius <= 0:
        return union(cells, keys)
    offsets = disc(radius, square)
    return _spread(union(cells, keys), keys, offsets).groupBy(*keys, *CELL).count().where(F.col("count") == len(offsets)).select(*keys, *CELL)


def close(cells: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Dilation, then erosion: gaps up to twice the radius are bridged. The cells themselves stay."""
    return erode(dilate(cells, keys, radius), keys, radius).unionByName(union(cells, keys)).distinct()


def area(cells: DataFrame, keys: list[str], size: int) -> DataFrame:
    return union(cells, keys).groupBy(*keys).agg((F.count("*") * size * size).alias("area"))


def overlap(candidates: DataFrame, footprint: DataFrame, keys: list[str], shared: list[str]) -> DataFrame:
    """Share of each candidate's cells (keys) that lie on the footprint (shared keys), 0 for none."""
    marked = candidates.join(footprint.select(*shared, *CELL).distinct().withColumn("_on", F.lit(1)), [*shared, *CELL], "left")
    return marked.groupBy(*keys).agg((F.count("_on") / F.count("*")).alias("overlap"), F.count("*").alias("cells"))


def first_seen(cells: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The first position at which a cell appears: the monotone union over time in one grouping."""
    return cells.groupBy(*keys, *CELL).agg(F.min(position).alias(position))


def growth(cells: DataFrame, positions: DataFrame, keys: list[str], position: str, size: int) -> DataFrame:
    """For each of `positions` (keys, position): area added there, and the cumulative area."""
    added = first_seen(cells, keys, position).groupBy(*keys, position).agg((F.count("*") * size * size).alias("added_area"))
    every = positions.select(*keys, position).distinct().join(added, [*keys, position], "left").withColumn("added_area", F.coalesce("added_area", F.lit(0)))
    return every.withColumn("total_area", F.sum("added_area").over(W.partitionBy(*keys).orderBy(position).rowsBetween(W.unboundedPreceding, 0)))
