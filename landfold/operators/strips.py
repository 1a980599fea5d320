"""Sets of cells as packed strips: a row holds 64 cells side by side as the bits of one number.

A strip (keys, sx, cy, bits) is the cells 64 * sx .. 64 * sx + 63 of lattice row cy, the lowest bit being the first. Overlay is
`bit_or` by group and AND and ANDNOT on equi-joins, area a sum of bit counts; all that stays in the JVM. Dilation, erosion and
closing deal strips out to squares of 64 by 64 cells with a halo, one exchange, and work on whole squares as arrays.

Geometries come in as boxes, or as rings with holes by scan-line: every edge gives its crossings with the rows' centre lines,
crossings of a row sorted are intervals by even-odd, and intervals are cut into strips. A cell is on where its centre is inside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from landfold.functions.geometry import cell_area_m2
from landfold.operators.graph import ONE_TASK_EDGES, components, least_of_group, whole_groups
from landfold.sources.staging import staged

SIDE = 64
STRIP = ["sx", "cy"]
#: Rows of cells to a band: a long edge of a polygon is dealt out by bands before its rows are written out.
BAND = 4096
#: Squares that are worked on at a time in a task.
TOGETHER = 256


def _shift(a: Column, n: Column) -> Column:
    return F.call_function("shiftleft", a, n.cast("int"))


def _bits(low: Column, high: Column) -> Column:
    """Bits low .. high, both within 0 .. 63."""
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), (SIDE - 1 - high + low).cast("int"))
    return _shift(ones, low)


def of_intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: (keys, cy, x0, x1), cells x0 .. x1 of a row, both included; none where x1 < x0."""
    square = lambda c: F.floor(F.col(c) / SIDE)
    cut = rows.where("x1 >= x0").select(*keys, "cy", "x0", "x1", F.explode(F.sequence(square("x0"), square("x1"))).alias("sx"))
    start = F.col("sx") * SIDE
    return cut.select(*keys, "sx", "cy", _bits(F.greatest(F.col("x0") - start, F.lit(0)), F.least(F.col("x1") - start, F.lit(SIDE - 1))).alias("bits"))


def _first(v: Column, size: int) -> Column:
    """The first cell whose centre is at v or beyond."""
    return F.ceil(v / size - 0.5)


def of_boxes(boxes: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Boxes (minx, miny, maxx, maxy)."""
    first, last = _first(F.col("miny"), size), _first(F.col("maxy"), size) - 1
    rows = boxes.select(*keys, _first(F.col("minx"), size).alias("x0"), (_first(F.col("maxx"), size) - 1).alias("x1"), F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))).alias("cy"))
    return of_intervals(rows, keys)


def of_rings(features: DataFrame, keys: list[str], size: int, rings: str = "rings") -> DataFrame:
    """Features with rings (array of array of (x, y)), outer ones and holes of any direction, closed or not. A feature is a row:
    its rings meet by even-odd. Null, empty and flat rings give no cells."""
    rows = features.select(*keys, F.col(rings).alias("_r")).withColumn("_f", F.monotonically_increasing_id()).withColumn("_r", F.explode("_r"))
    pair = lambda k: F.struct(F.col("_r")[k].alias("a"), F.col("_r")[(k + 1) % F.size("_r")].alias("b"))
    edges = rows.where(F.size("_r") > 2).select(*keys, "_f", F.explode(F.transform(F.sequence(F.lit(0), F.size("_r") - 1), pair)).alias("e"))
    edges = edges.select(*keys, "_f", *[F.col(f"e.{p}.{v}").cast("double").alias(f"_{p}{v}") for p in "ab" for v in "xy"])
    low, high = F.least("_ay", "_by"), F.greatest("_ay", "_by")
    edges = edges.withColumns({"_y0": _first(low, size), "_y1": _first(high, size) - 1}).where("_y1 >= _y0")
    band = lambda c: F.floor(F.col(c) / BAND)
    bands = edges.withColumn("_band", F.explode(F.sequence(band("_y0"), band("_y1")))).repartition("_f", "_band")
    inside = F.sequence(F.greatest("_y0", F.col("_band") * BAND), F.least("_y1", F.col("_band") * BAND + BAND - 1))
    at = bands.withColumn("cy", F.explode(inside))
    x = F.col("_ax") + ((F.col("cy") + 0.5) * size - F.col("_ay")) * (F.col("_bx") - F.col("_ax")) / (F.col("_by") - F.col("_ay"))
    crossed = at.select(*keys, "_f", "_band", "cy", x.alias("_x")).groupBy(*keys, "_f", "_band", "cy").agg(F.sort_array(F.collect_list("_x")).alias("_x"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("_x") / 2).cast("int") - 1), lambda k: F.struct(F.col("_x")[2 * k].alias("a"), F.col("_x")[2 * k + 1].alias("b")))
    spans = crossed.where(F.size("_x") > 1).select(*keys, "cy", F.explode(pairs).alias("s"))
    return of_intervals(spans.select(*keys, "cy", _first(F.col("s.a"), size).alias("x0"), (_first(F.col("s.b"), size) - 1).alias("x1")), keys)


def of_features(features: DataFrame, keys: list[str], size: int) -> DataFrame:
    """By rings where there is such a column, else by boxes."""
    return of_rings(features, keys, size) if "rings" in features.columns else of_boxes(features, keys, size)


def of_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    bit = _shift(F.lit(1).cast("bigint"), F.pmod(F.col("cx"), F.lit(SIDE)))
    return union(cells.select(*keys, F.floor(F.col("cx") / SIDE).alias("sx"), F.col("cy").cast("bigint").alias("cy"), bit.alias("bits")), keys)


def cells_of(strips: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each cell (cx, cy)."""
    on = F.filter(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda k: F.call_function("shiftright", F.col("bits"), k).bitwiseAND(F.lit(1)) == 1)
    return strips.select(*keys, "sx", "cy", F.explode(on).alias("_k")).select(*keys, (F.col("sx") * SIDE + F.col("_k")).alias("cx"), "cy")


# --- overlay


def union(strips: DataFrame, keys: list[str]) -> DataFrame:
    """One strip for each place; most other operators take such a set."""
    return strips.groupBy(*keys, *STRIP).agg(F.bit_or("bits").alias("bits"))


def intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Of strips that are unions."""
    met = a.join(b.select(*keys, *STRIP, F.col("bits").alias("_b")), [*keys, *STRIP])
    return met.select(*keys, *STRIP, F.col("bits").bitwiseAND(F.col("_b")).alias("bits")).where("bits <> 0")


def difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    met = a.join(b.select(*keys, *STRIP, F.col("bits").alias("_b")), [*keys, *STRIP], "left")
    return met.select(*keys, *STRIP, F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_b", F.lit(0).cast("bigint")))).alias("bits")).where("bits <> 0")


def clip_bits(box: tuple[int, int, int, int]) -> Column:
    """A strip's bits within the cells of a box, both ends included."""
    x0, y0, x1, y1 = box
    start = F.col("sx") * SIDE
    mask = _bits(F.greatest(F.lit(x0) - start, F.lit(0)), F.least(F.lit(x1) - start, F.lit(SIDE - 1)))
    near = F.col("cy").between(y0, y1) & F.col("sx").between(x0 // SIDE, x1 // SIDE)
    return F.when(near, F.col("bits").bitwiseAND(mask)).otherwise(F.lit(0).cast("bigint"))


def clipped(strips: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    return strips.withColumn("bits", clip_bits(box)).where("bits <> 0")


def count(bits: str | Column = "bits") -> Column:
    return F.bit_count(bits).cast("bigint")


def column_sum(bits: str = "bits") -> Column:
    """Sum of cx over a strip's cells: bit by bit of the places within it."""
    total = F.col("sx") * SIDE * count(bits)
    for k in range(6):
        mask = sum(1 << j for j in range(SIDE) if j >> k & 1)
        total = total + count(F.col(bits).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("bigint"))) * (1 << k)
    return total


def area(strips: DataFrame, keys: list[str], size: int) -> DataFrame:
    return union(strips, keys).groupBy(*keys).agg((F.sum(count()) * size * size).alias("area"))


def measures(strips: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Of strips that are unions: cells, area on the ellipsoid, centre."""
    n = F.sum(count())
    return strips.groupBy(*keys).agg(
        n.alias("cells"), F.sum(count() * cell_area_m2("cy", size)).alias("area_m2"),
        ((F.sum(column_sum()) / n + 0.5) * size).alias("centre_x"), ((F.sum(count() * F.col("cy")) / n + 0.5) * size).alias("centre_y"))


def overlap(candidates: DataFrame, footprint: DataFrame, keys: list[str], shared: list[str]) -> DataFrame:
    """Share of each candidate's cells (keys) that lie on the footprint (shared keys), 0 for none."""
    own = candidates.groupBy(*dict.fromkeys([*keys, *shared]), *STRIP).agg(F.bit_or("bits").alias("bits"))
    met = own.join(union(footprint, shared).withColumnRenamed("bits", "_b"), [*shared, *STRIP], "left")
    on = F.coalesce(F.sum(count(F.col("bits").bitwiseAND(F.col("_b")))), F.lit(0))
    return met.groupBy(*keys).agg((on / F.sum(count())).alias("overlap"), F.sum(count()).alias("cells"))


def growth(strips: DataFrame, positions: DataFrame, keys: list[str], position: str, size: int) -> DataFrame:
    """For each of `positions` (keys, position): area added there, and the cumulative area. What a strip adds are its bits that
    no earlier one of its place has."""
    before = F.bit_or("bits").over(W.partitionBy(*keys, *STRIP).orderBy(position).rowsBetween(W.unboundedPreceding, -1))
    seen = union(strips, [*keys, position]).withColumn("_before", F.coalesce(before, F.lit(0).cast("bigint")))
    fresh = seen.groupBy(*keys, position).agg((F.sum(count(F.col("bits").bitwiseAND(F.bitwise_not(F.col("_before"))))) * size * size).alias("added_area"))
    every = positions.select(*keys, position).distinct().join(fresh, [*keys, position], "left").withColumn("added_area", F.coalesce("added_area", F.lit(0)))
    return every.withColumn("total_area", F.sum("added_area").over(W.partitionBy(*keys).orderBy(position).rowsBetween(W.unboundedPreceding, 0)))


# --- morphology


def _windowed(canvas: np.ndarray, radius: float, square: bool, eroded: bool) -> np.ndarray:
    """Cells (n, rows, columns) within the radius of any cell, or all of whose neighbours within it are there. Loses
    int(radius) at each border."""
    r = int(radius)
    n, rows, columns = canvas.shape
    sums = np.zeros((n, rows, columns + 1), np.int32)
    np.cumsum(canvas, axis=2, out=sums[:, :, 1:])
    out = np.full((n, rows - 2 * r, columns - 2 * r), eroded)
    for dy in range(-r, r + 1):
        w = r if square else int(np.sqrt(radius * radius - dy * dy))
        line = sums[:, r + dy : rows - r + dy]
        found = line[:, :, r + w + 1 : columns - r + w + 1] - line[:, :, r - w : columns - r - w]
        if eroded:
            out &= found == 2 * w + 1
        else:
            out |= found > 0
    return out


Step = tuple[float, bool, bool]  # radius, square, eroded


def _squares(strips: DataFrame, keys: list[str], halo: int, work: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Deals strips out to squares with a halo and puts arrays (squares, 64 + 2 * halo, 64 + 2 * halo) through `work`, which
    gives (squares, 64, 64). Only strips near a border go to more than one square."""
    reach, square = -(-halo // SIDE), F.floor(F.col("cy") / SIDE)
    near = strips.withColumns({"ty": F.explode(F.sequence(F.floor((F.col("cy") - halo) / SIDE), F.floor((F.col("cy") + halo) / SIDE)))}) if halo else strips.withColumn("ty", square)
    steps = [F.struct(F.lit(0).alias("dx"), F.lit(-1).cast("bigint").alias("mask"))]
    for k in range(1, reach + 1):
        n = min(SIDE, halo - SIDE * (k - 1))  # columns that the halo of a square k steps away reaches
        low, high = (1 << n) - 1, ((1 << n) - 1) << (SIDE - n)
        signed = lambda v: F.lit(v - (1 << 64) if v >> 63 else v).cast("bigint").alias("mask")
        steps += [F.struct(F.lit(-k).alias("dx"), signed(low)), F.struct(F.lit(k).alias("dx"), signed(high))]
    seen = F.filter(F.array(*steps), lambda s: F.col("bits").bitwiseAND(s.mask) != 0)
    dealt = near.withColumn("s", F.explode(seen)).select(*keys, (F.col("sx") + F.col("s.dx")).cast("bigint").alias("tx"), F.col("ty").cast("bigint").alias("ty"), F.col("s.dx").alias("dx"), F.col("cy").cast("bigint").alias("cy"), "bits")
    group = [*keys, "tx", "ty"]
    dealt = dealt.repartition(*group).sortWithinPartitions(*group)

    def some(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
        tx, ty, dx, cy = (rows[c].to_numpy().astype(np.int64) for c in ("tx", "ty", "dx", "cy"))
        words = np.zeros((len(starts), SIDE + 2 * halo, 2 * reach + 1), "<u8")
        np.bitwise_or.at(words, (owner, cy - ty * SIDE + halo, reach - dx), rows["bits"].to_numpy().view(np.uint64))
        canvas = np.unpackbits(words.view(np.uint8).reshape(*words.shape[:2], -1), axis=2, bitorder="little").view(bool)
        edge = reach * SIDE - halo
        made = work(canvas[:, :, edge : canvas.shape[2] - edge])
        packed = np.ascontiguousarray(np.packbits(made, axis=2, bitorder="little")).view("<u8")[:, :, 0].view(np.int64)
        at, row = np.nonzero(packed)
        first = starts[at]
        out = [rows[c].take(pa.array(first)) for c in keys]
        return pa.table([*out, pa.array(tx[first]), pa.array(ty[first] * SIDE + row), pa.array(packed[at, row])], [*keys, *STRIP, "bits"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, group):
            for k in range(0, len(starts), TOGETHER):
                end = starts[k + TOGETHER] if k + TOGETHER < len(starts) else rows.num_rows
                yield from some(rows.slice(starts[k], end - starts[k]), starts[k : k + TOGETHER] - starts[k]).to_batches()

    kinds = "".join(f"`{k}` {strips.schema[k].dataType.simpleString()}, " for k in keys)
    return dealt.mapInArrow(over, kinds + "sx bigint, cy bigint, bits bigint")


def morphed(strips: DataFrame, keys: list[str], *steps: Step) -> DataFrame:
    """Dilations and erosions one after the other, with one exchange."""
    steps = tuple(s for s in steps if int(s[0]) > 0)
    if not steps:
        return union(strips, keys)

    def work(canvas: np.ndarray) -> np.ndarray:
        for step in steps:
            canvas = _windowed(canvas, *step)
        return canvas

    return _squares(strips, keys, sum(int(s[0]) for s in steps), work)


def dilate(strips: DataFrame, keys: list[str], radius: float, square: bool = False) -> DataFrame:
    """Cells within the Euclidean radius (or a square of that half side); below 1 nothing changes."""
    return morphed(strips, keys, (radius, square, False))


def erode(strips: DataFrame, keys: list[str], radius: float, square: bool = False) -> DataFrame:
    return morphed(strips, keys, (radius, square, True))


def close(strips: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Dilation, then erosion: gaps up to twice the radius are bridged. The cells themselves stay."""
    return morphed(strips, keys, (radius, False, False), (radius, False, True))


def edge_band(strips: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Cells about the outline: the set grown, without its eroded core."""
    r = int(radius)
    return _squares(strips, keys, r, lambda c: _windowed(c, radius, False, False) & ~_windowed(c, radius, False, True)) if r else union(strips, keys).where("false")


# --- components


def _runs(strips: DataFrame, keys: list[str], outside: bool = False) -> DataFrame:
    """Components within squares, as runs (keys, sx, sy, ny, nx, cy, x0, x1) with the first cell (ny, nx) of their component;
    with `outside`, those of the cells of the same squares that aren't in the set."""
    group = [*keys, "sx", "sy"]
    dealt = strips.select(*keys, F.col("sx").cast("bigint").alias("sx"), F.floor(F.col("cy") / SIDE).alias("sy"), F.col("cy").cast("bigint").alias("cy"), "bits").repartition(*group).sortWithinPartitions(*group, "cy")

    def some(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, rows.num_rows)))
        sx, sy, cy = (rows[c].to_numpy().astype(np.int64) for c in ("sx", "sy", "cy"))
        words = np.zeros((len(starts), SIDE), "<u8")
        np.bitwise_or.at(words, (owner, cy - sy * SIDE), rows["bits"].to_numpy().view(np.uint64))
        words = ~words if outside else words
        on = np.unpackbits(words.view(np.uint8).reshape(len(starts), SIDE, 8), axis=2, bitorder="little").astype(np.int8)
        turn = np.diff(np.pad(on, ((0, 0), (0, 0), (1, 1))), axis=2)
        own, row, x0 = np.nonzero(turn == 1)
        x1 = np.nonzero(turn == -1)[2]
        run = np.cumsum(turn[:, :, :-1].ravel() == 1).reshape(on.shape) - 1
        met = (on[:, :-1] & on[:, 1:]).astype(bool)
        root = least_of_group(len(own), run[:, :-1][met], run[:, 1:][met])
        first = starts[own]
        left, top = sx[first] * SIDE, sy[first] * SIDE
        out = [rows[c].take(pa.array(first)) for c in keys]
        return pa.table([*out, *(pa.array(a) for a in (sx[first], sy[first], (top + row)[root], (left + x0)[root], top + row, left + x0, left + x1))], [*group, "ny", "nx", "cy", "x0", "x1"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, group):
            for k in range(0, len(starts), TOGETHER):
                end = starts[k + TOGETHER] if k + TOGETHER < len(starts) else rows.num_rows
                yield from some(rows.slice(starts[k], end - starts[k]), starts[k : k + TOGETHER] - starts[k]).to_batches()

    kinds = "".join(f"`{k}` {strips.schema[k].dataType.simpleString()}, " for k in keys)
    return staged(dealt.mapInArrow(over, kinds + ", ".join(f"{c} bigint" for c in ("sx", "sy", "ny", "nx", "cy", "x0", "x1"))), "strip-runs")


def _touching(runs: DataFrame, keys: list[str], node: Column) -> DataFrame:
    """Pairs (a, b) of nodes of different squares that touch: runs that end at a square's side with those that begin there, and
    the cells of runs of a last row with those below."""
    same = [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys]
    mine = [F.col(k).alias(f"_{k}") for k in keys]
    here = runs.where(F.col("x1") % SIDE == 0).select(*mine, F.col("cy").alias("_cy"), F.col("x1").alias("_x"), node.alias("a"))
    there = runs.where(F.col("x0") % SIDE == 0).select(*keys, "cy", F.col("x0").alias("x"), node.alias("b"))
    beside = here.join(there, [*same, F.col("cy") == F.col("_cy"), F.col("x") == F.col("_x")]).select("a", "b")
    cells = F.explode(F.sequence(F.col("x0"), F.col("x1") - 1))
    row = F.pmod("cy", F.lit(SIDE))
    last = runs.where(row == SIDE - 1).select(*mine, (F.col("cy") + 1).alias("_cy"), cells.alias("_x"), node.alias("a"))
    top = runs.where(row == 0).select(*keys, "cy", cells.alias("x"), node.alias("b"))
    return beside.unionByName(last.join(top, [*same, F.col("cy") == F.col("_cy"), F.col("x") == F.col("_x")]).select("a", "b"))


def label(strips: DataFrame, keys: list[str]) -> DataFrame:
    """4-connected components as runs of cells: (keys, label, cy, x0, x1), x1 not included, the label being the least id of a
    component's cells, ids counting in row-major order.

    Squares are labelled as arrays, each on its own; a component of a square is a node named by its first cell, and nodes meet
    at squares' borders. So a component of any size is spread over tasks, and the graph sees borders alone."""
    runs = _runs(strips, keys)
    node = F.struct(*[F.col(k) for k in keys], "ny", "nx")
    roots = components(_touching(runs, keys, node), ONE_TASK_EDGES).select(F.col("node").alias("_node"), F.col("root.ny").alias("_ry"), F.col("root.nx").alias("_rx"))
    labelled = runs.withColumn("_node", node).join(roots, "_node", "left")
    return labelled.select(*keys, (F.coalesce("_ry", "ny") * (1 << 31) + F.coalesce("_rx", "nx")).alias("label"), "cy", "x0", "x1")


def filled(strips: DataFrame, keys: list[str]) -> DataFrame:
    """The set and its holes: what of the rest doesn't hang together with the outside by shared sides.

    The rest is labelled inside the squares that the set has; between these, the empty squares from one to the next in a row of
    squares are one node, and what lies before the first and after the last is the outside. So a wide ring costs its edge, and
    no area is written out but that of the holes."""
    source = staged(union(strips, keys), "fill-source")
    rest = _runs(source, keys, outside=True)
    number = lambda c: F.col(c).cast("bigint") if isinstance(c, str) else F.lit(c).cast("bigint")
    node = lambda kind, y, x: F.struct(*[F.col(k) for k in keys], F.lit(kind).alias("kind"), number(y).alias("y"), number(x).alias("x"))
    own, outer = node(2, "ny", "nx"), node(0, 0, 0)
    own_row = W.partitionBy(*keys, "sy").orderBy("sx")
    taken = staged(source.select(*keys, F.col("sx").cast("bigint").alias("sx"), F.floor(F.col("cy") / SIDE).alias("sy")).distinct().withColumn("after", F.lead("sx").over(own_row)), "fill-squares")
    gaps = taken.where("after > sx + 1")
    # What lies at a square (tx, ty) that a node touches or, of two runs of empty squares, at the start of either.
    ask = lambda rows, x, y, of: rows.select(*keys, y.alias("sy"), x.alias("sx"), of.alias("a"))
    sx, sy = F.col("sx"), F.col("sy")
    asked = [
        ask(rest.where(F.col("x0") == sx * SIDE), sx - 1, sy, own), ask(rest.where(F.col("x1") == (sx + 1) * SIDE), sx + 1, sy, own),
        ask(rest.where(F.col("cy") == sy * SIDE), sx, sy - 1, own), ask(rest.where(F.col("cy") == sy * SIDE + SIDE - 1), sx, sy + 1, own),
        *(ask(gaps, sx + 1, sy + d, node(1, "sy", "sx")) for d in (-1, 1)), *(ask(taken.where("after IS NULL"), sx + 1, sy + d, outer) for d in (-1, 1)),
    ]
    looked = taken.select(*keys, "sy", "sx", F.lit(None).cast(asked[0].schema["a"].dataType).alias("a"), F.struct("sx", "after").alias("at"))
    for rows in asked:
        looked = looked.unionByName(rows.distinct().withColumn("at", F.lit(None).cast("struct<sx: bigint, after: bigint>")))
    known = F.last("at", ignorenulls=True).over(W.partitionBy(*keys, "sy").orderBy("sx", F.col("a").isNotNull()).rowsBetween(W.unboundedPreceding, 0))
    looked = looked.withColumn("at", known).where(F.col("a").isNotNull() & (F.col("at").isNull() | (F.col("at.sx") != sx)))
    met = F.when(F.col("at").isNull() | F.col("at.after").isNull(), outer).otherwise(node(1, "sy", "at.sx"))
    edges = _touching(rest, keys, own).unionByName(looked.select("a", met.alias("b")))
    roots = staged(components(edges, ONE_TASK_EDGES).select(F.col("node").alias("_node"), F.col("root.kind").alias("_kind")).where("_kind = 0"), "fill-outside")
    holes = rest.withColumn("_node", own).join(roots, "_node", "left_anti")
    inner = gaps.withColumn("_node", node(1, "sy", "sx")).join(roots, "_node", "left_anti")
    inner = inner.select(*keys, F.explode(F.sequence(sx + 1, F.col("after") - 1)).alias("sx"), "sy").select(*keys, "sx", F.explode(F.sequence(sy * SIDE, sy * SIDE + SIDE - 1)).alias("cy"), F.lit(-1).cast("bigint").alias("bits"))
    return union(source.unionByName(run_strips(holes, keys)).unionByName(inner), keys)


def label_cells(strips: DataFrame, keys: list[str]) -> DataFrame:
    """The same, a row a cell: (keys, cx, cy, label)."""
    return label(strips, keys).select(*keys, F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)).alias("cx"), "cy", "label")


def run_strips(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs (keys, cy, x0, x1), x1 not included, as strips."""
    return of_intervals(runs.withColumn("x1", F.col("x1") - 1), keys)
