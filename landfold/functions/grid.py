"""Tile-grid and projection arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The Web-Mercator half span in metres and the latitude limit of square tiles.
HALF_SPAN = 20037508.342789244
MAX_LATITUDE = 85.05112878
TILE_PIXELS = 256


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def tile_fraction(lon, lat, z) -> tuple[Column, Column]:
    """Column and row of a point in tiles, with fractions; latitudes beyond the grid are clamped."""
    n = F.pow(F.lit(2.0), _c(z))
    rad = F.radians(F.greatest(F.least(_c(lat), F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE)))
    return (_c(lon) + 180) / 360 * n, (1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * n


def tile_range(minx, miny, maxx, maxy, z) -> Column:
    """Tiles that a box of degrees touches: x_min, x_max, y_min, y_max."""
    (x0, y0), (x1, y1) = tile_fraction(minx, maxy, z), tile_fraction(maxx, miny, z)
    return F.struct(*[F.floor(v).cast("bigint").alias(k) for k, v in (("x_min", x0), ("x_max", x1), ("y_min", y0), ("y_max", y1))])


def tile_count(span: Column) -> Column:
    return (span.x_max - span.x_min + 1) * (span.y_max - span.y_min + 1)


def tile_bounds_mercator(z, x, y) -> Column:
    """Metres: minx, miny, maxx, maxy."""
    size = F.lit(2 * HALF_SPAN) / F.pow(F.lit(2.0), _c(z))
    minx, maxy = _c(x) * size - HALF_SPAN, HALF_SPAN - _c(y) * size
    return F.struct(minx.alias("minx"), (maxy - size).alias("miny"), (minx + size).alias("maxx"), maxy.alias("maxy"))


def tile_bounds_degrees(z, x, y) -> Column:
    n = F.pow(F.lit(2.0), _c(z))
    lat = lambda row: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * row / n))))
    return F.struct((_c(x) / n * 360 - 180).alias("minx"), lat(_c(y) + 1).alias("miny"), ((_c(x) + 1) / n * 360 - 180).alias("maxx"), lat(_c(y)).alias("maxy"))


def pixel_size(z) -> Column:
    """Metres of one pixel of a tile."""
    return F.lit(2 * HALF_SPAN) / F.pow(F.lit(2.0), _c(z)) / TILE_PIXELS


def pixel_area(z) -> Column:
    """At least 0.01 square metres."""
    return F.greatest(pixel_size(z) * pixel_size(z), F.lit(0.01))


def is_tile(z, x, y) -> Column:
    n = F.pow(F.lit(2.0), _c(z))
    return (_c(x) >= 0) & (_c(x) < n) & (_c(y) >= 0) & (_c(y) < n)


def sliding_positions(length, patch, stride) -> Column:
    """Starts of patches along a length; the last one lies flush with the end."""
    length, patch, stride = _c(length), _c(patch), _c(stride)
    steps = F.sequence(F.lit(0).cast("bigint"), (length - patch).cast("bigint"), stride.cast("bigint"))
    return F.when(length <= patch, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_union(steps, F.array((length - patch).cast("bigint"))))


def inference_offsets(length, size, overlap) -> Column:
    """Starts of tiles with a margin on both sides (stride size - 2 * overlap); strictly inside, and the last one flush."""
    length, size, stride = _c(length), _c(size), _c(size) - _c(overlap) * 2
    checked = F.when(stride <= 0, F.raise_error(F.lit("twice the overlap must be less than the size"))).otherwise(stride).cast("bigint")
    steps = F.filter(F.sequence(F.lit(0).cast("bigint"), F.greatest(length - size, F.lit(0)).cast("bigint"), checked), lambda v: v + size < length)
    return F.when(length <= size, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_union(steps, F.array((length - size).cast("bigint"))))


def windows(rasters: DataFrame, offsets, size: str) -> DataFrame:
    """One row per window of each raster (raster, width, height, size), numbered in row-major order."""
    rows = rasters.withColumns({"row_offsets": offsets("height"), "col_offsets": offsets("width")})
    rows = rows.select("raster", "width", "height", size, F.size("col_offsets").alias("per_row"), "col_offsets", F.posexplode("row_offsets").alias("i", "y0"))
    rows = rows.select("raster", "width", "height", size, "per_row", "i", "y0", F.posexplode("col_offsets").alias("j", "x0"))
    return rows.select("raster", (F.col("i") * F.col("per_row") + F.col("j")).cast("bigint").alias("index"), "y0", F.least(F.col("y0") + F.col(size), F.col("height")).alias("y1"), "x0", F.least(F.col("x0") + F.col(size), F.col("width")).alias("x1"))


def slide_crops(length, crop, stride) -> Column:
    """Starts of crops on a ceiling grid, those over the edge shifted back."""
    length, crop, stride = _c(length), _c(crop), _c(stride)
    n = F.greatest(F.ceil((length - crop) / stride), F.lit(0)).cast("bigint")
    return F.transform(F.sequence(F.lit(0).cast("bigint"), n), lambda k: F.greatest(F.lit(0), F.least(k * stride, length - crop)).cast("bigint"))


def utm_epsg(lon, lat) -> Column:
    zone = F.least(F.floor((_c(lon) + 180) / 6) + 1, F.lit(60))
    return (F.when(_c(lat) >= 0, 32600).otherwise(32700) + zone).cast("int")


def project_mercator(lon, lat) -> tuple[Column, Column]:
    rad = F.radians(F.greatest(F.least(_c(lat), F.lit(MAX_LATITUDE)), F.lit(-MAX_LATITUDE)))
    return _c(lon) / 180 * HALF_SPAN, F.log(F.tan(math.pi / 4 + rad / 2)) / math.pi * HALF_SPAN


def unproject_mercator(x, y) -> tuple[Column, Column]:
    return _c(x) / HALF_SPAN * 180, F.degrees(2 * F.atan(F.exp(_c(y) / HALF_SPAN * math.pi)) - math.pi / 2)


#: The ellipsoid, the scale on a zone's central meridian, and the offsets of its coordinates.
_A, _F, UTM_SCALE, UTM_EAST, UTM_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0
_N, _E = _F / (2 - _F), math.sqrt(_F * (2 - _F))
#: The rectifying radius, and the coefficients of the Krüger series to the fourth order in the third flattening: forward,
#: inverse, and from the conformal latitude to the latitude. What is left out is less than a micrometre.
UTM_RADIUS = UTM_SCALE * _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
UTM_FORWARD = (_N / 2 - 2 / 3 * _N**2 + 5 / 16 * _N**3 + 41 / 180 * _N**4, 13 / 48 * _N**2 - 3 / 5 * _N**3 + 557 / 1440 * _N**4, 61 / 240 * _N**3 - 103 / 140 * _N**4, 49561 / 161280 * _N**4)
UTM_INVERSE = (_N / 2 - 2 / 3 * _N**2 + 37 / 96 * _N**3 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 / 1440 * _N**4, 17 / 480 * _N**3 - 37 / 840 * _N**4, 4397 / 161280 * _N**4)
UTM_LATITUDE = (2 * _N - 2 / 3 * _N**2 - 2 * _N**3 + 116 / 45 * _N**4, 7 / 3 * _N**2 - 8 / 5 * _N**3 - 227 / 45 * _N**4, 56 / 15 * _N**3 - 136 / 35 * _N**4, 4279 / 630 * _N**4)


def _series(factors: tuple, first, second, a: Column, b: Column) -> Column:
    total = F.lit(0.0)
    for k, f in enumerate(factors, 1):
        total = total + f * first(2 * k * a) * second(2 * k * b)
    return total


def _let(values: dict[str, Column], then) -> Column:
    """What an expression makes of values that are worked out once, however often it names them."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), then), 0)


def project_utm(lon, lat, epsg) -> tuple[Column, Column]:
    """East and north in a zone (326zz or 327zz), in metres."""

    def place(v: Column) -> Column:
        spread = lambda w: _let({"xi": F.atan2(w.t, F.cos(w.away)), "eta": F.asinh(F.sin(w.away) / F.sqrt(w.t * w.t + F.cos(w.away) * F.cos(w.away)))}, lambda u: F.struct(
            (UTM_EAST + UTM_RADIUS * (u.eta + _series(UTM_FORWARD, F.cos, F.sinh, u.xi, u.eta))).alias("x"),
            (UTM_RADIUS * (u.xi + _series(UTM_FORWARD, F.sin, F.cosh, u.xi, u.eta)) + w.south).alias("y")))
        sine = lambda w: {"t": F.sinh(F.atanh(w.sine) - _E * F.atanh(_E * w.sine)), "away": w.away, "south": w.south}
        first = {"sine": F.sin(F.radians(v.lat)), "away": F.radians(v.lon - (v.epsg % 100 * 6 - 183)), "south": F.when(F.floor(v.epsg / 100) == 327, UTM_NORTH).otherwise(0.0)}
        return _let(first, lambda w: _let(sine(w), spread))

    found = _let({"lon": _c(lon), "lat": _c(lat), "epsg": _c(epsg)}, place)
    return found.x, found.y


def unproject_utm(x, y, epsg) -> tuple[Column, Column]:
    def place(v: Column) -> Column:
        scaled = {"eta": (v.x - UTM_EAST) / UTM_RADIUS, "xi": (v.y - F.when(F.floor(v.epsg / 100) == 327, UTM_NORTH).otherwise(0.0)) / UTM_RADIUS}
        true = lambda w: {"a": w.xi - _series(UTM_INVERSE, F.sin, F.cosh, w.xi, w.eta), "b": w.eta - _series(UTM_INVERSE, F.cos, F.sinh, w.xi, w.eta)}

        def degrees(w: Column) -> Column:
            conformal = {"c": F.asin(F.sin(w.a) / F.cosh(w.b)), "lon": v.epsg % 100 * 6 - 183 + F.degrees(F.atan2(F.sinh(w.b), F.cos(w.a)))}
            return _let(conformal, lambda u: F.struct(u.lon.alias("x"), F.degrees(u.c + _series(UTM_LATITUDE, F.sin, lambda _: F.lit(1.0), u.c, u.c)).alias("y")))

        return _let(scaled, lambda w: _let(true(w), degrees))

    found = _let({"x": _c(x), "y": _c(y), "epsg": _c(epsg)}, place)
    return found.x, found.y


def reproject(x, y, source, target) -> tuple[Column, Column]:
    """Between 4326 (degrees), 3857 and the UTM zones, given by number; NULL for any other system."""
    zone = lambda c: F.floor(c / 100).isin(326, 327) & (c % 100).between(1, 60)
    pick = lambda of, ways: F.when(of == 4326, ways[0]).when(of == 3857, ways[1]).when(zone(of), ways[2])

    def place(v: Column) -> Column:
        from_mercator, from_utm = unproject_mercator(v.x, v.y), unproject_utm(v.x, v.y, v.source)
        degrees = {n: pick(v.source, (o, from_mercator[k], from_utm[k])) for k, (n, o) in enumerate((("lon", v.x), ("lat", v.y)))}

        def onward(w: Column) -> Column:
            to_mercator, to_utm = project_mercator(w.lon, w.lat), project_utm(w.lon, w.lat, v.target)
            return F.struct(*[F.when(v.source == v.target, own).otherwise(pick(v.target, (g, to_mercator[k], to_utm[k]))).alias(n) for k, (n, own, g) in enumerate((("x", v.x, w.lon), ("y", v.y, w.lat)))])

        return _let(degrees, onward)

    found = _let({"x": _c(x).cast("double"), "y": _c(y).cast("double"), "source": _c(source), "target": _c(target)}, place)
    return found.x, found.y


def zoom_for(metres_per_pixel, low: int = 0, high: int = 22) -> Column:
    """The zoom whose pixels come nearest, within limits."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.round(F.log2(F.lit(2 * HALF_SPAN / TILE_PIXELS) / _c(metres_per_pixel)))))


def min_object_pixels(explicit, area, area_of_pixel, default: int = 1) -> Column:
    """Explicit, else the area in pixels rounded up, else a default; at least 1."""
    return F.greatest(F.coalesce(_c(explicit), F.ceil(_c(area) / _c(area_of_pixel)), F.lit(default)), F.lit(1)).cast("bigint")
