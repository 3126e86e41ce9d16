"""Names of map sheets, zones, bounds, bits, indices and fault planes, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sheet_bounds(sheet: Column) -> dict[str, Column]:
    """west, south, east, north of a South African map sheet: latitude and longitude, then up to two quadrants A to D; null if it is no name."""
    known = F.upper(sheet).rlike("^[0-9]{4}([A-D][A-D]?)?$")
    number = lambda at: F.when(known, F.try_to_number(F.substring(sheet, at, 2), F.lit("99")).cast("double"))
    quadrant = lambda at: F.upper(F.substring(sheet, at, 1))
    down = lambda at, size: F.when(quadrant(at).isin("C", "D"), size).otherwise(0.0)
    right = lambda at, size: F.when(quadrant(at).isin("B", "D"), size).otherwise(0.0)
    length = F.length(sheet)
    high = F.when(length > 5, 0.25).when(length > 4, 0.5).otherwise(1.0)
    wide = F.when(length > 5, 0.25).when(length > 4, 0.5).otherwise(2.0)
    north, west = -(number(1) + down(5, 0.5) + down(6, 0.25)), number(3) + right(5, 0.5) + right(6, 0.25)
    return {"west": west, "south": north - high, "east": west + wide, "north": north}


def utm_to_south(epsg: Column, northing: Column) -> dict[str, Column]:
    """Northern UTM zones (32600 to 32660) as southern ones, with ten million metres more; others as they are."""
    northern = epsg.between(32600, 32660)
    return {"epsg": F.when(northern, epsg + 100).otherwise(epsg), "northing": F.when(northern, northing + 1e7).otherwise(northing)}


def transverse_mercator(lat: Column, lon: Column, meridian: float | Column, scale: float = 0.9996, a: float = 6378137.0, f: float = 1 / 298.257223563) -> dict[str, Column]:
    """easting and northing in metres from the meridian and the equator, by Krueger's series to the third order (millimetres within a zone)."""
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3]
    e = 2 * math.sqrt(n) / (1 + n)
    s, d = F.sin(F.radians(lat)), F.radians(lon - meridian)
    t = F.sinh(_atanh(s) - e * _atanh(e * s))
    xi, eta = F.atan2(t, F.cos(d)), _atanh(F.sin(d) / F.sqrt(1 + t * t))
    east = north = F.lit(0.0)
    for k, factor in enumerate(alpha, 1):
        east, north = east + factor * F.cos(2 * k * xi) * F.sinh(2 * k * eta), north + factor * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
    return {"easting": scale * radius * (eta + east), "northing": scale * radius * (xi + north)}


def from_transverse_mercator(easting: Column, northing: Column, meridian: float | Column, scale: float = 0.9996, a: float = 6378137.0, f: float = 1 / 298.257223563) -> dict[str, Column]:
    """Latitude and longitude in degrees of the place that ``transverse_mercator`` sends there."""
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3, n**2 / 48 + n**3 / 15, 17 / 480 * n**3]
    delta = [2 * n - 2 / 3 * n**2 - 2 * n**3, 7 / 3 * n**2 - 8 / 5 * n**3, 56 / 15 * n**3]
    xi, eta = northing / (scale * radius), easting / (scale * radius)
    x, y = xi, eta
    for k, factor in enumerate(beta, 1):
        x, y = x - factor * F.sin(2 * k * xi) * F.cosh(2 * k * eta), y - factor * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for k, factor in enumerate(delta, 1):
        lat = lat + factor * F.sin(2 * k * chi)
    return {"lat": F.degrees(lat), "lon": meridian + F.degrees(F.atan2(F.sinh(y), F.cos(x)))}


def _atanh(x: Column) -> Column:
    return 0.5 * F.ln((1 + x) / (1 - x))


def plane_of_normal(north: Column, east: Column, up: Column) -> dict[str, Column]:
    """strike (0 to 360) and dip in degrees of the plane with a normal, which is turned upwards first."""
    turn = F.when(up < 0, -1.0).otherwise(1.0)
    n, e, u = north * turn, east * turn, up * turn
    return {"strike": F.pmod(F.degrees(F.atan2(e, n)) - 90, F.lit(360.0)), "dip": F.degrees(F.atan2(F.sqrt(n * n + e * e), u))}


def auxiliary_plane(strike: Column, dip: Column, rake: Column) -> dict[str, Column]:
    """strike, dip and rake in degrees of the second nodal plane, whose normal is the slip in the first one.

    The slip is turned upwards first, as for ``plane_of_normal``, so that no rake but one of level slip is negative.
    """
    s, d, r = F.radians(strike + 90), F.radians(dip), F.radians(rake)
    east = -F.cos(r) * F.cos(s) - F.sin(r) * F.sin(s) * F.cos(d)
    north = F.cos(r) * F.sin(s) - F.sin(r) * F.cos(s) * F.cos(d)
    up = F.sin(r) * F.sin(d)
    turn = F.when(up < 0, -1.0).otherwise(1.0)
    along = turn * (east * F.cos(s) * F.sin(d) - north * F.sin(s) * F.sin(d)) / F.sqrt(north * north + east * east)
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), along))))
    return plane_of_normal(north, east, up) | {"rake": F.when(up != 0, angle).otherwise(-angle)}


def distance_to_segment(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a place from a segment; from its point if it has no length."""
    dx, dy = x2 - x1, y2 - y1
    along = F.coalesce(F.try_divide((x - x1) * dx + (y - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.hypot(x - (x1 + t * dx), y - (y1 + t * dy))


def bit_is_set(value: Column, place: int) -> Column:
    return value.bitwiseAND(F.lit(1 << place)) != 0


def with_bit(value: Column, place: int) -> Column:
    return value.bitwiseOR(F.lit(1 << place))


def cell_index(row: Column, col: Column, layer: Column, rows: int, cols: int) -> Column:
    """A voxel's number, rows first, then columns, then layers."""
    return layer * (rows * cols) + col * rows + row


def cell_place(index: Column, rows: int, cols: int) -> dict[str, Column]:
    """row, col and layer of a voxel's number."""
    return {"row": index % rows, "col": F.floor(index / rows) % cols, "layer": F.floor(index / (rows * cols))}


def next_power(n: Column) -> Column:
    """The least k with 2 ** k >= n."""
    return F.ceil(F.round(F.log2(n), 12)).cast("int")


def overlaps(left: Column, bottom: Column, right: Column, top: Column, bounds: tuple[float, float, float, float]) -> Column:
    """Whether a box shares more than an edge with ``bounds`` (left, bottom, right, top)."""
    return (F.lit(bounds[0]) < right) & (F.lit(bounds[2]) > left) & (F.lit(bounds[1]) < top) & (F.lit(bounds[3]) > bottom)
