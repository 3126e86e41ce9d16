"""Conic map projections of an ellipsoid as columns, both ways."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half axis in metres and flattening of the usual ellipsoid.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563


def _m(phi: float, e2: float) -> float:
    return math.cos(phi) / math.sqrt(1 - e2 * math.sin(phi) ** 2)


def _conformal(phi, e: float, lib=F):
    """The tangent of half the conformal colatitude."""
    s = lib.sin(phi)
    return lib.tan(math.pi / 4 - phi / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2) if lib is math else F.tan(math.pi / 4 - phi / 2) / F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2))


class LambertConformal:
    """Lambert's conformal conic projection on two standard parallels (degrees)."""

    def __init__(self, lat0: float, lon0: float, parallel1: float, parallel2: float, x0: float = 0.0, y0: float = 0.0, a: float = AXIS, f: float = FLATTENING):
        self.lon0, self.x0, self.y0 = lon0, x0, y0
        self.e = math.sqrt(f * (2 - f))
        p0, p1, p2 = map(math.radians, (lat0, parallel1, parallel2))
        m1, m2, t0, t1, t2 = _m(p1, self.e**2), _m(p2, self.e**2), _conformal(p0, self.e, math), _conformal(p1, self.e, math), _conformal(p2, self.e, math)
        self.n = math.sin(p1) if p1 == p2 else math.log(m1 / m2) / math.log(t1 / t2)
        self.scale = a * m1 / (self.n * t1**self.n)
        self.r0 = self.scale * t0**self.n

    def forward(self, lat: Column, lon: Column) -> dict[str, Column]:
        """x and y in metres of a place in degrees."""
        r = self.scale * F.pow(_conformal(F.radians(lat), self.e), F.lit(self.n))
        turn = self.n * F.radians(_within(lon - self.lon0))
        return {"x": self.x0 + r * F.sin(turn), "y": self.y0 + self.r0 - r * F.cos(turn)}

    def inverse(self, x: Column, y: Column) -> dict[str, Column]:
        """Latitude and longitude in degrees of a place in metres."""
        sign = math.copysign(1, self.n)
        dx, dy = (x - self.x0) * sign, (self.r0 - y + self.y0) * sign
        chi = math.pi / 2 - 2 * F.atan(F.pow(F.hypot(dx, dy) / abs(self.scale), F.lit(1 / self.n)))
        e2 = self.e**2
        series = (e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360, 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520, 7 * e2**3 / 120 + 81 * e2**4 / 1120, 4279 * e2**4 / 161280)
        return {"lat": F.degrees(_with_series(chi, series)), "lon": _within(self.lon0 + F.degrees(F.atan2(dx, dy)) / self.n)}


class AlbersEqualArea:
    """Albers' equal area conic projection on two standard parallels (degrees)."""

    def __init__(self, lat0: float, lon0: float, parallel1: float, parallel2: float, x0: float = 0.0, y0: float = 0.0, a: float = AXIS, f: float = FLATTENING):
        self.lon0, self.x0, self.y0, self.a = lon0, x0, y0, a
        self.e = math.sqrt(f * (2 - f))
        p0, p1, p2 = map(math.radians, (lat0, parallel1, parallel2))
        m1, m2, q0, q1, q2 = _m(p1, self.e**2), _m(p2, self.e**2), *(self._area(math.sin(p)) for p in (p0, p1, p2))
        self.n = math.sin(p1) if p1 == p2 else (m1 * m1 - m2 * m2) / (q2 - q1)
        self.c = m1 * m1 + self.n * q1
        self.r0 = a * math.sqrt(self.c - self.n * q0) / self.n

    def _area(self, s: float) -> float:
        return (1 - self.e**2) * (s / (1 - (self.e * s) ** 2) - math.log((1 - self.e * s) / (1 + self.e * s)) / (2 * self.e))

    def forward(self, lat: Column, lon: Column) -> dict[str, Column]:
        """x and y in metres of a place in degrees."""
        s = F.sin(F.radians(lat))
        q = (1 - self.e**2) * (s / (1 - self.e**2 * s * s) - F.ln((1 - self.e * s) / (1 + self.e * s)) / (2 * self.e))
        r = self.a * F.sqrt(self.c - self.n * q) / self.n
        turn = self.n * F.radians(_within(lon - self.lon0))
        return {"x": self.x0 + r * F.sin(turn), "y": self.y0 + self.r0 - r * F.cos(turn)}

    def inverse(self, x: Column, y: Column) -> dict[str, Column]:
        """Latitude and longitude in degrees of a place in metres."""
        sign = math.copysign(1, self.n)
        dx, dy = (x - self.x0) * sign, (self.r0 - y + self.y0) * sign
        r = F.hypot(dx, dy) * self.n / self.a
        e2 = self.e**2
        beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (self.c - r * r) / self.n / self._area(1.0))))
        series = (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360)
        return {"lat": F.degrees(_with_series(beta, series)), "lon": _within(self.lon0 + F.degrees(F.atan2(dx, dy)) / self.n)}


class TransverseMercator:
    """The transverse Mercator projection of ``functions.places``, with false origin."""

    def __init__(self, lon0: float, scale: float = 0.9996, x0: float = 500_000.0, y0: float = 0.0):
        self.lon0, self.scale, self.x0, self.y0 = lon0, scale, x0, y0

    def forward(self, lat: Column, lon: Column) -> dict[str, Column]:
        from .places import transverse_mercator

        p = transverse_mercator(lat, lon, self.lon0, self.scale)
        return {"x": self.x0 + p["easting"], "y": self.y0 + p["northing"]}

    def inverse(self, x: Column, y: Column) -> dict[str, Column]:
        from .places import from_transverse_mercator

        return from_transverse_mercator(x - self.x0, y - self.y0, self.lon0, self.scale)


class Geographic:
    """Degrees as they are: x is the longitude."""

    def forward(self, lat: Column, lon: Column) -> dict[str, Column]:
        return {"x": lon, "y": lat}

    def inverse(self, x: Column, y: Column) -> dict[str, Column]:
        return {"lat": y, "lon": x}


def _with_series(angle: Column, series: tuple[float, ...]) -> Column:
    """An angle with multiples of the sines of its even multiples: a latitude of the sphere as one of the ellipsoid."""
    out = angle
    for k, factor in enumerate(series, 1):
        out = out + factor * F.sin(2 * k * angle)
    return out


def _within(degrees: Column) -> Column:
    """From -180 up to 180 degrees."""
    return F.pmod(degrees + 180, F.lit(360.0)) - 180
