"""Gravity reductions as columns: mGal, metres, degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the reductions.
EQUATOR, SOMIGLIANA, ECCENTRICITY2 = 978032.67715, 0.001931851353, 0.0066943800229
BIG_G, EARTH_RADIUS, CAP = 6.67384e-11, 6371000.0, 166700.0


def theoretical(lat: Column) -> Column:
    """Normal gravity at a latitude."""
    s2 = F.pow(F.sin(F.radians(lat)), F.lit(2))
    return EQUATOR * (1 + SOMIGLIANA * s2) / F.sqrt(1 - ECCENTRICITY2 * s2)


def atmospheric(h: Column) -> Column:
    return 0.874 - 9.9e-5 * h + 3.56e-9 * h * h


def height(lat: Column, h: Column) -> Column:
    """Free-air correction to second order."""
    s2 = F.pow(F.sin(F.radians(lat)), F.lit(2))
    return -(0.308769109 - 0.000439773 * s2) * h + 7.2125e-8 * h * h


def spherical_bouguer(h: Column, density: float) -> Column:
    """Attraction of a spherical cap of the station's height, by the closed form of LaFehr (1991)."""
    alpha = CAP / EARTH_RADIUS
    ca, sa, half = math.cos(alpha), math.sin(alpha), math.sin(alpha / 2)
    d, f, k, m = 3 * ca * ca - 2, ca, sa * sa, -3 * sa * sa * ca
    p, n = -6 * ca * ca * half + 4 * half**3, 2 * (half - half * half)
    r = EARTH_RADIUS + h
    delta, eta = EARTH_RADIUS / r, h / r
    root = F.sqrt((f - delta) * (f - delta) + k)
    mu = eta * eta / 3 - eta
    lam = ((d + f * delta + delta * delta) * root + p + m * F.ln(n / (f - delta + root))) / 3
    return 2 * math.pi * BIG_G * density * 1e5 * (mu * h - lam * r)


def bouguer(observed: Column, lat: Column, h: Column, density: float = 2670.0) -> Column:
    """Bouguer anomaly: observed less theoretical gravity, with the corrections."""
    return observed - theoretical(lat) + atmospheric(h) - height(lat, h) - spherical_bouguer(h, density)


def radius(lat: Column) -> Column:
    """Geocentric radius of the ellipsoid at a latitude in radians, metres."""
    a, b = 6378137.0, 6356752.314245
    c, s = F.cos(lat), F.sin(lat)
    return F.sqrt((a**4 * c * c + b**4 * s * s) / (a * a * c * c + b * b * s * s))
