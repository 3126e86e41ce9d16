"""The geomagnetic field of a spherical-harmonic model at places, and what a survey differs from it.

A model is some two hundred numbers and goes to every task; each place is worked out
where its row is, without a shuffle.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalite.session import ship

# The reference radius in km, and the squared half axes of the ellipsoid.
RADIUS, A2, B2 = 6371.2, 40680631.59, 40408299.98


def coefficients(models: DataFrame, date: float) -> dict[tuple[int, int], tuple[float, float]]:
    """(g, h) by degree and order at a decimal year: between the epochs of two models, or by the rates of the last one.

    A degree that one of two models lacks counts as 0 there. Reads the epochs and at
    most two models, a few hundred rows.
    """
    epochs = sorted(tuple(r) for r in models.select("epoch", "first_year", "last_year", "model", "has_rates").distinct().collect())
    at = sum(e[2] < date for e in epochs)
    if at >= len(epochs):
        raise ValueError(f"no model covers {date}")
    load = lambda model: {(r["n"], r["m"]): r for r in models.where(F.col("model") == model).collect()}
    one = load(epochs[at][3])
    if epochs[at][4]:
        years = date - epochs[at][0]
        return {k: (r["g"] + years * r["g_rate"], r["h"] + years * r["h_rate"]) for k, r in one.items()}
    if at + 1 >= len(epochs):
        raise ValueError(f"no model follows {epochs[at][3]}")
    two, share = load(epochs[at + 1][3]), (date - epochs[at][1]) / (epochs[at + 1][1] - epochs[at][1])
    value = lambda model, k, name: model[k][name] if k in model else 0.0
    return {k: tuple(value(one, k, c) + share * (value(two, k, c) - value(one, k, c)) for c in ("g", "h")) for k in one.keys() | two.keys()}


def synthesis(lat, lon, height, model: dict[tuple[int, int], tuple[float, float]]):
    """North, east and down in nT at geodetic places (degrees, km above the ellipsoid), as arrays."""
    import numpy as np

    lat = np.clip(lat, -89.999, 89.999)
    s, c = np.sin(np.radians(lat)), np.cos(np.radians(lat))
    flat = np.sqrt(A2 * c * c + B2 * s * s)
    r = np.sqrt(height * (height + 2 * flat) + (A2 * A2 * c * c + B2 * B2 * s * s) / (flat * flat))
    turn_c, turn_s = (height + flat) / r, (A2 - B2) / flat * s * c / r
    cos, sin = s * turn_c - c * turn_s, c * turn_c + s * turn_s  # of the geocentric distance from the pole
    degree = max(n for n, _ in model)
    legendre, slope = {(0, 0): np.ones_like(lat)}, {(0, 0): np.zeros_like(lat)}
    none = np.zeros_like(lat)
    north, east, down = none.copy(), none.copy(), none.copy()
    for n in range(1, degree + 1):
        for m in range(n + 1):
            if m == n:
                f = math.sqrt(1 - 0.5 / n) if n > 1 else 1.0
                p, d = legendre[n - 1, n - 1], slope[n - 1, n - 1]
                legendre[n, n], slope[n, n] = f * sin * p, f * (sin * d + cos * p)
            else:
                f, b = math.sqrt(n * n - m * m), math.sqrt(max((n - 1) ** 2 - m * m, 0))
                p, d = legendre[n - 1, m], slope[n - 1, m]
                legendre[n, m] = ((2 * n - 1) * cos * p - b * legendre.get((n - 2, m), none)) / f
                slope[n, m] = ((2 * n - 1) * (cos * d - sin * p) - b * slope.get((n - 2, m), none)) / f
            g, h = model.get((n, m), (0.0, 0.0))
            scale = (RADIUS / r) ** (n + 2)
            cm, sm = np.cos(m * np.radians(lon)), np.sin(m * np.radians(lon))
            north += scale * (g * cm + h * sm) * slope[n, m]
            east += scale * m * (g * sm - h * cm) * legendre[n, m] / sin
            down -= scale * (n + 1) * (g * cm + h * sm) * legendre[n, m]
    return north * turn_c + down * turn_s, east, down * turn_c - north * turn_s


def field(places: DataFrame, model: dict[tuple[int, int], tuple[float, float]], lat: str = "lat", lon: str = "lon", height: str = "height") -> DataFrame:
    """Adds f (nT), inclination and declination (degrees) of the model; heights in metres. Null where a place is."""
    ship(places.sparkSession)

    @F.pandas_udf("north double, east double, down double")
    def at(lat: pd.Series, lon: pd.Series, height: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("north", "east", "down"), synthesis(lat.to_numpy("float64"), lon.to_numpy("float64"), height.to_numpy("float64") / 1000, model), strict=True)))

    known = F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(height).isNotNull()
    b = places.withColumn("_b", F.when(known, at(F.col(lat).cast("double"), F.col(lon).cast("double"), F.col(height).cast("double"))))
    n, e, d = (F.col(f"_b.{c}") for c in ("north", "east", "down"))
    return b.withColumns({"f": F.sqrt(n * n + e * e + d * d), "inclination": F.degrees(F.atan2(d, F.sqrt(n * n + e * e))), "declination": F.degrees(F.atan2(e, n))}).drop("_b")


def anomaly(survey: DataFrame, heights: DataFrame, model: dict[tuple[int, int], tuple[float, float]], value: str = "value") -> DataFrame:
    """The survey on the cells whose height is known, less the model's field there (both: row, col; heights: lat, lon, height)."""
    return field(survey.join(heights, ["row", "col"]), model).withColumn(value, F.col(value) - F.col("f"))
