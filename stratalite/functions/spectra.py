"""Spectra as arrays: angles, correlation, continuum removal."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def spectral_angle(a: Column, b: Column) -> Column:
    """Angle between two spectra, 0 if one is zero."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.acos(F.least(F.greatest(F.try_divide(dot(a, b), n), F.lit(-1.0)), F.lit(1.0))))


def spectral_correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two spectra, -1 if one doesn't vary."""
    centre = lambda v: F.transform(v.cast("array<double>"), lambda x: x - F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, y: s + y) / F.size(v))
    p, q = centre(a), centre(b)
    n = F.sqrt(dot(p, p) * dot(q, q))
    return F.when(n == 0, F.lit(-1.0)).otherwise(F.try_divide(dot(p, q), n))


def hull_quotients(wavelengths: list[float]):
    """A vectorised function: spectra over their upper convex hull (1 on the hull)."""

    @F.pandas_udf("array<double>")
    def removed(spectra: pd.Series) -> pd.Series:
        import numpy as np

        x = np.asarray(wavelengths, float)

        def one(s):
            if s is None:
                return None
            y, hull = np.asarray(s, float), []
            for k in range(len(x)):
                while len(hull) > 1 and (y[k] - y[hull[-2]]) * (x[hull[-1]] - x[hull[-2]]) >= (y[hull[-1]] - y[hull[-2]]) * (x[k] - x[hull[-2]]):
                    hull.pop()
                hull.append(k)
            top = np.interp(x, x[hull], y[hull])
            return np.where(top != 0, y / np.where(top == 0, 1, top), 1.0).tolist()

        return spectra.map(one)

    return removed


def sensor_reflectance(dn: Column, scale: float, offset: float, nodata: float | None = 0) -> Column:
    """Scaled numbers of a sensor; its sign for nothing is null."""
    value = dn * scale + offset
    return value if nodata is None else F.when(dn != nodata, value)


def brightness_temperature(dn: Column, mult: float, add: float, k1: float, k2: float) -> Column:
    """Kelvin, from thermal numbers by radiance and Planck's law."""
    return k2 / F.ln(k1 / (dn * mult + add) + 1)


def upper_hulls(count: int):
    """A vectorised function: the upper convex hull of spectra of ``count`` values at equal steps; null for a null, or where a value is missing."""

    @F.pandas_udf("array<double>")
    def hulls(spectra: pd.Series) -> pd.Series:
        import numpy as np

        def one(s):
            if s is None or len(s) != count or np.isnan(y := np.asarray(s, float)).any():
                return None
            hull = [0]
            while hull[-1] < count - 1:  # the steepest way on; of equally steep ones the nearest
                rest = np.arange(hull[-1] + 1, count)
                hull.append(int(rest[np.argmax((y[rest] - y[hull[-1]]) / (rest - hull[-1]))]))
            return np.interp(np.arange(count), hull, y[hull]).tolist()

        return spectra.map(one)

    return hulls
