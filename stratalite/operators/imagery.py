"""Images of sensors: light on slopes, mineral features of spectra, ternary composites."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalite.functions.formula import formula
from stratalite.functions.spectra import upper_hulls
from stratalite.session import written

from .grid import clip_percentiles, norm2, norm255
from .stencil import aspect, derivatives, shade

PLACE = ["row", "col"]


def sun_cosine(dem: DataFrame, azimuth: float, zenith: float, cell: float = 1.0) -> DataFrame:
    """row, col and ``light``: the cosine between the sun (degrees) and the normal of each cell of a height model; null beside a missing height."""
    faced = aspect(dem).select(*PLACE, F.col("value").alias("_faced"))
    d = derivatives(dem, cell, cell).select(*PLACE, F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).alias("_slope"))
    z, a = math.radians(zenith), math.radians(azimuth)
    light = math.cos(z) * F.cos("_slope") + math.sin(z) * F.sin("_slope") * F.cos(a - F.radians("_faced"))
    return d.join(faced, PLACE).select(*PLACE, light.alias("light"))


def light_corrected(cells: DataFrame, dem: DataFrame, azimuth: float, zenith: float, bands: Sequence[str], cell: float = 1.0) -> DataFrame:
    """The bands of ``cells`` (row, col, bands) as on level ground, by the C correction.

    Each band is fitted by a line over the cosine to the sun; with c, its height at 0 over its
    slope, values are multiplied by (cos(zenith) + c) / (cosine + c). Null where the cosine is
    unknown or that divides by zero; a band without a slope (all values alike, one cell)
    has nulls only. One row of sums goes over the driver.
    """
    lit = written(cells.join(sun_cosine(dem, azimuth, zenith, cell), PLACE, "left"), "light")
    fits = [F.try_divide(F.regr_intercept(b, "light"), F.regr_slope(b, "light")).alias(b) for b in bands]
    c = lit.agg(*fits).first()
    top = math.cos(math.radians(zenith))
    out = {b: F.try_divide(F.col(b) * (top + F.lit(c[b])), F.col("light") + F.lit(c[b])) if c[b] is not None else F.lit(None).cast("double") for b in bands}
    return lit.withColumns(out).drop("light")


def _nearest(wavelengths: Sequence[float], at: float) -> int:
    return min(range(len(wavelengths)), key=lambda k: abs(wavelengths[k] - at))


def absorption(spectrum: Column, wavelengths: Sequence[float], low: float, high: float, least: float | None = None, most: float | None = None) -> Column:
    """The absorption between two wavelengths, as struct (depth, wavelength, drop).

    The spectrum (an array) from the band nearest to ``low`` to that nearest to ``high`` is
    divided by its upper hull; the deepest place of the bands strictly between ``least`` and
    ``most`` (by default the same limits), the last of them left out, gives depth and wavelength,
    the first of equally deep ones. ``drop`` is the largest distance below the hull. A
    spectrum that is 0 on average has zeros; a null or incomplete one, nulls.
    """
    first, last = _nearest(wavelengths, low), _nearest(wavelengths, high)
    x = list(wavelengths[first : last + 1])
    inner = [k for k, v in enumerate(x) if (low if least is None else least) < v < (high if most is None else most)]
    if len(inner) < 2:
        raise ValueError("an absorption needs two bands between its limits")
    y = F.slice(spectrum, first + 1, len(x))
    hull = upper_hulls(len(x))(y)
    part = lambda c: F.slice(c, inner[0] + 1, inner[-1] - inner[0])
    quotient = part(F.zip_with(y, hull, lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(1.0))))
    deepest = F.array_min(quotient)
    place = F.element_at(F.array(*[F.lit(float(v)) for v in x[inner[0] : inner[-1]]]), F.array_position(quotient, deepest).cast("int"))
    empty = F.aggregate(y, F.lit(0.0), lambda s, v: s + v) == 0
    known = lambda c: F.when(hull.isNotNull(), F.when(empty, 0.0).otherwise(c))
    return F.struct(known(1 - deepest).alias("depth"), known(place).alias("wavelength"), known(F.array_max(F.zip_with(y, hull, lambda a, b: b - a))).alias("drop"))


def mineral(spectra: DataFrame, wavelengths: Sequence[float], features: Mapping[str, Sequence[float]], ratios: Mapping[str, str], product: Sequence[str], crystallinity: Sequence[str] = (), least_ratio: float | None = 1.0, spectrum: str = "spectrum") -> DataFrame:
    """Adds ``depth`` and ``wavelength`` of a mineral, or its ``ratio``, and ``crystallinity`` if asked for.

    ``features`` are limits of absorptions (two, or four with inner limits) named ``f...``,
    ``ratios`` formulas over wavelengths (``R2200``: the nearest band). ``product`` lists
    formulas over them, thresholds mostly, whose values are multiplied; if the first
    begins with a feature the result is a depth with the wavelength of that feature, else a
    ratio, which is none below ``least_ratio``. A formula of several features compares
    their depths times their drops. What isn't known counts 0, and results of 0 are null.
    """
    names = [n for n in (*features, *ratios) if any(re.search(rf"\b{n}\b", p) for p in (*product, *crystallinity))]
    out = spectra.withColumns({f"_{n}": absorption(F.col(spectrum), wavelengths, *features[n]) for n in names if n in features})
    band = lambda r: F.get(F.col(spectrum), _nearest(wavelengths, float(r[1:]))) if re.fullmatch(r"R\d+", r) else None
    out = out.withColumns({f"_{n}": formula(ratios[n], band) for n in names if n in ratios})

    def result(parts: Sequence[str]) -> Column:
        total = F.lit(1.0)
        for text in parts:
            several = sum(len(re.findall(rf"\b{n}\b", text)) for n in features) > 1

            def value(n: str, several=several) -> Column | None:
                if n not in names:
                    return None
                if n in ratios:
                    return F.col(f"_{n}")
                return F.col(f"_{n}.depth") * F.col(f"_{n}.drop") if several else F.col(f"_{n}.depth")

            each = formula(text, value).cast("double")
            total = total * F.coalesce(F.when(~F.isnan(each), each), F.lit(0.0))
        return total

    found = result(product)
    head = next((n for n in features if re.match(rf"{n}\b", product[0])), None)
    if head is None and least_ratio is not None:
        found = F.when(found >= least_ratio, found).otherwise(0.0)
    out = out.withColumn("_found", F.when(found != 0, found))
    if head is None:
        out = out.withColumn("ratio", F.col("_found"))
    else:
        at = F.col(f"_{head}.wavelength")
        out = out.withColumns({"depth": F.col("_found"), "wavelength": F.when(F.col("_found").isNotNull() & (at != 0), at)})
    if crystallinity:
        order = result(crystallinity)
        out = out.withColumn("crystallinity", F.when(F.col("_found").isNotNull() & (order != 0), order))
    return out.drop("_found", *[f"_{n}" for n in names])


def ternary(cells: DataFrame, bands: tuple[str, str, str] = ("red", "green", "blue"), low: float = 1.0, high: float = 1.0, relief: str | None = None, cell: float = 25.0, alpha: float = 0.0) -> DataFrame:
    """row, col, red, green, blue, alpha (0 to 255) of a composite of three bands, clipped by ``low`` and ``high`` percent and stretched.

    With a ``relief`` column its sunshaded surface darkens the colours. Cells without one of
    the bands are 0 with alpha 1, others at least 1 with alpha 255. A band of one value
    only counts as without.
    """
    out = cells
    for b in bands:
        out = norm255(clip_percentiles(out, low, high, b), b)
    known = out[bands[0]].isNotNull() & out[bands[1]].isNotNull() & out[bands[2]].isNotNull()
    light: Column = F.lit(1.0)
    if relief is not None:
        shaded = norm2(shade(cells.select(*PLACE, F.col(relief).alias("value")), cell, alpha=alpha)).select(*PLACE, F.col("value").alias("_light"))
        out, light = out.join(shaded, PLACE, "left"), F.coalesce("_light", F.lit(0.0))
    colour = lambda b: F.when(known, F.greatest(F.floor(F.col(b) * light), F.lit(1))).otherwise(0).cast("int")
    return out.select(*PLACE, *[colour(b).alias(n) for b, n in zip(bands, ("red", "green", "blue"), strict=True)], F.when(known, 255).otherwise(1).alias("alpha"))
