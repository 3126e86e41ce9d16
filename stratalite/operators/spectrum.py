"""Filters in the frequency domain, on rasters of any size.

A raster is a table of lines: ``at`` (the row) and an array of its values. Work along
rows is done line by line; ``across`` turns rows into columns, one shuffle of the
cells. A two-dimensional transform is one along rows, a turn, and one along columns,
so that a task holds lines, never the raster.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalite.session import settled, ship


def across(lines: DataFrame, arrays: list[str]) -> DataFrame:
    """Columns as lines: ``at`` is the place in the arrays, whose values come in the order of the rows' ``at``."""
    cells = lines.select("at", F.posexplode(F.arrays_zip(*arrays)).alias("_to", "_v"))
    turned = cells.groupBy("_to").agg(F.array_sort(F.collect_list(F.struct("at", "_v"))).alias("_l"))
    return turned.select(F.col("_to").alias("at"), *[F.col(f"_l._v.{n}").alias(n) for n in arrays])


def _each(lines: DataFrame, f: Callable, out: list[str]) -> DataFrame:
    """``f(at, *arrays)`` of every line gives the arrays of ``out``."""
    import numpy as np
    import pandas as pd

    ship(lines.sparkSession)
    names = [n for n in lines.columns if n != "at"]

    def run(batches):
        for batch in batches:
            made = [f(at, *[np.asarray(v, "float64") for v in arrays]) for at, *arrays in batch[["at", *names]].itertuples(index=False)]
            yield pd.DataFrame({"at": batch["at"], **{n: pd.Series([m[i] for m in made], dtype=object) for i, n in enumerate(out)}})

    return lines.mapInPandas(run, "at int, " + ", ".join(f"{n} array<double>" for n in out))


def _filled(z):
    """A line with its gaps interpolated and its ends zero; 0 is no value."""
    import numpy as np

    known = ~np.isnan(z)
    places = np.arange(len(z))
    full = np.interp(places, places[known], z[known])
    full[full == 0] = np.nan
    return full


def _mean(a, b):
    import numpy as np

    return np.where(np.isnan(a), b, np.where(np.isnan(b), a, (a + b) / 2))


def _edged(z, whole: bool):
    """The line with its ends zero, or all of it."""
    out = z.copy()
    out[:: 1 if whole or len(z) < 2 else len(z) - 1] = 0
    return out


def taper(n: int):
    """Tukey's window of n places, half of them cosine."""
    import numpy as np

    if n < 2:
        return np.ones(n)
    x = np.minimum(np.arange(n), np.arange(n)[::-1]) / (n - 1)
    return np.where(x < 0.25, 0.5 * (1 - np.cos(4 * math.pi * x)), 1.0)


def prepared(cells: DataFrame, middle: float, rows: tuple[int, int], cols: tuple[int, int], value: str = "value") -> DataFrame:
    """The raster less ``middle``, in a frame of half its size that falls to zero, gaps filled, and tapered: lines ``at``, ``re``.

    A gap takes the mean of what its row and its column interpolate, twice over, so
    that the frame's corners follow from its sides; what is still unknown is 0.
    """
    import numpy as np

    nr, nc = rows[1] - rows[0] + 1, cols[1] - cols[0] + 1
    pr, pc = nr // 2, nc // 2
    high, wide = nr + 2 * pr, nc + 2 * pc
    known = cells.where(F.col(value).isNotNull()).groupBy((F.col("row") - rows[0] + pr).cast("int").alias("at")).agg(F.collect_list(F.struct((F.col("col") - cols[0] + pc).cast("int").alias("c"), F.col(value).cast("double").alias("v"))).alias("l"))
    every = cells.sparkSession.range(high).select(F.col("id").cast("int").alias("at"))
    known = every.join(known, "at", "left").select("at", F.coalesce(F.transform("l", lambda x: x["c"].cast("double")), F.array().cast("array<double>")).alias("c"), F.coalesce(F.transform("l", lambda x: x["v"]), F.array().cast("array<double>")).alias("v"))

    def by_row(at, c, v):
        z = np.full(wide, np.nan)
        z[c.astype(int)] = v - middle
        z = _edged(z, at in (0, high - 1))
        return z, _filled(z)

    def by_column(at, z, h):
        z = _edged(z, at in (0, wide - 1))
        z = np.where(np.isnan(z), _mean(h, _filled(z)), z)
        z = _edged(z, at in (0, wide - 1))
        return z, _filled(z)

    def by_row_again(at, z, v):
        z = np.where(np.isnan(z), _mean(_filled(z), v), z)
        return (np.nan_to_num(z) * taper(wide) * taper(high)[at],)

    first = _each(known, by_row, ["z", "h"])
    second = _each(across(first, ["z", "h"]), by_column, ["z", "v"])
    return _each(across(second, ["z", "v"]), by_row_again, ["re"])


def filtered(cells: DataFrame, response: Callable, dx: float = 1.0, dy: float = 1.0, value: str = "value", keep_level: bool = True) -> DataFrame:
    """The cells with ``value`` after the response of wavenumbers (kx, ky, radians; ky counted upwards) is applied; gaps stay gaps.

    ``keep_level`` adds the raster's median again. A raster of one row or column has no
    frame to fall to zero in and is refused; one without values gives no cells.
    """
    import numpy as np

    from .stats import medians

    known = cells.where(F.col(value).isNotNull()).select("row", "col", F.col(value).cast("double").alias(value))
    r0, r1, c0, c1 = cells.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    middle = medians(known.select(F.lit("v").alias("band"), F.col(value).alias("value"))).get("v")
    if middle is None:
        return known
    if r0 == r1 or c0 == c1:
        raise ValueError("a raster of one row or column has no two-dimensional spectrum")
    nr, nc = r1 - r0 + 1, c1 - c0 + 1
    high, wide = nr + 2 * (nr // 2), nc + 2 * (nc // 2)
    kx, ky = np.fft.fftfreq(wide, dx) * 2 * math.pi, -np.fft.fftfreq(high, dy) * 2 * math.pi

    def forward(at, z):
        f = np.fft.fft(z)
        return f.real, f.imag

    def answered(at, re, im):
        f = np.fft.ifft(np.fft.fft(re + 1j * im) * response(np.full(high, kx[at]), ky))
        return f.real, f.imag

    def backward(at, re, im):
        return (np.fft.ifft(re + 1j * im).real[nc // 2 : nc // 2 + nc],)

    spectrum = _each(across(_each(prepared(known, middle, (r0, r1), (c0, c1), value), forward, ["re", "im"]), ["re", "im"]), answered, ["re", "im"])
    back = _each(across(spectrum, ["re", "im"]).where(F.col("at").between(nr // 2, nr // 2 + nr - 1)), backward, ["z"])
    out = settled(back).select((F.col("at") - nr // 2 + r0).cast("int").alias("row"), F.posexplode("z").alias("_c", "_z"))
    out = out.select("row", (F.col("_c") + c0).cast("int").alias("col"), (F.col("_z") + (middle if keep_level else 0.0)).alias("_z"))
    return known.join(out, ["row", "col"]).withColumn(value, F.col("_z")).drop("_z")


def upward(cells: DataFrame, height: float, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """The field continued upwards by ``height``."""

    def response(kx, ky):
        import numpy as np

        return np.exp(-np.hypot(kx, ky) * height)

    return filtered(cells, response, dx, dy)


def vertical_derivative(cells: DataFrame, order: float = 1.0, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """The vertical derivative of an order, without the level."""

    def response(kx, ky):
        import numpy as np

        return np.hypot(kx, ky) ** order

    return filtered(cells, response, dx, dy, keep_level=False)


def downward(cells: DataFrame, depth: float, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """The field continued downwards by ``depth``: its Taylor series to the third derivative, as one response beside the cells."""

    def response(kx, ky):
        import numpy as np

        k = np.hypot(kx, ky) * depth
        return k + k**2 / 2 + k**3 / 6

    change = filtered(cells, response, dx, dy, keep_level=False).withColumnRenamed("value", "_change")
    return cells.where("value IS NOT NULL").join(change, ["row", "col"]).withColumn("value", F.col("value") + F.col("_change")).drop("_change")


def edge_derivative(cells: DataFrame, order: float = 1.0, step: float = 1.0) -> DataFrame:
    """The vertical derivative of an order, the raster set in a square of a power of two and its edges repeated outwards; less the median first.

    Cells that are null, or missing from the rectangle of the others, count as the
    median, and get a value too. A raster without values gives no rows.
    """
    import numpy as np

    from .stats import medians

    known = cells.select("row", "col", F.col("value").cast("double").alias("value"))
    r0, r1, c0, c1 = known.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    middle = medians(known.select(F.lit("v").alias("band"), "value")).get("v")
    if middle is None:
        return known.where("false")
    nr, nc = r1 - r0 + 1, c1 - c0 + 1
    n = 1 << (max(nr, nc) - 1).bit_length()
    top, left = (n - nr) // 2, (n - nc) // 2
    wave = np.fft.fftfreq(n) * n * (2 * math.pi / (step * (n - 1))) if n > 1 else np.zeros(1)
    held = known.where("value IS NOT NULL").groupBy((F.col("row") - r0).cast("int").alias("_row")).agg(F.collect_list(F.struct((F.col("col") - c0).cast("int").alias("c"), F.col("value").alias("v"))).alias("l"))
    every = cells.sparkSession.range(n).select(F.col("id").cast("int").alias("at"), F.least(F.greatest(F.col("id") - top, F.lit(0)), F.lit(nr - 1)).cast("int").alias("_row"))
    nothing = F.array().cast("array<double>")
    lines = every.join(held, "_row", "left").select("at", F.coalesce(F.transform("l", lambda x: x["c"].cast("double")), nothing).alias("c"), F.coalesce(F.transform("l", lambda x: x["v"]), nothing).alias("v"))

    def forward(at, c, v):
        z = np.zeros(nc)
        z[c.astype(int)] = v - middle
        f = np.fft.fft(np.pad(z, (left, n - left - nc), "edge"))
        return f.real, f.imag

    def answered(at, re, im):
        f = np.fft.ifft(np.fft.fft(re + 1j * im) * np.hypot(wave[at], wave) ** order)
        return f.real, f.imag

    def backward(at, re, im):
        return (np.fft.ifft(re + 1j * im).real[left : left + nc],)

    spectrum = _each(across(_each(lines, forward, ["re", "im"]), ["re", "im"]), answered, ["re", "im"])
    back = settled(_each(across(spectrum, ["re", "im"]).where(F.col("at").between(top, top + nr - 1)), backward, ["z"]))
    return back.select((F.col("at") - top + r0).cast("int").alias("row"), F.posexplode("z").alias("_c", "value")).select("row", (F.col("_c") + c0).cast("int").alias("col"), "value")


def tilt_angles(cells: DataFrame, azimuth: float = 0.0, smooth: int = 0, factor: float = 2.0) -> DataFrame:
    """Edge maps of a field (row, col, value): tilt, hyperbolic, second, directional, total, horizontal, enhanced; null where an angle is of nothing.

    ``azimuth`` in degrees from east for the directional tilt; ``smooth`` an odd window
    whose mean is taken first, its border lost; ``factor`` that of the enhanced amplitude.
    Null cells count as half way between the extremes. The hyperbolic tilt exists below a
    ratio of one; the second order tilt is that of the tilt's mean over 3 x 3 cells (or
    the window), zeros around.
    """
    from .stencil import box_mean, derivatives
    from .grid import with_stats

    c = with_stats(cells.select("row", "col", F.col("value").cast("double").alias("value")), _a=F.min("value"), _b=F.max("value"))
    c = c.select("row", "col", F.coalesce("value", (F.col("_a") + F.col("_b")) / 2).alias("value"))
    c = settled(box_mean(c, smooth // 2) if smooth > 1 else c)
    a = math.radians(azimuth)
    length = lambda *x: F.sqrt(sum((v * v for v in x[1:]), x[0] * x[0]))
    rise = lambda df: edge_derivative(df).withColumnRenamed("value", "dz")
    first = settled(derivatives(c).join(rise(c), ["row", "col"]).withColumn("flat", length(F.col("dx"), F.col("dy"))))
    ratio = F.try_divide("dz", "flat")
    along, over = F.col("dx") * math.cos(a) + F.col("dy") * math.sin(a), F.col("dx") * math.cos(a + math.pi / 2) + F.col("dy") * math.sin(a + math.pi / 2)
    maps = first.select(
        "row", "col", F.atan(ratio).alias("tilt"), F.when(F.abs(ratio) < 1, F.atanh(ratio)).alias("hyperbolic"),
        F.atan(F.try_divide(along, length(over, F.col("dz")))).alias("directional"), F.atan(F.try_divide(F.col("flat"), F.abs("dz"))).alias("total"),
    )
    radius = max(smooth, 3) // 2
    size = (2 * radius + 1) ** 2
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    spread = maps.select("row", "col", "tilt", F.explode(steps).alias("i")).select("row", "col", "tilt", "i", F.explode(steps).alias("j"))
    near = spread.groupBy((F.col("row") + F.col("i")).alias("row"), (F.col("col") + F.col("j")).alias("col")).agg((F.sum("tilt") / size).alias("value"))
    mean = settled(maps.select("row", "col").join(near, ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(0.0))))
    second = derivatives(mean).join(rise(mean), ["row", "col"]).select("row", "col", F.atan(F.try_divide(F.col("dz"), length(F.col("dx"), F.col("dy")))).alias("second"))
    slope = first.select("row", "col", F.col("flat").alias("value"))
    third = derivatives(slope).join(rise(slope), ["row", "col"])
    flat, whole = length(F.col("dx"), F.col("dy")), length(F.col("dx"), F.col("dy"), F.col("dz"))
    share = factor * (F.try_divide(F.col("dz"), whole) - 1) + 1
    third = third.select("row", "col", F.atan(F.try_divide(F.col("dz"), flat)).alias("horizontal"), F.asin(F.greatest(share, F.lit(-1.0))).alias("enhanced"))
    return maps.join(second, ["row", "col"]).join(third, ["row", "col"])


def to_pole(cells: DataFrame, inclination: float, declination: float, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """A magnetic field reduced to the pole, by the inclination and declination in degrees."""
    i, d = math.radians(inclination), math.radians(declination)

    def response(kx, ky):
        import numpy as np

        return 1 / (math.sin(i) + 1j * math.cos(i) * np.sin(d + np.arctan2(ky, kx))) ** 2

    return filtered(cells, response, dx, dy)
