"""Neighbourhood operators on raster cells.

Derivatives need the cells before and after in a row or column: two ordered
windows. Windows of (2r+1) x (2r+1) cells are sums of each cell's contributions
to the cells around it; the partial aggregate combines them before the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collections.abc import Sequence

from .grid import with_stats


def _row(keys: Sequence[str] = ()):
    """Along a row; a window needs a session, so none is made on import."""
    return Window.partitionBy(*keys, "row").orderBy("col")


def _col(keys: Sequence[str] = ()):
    return Window.partitionBy(*keys, "col").orderBy("row")


def _beside(w, place: str, value: str) -> tuple[Column, Column]:
    """The values one place before and after; null where that cell is missing."""
    here = F.col(place)
    return F.when(F.lag(place).over(w) == here - 1, F.lag(value).over(w)), F.when(F.lead(place).over(w) == here + 1, F.lead(value).over(w))


_EDGES = {"_r0": ("min", "row"), "_r1": ("max", "row"), "_c0": ("min", "col"), "_c1": ("max", "col")}


def _with_edges(cells: DataFrame) -> DataFrame:
    """First and last row and column of the whole raster, in each cell."""
    return with_stats(cells, **{n: getattr(F, f)(c) for n, (f, c) in _EDGES.items()})


def derivatives(cells: DataFrame, dx: float = 1.0, dy: float = 1.0, value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """Adds dx (along columns) and dy (along rows): central differences inside, one-sided at the raster's edges.

    Beside a missing cell or a null there is no derivative. ``keys`` (band, scene)
    part rasters in one table that share their edges.
    """

    def along(w: Window, step: float, place: str, low: str, high: str) -> Column:
        before, after = _beside(w, place, value)
        here, first, last = F.col(value), F.col(place) == F.col(low), F.col(place) == F.col(high)
        return F.when(first & last, F.lit(0.0)).when(first, (after - here) / step).when(last, (here - before) / step).otherwise((after - before) / (2 * step))

    return _with_edges(cells).withColumns({"dx": along(_row(keys), dx, "col", "_c0", "_c1"), "dy": along(_col(keys), dy, "row", "_r0", "_r1")}).drop(*_EDGES)


def directional(cells: DataFrame, azimuth: float, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """Derivative in the direction of an azimuth in degrees, rows counted downwards."""
    a = math.radians(azimuth)
    d = derivatives(cells, dx, dy)
    return d.withColumn("value", -F.col("dy") * math.sin(a) - F.col("dx") * math.cos(a)).drop("dx", "dy")


def horizontal_gradient(cells: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """Total horizontal gradient."""
    return derivatives(cells, dx, dy).withColumn("value", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))).drop("dx", "dy")


def derivative_ratio(cells: DataFrame, azimuth: float, order: float = 1.0) -> DataFrame:
    """Angle of the derivative along an azimuth over the power of that across it."""
    a = math.radians(azimuth)
    d = derivatives(cells)
    along = -F.col("dx") * math.sin(a) - F.col("dy") * math.cos(a)
    across = -F.col("dx") * math.sin(a + math.pi / 2) - F.col("dy") * math.cos(a + math.pi / 2)
    return d.withColumn("value", F.atan2(along, F.pow(F.abs(across), F.lit(float(order))))).drop("dx", "dy")


def around(cells: DataFrame, radius: int, value: str = "value") -> DataFrame:
    """Of each cell whose window is whole: row, col, and n, s, ss (count, sum, sum of squares) of its (2r+1)^2 window."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    spread = cells.where(F.col(value).isNotNull()).select("row", "col", F.col(value).alias("v"), F.explode(steps).alias("i")).select("row", "col", "v", "i", F.explode(steps).alias("j"))
    size = (2 * radius + 1) ** 2
    near = spread.groupBy((F.col("row") + F.col("i")).alias("row"), (F.col("col") + F.col("j")).alias("col")).agg(F.count("v").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("ss"))
    return near.where(F.col("n") == size)


def box_mean(cells: DataFrame, radius: int = 1) -> DataFrame:
    """Mean of each whole window; cells near the border or a masked cell have none."""
    return around(cells, radius).select("row", "col", (F.col("s") / F.col("n")).alias("value"))


def weighted(cells: DataFrame, kernel: dict[tuple[int, int], float], value: str = "value") -> DataFrame:
    """Sum of the weighted cells around each cell, whole windows only: a convolution by (row step, column step)."""
    entries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(w)).alias("w")) for (i, j), w in kernel.items()])
    spread = cells.where(F.col(value).isNotNull()).select("row", "col", F.col(value).alias("v"), F.explode(entries).alias("k"))
    near = spread.groupBy((F.col("row") - F.col("k.i")).alias("row"), (F.col("col") - F.col("k.j")).alias("col")).agg(F.count("v").alias("n"), F.sum(F.col("v") * F.col("k.w")).alias("value"))
    return near.where(F.col("n") == len(kernel)).select("row", "col", "value")


def disc_kernel(radius: int) -> dict[tuple[int, int], float]:
    """Equal weights in a disc on an even grid of steps from -r to r - 1."""
    inside = [(i, j) for i in range(-radius, radius) for j in range(-radius, radius) if i * i + j * j <= radius * radius]
    return dict.fromkeys(inside, 1 / len(inside))


def window_values(cells: DataFrame, offsets: Sequence[tuple[int, int]], value: str = "value") -> DataFrame:
    """Of each cell that exists: the known values of its window as an array ``near``, by (row step, column step)."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets])
    spread = cells.where(F.col(value).isNotNull()).select("row", "col", F.col(value).alias("v"), F.explode(steps).alias("k"))
    near = spread.groupBy((F.col("row") - F.col("k.i")).alias("row"), (F.col("col") - F.col("k.j")).alias("col")).agg(F.sort_array(F.collect_list("v")).alias("near"))
    return cells.join(near, ["row", "col"])


def median_of(values: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2


def offsets(rows: int, cols: int | None = None) -> list[tuple[int, int]]:
    """Steps of a window of rows by cols, with the cell in the middle."""
    cols = cols or rows
    return [(i - rows // 2, j - cols // 2) for i in range(rows) for j in range(cols)]


def disc_offsets(radius: int) -> list[tuple[int, int]]:
    return list(disc_kernel(radius))


def moving_median(cells: DataFrame, steps: Sequence[tuple[int, int]]) -> DataFrame:
    """Median of the known cells of each window; windows at the border are smaller, masked cells get the median around them."""
    return window_values(cells, steps).select("row", "col", median_of(F.col("near")).alias("value"))


def moving_sum(cells: DataFrame, kernel: dict[tuple[int, int], float]) -> DataFrame:
    """Correlation with a kernel, zeros outside the raster; a cell whose window has a masked cell is masked."""
    bad = cells.where("value IS NULL").select("row", "col").withColumn("value", F.lit(float("nan")))
    entries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(w)).alias("w")) for (i, j), w in kernel.items()])
    known = cells.where("value IS NOT NULL").select("row", "col", F.col("value").cast("double").alias("value")).unionByName(bad)
    near = known.select("row", "col", "value", F.explode(entries).alias("k")).groupBy((F.col("row") - F.col("k.i")).alias("row"), (F.col("col") - F.col("k.j")).alias("col")).agg(F.sum(F.col("value") * F.col("k.w")).alias("value"))
    return cells.select("row", "col").join(near, ["row", "col"]).withColumn("value", F.nanvl("value", F.lit(None)))


def gaussian_kernel(rows: int, cols: int, sigma: float) -> dict[tuple[int, int], float]:
    """Weights exp(-(r/s)^2 / 2) on the even grid of steps from -n/2 to n/2 - 1, adding up to 1."""
    r2, c2 = (rows - 1) / 2, (cols - 1) / 2
    steps = {(i, j): math.exp(-((i - r2) ** 2 + (j - c2) ** 2) / (2 * sigma * sigma)) for i in range(2 * int(r2)) for j in range(2 * int(c2))}
    total = sum(steps.values())
    return {(i - int(r2), j - int(c2)): w / total for (i, j), w in steps.items()}


def gain_control(cells: DataFrame, radius: int, how: str = "mean") -> DataFrame:
    """Value above the least one over the mean, median or root mean square of the unmasked cells of its window.

    Cells nearer than ``radius`` to the raster's edge, and masked ones, have none;
    where the window's is zero, the value above the least stays.
    """
    low = with_stats(_with_edges(cells), _m=F.min("value")).withColumn("value", F.col("value") - F.col("_m"))
    near = window_values(low, offsets(2 * radius + 1)).where("value IS NOT NULL")
    whole = (F.col("row") - F.col("_r0") >= radius) & (F.col("_r1") - F.col("row") >= radius) & (F.col("col") - F.col("_c0") >= radius) & (F.col("_c1") - F.col("col") >= radius)
    n, total = F.size("near"), lambda f: F.aggregate("near", F.lit(0.0), lambda a, v: a + f(v))
    stat = {"mean": lambda: total(lambda v: v) / n, "median": lambda: median_of(F.col("near")), "rms": lambda: F.sqrt(total(lambda v: v * v) / n)}[how]()
    return near.where(whole).select("row", "col", F.when(stat == 0, F.col("value")).otherwise(F.col("value") / stat).alias("value"))


def sobel(cells: DataFrame) -> DataFrame:
    """Adds dzdx and dzdy of the 3x3 Sobel operator (over 8), the border repeated outwards; null beside a missing cell."""
    c = _with_edges(cells)

    def ends(w, place: str, name: str, low: str, high: str) -> tuple[Column, Column]:
        before, after = _beside(w, place, name)
        return F.when(F.col(place) == F.col(low), F.col(name)).otherwise(before), F.when(F.col(place) == F.col(high), F.col(name)).otherwise(after)

    left, right = ends(_row(), "col", "value", "_c0", "_c1")
    c = c.withColumns({"_ra": left, "_rb": right})
    c = c.withColumns({"_dx": F.col("_rb") - F.col("_ra"), "_sx": F.col("_ra") + 2 * F.col("value") + F.col("_rb")})
    (up_d, down_d), (up_s, down_s) = ends(_col(), "row", "_dx", "_r0", "_r1"), ends(_col(), "row", "_sx", "_r0", "_r1")
    c = c.withColumns({"dzdx": (up_d + 2 * F.col("_dx") + down_d) / 8, "dzdy": (up_s - down_s) / 8})
    return c.drop("_ra", "_rb", "_dx", "_sx", *_EDGES)


def aspect(cells: DataFrame) -> DataFrame:
    """Direction that the surface faces, clockwise from north in degrees, -1 where it is flat."""
    c = sobel(cells)
    a = F.degrees(F.atan2("dzdy", -F.col("dzdx")))
    turned = F.when(a > 90, 450 - a).otherwise(90 - a)
    return c.withColumn("value", F.when((F.col("dzdx") == 0) & (F.col("dzdy") == 0), F.lit(-1.0)).otherwise(turned)).drop("dzdx", "dzdy")


def shade(cells: DataFrame, cell: float = 1.0, elevation: float = math.pi / 4, azimuth: float = -math.pi / 4, alpha: float = 1.0) -> DataFrame:
    """Sunshaded relief by Blinn's model: the cosine to the sun, times (1 - alpha) plus alpha by the squared cosine to the half-way direction (radians)."""
    c = sobel(cells)
    p, q = F.col("dzdx") / cell, F.col("dzdy") / cell
    sun = (-math.cos(azimuth) * math.tan(elevation), -math.sin(azimuth) * math.tan(elevation))
    half = tuple(x / (1 + math.hypot(1, *sun)) for x in sun)
    cosine = lambda x, y: (1 + x * p + y * q) / (F.sqrt(1 + p * p + q * q) * math.hypot(1, x, y))
    light = ((1 - alpha) + alpha * cosine(*half) * cosine(*half)) * cosine(*sun) / math.cos(elevation / 2)
    return c.withColumn("value", light).drop("dzdx", "dzdy")
