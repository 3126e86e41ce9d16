"""Rasters on other grids: reprojection and aligned stacks.

A grid is its left upper corner, cell sizes, rows and columns. Target cells are made by
ranges, the place of each in the source follows from columns, and one join with the
source's cells brings the values: four weighted ones for linear, one for the nearest.
"""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class Grid:
    """A raster's place: the left upper corner, cell sizes, rows and columns (rows are counted downwards)."""

    left: float
    top: float
    dx: float
    dy: float
    rows: int
    cols: int

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """left, bottom, right, top."""
        return self.left, self.top - self.rows * self.dy, self.left + self.cols * self.dx, self.top

    def cells(self, spark) -> DataFrame:
        """Every cell of the grid: row, col and the x, y of its centre."""
        at = spark.range(self.rows * self.cols).select(F.floor(F.col("id") / self.cols).cast("int").alias("row"), (F.col("id") % self.cols).cast("int").alias("col"))
        return at.withColumns({"x": self.left + (F.col("col") + 0.5) * self.dx, "y": self.top - (F.col("row") + 0.5) * self.dy})

    def place(self, x: Column, y: Column) -> tuple[Column, Column]:
        """row and column of a place as real numbers, whole ones at centres."""
        return (self.top - y) / self.dy - 0.5, (x - self.left) / self.dx - 0.5


def sampled(cells: DataFrame, source: Grid, wanted: DataFrame, how: str = "linear") -> DataFrame:
    """``wanted`` cells (row, col, x, y in the source's coordinates) with the source's ``value``.

    ``linear`` weighs the four cells around; beside the source's edge, where some are
    missing, and beside null cells, the known ones by their weights. ``nearest`` takes
    the cell that the place lies in. Places outside of the source have no row.
    """
    r, c = source.place(F.col("x"), F.col("y"))
    inside = wanted.select("row", "col", r.alias("_r"), c.alias("_c")).where(F.col("_r").between(-0.5, source.rows - 0.5) & F.col("_c").between(-0.5, source.cols - 0.5))
    known = cells.where("value IS NOT NULL").select(F.col("row").alias("_sr"), F.col("col").alias("_sc"), "value")
    if how == "nearest":
        near = inside.withColumns({"_sr": F.least(F.floor(F.col("_r") + 0.5).cast("int"), F.lit(source.rows - 1)), "_sc": F.least(F.floor(F.col("_c") + 0.5).cast("int"), F.lit(source.cols - 1))})
        return near.join(known, ["_sr", "_sc"]).select("row", "col", "value")
    if how != "linear":
        raise ValueError(how)
    r0, c0 = F.floor("_r"), F.floor("_c")
    fr, fc = F.col("_r") - r0, F.col("_c") - c0
    corner = lambda i, j, w: F.struct((r0 + i).cast("int").alias("_sr"), (c0 + j).cast("int").alias("_sc"), w.alias("w"))
    corners = F.array(corner(0, 0, (1 - fr) * (1 - fc)), corner(0, 1, (1 - fr) * fc), corner(1, 0, fr * (1 - fc)), corner(1, 1, fr * fc))
    spread = inside.select("row", "col", F.explode(F.filter(corners, lambda k: k["w"] > 0)).alias("k")).select("row", "col", "k.*")
    met = spread.join(known, ["_sr", "_sc"]).groupBy("row", "col").agg(F.sum(F.col("w") * F.col("value")).alias("s"), F.sum("w").alias("w"))
    return met.select("row", "col", (F.col("s") / F.col("w")).alias("value"))


def default_grid(spark, source: Grid, from_: object, to: object, dx: float | None = None) -> Grid:
    """The grid of the projected source: the bounds of its projected border, and cells that keep its diagonal's number of cells (or ``dx``)."""
    n = 2 * (source.rows + source.cols) + 4
    k, (left, bottom, right, top) = F.col("id"), source.bounds
    along = lambda a, b, size, start: a + (b - a) * (k - start) / size
    s1, s2, s3 = source.cols + 1, source.cols + source.rows + 2, 2 * source.cols + source.rows + 3
    x = F.when(k < s1, along(left, right, source.cols, 0)).when(k < s2, right).when(k < s3, along(right, left, source.cols, s2)).otherwise(left)
    y = F.when(k < s1, top).when(k < s2, along(top, bottom, source.rows, s1)).when(k < s3, bottom).otherwise(along(bottom, top, source.rows, s3))
    geo = spark.range(n).select(x.alias("x"), y.alias("y"))
    g = from_.inverse(F.col("x"), F.col("y"))
    p = to.forward(F.col("lat"), F.col("lon"))
    r = geo.select(g["lat"].alias("lat"), g["lon"].alias("lon")).select(p["x"].alias("x"), p["y"].alias("y")).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    step = dx or math.hypot(r[1] - r[0], r[3] - r[2]) / math.hypot(source.rows, source.cols)
    return Grid(r[0], r[3], step, step, max(1, math.ceil((r[3] - r[2]) / step - 1e-9)), max(1, math.ceil((r[1] - r[0]) / step - 1e-9)))


def reprojected(cells: DataFrame, source: Grid, from_: object, to: object, target: Grid | None = None, how: str = "linear") -> tuple[DataFrame, Grid]:
    """A raster (row, col, value) in another projection, on ``target`` or a default grid, which comes back too.

    Projections have ``forward`` (degrees to x, y) and ``inverse``, as in
    ``functions.projections``. Each target cell looks up the source.
    """
    spark = cells.sparkSession
    target = target or default_grid(spark, source, from_, to)
    at = to.inverse(F.col("x"), F.col("y"))
    geo = target.cells(spark).select("row", "col", at["lat"].alias("lat"), at["lon"].alias("lon"))
    back = from_.forward(F.col("lat"), F.col("lon"))
    return sampled(cells, source, geo.select("row", "col", back["x"].alias("x"), back["y"].alias("y")), how), target


def aligned(bands: dict[str, tuple[DataFrame, Grid]], master: str | None = None, dxy: float | None = None, common: bool = False, how: str = "linear") -> tuple[DataFrame, Grid]:
    """Rasters of different places and cell sizes side by side on one grid: row, col, a column for each; and that grid.

    It is the master's, or spans all rasters (with ``common``, what they share) by ``dxy``
    or the least cell size. Cells that no raster knows have no row.
    """
    grids = [g for _, g in bands.values()]
    if master is not None:
        target = bands[master][1]
    else:
        step = dxy or min(min(g.dx, g.dy) for g in grids)
        low, high = (max, min) if common else (min, max)
        left, bottom = low(g.bounds[0] for g in grids), low(g.bounds[1] for g in grids)
        right, top = high(g.bounds[2] for g in grids), high(g.bounds[3] for g in grids)
        target = Grid(left, top, step, step, max(0, math.ceil((top - bottom) / step - 1e-9)), max(0, math.ceil((right - left) / step - 1e-9)))
    spark, out = next(iter(bands.values()))[0].sparkSession, None
    for name, (cells, grid) in bands.items():
        part = cells.where("value IS NOT NULL").select("row", "col", "value") if grid == target else sampled(cells, grid, target.cells(spark), how)
        part = part.withColumnRenamed("value", name)
        out = part if out is None else out.join(part, ["row", "col"], "full")
    return out, target
