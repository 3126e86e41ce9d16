"""Polygons on rasters: rows cut by edges, intervals between the cuts, cells inside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_intervals(polygons: DataFrame, x0: float = 0.0, y0: float = 0.0, dx: float = 1.0, dy: float = 1.0, keys: Sequence[str] = ("polygon",)) -> DataFrame:
    """Of polygons (keys, rings: arrays of closed rings of x, y): keys, row, first and last column whose cell centres lie inside.

    Cell centres are at x0 + (col + 0.5) dx and y0 + (row + 0.5) dy. An edge is cut by the
    rows between its ends (the lower end counts, the upper doesn't), and what lies between
    an odd cut and the next is inside, so holes are rings like others. A centre on a left
    cut is inside, on a right one outside. A polygon without cells has no rows.
    """
    rings = polygons.select(*keys, F.explode("rings").alias("_ring"))
    edges = rings.select(*keys, F.explode(F.arrays_zip(F.slice("_ring", 1, F.size("_ring") - 1).alias("a"), F.slice("_ring", 2, F.size("_ring") - 1).alias("b"))).alias("_e"))
    flat = edges.select(*keys, *[F.col(f"_e.{p}.{c}").cast("double").alias(f"_{p}{c}") for p in "ab" for c in "xy"]).where("_ay <> _by")
    at = lambda y: F.ceil((y - y0) / dy - 0.5).cast("long")
    low, high = F.least("_ay", "_by"), F.greatest("_ay", "_by")
    first, last = at(low), at(high) - 1
    cuts = flat.where(first <= last).select(*keys, "_ax", "_ay", "_bx", "_by", F.explode(F.sequence(first, last)).alias("row"))
    y = y0 + (F.col("row") + 0.5) * dy
    x = (F.col("_bx") - F.col("_ax")) * (y - F.col("_ay")) / (F.col("_by") - F.col("_ay")) + F.col("_ax")
    sorted_ = cuts.select(*keys, "row", x.alias("_x")).groupBy(*keys, "row").agg(F.sort_array(F.collect_list("_x")).alias("_x"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("_x") / 2).cast("int") - 1), lambda k: F.struct(F.get("_x", 2 * k).alias("a"), F.get("_x", 2 * k + 1).alias("b")))
    spans = sorted_.where(F.size("_x") > 1).select(*keys, "row", F.explode(pairs).alias("_p"))
    column = lambda c: F.ceil((c - x0) / dx - 0.5).cast("long")
    out = spans.select(*keys, "row", column(F.col("_p.a")).alias("first"), (column(F.col("_p.b")) - 1).alias("last"))
    return out.where(F.col("first") <= F.col("last"))


def cells_inside(polygons: DataFrame, x0: float = 0.0, y0: float = 0.0, dx: float = 1.0, dy: float = 1.0, keys: Sequence[str] = ("polygon",)) -> DataFrame:
    """The cells (keys, row, col) whose centres lie in each polygon."""
    spans = row_intervals(polygons, x0, y0, dx, dy, keys)
    each = spans.select(*keys, F.col("row").cast("int").alias("row"), F.explode(F.sequence("first", "last")).alias("col"))
    return each.withColumn("col", F.col("col").cast("int")).distinct()


def cut_raster(cells: DataFrame, polygons: DataFrame, x0: float = 0.0, y0: float = 0.0, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """The cells whose centres lie in some polygon (polygon, rings): one join of cells with the intervals' cells."""
    return cells.join(cells_inside(polygons, x0, y0, dx, dy).select("row", "col").distinct(), ["row", "col"], "left_semi")


def zonal_statistics(cells: DataFrame, polygons: DataFrame, x0: float = 0.0, y0: float = 0.0, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """Of each polygon: n, mean, deviation (population), least and greatest of the known cells inside; polygons without any don't come out."""
    met = cells.where("value IS NOT NULL").join(cells_inside(polygons, x0, y0, dx, dy), ["row", "col"])
    return met.groupBy("polygon").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
