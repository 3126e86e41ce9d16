"""Visibility along the eight directions of a raster, from windows of neighbours in a line."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grid import with_stats


def complete(cells: DataFrame, value: str = "value") -> DataFrame:
    """Every place between the extremes of rows and columns, with ``filled``: the value, or the mean of all where there is none."""
    edges = cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.avg(value).alias("_mean"))
    places = edges.where("r0 IS NOT NULL").select(F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1", "_mean").select("row", F.explode(F.sequence("c0", "c1")).alias("col"), "_mean")
    return places.join(cells.select("row", "col", value), ["row", "col"], "left").withColumn("filled", F.coalesce(value, "_mean").cast("double")).drop("_mean")


def _seen(step, reach: int, height: float) -> Column:
    """How many of the places 1 to ``reach`` steps away aren't below the line of sight over those before them, the first one included."""
    slope = [(step(k) - F.col("filled") - height) / k for k in range(1, reach + 1)]
    seen = F.lit(1)
    for k in range(1, reach):
        seen = seen + (slope[k] >= (F.greatest(*slope[:k]) if k > 1 else slope[0])).cast("int")
    return seen


def visibility(cells: DataFrame, size: int, height: float) -> DataFrame:
    """row, col, total, deviation, resultant: places seen from ``height`` above each cell in eight directions of an odd window.

    A direction to later rows or columns (or diagonal ones) counts the cell itself
    too. A window of 1 or 3 has only the cell's own count in those, and none in the
    others. Places without a value count as the mean of all; they, and cells whose
    window leaves the raster, don't come out.
    """
    reach = size // 2
    if size < 1 or size % 2 == 0:
        raise ValueError("the window must be odd")
    c = complete(cells)
    ways = {"s": (F.col("col"), F.col("row")), "e": (F.col("row"), F.col("col")), "d": (F.col("row") - F.col("col"), F.col("col")), "u": (F.col("row") + F.col("col"), F.col("col"))}
    c = c.withColumns({f"_{n}": line for n, (line, _) in ways.items()})
    counts = {}
    for n, (_, order) in ways.items():
        w = Window.partitionBy(f"_{n}").orderBy(order)
        later, sooner = (lambda k, w=w: F.lead("filled", k).over(w)), (lambda k, w=w: F.lag("filled", k).over(w))
        counts[f"{n}1"] = _seen(later, reach, height) + 1 if reach > 1 else F.lit(1)
        counts[f"{n}2"] = _seen(sooner, reach, height) if reach > 1 else F.lit(0)
    c = with_stats(c.withColumns(counts), _r0=F.min("row"), _r1=F.max("row"), _c0=F.min("col"), _c1=F.max("col"))
    c = c.where((F.col("row") - F.col("_r0") >= reach) & (F.col("_r1") - F.col("row") >= reach) & (F.col("col") - F.col("_c0") >= reach) & (F.col("_c1") - F.col("col") >= reach) & F.col("value").isNotNull())
    every = [F.col(n).cast("double") for n in counts]
    total = sum(every[1:], every[0])
    spread = sum(((v - total / 8) * (v - total / 8) for v in every[1:]), (every[0] - total / 8) * (every[0] - total / 8))
    one, d, u = math.sqrt(0.5), F.col("d1") - F.col("d2"), F.col("u1") - F.col("u2")
    x, y = F.col("e1") - F.col("e2") + one * (d + u), F.col("s1") - F.col("s2") + one * (d - u)
    return c.select("row", "col", total.cast("int").alias("total"), F.sqrt(spread / 7).alias("deviation"), F.hypot(x, y).alias("resultant"))
