"""Operators on the scenes of a raster: statistics in time, condition indices, composites, decision lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def statistics(scenes: DataFrame, value: str) -> DataFrame:
    """Mean, population deviation and count of each cell over its scenes, from partial moments."""
    return scenes.groupBy("row", "col").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def coefficient_of_variation(scenes: DataFrame, value: str) -> DataFrame:
    """Deviation over mean of each cell, clamped to its own first and last percentile."""
    cv = statistics(scenes, value).select("row", "col", F.try_divide("std", "mean").alias("cv"))
    limits = cv.agg(F.percentile("cv", [0.01, 0.99]).alias("_p"))
    return cv.crossJoin(F.broadcast(limits)).select("row", "col", F.least(F.greatest("cv", F.col("_p")[0]), F.col("_p")[1]).alias("cv"))


def condition_indices(scenes: DataFrame, temperature: str, vegetation: str, alpha: float) -> DataFrame:
    """Adds tci, vci (place between the cell's extremes in time) and their weighted sum vhi."""
    w = Window.partitionBy("row", "col")
    low, high = (lambda c: F.min(c).over(w)), (lambda c: F.max(c).over(w))
    out = scenes.withColumns({"tci": F.try_divide(high(temperature) - F.col(temperature), high(temperature) - low(temperature)), "vci": F.try_divide(F.col(vegetation) - low(vegetation), high(vegetation) - low(vegetation))})
    return out.withColumn("vhi", alpha * F.col("vci") + (1 - alpha) * F.col("tci"))


def difference(first: DataFrame, second: DataFrame, value: str) -> DataFrame:
    """Second less first, on the cells of both."""
    return first.select("row", "col", F.col(value).alias("_a")).join(second.select("row", "col", F.col(value).alias("_b")), ["row", "col"]).select("row", "col", (F.col("_b") - F.col("_a")).alias("value"))


def best_pixel(scenes: DataFrame, score: Column, order: str, bands: Sequence[str]) -> DataFrame:
    """The bands of the scene with the greatest score in each cell; of equal ones the earliest."""
    best = F.max_by(F.struct(order, *bands), F.struct(score, -F.col(order)))
    return scenes.groupBy("row", "col").agg(best.alias("_best")).select("row", "col", f"_best.{order}", *[f"_best.{b}" for b in bands])


def decide(cells: DataFrame, rules: Sequence[tuple[str, int]], out: str) -> DataFrame:
    """The number of the last rule that holds in each cell, 0 if none does."""
    found = F.lit(0)
    for condition, number in rules:
        found = F.when(F.expr(condition), number).otherwise(found)
    return cells.withColumn(out, found.cast("int"))
