"""Operators on voxel models: tables of (i, j, k, lith), layers counted from 1 at the top."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lithology_statistics(voxels: DataFrame, dxy: float, dz: float) -> DataFrame:
    """Per lithology: voxels, volume, and of the columns that have it the mean thickness and depths to its top and bottom."""
    columns = voxels.groupBy("lith", "i", "j").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("top"), F.max("k").alias("bottom"))
    return columns.groupBy("lith").agg(
        F.sum("n").alias("n"), (F.sum("n") * (dxy * dxy * dz)).alias("volume"), F.avg(F.col("n") * dz).alias("thickness"), F.avg((F.col("top") - 1) * dz).alias("depth_top"), F.avg(F.col("bottom") * dz).alias("depth_bottom")
    )


def with_properties(voxels: DataFrame, properties: DataFrame) -> DataFrame:
    """Voxels with the physical properties of their lithology."""
    return voxels.join(properties, "lith", "left")


def merge(master: DataFrame, other: DataFrame, background: str) -> DataFrame:
    """The master's lithology, but the other's where the master has none or background."""
    both = master.select("i", "j", "k", F.col("lith").alias("_m")).join(other.select("i", "j", "k", F.col("lith").alias("_o")), ["i", "j", "k"], "full")
    return both.select("i", "j", "k", F.when(F.coalesce(F.col("_m"), F.lit(background)) == background, F.coalesce("_o", "_m")).otherwise(F.col("_m")).alias("lith"))


def carve(voxels: DataFrame, surface: DataFrame, dz: float, top: float, air: str = "air") -> DataFrame:
    """Voxels above a surface (i, j, height) become air: the first int((top - height) / dz) layers."""
    depth = F.floor((F.lit(top) - F.col("height")) / dz)
    return voxels.join(surface, ["i", "j"], "left").withColumn("lith", F.when(F.col("k") <= depth, F.lit(air)).otherwise(F.col("lith"))).drop("height")


def interval_labels(logs: DataFrame, dz: float) -> DataFrame:
    """Layers of borehole logs (hole, depth_from, depth_to, label): the labels in each layer, sorted and joined by /."""
    first, last = F.floor(F.col("depth_from") / dz), F.greatest(F.ceil(F.col("depth_to") / dz) - 1, F.floor(F.col("depth_from") / dz))
    layers = logs.select("hole", "label", F.explode(F.sequence(first, last)).alias("layer"))
    return layers.groupBy("hole", F.col("layer").cast("int").alias("layer")).agg(F.array_join(F.sort_array(F.collect_set("label")), "/").alias("labels"))


def volume_rollup(voxels: DataFrame, *keys: str) -> DataFrame:
    """Counts for each level of the keys, from all of them to the total."""
    return voxels.rollup(*keys).agg(F.count(F.lit(1)).alias("n"))
