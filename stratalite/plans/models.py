"""Queries of clustering, classification and transforms. Where labels or signs depend on the method's path, there is no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalite.operators import density, learning

from .registry import query
from .views import cells, table

_BANDS = ["price", "tax", "qty"]


@query("kmeans_classes")
def kmeans_classes(spark, sf_dir):
    return learning.clusters(cells(spark, sf_dir), _BANDS, 4).select("scene", "row", "col", "label")


@query("bisecting_classes")
def bisecting_classes(spark, sf_dir):
    return learning.clusters(cells(spark, sf_dir), _BANDS, 4, "bisecting", "robust").select("scene", "row", "col", "label")


@query("crisp_means_classes")
def crisp_means_classes(spark, sf_dir):
    return learning.crisp_means(cells(spark, sf_dir), _BANDS, 3, "mahalanobis").select("scene", "row", "col", "label")


@query("fuzzy_means_members")
def fuzzy_means_members(spark, sf_dir):
    out = learning.fuzzy_means(cells(spark, sf_dir), _BANDS, 3)
    return out.select("scene", "row", "col", "label", *[F.round(c, 6).alias(c) for c in ("u1", "u2", "u3", "entropy")])


@query("fuzzy_compactness")
def fuzzy_compactness(spark, sf_dir):
    return learning.compactness(learning.fuzzy_means(cells(spark, sf_dir), _BANDS, 3), _BANDS, 3)


@query("variance_ratio_by_classes")
def variance_ratio_by_classes(spark, sf_dir):
    """The criterion for each number of classes."""
    known, out = cells(spark, sf_dir), None
    for k in (2, 3, 4, 5):
        one = learning.spread_ratio(learning.clusters(known, _BANDS, k), _BANDS).withColumn("classes", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def _spectra(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"b{i}") for i in range(16)])


@query("forest_classes")
def forest_classes(spark, sf_dir):
    s = _spectra(spark, sf_dir)
    return learning.classify(s.where("id % 4 <> 0"), s, [f"b{i}" for i in range(16)], "label").select("id", "label", "found")


@query("tree_classes")
def tree_classes(spark, sf_dir):
    s = _spectra(spark, sf_dir)
    return learning.classify(s.where("id % 4 <> 0"), s, [f"b{i}" for i in range(16)], "label", "tree").select("id", "label", "found")


@query("vector_classes")
def vector_classes(spark, sf_dir):
    s = _spectra(spark, sf_dir)
    return learning.classify(s.where("id % 4 <> 0"), s, [f"b{i}" for i in range(16)], "label", "vectors").select("id", "label", "found")


@query("principal_components")
def principal_components(spark, sf_dir):
    out, _ = learning.principal_components(cells(spark, sf_dir), _BANDS)
    return out.select("scene", "row", "col", *[F.round(f"pc{k}", 6).alias(f"pc{k}") for k in (1, 2, 3)])


@query("noise_fractions")
def noise_fractions(spark, sf_dir):
    out, _ = learning.noise_fractions(cells(spark, sf_dir), _BANDS, keys=["scene"])
    return out.select("scene", "row", "col", *[F.round(f"mnf{k}", 6).alias(f"mnf{k}") for k in (1, 2, 3)])


@query("density_classes")
def density_classes(spark, sf_dir):
    """Clusters of scaled cells of all scenes by density."""
    p = cells(spark, sf_dir).select((F.col("scene") * 1_000_000 + F.col("row") * 1000 + F.col("col")).alias("id"), (F.col("price") / 10000).alias("price"), (F.col("tax") * 100).alias("tax"))
    return density.density_clusters(p, ["price", "tax"], 0.15, 4).select("id", "core", "cluster", "label")
