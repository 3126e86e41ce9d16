"""Density clustering (DBSCAN) over grid buckets.

Buckets are so narrow that all their points lie within ``eps`` of each other. A bucket
with ``least`` points or more is core throughout, without a look at its pairs; in the
others each point counts its neighbours. Core points of a bucket are one node of a
graph, whose edges are found from a few examples of each side first, and from the points
themselves only where those leave it open. So dense buckets never meet themselves.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalite.session import written

from .components import components, numbered

#: Parts of a bucket along each band, each with one example.
PARTS = 4


def _apart(a: str, b: str) -> Column:
    """The squared distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)


def _box_apart(a: str, b: str, width: float) -> Column:
    """The least squared distance of points of two boxes (arrays of whole numbers) of a width."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(F.abs(x - y) - 1, F.lit(0)).cast("double") * width), F.lit(0.0), lambda s, d: s + d * d)


def density_clusters(cells: DataFrame, bands: Sequence[str], eps: float, least: int = 5, id: str = "id") -> DataFrame:
    """The rows of ``cells`` (with a unique long ``id``) whose bands are all known, with ``core``, ``cluster`` and ``label``.

    A point is core if ``least`` points, itself included, lie within ``eps``. Core points
    within ``eps`` of each other share a cluster, named by its least core id; another
    point within ``eps`` of a core one joins the cluster of the least such id. The rest
    is noise: null, label 0. Labels number the clusters from 1 in the order of their names.
    Points of equal places count each; an empty table gives no rows. Up to four bands.
    """
    d = len(bands)
    if not 1 <= d <= 4:
        raise ValueError("from one to four bands")
    width = eps / math.sqrt(d) * (1 - 1e-9)
    known = cells.dropna(subset=list(bands))
    x = F.array(*[F.col(b).cast("double") for b in bands])
    place = lambda w: F.transform("x", lambda v: F.floor(v / w).cast("long"))
    points = written(known.select(F.col(id).cast("long").alias("id"), x.alias("x")).withColumns({"bucket": place(width), "part": place(width / PARTS)}), "density-points")
    reach = math.ceil(math.sqrt(d))
    steps = [s for s in itertools.product(range(-reach, reach + 1), repeat=d) if sum((max(abs(k) - 1, 0) * width) ** 2 for k in s) <= eps * eps]
    around = lambda which: F.array(*[F.array(*[(F.col("bucket")[k] + s[k]).cast("long") for k in range(d)]) for s in which])

    full = points.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    dense = full.where(F.col("n") >= least).select("bucket")
    sparse = points.join(dense, "bucket", "left_anti").select("id", F.col("x").alias("own"), F.explode(around(steps)).alias("bucket"))
    met = written(sparse.join(points.select("bucket", F.col("id").alias("other"), "x"), "bucket").where(_apart("own", "x") <= eps * eps).select("id", "other"), "density-met")
    counted = met.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("id")
    core = points.join(dense, "bucket", "left_semi").unionByName(points.join(counted, "id", "left_semi"))
    core = written(core.select("id", "x", "bucket", "part"), "density-core")

    nodes = written(core.groupBy("bucket").agg(F.min("id").alias("node")), "density-nodes")
    later = [s for s in steps if s > (0,) * d]
    pairs = nodes.select("node", F.explode(around(later)).alias("bucket")).join(nodes.select("bucket", F.col("node").alias("to")), "bucket")
    pairs = written(pairs.select(F.col("node").alias("a"), F.col("to").alias("b")), "density-pairs")
    named = core.join(nodes, "bucket").select("node", "part", "x")
    examples = written(named.groupBy("node", "part").agg(F.min("x").alias("x")), "density-examples")
    side = lambda t, n: t.select(F.col("node").alias(n), F.col("part").alias(f"{n}_part"), F.col("x").alias(f"{n}_x"))
    close = written(pairs.join(side(examples, "a"), "a").join(side(examples, "b"), "b").where(_box_apart("a_part", "b_part", width / PARTS) <= eps * eps).withColumn("hit", _apart("a_x", "b_x") <= eps * eps).select("a", "b", "a_part", "b_part", "hit"), "density-close")
    joined = close.where("hit").select("a", "b").distinct()
    open_ = close.join(joined, ["a", "b"], "left_anti")
    looked = open_.join(side(named, "a"), ["a", "a_part"]).join(side(named, "b"), ["b", "b_part"]).where(_apart("a_x", "b_x") <= eps * eps).select("a", "b").distinct()
    groups = components(joined.unionByName(looked))
    clusters = nodes.join(groups.withColumnRenamed("component", "cluster"), "node", "left").select("bucket", F.coalesce("cluster", "node").alias("cluster"))
    of_core = written(core.join(clusters, "bucket").select("id", "cluster"), "density-clusters")

    beside = met.join(core.select(F.col("id").alias("other")), "other", "left_semi").groupBy("id").agg(F.min("other").alias("other"))
    border = beside.join(of_core.select("id"), "id", "left_anti").join(of_core.select(F.col("id").alias("other"), "cluster"), "other").select("id", F.lit(False).alias("core"), "cluster")
    found = of_core.select("id", F.lit(True).alias("core"), "cluster").unionByName(border)
    found = found.join(numbered(of_core, "cluster", "label"), "cluster")
    found = known.join(found.withColumnRenamed("id", "_id"), F.col(id).cast("long") == F.col("_id"), "left").drop("_id")
    return found.withColumns({"core": F.coalesce("core", F.lit(False)), "label": F.coalesce("label", F.lit(0)).cast("long")})
