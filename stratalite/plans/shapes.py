"""Queries on surfaces, polygons, other grids, windows and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalite.functions import projections
from stratalite.operators import moving, polygons, resample, segments, surfaces

from .registry import query
from .views import RASTER, raster, table


def _triangles(spark):
    ring = lambda *p: [[(x, y) for x, y in (*p, p[0])]]
    shapes = [(1, ring((3.05, 1.05), (30.05, 2.05), (12.05, 9.05))), (2, ring((20.05, 3.05), (48.05, 1.05), (35.05, 10.05)))]
    return spark.createDataFrame(shapes, "polygon int, rings array<array<struct<x: double, y: double>>>")


_INSIDE = f"""WITH {RASTER}, t(polygon, x1, y1, x2, y2, x3, y3) AS (VALUES (1, 3.05, 1.05, 30.05, 2.05, 12.05, 9.05), (2, 20.05, 3.05, 48.05, 1.05, 35.05, 10.05)),
c AS (SELECT *, col + 0.5 AS x, "row" + 0.5 AS y FROM raster),
inside AS (SELECT polygon, "row", col, value FROM c, t WHERE ((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) > 0) = ((x3 - x2) * (y - y2) - (y3 - y2) * (x - x2) > 0) AND ((x3 - x2) * (y - y2) - (y3 - y2) * (x - x2) > 0) = ((x1 - x3) * (y - y3) - (y1 - y3) * (x - x3) > 0))"""


@query("cut_raster", f"""{_INSIDE} SELECT DISTINCT "row", col, round(value, 6) AS value FROM inside""")
def cut_raster(spark, sf_dir):
    return polygons.cut_raster(raster(spark, sf_dir), _triangles(spark)).select("row", "col", F.round("value", 6).alias("value"))


@query("zonal_statistics", f"""{_INSIDE} SELECT polygon, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS min, round(max(value), 6) AS max FROM inside GROUP BY 1""")
def zonal_statistics(spark, sf_dir):
    found = polygons.zonal_statistics(raster(spark, sf_dir), _triangles(spark))
    return found.select("polygon", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")])


_FINE, _COARSE = resample.Grid(0.0, 11.0, 1.0, 1.0, 11, 51), resample.Grid(0.0, 11.0, 2.0, 2.0, 6, 26)


@query("aligned_stack", f"""WITH {RASTER}, coarse AS (SELECT "row" // 2 AS r, col // 2 AS c, avg(value) AS v FROM raster GROUP BY 1, 2), l AS (SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col FROM (SELECT unnest(range(0, 11)) AS r), (SELECT unnest(range(0, 51)) AS c))
SELECT l."row", l.col, round(raster.value, 6) AS fine, round(coarse.v, 6) AS coarse FROM l LEFT JOIN raster USING ("row", col) LEFT JOIN coarse ON coarse.r = l."row" // 2 AND coarse.c = l.col // 2 WHERE raster.value IS NOT NULL OR coarse.v IS NOT NULL""")
def aligned_stack(spark, sf_dir):
    """A raster and one of twice its cell size on the finer grid."""
    fine = raster(spark, sf_dir)
    coarse = fine.groupBy(F.floor(F.col("row") / 2).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col")).agg(F.avg("value").alias("value"))
    out, _ = resample.aligned({"fine": (fine, _FINE), "coarse": (coarse, _COARSE)}, master="fine", how="nearest")
    return out.select("row", "col", F.round("fine", 6).alias("fine"), F.round("coarse", 6).alias("coarse"))


@query("reprojected_raster")
def reprojected_raster(spark, sf_dir):
    """Degrees to an equal area projection."""
    place = resample.Grid(20.0, -20.0, 0.25, 0.25, 11, 51)
    out, _ = resample.reprojected(raster(spark, sf_dir), place, projections.Geographic(), projections.AlbersEqualArea(0, 24, -18, -32))
    return out.select("row", "col", F.round("value", 4).alias("value"))


def _values(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.floor("l_quantity").cast("int").alias("i"), F.round(F.col("l_discount") * 100).cast("int").alias("j"), F.col("l_linenumber").cast("int").alias("k")).agg(F.avg(F.col("l_extendedprice").cast("double")).alias("value"))


@query("isosurface")
def isosurface(spark, sf_dir):
    return surfaces.isosurface(_values(spark, sf_dir), 40000.0).select("v1", "v2", "v3", *[F.round(f"{c}{n}", 6).alias(f"{c}{n}") for n in (1, 2, 3) for c in "xyz"])


@query("isosurface_vertices")
def isosurface_vertices(spark, sf_dir):
    return surfaces.vertices(surfaces.isosurface(_values(spark, sf_dir), 40000.0)).select("id", *[F.round(c, 6).alias(c) for c in ("x", "y", "z", "nx", "ny", "nz")])


@query("window_mean_large", f"""WITH {RASTER} SELECT a."row", a.col, round(avg(b.value), 6) AS value FROM raster a JOIN raster b ON b."row" BETWEEN a."row" - 4 AND a."row" + 4 AND b.col BETWEEN a.col - 4 AND a.col + 4 GROUP BY 1, 2 HAVING count(*) = 81""")
def window_mean_large(spark, sf_dir):
    """Means of 9 x 9 cells by running sums in blocks."""
    return moving.window_mean(raster(spark, sf_dir), 4).withColumn("value", F.round("value", 6))


@query("window_median_large", f"""WITH {RASTER} SELECT a."row", a.col, round(median(b.value), 6) AS value FROM raster a JOIN raster b ON b."row" BETWEEN a."row" - 4 AND a."row" + 4 AND b.col BETWEEN a.col - 4 AND a.col + 4 GROUP BY 1, 2""")
def window_median_large(spark, sf_dir):
    steps = [(i, j) for i in range(-4, 5) for j in range(-4, 5)]
    cells = raster(spark, sf_dir)
    return moving.window_median(cells, steps).join(cells.select("row", "col"), ["row", "col"], "left_semi").withColumn("value", F.round("value", 6))


_BOX = lambda side: f"""SELECT "row", col, count(DISTINCT least((r - "row" + 2) // {side}, {(4 // side) - 1}) * 100 + least((c - col + 2) // {side}, {(4 // side) - 1})) AS n FROM near GROUP BY 1, 2"""


@query("fractal_dimension", f"""WITH {RASTER}, e AS (SELECT min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM raster), on_ AS (SELECT "row" AS r, col AS c FROM raster WHERE value > 36500),
p AS (SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col FROM (SELECT unnest(range((SELECT r0 + 2 FROM e), (SELECT r1 - 1 FROM e))) AS r), (SELECT unnest(range((SELECT c0 + 2 FROM e), (SELECT c1 - 1 FROM e))) AS c)),
near AS (SELECT p."row", p.col, r, c FROM p JOIN on_ ON r BETWEEN p."row" - 2 AND p."row" + 2 AND c BETWEEN p.col - 2 AND p.col + 2),
one AS ({_BOX(1)}), two AS ({_BOX(2)}) SELECT one."row", one.col, round(log2(one.n / two.n), 9) AS value FROM one JOIN two USING ("row", col)""")
def fractal_dimension(spark, sf_dir):
    on = raster(spark, sf_dir).withColumn("value", (F.col("value") > 36500).cast("double"))
    return moving.fractal_dimension(on, 5).withColumn("value", F.round("value", 9))


@query("image_segments")
def image_segments(spark, sf_dir):
    cells = raster(spark, sf_dir).withColumn("value", F.col("value") / 1000)
    return segments.segments(cells, ["value"], 3.0).select("row", "col", "region", "label")
