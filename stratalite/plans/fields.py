"""Queries on potential fields and relief: spectra and visibility."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalite.operators import contours, curvature, spectrum, visibility

from .registry import query
from .views import POINTS, RASTER, points, raster


@query("upward_continuation")
def upward_continuation(spark, sf_dir):
    return spectrum.upward(raster(spark, sf_dir), 2.0).select("row", "col", F.round("value", 6).alias("value"))


@query("downward_continuation")
def downward_continuation(spark, sf_dir):
    return spectrum.downward(raster(spark, sf_dir), 0.5).select("row", "col", F.round("value", 6).alias("value"))


@query("vertical_derivative")
def vertical_derivative(spark, sf_dir):
    return spectrum.vertical_derivative(raster(spark, sf_dir)).select("row", "col", F.round("value", 6).alias("value"))


@query("reduction_to_pole")
def reduction_to_pole(spark, sf_dir):
    return spectrum.to_pole(raster(spark, sf_dir), -62.5, -16.75).select("row", "col", F.round("value", 6).alias("value"))


def _line(dr: int, dc: int, own: int) -> str:
    """The count along one direction for a window of 5: the places one and two steps away, by lookups of their cells."""
    near, far = (f'(SELECT value FROM raster b WHERE b."row" = a."row" + {k * dr} AND b.col = a.col + {k * dc})' for k in (1, 2))
    return f"{1 + own} + CAST(({far} - value - 1000) / 2 >= {near} - value - 1000 AS INTEGER)"


_WAYS = {"s1": (1, 0, 1), "s2": (-1, 0, 0), "e1": (0, 1, 1), "e2": (0, -1, 0), "d1": (1, 1, 1), "d2": (-1, -1, 0), "u1": (-1, 1, 1), "u2": (1, -1, 0)}


@query("visibility", f"""WITH {RASTER}, v AS (SELECT "row", col, {", ".join(f"{_line(*w)} AS {n}" for n, w in _WAYS.items())} FROM raster a), t AS (SELECT *, s1 + s2 + e1 + e2 + d1 + d2 + u1 + u2 AS total, sqrt(0.5) AS q FROM v)
SELECT "row", col, CAST(total AS INTEGER) AS total, round(list_stddev_samp([s1, s2, e1, e2, d1, d2, u1, u2]), 6) AS deviation, round(sqrt((e1 - e2 + q * (d1 - d2 + u1 - u2)) ** 2 + (s1 - s2 + q * (d1 - d2 - u1 + u2)) ** 2), 6) AS resultant
FROM t WHERE "row" BETWEEN (SELECT min("row") + 2 FROM raster) AND (SELECT max("row") - 2 FROM raster) AND col BETWEEN (SELECT min(col) + 2 FROM raster) AND (SELECT max(col) - 2 FROM raster)""")
def visibility_counts(spark, sf_dir):
    return visibility.visibility(raster(spark, sf_dir), 5, 1000.0).select("row", "col", "total", F.round("deviation", 6).alias("deviation"), F.round("resultant", 6).alias("resultant"))


@query("edge_derivative")
def edge_derivative(spark, sf_dir):
    return spectrum.edge_derivative(raster(spark, sf_dir)).select("row", "col", F.round("value", 6).alias("value"))


@query("tilt_angles")
def tilt_angles(spark, sf_dir):
    names = ["tilt", "hyperbolic", "second", "directional", "total", "horizontal", "enhanced"]
    return spectrum.tilt_angles(raster(spark, sf_dir), 45.0).select("row", "col", *[F.round(n, 6).alias(n) for n in names])


@query("tilt_depths")
def tilt_depths(spark, sf_dir):
    tilt = spectrum.tilt_angles(raster(spark, sf_dir)).select("row", "col", F.col("tilt").alias("value"))
    return contours.tilt_depths(tilt).select(F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "line", F.round("depth", 6).alias("depth"))


_LEVELS = (33000.0, 36000.0, 39000.0)
_SIDES = [("a", "b", 0, 0, 1, 0), ("b", "d", 1, 0, 0, 1), ("d", "e", 1, 1, -1, 0), ("e", "a", 0, 1, 0, -1)]
_SIDE = " UNION ALL ".join(f"""SELECT level, "row", col, {k} AS k, {p} > level AND NOT {q} > level AS leaves, NOT {p} > level AND {q} > level AS enters, col + {x} + (level - {p}) / nullif({q} - {p}, 0) * {dx} AS x, "row" + {y} + (level - {p}) / nullif({q} - {p}, 0) * {dy} AS y, (a + b + d + e) / 4 > level AS up FROM squares""" for k, (p, q, x, y, dx, dy) in enumerate(_SIDES))


@query("contour_segments", f"""WITH {RASTER}, squares AS (SELECT l.level, a."row", a.col, a.value AS a, b.value AS b, d.value AS d, e.value AS e FROM raster a JOIN raster b ON b."row" = a."row" AND b.col = a.col + 1 JOIN raster d ON d."row" = a."row" + 1 AND d.col = a.col + 1 JOIN raster e ON e."row" = a."row" + 1 AND e.col = a.col, (VALUES {", ".join(f"({v})" for v in _LEVELS)}) AS l(level)),
sides AS ({_SIDE}), n AS (SELECT level, "row", col, count(*) AS n FROM sides WHERE leaves GROUP BY 1, 2, 3)
SELECT CAST(o.level AS DOUBLE) AS level, o."row", o.col, round(o.x, 6) AS x1, round(o.y, 6) AS y1, round(i.x, 6) AS x2, round(i.y, 6) AS y2
FROM sides o JOIN sides i ON o.level = i.level AND o."row" = i."row" AND o.col = i.col AND o.leaves AND i.enters JOIN n ON n.level = o.level AND n."row" = o."row" AND n.col = o.col
WHERE n.n = 1 OR (CASE WHEN o.up THEN (i.k - o.k + 4) % 4 = 1 ELSE (o.k - i.k + 4) % 4 = 1 END)""")
def contour_segments(spark, sf_dir):
    found = contours.segments(raster(spark, sf_dir), _LEVELS)
    return found.select("level", "row", "col", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("contour_lines")
def contour_lines(spark, sf_dir):
    found = contours.contour_lines(raster(spark, sf_dir), _LEVELS)
    return found.groupBy("level", "line", "ring").agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), 6).alias("length"))


@query("minimum_curvature", f"""WITH {POINTS}, g AS (SELECT CAST(floor(y - (SELECT min(y) FROM points) + 0.5) AS INTEGER) AS "row", CAST(floor(x - (SELECT min(x) FROM points) + 0.5) AS INTEGER) AS col, min(z) AS value FROM points GROUP BY 1, 2)
SELECT "row", col, round(value, 6) AS value FROM g""")
def minimum_curvature(spark, sf_dir):
    """The surface where there are points, which keeps their values; without the cells between (their SQL would be a system of equations)."""
    p = points(spark, sf_dir)
    surface = curvature.minimum_curvature(p, 1.0, tolerance=1e-3)
    known, _ = curvature.data_cells(p, 1.0, buffer=0)
    return surface.join(known.select("row", "col"), ["row", "col"], "left_semi").select("row", "col", F.round("value", 6).alias("value"))


@query("minimum_curvature_between")
def minimum_curvature_between(spark, sf_dir):
    """The surface over the points of every third column, at every cell."""
    p = points(spark, sf_dir).where("x % 3 = 0")
    return curvature.minimum_curvature(p, 1.0, tolerance=1e-5).select("row", "col", F.round("value", 3).alias("value"))
