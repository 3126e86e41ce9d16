"""Queries on light on slopes, mineral features and composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalite.operators import imagery

from .registry import query
from .views import RASTER, raster, table


def _bands(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    mean = lambda c: F.avg(F.col(c).cast("double"))
    return t.groupBy(F.round(F.col("l_discount") * 100).cast("int").alias("row"), F.floor("l_quantity").cast("int").alias("col")).agg(mean("l_extendedprice").alias("red"), mean("l_tax").alias("green"), mean("l_linenumber").alias("blue"))


_BANDS = """bands AS (SELECT CAST(round(l_discount * 100) AS INTEGER) AS "row", CAST(floor(l_quantity) AS INTEGER) AS col, avg(CAST(l_extendedprice AS DOUBLE)) AS red, avg(CAST(l_tax AS DOUBLE)) AS green, avg(CAST(l_linenumber AS DOUBLE)) AS blue FROM lineitem GROUP BY 1, 2)"""


@query("light_corrected", f"""WITH {_BANDS}, {RASTER}, e AS (SELECT min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM raster),
o AS (SELECT dr, dc FROM (VALUES (-1), (0), (1)) a(dr), (VALUES (-1), (0), (1)) b(dc)),
s AS (SELECT a."row", a.col, sum(b.value / 5000 * dc * (2 - abs(dr))) / 8 AS sx, -sum(b.value / 5000 * dr * (2 - abs(dc))) / 8 AS sy,
  sum(CASE WHEN dr = 0 THEN b.value / 5000 * dc END) / (least(max(a.col) + 1, max(c1)) - greatest(max(a.col) - 1, max(c0))) AS dx, sum(CASE WHEN dc = 0 THEN b.value / 5000 * dr END) / (least(max(a."row") + 1, max(r1)) - greatest(max(a."row") - 1, max(r0))) AS dy
  FROM raster a, o, e, raster b WHERE b."row" = least(greatest(a."row" + dr, r0), r1) AND b.col = least(greatest(a.col + dc, c0), c1) GROUP BY 1, 2),
f AS (SELECT "row", col, atan(sqrt(dx * dx + dy * dy)) AS slope, CASE WHEN sx = 0 AND sy = 0 THEN -1 WHEN degrees(atan2(sy, -sx)) > 90 THEN 450 - degrees(atan2(sy, -sx)) ELSE 90 - degrees(atan2(sy, -sx)) END AS faced FROM s),
l AS (SELECT "row", col, red, green, cos(radians(40)) * cos(slope) + sin(radians(40)) * sin(slope) * cos(radians(135) - radians(faced)) AS light FROM f JOIN bands USING ("row", col)),
c AS (SELECT regr_intercept(red, light) / regr_slope(red, light) AS a, regr_intercept(green, light) / regr_slope(green, light) AS b FROM l)
SELECT "row", col, round(red * (cos(radians(40)) + a) / (light + a), 4) AS red, round(green * (cos(radians(40)) + b) / (light + b), 6) AS green FROM l, c""")
def light_corrected(spark, sf_dir):
    """Two bands over a height model, sun from the south-east."""
    dem = raster(spark, sf_dir).withColumn("value", F.col("value") / 5000)
    out = imagery.light_corrected(_bands(spark, sf_dir), dem, 135.0, 40.0, ["red", "green"])
    return out.select("row", "col", F.round("red", 4).alias("red"), F.round("green", 6).alias("green"))


@query("ternary_composite", f"""WITH {_BANDS}, q AS (SELECT {", ".join(f"quantile_cont({b}, 0.02) AS {b}0, quantile_cont({b}, 0.97) AS {b}1" for b in ("red", "green", "blue"))} FROM bands)
SELECT "row", col, {", ".join(f"CAST(round_even(254 * (least(greatest({b}, {b}0), {b}1) - {b}0) / ({b}1 - {b}0) + 1, 0) AS INTEGER) AS {b}" for b in ("red", "green", "blue"))}, 255 AS alpha FROM bands, q""")
def ternary_composite(spark, sf_dir):
    return imagery.ternary(_bands(spark, sf_dir), low=2.0, high=3.0)


@query("ternary_on_relief")
def ternary_on_relief(spark, sf_dir):
    return imagery.ternary(_bands(spark, sf_dir), low=2.0, high=3.0, relief="red", cell=5000.0)


@query("mineral_features")
def mineral_features(spark, sf_dir):
    """Embeddings as spectra from 400 nm on: an absorption where a ratio is high, its order by two absorptions."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double") + 2).alias("spectrum"))
    waves = [400.0 + 20 * k for k in range(16)]
    out = imagery.mineral(e, waves, {"f500": (420, 600, 440, 580), "f620": (560, 680)}, {"r1": "R420 / (R480 + R500)"}, ["f500", "r1 > 0.4"], ["f500 > f620"])
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("depth", "wavelength", "crystallinity")])
