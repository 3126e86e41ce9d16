"""Queries of checks and reports, of the geomagnetic field, and of tensors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratalite.operators import joining, magnetics, reports
from stratalite.session import shared_folder
from stratalite.sources import harmonics

from .registry import query
from .views import CATALOGUE, CELLS, LINES, RASTER, catalogue, cells, lines, raster, table

_PICKS = f"{CATALOGUE}, picks AS (SELECT station AS event, event AS at, CASE event % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'S' ELSE 'AML' END AS phase, event % 5 AS station, CASE event % 4 WHEN 0 THEN 'I' WHEN 1 THEN 'E' END AS quality, CASE event % 7 WHEN 0 THEN 'C' WHEN 1 THEN 'D' END AS first_motion, mag - 0.5 AS residual, CASE WHEN event % 11 = 0 THEN 9 END AS weight FROM catalogue)"


def _picks(spark, sf_dir):
    e, pick = F.col("event"), lambda n, *names: F.expr(f"CASE event % {n} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(names)) + " END")
    c = catalogue(spark, sf_dir)
    return c.select(F.col("station").alias("event"), e.alias("at"), pick(3, "P", "S", "AML").alias("phase"), (e % 5).alias("station"), pick(4, "I", "E").alias("quality"), pick(7, "C", "D").alias("first_motion"), (F.col("mag") - 0.5).alias("residual"), F.when(e % 11 == 0, 9).alias("weight"))


@query("phase_residuals", f"WITH {_PICKS} SELECT phase, round(avg(residual), 6) AS mean, round(stddev_pop(residual), 6) AS std, count(*) AS n FROM picks WHERE phase IN ('P', 'S') AND coalesce(weight, 0) <> 9 GROUP BY 1")
def phase_residuals(spark, sf_dir):
    return reports.phase_residuals(_picks(spark, sf_dir)).withColumns({n: F.round(n, 6) for n in ("mean", "std")})


@query("pick_issues", f"""WITH {_PICKS}, l AS (SELECT *, lag(station) OVER w AS s0, lag(phase) OVER w AS p0 FROM picks WINDOW w AS (PARTITION BY event ORDER BY "at"))
SELECT event, "at", 'impulsive S' AS issue FROM l WHERE quality = 'I' AND phase = 'S' UNION ALL SELECT event, "at", 'impulsive P without first motion' FROM l WHERE quality = 'I' AND phase = 'P' AND first_motion IS NULL
UNION ALL SELECT event, "at", 'emergent with first motion' FROM l WHERE quality = 'E' AND first_motion IS NOT NULL UNION ALL SELECT event, "at", 'residual above 3' FROM l WHERE quality = 'E' AND residual > 3
UNION ALL SELECT event, "at", 'phases out of order' FROM l WHERE s0 = station AND p0 = 'AML'""")
def pick_issues(spark, sf_dir):
    return reports.pick_issues(_picks(spark, sf_dir))


@query("event_issues", f"""WITH e AS (SELECT c_custkey AS event, CASE WHEN c_custkey % 9 > 0 THEN c_custkey END AS latitude, c_custkey AS longitude, c_mktsegment AS region FROM customer)
SELECT event, 'no latitude or longitude' AS issue FROM e WHERE latitude IS NULL UNION ALL SELECT event, 'unknown region' FROM e WHERE region NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')""")
def event_issues(spark, sf_dir):
    k = F.col("c_custkey")
    e = table(spark, sf_dir, "customer").select(k.alias("event"), F.when(k % 9 > 0, k).alias("latitude"), k.alias("longitude"), F.col("c_mktsegment").alias("region"))
    return reports.event_issues(e, ["BUILDING", "MACHINERY", "FURNITURE"])


@query("phase_magnitudes", f"""WITH {_PICKS}, m AS (SELECT event, station, max(residual) AS mag FROM picks WHERE phase = 'AML' GROUP BY 1, 2) SELECT p.event, p.at, m.mag FROM picks p LEFT JOIN m ON p.event = m.event AND p.station = m.station WHERE p.phase <> 'AML'""")
def phase_magnitudes(spark, sf_dir):
    """Picks with the magnitude of their station within the event, null where it has none."""
    p = _picks(spark, sf_dir)
    m = p.where("phase = 'AML'").groupBy("event", "station").agg(F.max("residual").alias("mag"))
    return p.where("phase <> 'AML'").join(m, ["event", "station"], "left").select("event", "at", "mag")


@query("closest_names", """SELECT c_custkey AS id, c_mktsegment AS region FROM customer""")
def closest_names(spark, sf_dir):
    """Names with a letter missing, put right from the list."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.substring("c_mktsegment", 1, 3), F.substring("c_mktsegment", 5, 99))).otherwise(F.col("c_mktsegment")).alias("region"))
    return reports.closest_names(c, "region", ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"])


@query("after_first_base", f"WITH {LINES} SELECT id FROM lines WHERE t >= (SELECT min(t) FROM lines WHERE line = 3)")
def after_first_base(spark, sf_dir):
    return reports.after_first_base(lines(spark, sf_dir), "line", 3, "t").select("id")


@query("absolute_bases", f"""WITH {LINES}, b AS (SELECT t, value, line = 9 AS base FROM lines WHERE line > 4 AND line < 12), k AS (SELECT t, avg(value) AS value FROM b WHERE base GROUP BY 1),
o AS (SELECT a.t, a.value, p.t AS t0, p.value AS v0, (SELECT min(t) FROM k WHERE k.t >= a.t) AS t1 FROM b a ASOF JOIN k p ON a.t >= p.t WHERE NOT a.base)
SELECT o.t, round(o.value - CASE WHEN t1 > t0 THEN v0 + (k.value - v0) * (o.t - t0) / (t1 - t0) ELSE v0 END + 978000.0, 5) AS base FROM o JOIN k ON k.t = t1""")
def absolute_bases(spark, sf_dir):
    """Users 5 to 11 as base stations, 9 as the known one."""
    r = lines(spark, sf_dir).where("line < 12")
    return reports.absolute_bases(r, 9, 978000.0, 4, station="line").withColumn("base", F.round("base", 5))


_FILE = "CASE c_custkey % 4 WHEN 0 THEN 'AST_L1T_' || c_custkey // 8 || '_' || c_custkey || '.zip' WHEN 1 THEN 'AST_L1T_' || c_custkey // 8 || '_' || c_custkey || '.hdf' ELSE 'LC08_' || c_custkey || '.tar' END"


@query("one_file_a_scene", f"""WITH f AS (SELECT c_custkey AS id, {_FILE} AS file FROM customer), a AS (SELECT *, row_number() OVER (PARTITION BY split_part(file, '_', 3) ORDER BY file LIKE '%.hdf' DESC, file DESC) AS rn FROM f WHERE file LIKE 'AST_%')
SELECT id, file FROM a WHERE rn = 1 UNION ALL SELECT id, file FROM f WHERE file NOT LIKE 'AST_%'""")
def one_file_a_scene(spark, sf_dir):
    f = table(spark, sf_dir, "customer").select(F.expr(_FILE.replace("c_custkey // 8", "c_custkey div 8")).alias("file"), F.col("c_custkey").alias("id"))
    return reports.one_file_a_scene(f).select("id", "file")


@query("sensor_files", f"""WITH f AS (SELECT c_custkey AS id, {_FILE} AS file FROM customer) SELECT id, CASE WHEN file LIKE '%AST_%' THEN 'ASTER' WHEN file LIKE '%LC08%' AND file NOT LIKE '%.tif' THEN 'Landsat' END AS sensor FROM f""")
def sensor_files(spark, sf_dir):
    """The sensor a product's name tells of, but for single bands."""
    f = table(spark, sf_dir, "customer").select(F.expr(_FILE.replace("c_custkey // 8", "c_custkey div 8")).alias("file"), F.col("c_custkey").alias("id"))
    return f.select("id", F.when(F.col("file").contains("AST_"), "ASTER").when(F.col("file").contains("LC08") & ~F.col("file").endswith(".tif"), "Landsat").alias("sensor"))


@query("robust_scale", f"WITH {RASTER}, m AS (SELECT median(value) AS m FROM raster) SELECT round(max(m), 6) AS median, round(2.5 * 1.4826 * median(abs(value - m)), 6) AS scale FROM raster, m")
def robust_scale(spark, sf_dir):
    return reports.robust_scale(raster(spark, sf_dir), "value").select(F.round("median", 6).alias("median"), F.round("scale", 6).alias("scale"))


@query("last_label", f"""WITH {CELLS}, b AS (SELECT min(price) AS p0, max(price) AS p1, min(tax) AS t0, max(tax) AS t1 FROM cells),
x AS (SELECT CAST(least(floor((price - p0) * 8 / (p1 - p0)), 7) AS INTEGER) AS bx, CAST(least(floor((tax - t0) * 6 / (t1 - t0)), 5) AS INTEGER) AS by_, scene, "row", col FROM cells, b) SELECT bx, by_ AS "by", count(*) AS n, arg_max(scene, (scene, "row", col)) AS label FROM x GROUP BY 1, 2""")
def last_label(spark, sf_dir):
    return reports.last_label(cells(spark, sf_dir), "price", "tax", "scene", ["scene", "row", "col"], 8, 6)


@query("segment_means", f"""WITH {CELLS} SELECT scene AS segment, round(avg(price), 5) AS price, round(avg(tax), 8) AS tax, round(avg(qty), 6) AS qty FROM cells GROUP BY 1""")
def segment_means(spark, sf_dir):
    """The mean vector of each segment."""
    return cells(spark, sf_dir).groupBy(F.col("scene").alias("segment")).agg(F.round(F.avg("price"), 5).alias("price"), F.round(F.avg("tax"), 8).alias("tax"), F.round(F.avg("qty"), 6).alias("qty"))


@query("tidy_columns", "SELECT n_nationkey AS nationkey, n_name AS \"name div text\", n_regionkey AS \"region key\" FROM nation")
def tidy_columns(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return reports.tidy_columns(n.select(F.col("n_nationkey").alias(" NationKey"), F.col("n_name").alias("Name / Text"), F.col("n_regionkey").alias("Region,Key")))


@query("band_checks", "SELECT count(DISTINCT c_mktsegment) AS bands, count(DISTINCT c_nationkey % 2) AS projections, count(DISTINCT c_nationkey * 0) AS nodata, false AS alike FROM customer")
def band_checks(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return reports.band_checks(c.select(F.col("c_mktsegment").alias("band"), (F.col("c_nationkey") % 2).cast("string").alias("crs"), (F.col("c_nationkey") * 0).alias("nodata")))


@query("rotated_tensors", """WITH z AS (SELECT l_orderkey AS id, l_linenumber AS k, CAST(l_quantity AS DOUBLE) AS a, CAST(l_discount AS DOUBLE) AS b, CAST(l_tax AS DOUBLE) AS c, CAST(l_linenumber AS DOUBLE) AS d, cos(radians(30)) AS x, sin(radians(30)) AS y FROM lineitem),
r AS (SELECT id, k, x, y, x * a + y * c AS p, x * b + y * d AS q, x * c - y * a AS s, x * d - y * b AS t FROM z) SELECT id, k, round((x * p + y * q) / sqrt(2), 6) AS xx, round((x * q - y * p) / sqrt(2), 6) AS xy, round((x * s + y * t) / sqrt(3), 6) AS yx, round((x * t - y * s) / sqrt(3), 6) AS yy FROM r""")
def rotated_tensors(spark, sf_dir):
    """Tensors turned, then freed of static shift."""
    turned = reports.rotated_impedance(*[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")], 30.0)
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), *[c.alias(n) for n, c in turned.items()])
    return t.select("id", "k", *[(F.round(c, 6) + 0.0).alias(n) for n, c in reports.without_shift(*map(F.col, turned), 2.0, 3.0).items()])


@query("error_ellipses")
def error_ellipses(spark, sf_dir):
    t, v = table(spark, sf_dir, "lineitem"), lambda c: F.col(c).cast("double")
    e = reports.error_ellipse(v("l_quantity"), v("l_linenumber"), v("l_tax"), v("l_discount"), F.lit(0.1), F.lit(0.2))
    return t.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), e.alias("e")).select("id", "k", F.round("e.major", 6).alias("major"), F.round("e.minor", 6).alias("minor"))


@query("intensity_hulls")
def intensity_hulls(spark, sf_dir):
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(((k * 7919) % 1000).alias("x"), ((k * 104729) % 1000).alias("y"), (k % 7).alias("intensity"))
    return reports.intensity_hulls(p, [2, 4, 6]).select("level", F.transform("hull", lambda q: F.concat_ws(" ", q["x"], q["y"])).alias("hull"))


@query("intensity_bands")
def intensity_bands(spark, sf_dir):
    """Places, and their mean intensity, between the hulls of felt levels: bands as polygons."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k.alias("id"), ((k * 7919) % 1000).cast("double").alias("x"), ((k * 104729) % 1000).cast("double").alias("y"), (k % 7).alias("intensity"))
    bands = reports.intensity_bands(reports.intensity_hulls(p, [2, 4, 6])).withColumnRenamed("level", "polygon")
    return joining.points_in_polygons(p, bands, 250.0).groupBy(F.col("polygon").alias("level")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("intensity"), 6).alias("mean"))


def model_text(spark, rows: list[str], name: str = "field-model") -> str:
    """A small model file in the shared folder."""
    folder = f"{shared_folder(spark)}/stratalite/{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([(r,) for r in rows], "text string").coalesce(1).write.text(folder)
    return folder


DIPOLE = ["   MADE2020  2020.00  1  1  0 2020.00 2025.00   -1.0  600.0", " 1  0 -29000.0 0.0 10.0 0.0", " 1  1 -1450.0 4650.0 8.0 -20.0"]


@query("field_of_model", """WITH p AS (SELECT c_custkey AS id, radians(CAST(c_custkey % 160 AS DOUBLE) - 80) AS la, radians(CAST(c_custkey % 360 AS DOUBLE)) AS lo, CAST(c_custkey % 1000 AS DOUBLE) / 1000 AS h, -28980.0::DOUBLE AS g0, -1434.0::DOUBLE AS g1, 4610.0::DOUBLE AS h1 FROM customer),
a AS (SELECT *, sqrt(40680631.59::DOUBLE * cos(la) ** 2 + 40408299.98::DOUBLE * sin(la) ** 2) AS d FROM p),
r AS (SELECT *, (40680631.59::DOUBLE / d + h) * cos(la) AS q, (40408299.98::DOUBLE / d + h) * sin(la) AS z FROM a),
u AS (SELECT *, sqrt(q * q + z * z) AS r, q / sqrt(q * q + z * z) AS s, z / sqrt(q * q + z * z) AS c FROM r),
m AS (SELECT *, power(6371.2 / r, 3) AS k, g1 * cos(lo) + h1 * sin(lo) AS e, g1 * sin(lo) - h1 * cos(lo) AS v FROM u)
SELECT id, round(k * sqrt((c * e - s * g0) ** 2 + v * v + 4 * (g0 * c + e * s) ** 2), 4) AS f FROM m""")
def field_of_model(spark, sf_dir):
    """Total intensity of a tilted dipole two years after its epoch."""
    models = harmonics.read_field_models(spark, model_text(spark, [DIPOLE[0].replace("  1  1  0 ", "  1  1  1 "), *DIPOLE[1:]]))
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k.alias("id"), ((k % 160).cast("double") - 80).alias("lat"), (k % 360).cast("double").alias("lon"), (k % 1000).cast("double").alias("height"))
    return magnetics.field(p, magnetics.coefficients(models, 2022.0)).select("id", F.round("f", 4).alias("f"))


@query("magnetic_anomaly")
def magnetic_anomaly(spark, sf_dir):
    models = harmonics.read_field_models(spark, model_text(spark, DIPOLE))
    r = raster(spark, sf_dir)
    heights = r.select("row", "col", (F.col("row") / 10 - 27).alias("lat"), (F.col("col") / 10 + 25).alias("lon"), F.lit(1200.0).alias("height"))
    return magnetics.anomaly(r, heights, magnetics.coefficients(models, 2021.0)).select("row", "col", F.round("value", 4).alias("value"))
