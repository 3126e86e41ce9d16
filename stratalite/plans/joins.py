"""Queries of joins: equal keys, intervals, places, nearness, and readings in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalite.operators import joining, voxel

from .registry import query
from .views import CELLS, LINES, RASTER, VOXELS, cells, lines, raster, table, voxels


def _rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names or ("value",)})


@query("left_join_gps", """SELECT o_orderkey AS station, o_custkey AS line, c_nationkey AS x, c_name AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_nationkey < 10""")
def left_join_gps(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("station"), F.col("o_custkey").alias("line"))
    c = table(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("line"), F.col("c_nationkey").alias("x"), F.col("c_name").alias("name"))
    return joining.left_join_report(o, c, ["line"]).select("station", "line", "x", "name")


@query("duplicates_report", """SELECT l_orderkey AS line, l_linenumber AS station, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicates_report(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("station"))
    return joining.duplicates(t, ["line", "station"])


@query("unmatched_drop", """SELECT o_orderkey AS station FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_nationkey < 10 WHERE NOT (o_orderkey < 5000 AND c_custkey IS NULL)""")
def unmatched_drop(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("station"), F.col("o_custkey").alias("line"))
    c = table(spark, sf_dir, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("line"), F.lit(True).alias("known"))
    return o.join(c, "line", "left").where("NOT (station < 5000 AND known IS NULL)").select("station")


@query("semi_join_bands", """SELECT DISTINCT p_brand AS band FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)""")
def semi_join_bands(spark, sf_dir):
    big = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(big, "p_partkey", "left_semi").select(F.col("p_brand").alias("band")).distinct()


@query("anti_join_removed", """SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def anti_join_removed(spark, sf_dir):
    gone = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(gone, "c_custkey", "left_anti").select(F.col("c_custkey").alias("id"))


@query("union_scenes", f"""WITH {CELLS} SELECT "row", col, round(price, 6) AS value, CAST(NULL AS DOUBLE) AS extra FROM cells WHERE scene = 1996 UNION ALL SELECT "row", col, round(tax, 6), round(qty, 6) FROM cells WHERE scene = 1997""")
def union_scenes(spark, sf_dir):
    c = cells(spark, sf_dir)
    a = c.where("scene = 1996").select("row", "col", F.round("price", 6).alias("value"))
    b = c.where("scene = 1997").select("row", "col", F.round("tax", 6).alias("value"), F.round("qty", 6).alias("extra"))
    return a.unionByName(b, allowMissingColumns=True)


@query("intersect_bands", """SELECT p_brand AS band FROM part WHERE p_size < 10 INTERSECT SELECT p_brand FROM part WHERE p_size > 40""")
def intersect_bands(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.where("p_size < 10").select(F.col("p_brand").alias("band")).intersect(p.where("p_size > 40").select(F.col("p_brand").alias("band")))


@query("union_distinct_names", """SELECT n_name AS name FROM nation UNION SELECT r_name FROM region""")
def union_distinct_names(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf_dir, "region").select("r_name")).distinct()


@query("except_range", f"""WITH {CELLS} SELECT "row", col FROM cells EXCEPT SELECT "row", col FROM cells WHERE price > 38000""")
def except_range(spark, sf_dir):
    c = cells(spark, sf_dir)
    return c.select("row", "col").subtract(c.where("price > 38000").select("row", "col"))


@query("drift_interp", f"""WITH {LINES}, b AS (SELECT *, last_value(CASE WHEN base THEN t END IGNORE NULLS) OVER p AS ta, last_value(CASE WHEN base THEN value END IGNORE NULLS) OVER p AS va,
first_value(CASE WHEN base THEN t END IGNORE NULLS) OVER f AS tb, first_value(CASE WHEN base THEN value END IGNORE NULLS) OVER f AS vb FROM lines
WINDOW p AS (PARTITION BY line ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY line ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT line, id, round(coalesce(CASE WHEN tb > ta THEN va + (vb - va) * (t - ta) / (tb - ta) END, va, vb), 4) AS drift FROM b""")
def drift_interp(spark, sf_dir):
    return _rounded(joining.interpolate_base(lines(spark, sf_dir)), "drift", places=4).select("line", "id", "drift")


_PROPERTIES = [("A", 2.67, 0.01), ("N", 2.8, 0.02), ("R", 3.0, 0.05)]


@query("voxel_properties", f"""WITH {VOXELS}, p(lith, density, susceptibility) AS (VALUES ('A', 2.67, 0.01), ('N', 2.8, 0.02), ('R', 3.0, 0.05))
SELECT i, j, k, voxels.lith, CAST(density AS DOUBLE) AS density, CAST(susceptibility AS DOUBLE) AS susceptibility FROM voxels LEFT JOIN p ON voxels.lith = p.lith""")
def voxel_properties(spark, sf_dir):
    return voxel.with_properties(voxels(spark, sf_dir), spark.createDataFrame(_PROPERTIES, "lith string, density double, susceptibility double"))


@query("model_merge", f"""WITH {VOXELS}, m AS (SELECT * FROM voxels WHERE i <= 30), o AS (SELECT * FROM voxels WHERE i >= 20)
SELECT coalesce(m.i, o.i) AS i, coalesce(m.j, o.j) AS j, coalesce(m.k, o.k) AS k, CASE WHEN coalesce(m.lith, 'N') = 'N' THEN coalesce(o.lith, m.lith) ELSE m.lith END AS lith FROM m FULL JOIN o ON m.i = o.i AND m.j = o.j AND m.k = o.k""")
def model_merge(spark, sf_dir):
    v = voxels(spark, sf_dir)
    return voxel.merge(v.where("i <= 30"), v.where("i >= 20"), "N")


@query("carve_air", f"""WITH {VOXELS}, {RASTER} SELECT i, j, k, CASE WHEN k <= floor((50000 - value) / 5000) THEN 'air' ELSE lith END AS lith FROM voxels LEFT JOIN raster ON i = col AND j = "row" """)
def carve_air(spark, sf_dir):
    surface = raster(spark, sf_dir).select(F.col("col").alias("i"), F.col("row").alias("j"), F.col("value").alias("height"))
    return voxel.carve(voxels(spark, sf_dir), surface, 5000.0, 50000.0)


@query("borehole_intervals", """WITH l AS (SELECT l_orderkey AS hole, l_linenumber * 4.0 - 4 AS a, l_linenumber * 4.0 - 4 + CAST(l_quantity AS DOUBLE) / 5 AS b, l_returnflag AS label FROM lineitem),
k AS (SELECT hole, label, unnest(range(CAST(floor(a / 3) AS BIGINT), CAST(greatest(ceil(b / 3) - 1, floor(a / 3)) AS BIGINT) + 1)) AS layer FROM l)
SELECT hole, CAST(layer AS INTEGER) AS layer, string_agg(DISTINCT label, '/' ORDER BY label) AS labels FROM k GROUP BY 1, 2""")
def borehole_intervals(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    top = F.col("l_linenumber") * 4.0 - 4
    logs = t.select(F.col("l_orderkey").alias("hole"), top.alias("depth_from"), (top + F.col("l_quantity").cast("double") / 5).alias("depth_to"), F.col("l_returnflag").alias("label"))
    return voxel.interval_labels(logs, 3.0)


_PLACES = """a AS (SELECT c_custkey AS lid, (c_custkey * 7919 % 1000) / 10.0 AS lx, (c_custkey * 104729 % 1000) / 10.0 AS ly FROM customer), b AS (SELECT s_suppkey AS rid, (s_suppkey * 7907 % 1000) / 10.0 AS rx, (s_suppkey * 104723 % 1000) / 10.0 AS ry FROM supplier)"""


def _places(spark, sf_dir):
    at = lambda key, m: ((F.col(key) * m) % 1000) / 10.0
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("lid"), at("c_custkey", 7919).alias("lx"), at("c_custkey", 104729).alias("ly"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rid"), at("s_suppkey", 7907).alias("rx"), at("s_suppkey", 104723).alias("ry"))
    return a, b


_APART = f"""{_PLACES}, w AS (SELECT lid, rid, power(lx - rx, 2) + power(ly - ry, 2) AS d2 FROM a, b)"""


@query("nearest_point", f"""WITH {_APART} SELECT lid, rid, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY d2, rid) AS rn FROM w) WHERE rn = 1""")
def nearest_point(spark, sf_dir):
    return _rounded(joining.nearest(*_places(spark, sf_dir), 2.0), "d2")


@query("knn_points", f"""WITH {_APART} SELECT lid, rid, round(d2, 6) AS d2, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY d2, rid) AS rn FROM w) WHERE rn <= 3""")
def knn_points(spark, sf_dir):
    return _rounded(joining.knn(*_places(spark, sf_dir), 3, 4.0).select("lid", "rid", "d2", "rank"), "d2")


@query("point_in_polygon", f"""WITH {_PLACES}, t(polygon, x1, y1, x2, y2, x3, y3) AS (VALUES (1, 10.05, 10.05, 60.05, 12.05, 30.05, 70.05), (2, 55.05, 50.05, 95.05, 60.05, 70.05, 95.05))
SELECT polygon, lid AS id FROM a, t WHERE
((x2 - x1) * (ly - y1) - (y2 - y1) * (lx - x1) > 0) = ((x3 - x2) * (ly - y2) - (y3 - y2) * (lx - x2) > 0) AND ((x3 - x2) * (ly - y2) - (y3 - y2) * (lx - x2) > 0) = ((x1 - x3) * (ly - y3) - (y1 - y3) * (lx - x3) > 0)""")
def point_in_polygon(spark, sf_dir):
    a, _ = _places(spark, sf_dir)
    ring = lambda *p: [[(x, y) for x, y in (*p, p[0])]]
    shapes = [(1, ring((10.05, 10.05), (60.05, 12.05), (30.05, 70.05))), (2, ring((55.05, 50.05), (95.05, 60.05), (70.05, 95.05)))]
    polygons = spark.createDataFrame(shapes, "polygon int, rings array<array<struct<x: double, y: double>>>")
    return joining.points_in_polygons(a.select(F.col("lid").alias("id"), F.col("lx").alias("x"), F.col("ly").alias("y")), polygons, 10.0).select("polygon", "id")


@query("bilinear_sample", f"""WITH {RASTER}, p AS (SELECT c_custkey AS id, (c_custkey * 7919 % 470) / 10.0 + 1.05 AS x, (c_custkey * 104729 % 90) / 10.0 + 0.05 AS y FROM customer)
SELECT id, round(a.value * (1 - (x - floor(x))) * (1 - (y - floor(y))) + b.value * (x - floor(x)) * (1 - (y - floor(y))) + c.value * (1 - (x - floor(x))) * (y - floor(y)) + d.value * (x - floor(x)) * (y - floor(y)), 4) AS value
FROM p LEFT JOIN raster a ON a."row" = floor(y) AND a.col = floor(x) LEFT JOIN raster b ON b."row" = floor(y) AND b.col = floor(x) + 1 LEFT JOIN raster c ON c."row" = floor(y) + 1 AND c.col = floor(x) LEFT JOIN raster d ON d."row" = floor(y) + 1 AND d.col = floor(x) + 1""")
def bilinear_sample(spark, sf_dir):
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k.alias("id"), (((k * 7919) % 470) / 10.0 + 1.05).alias("x"), (((k * 104729) % 90) / 10.0 + 0.05).alias("y"))
    return _rounded(joining.bilinear(p, raster(spark, sf_dir)), places=4)


@query("band_nearest", """WITH w(wanted) AS (VALUES (500.0), (861.0), (2200.0)), b AS (SELECT p_partkey AS band, 400 + p_partkey * 13 % 2100 AS wavelength FROM part)
SELECT CAST(wanted AS DOUBLE) AS wanted, band, CAST(wavelength AS DOUBLE) AS wavelength FROM (SELECT *, row_number() OVER (PARTITION BY wanted ORDER BY abs(wavelength - wanted), wavelength, band) AS rn FROM w, b) WHERE rn = 1""")
def band_nearest(spark, sf_dir):
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("band"), (400 + (F.col("p_partkey") * 13) % 2100).cast("double").alias("wavelength"))
    return joining.nearest_band(b, [500.0, 861.0, 2200.0])


_SEGMENTS = """s AS (SELECT c_custkey AS id, CAST(c_custkey * 7919 % 1000 AS DOUBLE) / 10 AS x1, CAST(c_custkey * 104729 % 1000 AS DOUBLE) / 10 AS y1, CAST(c_custkey * 7919 % 1000 AS DOUBLE) / 10 + (CAST(c_custkey * 31 % 70 AS DOUBLE) / 10 - CAST(3.05 AS DOUBLE)) AS x2, CAST(c_custkey * 104729 % 1000 AS DOUBLE) / 10 + (CAST(c_custkey * 37 % 80 AS DOUBLE) / 10 - CAST(4.05 AS DOUBLE)) AS y2 FROM customer)"""


def _binary(c, scale):
    """Rounded as the SQL does it, by binary values and halves away from zero: Spark's own rounding goes by their shortest decimals, and ties differ."""
    v = F.abs(F.col(c) * scale)
    whole = F.floor(v)
    return (F.signum(c) * (whole + (v - whole >= 0.5).cast("int")) / scale).alias(c)


@query("segment_crossings", f"""WITH {_SEGMENTS}, p AS (SELECT a.id AS a, b.id AS b, a.x1, a.y1, a.x2 - a.x1 AS rx, a.y2 - a.y1 AS ry, b.x2 - b.x1 AS sx, b.y2 - b.y1 AS sy, b.x1 - a.x1 AS qx, b.y1 - a.y1 AS qy FROM s a JOIN s b ON a.id < b.id),
t AS (SELECT *, (qx * sy - qy * sx) / nullif(rx * sy - ry * sx, 0) AS t, (qx * ry - qy * rx) / nullif(rx * sy - ry * sx, 0) AS u FROM p)
SELECT a, b, round(x1 + t * rx, 9) AS x, round(y1 + t * ry, 9) AS y FROM t WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1""")
def segment_crossings(spark, sf_dir):
    k = F.col("c_custkey")
    s = table(spark, sf_dir, "customer").select(k.alias("id"), (((k * 7919) % 1000) / 10.0).alias("x1"), (((k * 104729) % 1000) / 10.0).alias("y1"), ((k * 31) % 70 / 10.0 - 3.05).alias("dx"), ((k * 37) % 80 / 10.0 - 4.05).alias("dy"))
    s = s.select("id", "x1", "y1", (F.col("x1") + F.col("dx")).alias("x2"), (F.col("y1") + F.col("dy")).alias("y2"))
    return joining.segment_crossings(s, 5.0).select("a", "b", _binary("x", 1e9), _binary("y", 1e9))


@query("cell_residual", f"""WITH {CELLS} SELECT a."row", a.col, round(a.price - b.price, 4) AS residual FROM cells a JOIN cells b ON a."row" = b."row" AND a.col = b.col AND a.scene = 1995 AND b.scene = 1999""")
def cell_residual(spark, sf_dir):
    """Observed less calculated, on the cells of both."""
    c = cells(spark, sf_dir)
    both = c.where("scene = 1995").alias("a").join(c.where("scene = 1999").select("row", "col", F.col("price").alias("calculated")), ["row", "col"])
    return both.select("row", "col", F.round(F.col("price") - F.col("calculated"), 4).alias("residual"))


@query("index_gather", f"""WITH {RASTER}, g AS (SELECT "row", col, (col * 3 + "row") % 60 AS gx, "row" AS gy FROM raster) SELECT g."row", g.col, round(r.value, 6) AS value FROM g LEFT JOIN raster r ON g.gx > 0 AND r.col = g.gx AND r."row" = g.gy""")
def index_gather(spark, sf_dir):
    """A geometry lookup: each cell takes the value that its indices point at, none if they are 0."""
    r = raster(spark, sf_dir)
    g = r.select("row", "col", ((F.col("col") * 3 + F.col("row")) % 60).alias("gx"), F.col("row").alias("gy")).withColumn("gx", F.when(F.col("gx") > 0, F.col("gx")))
    return _rounded(g.join(r.select(F.col("row").alias("gy"), F.col("col").alias("gx"), "value"), ["gx", "gy"], "left").select("row", "col", "value"))
