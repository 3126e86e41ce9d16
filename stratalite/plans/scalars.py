"""Queries of scalar functions: gravity, places, names, spectra."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalite.functions import geo, gravity, spectra

from .registry import query
from .views import table


def _rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


_STATIONS = "stations AS (SELECT c_custkey AS id, -35 + (c_custkey % 1000) / 80.0 AS lat, 16 + (c_custkey * 7 % 1700) / 100.0 AS lon, CAST(c_custkey * 13 % 1800 AS DOUBLE) AS h, 978500 + (c_custkey * 17 % 9000) / 10.0 AS g FROM customer)"


def _stations(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (-35 + (k % 1000) / 80.0).alias("lat"), (16 + (k * 7) % 1700 / 100.0).alias("lon"), ((k * 13) % 1800).cast("double").alias("h"), (978500 + (k * 17) % 9000 / 10.0).alias("g"))


_ALPHA = "166700.0 / 6371000.0"


@query("bouguer", f"""WITH {_STATIONS}, c AS (SELECT 3 * cos({_ALPHA}) ** 2 - 2 AS d, cos({_ALPHA}) AS f, sin({_ALPHA}) ** 2 AS k, -3 * sin({_ALPHA}) ** 2 * cos({_ALPHA}) AS m,
-6 * cos({_ALPHA}) ** 2 * sin({_ALPHA} / 2) + 4 * sin({_ALPHA} / 2) ** 3 AS p, 2 * (sin({_ALPHA} / 2) - sin({_ALPHA} / 2) ** 2) AS n),
s AS (SELECT *, sin(radians(lat)) ** 2 AS s2, 6371000.0 / (6371000.0 + h) AS delta, h / (6371000.0 + h) AS eta, 6371000.0 + h AS r FROM stations, c),
b AS (SELECT *, sqrt((f - delta) ** 2 + k) AS q FROM s),
a AS (SELECT id, 978032.67715 * (1 + 0.001931851353 * s2) / sqrt(1 - 0.0066943800229 * s2) AS gt, 0.874 - 9.9e-5 * h + 3.56e-9 * h * h AS atm, -(0.308769109 - 0.000439773 * s2) * h + 7.2125e-8 * h * h AS hc,
2 * pi() * 6.67384e-11 * 2670 * 1e5 * ((eta * eta / 3 - eta) * h - ((d + f * delta + delta * delta) * q + p + m * ln(n / (f - delta + q))) / 3 * r) AS sb, g FROM b)
SELECT id, round(gt, 4) AS theoretical, round(sb, 4) AS cap, round(g - gt + atm - hc - sb, 4) AS anomaly FROM a""")
def bouguer(spark, sf_dir):
    s = _stations(spark, sf_dir)
    return s.select("id", F.round(gravity.theoretical(F.col("lat")), 4).alias("theoretical"), F.round(gravity.spherical_bouguer(F.col("h"), 2670.0), 4).alias("cap"), F.round(gravity.bouguer(F.col("g"), F.col("lat"), F.col("h")), 4).alias("anomaly"))


@query("geocentric_radius", f"""WITH {_STATIONS}, r AS (SELECT id, power(6378137.0, 2) * cos(radians(lat)) AS ac, power(6356752.314245, 2) * sin(radians(lat)) AS bs, 6378137.0 * cos(radians(lat)) AS a, 6356752.314245 * sin(radians(lat)) AS b FROM stations)
SELECT id, round(sqrt((ac * ac + bs * bs) / (a * a + b * b)), 3) AS radius FROM r""")
def geocentric_radius(spark, sf_dir):
    return _stations(spark, sf_dir).select("id", F.round(gravity.radius(F.radians("lat")), 3).alias("radius"))


@query("map_sheet", f"""WITH {_STATIONS}, s AS (SELECT id, abs(lat) AS a, abs(lon) AS o FROM stations)
SELECT id, lpad(CAST(CAST(floor(a) AS INTEGER) AS VARCHAR), 2, '0') || lpad(CAST(CAST(floor(o) AS INTEGER) AS VARCHAR), 2, '0')
|| substr('ABCD', CAST(2 * floor((a % 1) * 2) + floor((o % 1) * 2) + 1 AS INTEGER), 1) || substr('ABCD', CAST(2 * floor((a * 2 % 1) * 2) + floor((o * 2 % 1) * 2) + 1 AS INTEGER), 1) AS sheet FROM s""")
def map_sheet(spark, sf_dir):
    return _stations(spark, sf_dir).select("id", geo.map_sheet(F.col("lat"), F.col("lon")).alias("sheet"))


@query("utm_zone", f"""WITH {_STATIONS} SELECT id, CASE WHEN lat >= -30 THEN '326' ELSE '327' END || lpad(CAST(CAST(floor((lon * 5 - 180 + 180) / 6) % 60 + 1 AS INTEGER) AS VARCHAR), 2, '0') AS epsg FROM stations""")
def utm_zone(spark, sf_dir):
    return _stations(spark, sf_dir).select("id", geo.utm_zone(F.col("lon") * 5 - 180, F.col("lat") + 30).alias("epsg"))


@query("wrap_longitude", f"""WITH {_STATIONS}, w AS (SELECT id, (lon * 20 - 180) % 360 AS m FROM stations) SELECT id, round((CASE WHEN m < 0 THEN m + 360 ELSE m END) - 180, 6) AS lon FROM w""")
def wrap_longitude(spark, sf_dir):
    return _rounded(_stations(spark, sf_dir).select("id", geo.wrap_longitude(F.col("lon") * 20).alias("lon")), "lon")


@query("text_numbers", """SELECT p_partkey AS id, CASE WHEN trim(p_size || CASE WHEN p_size % 3 = 0 THEN ' x' ELSE '' END) NOT IN ('', '*', 'N/A', '99.99', '999.9') THEN TRY_CAST(p_size || CASE WHEN p_size % 3 = 0 THEN ' x' ELSE '' END AS DOUBLE) END AS value FROM part""")
def text_numbers(spark, sf_dir):
    text = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 3 == 0, " x").otherwise(""))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), geo.number_or_null(text).alias("value"))


@query("natural_sort", """WITH n AS (SELECT p_partkey AS id, 'B' || CAST(p_partkey % 120 AS VARCHAR) || 'a' AS name FROM part) SELECT id, name, CAST(dense_rank() OVER (ORDER BY id % 120) AS INTEGER) AS place FROM n""")
def natural_sort(spark, sf_dir):
    """Distinct names are ranked, not rows: a raster has so many bands at most."""
    from pyspark.sql import Window

    n = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("B"), (F.col("p_partkey") % 120).cast("string"), F.lit("a")).alias("name"))
    names = n.select("name").distinct().withColumn("place", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(geo.natural_key(F.col("name")))))
    return n.join(names, "name").select("id", "name", "place")


@query("clock_seconds", """SELECT CAST(event_id AS BIGINT) AS id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INTEGER) AS seconds FROM events""")
def clock_seconds(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("long").alias("id"), geo.seconds_of_day(F.date_format("ts", "HH:mm:ss")).cast("int").alias("seconds"))


@query("decimal_year", """SELECT o_orderkey AS id, round(year(o_orderdate) + dayofyear(o_orderdate) / CAST(dayofyear(make_date(CAST(year(o_orderdate) AS INTEGER), 12, 31)) AS DOUBLE), 6) AS year FROM orders""")
def decimal_year(spark, sf_dir):
    return _rounded(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), geo.decimal_year(F.to_date("o_orderdate")).alias("year")), "year")


@query("hemisphere_number", """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN -CAST(c_custkey AS DOUBLE) ELSE CAST(c_custkey AS DOUBLE) END AS value FROM customer""")
def hemisphere_number(spark, sf_dir):
    text = F.concat(F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, " S").otherwise(" N"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), geo.hemisphere_number(text).alias("value"))


@query("field_angles", f"""WITH {_STATIONS} SELECT id, round(degrees(atan2(lon, lat)), 5) AS d, round(degrees(atan2(h, sqrt(lat * lat + lon * lon))), 5) AS i, round(sqrt(lat * lat + lon * lon), 5) AS h, round(sqrt(lat * lat + lon * lon + h * h), 5) AS f FROM stations""")
def field_angles(spark, sf_dir):
    s = _stations(spark, sf_dir)
    return s.select("id", *[F.round(c, 5).alias(n) for n, c in geo.field_angles(F.col("lat"), F.col("lon"), F.col("h")).items()])


@query("remanence", f"""WITH {_STATIONS} SELECT id, round(h / (400 * pi()), 6) AS magnetisation, round(CASE WHEN (id % 5) = 0 THEN 0 ELSE (h / (400 * pi())) / ((id % 5) * 0.01 * 28000 / (400 * pi())) END, 6) AS q FROM stations""")
def remanence(spark, sf_dir):
    s = _stations(spark, sf_dir)
    return s.select("id", *[F.round(c, 6).alias(n) for n, c in geo.remanence(F.col("h"), (F.col("id") % 5) * 0.01, 28000.0).items()])


_PAIR = "p AS (SELECT a.vec_id AS id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("x")).join(e.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("y")), "id")


@query("spectral_angle", f"""WITH {_PAIR} SELECT id, round(acos(greatest(least(list_inner_product(x, y) / sqrt(list_inner_product(x, x) * list_inner_product(y, y)), 1), -1)), 6) AS value FROM p""")
def spectral_angle(spark, sf_dir):
    return _rounded(_pairs(spark, sf_dir).select("id", spectra.spectral_angle(F.col("x"), F.col("y")).alias("value")), "value")


@query("spectral_correlation", f"""WITH {_PAIR}, u AS (SELECT id, unnest(x) AS x, unnest(y) AS y FROM p) SELECT id, round(corr(x, y), 6) AS value FROM u GROUP BY 1""")
def spectral_correlation(spark, sf_dir):
    return _rounded(_pairs(spark, sf_dir).select("id", spectra.spectral_correlation(F.col("x"), F.col("y")).alias("value")), "value")


@query("sensor_scaling", """SELECT l_orderkey AS id, l_linenumber AS band, round(CASE WHEN l_quantity <> 1 THEN CAST(l_quantity AS DOUBLE) * 0.0000275 - 0.2 END, 8) AS reflectance, round(1321.0789 / ln(774.8853 / (CAST(l_quantity AS DOUBLE) * 0.1 + 0.1) + 1), 5) AS kelvin FROM lineitem""")
def sensor_scaling(spark, sf_dir):
    dn = F.col("l_quantity").cast("double")
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("band"), F.round(spectra.sensor_reflectance(dn, 0.0000275, -0.2, 1), 8).alias("reflectance"), F.round(spectra.brightness_temperature(dn, 0.1, 0.1, 774.8853, 1321.0789), 5).alias("kelvin"))
