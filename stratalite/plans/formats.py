"""Queries that write a view in a format and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stratalite.session import shared_folder
from stratalite.sources import grids, nordic, points, raw

from .registry import query
from .views import LINES, RASTER, VOXELS, lines, raster, table, voxels


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/stratalite/{name}-{uuid.uuid4().hex}"


@query("ascii_grid_round_trip", f"""WITH {RASTER} SELECT "row", col, 100 + (col - 1 + 1.5) * 2 AS x, 50 + (10 - "row" + 0.5) * 2 AS y, round(CASE WHEN col % 7 <> 0 THEN value END, 6) AS value FROM raster""")
def ascii_grid_round_trip(spark, sf_dir):
    cells, folder = raster(spark, sf_dir).withColumn("value", F.when(F.col("col") % 7 != 0, F.col("value"))), _folder(spark, "grid")
    grids.write_ascii_grid(cells, folder, 100.0, 50.0, 2.0)
    return grids.read_ascii_grid(spark, folder).where("col > 0").select("row", "col", "x", "y", F.round("value", 6).alias("value"))


@query("xyz_grid_round_trip", f"""WITH {RASTER} SELECT "row" - (SELECT min("row") FROM raster) AS "row", col - (SELECT min(col) FROM raster) AS col, round(value, 6) AS value FROM raster""")
def xyz_grid_round_trip(spark, sf_dir):
    folder = _folder(spark, "xyz")
    grids.write_xyz_grid(raster(spark, sf_dir), folder, 0.0, 100.0, 5.0)
    return grids.read_xyz_grid(spark, folder).withColumn("value", F.round("value", 6))


@query("delimited_round_trip", "SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS line, CAST(c_custkey % 360 AS DOUBLE) AS x, CAST(c_custkey % 180 AS DOUBLE) AS y, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey END AS value FROM customer")
def delimited_round_trip(spark, sf_dir):
    k, folder = F.col("c_custkey"), _folder(spark, "points")
    t = table(spark, sf_dir, "customer").select(k.alias("ID"), F.col("c_nationkey").alias("Line"), (k % 360).alias("Longitude"), (k % 180).alias("Latitude"), F.when(k % 10 != 0, k).otherwise(-99999).alias("Value"))
    points.write_delimited(t, folder, sep="\t")
    got = points.read_delimited(spark, folder, sep="\t", nodata=-99999)
    return got.select(F.col("id").cast("long").alias("id"), "line", "x", "y", F.col("value").cast("long").alias("value"))


@query("geosoft_xyz_round_trip", f"""WITH {LINES} SELECT CAST(line AS VARCHAR) AS line, id, CASE WHEN id % 9 <> 0 THEN value END AS value FROM lines""")
def geosoft_xyz_round_trip(spark, sf_dir):
    folder = _folder(spark, "geosoft")
    points.write_geosoft_xyz(lines(spark, sf_dir).withColumn("value", F.when(F.col("id") % 9 != 0, F.col("value"))), folder, "line", "t", ["id", "value"])
    got = points.read_geosoft_xyz(spark, folder)
    return got.select("line", F.col("values")["id"].cast("long").alias("id"), F.col("values")["value"].alias("value"))


@query("voxel_csv_round_trip", f"""WITH {VOXELS}, o AS (SELECT min(i) AS i, min(j) AS j, min(k) AS k FROM voxels) SELECT v.i - o.i AS i, v.j - o.j AS j, v.k - o.k AS k, lith FROM voxels v, o""")
def voxel_csv_round_trip(spark, sf_dir):
    folder = _folder(spark, "voxels")
    v = voxels(spark, sf_dir).select(F.col("i") * 50.0, F.col("j") * 25.0, F.col("k") * -10.0, "lith")
    v.write.csv(folder)
    return points.read_voxel_points(spark, folder)


_QUAKES = """e AS (SELECT event_id AS event, 2000 + event_id % 20 AS year, 1 + event_id % 12 AS month, 1 + event_id % 28 AS day, CAST(event_id % 60000 AS DOUBLE) / 1000 - 30 AS latitude, CAST(event_id % 90000 AS DOUBLE) / 1000 AS longitude, CAST(1 + event_id % 60 AS DOUBLE) / 10 AS magnitude_1, event_type, value, user_id FROM events)"""


@query("nordic_round_trip", f"""WITH {_QUAKES} SELECT CAST(row_number() OVER (ORDER BY event) - 1 AS BIGINT) AS event, year, month, day, round(latitude, 3) AS latitude, round(longitude, 3) AS longitude, magnitude_1, 'S' || CAST(user_id % 1000 AS VARCHAR) AS station, upper(substr(event_type, 1, 1)) AS phase, CAST(event % 600 AS DOUBLE) / 10 AS second FROM e""")
def nordic_round_trip(spark, sf_dir):
    k, folder, none = F.col("event_id"), _folder(spark, "nordic"), lambda t: F.lit(None).cast(t)
    t = table(spark, sf_dir, "events")
    made = {"year": 2000 + k % 20, "month": 1 + k % 12, "day": 1 + k % 28, "latitude": (k % 60000).cast("double") / 1000 - 30, "longitude": (k % 90000).cast("double") / 1000, "magnitude_1": (1 + k % 60).cast("double") / 10, "type_1": F.lit("L")}
    events = t.select(k.alias("event"), *[made.get(n, none(kind)).alias(n) for n, _, _, kind in nordic.EVENT])
    pick = {"station": F.concat(F.lit("S"), F.col("user_id") % 1000), "phase": F.upper(F.substring("event_type", 1, 1)), "second": (k % 600).cast("double") / 10}
    phases = t.select(k.alias("event"), *[pick.get(n, none(kind)).alias(n) for n, _, _, kind in nordic.PHASE])
    nordic.write_events(events, phases, folder)
    got = nordic.denormalised(*nordic.read_events(spark, folder))
    return got.select(F.col("event").cast("long").alias("event"), *[F.col(c).cast("long").alias(c) for c in ("year", "month", "day")], "latitude", "longitude", "magnitude_1", F.col("phase_station").alias("station"), F.col("phase_phase").alias("phase"), F.col("phase_second").alias("second"))


@query("raw_raster_round_trip", f"""WITH {RASTER}, s AS (SELECT max("row") AS r, max(col) AS c FROM raster), l AS (SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col FROM (SELECT unnest(range(0, (SELECT r + 1 FROM s))) AS r), (SELECT unnest(range(0, (SELECT c + 1 FROM s))) AS c))
SELECT l."row", l.col, round(CASE WHEN l.col % 7 <> 0 THEN value END, 6) AS b1, round(value / 2, 6) AS b2 FROM l LEFT JOIN raster USING ("row", col)""")
def raw_raster_round_trip(spark, sf_dir):
    cells, folder = raster(spark, sf_dir).select("row", "col", F.when(F.col("col") % 7 != 0, F.col("value")).alias("a"), (F.col("value") / 2).alias("b")), _folder(spark, "raw")
    options = raw.write_raw(cells, folder, ["a", "b"], "<f8", rows_a_part=4)
    return raw.read_raw(spark, folder, **options).select("row", "col", F.round("b1", 6).alias("b1"), F.round("b2", 6).alias("b2"))


@query("raw_raster_window", f"""WITH {RASTER} SELECT "row", col, round(value, 6) AS b1 FROM raster WHERE "row" BETWEEN 3 AND 6 AND col BETWEEN 10 AND 20""")
def raw_raster_window(spark, sf_dir):
    """A window of a raw raster, pushed to the byte ranges that are read."""
    folder = _folder(spark, "raw")
    options = raw.write_raw(raster(spark, sf_dir), folder, ["value"], "<f8", "pixel", rows_a_part=4)
    found = raw.read_raw(spark, folder, **options).where("row BETWEEN 3 AND 6 AND col BETWEEN 10 AND 20")
    return found.where("b1 IS NOT NULL").withColumn("b1", F.round("b1", 6))
