"""The library's views of the driver tables: survey points, raster cells, profile lines, a catalogue, voxels.

Each has a DataFrame form and the same as SQL, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z of survey points."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.col("l_quantity").cast("double").alias("x"), F.round(F.col("l_discount").cast("double") * 100).alias("y"), F.col("l_extendedprice").cast("double").alias("z"))


POINTS = "points AS (SELECT CAST(l_quantity AS DOUBLE) AS x, round(CAST(l_discount AS DOUBLE) * 100) AS y, CAST(l_extendedprice AS DOUBLE) AS z FROM lineitem)"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of three bands for each scene (ship year): scene, row, col, price, tax, qty."""
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.year("l_shipdate").alias("scene"), F.round(F.col("l_discount") * 100).cast("int").alias("row"), F.floor("l_quantity").cast("int").alias("col")).agg(
        F.avg(F.col("l_extendedprice").cast("double")).alias("price"), F.avg(F.col("l_tax").cast("double")).alias("tax"), F.avg(F.col("l_linenumber").cast("double")).alias("qty")
    )


CELLS = """cells AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS scene, CAST(round(l_discount * 100) AS INTEGER) AS "row", CAST(floor(l_quantity) AS INTEGER) AS col,
  avg(CAST(l_extendedprice AS DOUBLE)) AS price, avg(CAST(l_tax AS DOUBLE)) AS tax, avg(CAST(l_linenumber AS DOUBLE)) AS qty FROM lineitem GROUP BY 1, 2, 3)"""


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One band over all scenes: row, col, value."""
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.round(F.col("l_discount") * 100).cast("int").alias("row"), F.floor("l_quantity").cast("int").alias("col")).agg(F.avg(F.col("l_extendedprice").cast("double")).alias("value"))


RASTER = """raster AS (SELECT CAST(round(l_discount * 100) AS INTEGER) AS "row", CAST(floor(l_quantity) AS INTEGER) AS col, avg(CAST(l_extendedprice AS DOUBLE)) AS value FROM lineitem GROUP BY 1, 2)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings along lines: line, t (seconds), value, base (whether it is a reading at the base)."""
    t = table(spark, sf_dir, "events")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).cast("double")
    return t.select(F.col("user_id").cast("long").alias("line"), seconds.alias("t"), F.col("value").cast("double").alias("value"), (F.col("event_type") == "error").alias("base"), F.col("event_id").cast("long").alias("id"))


LINES = "lines AS (SELECT CAST(user_id AS BIGINT) AS line, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS t, CAST(value AS DOUBLE) AS value, event_type = 'error' AS base, CAST(event_id AS BIGINT) AS id FROM events)"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earthquakes: event, station, phase, mag, hour, day, t."""
    t = table(spark, sf_dir, "events")
    return t.select(
        F.col("event_id").cast("long").alias("event"), F.col("user_id").cast("long").alias("station"), F.col("event_type").alias("phase"),
        F.round(F.col("value").cast("double") / 100, 1).alias("mag"), F.hour("ts").cast("int").alias("hour"), F.to_date("ts").alias("day"), F.col("value").cast("double").alias("value"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).cast("double").alias("t"),
    )


CATALOGUE = """catalogue AS (SELECT CAST(event_id AS BIGINT) AS event, CAST(user_id AS BIGINT) AS station, event_type AS phase, round(CAST(value AS DOUBLE) / 100, 1) AS mag,
  CAST(hour(ts) AS INTEGER) AS hour, CAST(ts AS DATE) AS day, CAST(value AS DOUBLE) AS value, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS t FROM events)"""


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lithology model: i, j, k, lith, the most frequent flag of the cell (the least of equally frequent ones)."""
    t = table(spark, sf_dir, "lineitem")
    n = t.groupBy(F.floor("l_quantity").cast("int").alias("i"), F.round(F.col("l_discount") * 100).cast("int").alias("j"), F.col("l_linenumber").cast("int").alias("k"), F.col("l_returnflag").alias("lith")).count()
    return n.groupBy("i", "j", "k").agg(F.min(F.struct((-F.col("count")).alias("n"), "lith"))["lith"].alias("lith"))


VOXELS = """voxel_counts AS (SELECT CAST(floor(l_quantity) AS INTEGER) AS i, CAST(round(l_discount * 100) AS INTEGER) AS j, CAST(l_linenumber AS INTEGER) AS k, l_returnflag AS lith, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4),
voxels AS (SELECT i, j, k, lith FROM (SELECT *, row_number() OVER (PARTITION BY i, j, k ORDER BY n DESC, lith) AS rn FROM voxel_counts) WHERE rn = 1)"""
