"""Queries of statistics over bands, columns and classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalite.operators import stats

from .registry import query
from .views import RASTER, CATALOGUE, catalogue, points, POINTS, raster, table, voxels, VOXELS
from stratalite.operators import voxel


def _rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


_BANDS = ["l_quantity", "l_extendedprice", "l_tax"]
_LONG = "l AS (" + " UNION ALL ".join(f"SELECT '{b}' AS band, CAST({b} AS DOUBLE) AS value FROM lineitem" for b in _BANDS) + ")"


@query("basic_stats", f"""WITH {_LONG}, m AS (SELECT band, avg(value) AS m, median(value) AS med FROM l GROUP BY 1),
a AS (SELECT l.band, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_pop(value) AS std, median(value) AS median, count(value) AS n,
avg(power(value - m, 3)) / power(stddev_pop(value), 3) AS skew, avg(power(value - m, 4)) / power(stddev_pop(value), 4) - 3 AS kurtosis, median(abs(value - med)) AS mad FROM l JOIN m ON l.band = m.band GROUP BY 1)
SELECT band, min, max, round(mean, 5) AS mean, round(std, 5) AS std, median, n, round(skew, 5) AS skew, round(kurtosis, 5) AS kurtosis, round(mad, 6) AS mad FROM a""")
def basic_stats(spark, sf_dir):
    return _rounded(_rounded(stats.band_statistics(table(spark, sf_dir, "lineitem"), _BANDS), "mean", "std", "skew", "kurtosis", places=5), "mad")


@query("vector_stats", """WITH l AS (SELECT 'o_totalprice' AS band, CAST(o_totalprice AS DOUBLE) AS value FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders)
SELECT band, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, median(value) AS median, min(value) AS min, max(value) AS max FROM l GROUP BY 1""")
def vector_stats(spark, sf_dir):
    return _rounded(stats.column_statistics(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"]), "mean", "std", places=4)


@query("class_stats", """SELECT l_returnflag AS label, band, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM (
SELECT l_returnflag, 'l_quantity' AS band, CAST(l_quantity AS DOUBLE) AS value FROM lineitem UNION ALL SELECT l_returnflag, 'l_extendedprice', CAST(l_extendedprice AS DOUBLE) FROM lineitem) GROUP BY 1, 2""")
def class_stats(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "label")
    return _rounded(stats.class_statistics(t, "label", ["l_quantity", "l_extendedprice"]), "mean", "std", places=4)


_PAIRS = [("l_quantity", "l_quantity"), ("l_quantity", "l_extendedprice"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_extendedprice"), ("l_extendedprice", "l_tax"), ("l_tax", "l_tax")]


@query("corr_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS value FROM lineitem" for a, b in _PAIRS))
def corr_matrix(spark, sf_dir):
    return _rounded(stats.pair_table(table(spark, sf_dir, "lineitem"), _BANDS, "corr"), "value")


@query("corr_percent_lower", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CAST(round_even(100 * corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 0) AS INTEGER) AS value FROM lineitem" for a, b in _PAIRS))
def corr_percent_lower(spark, sf_dir):
    return stats.pair_table(table(spark, sf_dir, "lineitem"), _BANDS, "corr").withColumn("value", F.coalesce(F.bround(F.col("value") * 100), F.lit(0)).cast("int"))


@query("covariance", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 3) AS value FROM lineitem" for a, b in _PAIRS))
def covariance(spark, sf_dir):
    return _rounded(stats.pair_table(table(spark, sf_dir, "lineitem"), _BANDS, "cov"), "value", places=3)


@query("histogram_fixed", """WITH s AS (SELECT min(value) AS a, max(value) AS b FROM events), h AS (SELECT CAST(least(floor((value - a) * 50 / (b - a)), 49) AS INTEGER) AS bin, a, b, count(*) AS n FROM events, s GROUP BY 1, 2, 3)
SELECT bin, round(a + (b - a) / 50 * bin, 6) AS low, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS running FROM h""")
def histogram_fixed(spark, sf_dir):
    return _rounded(stats.fixed_histogram(table(spark, sf_dir, "events"), "value", 50), "low")


@query("histogram_export256", f"""WITH {RASTER}, s AS (SELECT min(value) AS a, max(value) AS b FROM raster)
SELECT CAST(least(floor((value - a) * 256 / (b - a)), 255) AS INTEGER) AS bin, count(*) AS n FROM raster, s GROUP BY 1""")
def histogram_export256(spark, sf_dir):
    return stats.fixed_histogram(raster(spark, sf_dir), "value", 256).select("bin", "n")


@query("histogram_weighted", """SELECT CAST(floor(CAST(l_quantity AS DOUBLE) / 3) AS INTEGER) AS bin, round(sum(CAST(l_extendedprice AS DOUBLE)), 2) AS weight FROM lineitem GROUP BY 1""")
def histogram_weighted(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("w"))
    return _rounded(stats.weighted_histogram(t, "x", "w", 3.0), "weight", places=2)


@query("histogram_2d", f"""WITH {POINTS}, s AS (SELECT min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1 FROM points)
SELECT CAST(least(floor((x - x0) * 10 / (x1 - x0)), 9) AS INTEGER) AS bx, CAST(least(floor((z - z0) * 12 / (z1 - z0)), 11) AS INTEGER) AS "by", count(*) AS n FROM points, s GROUP BY 1, 2""")
def histogram_2d(spark, sf_dir):
    return stats.histogram_2d(points(spark, sf_dir), "x", "z", 10, 12)


def _zoom(k: int) -> str:
    return f"""h{k} AS (SELECT coalesce(least(floor((v - a) * 255 / nullif(b - a, 0)), 254), 0) AS bin, a, b, count(*) AS n FROM v, z{k} WHERE v BETWEEN a AND b GROUP BY 1, 2, 3 ORDER BY n DESC, bin LIMIT 1),
z{k + 1} AS (SELECT a + (b - a) / 255 * bin AS a, a + (b - a) / 255 * (bin + 1) AS b FROM h{k})"""


@query("histogram_mode", f"""WITH v AS (SELECT CAST(value AS DOUBLE) AS v FROM events), z0 AS (SELECT min(v) AS a, max(v) AS b FROM v), {_zoom(0)}, {_zoom(1)}
SELECT round((a + b) / 2, 5) AS mode FROM z2""")
def histogram_mode(spark, sf_dir):
    return _rounded(stats.modal_value(table(spark, sf_dir, "events"), "value"), "mode", places=5)


@query("display_limits", f"""WITH {RASTER} SELECT round(avg(value) - 2 * stddev_pop(value), 4) AS low, round(avg(value) + 2 * stddev_pop(value), 4) AS high FROM raster""")
def display_limits(spark, sf_dir):
    return _rounded(stats.display_limits(raster(spark, sf_dir), "value"), "low", "high", places=4)


@query("quartile_breaks", """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM events)
SELECT CAST(CASE WHEN value <= a THEN 1 WHEN value <= b THEN 2 WHEN value <= c THEN 3 ELSE 4 END AS INTEGER) AS quartile, count(*) AS n FROM events, q GROUP BY 1""")
def quartile_breaks(spark, sf_dir):
    return stats.class_breaks(table(spark, sf_dir, "events"), "value").groupBy("quartile").agg(F.count(F.lit(1)).alias("n"))


@query("hour_histogram", f"""WITH {CATALOGUE} SELECT hour, count(*) AS n FROM catalogue GROUP BY 1""")
def hour_histogram(spark, sf_dir):
    return catalogue(spark, sf_dir).groupBy("hour").agg(F.count(F.lit(1)).alias("n"))


_TRUE = "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"
_FOUND = "CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END"


@query("confusion_kappa", f"""WITH c AS (SELECT {_TRUE} AS y, {_FOUND} AS p FROM lineitem), t AS (SELECT count(*) AS t, sum(CASE WHEN y = p THEN 1 ELSE 0 END) AS hit,
sum(y) AS y1, sum(p) AS p1 FROM c), k AS (SELECT hit / t AS po, (CAST(y1 AS DOUBLE) * p1 + CAST(t - y1 AS DOUBLE) * (t - p1)) / (CAST(t AS DOUBLE) * t) AS pe FROM t)
SELECT round(po, 6) AS accuracy, round((po - pe) / (1 - pe), 6) AS kappa FROM k""")
def confusion_kappa(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.expr(_TRUE).alias("y"), F.expr(_FOUND).alias("p"))
    return _rounded(stats.accuracy_kappa(t, "y", "p"), "accuracy", "kappa")


@query("variance_ratio", """WITH l AS (SELECT l_linestatus AS k, 'q' AS band, CAST(l_quantity AS DOUBLE) AS v FROM lineitem UNION ALL SELECT l_linestatus, 't', CAST(l_tax AS DOUBLE) * 100 FROM lineitem),
p AS (SELECT k, band, avg(v) AS m, count(*) AS n, var_pop(v) * count(*) AS w FROM l GROUP BY 1, 2), g AS (SELECT band, avg(v) AS g FROM l GROUP BY 1),
s AS (SELECT sum(n * (m - g) * (m - g)) AS b, sum(w) AS w, count(DISTINCT k) AS k, sum(n) / 2 AS n FROM p JOIN g ON p.band = g.band)
SELECT round((b / (k - 1)) / (w / (n - k)), 5) AS vrc FROM s""")
def variance_ratio(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("k"), F.col("l_quantity").cast("double").alias("q"), (F.col("l_tax").cast("double") * 100).alias("t"))
    return _rounded(stats.variance_ratio(t, "k", ["q", "t"]), "vrc", places=5)


@query("voxel_stats", f"""WITH {VOXELS}, c AS (SELECT lith, i, j, count(*) AS n, min(k) AS top, max(k) AS bottom FROM voxels GROUP BY 1, 2, 3)
SELECT lith, CAST(sum(n) AS BIGINT) AS n, sum(n) * 250.0 AS volume, round(avg(n * 10.0), 6) AS thickness, round(avg((top - 1) * 10.0), 6) AS depth_top, round(avg(bottom * 10.0), 6) AS depth_bottom FROM c GROUP BY 1""")
def voxel_stats(spark, sf_dir):
    return _rounded(voxel.lithology_statistics(voxels(spark, sf_dir), 5.0, 10.0), "thickness", "depth_top", "depth_bottom")
