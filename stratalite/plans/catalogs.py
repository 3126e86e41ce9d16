"""Queries on catalogues of events and on lines of readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalite.operators import catalog

from .registry import query
from .views import CATALOGUE, LINES, catalogue, lines, table


def _rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


@query("include_filter", f"""WITH {CATALOGUE} SELECT event, mag FROM catalogue WHERE mag BETWEEN 0.5 AND 1.5""")
def include_filter(spark, sf_dir):
    return catalog.range_filter(catalogue(spark, sf_dir), "mag", 0.5, 1.5).select("event", "mag")


@query("exclude_filter", f"""WITH {CATALOGUE} SELECT event, mag FROM catalogue WHERE NOT (mag BETWEEN 0.5 AND 1.5)""")
def exclude_filter(spark, sf_dir):
    return catalog.range_filter(catalogue(spark, sf_dir), "mag", 0.5, 1.5, exclude=True).select("event", "mag")


@query("forall_filter", """SELECT o_orderkey AS event FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1 HAVING min(l_quantity) >= 10 AND max(l_quantity) <= 45""")
def forall_filter(spark, sf_dir):
    phases = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event")).agg(F.collect_list("l_quantity").alias("phases"))
    events = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event")).distinct().join(phases, "event", "left")
    return catalog.all_phases(events, "phases", lambda p: (p >= 10) & (p <= 45)).select("event")


@query("field_limits", f"""WITH {CATALOGUE} SELECT 'mag' AS field, min(mag) AS low, max(mag) AS high FROM catalogue UNION ALL SELECT 'value', min(value), max(value) FROM catalogue""")
def field_limits(spark, sf_dir):
    return catalog.limits(catalogue(spark, sf_dir), ["mag", "value"])


@query("keyword_delete", """SELECT doc_id FROM documents WHERE NOT contains(text, 'token') AND NOT contains(text, 'License')""")
def keyword_delete(spark, sf_dir):
    return catalog.without_keywords(table(spark, sf_dir, "documents"), "text", ["token", "License"]).select("doc_id")


@query("bvalue", f"""WITH {CATALOGUE}, m AS (SELECT CAST(round(mag / 0.1) AS INTEGER) AS bin, mag AS m FROM catalogue WHERE mag IS NOT NULL), h AS (SELECT bin, count(*) AS n FROM m GROUP BY 1),
e0 AS (SELECT unnest(range((SELECT min(bin) FROM h), (SELECT max(bin) + 1 FROM h))) AS bin), u AS (SELECT bin, sum(coalesce(n, 0)) OVER (ORDER BY bin DESC) AS above FROM e0 LEFT JOIN h USING (bin)), c AS (SELECT bin AS c FROM h ORDER BY n DESC, bin LIMIT 1),
l AS (SELECT regr_slope(log10(above), bin * 0.1) AS s, regr_intercept(log10(above), bin * 0.1) AS a, min(c) * 0.1 AS completeness FROM u, c WHERE bin >= c), e AS (SELECT 0.4342944819032518 / (avg(m) - min(m)) AS b_mle FROM m, c WHERE bin >= c)
SELECT round(CAST(completeness AS DOUBLE), 4) AS completeness, round(-s, 5) AS b, round(a, 5) AS a, round(b_mle, 5) AS b_mle FROM l, e""")
def bvalue(spark, sf_dir):
    found = catalog.frequency_magnitude(catalogue(spark, sf_dir))
    return _rounded(_rounded(found, "b", "a", "b_mle", places=5), "completeness", places=4)


@query("rev_cumulative", f"""WITH {CATALOGUE}, h AS (SELECT mag, count(*) AS n FROM catalogue GROUP BY 1) SELECT mag, n, CAST(sum(n) OVER (ORDER BY mag DESC) AS BIGINT) AS above FROM h""")
def rev_cumulative(spark, sf_dir):
    return catalog.reverse_cumulative(catalogue(spark, sf_dir), "mag")


_PICKS = """picks AS (SELECT l_orderkey AS event, l_linenumber AS station, max(CAST(l_quantity AS DOUBLE)) AS p, max(CAST(l_quantity AS DOUBLE)) * 1.7 + max(CAST(l_tax AS DOUBLE)) * 10 AS s FROM lineitem GROUP BY 1, 2)"""


@query("wadati", f"""WITH {_PICKS}, many AS (SELECT event FROM picks GROUP BY 1 HAVING count(*) > 3), w AS (SELECT a.event, abs(a.p - b.p) AS dp, abs(a.s - b.s) AS ds FROM picks a JOIN picks b ON a.event = b.event AND a.station < b.station WHERE a.event IN (SELECT event FROM many)),
f AS (SELECT event, regr_slope(ds, dp) AS vpvs FROM w GROUP BY 1) SELECT event, round(vpvs, 9) AS vpvs FROM f WHERE vpvs BETWEEN 1.53 AND 1.93""")
def wadati(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event"), F.col("l_linenumber").alias("station"))
    picks = t.agg(F.max(F.col("l_quantity").cast("double")).alias("p"), F.max(F.col("l_tax").cast("double")).alias("x")).withColumn("s", F.col("p") * 1.7 + F.col("x") * 10)
    return _rounded(catalog.wadati(picks, least_stations=3), "vpvs", places=9)  # five places would be ties


@query("wadati_last_picks", """WITH r AS (SELECT l_partkey % 500 AS event, l_suppkey % 9 AS station, CASE l_linenumber % 3 WHEN 0 THEN 'P' WHEN 1 THEN 'S' ELSE 'PN' END AS phase, l_orderkey AS o, CAST(l_quantity AS DOUBLE) * CASE l_linenumber % 3 WHEN 1 THEN 1.7::DOUBLE ELSE 1 END AS t FROM lineitem WHERE round(l_discount * 100) <> 9),
last AS (SELECT event, station, phase, t FROM r QUALIFY row_number() OVER (PARTITION BY event, station, phase ORDER BY o DESC, t DESC) = 1)
SELECT p.event, p.station, p.t AS p, s.t AS s FROM last p JOIN last s ON p.event = s.event AND p.station = s.station AND p.phase = 'P' AND s.phase = 'S'""")
def wadati_last_picks(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    kind = F.col("l_linenumber") % 3
    r = t.select((F.col("l_partkey") % 500).alias("event"), (F.col("l_suppkey") % 9).alias("station"), F.when(kind == 0, " P").when(kind == 1, "S ").otherwise("PN").alias("phase"), F.col("l_orderkey").alias("o"), (F.col("l_quantity").cast("double") * F.when(kind == 1, 1.7).otherwise(1.0)).alias("time"), F.round(F.col("l_discount") * 100).cast("int").alias("weight"))
    return catalog.last_picks(r, "o")


@query("residual_by_station", f"""WITH {CATALOGUE}, r AS (SELECT phase, value - avg(value) OVER (PARTITION BY station) AS r FROM catalogue) SELECT phase, round(avg(r), 5) AS mean, round(stddev_pop(r), 5) AS std, count(r) AS n FROM r GROUP BY 1""")
def residual_by_station(spark, sf_dir):
    return _rounded(catalog.station_residuals(catalogue(spark, sf_dir), "station", "phase", "value"), "mean", "std", places=5)


@query("mercalli", f"""WITH {CATALOGUE} SELECT CASE WHEN mag < 2 THEN 'I' WHEN mag < 3 THEN 'II' WHEN mag < 4 THEN 'III' WHEN mag = 4 THEN 'IV' WHEN mag < 5 THEN 'V' WHEN mag < 6 THEN 'VI' WHEN mag = 6 THEN 'VII' WHEN mag < 7 THEN 'VIII' WHEN mag = 7 THEN 'IX' WHEN mag < 8 THEN 'X' WHEN mag = 8 THEN 'XI' ELSE 'XII' END AS intensity, count(*) AS n FROM catalogue GROUP BY 1""")
def mercalli(spark, sf_dir):
    return catalogue(spark, sf_dir).groupBy(catalog.mercalli(F.col("mag")).alias("intensity")).agg(F.count(F.lit(1)).alias("n"))


@query("summary_pivot", f"""WITH {CATALOGUE} SELECT station, max(CASE WHEN phase = 'click' THEN mag END) AS click, max(CASE WHEN phase = 'error' THEN mag END) AS error, max(CASE WHEN phase = 'purchase' THEN mag END) AS purchase FROM catalogue GROUP BY 1""")
def summary_pivot(spark, sf_dir):
    return catalog.magnitude_columns(catalogue(spark, sf_dir), "station", "phase", "mag", ["click", "error", "purchase"])


@query("profile_distance", f"""WITH {LINES}, s AS (SELECT line, id, t, sqrt(power(t / 1000 - lag(t / 1000) OVER w, 2) + power(value - lag(value) OVER w, 2)) AS s FROM lines WINDOW w AS (PARTITION BY line ORDER BY t))
SELECT line, id, round(sum(coalesce(s, 0)) OVER (PARTITION BY line ORDER BY t ROWS UNBOUNDED PRECEDING), 3) AS distance FROM s""")
def profile_distance(spark, sf_dir):
    l = lines(spark, sf_dir).withColumn("x", F.col("t") / 1000)  # noqa: E741
    return _rounded(catalog.profile_distance(l, "line", "t", "x", "value"), "distance", places=3).select("line", "id", "distance")


@query("line_azimuth", f"""WITH {LINES}, a AS (SELECT line, id, t, degrees(atan2(lead(t) OVER w - t, lead(value) OVER w - value)) AS a FROM lines WINDOW w AS (PARTITION BY line ORDER BY t))
SELECT line, id, round(coalesce(a, lag(a) OVER (PARTITION BY line ORDER BY t)), 5) AS azimuth FROM a""")
def line_azimuth(spark, sf_dir):
    return _rounded(catalog.line_azimuth(lines(spark, sf_dir), "line", "t", "t", "value"), "azimuth", places=5).select("line", "id", "azimuth")


@query("day_index", f"""WITH {CATALOGUE} SELECT station, event, CAST(dense_rank() OVER (PARTITION BY station ORDER BY day) AS INTEGER) AS day_no FROM catalogue""")
def day_index(spark, sf_dir):
    return catalog.day_index(catalogue(spark, sf_dir), "day", "station").select("station", "event", "day_no")


@query("rename_dups", """SELECT p_partkey AS id, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN p_name || '(' || CAST(row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS VARCHAR) || ')' ELSE p_name END AS name FROM part""")
def rename_dups(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return catalog.rename_duplicates(p, "name", "id")


@query("drift_rate", f"""WITH {CATALOGUE} SELECT station, CAST(day AS VARCHAR) AS day, round((arg_max(value, t) - arg_min(value, t)) / nullif((max(t) - min(t)) / 60, 0), 5) AS rate FROM catalogue GROUP BY 1, 2""")
def drift_rate(spark, sf_dir):
    c = catalogue(spark, sf_dir).withColumn("day", F.col("day").cast("string"))
    return _rounded(catalog.drift_rate(c, ["station", "day"], "t", "value"), "rate", places=5)


@query("block_segments", f"""WITH {LINES} SELECT line, id, CAST(sum(CASE WHEN base THEN 1 ELSE 0 END) OVER (PARTITION BY line ORDER BY t ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM lines""")
def block_segments(spark, sf_dir):
    return catalog.segments_of(lines(spark, sf_dir), F.col("base"), "line", "t").select("line", "id", F.col("block").cast("long").alias("block"))


_EPICENTRES = """e AS (SELECT event_id AS event, CAST(event_id * 7919 % 40009 AS DOUBLE) / 10000 AS lat, CAST(event_id * 104729 % 40013 AS DOUBLE) / 10000 AS lon, CASE WHEN event_id * 7919 % 40009 < 9000 THEN 8 + event_id % 9 ELSE event_id % 24 END AS hour FROM events)"""


@query("quarry_removal", f"""WITH {_EPICENTRES}, w AS (SELECT a.event AS lid, b.event AS rid, b.hour BETWEEN 9 AND 15 AS is_day, row_number() OVER (PARTITION BY a.event ORDER BY power(a.lon - b.lon, 2) + power(a.lat - b.lat, 2), b.event) AS rank
FROM e a JOIN e b ON b.lat BETWEEN a.lat - 0.21 AND a.lat + 0.21 AND b.lon BETWEEN a.lon - 0.21 AND a.lon + 0.21 WHERE power(a.lon - b.lon, 2) + power(a.lat - b.lat, 2) <= 0.2 * 0.2),
k AS (SELECT * FROM w WHERE rank <= 50), n AS (SELECT lid, count(*) AS n, CAST(sum(CASE WHEN is_day THEN 1 ELSE 0 END) AS DOUBLE) AS d FROM k GROUP BY 1),
x AS (SELECT lid FROM n WHERE n = 50 AND d * 18 / (CASE WHEN d = 50 THEN 0.00001 ELSE 50 - d END * 6) > 3.0)
SELECT event FROM e WHERE event NOT IN (SELECT rid FROM k WHERE is_day AND lid IN (SELECT lid FROM x))""")
def quarry_removal(spark, sf_dir):
    k = F.col("event_id")
    lat, lon = (k * 7919) % 40009, (k * 104729) % 40013
    e = table(spark, sf_dir, "events").select(k.alias("event"), (lat.cast("double") / 10000).alias("lat"), (lon.cast("double") / 10000).alias("lon"), F.when(lat < 9000, 8 + k % 9).otherwise(k % 24).alias("hour"))
    return catalog.quarry_blasts(e, (9, 15), start=0.1).select("event")


@query("magnitude_rollup", f"""WITH {CATALOGUE} SELECT phase, hour, count(*) AS n FROM catalogue GROUP BY ROLLUP (phase, hour)""")
def magnitude_rollup(spark, sf_dir):
    return catalogue(spark, sf_dir).rollup("phase", "hour").agg(F.count(F.lit(1)).alias("n"))
