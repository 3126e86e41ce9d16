"""Queries on the event stream: statistics that run along, best readings, days, covariances."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stratalite.session import shared_folder
from stratalite.streaming import running

from .registry import query


def _events(spark, sf_dir):
    t = running.growing(spark, f"{sf_dir}/{{events}}.parquet")  # a pattern, as the table may be one file
    return t.select(F.col("event_id").cast("long").alias("event"), F.col("user_id").cast("long").alias("station"), F.col("event_type").alias("phase"), F.col("value").cast("double").alias("value"), F.col("ts").cast("timestamp").alias("ts"))


def _folded(spark, stream, *keys):
    return running.folded(stream, list(keys), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}")


@query("stream_statistics", """SELECT CAST(user_id AS BIGINT) AS station, count(value) AS n, round(avg(CAST(value AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(value AS DOUBLE)), 6) AS std FROM events GROUP BY 1""")
def stream_statistics(spark, sf_dir):
    found = _folded(spark, running.statistics(_events(spark, sf_dir), ["station"], "value"), "station")
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("stream_best", """SELECT station, value, event FROM (SELECT CAST(user_id AS BIGINT) AS station, CAST(value AS DOUBLE) AS value, CAST(event_id AS BIGINT) AS event,
  row_number() OVER (PARTITION BY user_id ORDER BY CAST(value AS DOUBLE) DESC NULLS LAST, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def stream_best(spark, sf_dir):
    return _folded(spark, running.best(_events(spark, sf_dir), ["station"], "value", "event"), "station")


@query("stream_days", """SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type AS phase, count(value) AS n, round(avg(CAST(value AS DOUBLE)), 6) AS mean FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""")
def stream_days(spark, sf_dir):
    found = _folded(spark, running.windows(_events(spark, sf_dir), "ts", "value", ["phase"], "1 day", "36500 days"), "start", "phase")
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "phase", "n", F.round("mean", 6).alias("mean"))


@query("stream_covariances", """WITH e AS (SELECT CAST(value AS DOUBLE) AS v, CAST(user_id AS DOUBLE) AS s FROM events)
SELECT round(covar_pop(v, v), 4) AS cov_value_value, round(covar_pop(v, s), 4) AS cov_value_station, round(covar_pop(s, s), 4) AS cov_station_station FROM e""")
def stream_covariances(spark, sf_dir):
    found = _folded(spark, running.covariances(_events(spark, sf_dir), ["value", "station"]))
    return found.select([F.round(c, 4).alias(c) for c in found.columns])
