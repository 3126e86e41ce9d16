"""Aggregates that run along a stream of files.

Each takes and returns a streaming DataFrame for update mode; :func:`folded` runs one
over all files there are and gives the last row of each group. State is one row for
each group, in Spark's state store, dealt by the group's key.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def growing(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """A folder of Parquet files, or a pattern of names, as a stream that reads each file once, ``files_at_once`` in a batch (all if None).

    One file is a stream too, if its name is given as a pattern.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(path)


def statistics(stream: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean and std (population) of each group so far; nulls don't count, a group of nulls has n 0 and no mean."""
    return stream.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def best(stream: DataFrame, keys: list[str], score: str, value: str) -> DataFrame:
    """The highest score of each group so far and the value that came with it.

    Of equal scores the greatest value wins; a null score never wins, and a group
    with null scores only has nulls.
    """
    top = F.max(F.when(F.col(score).isNotNull(), F.struct(score, value)))
    return stream.groupBy(*keys).agg(top.alias("_top")).select(*keys, F.col("_top")[score].alias(score), F.col("_top")[value].alias(value))


def windows(stream: DataFrame, time: str, value: str, keys: list[str], length: str, delay: str) -> DataFrame:
    """start, n and mean for each window of ``length`` and group; rows over ``delay`` behind the latest earlier batch may be left out.

    Rows without a time are in no window.
    """
    dealt = stream.withWatermark(time, delay).groupBy(F.window(time, length).alias("_window"), *keys)
    return dealt.agg(F.count(value).alias("n"), F.avg(value).alias("mean")).select(F.col("_window.start").alias("start"), *keys, "n", "mean")


def covariances(stream: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the population covariance of each pair of columns so far, as ``cov_a_b``; a pair counts where both are given."""

    def pair(a: str, b: str) -> Column:
        return F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"cov_{a}_{b}")

    return stream.groupBy().agg(*[pair(a, b) for a, b in combinations_with_replacement(columns, 2)])


def folded(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Run ``stream`` over the files there are and return the last row of each group.

    Each batch writes the rows it changed to its own part of ``folder``, which a batch
    that runs again overwrites; a later call with the same folder goes on from there.
    """

    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(keep).start().awaitTermination()
    found = stream.sparkSession.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{folder}/changes")
    rest = [c for c in stream.columns if c not in keys]
    return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, *[F.col("_last")[c].alias(c) for c in rest])
