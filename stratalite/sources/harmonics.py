"""Files of geomagnetic field models: a heading for each epoch, and a line for each degree and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import read_lines, with_latest


def read_field_models(spark: SparkSession, path: str) -> DataFrame:
    """model, epoch, first_year, last_year, has_rates, n, m, g, h, g_rate, h_rate: the coefficients in nT, and their change in a year."""
    parts = F.split(F.trim("text"), r"\s+")
    heading = F.col("text").startswith("   ")
    number = lambda i: F.try_element_at(parts, F.lit(i + 1)).try_cast("double")
    head = F.struct(parts[0].alias("model"), number(1).alias("epoch"), number(5).alias("first_year"), number(6).alias("last_year"), (number(3) > 0).alias("has_rates"))
    lines = with_latest(read_lines(spark, path).where("trim(text) <> ''"), "h", F.when(heading, head))
    names = ("g", "h", "g_rate", "h_rate")
    return lines.where(~heading).select("h.model", "h.epoch", "h.first_year", "h.last_year", "h.has_rates", number(0).cast("int").alias("n"), number(1).cast("int").alias("m"), *[F.coalesce(number(i), F.lit(0.0)).alias(n) for i, n in enumerate(names, 2)])
