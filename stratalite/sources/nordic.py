"""Earthquake catalogues in the Nordic format: 80 columns a line, the last one its type, a blank line after each event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import fixed, read_lines, with_running, write_lines

# Places of the fields, counted from 0, and their types.
EVENT = (
    ("year", 1, 5, "int"), ("month", 6, 8, "int"), ("day", 8, 10, "int"), ("hour", 11, 13, "int"), ("minute", 13, 15, "int"), ("second", 16, 20, "double"), ("distance_indicator", 21, 22, "string"),
    ("latitude", 23, 30, "double"), ("longitude", 30, 38, "double"), ("depth", 38, 43, "double"), ("agency", 45, 48, "string"), ("stations", 48, 51, "int"), ("rms", 51, 55, "double"),
    ("magnitude_1", 55, 59, "double"), ("type_1", 59, 60, "string"), ("magnitude_2", 63, 67, "double"), ("type_2", 67, 68, "string"), ("magnitude_3", 71, 75, "double"), ("type_3", 75, 76, "string"),
)
PHASE = (
    ("station", 1, 6, "string"), ("component", 7, 8, "string"), ("quality", 9, 10, "string"), ("phase", 10, 14, "string"), ("weight", 14, 15, "string"), ("first_motion", 16, 17, "string"), ("hour", 18, 20, "int"), ("minute", 20, 22, "int"),
    ("second", 22, 28, "double"), ("duration", 29, 33, "int"), ("amplitude", 33, 40, "double"), ("period", 41, 45, "double"), ("residual", 63, 68, "double"), ("distance", 70, 75, "double"), ("azimuth", 76, 79, "double"),
)


def read_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events (file, event, the fields of the first type-1 line, region, gap) and phases (file, event, the fields of type-4 and untyped lines).

    Events are numbered by the blank lines of their file. An event without a
    type-1 line has nulls. A blank or unreadable field is null.
    """
    lines = with_running(read_lines(spark, path), "event", (F.trim("text") == "").cast("int")).where("trim(text) <> ''")
    lines = lines.select("file", "event", "at", F.rpad("text", 80, " ").alias("text")).withColumn("kind", F.substring("text", 80, 1))
    first = lambda kind, value: F.min_by(value, F.when(F.col("kind") == kind, F.col("at")))
    head = F.struct(*[fixed(a, b, t).alias(n) for n, a, b, t in EVENT])
    region = F.when(F.col("text").contains("Region:"), F.trim(F.substring("text", 13, 66)))
    events = lines.groupBy("file", "event").agg(first("1", head).alias("h"), F.max(F.when(F.col("kind") == "3", region)).alias("region"), F.max(F.when(F.col("kind") == "E", fixed(5, 8, "double"))).alias("gap"))
    heading = F.col("text").startswith(" STAT SP")
    phases = lines.where(F.col("kind").isin("4", " ") & ~heading).select("file", "event", "at", *[fixed(a, b, t).alias(n) for n, a, b, t in PHASE])
    return events.select("file", "event", "h.*", "region", "gap"), phases


def _line(fields: tuple, kind: str, formats: dict[str, str]) -> Column:
    """A line of 80 columns with each field right-aligned in its place."""
    parts, at = [], 0
    for name, start, stop, t in fields:
        text = F.col(name).cast("string") if t != "double" else F.format_string(formats.get(name, f"%.{1}f"), F.col(name))
        text = F.when(F.col(name).isNull(), F.lit("")).otherwise(text)
        width = stop - start
        parts += [F.lit(" " * (start - at)), F.rpad(text, width, " ") if t == "string" else F.lpad(text, width, " ")]
        at = stop
    return F.concat(F.rpad(F.concat(*parts), 79, " "), F.lit(kind))


def write_events(events: DataFrame, phases: DataFrame, folder: str) -> None:
    """Write events (event and the fields of EVENT) and phases (event and those of PHASE), a blank line after each event."""
    places = {"latitude": "%.3f", "longitude": "%.3f", "second": "%.1f", "rms": "%.1f", "depth": "%.1f"}
    head = events.select("event", F.lit(0).alias("k"), _line(EVENT, "1", places).alias("text"))
    title = events.select("event", F.lit(1).alias("k"), F.lit(" STAT SP IPHASW D HRMM SECON CODA AMPLIT PERI AZIMU VELO AIN AR TRES W  DIS CAZ7").alias("text"))
    body = phases.select("event", F.lit(2).alias("k"), _line(PHASE, " ", {"second": "%.2f", "amplitude": "%.1f", "period": "%.2f", "residual": "%.2f", "distance": "%.1f", "azimuth": "%.0f"}).alias("text"))
    blank = events.select("event", F.lit(3).alias("k"), F.lit(" ").alias("text"))
    write_lines(head.unionByName(title).unionByName(body).unionByName(blank), folder, ["event", "k", "text"])


def denormalised(events: DataFrame, phases: DataFrame) -> DataFrame:
    """A row for each phase with its event's fields beside it, as the catalogue's csv has them; events without phases have one."""
    own = [c for c in phases.columns if c not in ("file", "event", "at")]
    return events.join(phases.select("file", "event", *[F.col(c).alias(f"phase_{c}") for c in own]), ["file", "event"], "left")
