"""Raster text formats: ESRI ASCII grids and x y z rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import read_lines, with_running, write_lines

HEADER = ("ncols", "nrows", "xllcorner", "yllcorner", "xllcenter", "yllcenter", "cellsize", "nodata_value")


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """file, row (from the top), col, x, y (cell centres) and value of each cell; nodata cells are null.

    Header lines have a name and a number. A row's number is the count of rows in the
    blocks before its own and in its own up to it.
    """
    lines = read_lines(spark, path).withColumn("word", F.split(F.trim("text"), r"\s+")).where("text <> ''")
    is_head = F.lower(F.get("word", F.lit(0))).isin(*HEADER)
    found = F.when(is_head, F.get("word", F.lit(1)).try_cast("double"))
    head = lines.where(is_head).groupBy("file").agg(*[F.max(F.when(F.lower(F.get("word", F.lit(0))) == h, found)).alias(h) for h in HEADER])
    rows = with_running(lines, "row", (~is_head).cast("int")).withColumn("row", F.col("row") - 1).where(~is_head)
    cells = rows.select("file", F.col("row").cast("int").alias("row"), F.posexplode("word").alias("col", "v")).withColumn("value", F.col("v").try_cast("double"))
    out = cells.join(head, "file")
    x0 = F.coalesce(F.col("xllcorner") + F.col("cellsize") / 2, F.col("xllcenter"))
    y0 = F.coalesce(F.col("yllcorner") + F.col("cellsize") / 2, F.col("yllcenter"))
    return out.select(
        "file", "row", "col", (x0 + F.col("col") * F.col("cellsize")).alias("x"), (y0 + (F.col("nrows") - 1 - F.col("row")) * F.col("cellsize")).alias("y"),
        F.when(F.col("nodata_value").isNull() | (F.col("value") != F.col("nodata_value")), F.col("value")).alias("value"),
    )


def write_ascii_grid(cells: DataFrame, folder: str, x0: float = 0.0, y0: float = 0.0, cell: float = 1.0, nodata: float = -9999.0) -> None:
    """Write (row, col, value), counted from the top left, as an ESRI ASCII grid; missing and null cells as nodata."""
    rows, cols = cells.agg(F.max("row"), F.max("col")).first()
    head = [f"ncols {cols + 1}", f"nrows {rows + 1}", f"xllcorner {x0}", f"yllcorner {y0}", f"cellsize {cell}", f"nodata_value {nodata}"]
    spark = cells.sparkSession
    first = spark.createDataFrame([(i - len(head), t) for i, t in enumerate(head)], "row int, text string")
    known = cells.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", F.coalesce(F.col("value").cast("double"), F.lit(nodata)).alias("v")))).alias("m"))
    each = spark.range(rows + 1).select(F.col("id").cast("int").alias("row")).join(known, "row", "left")
    values = F.transform(F.sequence(F.lit(0), F.lit(cols)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(nodata)).cast("string"))
    write_lines(first.unionByName(each.select("row", F.array_join(values, " ").alias("text"))), folder, ["row"])


def read_xyz_grid(spark: SparkSession, path: str, nodata: float = 0.0) -> DataFrame:
    """row (from the top), col, value of a grid in rows of x y z; its cell sizes are the least steps between distinct places."""
    p = read_lines(spark, path).select(F.transform(F.split(F.trim("text"), r"[\s,]+"), lambda v: v.try_cast("double")).alias("v")).where("v[0] IS NOT NULL AND size(v) >= 3")
    p = p.select(F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), F.nullif(F.col("v")[2], F.lit(float(nodata))).alias("value"))
    size = p.crossJoin(F.broadcast(p.agg(F.min("x").alias("x0"), F.max("y").alias("y1")))).crossJoin(F.broadcast(least_step(p, "x"))).crossJoin(F.broadcast(least_step(p, "y")))
    return size.select(F.round((F.col("y1") - F.col("y")) / F.col("step_y")).cast("int").alias("row"), F.round((F.col("x") - F.col("x0")) / F.col("step_x")).cast("int").alias("col"), "value")


def least_step(places: DataFrame, column: str) -> DataFrame:
    """One row, ``step_<column>``: the least step between neighbouring distinct values (a grid has few of them), 1 for a single one."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy(column)
    steps = places.select(column).distinct().select((F.col(column) - F.lag(column).over(w)).alias("s"))
    return steps.agg(F.coalesce(F.min("s"), F.lit(1.0)).alias(f"step_{column}"))


def write_xyz_grid(cells: DataFrame, folder: str, x0: float, y1: float, cell: float) -> None:
    """Write known cells as rows of x y z, by the corner of the cell."""
    text = F.concat_ws(" ", F.lit(x0) + F.col("col") * cell, F.lit(y1) - F.col("row") * cell, F.col("value").cast("double"))
    write_lines(cells.where("value IS NOT NULL").select("row", "col", text.alias("text")), folder, ["row", "col"])
