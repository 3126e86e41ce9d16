"""Point and line formats: delimited tables, Geosoft XYZ, gravimeter readings, block models, fault planes, intensities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import fixed, read_lines, with_latest, with_running, write_lines

# Names of coordinate columns in the order they are looked for, and the columns of a CG-5 file.
PLACES = (("longitude", "latitude"), ("long", "lat"), ("lon", "lat"), ("easting", "northing"), ("x", "y"), ("e", "n"))
CG5 = ("line", "station", "alt", "grav", "sd", "tiltx", "tilty", "temp", "tide", "dur", "rej", "time", "dectimedate", "terrain")


def read_delimited(spark: SparkSession, path: str, sep: str = ",", nodata: float | None = None) -> DataFrame:
    """A table with a header: names in lower case, coordinates also as x and y, ``line`` as text, nodata as null.

    Spark's own reader splits the file and reads only the columns that are used.
    """
    t = spark.read.option("header", True).option("sep", sep).option("inferSchema", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    t = t.toDF(*[c.strip().lower() for c in t.columns])
    kinds = dict(t.dtypes)
    if nodata is not None:
        t = t.withColumns({c: F.nullif(F.col(c), F.lit(nodata).cast(k)) for c, k in kinds.items() if k in ("int", "bigint", "double")})
    if "line" in kinds:
        t = t.withColumn("line", F.col("line").cast("string"))
    for x, y in PLACES:
        if x in kinds and y in kinds:
            return t if (x, y) == ("x", "y") else t.withColumns({"x": F.col(x).cast("double"), "y": F.col(y).cast("double")})
    return t


def write_delimited(table: DataFrame, folder: str, sep: str = ",", most_rows: int | None = None) -> None:
    """Write with a header; ``most_rows`` (1,048,576 in a spreadsheet) is the format's own limit."""
    (table if most_rows is None else table.limit(most_rows)).write.option("header", True).option("sep", sep).csv(folder)


def read_geosoft_xyz(spark: SparkSession, path: str) -> DataFrame:
    """file, line, at, values (by name, null for ``*``) of each reading.

    ``//`` lines are comments, the last ``/`` line before the first block names the
    columns, and ``line`` or ``tie`` lines begin a block.
    """
    lines = read_lines(spark, path).withColumn("text", F.trim("text")).where("text <> '' AND NOT text LIKE '//%'")
    words = F.split("text", r"\s+")
    marker = F.lower(F.get(words, F.lit(0))).isin("line", "tie")
    head = lines.where("text LIKE '/%'").groupBy("file").agg(F.max_by(F.split(F.lower(F.trim(F.substring("text", 2, 1_000_000))), r"\s+"), "at").alias("names"))
    rows = with_latest(lines, "line", F.when(marker, F.array_join(F.slice(words, 2, F.size(words)), " "))).where(~marker & ~F.col("text").startswith("/"))
    number = lambda v: F.when(v != "*", v.try_cast("double"))
    return rows.join(head, "file").select("file", "line", "at", F.map_from_arrays("names", F.transform(F.slice(words, 1, F.size("names")), number)).alias("values"))


def write_geosoft_xyz(readings: DataFrame, folder: str, line: str, order: str, columns: list[str]) -> None:
    """Write blocks of readings by line, nulls as ``*``; the header comes first."""
    spark = readings.sparkSession
    head = spark.createDataFrame([("", -1, 0.0, "/ " + " ".join(columns))], "l string, k int, o double, text string")
    starts = readings.select(F.col(line).cast("string").alias("l")).distinct().select("l", F.lit(0).alias("k"), F.lit(0.0).alias("o"), F.concat(F.lit("LINE "), "l").alias("text"))
    cells = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("double").cast("string"), F.lit("*")) for c in columns])
    rows = readings.select(F.col(line).cast("string").alias("l"), F.lit(1).alias("k"), F.col(order).cast("double").alias("o"), cells.alias("text"))
    write_lines(head.unionByName(starts).unionByName(rows), folder, [F.col("k") >= 0, "l", "k", "o"])


def read_cg5(spark: SparkSession, path: str) -> DataFrame:
    """Gravimeter readings; gravity and dates are parsed as 32-bit floats, as the instrument's program does."""
    lines = read_lines(spark, path).where("NOT (text LIKE '/%' OR text LIKE 'Line%' OR text LIKE '%,%')")
    word = F.split(F.trim("text"), r"\s+")
    rows = lines.where(F.size(word) >= len(CG5))

    def column(k: int, name: str) -> Column:
        v = F.get(word, F.lit(k))
        return (v if name == "time" else v.try_cast("int") if name in ("dur", "rej") else v.try_cast("float").cast("double")).alias(name)

    return rows.select(*[column(k, name) for k, name in enumerate(CG5)])


def read_gps(spark: SparkSession, path: str) -> DataFrame:
    """line, station, latitude, longitude, elevation; a station that is no number (the base) is null."""
    t = spark.read.option("header", True).csv(path)
    roles = {}
    for c in t.columns:
        for role in ("line", "station", "lat", "lon", "elev"):
            if role in c.lower():
                roles.setdefault(role, c)
    names = {"line": "line", "station": "station", "lat": "latitude", "lon": "longitude", "elev": "elevation"}
    return t.select(*[F.trim(F.col(f"`{c}`")).try_cast("double").alias(names[r]) for r, c in roles.items()])


def read_block_model(spark: SparkSession, path: str) -> DataFrame:
    """i, j, k, lith and cell sizes of a block-model csv: x, y, z, cell sizes, volume, label; rows count from the greatest y, layers from the top."""
    t = spark.read.option("header", True).option("comment", "#").option("ignoreLeadingWhiteSpace", True).csv(path)
    names = t.columns
    num = lambda k: F.trim(F.col(f"`{names[k]}`")).try_cast("double")
    v = t.select(num(0).alias("x"), num(1).alias("y"), num(2).alias("z"), num(3).alias("dx"), num(4).alias("dy"), num(5).alias("dz"), F.trim(F.col(f"`{names[7]}`")).alias("label"))
    lim = v.agg(F.min("x").alias("x0"), F.max("y").alias("y1"), F.max("z").alias("z1"))
    lith = F.when(F.lower("label") == "blank", "Background").otherwise(F.col("label"))
    at = lambda a, b, d: F.floor((a - b) / d + 0.5).cast("int")
    return v.crossJoin(F.broadcast(lim)).select(at(F.col("x"), F.col("x0"), F.col("dx")).alias("i"), at(F.col("y1"), F.col("y"), F.col("dy")).alias("j"), at(F.col("z1"), F.col("z"), F.col("dz")).alias("k"), lith.alias("lith"), "dx", "dy", "dz")


def read_voxel_points(spark: SparkSession, path: str) -> DataFrame:
    """i, j, k, lith of x, y, z, label rows; a cell is the least step between distinct places, rows count from the least y."""
    from .grids import least_step

    t = spark.read.csv(path)
    num = lambda k: F.trim(F.col(t.columns[k])).try_cast("double")
    v = t.select(num(0).alias("x"), num(1).alias("y"), num(2).alias("z"), F.trim(F.col(t.columns[3])).alias("lith")).where("x IS NOT NULL")
    for c in "xyz":
        v = v.crossJoin(F.broadcast(least_step(v, c)))
    lim = v.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("z").alias("z1"))
    at = lambda a, b, d: F.round((F.col(a) - F.col(b)) / F.col(d)).cast("int")
    return v.crossJoin(F.broadcast(lim)).select(at("x", "x0", "step_x").alias("i"), at("y", "y0", "step_y").alias("j"), at("z1", "z", "step_z").alias("k"), "lith")


def read_fault_planes(spark: SparkSession, path: str) -> DataFrame:
    """longitude, latitude, depth, strike, dip, rake and, from the last column, magnitude; a header line has letters."""
    word = F.split("text", ",")
    rows = read_lines(spark, path).where("NOT text RLIKE '[A-DF-Za-df-z]' AND text <> ''")
    names = ("longitude", "latitude", "depth", "strike", "dip", "rake")
    return rows.select(*[F.trim(F.get(word, F.lit(k))).try_cast("double").alias(n) for k, n in enumerate(names)], F.trim(F.element_at(word, -1)).try_cast("double").alias("magnitude"))


def read_intensities(spark: SparkSession, path: str) -> DataFrame:
    """lat, lon, intensity, code, postalcode, location of a macroseismic file: two header lines, then fixed columns; a plus at the intensity goes."""
    lines = with_running(read_lines(spark, path), "n", F.lit(1)).where("n > 2 AND trim(text) <> ''")
    return lines.select(fixed(0, 10, "double").alias("lat"), fixed(10, 20, "double").alias("lon"), F.replace(fixed(20, 25), F.lit("+"), F.lit("")).try_cast("double").alias("intensity"), fixed(25, 30).alias("code"), fixed(30, 40).alias("postalcode"), fixed(40, 80).alias("location"))


def read_spectra(spark: SparkSession, path: str) -> DataFrame:
    """name, wavelength and reflectance of spectra in a delimited table: the first column has the wavelengths, each other one a spectrum."""
    t = spark.read.option("header", True).option("inferSchema", True).csv(path)
    first = t.columns[0]
    return t.unpivot([first], [c for c in t.columns if c != first], "name", "reflectance").withColumnRenamed(first, "wavelength")
