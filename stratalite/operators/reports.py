"""Checks, reports and small rules of surveys and catalogues."""

from __future__ import annotations

import difflib
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalite.session import ship, written


def phase_residuals(picks: DataFrame, phase: str = "phase", residual: str = "residual", weight: str = "weight") -> DataFrame:
    """phase, mean, std, n of the residuals of P and S picks; those of weight 9 don't count (a missing weight does)."""
    p = picks.where(F.trim(F.col(phase)).isin("P", "S") & F.col(residual).isNotNull() & ~F.isnan(residual) & (F.coalesce(F.col(weight).cast("string"), F.lit("")) != "9"))
    return p.groupBy(F.trim(F.col(phase)).alias("phase")).agg(F.avg(residual).alias("mean"), F.stddev_pop(residual).alias("std"), F.count(F.lit(1)).alias("n"))


def pick_issues(picks: DataFrame) -> DataFrame:
    """Each pick (event, at, station, phase, quality, first_motion, residual) with one row for every rule that it breaks: event, at, issue."""
    first, w = F.substring("phase", 1, 1), Window.partitionBy("event").orderBy("at")
    moved = F.coalesce(F.col("first_motion"), F.lit("")).isin("C", "D")
    picks = picks.withColumns({"_station": F.lag("station").over(w), "_phase": F.lag("phase").over(w)})
    behind = (F.col("_station") == F.col("station")) & F.col("_phase").contains("AML") & (F.trim(first) != "")
    rules = {
        "impulsive S": (F.col("quality") == "I") & (first == "S"),
        "impulsive P without first motion": (F.col("quality") == "I") & (first == "P") & ~moved,
        "emergent with first motion": (F.col("quality") == "E") & moved,
        "residual above 3": (F.col("quality") == "E") & (F.col("residual") > 3),
        "phases out of order": behind,
    }
    return picks.select("event", "at", F.explode(F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))).alias("issue"))


def event_issues(events: DataFrame, regions: Sequence[str]) -> DataFrame:
    """event, issue: places that are missing, and regions that aren't on the list."""
    rules = {"no latitude or longitude": F.col("latitude").isNull() | F.col("longitude").isNull(), "unknown region": ~F.col("region").isin(*regions)}
    return events.select("event", F.explode(F.array_compact(F.array(*[F.when(rule, name) for name, rule in rules.items()]))).alias("issue"))


def closest_names(rows: DataFrame, column: str, names: Sequence[str], cutoff: float = 0.7) -> DataFrame:
    """Each row with its name replaced by the likest one on the list, where one is as like as ``cutoff``; others stay, null too.

    Distinct names are compared, once each; the list is a parameter and goes to the tasks.
    """
    ship(rows.sparkSession)
    known = list(names)

    @F.pandas_udf("string")
    def likest(name: pd.Series) -> pd.Series:
        return name.map(lambda n: next(iter(difflib.get_close_matches(n, known, 1, cutoff)), n))

    matched = rows.where(F.col(column).isNotNull()).select(F.col(column).alias("_name")).distinct().withColumn("_like", likest("_name"))
    return rows.join(matched, rows[column] == F.col("_name"), "left").withColumn(column, F.coalesce("_like", F.col(column))).drop("_name", "_like")


def absolute_bases(readings: DataFrame, known: float, base: float, threshold: float, station: str = "station", t: str = "t", value: str = "value") -> DataFrame:
    """t, base: absolute values of a local base, from its readings between those of the known station (linear in time).

    Base stations are numbered above ``threshold``. The local base's readings outside of
    the known station's times have none. The base readings of a survey, not the
    survey's, pass through one ordered window.
    """
    from .joining import interpolate_base

    bases = readings.where(F.col(station) > threshold).select(F.lit(0).alias("line"), F.col(t).cast("double").alias("t"), F.col(value).cast("double").alias("value"), (F.col(station) == known).alias("base"))
    other = bases.where("NOT base").limit(1).count() > 0
    span = bases.where("base").agg(F.min("t").alias("_a"), F.max("t").alias("_b"))
    drift = interpolate_base(bases)
    drift = (drift.where("NOT base") if other else drift).crossJoin(F.broadcast(span)).where("t BETWEEN _a AND _b")
    return drift.select("t", (F.col("value") - F.col("drift") + base).alias("base"))


def after_first_base(readings: DataFrame, station: str, known: float, t: str) -> DataFrame:
    """The readings from the first one at the known station on."""
    first = readings.where(F.col(station) == known).agg(F.min(t).alias("_first"))
    return readings.crossJoin(F.broadcast(first)).where(F.col(t) >= F.col("_first")).drop("_first")


def one_file_a_scene(files: DataFrame, name: str = "file") -> DataFrame:
    """Of the archives and HDF files of one acquisition the HDF file (the last by name of several); other files all stay."""
    ours = F.col(name).contains("AST_") & F.lower(name).rlike(r"\.(hdf|zip)$")
    stamp = F.split(F.regexp_extract(name, "[^/]*$", 0), "_")[2]
    best = files.where(ours).groupBy(stamp.alias("_stamp")).agg(F.max(F.struct(F.lower(name).endswith(".hdf").alias("h"), F.struct(*files.columns).alias("row"))).alias("_b"))
    return files.where(~ours).unionByName(best.select("_b.row.*"))


def error_ellipse(dx: Column, dy: Column, dz: Column, xy: Column, xz: Column, yz: Column) -> Column:
    """major, minor (km) and angle (degrees) of the horizontal ellipse of a location's errors and covariances."""
    import numpy as np

    @F.pandas_udf("major double, minor double, angle double")
    def ellipse(dx: pd.Series, dy: pd.Series, dz: pd.Series, xy: pd.Series, xz: pd.Series, yz: pd.Series) -> pd.DataFrame:
        a, b, c, d, e, f = (v.to_numpy("float64") for v in (dx, dy, dz, xy, xz, yz))
        m = np.stack([np.stack([a * a, d, e], -1), np.stack([d, b * b, f], -1), np.stack([e, f, c * c], -1)], -2)
        good = ~np.isnan(m).any(axis=(1, 2))
        out = np.full((len(a), 3), np.nan)
        if good.any():
            values, axes = np.linalg.eigh(m[good])
            length = 2 * np.sqrt(abs(values)) * np.cos(np.arctan2(axes[:, 2], np.hypot(axes[:, 0], axes[:, 1])))
            most = length.argmax(axis=1)
            rows = np.arange(len(most))
            order = np.sort(length, axis=1)
            out[good] = np.stack([order[:, 2], order[:, 1], np.degrees(np.arctan2(axes[rows, 1, most], axes[rows, 0, most]))], -1)
        return pd.DataFrame(out, columns=["major", "minor", "angle"])

    return ellipse(dx, dy, dz, xy, xz, yz)


def intensity_hulls(points: DataFrame, levels: Sequence[float], at_once: int = 20_000) -> DataFrame:
    """level, hull: the convex hull (counter-clockwise, from its leftmost lowest point) of the points felt at each level or above.

    Hulls of hulls: a task reduces every ``at_once`` points of a level to their hull, then
    tasks of a quarter as many groups do so again with what was kept, until one is left.
    Only vertices go on, and every vertex of the whole hull is one of its part's.
    """
    ship(points.sparkSession)
    felt = points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.explode(F.filter(F.array(*[F.lit(float(v)) for v in levels]), lambda v: v <= F.col("intensity"))).alias("level"))

    def ring(p) -> list:
        p = sorted(set(p))

        def half(seq):
            out = []
            for q in seq:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(q)
            return out[:-1]

        return (half(p) + half(p[::-1])) or p

    def reduced(batches):
        kept: dict = {}
        for batch in batches:
            for level, part in batch.groupby("level"):
                held = kept.setdefault(level, [])
                held += zip(part["x"], part["y"], strict=True)
                if len(held) >= at_once:
                    kept[level] = ring(held)
        for level, p in kept.items():
            p = ring(p)
            yield pd.DataFrame({"level": level, "x": [q[0] for q in p], "y": [q[1] for q in p]})

    def hull(part: pd.DataFrame) -> pd.DataFrame:
        p = ring(zip(part["x"], part["y"], strict=True))
        return pd.DataFrame({"level": [part["level"].iloc[0]], "hull": [[{"x": float(x), "y": float(y)} for x, y in p]]})

    shape = "level double, x double, y double"
    left = written(felt.select("level", "x", "y").mapInPandas(reduced, shape), "hulls")
    groups = math.ceil((left.groupBy("level").count().agg(F.max("count")).first()[0] or 0) / at_once)
    while groups > 1:
        groups = math.ceil(groups / 4)
        before = left.count()
        left = written(left.withColumn("_g", F.pmod(F.xxhash64("x", "y"), F.lit(groups))).repartition(max(1, groups) * len(levels), "level", "_g").select("level", "x", "y").mapInPandas(reduced, shape), "hulls")
        if left.count() > 0.9 * before:  # nearly all points are vertices of the hull itself
            break
    return left.groupBy("level").applyInPandas(hull, "level double, hull array<struct<x: double, y: double>>")


def intensity_bands(hulls: DataFrame) -> DataFrame:
    """level, rings of what is felt at a level and not at the next one: its hull with the next hull as a hole.

    ``hulls`` are :func:`intensity_hulls`, each inside the one before, so the difference is
    the two rings together, as polygons with holes are here. Rings are closed; the last
    level has no hole, and a hull of less than three points has no ring and makes none.
    """
    closed = F.when(F.size("hull") > 2, F.concat("hull", F.slice("hull", 1, 1)))
    rings = hulls.select("level", closed.alias("_ring"))
    after = rings.withColumn("_hole", F.lead("_ring").over(Window.orderBy("level")))  # a row for each level asked for
    return after.where("_ring IS NOT NULL").select("level", F.filter(F.array("_ring", "_hole"), lambda r: r.isNotNull()).alias("rings"))


def robust_scale(rows: DataFrame, column: str, lines: DataFrame | None = None) -> DataFrame:
    """One row: median and scale (2.5 times the scaled median deviation, 1 if that is 0) of a column."""
    from .stats import medians

    long = rows.where(F.col(column).isNotNull()).select(F.lit("v").alias("band"), F.col(column).cast("double").alias("value"))
    middle = medians(long).get("v")
    deviation = medians(long.withColumn("value", F.abs(F.col("value") - F.lit(middle)))).get("v")
    scale = None if deviation is None else 2.5 * deviation * 1.4826 or 1.0
    return rows.sparkSession.createDataFrame([(middle, scale)], "median double, scale double")


def last_label(cells: DataFrame, x: str, y: str, label: str, order: Sequence[str], nx: int, ny: int) -> DataFrame:
    """bx, by, n, label: counts over bins of two columns, with the label of the last cell of each bin."""
    from .grid import with_stats

    c = with_stats(cells.where(F.col(x).isNotNull() & F.col(y).isNotNull()), _x0=F.min(x), _x1=F.max(x), _y0=F.min(y), _y1=F.max(y))
    bin_of = lambda v, low, high, n: F.least(F.coalesce(F.floor(F.try_divide((F.col(v) - F.col(low)) * n, F.col(high) - F.col(low))), F.lit(0)), F.lit(n - 1)).cast("int")
    return c.groupBy(bin_of(x, "_x0", "_x1", nx).alias("bx"), bin_of(y, "_y0", "_y1", ny).alias("by")).agg(F.count(F.lit(1)).alias("n"), F.max_by(label, F.struct(*order, label)).alias("label"))


def tidy_columns(df: DataFrame) -> DataFrame:
    """Columns in lower case, without blanks around them, commas as blanks and slashes as "div"."""
    return df.toDF(*[c.strip().lower().replace(",", " ").replace("/", "div") for c in df.columns])


def band_checks(meta: DataFrame) -> DataFrame:
    """One row of bands, projections and missing values that differ among rasters (band, crs, nodata), and whether they can be joined."""
    n = meta.agg(F.count_distinct("band").alias("bands"), F.count_distinct(F.coalesce("crs", F.lit(""))).alias("projections"), F.count_distinct(F.coalesce(F.col("nodata").cast("string"), F.lit(""))).alias("nodata"))
    return n.withColumn("alike", (F.col("projections") <= 1) & (F.col("nodata") <= 1))


def rotated_impedance(xx: Column, xy: Column, yx: Column, yy: Column, degrees: float) -> dict[str, Column]:
    """A 2 x 2 tensor turned clockwise by an angle; for complex ones, real and imaginary parts alike."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return {"xx": c * c * xx + c * s * (xy + yx) + s * s * yy, "xy": c * c * xy - s * s * yx + c * s * (yy - xx), "yx": c * c * yx - s * s * xy + c * s * (yy - xx), "yy": s * s * xx - c * s * (xy + yx) + c * c * yy}


def without_shift(xx: Column, xy: Column, yx: Column, yy: Column, shift_x: float, shift_y: float) -> dict[str, Column]:
    """A tensor without static shift: resistivity factors of the two rows, so the tensor is divided by their roots."""
    x, y = math.sqrt(shift_x), math.sqrt(shift_y)
    return {"xx": xx / x, "xy": xy / x, "yx": yx / y, "yy": yy / y}
