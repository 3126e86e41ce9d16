"""Operators on raster cells: tables of (row, col) and band columns, with null for masked cells.

Statistics of a whole raster are one aggregated row, broadcast to the cells, so
that each operator is a scan with a partial aggregate and no data on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalite.functions.formula import formula


def with_stats(cells: DataFrame, **stats: Column) -> DataFrame:
    """Each cell with the same one row of whole-raster aggregates."""
    return cells.crossJoin(F.broadcast(cells.agg(*[c.alias(n) for n, c in stats.items()])))


def cell_mean(points: DataFrame, dxy: float, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Mean of the points of each cell of size ``dxy``, cells counted from the least x and y: row, col, value."""
    p = points.where(F.col(z).isNotNull())
    p = with_stats(p, _x0=F.min(x), _y0=F.min(y))
    return p.groupBy(F.floor((F.col(y) - F.col("_y0")) / dxy).cast("int").alias("row"), F.floor((F.col(x) - F.col("_x0")) / dxy).cast("int").alias("col")).agg(F.avg(z).alias("value"))


def quickgrid(points: DataFrame, dxy: float, levels: int = 4, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Cell means, with empty cells filled from the means of cells twice, four times, ... as wide.

    Coarse sums are sums of the finest cells' sums, so that points are grouped once.
    """
    p = with_stats(points.where(F.col(z).isNotNull()), _x0=F.min(x), _y0=F.min(y))
    fine = p.groupBy(F.floor((F.col(y) - F.col("_y0")) / dxy).cast("int").alias("row"), F.floor((F.col(x) - F.col("_x0")) / dxy).cast("int").alias("col")).agg(F.sum(z).alias("s"), F.count(z).alias("n"))
    size = fine.agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    out = size.select(F.explode(F.sequence(F.lit(0), "rows")).alias("row"), "cols").select("row", F.explode(F.sequence(F.lit(0), "cols")).alias("col"))
    for k in range(levels):
        f = 2**k
        level = fine.groupBy(F.floor(F.col("row") / f).cast("int").alias(f"r{k}"), F.floor(F.col("col") / f).cast("int").alias(f"c{k}")).agg((F.sum("s") / F.sum("n")).alias(f"v{k}"))
        out = out.join(level, (F.floor(F.col("row") / f).cast("int") == F.col(f"r{k}")) & (F.floor(F.col("col") / f).cast("int") == F.col(f"c{k}")), "left").drop(f"r{k}", f"c{k}")
    return out.select("row", "col", F.coalesce(*[F.col(f"v{k}") for k in range(levels)]).alias("value"))


def normalise(cells: DataFrame, how: str, value: str = "value") -> DataFrame:
    """(v - a) / b with (min, range), (mean, population deviation) or (median, median absolute deviation)."""
    if how == "interval":
        s = with_stats(cells, _a=F.min(value), _b=F.max(value) - F.min(value))
    elif how == "mean":
        s = with_stats(cells, _a=F.avg(value), _b=F.stddev_pop(value))
    elif how == "median":
        from .stats import medians

        long = cells.select(F.lit("v").alias("band"), F.col(value).cast("double").alias("value"))
        a = medians(long).get("v")
        b = medians(long.withColumn("value", F.abs(F.col("value") - F.lit(a)))).get("v")
        s = cells.withColumns({"_a": F.lit(a).cast("double"), "_b": F.lit(b).cast("double")})
    else:
        raise ValueError(how)
    return s.withColumn(value, F.try_divide(F.col(value) - F.col("_a"), F.col("_b"))).drop("_a", "_b")


def clip_percentiles(cells: DataFrame, low: float, high: float, value: str = "value") -> DataFrame:
    """Values clamped to two interpolated percentiles (in percent, from below and from above); nulls stay."""
    from .stats import exact_quantiles

    limits = exact_quantiles(cells.select(F.lit("v").alias("band"), F.col(value).cast("double").alias("value")), [low / 100, 1 - high / 100]).get("v", [None, None])
    return cells.withColumn(value, F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), F.lit(limits[0]).cast("double")), F.lit(limits[1]).cast("double"))))


def norm2(cells: DataFrame, low: float | None = None, high: float | None = None, value: str = "value") -> DataFrame:
    """Values between two limits (of the data by default) to 0..1, clamped; nulls stay."""
    s = with_stats(cells, _a=F.min(value) if low is None else F.first(F.lit(float(low))), _b=F.max(value) if high is None else F.first(F.lit(float(high))))
    share = F.try_divide(F.col(value) - F.col("_a"), F.col("_b") - F.col("_a"))
    return s.withColumn(value, F.when(F.col(value).isNotNull(), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))).drop("_a", "_b")


def norm255(cells: DataFrame, value: str = "value") -> DataFrame:
    """Values to 1..255, rounded half to even; 0 is left for masked cells."""
    s = with_stats(cells, _a=F.min(value), _b=F.max(value) - F.min(value))
    return s.withColumn(value, F.bround(F.try_divide(254 * (F.col(value) - F.col("_a")), F.col("_b")) + 1).cast("int")).drop("_a", "_b")


def histogram(cells: DataFrame, bins: int, value: str = "value") -> DataFrame:
    """Counts of equal bins from the least to the greatest value: bin (0..), n."""
    s = with_stats(cells.where(F.col(value).isNotNull()), _a=F.min(value), _b=F.max(value))
    at = F.least(F.floor(F.try_divide((F.col(value) - F.col("_a")) * bins, F.col("_b") - F.col("_a"))), F.lit(bins - 1)).cast("int")
    return s.groupBy(F.coalesce(at, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def equalise(cells: DataFrame, bins: int = 32768, value: str = "value") -> DataFrame:
    """Histogram equalisation: the cells in higher bins than the first, up to the value's own, scaled to 0..``bins``; between bin centres linearly.

    A cell needs the counts up to the bins of the two centres around it: one window
    over the bins, and one join with them.
    """
    s = with_stats(cells, _a=F.min(value), _b=F.max(value))
    counts = s.select("_a", "_b").limit(1).select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(histogram(cells, bins, value), "bin", "left")
    up = counts.select("bin", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(F.lit(0)).orderBy("bin")).alias("c"))  # ``bins`` rows
    scaled = with_stats(up, _c0=F.min("c"), _c1=F.max("c")).select("bin", (F.lit(float(bins)) * F.try_divide(F.col("c") - F.col("_c0"), F.col("_c1") - F.col("_c0"))).alias("c"))
    scaled = scaled.select("bin", "c", F.coalesce(F.lead("c").over(Window.partitionBy(F.lit(0)).orderBy("bin")), "c").alias("next"))
    place = F.greatest(F.least(F.try_divide((F.col(value) - F.col("_a")) * bins, F.col("_b") - F.col("_a")) - 0.5, F.lit(bins - 1.0)), F.lit(0.0))
    s = s.withColumn("_place", place).withColumn("bin", F.floor("_place").cast("int")).join(F.broadcast(scaled), "bin", "left")
    return s.withColumn(value, F.col("c") + (F.col("next") - F.col("c")) * (F.col("_place") - F.col("bin"))).drop("_a", "_b", "_place", "bin", "c", "next")


def trim(cells: DataFrame, value: str = "value") -> DataFrame:
    """Without the border rows and columns that are null throughout, counted anew from 0."""
    ok = F.col(value).isNotNull()
    s = with_stats(cells, _r0=F.min(F.when(ok, F.col("row"))), _r1=F.max(F.when(ok, F.col("row"))), _c0=F.min(F.when(ok, F.col("col"))), _c1=F.max(F.when(ok, F.col("col"))))
    s = s.where("row BETWEEN _r0 AND _r1 AND col BETWEEN _c0 AND _c1")
    return s.withColumns({"row": F.col("row") - F.col("_r0"), "col": F.col("col") - F.col("_c0")}).drop("_r0", "_r1", "_c0", "_c1")


def crop(cells: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """The cells of a window, limits included."""
    return cells.where(F.col("row").between(*rows) & F.col("col").between(*cols))


def stack(bands: dict[str, DataFrame], common: bool = False) -> DataFrame:
    """Co-registered bands (row, col, value) side by side; with ``common`` a cell null in one band is null in all."""
    out = None
    for name, band in bands.items():
        b = band.select("row", "col", F.col("value").alias(name))
        out = b if out is None else out.join(b, ["row", "col"], "full")
    if common:
        every = F.lit(True)
        for name in bands:
            every = every & F.col(name).isNotNull()
        out = out.withColumns({name: F.when(every, F.col(name)) for name in bands})
    return out


def mosaic(scenes: DataFrame, how: str, order: str = "scene", value: str = "value") -> DataFrame:
    """One value for each cell of overlapping scenes: min, max, first, last or mean of those that aren't null."""
    ok = scenes.where(F.col(value).isNotNull())
    reduce = {"min": F.min(value), "max": F.max(value), "first": F.min_by(value, order), "last": F.max_by(value, order), "mean": F.avg(value)}[how]
    return ok.groupBy("row", "col").agg(reduce.alias(value))


def mosaic_median(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` over ``old``, moved by the difference of their medians where they overlap."""
    both = old.select("row", "col", F.col("value").alias("a")).join(new.select("row", "col", F.col("value").alias("b")), ["row", "col"], "full")
    from .stats import medians

    middle = medians(both.where("a IS NOT NULL AND b IS NOT NULL").select(*[F.col(c).cast("double").alias(c) for c in "ab"]).unpivot([], ["a", "b"], "band", "value"))
    return both.select("row", "col", F.coalesce(F.col("b") + F.lit(middle.get("a", 0.0) - middle.get("b", 0.0)), "a").alias("value"))


def equation(cells: DataFrame, text: str, bands: Iterable[str], out: str = "value") -> DataFrame:
    """A new band by a formula over ``i0, i1, ...`` (the bands in order) and band names; what a formula may hold: ``functions.formula``.

    Other names are refused. A null in a band that is used makes the result null; so
    does a division by zero.
    """
    names = list(bands)

    def band(name: str) -> Column | None:
        if name in names:
            return F.col(f"`{name}`").cast("double")
        if re.fullmatch(r"i\d+", name) and int(name[1:]) < len(names):
            return F.col(f"`{names[int(name[1:])]}`").cast("double")
        return None

    return cells.withColumn(out, formula(text, band).cast("double"))


def ratio(numerator: Column, denominator: Column, least: float = 1e-8) -> Column:
    """A band ratio; a denominator close to zero masks the cell."""
    return F.when(F.abs(denominator) > least, numerator / denominator)


def bands_mean(bands: Sequence[str]) -> Column:
    """Mean of a cell's bands that aren't null, null if all are."""
    known = F.filter(F.array(*bands), lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))


def bands_std(bands: Sequence[str]) -> Column:
    """Population deviation of a cell's bands that aren't null."""
    known, mean = F.filter(F.array(*bands), lambda x: x.isNotNull()), bands_mean(bands)
    return F.when(F.size(known) > 0, F.sqrt(F.aggregate(known, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(known)))
