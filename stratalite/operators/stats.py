"""Statistics of bands, columns and classes; histograms; correlations."""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalite.session import written


def unpivot(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows of (keys, band, value) for the given columns."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), list(columns), "band", "value")


def _keys(long: DataFrame) -> DataFrame:
    """(band, key) of the known values: the bits of a double as a whole number of the same order."""
    bits = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), F.col("value") + 0.0).cast("long")  # -0.0 is 0.0
    known = long.where("value IS NOT NULL AND NOT isnan(value)").select("band", bits.alias("bits"))
    return written(known, "quantile-bits").select("band", F.when(F.col("bits") < 0, F.col("bits").bitwiseXOR((1 << 63) - 1)).otherwise(F.col("bits")).alias("key"))


def _value(key: int) -> float:
    """The double of a key."""
    return struct.unpack("<d", struct.pack("<q", key ^ ((1 << 63) - 1) if key < 0 else key))[0]


def _between(a: float, b: float, f: float) -> float:
    if not f or a == b:
        return a
    return a + (b - a) * f if math.isfinite(b - a) or math.isinf(a) or math.isinf(b) else a * (1 - f) + b * f


def exact_quantiles(long: DataFrame, probabilities: Sequence[float], bins: int = 4096) -> dict[str, list[float]]:
    """Of (band, value) rows: each band's exact quantiles, interpolated between neighbours; nulls and NaN are skipped.

    Values are ordered as whole numbers of 64 bits, which are written once. Each round
    counts the next bits of them, ``bins`` equal parts of the intervals that hold the
    wanted ranks, so that six rounds end for any values, infinite and denormal ones too.
    The driver gets ``bins`` counts for each interval. Between infinities of both signs
    lies NaN.
    """
    bits = max(1, bins.bit_length() - 1)
    keys = _keys(long)
    bands = {r.band: r for r in keys.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()}
    ranks = {b: [((r.n - 1) * p // 1, (r.n - 1) * p % 1) for p in probabilities] for b, r in bands.items()}
    wanted = {(b, int(k) + d): (r.a, r.b, int(k) + d) for b, r in bands.items() for k, f in ranks[b] for d in ((0, 1) if f else (0,))}
    while todo := sorted({(b, a, z) for (b, _), (a, z, _) in wanted.items() if a < z}):
        parts = [(b, a, z, max(0, (z - a).bit_length() - bits)) for b, a, z in todo]
        known = keys.join(F.broadcast(keys.sparkSession.createDataFrame(parts, "band string, a long, z long, shift int")), "band").where("key BETWEEN a AND z")
        at = F.expr("shiftright(key, shift) - shiftright(a, shift)").alias("bin")  # shifted first, as a difference of 64 bits may overflow
        rows = known.groupBy("band", "a", "z", at).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        held: dict = {}
        for r in sorted(rows, key=lambda r: (r.band, r.a, r.z, r.bin)):
            held.setdefault((r.band, r.a, r.z), []).append(r)
        for key, (a, z, rank) in wanted.items():
            if a < z:
                for r in held[key[0], a, z]:
                    if rank < r.n:
                        wanted[key] = (r.low, r.high, rank)
                        break
                    rank -= r.n
    value = lambda b, k: _value(wanted[b, int(k)][0])
    return {b: [_between(value(b, k), value(b, k + 1) if f else value(b, k), f) for k, f in ranks[b]] for b in bands}


def medians(long: DataFrame) -> dict[str, float]:
    return {b: v[0] for b, v in exact_quantiles(long, [0.5]).items()}


def by_band(values: dict[str, float], missing: float | None = None):
    """A column with the value of each row's band."""
    known = [x for b, v in values.items() for x in (F.lit(b), F.lit(v))]
    return F.try_element_at(F.create_map(*known), F.col("band")) if known else F.lit(missing).cast("double")


def band_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per band: least, greatest, mean, population deviation, median, median absolute deviation, count, biased skew and excess kurtosis."""
    long = unpivot(df, columns).where("value IS NOT NULL")
    middle = medians(long)
    mad = medians(long.withColumn("value", F.abs(F.col("value") - by_band(middle))))
    each = lambda c: {"min": F.min(c), "max": F.max(c), "mean": F.avg(c), "std": F.stddev_pop(c), "n": F.count(c), "skew": F.skewness(c), "kurtosis": F.kurtosis(c)}
    one = df.agg(*[F.struct(*[f.alias(n) for n, f in each(F.col(c).cast("double")).items()]).alias(c) for c in columns])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("band"), F.col(c).alias("s")) for c in columns])).alias("x")).select("x.band", "x.s.*")
    return rows.where("n > 0").withColumns({"median": by_band(middle), "mad": by_band(mad)})


def column_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per numeric column: mean, sample deviation, median, least, greatest; nulls are skipped."""
    long = unpivot(df, columns)
    return long.groupBy("band").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max")).withColumn("median", by_band(medians(long)))


def class_statistics(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each band in each class."""
    return unpivot(df, columns, [label]).groupBy(label, "band").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def pair_table(df: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """Correlation (of rows where both are known) or sample covariance (of rows where all are) of each pair: a, b, value."""
    pairs = list(combinations_with_replacement(columns, 2))
    source = df if how == "corr" else df.dropna(subset=list(columns))
    f = F.corr if how == "corr" else F.covar_samp
    one = source.agg(*[f(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("value")) for a, b in pairs])).alias("x")).select("x.*")


def fixed_histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, low edge, n and the running count of equal bins over the range; the last one is closed."""
    known = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    s = known.crossJoin(F.broadcast(known.agg(F.min("v").alias("a"), F.max("v").alias("b"))))
    at = F.coalesce(F.least(F.floor(F.try_divide((F.col("v") - F.col("a")) * bins, F.col("b") - F.col("a"))), F.lit(bins - 1)), F.lit(0)).cast("int")
    h = s.groupBy(at.alias("bin"), "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return h.select("bin", (F.col("a") + (F.col("b") - F.col("a")) / bins * F.col("bin")).alias("low"), "n", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("bin")).alias("running"))


def weighted_histogram(df: DataFrame, x: str, weight: str, width: float) -> DataFrame:
    """Sum of weights in bins of a width, counted from zero."""
    return df.groupBy(F.floor(F.col(x) / width).cast("int").alias("bin")).agg(F.sum(weight).alias("weight"))


def histogram_2d(df: DataFrame, x: str, y: str, nx: int, ny: int) -> DataFrame:
    """Counts of nx by ny equal bins over both ranges."""
    s = df.crossJoin(F.broadcast(df.agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))))
    at = lambda v, a, b, n: F.least(F.floor(F.try_divide((F.col(v) - F.col(a)) * n, F.col(b) - F.col(a))), F.lit(n - 1)).cast("int")
    return s.groupBy(at(x, "_x0", "_x1", nx).alias("bx"), at(y, "_y0", "_y1", ny).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def modal_value(df: DataFrame, column: str, bins: int = 255, zooms: int = 1) -> DataFrame:
    """The middle of the fullest bin after zooming into the fullest bin ``zooms`` times (the first of equally full ones)."""
    known = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    limits = known.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    for _ in range(zooms + 1):
        s = known.crossJoin(F.broadcast(limits)).where("v BETWEEN a AND b")
        at = F.coalesce(F.least(F.floor(F.try_divide((F.col("v") - F.col("a")) * bins, F.col("b") - F.col("a"))), F.lit(bins - 1)), F.lit(0))
        h = s.groupBy(at.alias("bin"), "a", "b").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "bin").limit(1)
        step = (F.col("b") - F.col("a")) / bins
        limits = h.select((F.col("a") + step * F.col("bin")).alias("a"), (F.col("a") + step * (F.col("bin") + 1)).alias("b"))
    return limits.select(((F.col("a") + F.col("b")) / 2).alias("mode"))


def display_limits(df: DataFrame, column: str, deviations: float = 2.0) -> DataFrame:
    """Mean less and plus a number of population deviations."""
    m, s = F.avg(column), F.stddev_pop(column)
    return df.agg((m - deviations * s).alias("low"), (m + deviations * s).alias("high"))


def class_breaks(df: DataFrame, column: str) -> DataFrame:
    """The quartile (1..4, right-closed) that each value lies in."""
    found = exact_quantiles(df.select(F.lit("v").alias("band"), F.col(column).cast("double").alias("value")), [0.25, 0.5, 0.75]).get("v", [None] * 3)
    v, q = F.col(column), [F.lit(x).cast("double") for x in found]
    return df.withColumn("quartile", F.when(v <= q[0], 1).when(v <= q[1], 2).when(v <= q[2], 3).when(v.isNotNull(), 4))


def confusion(df: DataFrame, truth: str, found: str) -> DataFrame:
    """Counts of each pair of classes."""
    return df.groupBy(truth, found).agg(F.count(F.lit(1)).alias("n"))


def accuracy_kappa(df: DataFrame, truth: str, found: str) -> DataFrame:
    """Overall accuracy and Cohen's kappa."""
    n = confusion(df, truth, found)
    total = n.agg(F.sum("n").alias("t"), F.sum(F.when(F.col(truth) == F.col(found), F.col("n")).otherwise(0)).alias("hit"))
    rows, cols = n.groupBy(F.col(truth).alias("k")).agg(F.sum("n").alias("r")), n.groupBy(F.col(found).alias("k")).agg(F.sum("n").alias("c"))
    chance = rows.join(cols, "k").agg(F.sum(F.col("r") * F.col("c")).alias("rc"))
    pe = F.col("rc") / (F.col("t") * F.col("t"))
    po = F.col("hit") / F.col("t")
    return total.crossJoin(chance).select(po.alias("accuracy"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def variance_ratio(df: DataFrame, label: str, bands: Sequence[str]) -> DataFrame:
    """Variance between classes over that within, each over its degrees of freedom."""
    long = unpivot(df.withColumn("_l", F.col(label)), bands, ["_l"])
    per = long.groupBy("_l", "band").agg(F.avg("value").alias("m"), F.count("value").alias("n"), (F.var_pop("value") * F.count("value")).alias("w"))
    grand = long.groupBy("band").agg(F.avg("value").alias("g"))
    both = per.join(F.broadcast(grand), "band").agg(F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))).alias("b"), F.sum("w").alias("w"), F.countDistinct("_l").alias("k"), (F.sum("n") / len(bands)).alias("n"))
    return both.select(F.try_divide(F.col("b") / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k"))).alias("vrc"))
