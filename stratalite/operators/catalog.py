"""Operators on catalogues of events and on readings along lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalite.session import settled, ship

from .joining import starting_radius


#: Buckets of a tile's side, places of a task, and distances that are looked at together.
TILE, PLACES, MATRIX = 8, 20_000, 2_000_000


def range_filter(events: DataFrame, column: str, low: float, high: float, exclude: bool = False) -> DataFrame:
    """Events with a value inside (or, excluding, outside) a range; null is neither."""
    inside = F.col(column).between(low, high)
    return events.where(~inside if exclude else inside)


def all_phases(events: DataFrame, phases: str, passes) -> DataFrame:
    """Events of which every phase of the array passes; events without phases go."""
    return events.where((F.size(phases) > 0) & F.forall(phases, passes))


def limits(events: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Least and greatest value of each column: field, low, high."""
    return events.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "field", "v").groupBy("field").agg(F.min("v").alias("low"), F.max("v").alias("high"))


def without_keywords(lines: DataFrame, column: str, words: Sequence[str]) -> DataFrame:
    """Lines that contain none of the words."""
    for w in words:
        lines = lines.where(~F.col(column).contains(w))
    return lines


def frequency_magnitude(events: DataFrame, mag: str = "mag", step: float = 0.1) -> DataFrame:
    """b-value: completeness (the first modal magnitude), least-squares fit of log10 N(>=M) from there over every bin, and the likelihood estimate."""
    m = events.where(F.col(mag).isNotNull()).select(F.round(F.col(mag) / step).cast("int").alias("bin"), F.col(mag).alias("m"))
    h = m.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = h.agg(F.min("bin").alias("a"), F.max("bin").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("bin"))
    up = every.join(h, "bin", "left").withColumn("above", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(F.lit(0)).orderBy(F.desc("bin"))))
    mode = h.orderBy(F.desc("n"), "bin").limit(1).select(F.col("bin").alias("_c"))
    line = up.crossJoin(F.broadcast(mode)).where("bin >= _c").agg(F.regr_slope(F.log10("above"), F.col("bin") * step).alias("slope"), F.regr_intercept(F.log10("above"), F.col("bin") * step).alias("a"), (F.min("_c") * step).alias("completeness"))
    mle = m.crossJoin(F.broadcast(mode)).where("bin >= _c").agg((F.lit(0.4342944819032518) / (F.avg("m") - F.min("m"))).alias("b_mle"))
    return line.crossJoin(mle).select("completeness", (-F.col("slope")).alias("b"), "a", "b_mle")


def reverse_cumulative(events: DataFrame, column: str) -> DataFrame:
    """Count of events at each value, and at or above it; events without a value aren't counted."""
    from .components import running_totals

    return running_totals(events.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")), column, "n", "above", falling=True)


def travel_time_pairs(picks: DataFrame, event: str, station: str, p: str, s: str) -> DataFrame:
    """Of each event all pairs of stations, with the differences of their P and S times: event, dp, ds."""
    a = picks.select(event, F.col(station).alias("_a"), F.col(p).alias("_pa"), F.col(s).alias("_sa"))
    b = picks.select(event, F.col(station).alias("_b"), F.col(p).alias("_pb"), F.col(s).alias("_sb"))
    return a.join(b, event).where("_a < _b").select(event, F.abs(F.col("_pa") - F.col("_pb")).alias("dp"), F.abs(F.col("_sa") - F.col("_sb")).alias("ds"))


def wadati(picks: DataFrame, event: str = "event", station: str = "station", p: str = "p", s: str = "s", least_stations: int = 5, low: float = 1.53, high: float = 1.93) -> DataFrame:
    """Slope of S on P differences for each event with more than so many stations and a slope in range."""
    many = picks.groupBy(event).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least_stations)
    fit = travel_time_pairs(picks.join(many, event, "left_semi"), event, station, p, s).groupBy(event).agg(F.regr_slope("ds", "dp").alias("vpvs"))
    return fit.where(F.col("vpvs").between(low, high))


def last_picks(readings: DataFrame, order: str, event: str = "event", station: str = "station", phase: str = "phase", time: str = "time", weight: str | None = "weight") -> DataFrame:
    """event, station, p, s: of each station with both the last P and the last S time of an event, by ``order`` (of equal ones the latest time).

    Blanks around phase names don't count; readings of weight 9 are out of use. Readings
    without an event, station, time or order are left out.
    """
    name = F.trim(F.col(phase))
    known = readings.where(name.isin("P", "S") & F.col(event).isNotNull() & F.col(station).isNotNull() & F.col(time).isNotNull() & F.col(order).isNotNull())
    if weight is not None:
        known = known.where(~F.col(weight).eqNullSafe(F.lit(9)))
    last = lambda which: F.max(F.when(name == which, F.struct(F.col(order).alias("o"), F.col(time).alias("t"))))
    both = known.groupBy(event, station).agg(last("P").alias("_p"), last("S").alias("_s")).where("_p IS NOT NULL AND _s IS NOT NULL")
    return both.select(F.col(event).alias("event"), F.col(station).alias("station"), F.col("_p.t").alias("p"), F.col("_s.t").alias("s"))


def station_residuals(picks: DataFrame, event: str, station: str, value: str) -> DataFrame:
    """Mean and deviation, per station, of what each pick differs from its event's mean."""
    r = picks.withColumn("_r", F.col(value) - F.avg(value).over(Window.partitionBy(event)))
    return r.groupBy(station).agg(F.avg("_r").alias("mean"), F.stddev_pop("_r").alias("std"), F.count("_r").alias("n"))


def mercalli(mag: Column) -> Column:
    """Intensity from magnitude: whole magnitudes 4, 6, 7 and 8 have steps of their own."""
    steps = ((mag < 2, "I"), (mag < 3, "II"), (mag < 4, "III"), (mag == 4, "IV"), (mag < 5, "V"), (mag < 6, "VI"), (mag == 6, "VII"), (mag < 7, "VIII"), (mag == 7, "IX"), (mag < 8, "X"), (mag == 8, "XI"), (mag > 8, "XII"))
    found = F.when(mag.isNull(), None)
    for at, name in steps:
        found = found.when(at, name)
    return found


def magnitude_columns(events: DataFrame, event: str, kind: str, mag: str, kinds: Sequence[str]) -> DataFrame:
    """One row for each event with a column for the greatest magnitude of each kind."""
    return events.groupBy(event).pivot(kind, list(kinds)).agg(F.max(mag))


def profile_distance(readings: DataFrame, line: str, order: str, x: str, y: str) -> DataFrame:
    """Adds ``distance``: the way along the line to each reading."""
    w = Window.partitionBy(line).orderBy(order)
    step = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), F.lit(2)) + F.pow(F.col(y) - F.lag(y).over(w), F.lit(2)))
    return readings.withColumn("_s", F.coalesce(step, F.lit(0.0))).withColumn("distance", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_s")


def line_azimuth(readings: DataFrame, line: str, order: str, x: str, y: str) -> DataFrame:
    """Adds ``azimuth`` of the way to the next reading (degrees); the last one has that of the one before."""
    w = Window.partitionBy(line).orderBy(order)
    a = readings.withColumn("_a", F.degrees(F.atan2(F.lead(x).over(w) - F.col(x), F.lead(y).over(w) - F.col(y))))
    return a.withColumn("azimuth", F.coalesce("_a", F.lag("_a").over(w))).drop("_a")


def day_index(readings: DataFrame, day: str, line: str | None = None) -> DataFrame:
    """Adds ``day_no``: 1 for the first day, one more with each other day (of each line, if one is named); null for a null day."""
    from .components import numbered

    if not line:
        return readings.join(numbered(readings, day, "day_no").withColumn("day_no", F.col("day_no").cast("int")), day, "left")
    return readings.withColumn("day_no", F.dense_rank().over(Window.partitionBy(line).orderBy(day)))


def rename_duplicates(names: DataFrame, name: str, order: str) -> DataFrame:
    """Names that occur more than once get (1), (2), ... in order."""
    w = Window.partitionBy(name)
    return names.withColumn(name, F.when(F.count(F.lit(1)).over(w) > 1, F.concat(name, F.lit("("), F.row_number().over(w.orderBy(order)), F.lit(")"))).otherwise(F.col(name)))


def drift_rate(readings: DataFrame, keys: Sequence[str], t: str, value: str) -> DataFrame:
    """Change of the value per minute between the first and last reading of each group; null for a single one."""
    span = (F.max(t) - F.min(t)) / 60
    return readings.groupBy(*keys).agg(F.try_divide(F.max_by(value, t) - F.min_by(value, t), span).alias("rate"))


def segments_of(lines: DataFrame, delimiter: Column, key: str, order: str, out: str = "block") -> DataFrame:
    """Adds the number of delimiter rows so far in each ``key`` (file, line): rows between two delimiters share a block."""
    return lines.withColumn(out, F.sum(delimiter.cast("int")).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def quarry_blasts(events: DataFrame, day: tuple[int, int], k: int = 50, radius: float = 0.2, ratio: float = 3.0, start: float | None = None) -> DataFrame:
    """Events (event, lat, lon, hour) without those that look like blasts.

    Each event with its k - 1 nearest within ``radius`` degrees is a node; where the
    rate of daytime events over that of the others exceeds ``ratio``, the node's
    daytime events go. ``start`` is the first radius that is searched, or so much less
    that events are few in each bucket.

    Places are judged in tiles of buckets with a border of one, so neither pairs nor
    neighbours are sent. Those with fewer than k events within a radius go on to twice
    the radius. Of events of one place the k least can be among the nearest. Events
    without a place (null or NaN) are no node, and stay.
    """
    spark = events.sparkSession
    ship(spark)
    x, y = F.col("lon").cast("double"), F.col("lat").cast("double")
    known = events.select(F.col("event").alias("rid"), x.alias("rx"), y.alias("ry"), F.coalesce(F.col("hour").between(*day), F.lit(False)).alias("is_day")).where("rid IS NOT NULL AND rx IS NOT NULL AND ry IS NOT NULL AND NOT isnan(rx) AND NOT isnan(ry)")
    least = F.row_number().over(Window.partitionBy("rx", "ry").orderBy("rid"))
    there = settled(known.withColumn("_n", least).where(F.col("_n") <= k).drop("_n"))
    open_ = there.select("rx", "ry").distinct()
    reach, side, blasts = min(radius, starting_radius(there, start or radius / 4, 4 * k + 12, radius)), TILE, None
    while True:
        last = reach >= radius
        judged = settled(_judged(open_, there, k, reach, side, day[1] - day[0], ratio, last))
        some = judged.where("rid IS NOT NULL").select(F.col("rid").alias("event"))
        blasts = some if blasts is None else blasts.unionByName(some)
        open_ = judged.where("rid IS NULL").select("rx", "ry")
        if last or open_.isEmpty():
            return events.join(blasts.distinct(), "event", "left_anti")
        reach, side = min(radius, reach * 2), max(1, side // 2)


def _judged(places: DataFrame, events: DataFrame, k: int, reach: float, side: int, days: int, ratio: float, last: bool) -> DataFrame:
    """Daytime events (rid) near places (rx, ry) that look like blasts, and places with fewer than k events (rid, rx, ry) within ``reach``, unless it is the last one."""
    tile = lambda c, by: F.floor((F.floor(F.col(c) / reach) + by) / side)
    tiles = lambda c: F.explode(F.array_distinct(F.array(tile(c, -1), tile(c, 0), tile(c, 1))))
    left = places.withColumns({"tx": tile("rx", 0), "ty": tile("ry", 0)})
    right = events.withColumn("tx", tiles("rx")).withColumn("ty", tiles("ry"))
    if side < TILE:
        right = right.join(left.select("tx", "ty").distinct(), ["tx", "ty"], "left_semi")
    parts = max(1, left.count() // PLACES)
    rid = events.schema["rid"].dataType.simpleString()

    def run(left, right):
        import pyarrow as pa

        right = right.sort_by("rid")  # so of equally near ones the first counts
        lx, ly, rx, ry = (t.column(c).to_numpy() for t in (left, right) for c in ("rx", "ry"))
        found, few = _blasts_of(lx, ly, rx, ry, right.column("is_day").to_numpy(), k, reach, days, ratio)
        few, kind, none = few if not last else few[:0], right.schema.field("rid").type, pa.nulls
        return pa.table({
            "rid": pa.concat_arrays([right.column("rid").take(pa.array(found)).combine_chunks(), none(len(few), kind)]),
            "rx": pa.concat_arrays([none(len(found), pa.float64()), pa.array(lx[few], pa.float64())]),
            "ry": pa.concat_arrays([none(len(found), pa.float64()), pa.array(ly[few], pa.float64())]),
        })

    left, right = (d.repartition(parts, "tx", "ty").groupBy("tx", "ty") for d in (left, right))
    return left.cogroup(right).applyInArrow(lambda a, b: run(a.drop_columns(["tx", "ty"]), b), f"rid {rid}, rx double, ry double")


def _blasts_of(lx, ly, rx, ry, is_day, k: int, reach: float, days: int, ratio: float):
    """Of events in order: which of them are daytime events of busy places, and which places have fewer than k within ``reach``."""
    import numpy as np

    cell = lambda x, y: (np.floor(x / reach).astype("int64"), np.floor(y / reach).astype("int64"))
    (cx, cy), (ex, ey) = cell(lx, ly), cell(rx, ry)
    order = np.lexsort((ex, ey))
    ex, ey = ex[order], ey[order]
    row, begin = np.unique(ey, return_index=True)
    rows = dict(zip(row.tolist(), zip(begin.tolist(), [*begin[1:].tolist(), len(ey)], strict=True), strict=True))
    by = np.lexsort((cx, cy))
    edges = np.flatnonzero(np.concatenate(([True], (cx[by][1:] != cx[by][:-1]) | (cy[by][1:] != cy[by][:-1]), [True]))) if len(by) else [0]
    blast, few = np.zeros(len(rx), bool), []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        x, y, near = int(cx[by[lo]]), int(cy[by[lo]]), []
        for at in (y - 1, y, y + 1):
            a, b = rows.get(at, (0, 0))
            near.append(order[a + np.searchsorted(ex[a:b], x - 1) : a + np.searchsorted(ex[a:b], x + 1, side="right")])
        near = np.sort(np.concatenate(near))
        if len(near) < k:
            few.append(by[lo:hi])
            continue
        nx, ny, day = rx[near], ry[near], is_day[near]
        step = max(1, MATRIX // len(near))
        for at in range(lo, hi, step):
            own = by[at : min(hi, at + step)]
            dx, dy = lx[own, None] - nx, ly[own, None] - ny
            d2 = dx * dx + dy * dy
            kth = np.partition(d2, k - 1, axis=1)[:, k - 1]
            done = kth <= reach * reach
            few.append(own[~done])
            d2, kth = d2[done], kth[done]
            chosen = d2 <= kth[:, None]
            for r in np.flatnonzero(chosen.sum(axis=1) > k):
                tied = np.flatnonzero(d2[r] == kth[r])
                chosen[r, tied[k - np.count_nonzero(d2[r] < kth[r]) :]] = False
            d = (chosen & day).sum(axis=1)
            busy = d * (24 - days) / (np.where(d == k, 0.00001, k - d) * days) > ratio
            blast[near[day & chosen[busy].any(axis=0)]] = True
    return np.flatnonzero(blast), np.concatenate(few) if few else np.zeros(0, "int64")
