"""Contours of rasters by marching squares, joined into lines and rings; depths from the contours of the tilt angle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalite.session import written

from .blocks import to_blocks, with_borders
from .components import chain_places

#: Cells along a block.
SIZE = 256
#: Bits of a row or column in the name of a grid edge.
BITS = 28


def segments(cells: DataFrame, levels: Sequence[float], size: int = SIZE) -> DataFrame:
    """A segment for each crossing of a level through a square of four neighbouring cells: level, row, col (of the square), x1, y1, x2, y2, start, stop, id.

    x and y count columns and rows. A value equal to the level is below it. Where both
    pairs of opposite corners differ, the mean of the four tells which are joined. Going
    along a segment, what is above lies to one side throughout, so ``stop`` of one
    segment (the name of the grid edge it ends on) is ``start`` of the next. Squares with
    a missing or null cell have none; an empty raster gives no rows.
    """
    if len(levels) > 60:
        raise ValueError("no more than 60 levels at once")
    low = cells.agg(F.min("row"), F.min("col")).first()
    r0, c0 = (low[0] or 0, low[1] or 0)
    moved = cells.select((F.col("row") - r0).alias("row"), (F.col("col") - c0).alias("col"), "value")

    def step(br, bc, window):
        import numpy as np

        w = window[0, 1:, 1:]
        z = np.stack([w[:-1, :-1], w[:-1, 1:], w[1:, 1:], w[1:, :-1]])  # corners clockwise
        known = ~np.isnan(z).any(axis=0)
        corner = np.array([(0, 0), (0, 1), (1, 1), (1, 0)])
        # of each side: the corner its name comes from, and its direction (0 along the row)
        named = [((0, 0), 0), ((0, 1), 1), ((1, 0), 0), ((0, 0), 1)]
        for n, level in enumerate(levels):
            above = z > level
            after = np.roll(above, -1, axis=0)
            leave, enter = above & ~after & known, ~above & after & known
            saddle = leave.sum(axis=0) == 2
            middle = z.mean(axis=0) > level
            for i in range(4):
                for j in range(4):
                    if i == j:
                        continue
                    both = leave[i] & enter[j] & (~saddle | (middle if (j - i) % 4 == 1 else ~middle if (i - j) % 4 == 1 else False))
                    r, c = np.nonzero(both)
                    if not len(r):
                        continue
                    ends = []
                    for side in (i, j):
                        p, q = z[side, r, c], z[(side + 1) % 4, r, c]
                        f = (level - p) / (q - p)
                        a, b = corner[side], corner[(side + 1) % 4]
                        (dr, dc), way = named[side]
                        name = (((n << BITS) | (br * size + r + dr)) << BITS | (bc * size + c + dc)) << 1 | way
                        ends.append((bc * size + c + a[1] + f * (b[1] - a[1]), br * size + r + a[0] + f * (b[0] - a[0]), name))
                    for k in range(len(r)):
                        yield float(level), int(br * size + r[k] + r0), int(bc * size + c[k] + c0), float(ends[0][0][k] + c0), float(ends[0][1][k] + r0), float(ends[1][0][k] + c0), float(ends[1][1][k] + r0), int(ends[0][2][k]), int(ends[1][2][k])

    schema = "level double, row int, col int, x1 double, y1 double, x2 double, y2 double, start long, stop long"
    return with_borders(to_blocks(moved, size), size, 1, step, schema).withColumn("id", F.col("start"))


def contour_lines(cells: DataFrame, levels: Sequence[float], size: int = SIZE) -> DataFrame:
    """The segments in order: level, line, place, ring, x1, y1, x2, y2. A line's name is unique over all levels; rings are closed."""
    found = written(segments(cells, levels, size), "contour-segments")
    ahead = found.select(F.col("start").alias("stop"), F.col("id").alias("next"))
    links = found.select(F.col("id").alias("node"), "stop").join(ahead, "stop", "left").select("node", "next")
    placed = chain_places(links)
    return found.join(placed, found["id"] == placed["node"]).select("level", F.col("chain").alias("line"), "place", "ring", "x1", "y1", "x2", "y2")


def contour_polygons(cells: DataFrame, levels: Sequence[float], size: int = SIZE) -> DataFrame:
    """Closed contours as polygons: level, line, ring (array of x, y, the first point again at the end). Lines that leave the raster are none."""
    lines = contour_lines(cells, levels, size).where("ring")
    points = lines.groupBy("level", "line").agg(F.array_sort(F.collect_list(F.struct("place", F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p"))
    ring = F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return points.select("level", "line", F.concat(ring, F.slice(ring, 1, 1)).alias("ring"))


def _turned(degrees):
    """A direction without its sense, from -90 to 90 degrees."""
    return F.when(degrees > 90, degrees - 180).when(degrees < -90, degrees + 180).otherwise(degrees)


def tilt_depths(tilt: DataFrame, dx: float = 1.0, x0: float = 0.0, y0: float = 0.0, dy: float | None = None, angle: float = 10.0, size: int = SIZE) -> DataFrame:
    """Depths to sources from the tilt angle (row, col, value in radians; the raster's left upper corner at x0, y0): x, y, line, depth.

    At the middle of each segment of the zero contour, the nearest middles of the
    contours of 45 and -45 degrees are looked for. Where both lie within ``angle`` degrees
    of the contour's normal, the depth is the smaller distance.
    """
    from .joining import nearest

    dy = dy or dx
    degrees = tilt.select("row", "col", F.degrees("value").alias("value"))
    found = written(contour_lines(degrees, [0.0, 45.0, -45.0], size), "tilt-contours")
    x, y = (lambda c: x0 + (F.col(c) + 0.5) * dx), (lambda c: y0 - (F.col(c) + 0.5) * dy)
    middles = found.select("level", "line", "place", ((x("x1") + x("x2")) / 2).alias("x"), ((y("y1") + y("y2")) / 2).alias("y"), F.degrees(F.atan2(y("y2") - y("y1"), x("x2") - x("x1"))).alias("way"))
    middles = written(middles.withColumn("id", F.monotonically_increasing_id()), "tilt-middles")
    zero = middles.where("level = 0")
    out = zero.select("id", "x", "y", "line", _turned(F.col("way")).alias("way"))
    for name, level in (("up", 45.0), ("down", -45.0)):
        right = middles.where(F.col("level") == level).select(F.col("id").alias("rid"), F.col("x").alias("rx"), F.col("y").alias("ry"))
        near = nearest(zero.select(F.col("id").alias("lid"), F.col("x").alias("lx"), F.col("y").alias("ly")), right, 4 * dx)
        ends = near.join(right, "rid").select(F.col("lid").alias("id"), F.col("rx").alias(f"{name}_x"), F.col("ry").alias(f"{name}_y"), F.sqrt("d2").alias(f"{name}_d"))
        to = _turned(F.degrees(F.atan2(F.col(f"{name}_y") - F.col("y"), F.col(f"{name}_x") - F.col("x"))))
        out = out.join(ends, "id").where(F.abs(90 - F.abs(to - F.col("way"))) <= angle)
    return out.select("x", "y", "line", F.least("up_d", "down_d").alias("depth"))
