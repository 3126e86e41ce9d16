"""Linear gridding on the Delaunay triangulation, one cell at a time and exact, without a triangulation in one place.

The triangle that holds a place is the best of a small linear programme: of all points,
the three around it whose circle holds no other. So each cell needs no neighbour's
triangle. It starts from the points of its tile and a border around, and what its circle
reaches beyond them is looked up in buckets; a point inside the circle takes a corner's
place, until the circle is empty. Cells of one triangle share one look-up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalite.session import ship, written

#: Cells along a tile and across its border; cells along a bucket of level 0; buckets along a circle that the raster cuts off, at most.
TILE, HALO, BUCKET, ACROSS = 32, 16, 2, 64
#: Distance of the three corners that stand for the outside, in widths of the raster; what counts as on the hull, in the same.
FAR, ON_HULL = 1e6, 3e-7
#: By so much of a cell the place looked for is beside the cell's centre, so that it's on no edge.
NUDGE = 1e-8, 0.618e-8
STATE = "row int, col int, px array<double>, py array<double>, pw array<double>, pz array<double>, value double, sure boolean"


class Cells:
    """The triangles of some cells while they improve: corners (m, 3) in units of the raster's width from its middle, NaN values for the outside."""

    def __init__(self, qx, qy, px, py, pw, pz):
        self.qx, self.qy = qx, qy
        self.px, self.py, self.pw, self.pz = px, py, pw, pz

    @classmethod
    def outside(cls, qx, qy):
        import numpy as np

        m, turn = len(qx), np.pi / 2 + np.arange(3) * 2 * np.pi / 3
        each = lambda v: np.tile(v, (m, 1))
        return cls(qx, qy, each(FAR * np.cos(turn)), each(FAR * np.sin(turn)), each(np.zeros(3)), each(np.full(3, np.nan)))

    def weights(self, x=None, y=None):
        """Barycentric weights of the cells' places, or of others, in their triangles."""
        import numpy as np

        x, y = (self.qx, self.qy) if x is None else (x, y)
        dx, dy = self.px - x[:, None], self.py - y[:, None]
        parts = np.stack([dx[:, i] * dy[:, j] - dy[:, i] * dx[:, j] for i, j in ((1, 2), (2, 0), (0, 1))], axis=1)
        return parts / parts.sum(axis=1, keepdims=True)

    def planes(self):
        """Of the planes through the corners' squared distances from the places: slopes and height at the place."""
        import numpy as np

        x, y = self.px - self.qx[:, None], self.py - self.qy[:, None]
        cost = x * x + y * y + self.pw
        k = np.argsort(cost, axis=1)  # from the nearest corner, for the outside's are far
        x, y, cost = (np.take_along_axis(v, k, axis=1) for v in (x, y, cost))
        ux, uy, vx, vy = x[:, 1] - x[:, 0], y[:, 1] - y[:, 0], x[:, 2] - x[:, 0], y[:, 2] - y[:, 0]
        s, t = cost[:, 1] - cost[:, 0], cost[:, 2] - cost[:, 0]
        det = ux * vy - uy * vx
        ax, ay = (s * vy - t * uy) / det, (t * ux - s * vx) / det
        return ax, ay, cost[:, 0] - ax * x[:, 0] - ay * y[:, 0]

    def enter(self, at, x, y, w, z):
        """New points for the cells ``at``, each in the corner's place that keeps the cell inside."""
        import numpy as np

        part = Cells(self.qx[at], self.qy[at], self.px[at], self.py[at], self.pw[at], self.pz[at])
        have, new = part.weights(), part.weights(x, y)
        with np.errstate(divide="ignore", invalid="ignore"):
            leaves = np.argmin(np.where(new > 0, np.maximum(have, 0) / new, np.inf), axis=1)
        for mine, theirs in ((self.px, x), (self.py, y), (self.pw, w), (self.pz, z)):
            mine[at, leaves] = theirs

    def improve(self, x, y, w, z, room: int = 2_000_000):
        """Triangles whose circles hold none of these points."""
        import numpy as np

        out = Cells.outside(self.qx[:1], self.qy[:1])
        x, y, w, z = (np.concatenate([a, b[0]]) for a, b in ((x, out.px), (y, out.py), (w, out.pw), (z, out.pz)))
        step = max(1, room // len(x))
        for first in range(0, len(self.qx), step):
            at = np.arange(first, min(first + step, len(self.qx)))
            self._improve(at, *[np.broadcast_to(v, (len(at), len(v))) for v in (x, y, w, z)])

    def improve_own(self, x, y, w, z):
        """Triangles whose circles hold none of the points of their own row (m, k); a NaN is none."""
        import numpy as np

        out = Cells.outside(self.qx, self.qy)
        self._improve(np.arange(len(self.qx)), *[np.concatenate([a, b], axis=1) for a, b in ((x, out.px), (y, out.py), (w, out.pw), (z, out.pz))])

    def _improve(self, at, x, y, w, z):
        import numpy as np

        own, dx, dy = np.arange(len(at)), x - self.qx[at, None], y - self.qy[at, None]
        cost = dx * dx + dy * dy + w
        while len(at):
            part = Cells(self.qx[at], self.qy[at], self.px[at], self.py[at], self.pw[at], self.pz[at])
            ax, ay, c = part.planes()
            inside = ax[:, None] * dx + ay[:, None] * dy + c[:, None] - cost
            k = np.argmax(np.where(np.isnan(inside), -np.inf, inside), axis=1)
            every = np.arange(len(at))
            size = np.abs(ax * dx[every, k]) + np.abs(ay * dy[every, k]) + np.abs(c) + cost[every, k]
            go = inside[every, k] > 1e-11 * size
            at, k, dx, dy, cost, own = at[go], k[go], dx[go], dy[go], cost[go], own[go]
            if len(at):
                self.enter(at, x[own, k], y[own, k], w[own, k], z[own, k])

    def ordered(self):
        """The corners in order of place, the outside's last, so that cells of a triangle name it alike."""
        import numpy as np

        k = np.lexsort((self.py, self.px, np.isnan(self.pz)), axis=1)
        take = lambda v: np.take_along_axis(v, k, axis=1)
        self.px, self.py, self.pw, self.pz = take(self.px), take(self.py), take(self.pw), take(self.pz)

    def values(self, step):
        """Values by the corners' weights at the cells' own centres; NaN outside the hull."""
        import numpy as np

        w, far = self.weights(self.qx - NUDGE[0] * step, self.qy - NUDGE[1] * step), np.isnan(self.pz)
        beyond = np.where(far, np.abs(w), 0).sum(axis=1) * FAR > ON_HULL
        w = np.where(far, 0, w)
        return np.where(beyond, np.nan, (w * np.nan_to_num(self.pz)).sum(axis=1) / w.sum(axis=1))

    def frame(self, row, col, sure, step):
        import pandas as pd

        lists = {n: pd.Series(list(v), dtype="object") for n, v in (("px", self.px), ("py", self.py), ("pw", self.pw), ("pz", self.pz))}
        return pd.DataFrame({"row": row, "col": col, **lists, "value": self.values(step), "sure": sure})


def _circle() -> tuple[Column, Column, Column]:
    """Middle and squared radius of the circle through px, py (with weights pw)."""
    p = lambda c, k: F.col(f"p{c}")[k]
    ux, uy, vx, vy = p("x", 1) - p("x", 0), p("y", 1) - p("y", 0), p("x", 2) - p("x", 0), p("y", 2) - p("y", 0)
    s, t = ux * ux + uy * uy + p("w", 1) - p("w", 0), vx * vx + vy * vy + p("w", 2) - p("w", 0)
    det = ux * vy - uy * vx
    a, b = F.try_divide(s * vy - t * uy, det) / 2, F.try_divide(t * ux - s * vx, det) / 2
    return p("x", 0) + a, p("y", 0) + b, a * a + b * b + p("w", 0)


def linear_grid(points: DataFrame, dxy: float, blank: float | None = None, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Values between points, linear on their Delaunay triangles: row, col (from the least y and x, cell centres there and every ``dxy``), value.

    Cells outside the points' hull have no row (within some millionths of the raster's width of it they may have one or not), nor with ``blank`` (up to 16) those
    farther than so many cells from a cell with a point. Points with a null or NaN are
    left out, of equal places the least value counts. Where four points and more lie on
    one circle, a hash of their places chooses the triangles, the same in each run. No
    points, no rows. Points on one line give the cells on it. Any number of points may share a
    cell: a task holds at most four of each, and looks the others up.
    """
    if blank is not None and blank > HALO:
        raise ValueError(f"blank is no more than {HALO} cells")
    ship(points.sparkSession)
    known = points.select(*[F.col(c).cast("double").alias(n) for c, n in ((x, "x"), (y, "y"), (z, "z"))])
    known = known.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz"))
    known = written(known.groupBy("x", "y").agg(F.min("z").alias("z")), "triangles-points")
    r = known.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    if not r[4]:
        return known.select(F.lit(0).alias("row"), F.lit(0).alias("col"), F.col("z").alias("value"))
    x0, y0 = r[0], r[2]
    cols, rows = math.floor((r[1] - x0) / dxy + 0.5) + 1, math.floor((r[3] - y0) / dxy + 0.5) + 1
    unit = max(r[1] - x0, r[3] - y0, dxy)
    mx, my = (r[0] + r[1]) / 2, (r[2] + r[3]) / 2
    step = dxy / unit
    tie = 1e-7 * max(step * step, (r[1] - x0) * (r[3] - y0) / unit / unit / r[4])
    place = lambda c, at: F.floor((F.col(c) - at) / dxy + 0.5).cast("int")
    placed = known.select(
        place("y", y0).alias("row"), place("x", x0).alias("col"), ((F.col("x") - mx) / unit).alias("x"), ((F.col("y") - my) / unit).alias("y"), "z",
        (F.pmod(F.xxhash64("x", "y"), F.lit(1 << 20)) * (tie / (1 << 20))).alias("w"),
    )
    placed = written(placed, "triangles-placed")
    turns = [k * math.pi / 8 for k in range(16)]
    ends = placed.agg(*[F.max_by(F.struct("x", "y", "w", "z"), F.col("x") * math.cos(t) + F.col("y") * math.sin(t)).alias(f"e{k}") for k, t in enumerate(turns)]).first()
    ends = sorted({tuple(e) for e in ends})
    at = lambda row, col: ((x0 + col * dxy - mx) / unit + NUDGE[0] * step, (y0 + row * dxy - my) / unit + NUDGE[1] * step)

    cy, cx = (F.col("row") * dxy + y0 - my) / unit, (F.col("col") * dxy + x0 - mx) / unit
    away = (F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy)
    quartered = placed.withColumns({"left": F.col("x") < cx, "below": F.col("y") < cy, "away": away})
    # the least distances first, as numbers, which are hashed: aggregates of structs would sort all points
    near = written(quartered.groupBy("row", "col", "left", "below").agg(F.min("away").alias("away"), F.count(F.lit(1)).alias("n")), "triangles-near")
    quarters = quartered.join(near, ["row", "col", "left", "below", "away"]).groupBy("row", "col", "left", "below", "n").agg(F.min(F.struct("x", "y", "w", "z")).alias("p"))
    finest = -math.floor(math.log(BUCKET * math.sqrt(near.agg(F.max("n")).first()[0]), 4))
    tiles = lambda c: F.sequence(F.floor((F.col(c) - HALO) / TILE).cast("int"), F.floor((F.col(c) + HALO) / TILE).cast("int"))
    sent = quarters.select("row", "col", "p.x", "p.y", "p.w", "p.z", "n", tiles("row").alias("rs"), tiles("col").alias("cs"))
    sent = sent.select("row", "col", "x", "y", "w", "z", "n", "cs", F.explode("rs").alias("br")).select("row", "col", "x", "y", "w", "z", "n", "br", F.explode("cs").alias("bc"))
    nr, nc = -(-rows // TILE), -(-cols // TILE)
    every = points.sparkSession.range(nr * nc).select(F.floor(F.col("id") / nc).cast("int").alias("br"), (F.col("id") % nc).cast("int").alias("bc"))

    def solve(key, tile, near):
        import numpy as np

        if not len(tile):  # a border beyond the raster
            return Cells.outside(np.zeros(0), np.zeros(0)).frame(np.zeros(0, "int32"), np.zeros(0, "int32"), np.zeros(0, bool), step)
        r0, c0, wide = int(key[0]) * TILE, int(key[1]) * TILE, TILE + 2 * HALO
        row, col = (v.ravel() for v in np.meshgrid(np.arange(r0, min(r0 + TILE, rows)), np.arange(c0, min(c0 + TILE, cols)), indexing="ij"))
        nr_, nc_ = near["row"].to_numpy() - r0 + HALO, near["col"].to_numpy() - c0 + HALO
        inside = (nr_ >= 0) & (nr_ < wide) & (nc_ >= 0) & (nc_ < wide)
        if blank is not None:
            has, close = np.zeros((wide, wide), bool), np.zeros((TILE, TILE), bool)
            has[nr_[inside], nc_[inside]] = True
            for i in range(-int(blank), int(blank) + 1):
                for j in range(-int(blank), int(blank) + 1):
                    if i * i + j * j <= blank * blank:
                        close |= has[HALO + i : HALO + i + TILE, HALO + j : HALO + j + TILE]
            keep = close[row - r0, col - c0]
            row, col = row[keep], col[keep]
        qx, qy = at(row, col)
        cells = Cells.outside(qx, qy)
        more = np.array(ends)
        cells.improve(*[np.concatenate([near[c].to_numpy(dtype="float64"), more[:, k]]) for k, c in enumerate(("x", "y", "w", "z"))])
        cells.ordered()
        ax, ay, c = cells.planes()
        radius = np.sqrt(np.maximum(c + (ax * ax + ay * ay) / 4, 0)) * (1 + 1e-9)
        span = lambda mid, start, last: (np.clip(np.floor((mid - radius - start) / step + 0.5), 0, last), np.clip(np.floor((mid + radius - start) / step + 0.5), 0, last))
        left, right = (v - c0 + HALO for v in span(ax / 2 + qx, (x0 - mx) / unit, cols - 1))
        low, high = (v - r0 + HALO for v in span(ay / 2 + qy, (y0 - my) / unit, rows - 1))
        sure = (left >= 0) & (right < wide) & (low >= 0) & (high < wide)
        held = np.zeros((wide + 1, wide + 1))
        np.add.at(held, (nr_[inside] + 1, nc_[inside] + 1), near["n"].to_numpy()[inside] > 1)
        held = held.cumsum(axis=0).cumsum(axis=1)
        a, b, l_, r_ = (np.where(sure, v, 0).astype(int) for v in (low, high, left, right))
        sure &= held[b + 1, r_ + 1] - held[a, r_ + 1] - held[b + 1, l_] + held[a, l_] == 0
        return cells.frame(row, col, sure, step)

    state = written(every.groupBy("br", "bc").cogroup(sent.groupBy("br", "bc")).applyInPandas(solve, STATE), "triangles-state")
    done = [state.where("sure")]

    def improve(frames):
        import numpy as np

        for pdf in frames:
            if len(pdf):
                row, col = pdf["row"].to_numpy(), pdf["col"].to_numpy()
                cells = Cells(*at(row, col), *[np.stack(pdf[c].to_list()).astype("float64") for c in ("px", "py", "pw", "pz")])
                was, held = cells.planes()[2], [v.copy() for v in (cells.px, cells.py, cells.pw, cells.pz)]
                most = max(map(len, pdf["vx"]))
                new = [np.stack([np.pad(v.astype("float64"), (0, most - len(v)), constant_values=np.nan) for v in pdf[f"v{c}"]]) for c in "xywz"]
                cells.enter(np.arange(len(pdf)), *[v[:, 0] for v in new])
                cells.improve_own(*[np.concatenate([v, h], axis=1) for v, h in zip(new, held, strict=True)])  # corners that left, and the outside's, may come back
                still = ~(cells.planes()[2] < was)  # each step lowers the plane; a point that doesn't is on the circle but for rounding
                for v, h in zip((cells.px, cells.py, cells.pw, cells.pz), held, strict=True):
                    v[still] = h[still]
                cells.ordered()
                yield cells.frame(row, col, still, step)

    left = state.where("NOT sure")
    while left.limit(1).count():
        found = written(_conflicts(left, placed, step, (x0 - mx) / unit, (y0 - my) / unit, rows, cols, finest), "triangles-conflicts")
        names = ["px", "py"]
        done.append(left.join(found, names, "left_anti"))
        moved = written(left.join(found, names).mapInPandas(improve, STATE), "triangles-state")
        done.append(moved.where("sure"))
        left = moved.where("NOT sure")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.where("value IS NOT NULL AND NOT isnan(value)").select("row", "col", "value")


def _conflicts(cells: DataFrame, placed: DataFrame, step: float, left: float, low: float, rows: int, cols: int, finest: int) -> DataFrame:
    """Of the cells' triangles whose circle holds points those deepest inside, one of each bucket, the deepest first: px, py, vx, vy, vw, vz.

    A circle goes to the buckets it touches, of a size of which it covers few, down to level
    ``finest``, where points are few in a bucket; of one size there are the points of all. How
    deep the deepest are comes first, as numbers, and then the points: no task sorts or holds
    the points in a circle, of which there may be any number.
    """
    mx, my, rr = _circle()
    round_ = cells.select("px", "py", "pw").distinct().withColumns({"mx": mx, "my": my, "rr": rr}).where("rr IS NOT NULL")
    along = lambda v, start, last: F.greatest(F.least((v - start) / step, F.lit(last + 0.5)), F.lit(-0.5)) + 0.5
    radius = F.sqrt(F.greatest("rr", F.lit(0.0))) * (1 + 1e-9)
    round_ = round_.withColumn("radius", radius).withColumns({"bottom": along(F.col("my") - F.col("radius"), low, rows - 1), "top": along(F.col("my") + F.col("radius"), low, rows - 1)})
    tall, wide = F.col("top") - F.col("bottom"), along(F.col("mx") + F.col("radius"), left, cols - 1) - along(F.col("mx") - F.col("radius"), left, cols - 1)
    longest, whole = F.greatest(tall, wide), F.least(tall, wide) * step > 1.99 * F.col("radius")
    across = F.when(whole, F.lit(2.0)).when(F.col("radius") <= 4 * longest * step, F.lit(max(ACROSS / 4, 2.0))).otherwise(F.lit(float(ACROSS)))
    level = F.greatest(F.coalesce(F.ceil(F.log(longest / across / BUCKET) / math.log(4)), F.lit(finest)), F.lit(finest)).cast("int")
    round_ = written(round_.withColumn("level", level).withColumn("id", F.monotonically_increasing_id()), "triangles-circles")
    levels = sorted(r[0] for r in round_.select("level").distinct().collect())  # one for each fourfold size

    sides = {k: BUCKET * 4.0**k for k in levels}
    bucket = lambda c: F.floor(c / F.col("side")).cast("long")
    corners = [F.col(f"p{c}")[k].alias(f"{c}{k}") for c in "xy" for k in range(3)]
    at = lambda n: low + (n * F.col("side") - 0.5) * step
    apart = F.least(F.greatest("my", at(F.col("br"))), at(F.col("br") + 1)) - F.col("my")
    half = F.sqrt(F.greatest(F.col("rr") * (1 + 1e-9) - apart * apart, F.lit(0.0))) + F.col("side") * (step / 8)
    sized = F.array(*[F.struct(F.lit(k).alias("level"), F.lit(v).alias("side")) for k, v in (sides or {0: 1.0}).items()])
    flat = round_.join(F.broadcast(placed.sparkSession.range(1).select(F.inline(sized))), "level").select("id", "mx", "my", "rr", "level", "side", "bottom", "top", *corners)
    rowed = flat.withColumn("br", F.explode(F.sequence(bucket(F.col("bottom")), bucket(F.col("top"))))).drop("bottom", "top")
    sent = rowed.withColumn("bc", F.explode(F.sequence(bucket(along(F.col("mx") - half, left, cols - 1)), bucket(along(F.col("mx") + half, left, cols - 1))))).drop("side")
    each = placed.select("x", "y", "w", "z", along(F.col("y"), low, rows - 1).alias("v"), along(F.col("x"), left, cols - 1).alias("u"), F.inline(sized))
    each = each.select("x", "y", "w", "z", "level", bucket(F.col("v")).alias("br"), bucket(F.col("u")).alias("bc"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    square = dx * dx + dy * dy
    own = " OR ".join(f"(x = x{k} AND y = y{k})" for k in range(3))
    place, circle = ["id", "level", "br", "bc"], ["mx", "my", "rr", *[f"{c}{k}" for c in "xy" for k in range(3)]]

    def met(sent: DataFrame) -> DataFrame:
        return sent.join(each, ["level", "br", "bc"]).withColumn("deep", F.col("rr") - square - F.col("w")).where((F.col("deep") > 1e-11 * (F.col("rr") + square)) & ~F.expr(own))

    most = met(sent).groupBy(*place).agg(F.max("deep").alias("most"))
    deepest = written(most.join(flat.select("id", *circle), "id"), "triangles-deepest")
    best = met(deepest).where("deep = most").groupBy(*place).agg(F.max(F.struct("deep", "x", "y", "w", "z")).alias("v"))
    best = best.groupBy("id").agg(F.sort_array(F.collect_list("v"), asc=False).alias("v"))  # one of a bucket
    return best.join(round_, "id").select("px", "py", *[F.col(f"v.{c}").alias(f"v{c}") for c in "xywz"])


def filled(cells: DataFrame) -> DataFrame:
    """The raster (row, col, value) with each cell without a value (null or NaN) given one between the known cells; outside their hull it stays null."""
    known = cells.where("value IS NOT NULL AND NOT isnan(value)").select(F.col("col").alias("x"), F.col("row").alias("y"), F.col("value").alias("z"))
    start = known.agg(F.min("x"), F.min("y")).first()
    if start[0] is None:
        return cells
    between = linear_grid(known, 1.0).select((F.col("row") + start[1]).cast("int").alias("row"), (F.col("col") + start[0]).cast("int").alias("col"), F.col("value").alias("_between"))
    gap = cells.where("value IS NULL OR isnan(value)").drop("value").join(between, ["row", "col"], "left").withColumnRenamed("_between", "value")
    return cells.where("value IS NOT NULL AND NOT isnan(value)").unionByName(gap)
