"""Minimum curvature gridding: the surface through the data cells whose summed squared curvature is least.

The curvature of a cell is the sum of its second differences along its row and its
column; on the raster's edge that along the edge, in a corner none. Setting the
derivatives of the sum to zero gives Briggs' 13-point equation inside and his boundary
equations near the edges, without a case for each.

The raster is a table of blocks. A coarse raster that fits in one block is solved first;
each finer one starts from the coarser one and is solved in rounds: every block with a
border of its neighbours by conjugate gradients, all at once, until no cell moves.
A round sends each block and its border once.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalite.session import written

from .blocks import to_cells, with_borders

#: Cells along a block and across a border of one.
SIZE, BORDER = 256, 32


class Curvature:
    """The quadratic form of a window of a raster: cells at ``row``, ``col`` and on, of a raster of ``rows`` by ``cols``."""

    def __init__(self, row: int, col: int, shape: tuple[int, int], rows: int, cols: int):
        import numpy as np

        r, c = np.arange(row, row + shape[0])[:, None], np.arange(col, col + shape[1])[None, :]
        inner = lambda n: np.minimum(np.arange(n) > 0, np.arange(n) < n - 1)
        self.inside = (r >= 0) & (r < rows) & (c >= 0) & (c < cols)
        self.along_r = self.inside & (r > 0) & (r < rows - 1) & inner(shape[0])[:, None]
        self.along_c = self.inside & (c > 0) & (c < cols - 1) & inner(shape[1])[None, :]
        # cells whose equation is whole in this window: two cells from its border, or beside the raster's edge
        whole = lambda at, n, total: ((at - at.flat[0] >= 2) | (at < 2)) & ((at.flat[-1] - at >= 2) | (at >= total - 2))
        self.known = self.inside & whole(r, shape[0], rows) & whole(c, shape[1], cols)
        self.diagonal = np.maximum(self._diagonal(), 1.0)

    def _diagonal(self):
        import numpy as np

        out = (2.0 * self.along_r + 2.0 * self.along_c) ** 2
        r, c = self.along_r.astype("float64"), self.along_c.astype("float64")
        out[1:] += r[:-1]
        out[:-1] += r[1:]
        out[:, 1:] += c[:, :-1]
        out[:, :-1] += c[:, 1:]
        return np.asarray(out)

    def slope(self, u):
        """Half the derivative of the summed squared curvature by each cell."""
        import numpy as np

        c = np.zeros_like(u)
        c[1:-1] += np.where(self.along_r[1:-1], u[:-2] + u[2:] - 2 * u[1:-1], 0)
        c[:, 1:-1] += np.where(self.along_c[:, 1:-1], u[:, :-2] + u[:, 2:] - 2 * u[:, 1:-1], 0)
        out = np.zeros_like(u)
        for on, axis in ((self.along_r, 0), (self.along_c, 1)):
            part, o = np.where(on, c, 0), np.swapaxes(out, 0, axis)
            p = np.swapaxes(part, 0, axis)
            o -= 2 * p
            o[:-1] += p[1:]
            o[1:] += p[:-1]
        return out


def solved(u, free, form: Curvature, tolerance: float, steps: int):
    """``u`` with its free cells moved to the least curvature: conjugate gradients, scaled by the diagonal."""
    import numpy as np

    u = np.where(form.inside, np.nan_to_num(u), 0.0)
    free = free & form.known
    if not free.any():
        return u
    left = np.where(free, -form.slope(u), 0)
    ahead = way = left / form.diagonal
    size = (left * ahead).sum()
    goal = max(size * 1e-28, (tolerance * tolerance) * free.sum() * 1e-6)
    for _ in range(steps):
        if size <= goal:
            break
        turned = np.where(free, form.slope(way), 0)
        far = size / max((way * turned).sum(), 1e-300)
        u = u + far * way
        left = left - far * turned
        ahead = left / form.diagonal
        size, before = (left * ahead).sum(), size
        way = ahead + (size / before) * way
    return u


def data_cells(points: DataFrame, dxy: float, extent: tuple[float, float, float, float] | None = None, buffer: int = 3, x: str = "x", y: str = "y", z: str = "z") -> tuple[DataFrame, dict]:
    """Of each cell with points the value of the one nearest to its centre (the least of equally near ones): row, col, value; and the raster's place and size.

    Cell centres start at the least x and y, or the extent's (left, right, bottom, top);
    ``buffer`` cells are put around.
    """
    known = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(z).cast("double").alias("z"))
    known = known.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in "xyz"))
    if extent is None:
        r = known.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        if r[0] is None:
            return known.select(F.lit(0).alias("row"), F.lit(0).alias("col"), F.col("z").alias("value")), {"rows": 0, "cols": 0}
        extent = tuple(r)
    left, right, bottom, top = extent
    x0, y0 = left - buffer * dxy, bottom - buffer * dxy
    shape = {"x0": x0, "y0": y0, "cols": math.floor((right + buffer * dxy - x0) / dxy + 0.5) + 1, "rows": math.floor((top + buffer * dxy - y0) / dxy + 0.5) + 1}
    place = lambda c, at: F.floor((F.col(c) - at) / dxy + 0.5)
    p = known.withColumns({"row": place("y", y0).cast("int"), "col": place("x", x0).cast("int")})
    p = p.where(F.col("row").between(0, shape["rows"] - 1) & F.col("col").between(0, shape["cols"] - 1))
    away = F.pow(F.col("x") - (F.lit(x0) + F.col("col") * dxy), 2) + F.pow(F.col("y") - (F.lit(y0) + F.col("row") * dxy), 2)
    return p.groupBy("row", "col").agg(F.min(F.struct(away.alias("away"), F.col("z").alias("z")))["z"].alias("value")), shape


def _laid_out(fixed: DataFrame, size: int, rows: int, cols: int) -> DataFrame:
    """Every block of the raster, as (br, bc, data) with the data cells' values, NaN elsewhere; blocks without data too."""
    spark = fixed.sparkSession
    nr, nc = math.ceil(rows / size), math.ceil(cols / size)
    every = spark.range(nr * nc).select(F.floor(F.col("id") / nc).cast("int").alias("br"), (F.col("id") % nc).cast("int").alias("bc"))
    held = fixed.select(F.floor(F.col("row") / size).cast("int").alias("br"), F.floor(F.col("col") / size).cast("int").alias("bc"), (F.pmod("row", F.lit(size)) * size + F.pmod("col", F.lit(size))).cast("int").alias("at"), "value")
    held = held.groupBy("br", "bc").agg(F.collect_list(F.struct("at", "value")).alias("cells"))

    def run(frames):
        import numpy as np
        import pandas as pd

        for pdf in frames:
            out = []
            for br, bc, cells in pdf[["br", "bc", "cells"]].itertuples(index=False):
                data = np.full(size * size, np.nan)
                for c in cells if cells is not None else ():
                    data[c["at"]] = c["value"]
                out.append((br, bc, data.tobytes()))
            yield pd.DataFrame(out, columns=["br", "bc", "data"])

    return every.join(held, ["br", "bc"], "left").mapInPandas(run, "br int, bc int, data binary")


def minimum_curvature(points: DataFrame, dxy: float, extent: tuple[float, float, float, float] | None = None, blank: float | None = None, buffer: int = 3, tolerance: float = 1e-4, rounds: int = 30, steps: int = 4000, size: int = SIZE, border: int = BORDER, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """The surface of least curvature through the points: row, col (from the first cell with data, upwards and to the right), value.

    A cell with points keeps the value of the one nearest to its centre. Rounds end when
    no cell moves by more than ``tolerance`` times the range of the data. With ``blank``,
    only cells within so many cells of one with points remain. Points with a null or NaN
    are left out; points of equal places count once (the least value); no points give no
    rows. One point gives a level surface.
    """
    fixed, shape = data_cells(points, dxy, extent, buffer, x, y, z)
    rows, cols = shape["rows"], shape["cols"]
    fixed = written(fixed, "curvature-data")
    limits = fixed.agg(F.min("value"), F.max("value")).first()
    if limits[0] is None:
        return fixed.where("false").select("row", "col", "value")
    moves = tolerance * (limits[1] - limits[0] or 1.0)
    level = 0
    while max(rows, cols) > size << level:
        level += 1

    surface = None
    for k in range(level, -1, -1):
        r, c = -(-rows // (1 << k)), -(-cols // (1 << k))
        at_level = fixed.groupBy(F.floor(F.col("row") / (1 << k)).cast("int").alias("row"), F.floor(F.col("col") / (1 << k)).cast("int").alias("col")).agg(F.avg("value").alias("value"))
        data = _laid_out(at_level, size, r, c)
        surface = _start(data, size, limits) if surface is None else _finer(surface, data, size, r, c)
        surface = written(surface, "curvature-start")
        alone = max(r, c) <= size
        for _ in range(rounds):
            surface = written(_round(surface, size, border, r, c, moves, steps), "curvature-round")
            if alone or (surface.agg(F.max("moved")).first()[0] or 0.0) <= moves:
                break
    if blank is None:
        return _trimmed(to_cells(surface.select("br", "bc", _plane(0, size).alias("data")), size), rows, cols, buffer)
    return _trimmed(to_cells(_blanked(surface, size, blank), size), rows, cols, buffer)


def _plane(k: int, size: int):
    return F.substring("data", 8 * size * size * k + 1, 8 * size * size)


def _start(data: DataFrame, size: int, limits) -> DataFrame:
    """Two planes, surface and data, the surface level between the limits."""

    def run(frames):
        import numpy as np

        for pdf in frames:
            pdf = pdf.copy()
            pdf["data"] = [np.where(np.isnan(d := np.frombuffer(x)), (limits[0] + limits[1]) / 2, d).tobytes() + x for x in pdf["data"]]
            yield pdf

    return data.mapInPandas(run, "br int, bc int, data binary")


def _finer(coarse: DataFrame, data: DataFrame, size: int, rows: int, cols: int) -> DataFrame:
    """The surface of a raster of half the cell size, linear between the coarser one's centres, with the data cells put in."""

    def step(br, bc, window):
        import numpy as np

        w = window[0]
        for axis in (0, 1):  # beyond the raster's edge its last cells
            w = np.swapaxes(w, 0, axis)
            ok = np.flatnonzero(~np.isnan(w).all(axis=1))
            w = w[np.clip(np.arange(len(w)), ok[0], ok[-1])] if len(ok) else w
            w = np.swapaxes(w, 0, axis)
        at = (np.arange(2 * size) + 0.5) / 2 - 0.5 + 1  # centres of fine cells in the window's cells
        lo = np.floor(at).astype(int)
        f = at - lo
        fine = w[lo] * (1 - f)[:, None] + w[lo + 1] * f[:, None]
        fine = fine[:, lo] * (1 - f)[None, :] + fine[:, lo + 1] * f[None, :]
        for i in (0, 1):
            for j in (0, 1):
                r, c = 2 * br + i, 2 * bc + j
                if r * size < rows and c * size < cols:
                    yield r, c, np.ascontiguousarray(fine[i * size : (i + 1) * size, j * size : (j + 1) * size]).tobytes()

    spread = with_borders(coarse.select("br", "bc", "data"), size, 1, step, "br int, bc int, data binary", planes=2)

    def run(frames):
        import numpy as np

        for pdf in frames:
            out = pdf[["br", "bc"]].copy()
            out["data"] = [np.where(np.isnan(d := np.frombuffer(x)), np.frombuffer(s), d).tobytes() + x for s, x in zip(pdf["surface"], pdf["data"], strict=True)]
            yield out

    return spread.withColumnRenamed("data", "surface").join(data, ["br", "bc"]).mapInPandas(run, "br int, bc int, data binary")


def _round(surface: DataFrame, size: int, border: int, rows: int, cols: int, moves: float, steps: int) -> DataFrame:
    def step(br, bc, window):
        import numpy as np

        u, data = window
        form = Curvature(br * size - border, bc * size - border, u.shape, rows, cols)
        new = solved(u, np.isnan(data), form, moves, steps)
        own = (slice(border, border + size),) * 2
        inside = form.inside[own]
        new = np.where(inside, new[own], np.nan)
        moved = float(np.abs(new - u[own])[inside].max()) if inside.any() else 0.0
        yield br, bc, new.tobytes() + np.ascontiguousarray(data[own]).tobytes(), moved

    return with_borders(surface.select("br", "bc", "data"), size, border, step, "br int, bc int, data binary, moved double", planes=2)


def _blanked(surface: DataFrame, size: int, blank: float) -> DataFrame:
    """The surface where a data cell is within ``blank`` cells."""
    reach = max(1, math.floor(blank))
    if reach > size:
        raise ValueError("blank is no more than a block")

    def step(br, bc, window):
        import numpy as np

        known = ~np.isnan(window[1])
        near = np.zeros((size, size), bool)
        for i in range(-reach, reach + 1):
            for j in range(-reach, reach + 1):
                if i * i + j * j <= blank * blank:
                    near |= known[reach + i : reach + i + size, reach + j : reach + j + size]
        yield br, bc, np.where(near, window[0][reach : reach + size, reach : reach + size], np.nan).tobytes()

    return with_borders(surface.select("br", "bc", "data"), size, reach, step, "br int, bc int, data binary", planes=2)


def _trimmed(cells: DataFrame, rows: int, cols: int, buffer: int) -> DataFrame:
    inside = F.col("row").between(buffer, rows - 1 - buffer) & F.col("col").between(buffer, cols - 1 - buffer)
    return cells.where(inside).select((F.col("row") - buffer).alias("row"), (F.col("col") - buffer).alias("col"), "value")
