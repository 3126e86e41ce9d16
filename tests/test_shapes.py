"""Isosurfaces, polygons on rasters, projections, resampling."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalite.functions import projections
from stratalite.operators import polygons, resample, surfaces


def voxels_of(spark, v, low=(0, 0, 0)):
    return spark.createDataFrame([(i + low[0], j + low[1], k + low[2], None if np.isnan(x) else float(x)) for (i, j, k), x in np.ndenumerate(v)], "i int, j int, k int, value double")


def ball(n, r):
    g = np.arange(n) - (n - 1) / 2
    return r - np.sqrt(g[:, None, None] ** 2 + g[None, :, None] ** 2 + g[None, None, :] ** 2)


def closed(rows):
    """Each side of a triangle is another's, turned round."""
    sides = Counter((a, b) for t in rows for a, b in ((t.v1, t.v2), (t.v2, t.v3), (t.v3, t.v1)))
    return all(sides[b, a] == n for (a, b), n in sides.items())


def euler(rows):
    points = {v for t in rows for v in (t.v1, t.v2, t.v3)}
    sides = {frozenset(s) for t in rows for s in ((t.v1, t.v2), (t.v2, t.v3), (t.v3, t.v1))}
    return len(points) - len(sides) + len(rows)


@pytest.mark.parametrize("size", [5, 32])
def test_ball(spark, size):
    """One closed surface of Euler number 2 that holds a ball's volume, the same by any blocks; normals point outwards."""
    found = surfaces.isosurface(voxels_of(spark, ball(16, 5.3), (3, -2, 7)), 0.0, size=size)
    rows = found.collect()
    assert closed(rows) and euler(rows) == 2
    p = np.array([[[t.x1, t.y1, t.z1], [t.x2, t.y2, t.z2], [t.x3, t.y3, t.z3]] for t in rows]) - [10.5, 5.5, 14.5]
    volume = np.einsum("ni,ni->n", p[:, 0], np.cross(p[:, 1], p[:, 2])).sum() / 6
    assert abs(volume / (4 / 3 * math.pi * 5.3**3) - 1) < 0.03
    ends = surfaces.vertices(found).collect()
    assert len(ends) == len({v for t in rows for v in (t.v1, t.v2, t.v3)})
    for v in ends:
        at = np.array([v.x - 10.5, v.y - 5.5, v.z - 14.5])
        assert abs(np.linalg.norm(at) - 5.3) < 0.1 and at @ [v.nx, v.ny, v.nz] / np.linalg.norm(at) > 0.9


def test_any_field_has_no_cracks(spark):
    """With all borders below the level, surfaces of noise are closed, whatever the corners."""
    v = np.full((12, 11, 10), -1.0)
    v[1:-1, 1:-1, 1:-1] = np.random.default_rng(1).normal(size=(10, 9, 8))
    rows = surfaces.isosurface(voxels_of(spark, v), 0.1, size=4).collect()
    assert len(rows) > 500 and closed(rows)
    assert len(rows) <= 5 * 12 * 11 * 10
    hole = v.copy()
    hole[5, 5, 5] = np.nan
    some = {(t.v1, t.v2, t.v3) for t in surfaces.isosurface(voxels_of(spark, hole), 0.1, size=4).collect()}
    assert some < {(t.v1, t.v2, t.v3) for t in rows}
    assert surfaces.isosurface(voxels_of(spark, v), 99.0).count() == 0
    assert surfaces.isosurface(voxels_of(spark, v).where("false"), 0.0).count() == 0


def test_cases_are_consistent():
    table = surfaces.triangles_of_cases()
    assert len(table) == 256 and table[0] == table[255] == ()
    for case, triangles in enumerate(table):
        crossed = {e for e, (a, b) in enumerate(surfaces.EDGES) if (case >> a & 1) != (case >> b & 1)}
        assert {e for t in triangles for e in t} == crossed
    assert all(len(table[1 << c]) == 1 for c in range(8)) and max(map(len, table)) <= 5


# Polygons

RINGS = {
    "star": [[(1.3, 0.2), (9.7, 8.1), (0.4, 5.2), (10.2, 4.1), (2.2, 9.3), (1.3, 0.2)]],
    "holed": [[(2.0, 2.0), (12.0, 2.0), (12.0, 11.0), (2.0, 11.0), (2.0, 2.0)], [(4.5, 4.5), (8.5, 4.5), (8.5, 7.5), (4.5, 7.5), (4.5, 4.5)]],
    "thin": [[(0.0, 0.1), (15.0, 0.1), (15.0, 0.4), (0.0, 0.4), (0.0, 0.1)]],
    "far": [[(-50.0, -50.0), (-40.0, -50.0), (-40.0, -40.0), (-50.0, -50.0)]],
}


def polygons_of(spark):
    return spark.createDataFrame([(n, [[{"x": x, "y": y} for x, y in r] for r in rings]) for n, rings in RINGS.items()], "polygon string, rings array<array<struct<x: double, y: double>>>")


def centre_inside(rings, x, y):
    """An odd number of cuts at or left of the centre."""
    cuts = 0
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            if (ay > y) != (by > y) and (bx - ax) * (y - ay) / (by - ay) + ax <= x:
                cuts += 1
    return cuts % 2 == 1


@pytest.mark.parametrize(("x0", "y0", "dx", "dy"), [(0.0, 0.0, 1.0, 1.0), (-0.7, 0.3, 0.5, 0.9), (0.0, 0.5, 1.0, 1.0)])
def test_cells_of_polygons(spark, x0, y0, dx, dy):
    got = {(r.polygon, r.row, r.col) for r in polygons.cells_inside(polygons_of(spark), x0, y0, dx, dy).where("polygon <> 'far'").collect()}
    want = {(n, r, c) for n, rings in RINGS.items() if n != "far" for r in range(-3, 30) for c in range(-3, 40) if centre_inside(rings, x0 + (c + 0.5) * dx, y0 + (r + 0.5) * dy)}
    assert got == want and len(want) > 50


def test_cut_and_zones(spark):
    cells = spark.range(400).select((F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"), F.when(F.col("id") != 85, F.col("id")).cast("double").alias("value"))
    inside = lambda n: {(r, c) for r in range(20) for c in range(20) if centre_inside(RINGS[n], c + 0.5, r + 0.5)}
    cut = polygons.cut_raster(cells, polygons_of(spark))
    assert {(r.row, r.col) for r in cut.collect()} == set.union(*map(inside, RINGS)) and cut.columns == cells.columns
    for r in polygons.zonal_statistics(cells, polygons_of(spark)).collect():
        values = [20 * a + b for a, b in inside(r.polygon) if 20 * a + b != 85]
        np.testing.assert_allclose([r.n, r.mean, r.std, r.min, r.max], [len(values), np.mean(values), np.std(values), min(values), max(values)])
    assert polygons.cells_inside(polygons_of(spark).where("false")).count() == 0


# Projections


def test_projections_of_published_examples(spark):
    """Snyder's numerical examples on Clarke's ellipsoid of 1866."""
    e2 = 0.00676866
    clarke = {"a": 6378206.4, "f": 1 - math.sqrt(1 - e2)}
    row = spark.range(1).select(F.lit(35.0).alias("lat"), F.lit(-75.0).alias("lon"))
    for projection, x, y in ((projections.AlbersEqualArea(23, -96, 29.5, 45.5, **clarke), 1885472.7, 1535925.0), (projections.LambertConformal(23, -96, 33, 45, **clarke), 1894410.9, 1564649.5)):
        p = projection.forward(F.col("lat"), F.col("lon"))
        got = row.select(p["x"].alias("x"), p["y"].alias("y")).first()
        assert abs(got.x - x) < 0.1 and abs(got.y - y) < 0.1


@pytest.mark.parametrize("projection", [projections.LambertConformal(-29, 24, -22, -34, 1e5, 2e5), projections.LambertConformal(40, 10, 45, 45), projections.AlbersEqualArea(0, 24, -18, -32), projections.AlbersEqualArea(50, -100, 45, 60), projections.TransverseMercator(27.0), projections.Geographic()])
def test_projections_there_and_back(spark, projection):
    lon = getattr(projection, "lon0", 20.0)
    places = spark.range(200).select((F.col("id") % 20 * 3.9 - 38.5).alias("lat"), (lon - 4.0 + F.floor(F.col("id") / 20) * 0.83).alias("lon"))
    p = projection.forward(F.col("lat"), F.col("lon"))
    there = places.select("lat", "lon", p["x"].alias("x"), p["y"].alias("y"))
    b = projection.inverse(F.col("x"), F.col("y"))
    worst = there.select(F.max(F.abs(b["lat"] - F.col("lat"))), F.max(F.abs(b["lon"] - F.col("lon")))).first()
    assert max(worst) < 1e-7


# Resampling


def grid_cells(spark, v):
    return spark.createDataFrame([(r, c, None if np.isnan(x) else float(x)) for (r, c), x in np.ndenumerate(v)], "row int, col int, value double")


def linear_at(v, r, c):
    """The weighted mean of the known ones of four cells."""
    total = weight = 0.0
    for i in (math.floor(r), math.floor(r) + 1):
        for j in (math.floor(c), math.floor(c) + 1):
            w = (1 - abs(r - i)) * (1 - abs(c - j))
            if w > 0 and 0 <= i < v.shape[0] and 0 <= j < v.shape[1] and not np.isnan(v[i, j]):
                total, weight = total + w * v[i, j], weight + w
    return total / weight if weight else None


def test_aligned_stack(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(9, 8)), rng.normal(size=(6, 12))
    a[3, 4] = np.nan
    ga, gb = resample.Grid(100.0, 50.0, 2.0, 2.0, 9, 8), resample.Grid(104.0, 47.0, 1.0, 1.5, 6, 12)
    bands = {"a": (grid_cells(spark, a), ga), "b": (grid_cells(spark, b), gb)}
    for how in ("linear", "nearest"):
        for options, target in (({}, resample.Grid(100.0, 50.0, 1.0, 1.0, 18, 16)), ({"common": True}, resample.Grid(104.0, 47.0, 1.0, 1.0, 9, 12)), ({"master": "a"}, ga), ({"dxy": 4.0}, resample.Grid(100.0, 50.0, 4.0, 4.0, 5, 4))):
            out, grid = resample.aligned(bands, how=how, **options)
            assert grid == target
            want = {}
            for name, v, g in (("a", a, ga), ("b", b, gb)):
                for r in range(grid.rows):
                    for c in range(grid.cols):
                        x, y = grid.left + (c + 0.5) * grid.dx, grid.top - (r + 0.5) * grid.dy
                        at = (g.top - y) / g.dy - 0.5, (x - g.left) / g.dx - 0.5
                        if -0.5 <= at[0] <= g.rows - 0.5 and -0.5 <= at[1] <= g.cols - 0.5:
                            value = linear_at(v, *at) if how == "linear" else v[min(math.floor(at[0] + 0.5), g.rows - 1), min(math.floor(at[1] + 0.5), g.cols - 1)]
                            if value is not None and not np.isnan(value):
                                want.setdefault((r, c), {})[name] = value
            got = {(r.row, r.col): {n: r[n] for n in "ab" if r[n] is not None} for r in out.collect()}
            assert got.keys() == want.keys()
            assert all(got[k].keys() == want[k].keys() and all(abs(got[k][n] - want[k][n]) < 1e-9 for n in got[k]) for k in want)


def test_reprojection_there_and_back(spark):
    """A smooth field comes back from another projection."""
    g = resample.Grid(20.0, -25.0, 0.05, 0.05, 40, 50)
    r, c = np.mgrid[0:40, 0:50]
    v = np.sin(r / 9) * 10 + c / 5
    lambert = projections.LambertConformal(-26, 21, -25, -27)
    there, target = resample.reprojected(grid_cells(spark, v), g, projections.Geographic(), lambert)
    assert 0.7 < target.rows * target.cols / (40 * 50) < 1.5
    back, _ = resample.reprojected(there, target, lambert, projections.Geographic(), g)
    got = {(x.row, x.col): x.value for x in back.collect()}
    inner = [(i, j) for i in range(2, 38) for j in range(2, 48)]
    assert max(abs(got[k] - v[k]) for k in inner) < 0.05
    near, _ = resample.reprojected(grid_cells(spark, v), g, projections.Geographic(), projections.Geographic(), g, "nearest")
    assert {(x.row, x.col): x.value for x in near.collect()} == {k: float(x) for k, x in np.ndenumerate(v)}
