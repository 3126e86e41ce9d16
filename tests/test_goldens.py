"""Known results of the operators on small rasters, as published for them."""

import math

import pytest
from pyspark.sql import functions as F

from stratalite.operators import catalog, grid, joining, stats, stencil

SLOPE = [[1, 2], [1, 2]]
ROOF = [[0, 1, 2, 1]] * 4
BUMP = [[2.0 if (r, c) == (5, 5) else 1.0 for c in range(7)] for r in range(7)]
CORE = [[2.0 if 2 <= r < 5 and 2 <= c < 5 else 1.0 for c in range(7)] for r in range(7)]


@pytest.fixture(scope="module")
def raster(spark):
    return lambda rows: spark.createDataFrame([(r, c, None if v is None else float(v)) for r, row in enumerate(rows) for c, v in enumerate(row)], "row int, col int, value double")


def table(df, value="value"):
    return {(r["row"], r["col"]): r[value] for r in df.collect()}


def like(df, rows, value="value", tolerance=1e-6):
    got = table(df, value)
    want = {(r, c): v for r, row in enumerate(rows) for c, v in enumerate(row)}
    assert got.keys() == want.keys()
    assert all((v is None and got[k] is None) or math.isclose(got[k], v, abs_tol=tolerance) for k, v in want.items()), got


def test_gradients(raster):
    d = raster(SLOPE)
    like(stencil.directional(d, 0), [[-1, -1]] * 2)
    like(stencil.derivative_ratio(d, 90), [[-math.pi / 2] * 2] * 2)
    like(stencil.horizontal_gradient(d, 10, 10), [[0.1, 0.1]] * 2)


def test_gradients_beside_gaps(raster, spark):
    row = spark.createDataFrame([("a", 0, c, float(c * c)) for c in (0, 1, 2, 4, 5)] + [("b", 0, c, float(c)) for c in range(6)], "band string, row int, col int, value double")
    got = {(r.band, r.col): r.dx for r in stencil.derivatives(row, keys=["band"]).collect()}
    assert got == {("a", 0): 1.0, ("a", 1): 2.0, ("a", 2): None, ("a", 4): None, ("a", 5): 9.0} | {("b", c): 1.0 for c in range(6)}


def test_aspect_and_shade(raster):
    d = raster(ROOF)
    like(stencil.aspect(d), [[270, 270, -1, 90]] * 4)
    like(stencil.sobel(d), [[0.5, 1, 0, -0.5]] * 4, "dzdx")
    like(stencil.sobel(d), [[0] * 4] * 4, "dzdy")
    like(stencil.shade(d, 100, math.pi / 4, -math.pi / 4, 0), [[0.7626513511471404, 0.7599169088331246, 0.7653668647301795, 0.7680632445003582]] * 4)


def test_stretches(raster):
    d = raster(ROOF)
    like(grid.clip_percentiles(d, 5, 5), ROOF)
    like(grid.equalise(d), [[0, 10922.66666667, 32768, 10922.66666667]] * 4)
    like(grid.norm2(d), [[0, 0.5, 1, 0.5]] * 4)
    like(grid.norm255(d), [[1, 128, 255, 128]] * 4)
    like(grid.normalise(raster(SLOPE), "interval"), [[0, 1]] * 2)
    like(grid.normalise(raster(SLOPE), "mean"), [[-1, 1]] * 2)
    like(grid.normalise(raster(SLOPE), "median"), [[-1, 1]] * 2)


def test_trim_equation_mode_correlation(raster, spark):
    n = None
    like(grid.trim(raster([[n] * 4, [n, 1, 2, n], [n, 1, 2, n], [n] * 4])), SLOPE)
    two = raster(SLOPE).select("row", "col", F.col("value").alias("a"), F.col("value").alias("b"))
    like(grid.equation(two, "i0+i1", ["a", "b"]), [[2, 4]] * 2)
    assert math.isclose(stats.modal_value(spark.createDataFrame([(float(v),) for v in (1, 2, 3, 3, 4, 5, 6)], "v double"), "v").first().mode, 3.0000384467512493, abs_tol=1e-9)
    assert math.isclose(stats.pair_table(two, ["a", "b"], "corr").where("a <> b").first().value, 1.0)
    names = spark.createDataFrame([(0, ""), (1, "")], "i int, name string")
    assert [r.name for r in catalog.rename_duplicates(names, "name", "i").orderBy("i").collect()] == ["(1)", "(2)"]


def test_smoothing(raster):
    d = raster(BUMP)
    box = [
        [0.36, 0.48, 0.6, 0.6, 0.6, 0.48, 0.36], [0.48, 0.64, 0.8, 0.8, 0.8, 0.64, 0.48], [0.6, 0.8, 1, 1, 1, 0.8, 0.6], [0.6, 0.8, 1, 1.04, 1.04, 0.84, 0.64],
        [0.6, 0.8, 1, 1.04, 1.04, 0.84, 0.64], [0.48, 0.64, 0.8, 0.84, 0.84, 0.68, 0.52], [0.36, 0.48, 0.6, 0.64, 0.64, 0.52, 0.4],
    ]
    like(stencil.moving_sum(d, dict.fromkeys(stencil.offsets(5), 1 / 25)), box)
    disc = [
        [0.30379747, 0.36708861, 0.43037975, 0.44303797, 0.43037975, 0.37974684, 0.3164557], [0.36708861, 0.44303797, 0.53164557, 0.5443038, 0.53164557, 0.46835443, 0.39240506],
        [0.43037975, 0.53164557, 0.62025316, 0.63291139, 0.62025316, 0.5443038, 0.4556962], [0.44303797, 0.5443038, 0.63291139, 0.63291139, 0.63291139, 0.55696203, 0.46835443],
        [0.43037975, 0.53164557, 0.62025316, 0.63291139, 0.62025316, 0.5443038, 0.4556962], [0.37974684, 0.46835443, 0.5443038, 0.55696203, 0.5443038, 0.48101266, 0.40506329],
        [0.3164557, 0.39240506, 0.4556962, 0.46835443, 0.4556962, 0.40506329, 0.34177215],
    ]
    like(stencil.moving_sum(d, stencil.disc_kernel(5)), disc)
    like(stencil.moving_median(d, stencil.offsets(5)), [[1] * 7] * 7)
    like(stencil.moving_median(d, stencil.disc_offsets(5)), [[1] * 7] * 7)


def test_gain_control(raster):
    for how, (corner, side) in {"mean": (2.25, 1.5), "median": (1, 1), "rms": (1.5, 1.22474487)}.items():
        got = table(stencil.gain_control(raster(CORE), 1, how))
        inner = {(r, c): v or 0.0 for (r, c), v in got.items()}
        assert inner.keys() == {(r, c) for r in range(1, 6) for c in range(1, 6)}
        want = {(r, c): (1 if (r, c) == (3, 3) else side if 3 in (r, c) else corner) if 2 <= r < 5 and 2 <= c < 5 else 0 for r, c in inner}
        assert all(math.isclose(inner[k], want[k], abs_tol=1e-6) for k in want), (how, inner)


def test_mercalli(spark):
    mags = [1.9, 2, 3, 4, 4.5, 5.5, 6, 6.5, 7, 7.5, 8, 8.5]
    got = [r.m for r in spark.createDataFrame([(i, float(m)) for i, m in enumerate(mags)], "i int, mag double").orderBy("i").select(catalog.mercalli(F.col("mag")).alias("m")).collect()]
    assert got == ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII"]


def test_knn_reaches_far(spark):
    left = spark.createDataFrame([(i, i * 1.0, 0.0) for i in range(5)] + [(9, 1e4, 1e4)], "lid long, lx double, ly double")
    right = spark.createDataFrame([(i, i * 1.1, 0.5) for i in range(4)], "rid long, rx double, ry double")
    got = {}
    for r in joining.knn(left, right, 3, 0.5).collect():
        got.setdefault(r.lid, []).append((r.rank, r.rid))
    place = {r.lid: (r.lx, r.ly) for r in left.collect()}
    for lid, (x, y) in place.items():
        want = sorted(range(4), key=lambda i: ((x - i * 1.1) ** 2 + (y - 0.5) ** 2, i))[:3]
        assert [rid for _, rid in sorted(got[lid])] == want
    assert joining.knn(left, right, 3, 0.5, limit=2.0).where("lid = 9").count() == 0
    assert joining.knn(left.where("false"), right, 3, 0.5).count() == 0


def test_exact_quantiles(spark):
    import random

    import numpy as np

    draw = random.Random(1)
    data = {"even": [draw.random() for _ in range(5000)], "same": [3.0] * 1000, "mixed": [0.0] * 900 + [1e-300, 1e300, -5.0] + [draw.gauss(0, 1) for _ in range(50)], "one": [7.0]}
    df = spark.createDataFrame([(b, v) for b, vs in data.items() for v in vs] + [("even", None)], "band string, value double")
    got = stats.exact_quantiles(df, [0.0, 0.25, 0.5, 0.77, 1.0], bins=64)
    assert all(np.allclose(got[b], np.quantile(v, [0.0, 0.25, 0.5, 0.77, 1.0]), rtol=1e-12) for b, v in data.items())
    assert stats.exact_quantiles(df.where("false"), [0.5]) == {}
