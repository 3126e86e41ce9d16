"""Minimum curvature gridding against a plain solve, and block rasters."""

import numpy as np
import pytest

from stratalite.operators import blocks, curvature


def plain_surface(rows, cols, data):
    """The least summed squared curvature, by one system of equations."""
    forms = []
    at = lambda r, c: r * cols + c
    for r in range(rows):
        for c in range(cols):
            line = np.zeros(rows * cols)
            if 0 < r < rows - 1:
                line[[at(r - 1, c), at(r + 1, c)]] += 1
                line[at(r, c)] -= 2
            if 0 < c < cols - 1:
                line[[at(r, c - 1), at(r, c + 1)]] += 1
                line[at(r, c)] -= 2
            forms.append(line)
    a = np.array(forms)
    u = np.zeros(rows * cols)
    known = np.array([at(r, c) for r, c in data])
    u[known] = list(data.values())
    free = np.setdiff1d(np.arange(rows * cols), known)
    u[free] = np.linalg.lstsq(a[:, free], -a[:, known] @ u[known], rcond=None)[0]
    return u.reshape(rows, cols)


def drawn(n, rows, cols, seed=1):
    rng = np.random.default_rng(seed)
    x, y = rng.uniform(0, cols - 1, n), rng.uniform(0, rows - 1, n)
    x[:4], y[:4] = [0, cols - 1, 0, cols - 1], [0, 0, rows - 1, rows - 1]
    return x, y, np.sin(x / 5) * 10 + np.cos(y / 4) * 5 + 0.1 * x


def nearest_to_centres(x, y, z):
    data = {}
    for a, b, c in zip(x, y, z, strict=True):
        r, k = int(np.floor(b + 0.5)), int(np.floor(a + 0.5))
        data.setdefault((r, k), []).append(((a - k) ** 2 + (b - r) ** 2, c))
    return {k: min(v)[1] for k, v in data.items()}


@pytest.mark.parametrize(("size", "border", "tolerance", "close"), [(32, 8, 1e-8, 1e-5), (8, 6, 1e-6, 2e-3)])
def test_equals_a_plain_solve(spark, size, border, tolerance, close):
    """In one block, and in many that only exchange borders."""
    rows, cols = 21, 26
    x, y, z = drawn(60, rows, cols)
    points = spark.createDataFrame([tuple(map(float, t)) for t in zip(x, y, z, strict=True)], "x double, y double, z double")
    want = plain_surface(rows, cols, nearest_to_centres(x, y, z))
    got = np.full((rows, cols), np.nan)
    for r in curvature.minimum_curvature(points, 1.0, buffer=0, size=size, border=border, tolerance=tolerance, rounds=40).collect():
        got[r.row, r.col] = r.value
    assert np.abs(got - want).max() < close * (z.max() - z.min())


def test_equations_are_the_published_ones():
    """The weights of a cell inside, on an edge, in a corner, beside an edge and beside a corner."""
    n = 9
    form = curvature.Curvature(0, 0, (n, n), n, n)
    weights = lambda r, c: np.array([[form.slope(np.eye(n * n)[i * n + j].reshape(n, n))[r, c] for j in range(n)] for i in range(n)])
    inside = weights(4, 4)[2:7, 2:7]
    assert inside.tolist() == [[0, 0, 1, 0, 0], [0, 2, -8, 2, 0], [1, -8, 20, -8, 1], [0, 2, -8, 2, 0], [0, 0, 1, 0, 0]]
    assert weights(0, 4)[:3, 2:7].tolist() == [[1, -4, 7, -4, 1], [0, 1, -4, 1, 0], [0, 0, 1, 0, 0]]
    assert weights(0, 0)[:3, :3].tolist() == [[2, -2, 1], [-2, 0, 0], [1, 0, 0]]
    assert weights(1, 4)[:4, 2:7].tolist() == [[0, 1, -4, 1, 0], [1, -8, 19, -8, 1], [0, 2, -8, 2, 0], [0, 0, 1, 0, 0]]
    assert weights(1, 1)[:4, :4].tolist() == [[0, -4, 1, 0], [-4, 18, -8, 1], [1, -8, 2, 0], [0, 1, 0, 0]]
    assert weights(0, 1)[:3, :4].tolist() == [[-2, 6, -4, 1], [1, -4, 1, 0], [0, 1, 0, 0]]
    assert (form.diagonal == [[form.slope(np.eye(n * n)[i * n + j].reshape(n, n))[i, j] for j in range(n)] for i in range(n)]).all()


def test_planes_and_odd_points(spark):
    plane = spark.createDataFrame([(float(x), float(y), 2.0 * x - y) for x, y in [(0, 0), (30, 0), (0, 20), (30, 20), (7, 9)]], "x double, y double, z double")
    got = {(r.row, r.col): r.value for r in curvature.minimum_curvature(plane, 1.0, tolerance=1e-9).collect()}
    assert len(got) == 21 * 31
    assert max(abs(v - (2 * c - r)) for (r, c), v in got.items()) < 1e-4
    near = {(r.row, r.col) for r in curvature.minimum_curvature(plane, 1.0, blank=2.0).collect()}
    assert near == {(r, c) for r in range(21) for c in range(31) if any((r - b) ** 2 + (c - a) ** 2 <= 4 for a, b in [(0, 0), (30, 0), (0, 20), (30, 20), (7, 9)])}
    odd = spark.createDataFrame([(1.0, 1.0, 5.0), (1.0, 1.0, 4.0), (None, 1.0, 1.0), (1.0, float("nan"), 1.0), (2.0, 2.0, None)], "x double, y double, z double")
    assert [tuple(r) for r in curvature.minimum_curvature(odd, 1.0).collect()] == [(0, 0, 4.0)]
    assert curvature.minimum_curvature(odd.where("false"), 1.0).count() == 0


def test_windows_of_blocks(spark):
    """Each window is the raster around a block, with NaN where there are no cells."""
    rng = np.random.default_rng(2)
    raster = rng.normal(size=(13, 10))
    raster[rng.random((13, 10)) < 0.2] = np.nan
    cells = spark.createDataFrame([(r, c, float(v)) for (r, c), v in np.ndenumerate(raster) if not np.isnan(v)], "row int, col int, value double")
    made = blocks.to_blocks(cells, 4)
    assert sorted((r.row, r.col, r.value) for r in blocks.to_cells(made, 4).collect()) == sorted((r.row, r.col, r.value) for r in cells.collect())
    padded = np.full((40, 40), np.nan)
    padded[10 : 10 + 13, 10 : 10 + 10] = raster
    for r in blocks.with_borders(made, 4, 3, lambda br, bc, w: [(br, bc, w.tobytes())], "br int, bc int, data binary").collect():
        at = (10 + r.br * 4 - 3, 10 + r.bc * 4 - 3)
        np.testing.assert_array_equal(np.frombuffer(r.data).reshape(10, 10), padded[at[0] : at[0] + 10, at[1] : at[1] + 10])
