"""Linear gridding against all triangles of a few points, at odd inputs, and wherever the tiles lie."""

import itertools

import numpy as np
import pytest

from stratalite.operators import triangles


def plain(points, dxy):
    """Every triangle whose circle holds no other point, and the cells in it."""
    p = np.array(points)
    x0, y0 = p[:, 0].min(), p[:, 1].min()
    cols, rows = int((p[:, 0].max() - x0) / dxy + 0.5) + 1, int((p[:, 1].max() - y0) / dxy + 0.5) + 1
    out = {}
    for t in itertools.combinations(range(len(p)), 3):
        a = np.column_stack([p[list(t), :2], np.ones(3)])
        if abs(np.linalg.det(a)) < 1e-12:
            continue
        plane = np.linalg.solve(a, (p[list(t), :2] ** 2).sum(axis=1))
        rest = np.delete(p, t, axis=0)
        if len(rest) and ((np.column_stack([rest[:, :2], np.ones(len(rest))]) @ plane - (rest[:, :2] ** 2).sum(axis=1)) > 1e-9).any():
            continue
        for r in range(rows):
            for c in range(cols):
                w = np.linalg.solve(a.T, [x0 + c * dxy, y0 + r * dxy, 1.0])
                if (w >= -1e-9).all():
                    out[r, c] = float(w @ p[list(t), 2])
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "x double, y double, z double")


def got(df):
    rows = df.collect()
    out = {(r["row"], r["col"]): r["value"] for r in rows}
    assert len(out) == len(rows)
    return out


def same(a, b):
    assert set(a) == set(b)
    assert all(a[k] == pytest.approx(b[k], rel=1e-6, abs=1e-6) for k in a)


@pytest.mark.parametrize("seed, n, dxy", [(1, 25, 0.6), (2, 40, 1.0), (3, 12, 0.2)])
def test_all_triangles(spark, seed, n, dxy):
    p = np.random.default_rng(seed).uniform(0, 10, (n, 3)).tolist()
    same(got(triangles.linear_grid(table(spark, p), dxy)), plain(p, dxy))


def test_tiles_and_borders_leave_no_mark(spark, monkeypatch):
    """Small tiles with narrow borders: nearly all circles are looked up in buckets of several sizes."""
    p = np.random.default_rng(5).uniform(0, 10, (60, 3))
    p[:30, :2] = p[:30, :2] / 20 + 4  # a dense spot, with many points in a cell
    p = p.tolist()
    for name, v in (("TILE", 4), ("HALO", 1), ("BUCKET", 1), ("ACROSS", 4)):
        monkeypatch.setattr(triangles, name, v)
    same(got(triangles.linear_grid(table(spark, p), 0.7)), plain(p, 0.7))


def test_a_plane_comes_back_over_large_gaps(spark):
    g = np.random.default_rng(7)
    far = [(0.0, 0.0), (300.0, 0.0), (0.0, 200.0), (300.0, 200.0)]
    xy = [*map(tuple, g.uniform(0, 20, (300, 2))), *map(tuple, g.uniform(0, 5, (50, 2)) + [250, 150]), *far]
    found = got(triangles.linear_grid(table(spark, [(float(x), float(y), float(3 * x - 2 * y + 1)) for x, y in xy]), 2.0))
    assert len(found) == 151 * 101
    assert all(v == pytest.approx(3 * 2 * c - 2 * 2 * r + 1, abs=1e-3) for (r, c), v in found.items())


def test_lattice_with_ties_is_the_same_in_each_run(spark):
    p = [(float(x), float(y), float((x * 7 + y * 5) % 11)) for x in range(12) for y in range(9)]
    a, b = got(triangles.linear_grid(table(spark, p), 0.5)), got(triangles.linear_grid(table(spark, p[::-1]).repartition(5), 0.5))
    assert a == b and len(a) == 23 * 17
    assert all(a[2 * int(y), 2 * int(x)] == pytest.approx(z, abs=1e-6) for x, y, z in p)
    for r, c in a:  # a middle lies between two ends of some diagonal
        if r % 2 and c % 2:
            corners = [a[r + i, c + j] for i in (-1, 1) for j in (-1, 1)]
            assert any(a[r, c] == pytest.approx(m, abs=1e-6) for m in ((corners[0] + corners[3]) / 2, (corners[1] + corners[2]) / 2))


def test_odd_points(spark):
    nan = float("nan")
    assert got(triangles.linear_grid(table(spark, []), 1.0)) == {}
    assert got(triangles.linear_grid(table(spark, [(None, 1.0, 1.0), (1.0, nan, 1.0)]), 1.0)) == {}
    same(got(triangles.linear_grid(table(spark, [(3.0, 4.0, 5.0), (3.0, 4.0, 2.0)]), 1.0)), {(0, 0): 2.0})
    same(got(triangles.linear_grid(table(spark, [(float(x), 1.0, float(x * x)) for x in (0, 2, 5)]), 1.0)), {(0, 0): 0.0, (0, 1): 2.0, (0, 2): 4.0, (0, 3): 11.0, (0, 4): 18.0, (0, 5): 25.0})


def test_blank(spark):
    p = [(0.0, 0.0, 0.0), (20.0, 0.0, 20.0), (0.0, 20.0, 0.0)]
    found = got(triangles.linear_grid(table(spark, p), 1.0, blank=3))
    want = {(r, c): float(c) for r in range(21) for c in range(21) if r + c <= 20 and any((r - y) ** 2 + (c - x) ** 2 <= 9 for x, y, _ in p)}
    same(found, want)
    with pytest.raises(ValueError):
        triangles.linear_grid(table(spark, p), 1.0, blank=17)


def test_filled(spark):
    cells = [(r, c, None if (r, c) in {(1, 1), (2, 1), (4, 4)} else float(2 * r + c)) for r in range(5) for c in range(5)]
    df = spark.createDataFrame([*cells, (0, 9, None)], "row int, col int, value double")
    found = {(r["row"], r["col"]): r["value"] for r in triangles.filled(df).collect()}
    assert found[1, 1] == pytest.approx(3, abs=1e-6) and found[2, 1] == pytest.approx(5, abs=1e-6)
    assert found[0, 9] is None and found[4, 4] is None and len(found) == 26


def test_points_in_a_circle_are_not_sorted(spark, monkeypatch):
    """Points crowd along a flat hull, so that circles of cells there hold most of them: what meets is hashed down to numbers before any row is kept."""
    plans, plain_written = {}, triangles.written
    monkeypatch.setattr(triangles, "written", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().sparkPlan().toString()) and plain_written(df, name))
    x = np.random.default_rng(3).uniform(0, 40, 3000)
    y = np.where(np.arange(3000) % 2, np.random.default_rng(4).uniform(0, 6, 3000), (x - 20) ** 2 / 4000)
    found = got(triangles.linear_grid(table(spark, [(float(a), float(b), float(2 * a - b)) for a, b in zip(x, y, strict=True)]), 1.0))
    assert len(found) > 150 and all(v == pytest.approx(2 * (x.min() + c) - (y.min() + r), abs=1e-6) for (r, c), v in found.items())
    assert "HashAggregate" in plans["triangles-deepest"] and "SortAggregate" not in plans["triangles-deepest"] + plans["triangles-near"]
