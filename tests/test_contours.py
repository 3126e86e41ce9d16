"""Contours, their lines and rings, tilt maps and tilt depths."""

import math

import numpy as np
from pyspark.sql import functions as F

from stratalite.operators import components, contours, spectrum


def raster_of(spark, rows):
    return spark.createDataFrame([(r, c, None if v is None or np.isnan(v) else float(v)) for r, row in enumerate(rows) for c, v in enumerate(row)], "row int, col int, value double")


def crossings(z, level):
    """Plain marching squares: segments with what is above on one side."""
    out = []
    for r in range(z.shape[0] - 1):
        for c in range(z.shape[1] - 1):
            corner = [(r, c), (r, c + 1), (r + 1, c + 1), (r + 1, c)]
            v = [z[p] for p in corner]
            if any(np.isnan(v)):
                continue
            up = [x > level for x in v]
            at = lambda k: tuple(corner[k][i] + (level - v[k]) / (v[(k + 1) % 4] - v[k]) * (corner[(k + 1) % 4][i] - corner[k][i]) for i in (1, 0))  # noqa: B023, E731
            leave, enter = [k for k in range(4) if up[k] and not up[(k + 1) % 4]], [k for k in range(4) if not up[k] and up[(k + 1) % 4]]
            for k in leave:
                to = enter[0] if len(enter) == 1 else next(j for j in enter if (j - k) % 4 == (1 if sum(v) / 4 > level else 3))
                out.append((r, c, *at(k), *at(to)))
    return out


def field(seed, shape=(23, 19)):
    rng = np.random.default_rng(seed)
    return rng.normal(size=shape).round(1)  # ties with the level too


def test_segments_are_marching_squares(spark):
    z = field(1)
    z[4, 5] = np.nan
    cells = raster_of(spark, z)
    for size in (4, 64):
        got = contours.segments(cells, [0.0, 0.45], size)
        for level in (0.0, 0.45):
            mine = sorted(tuple(np.round([r.row, r.col, r.x1, r.y1, r.x2, r.y2], 9)) for r in got.where(F.col("level") == level).collect())
            assert mine == sorted(tuple(np.round(s, 9)) for s in crossings(z, level))


def test_lines_join_and_rings_close(spark):
    z = field(2)
    lines = {}
    for r in contours.contour_lines(raster_of(spark, z), [0.05, -0.55], 5).collect():
        lines.setdefault((r.level, r.line), []).append(r)
    rings = 0
    for segments in lines.values():
        segments.sort(key=lambda r: r.place)
        assert [r.place for r in segments] == list(range(len(segments)))
        assert all(math.dist((a.x2, a.y2), (b.x1, b.y1)) < 1e-9 for a, b in zip(segments, segments[1:], strict=False))
        closed = math.dist((segments[-1].x2, segments[-1].y2), (segments[0].x1, segments[0].y1)) < 1e-9
        assert {r.ring for r in segments} == {closed}
        rings += closed
        if not closed:  # begins and ends on the raster's edge
            assert all(x in (0, z.shape[1] - 1) or y in (0, z.shape[0] - 1) for x, y in ((segments[0].x1, segments[0].y1), (segments[-1].x2, segments[-1].y2)))
    assert rings > 3
    assert sum(map(len, lines.values())) == len(crossings(z, 0.05)) + len(crossings(z, -0.55))
    polygons = contours.contour_polygons(raster_of(spark, z), [0.05, -0.55], 5).collect()
    assert len(polygons) == rings and all(tuple(p.ring[0]) == tuple(p.ring[-1]) for p in polygons)


def test_cone_has_one_round_ring(spark):
    y, x = np.mgrid[-12:13, -12:13]
    polygon = contours.contour_polygons(raster_of(spark, 10 - np.hypot(x, y)), [2.5]).collect()
    assert len(polygon) == 1
    assert all(abs(math.dist((p.x, p.y), (12, 12)) - 7.5) < 0.1 for p in polygon[0].ring)
    assert contours.contour_lines(raster_of(spark, np.zeros((4, 4))), [1.0]).count() == 0
    assert contours.segments(raster_of(spark, np.zeros((4, 4))).where("false"), [1.0]).count() == 0


def test_chain_places(spark):
    links = [(5, 3), (3, 9), (9, None), (20, 22), (22, 21), (21, 20), (40, None), (50, 50)] + [(100 + k, 101 + k) for k in range(37)] + [(137, None)]
    got = {r.node: (r.chain, r.place, r.ring) for r in components.chain_places(spark.createDataFrame(links, "node long, next long")).collect()}
    assert got[5] == (3, 0, False) and got[3] == (3, 1, False) and got[9] == (3, 2, False)
    assert got[20] == (20, 0, True) and got[22] == (20, 1, True) and got[21] == (20, 2, True)
    assert got[40] == (40, 0, False) and got[50] == (50, 0, True)
    assert all(got[100 + k] == (100, k, False) for k in range(38))


def test_numbered(spark):
    df = spark.createDataFrame([(v,) for v in [30, 10, 20, 10, None, 500] * 3], "v long")
    assert sorted((r.v, r.number) for r in components.numbered(df, "v").collect()) == [(10, 1), (20, 2), (30, 3), (500, 4)]
    assert components.numbered(df.where("false"), "v").count() == 0


# Results of the published small cases of tilt maps and depths.
TILT_FIELD = [[0, 0, 0.1, 0.5, 1], [0, 0.1, 0.5, 1, 0.5], [0.1, 0.5, 1, 0.5, 0.1], [0.5, 1, 0.5, 0.1, 0], [1, 0.5, 0.1, 0, 0]]
DEPTHS = [
    (3.93612464, -1.99438548, 1, 0.32962923), (3.49438548, -2.49438548, 1, 0.34958333), (2.99438548, -2.99438548, 1, 0.34958333), (2.49438548, -3.49438548, 1, 0.34958333),
    (1.99438548, -3.93612464, 1, 0.32962923), (1.48759916, -2.48888969, 2, 0.36542720), (1.98888969, -1.98888969, 2, 0.36451351), (2.48888969, -1.48759916, 2, 0.36542720),
]
TILT, TOTAL = 1.2626272556789115, 0.30816907111598496


def test_tilt_maps_golden(spark):
    got = {(r.row, r.col): r for r in spectrum.tilt_angles(raster_of(spark, [[1, 2], [1, 2]]), 90.0).collect()}
    assert len(got) == 4
    for (_, c), r in got.items():
        assert math.isclose(r.tilt, TILT if c else -TILT, rel_tol=1e-12) and math.isclose(r.total, TOTAL, rel_tol=1e-12)
        assert r.hyperbolic is None and abs(r.second or 0) < 1e-9 and abs(r.directional) < 1e-15


def test_edge_derivative_by_a_plain_transform(spark):
    z = field(3, (5, 7))
    n, top, left = 8, 1, 0
    w = np.fft.fftfreq(n) * n * 2 * np.pi / (n - 1)
    padded = np.pad(z - np.median(z), ((top, n - 5 - top), (left, n - 7 - left)), "edge")
    want = np.fft.ifft2(np.fft.fft2(padded) * np.hypot(w[:, None], w[None, :])).real[top : top + 5, left : left + 7]
    got = {(r.row, r.col): r.value for r in spectrum.edge_derivative(raster_of(spark, z)).collect()}
    assert all(abs(got[k] - want[k]) < 1e-9 for k in np.ndindex(5, 7))
    assert spectrum.edge_derivative(raster_of(spark, z).where("false")).count() == 0


def test_tilt_depths_golden(spark):
    pole = spectrum.to_pole(raster_of(spark, TILT_FIELD), 90.0, 0.0)
    tilt = spectrum.tilt_angles(pole).select("row", "col", F.col("tilt").alias("value"))
    got = sorted((r.x, r.y, r.depth, r.line) for r in contours.tilt_depths(tilt).collect())
    want = sorted((x, y, d, line) for x, y, line, d in DEPTHS)
    assert len(got) == len(want)
    np.testing.assert_allclose([g[:3] for g in got], [w[:3] for w in want], atol=1e-6)
    names = {}
    assert all(names.setdefault(w[3], g[3]) == g[3] for g, w in zip(got, want, strict=True)) and len(set(names.values())) == 2
