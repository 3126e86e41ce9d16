"""Spectra against plain two-dimensional transforms, and visibility against walks along lines."""

import numpy as np
import pytest

from stratalite.functions import places, radiometry, ratios
from stratalite.operators import spectrum, structures, visibility


def _cells(spark, z):
    return spark.createDataFrame([(r + 3, c - 2, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(z)], "row int, col int, value double")


def _framed(z):
    """The frame, its filling and the taper, on the whole array at once."""
    middle = np.nanmedian(z)
    nr, nc = z.shape
    f = np.full((nr + 2 * (nr // 2), nc + 2 * (nc // 2)), np.nan)
    f[nr // 2 : nr // 2 + nr, nc // 2 : nc // 2 + nc] = z - middle

    def interpolated(line):
        k = np.flatnonzero(~np.isnan(line))
        out = np.interp(np.arange(len(line)), k, line[k])
        return np.where(out == 0, np.nan, out)

    for _ in range(2):
        f[[0, -1]], f[:, [0, -1]] = 0, 0
        rows, cols = np.apply_along_axis(interpolated, 1, f), np.apply_along_axis(interpolated, 0, f)
        both = np.where(np.isnan(rows), cols, np.where(np.isnan(cols), rows, (rows + cols) / 2))
        f = np.where(np.isnan(f), both, f)
    return np.nan_to_num(f) * spectrum.taper(f.shape[1]) * spectrum.taper(f.shape[0])[:, None], middle


def _plain(z, response, dx, dy, level):
    f, middle = _framed(z)
    kx, ky = np.meshgrid(np.fft.fftfreq(f.shape[1], dx) * 2 * np.pi, -np.fft.fftfreq(f.shape[0], dy) * 2 * np.pi)
    out = np.fft.ifft2(np.fft.fft2(f) * response(kx, ky)).real
    nr, nc = z.shape
    out = out[nr // 2 : nr // 2 + nr, nc // 2 : nc // 2 + nc] + (middle if level else 0)
    return np.where(np.isnan(z), np.nan, out)


@pytest.fixture(scope="module")
def field():
    z = np.random.default_rng(5).normal(50, 9, (7, 10))
    z[2, 3:6] = np.nan
    z[6, 0] = np.nan
    return z


I, D = np.deg2rad(-62.5), np.deg2rad(-16.75)


@pytest.mark.parametrize(
    ("ours", "response", "level"),
    [
        (lambda c: spectrum.upward(c, 2.0, 2.0, 3.0), lambda x, y: np.exp(-2.0 * np.sqrt(x**2 + y**2)), True),
        (lambda c: spectrum.vertical_derivative(c, 2.0, 2.0, 3.0), lambda x, y: x**2 + y**2, False),
        (lambda c: spectrum.to_pole(c, -62.5, -16.75, 2.0, 3.0), lambda x, y: (np.sin(I) + 1j * np.cos(I) * np.sin(D + np.arctan2(y, x))) ** -2.0, True),
    ],
)
def test_spectra(spark, field, ours, response, level):
    want = _plain(field, response, 2.0, 3.0, level)
    got = {(r["row"], r["col"]): r["value"] for r in ours(_cells(spark, field)).collect()}
    assert set(got) == {(r + 3, c - 2) for r, c in zip(*np.nonzero(~np.isnan(field)), strict=True)}
    assert all(abs(v - want[r - 3, c + 2]) < 1e-8 for (r, c), v in got.items())


def test_spectrum_without_values(spark):
    assert spectrum.upward(spark.createDataFrame([(0, 0, None), (1, 1, None)], "row int, col int, value double"), 1.0).count() == 0
    with pytest.raises(ValueError):
        spectrum.upward(_cells(spark, np.ones((1, 5))), 1.0)


@pytest.mark.parametrize("size", [3, 5, 7])
def test_visibility(spark, field, size):
    z, half = np.where(np.isnan(field), np.nanmean(field), field), size // 2

    def walk(r, c, dr, dc):
        top, seen = -np.inf, 0
        for k in range(1, half + 1):
            slope = (z[r + k * dr, c + k * dc] - z[r, c] - 2.0) / k
            if slope >= top:
                top, seen = slope, seen + 1
        return seen

    ways = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (-1, 1), (1, -1)]
    got = {(r["row"], r["col"]): r for r in visibility.visibility(_cells(spark, field), size, 2.0).collect()}
    want = {}
    for r in range(half, 7 - half):
        for c in range(half, 10 - half):
            if not np.isnan(field[r, c]):
                n = [(walk(r, c, *w) if half > 1 else 0) + (1 - i % 2) for i, w in enumerate(ways)]
                x = sum(v * w[1] / np.hypot(*w) for v, w in zip(n, ways, strict=True))
                y = sum(v * w[0] / np.hypot(*w) for v, w in zip(n, ways, strict=True))
                want[r + 3, c - 2] = (sum(n), np.std(n, ddof=1), np.hypot(x, y))
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert np.allclose((got[k]["total"], got[k]["deviation"], got[k]["resultant"]), v)


def test_ratios():
    oli = dict((label, f) for f, label in ratios.for_sensor("Landsat 8 and 9 (OLI)"))
    assert oli["NDVI"] == "(B5-B4)/(B5+B4)" and "quartz" not in oli
    assert dict((label, f) for f, label in ratios.for_sensor("Sentinel-2"))["GRVI Landslide"] == "B8A/B3"
    assert ratios.landsat_sensor("LE07_L1TP") == "Landsat 7 (ETM+)" and not ratios.for_sensor("Unknown")


def test_division_by_zero_is_null(spark):
    d = spark.createDataFrame([(1.0, 1.0)], "B2 double, B3 double")
    assert d.select(ratios.ratio("(B3-B2)/(B3-B2)"), ratios.ratio("B3/sqrt(B3-B2)+1"), ratios.ratio("B3/B2")).first()[:] == (None, None, 1.0)


def test_places(spark):
    one = spark.range(1)
    from pyspark.sql import functions as F

    at = one.select(*[c.alias(n) for n, c in places.transverse_mercator(F.lit(-25.0), F.lit(28.0), 27.0).items()]).first()
    # the known scale at the meridian and its distance from the equator
    assert abs(at["easting"] - 100_898.0) < 100 and abs(at["northing"] + 2_765_000) < 2000
    north = one.select(places.transverse_mercator(F.lit(45.0), F.lit(27.0), 27.0)["northing"] / 0.9996).first()[0]
    assert abs(north - 4_984_944.378) < 0.01
    bounds = one.select(*[c.alias(n) for n, c in places.sheet_bounds(F.lit("2928AB")).items()]).first()
    assert tuple(bounds) == (28.25, -29.25, 28.5, -29.0)
    assert one.select(*[c for c in places.sheet_bounds(F.lit("farm")).values()]).first()[:] == (None,) * 4
    plane = one.select(*[F.round(c, 6).alias(n) for n, c in places.auxiliary_plane(F.lit(0.0), F.lit(90.0), F.lit(0.0)).items()]).first()
    assert (plane["strike"] % 180, plane["dip"]) == (90.0, 90.0)


# Published distances of Earth and Sun for some days of the year.
DISTANCES = {1: 0.98331, 94: 1.00012, 186: 1.0167, 277: 1.00033, 366: 0.98331}


def test_sun_distance(spark):
    from pyspark.sql import functions as F

    for day, distance in DISTANCES.items():
        assert abs(spark.range(1).select(radiometry.sun_distance_of_day(F.lit(day))).first()[0] - distance) < 2e-5


def test_lines(spark):
    v = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 3.0, 0.0), ("a", 2, 3.0, 4.0), ("b", 0, 1.0, 1.0), ("c", 0, 2.0, 2.0), ("c", 1, 2.0, 2.0)], "line string, seq int, x double, y double")
    assert [tuple(r) for r in structures.resampled(v, 2.0).orderBy("k").collect()] == [("a", k, x, y) for k, x, y in [(0, 0, 0), (1, 1.75, 0), (2, 3, 0.5), (3, 3, 2.25), (4, 3, 4)]]
    assert {tuple(r) for r in structures.angles(structures.segments(v)).select("line", "angle").collect()} == {("a", 0), ("a", 90)}
    assert {(r["row"], r["col"]) for r in structures.touched(structures.segments(v).where("line = 'a'"), 2.0).collect()} == {(0, 0), (0, 1), (1, 1), (2, 1)}
    moved = {(r["line"], r["seq"]): (r["x"], r["y"]) for r in structures.extended(v, 1.0).collect()}
    assert np.allclose(moved["a", 0], (-1, 0)) and moved["a", 1] == (3, 0) and np.allclose(moved["a", 2], (3, 5)) and moved["b", 0] == (1, 1)
