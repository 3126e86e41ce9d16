"""Mineral features against a plain version, corrected light of a known scene, composites with gaps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalite.operators import imagery

WAVES = [2000.0 + 10 * k for k in range(30)]


def _hull(y):
    """At each place the greatest height of a chord over it."""
    n = len(y)
    return [max(y[a] + (y[b] - y[a]) * ((k - a) / (b - a) if b > a else 0) for a in range(k + 1) for b in range(k, n)) for k in range(n)]


def test_absorption(spark):
    g = np.random.default_rng(2)
    rows = [(k, s.tolist()) for k, s in enumerate(g.uniform(0.2, 1, (40, 30)))]
    odd = [(100, [0.0] * 30), (101, None), (102, [*rows[0][1][:12], None, *rows[0][1][13:]]), (103, [0.5] * 30), (104, [1.0] * 10)]
    df = spark.createDataFrame([*rows, *odd], "id int, spectrum array<double>")
    got = {r["id"]: r["a"] for r in df.select("id", imagery.absorption(F.col("spectrum"), WAVES, 2052, 2198, 2080, 2180).alias("a")).collect()}
    for k, s in rows:
        y = s[5:21]
        hull = _hull(y)
        inner = list(range(4, 12))  # 2090 to 2170, the last left out
        q = [y[i] / hull[i] for i in inner]
        assert got[k]["depth"] == pytest.approx(1 - min(q)) and got[k]["wavelength"] == 2050 + 10 * inner[q.index(min(q))]
        assert got[k]["drop"] == pytest.approx(max(h - v for h, v in zip(hull, y, strict=True)))
    assert tuple(got[100]) == (0.0, 0.0, 0.0) and got[103]["depth"] == 0 and got[103]["wavelength"] == 2090
    assert all(tuple(got[k]) == (None, None, None) for k in (101, 102, 104))
    with pytest.raises(ValueError):
        imagery.absorption(F.col("spectrum"), WAVES, 2050, 2060)


def test_mineral(spark):
    dip = lambda at, d: [1 - d * math.exp(-(((w - at) / 15) ** 2)) for w in WAVES]
    df = spark.createDataFrame([(1, dip(2100, 0.3)), (2, dip(2100, 0.04)), (3, dip(2220, 0.3)), (4, None)], "id int, spectrum array<double>")
    features, ratios = {"f2100": (2050, 2150), "f2220": (2180, 2260)}, {"r1": "R2000 / R2101", "r2": "R2000 / R2222"}
    got = {r["id"]: r for r in imagery.mineral(df, WAVES, features, ratios, ["f2100", "f2100 > 0.1"], ["f2100 > f2220"]).collect()}
    assert got[1]["depth"] == pytest.approx(0.3, abs=0.01) and got[1]["wavelength"] == 2100 and got[1]["crystallinity"] == 1
    assert all(got[k]["depth"] is None and got[k]["wavelength"] is None and got[k]["crystallinity"] is None for k in (2, 3, 4))
    got = {r["id"]: r["ratio"] for r in imagery.mineral(df, WAVES, features, ratios, ["r1", "r2 < 1.2"]).collect()}
    assert got[1] == pytest.approx(1 / 0.7) and got[2] == pytest.approx(1 / 0.96) and got[3] is None and got[4] is None


def test_light_on_a_roof_is_taken_out(spark):
    """Brightness that follows the cosine to the sun is level after the correction."""
    dem = spark.createDataFrame([(r, c, float(-abs(c - 5.5)) + 0.1 * r) for r in range(8) for c in range(12)], "row int, col int, value double")
    light = imagery.sun_cosine(dem, 90.0, 45.0)
    cells = light.select("row", "col", (F.col("light") * 3 + 2).alias("b"), F.lit(7.0).alias("flat"))
    got = imagery.light_corrected(cells, dem, 90.0, 45.0, ["b", "flat"]).collect()
    assert len(got) == 96 and all(r["b"] == pytest.approx(3 * math.cos(math.pi / 4) + 2) and r["flat"] is None for r in got)
    sides = {r["col"]: r["light"] for r in light.where("row = 4").collect()}
    assert sides[9] > sides[2]  # the sun stands in the east


def test_ternary(spark):
    rows = [(r, c, float(r), float(c), float(r + c) if (r, c) != (2, 2) else None) for r in range(4) for c in range(5)]
    df = spark.createDataFrame(rows, "row int, col int, red double, green double, blue double")
    got = {(r["row"], r["col"]): tuple(r)[2:] for r in imagery.ternary(df, low=0.0, high=0.0).collect()}
    assert got[0, 0] == (1, 1, 1, 255) and got[3, 4] == (255, 255, 255, 255) and got[2, 2] == (0, 0, 0, 1)
    assert got[1, 2][:2] == (round(254 / 3 + 1), 128)
    lit = {(r["row"], r["col"]): tuple(r)[2:] for r in imagery.ternary(df, low=0.0, high=0.0, relief="red", cell=1.0).collect()}
    assert len(lit) == 20 and lit[2, 2] == (0, 0, 0, 1) and all(1 <= v <= w for k in lit if k != (2, 2) for v, w in zip(lit[k][:3], got[k][:3], strict=True))
    assert imagery.ternary(df.where("false")).count() == 0
