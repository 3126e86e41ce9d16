"""The field of a model against the gradient of its potential, raw rasters, and the checks of surveys."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalite.operators import magnetics, reports
from stratalite.sources import binary, harmonics


def _schmidt(n, m, theta):
    """By the derivative of (x^2 - 1)^n, with polynomials."""
    p = np.polynomial.Polynomial([-1, 0, 1]) ** n
    p = p.deriv(n + m) / (2**n * math.factorial(n))
    scale = 1 if m == 0 else math.sqrt(2 * math.factorial(n - m) / math.factorial(n + m))
    return scale * math.sin(theta) ** m * p(math.cos(theta))


def test_field_is_the_gradient_of_its_potential():
    draw = np.random.default_rng(3)
    model = {(n, m): (float(draw.normal(0, 1e4 / n**2)), float(draw.normal(0, 1e4 / n**2)) if m else 0.0) for n in range(1, 6) for m in range(n + 1)}

    def potential(r, theta, phi):
        return sum(magnetics.RADIUS * (magnetics.RADIUS / r) ** (n + 1) * (g * math.cos(m * phi) + h * math.sin(m * phi)) * _schmidt(n, m, theta) for (n, m), (g, h) in model.items())

    for lat, lon, height in [(-27.5, 28.0, 1.4), (63.0, -120.0, 0.0), (2.0, 181.0, 12.0)]:
        s, c = math.sin(math.radians(lat)), math.cos(math.radians(lat))
        d = math.sqrt(magnetics.A2 * c * c + magnetics.B2 * s * s)
        q, z = (magnetics.A2 / d + height) * c, (magnetics.B2 / d + height) * s
        r, theta, phi, e = math.hypot(q, z), math.atan2(q, z), math.radians(lon), 1e-5
        br = -(potential(r + 0.01, theta, phi) - potential(r - 0.01, theta, phi)) / 0.02
        bt = -(potential(r, theta + e, phi) - potential(r, theta - e, phi)) / (2 * e * r)
        bp = -(potential(r, theta, phi + e) - potential(r, theta, phi - e)) / (2 * e * r * math.sin(theta))
        turn = math.radians(lat) - (math.pi / 2 - theta)
        want = (-bt * math.cos(turn) - br * math.sin(turn), bp, -br * math.cos(turn) + bt * math.sin(turn))
        got = magnetics.synthesis(np.array([lat]), np.array([lon]), np.array([height]), model)
        assert np.allclose([v[0] for v in got], want, rtol=1e-5, atol=0.05), (lat, lon)


MODELS = """   OLD  2010.00  2  0  0 2010.00 2015.00   -1.0  600.0
 1  0 -29500.0 0.0
 1  1 -1500.0 4900.0
 2  0 100.0 0.0
 2  1 0.0 0.0
 2  2 0.0 0.0
   NEW  2015.00  1  1  0 2015.00 2020.00   -1.0  600.0
 1  0 -29400.0 0.0 10.0 0.0
 1  1 -1400.0 4800.0 5.0 -20.0
"""


def test_models_between_epochs_and_beyond(spark, tmp_path):
    (tmp_path / "m.cof").write_text(MODELS)
    models = harmonics.read_field_models(spark, str(tmp_path / "m.cof"))
    assert magnetics.coefficients(models, 2012.5)[1, 0] == (-29450.0, 0.0)
    assert magnetics.coefficients(models, 2012.5)[2, 0] == (50.0, 0.0)
    assert magnetics.coefficients(models, 2017.0)[1, 1] == (-1390.0, 4760.0)
    with pytest.raises(ValueError):
        magnetics.coefficients(models, 2021.0)
    place = spark.createDataFrame([(1, -27.0, 25.0, 1200.0), (2, None, 25.0, 0.0)], "id int, lat double, lon double, height double")
    got = {r["id"]: r for r in magnetics.field(place, magnetics.coefficients(models, 2017.0)).collect()}
    assert got[2]["f"] is None and 20000 < got[1]["f"] < 50000 and got[1]["inclination"] < 0


@pytest.mark.parametrize("interleave", ["line", "pixel"])
def test_interleaved(spark, tmp_path, interleave):
    z = np.arange(2 * 40 * 5, dtype=">i2").reshape(40, 2, 5)
    z[3, 1, 2] = -1
    (tmp_path / "r.bil").write_bytes((z if interleave == "line" else z.transpose(0, 2, 1)).tobytes())
    got = {(r["row"], r["col"]): (r["b1"], r["b2"]) for r in binary.read_interleaved(spark, str(tmp_path / "r.bil"), 2, 5, ">i2", interleave, nodata=-1).collect()}
    assert got == {(r, c): (float(z[r, 0, c]), None if (r, c) == (3, 2) else float(z[r, 1, c])) for r in range(40) for c in range(5)}
    part = binary.read_interleaved(spark, str(tmp_path / "r.bil"), 2, 5, ">i2", interleave, (30, 1, 4, 2), -1).collect()
    assert {(r["row"], r["col"]) for r in part} == {(r, c) for r in range(30, 34) for c in (1, 2)}


def test_hulls(spark):
    draw = np.random.default_rng(2)
    points = [(float(x), float(y), float(v)) for x, y, v in zip(*draw.uniform(0, 100, (2, 800)), draw.integers(0, 5, 800), strict=True)]
    got = {r["level"]: {(p["x"], p["y"]) for p in r["hull"]} for r in reports.intensity_hulls(spark.createDataFrame(points, "x double, y double, intensity double"), [1, 4]).collect()}
    for level in (1.0, 4.0):
        inside = np.array([p[:2] for p in points if p[2] >= level])
        # a point is a corner if all others are on one side of a line to some other point
        corners = {tuple(a) for a in inside for b in inside if (a != b).any() and ((b[0] - a[0]) * (inside[:, 1] - a[1]) - (b[1] - a[1]) * (inside[:, 0] - a[0]) >= -1e-12).all()}
        assert got[level] <= corners and len(got[level]) >= len(corners) - 1


def test_ellipses(spark):
    e = spark.range(2).select(reports.error_ellipse(F.lit(3.0), F.lit(1.0), F.when(F.col("id") == 0, 0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("e"))
    found = [r["e"] for r in e.collect()]
    assert (found[0]["major"], found[0]["minor"]) == (6.0, 2.0) and abs(found[0]["angle"]) % 180 == 0
    assert found[1]["major"] is None or math.isnan(found[1]["major"])


def test_names(spark):
    rows = spark.createDataFrame([(1, "Johanesburg"), (2, "Durban"), (3, "xyz"), (4, None)], "id int, region string")
    assert {r["id"]: r["region"] for r in reports.closest_names(rows, "region", ["Johannesburg", "Durban"]).collect()} == {1: "Johannesburg", 2: "Durban", 3: "xyz", 4: None}


def test_bases_without_others(spark):
    r = spark.createDataFrame([(90001.0, 0.0, 10.0), (90001.0, 2.0, 14.0), (5.0, 1.0, 3.0)], "station double, t double, value double")
    assert [tuple(x) for x in reports.absolute_bases(r, 90001.0, 100.0, 90000.0).orderBy("t").collect()] == [(0.0, 100.0), (2.0, 100.0)]
