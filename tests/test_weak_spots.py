"""Quantiles of any doubles, formulas, exact hulls, density clusters, empty tables, small windows."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalite.functions import ratios
from stratalite.functions.formula import formula
from stratalite.operators import density, grid, learning, reports, stats, visibility


def long_of(spark, values, band="v"):
    return spark.createDataFrame([(band, v) for v in values], "band string, value double")


INF = float("inf")


@pytest.mark.parametrize(
    ("values", "probabilities", "want"),
    [
        ([1.0, INF], [0, 1], [1.0, INF]),
        ([-INF, 2.0, INF], [0, 0.5, 1], [-INF, 2.0, INF]),
        ([INF, INF, 1.0], [0.75], [INF]),
        ([-1.7e308, 1.7e308], [0, 0.5, 1], [-1.7e308, 0.0, 1.7e308]),
        ([0.0, 5e-324], [0, 1], [0.0, 5e-324]),
        ([5e-324, 1e-323, 1.5e-323], [0.5], [1e-323]),
        ([-0.0, 0.0, -0.0], [0.5], [0.0]),
        ([float("nan"), None, 3.0], [0.5], [3.0]),
        ([7.0] * 50 + [8.0], [0.5, 1], [7.0, 8.0]),
        ([-3.0, -1e-300, 1e-300, 3.0, 1e300, -1e300], [0.2, 0.4, 0.6], [-3.0, -1e-300, 1e-300]),
    ],
)
def test_quantiles_of_any_doubles(spark, values, probabilities, want):
    assert stats.exact_quantiles(long_of(spark, values), probabilities) == {"v": want}


def test_quantiles_of_many_bands(spark):
    rng = np.random.default_rng(1)
    bands = {b: np.concatenate([rng.normal(size=300) * 10.0 ** rng.integers(-30, 30, 300), rng.integers(-5, 5, 40)]) for b in "abc"}
    long = spark.createDataFrame([(b, float(v)) for b, vs in bands.items() for v in vs], "band string, value double")
    probabilities = [0, 0.01, 0.25, 1 / 3, 0.5, 0.9, 1]
    for bins in (8, 4096):
        got = stats.exact_quantiles(long, probabilities, bins)
        for b, vs in bands.items():
            np.testing.assert_allclose(got[b], np.quantile(vs, probabilities), rtol=1e-12)
    assert stats.exact_quantiles(long.where("false"), [0.5]) == {}


def test_quantile_between_infinities(spark):
    assert math.isnan(stats.exact_quantiles(long_of(spark, [-INF, INF]), [0.5])["v"][0])


# Formulas

BANDS = ["a", "b", "c"]
ROWS = [(4.0, 2.0, 0.0), (-1.0, 0.0, 3.0), (0.0, 0.0, 0.0), (2.5, None, 1.0), (1e3, -7.0, 2.0)]


def plain(text, row):
    """The formula in Python, None where a band is null or something is divided by zero."""
    if any(v is None for n, v in zip(BANDS, row, strict=True) if n in text) or any(row[int(k)] is None for k in range(3) if f"i{k}" in text):
        return None
    names = dict(zip(BANDS, row, strict=True)) | {f"i{k}": v for k, v in enumerate(row)} | {"sqrt": lambda x: math.sqrt(x) if x >= 0 else float("nan"), "abs": abs, "where": lambda c, x, y: x if c else y}
    try:
        return float(eval(text.replace("^", "**").replace("&", " and ").replace("|", " or "), {"__builtins__": {}}, names))
    except ZeroDivisionError:
        return None


FORMULAS = [
    "i0+i1", "sqrt(i0)/i1", "i0**2/i1", "i0/i1/i2", "(i0+sqrt(i1))/(i2-(i2+0))", "a/(b/c)", "(a-b)/(a+b)", "-a**2", "2**-c", "a^2 + b^2", "abs(a)/abs(b-c)*2 - 1", "a if a > b else c / b",
    "where((a > 0) & (b < 3), a/c, b)", "1/(1/(1/a))", "a % 3", "(a/b)**2", "c**-1", "a - -b",
]


@pytest.mark.parametrize("text", FORMULAS)
def test_formulas(spark, text):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(ROWS)], "k int, a double, b double, c double")
    got = {r.k: r.value for r in grid.equation(df, text, BANDS).collect()}
    for k, row in enumerate(ROWS):
        if text.startswith("where") and row == (0.0, 0.0, 0.0):
            continue
        want = plain(text, row)
        if want is None:
            assert got[k] is None or text == "where((a > 0) & (b < 3), a/c, b)", (text, row, got[k])
        else:
            assert got[k] is not None and (math.isclose(got[k], want, rel_tol=1e-12, abs_tol=1e-12) or (math.isnan(got[k]) and math.isnan(want))), (text, row, got[k], want)


@pytest.mark.parametrize("text", ["__import__('os')", "a.b", "d + 1", "i3", "lambda: 1", "[a]", "a +", "'x'", "exec(a)", "sqrt(a, b)", "a[0]", "f'{a}'"])
def test_formulas_refuse(spark, text):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    with pytest.raises(ValueError):
        grid.equation(df, text, BANDS)


def test_ratio_formulas(spark):
    df = spark.createDataFrame([(4.0, 2.0, 0.0)], "B1 double, B2 double, B3 double")
    one = lambda text: df.select(ratios.ratio(text).alias("v")).first().v
    assert one("(B1-B2)/(B1+B2)") == pytest.approx(1 / 3) and one("B1/B3") is None and one("sqrt(B1)/B2") == 1.0 and one("B1/B2/B3") is None and one("(B1/B2)**2/B2") == 2.0
    for sensor in ratios.SENSORS:
        for text, _ in ratios.for_sensor(sensor):
            if "," not in text:
                assert formula(text, lambda n: F.lit(1.0)) is not None


# Hulls


def plain_hull(points):
    """Vertices by trying every edge."""
    p = sorted(set(points))
    out = set()
    for a, b in itertools.permutations(p, 2):
        side = [(b[0] - a[0]) * (q[1] - a[1]) - (b[1] - a[1]) * (q[0] - a[0]) for q in p]
        if min(side) >= 0 and not any(s == 0 and (q[0] - a[0]) * (q[0] - b[0]) + (q[1] - a[1]) * (q[1] - b[1]) > 0 for s, q in zip(side, p, strict=True)):
            out |= {a, b}
    return out or set(p)


def test_hulls_are_exact(spark):
    rng = np.random.default_rng(4)
    points = [(float(x), float(y)) for x, y in rng.integers(-9, 9, (80, 2))]
    df = spark.createDataFrame([(x, y, 5.0) for x, y in points] + [(1.0, None, 5.0)], "x double, y double, intensity double").repartition(6)
    for at_once in (20_000, 12):
        hull = reports.intensity_hulls(df, [3], at_once).first().hull
        assert {(p.x, p.y) for p in hull} == plain_hull(points)
        area = sum(a.x * b.y - b.x * a.y for a, b in zip(hull, hull[1:] + hull[:1], strict=True))
        assert area > 0 and (hull[0].x, hull[0].y) == min((p.x, p.y) for p in hull)
    n = 20_000  # in convex position: every one is a vertex
    circle = spark.range(n).select(F.cos(F.col("id") * 2 * math.pi / n).alias("x"), F.sin(F.col("id") * 2 * math.pi / n).alias("y"), F.lit(4.0).alias("intensity"))
    assert len(reports.intensity_hulls(circle, [4], 3000).first().hull) > 0.999 * n
    assert reports.intensity_hulls(df.where("false"), [3]).count() == 0


# Density clusters


def plain_clusters(points, eps, least):
    """By id: whether core, and the least core id that it is connected with."""
    near = {i: [j for j, q in points.items() if sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) <= eps * eps] for i, p in points.items()}
    core = {i for i in points if len(near[i]) >= least}
    name = {i: i for i in core}
    changed = True
    while changed:
        changed = False
        for i in core:
            low = min(name[j] for j in near[i] if j in core)
            if low < name[i]:
                name[i], changed = low, True
    out = {}
    for i in points:
        hosts = [j for j in near[i] if j in core]
        out[i] = (i in core, name[i] if i in core else name[min(hosts)] if hosts else None)
    return out


@pytest.mark.parametrize(("seed", "d", "n"), [(1, 1, 80), (2, 2, 260), (3, 3, 200)])
def test_density_clusters_by_brute_force(spark, seed, d, n):
    rng = np.random.default_rng(seed)
    spread = np.concatenate([rng.normal(c, 0.35, (n // 4, d)) for c in (0, 1.4, 4)] + [rng.uniform(-2, 6, (n - 3 * (n // 4), d)), np.full((9, d), 2.75)])
    points = {7 * k + 3: tuple(map(float, p)) for k, p in enumerate(spread.round(2))}
    bands = [f"b{k}" for k in range(d)]
    df = spark.createDataFrame([(i, *p) for i, p in points.items()] + [(1, *[None] * d)], "id long, " + ", ".join(f"{b} double" for b in bands)).repartition(5)
    for eps, least in ((0.3, 4), (0.6, 8)):
        want = plain_clusters(points, eps, least)
        rows = density.density_clusters(df, bands, eps, least).collect()
        assert {r.id: (r.core, r.cluster) for r in rows} == want
        order = sorted({c for _, c in want.values() if c is not None})
        assert all(r.label == (0 if r.cluster is None else order.index(r.cluster) + 1) for r in rows)
        assert order


def test_density_of_dense_buckets_and_none(spark):
    """Many equal points are core without a look at their pairs; two dense buckets meet by examples."""
    df = spark.range(6000).select("id", F.when(F.col("id") % 2 == 0, 0.0).otherwise(0.9).alias("x"), F.lit(1.0).alias("y"))
    got = density.density_clusters(df, ["x", "y"], 1.0, 5)
    assert got.groupBy("core", "cluster", "label").count().collect() == [(True, 0, 1, 6000)]
    assert {r.cluster for r in density.density_clusters(df, ["x", "y"], 0.8, 5).select("cluster").distinct().collect()} == {0, 1}
    assert density.density_clusters(df.where("false"), ["x", "y"], 1.0).count() == 0


# Empty tables, small windows


def test_learning_without_cells(spark):
    none = spark.createDataFrame([], "row int, col int, a double, b double")
    for method in ("kmeans", "bisecting"):
        assert learning.clusters(none, ["a", "b"], 3, method).count() == 0
    assert learning.crisp_means(none, ["a", "b"], 2).columns[-1] == "label" and learning.crisp_means(none, ["a", "b"], 2).count() == 0
    fuzzy = learning.fuzzy_means(none, ["a", "b"], 2)
    assert fuzzy.count() == 0 and {"u1", "u2", "label", "entropy"} <= set(fuzzy.columns)
    assert learning.compactness(fuzzy, ["a", "b"], 2).count() == 0


def test_window_of_one(spark):
    """The published case: each cell sees four places, its own in four directions."""
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 1.0), (1, 1, 2.0)], "row int, col int, value double")
    rows = visibility.visibility(df, 1, 1.0).collect()
    assert len(rows) == 4 and all(r.total == 4 and abs(r.deviation - 0.5345) < 1e-4 and abs(r.resultant - 2.6131) < 1e-4 for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.floats(allow_nan=False))
def test_keys_keep_the_order(x):
    import struct

    bits = struct.unpack("<q", struct.pack("<d", x + 0.0))[0]
    key = bits ^ ((1 << 63) - 1) if bits < 0 else bits
    assert stats._value(key) == x
