"""Clustering and transforms against numpy and clear cases."""

import math
import random

import numpy as np
import pytest

from stratalite.operators import learning

BANDS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def blobs(spark):
    draw = random.Random(3)
    rows = []
    for k in range(600):
        n = k % 3
        rows.append((k // 25, k % 25, n, 10.0 * n + draw.gauss(0, 1), -5.0 * n + draw.gauss(0, 0.5), draw.gauss(0, 2)))
    return spark.createDataFrame(rows, "row int, col int, truth int, a double, b double, c double").cache()


def agrees(df):
    pairs = {(r.truth, r.label) for r in df.groupBy("truth", "label").count().collect()}
    return len(pairs) == 3 and len({t for t, _ in pairs}) == 3 and len({n for _, n in pairs}) == 3


def test_clusters(blobs):
    assert agrees(learning.clusters(blobs, BANDS, 3)) and agrees(learning.clusters(blobs, BANDS[:2], 3, "bisecting", "robust"))
    assert agrees(learning.crisp_means(blobs, BANDS, 3)) and agrees(learning.crisp_means(blobs, BANDS, 3, "mahalanobis"))
    fuzzy = learning.fuzzy_means(blobs, BANDS, 3).cache()
    assert agrees(fuzzy) and fuzzy.where("abs(u1 + u2 + u3 - 1) > 1e-9 OR entropy < 0 OR entropy > 1").count() == 0
    r = learning.compactness(fuzzy, BANDS, 3).first()
    assert 0 < r.xie_beni < 0.3 and 0 < r.class_entropy < 0.5


def test_diagonal_from_constant(spark):
    cells = spark.createDataFrame([(r, c, float(r == c), 1.0) for r in range(3) for c in range(3)], "row int, col int, i double, k double")
    for out in (learning.clusters(cells, ["i", "k"], 2), learning.crisp_means(cells, ["i", "k"], 2), learning.fuzzy_means(cells, ["i", "k"], 2)):
        by = {}
        for r in out.collect():
            by.setdefault(r.label, set()).add(r.row == r.col)
        assert len(by) == 2 and all(len(v) == 1 for v in by.values())


def test_components(blobs):
    data = np.array([[r.a, r.b, r.c] for r in blobs.collect()])
    out, shares = learning.principal_components(blobs, BANDS)
    values, axes = np.linalg.eigh(np.cov(data.T))
    assert np.allclose(shares, values[::-1] / values.sum())
    got = np.array([[r.pc1, r.pc2, r.pc3] for r in out.orderBy("row", "col").collect()])
    assert np.allclose(np.abs(got), np.abs((data - data.mean(0)) @ axes[:, ::-1]))
    back = np.array([[r.a, r.b, r.c] for r in learning.reconstruct(out, blobs, BANDS, 3).orderBy("row", "col").collect()])
    assert np.allclose(back, data)
    mnf, ratios = learning.noise_fractions(blobs, BANDS)
    m = np.array([[r.mnf1, r.mnf2, r.mnf3] for r in mnf.collect()])
    assert ratios == sorted(ratios, reverse=True) and np.allclose(np.cov(m.T), np.diag(ratios), atol=1e-6 * max(ratios))


def test_classifiers(blobs):
    cells = blobs.selectExpr("*", "concat('class ', truth) AS name")
    for how in ("tree", "forest", "vectors"):
        out = learning.classify(cells.where("col % 2 = 0"), cells, BANDS, "name", how)
        assert out.where("found = name").count() > 0.97 * 600, how


def test_empty_class_takes_the_farthest(spark):
    cells = spark.createDataFrame([(float(v),) for v in (0, 1, 2, 100)], "a double")
    out = {r.a: r.label for r in learning.crisp_means(cells, ["a"], 2, centres=[[1.0], [-1e6]]).collect()}
    assert out[100.0] not in (out[0.0], out[1.0], out[2.0]) and math.isclose(len(set(out.values())), 2)
