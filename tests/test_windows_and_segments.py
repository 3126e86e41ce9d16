"""Moving windows on blocks, box counting, and segmentation against plain versions."""

import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stratalite.operators import moving, segments, stencil


def cells_of(spark, v, low=(0, 0)):
    return spark.createDataFrame([(r + low[0], c + low[1], None if np.isnan(x) else float(x)) for (r, c), x in np.ndenumerate(v)], "row int, col int, value double")


@pytest.fixture(scope="module")
def field():
    v = np.random.default_rng(1).normal(size=(19, 23)).round(2) + 100
    v[3, 4] = v[10, 11] = np.nan
    return v


@pytest.mark.parametrize("size", [6, 64])
def test_means_and_medians(spark, field, size):
    cells = cells_of(spark, field, (-5, 7))
    for radius in (1, 3):
        mean = {(r.row + 5, r.col - 7): r.value for r in moving.window_mean(cells, radius, size=size).collect()}
        some = {(r.row + 5, r.col - 7): r.value for r in moving.window_mean(cells, radius, whole=False, size=size).collect()}
        median = {(r.row + 5, r.col - 7): r.value for r in moving.window_median(cells, stencil.offsets(2 * radius + 1), size=size).collect()}
        for r, c in np.ndindex(field.shape):
            w = field[max(0, r - radius) : r + radius + 1, max(0, c - radius) : c + radius + 1]
            if w.size == (2 * radius + 1) ** 2 and not np.isnan(w).any():
                assert abs(mean.pop((r, c)) - w.mean()) < 1e-9
            assert abs(some[r, c] - np.nanmean(w)) < 1e-9 and abs(median[r, c] - np.nanmedian(w)) < 1e-12
        assert mean == {}
    assert moving.window_mean(cells.where("false"), 2).count() == 0


def plain_dimension(w):
    """By the bins of a histogram: the last one is closed and ends at the last whole step."""
    n = []
    for side in (1, 2):
        edges = np.hstack([[0], np.arange(0, len(w), side)])
        h = np.histogram2d(*np.nonzero(w), bins=[edges, edges])[0] if w.any() else np.zeros((1, 1))
        n.append((h > 0).sum())
    return None if n[0] == 0 else -np.polyfit(np.log([1, 2]), np.log(n), 1)[0]


@pytest.mark.parametrize("window", [3, 5, 9])
def test_box_counting(spark, window):
    v = (np.random.default_rng(window).random((16, 15)) < 0.12).astype(float)
    v[0:6, 0:6] = 0
    got = {(r.row, r.col): r.value for r in moving.fractal_dimension(cells_of(spark, v), window, size=7).collect()}
    w = window // 2
    want = {(r, c): d for r in range(w, 16 - w) for c in range(w, 15 - w) if (d := plain_dimension(v[r - w : r + w + 1, c - w : c + w + 1] > 0)) is not None}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def plain_segments(v, scale, colour, compact):
    """Rounds of mutual best pairs on sets of cells."""
    name = lambda r, c: r * 2**31 + c
    regions = {name(r, c): [(r, c)] for r, c in np.ndindex(v.shape) if not np.isnan(v[r, c])}

    def spread(cells):
        x = np.array([v[p] for p in cells])
        return len(x) * x.std()

    def outline(cells):
        s = set(cells)
        return sum((r + i, c + j) not in s for r, c in s for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))

    def box(cells):
        r, c = zip(*cells, strict=True)
        return 2 * (max(r) - min(r) + max(c) - min(c) + 2)

    def rise(a, b):
        ca, cb = regions[a], regions[b]
        out = spread(ca + cb) - spread(ca) - spread(cb)
        if colour >= 1:
            return out
        n1, n2, l1, l2, l = len(ca), len(cb), outline(ca), outline(cb), outline(ca + cb)
        smooth = (n1 + n2) * l / box(ca + cb) - (n1 * l1 / box(ca) + n2 * l2 / box(cb))
        dense = (n1 + n2) ** 0.5 * l - (n1**0.5 * l1 + n2**0.5 * l2)
        return colour * out + (1 - colour) * (compact * dense + (1 - compact) * smooth)

    def hashed(a, b):
        h = xxhash.xxh64_intdigest(struct.pack("<q", b), seed=xxhash.xxh64_intdigest(struct.pack("<q", a), seed=42))
        return h - 2**64 if h >= 2**63 else h

    if colour >= 1:
        while pair := next(((a, b) for a in regions for b in regions if a < b and any(max(abs(p[0] - q[0]), abs(p[1] - q[1])) == 1 and v[p] == v[q] for p in regions[a] for q in regions[b])), None):
            regions[pair[0]] += regions.pop(pair[1])
    while True:
        owner = {p: k for k, cells in regions.items() for p in cells}
        edges = {tuple(sorted((owner[p], owner[q]))) for p in owner for i in (-1, 0, 1) for j in (-1, 0, 1) if (q := (p[0] + i, p[1] + j)) in owner and owner[p] != owner[q]}
        best = {}
        for a, b in edges:
            key = (round(rise(a, b), 9), hashed(a, b), a, b)
            if key[0] <= scale:
                for k in (a, b):
                    best[k] = min(best.get(k, key), key)
        merges = [k for k in set(best.values()) if best[k[2]] == k == best[k[3]]]
        if not merges:
            return owner
        for *_, a, b in merges:
            regions[a] += regions.pop(b)


@pytest.mark.parametrize(("colour", "scale"), [(1.0, 1.3), (0.6, 2.5)])
def test_segments_by_a_plain_version(spark, colour, scale):
    r, c = np.mgrid[0:8, 0:9]
    v = np.where(c + r < 8, 1.0, 5.0) + np.random.default_rng(3).normal(size=(8, 9)) * 0.4
    v[2:4, 2:5] = 3.0
    v[6, 1] = np.nan
    want = plain_segments(v, scale, colour, 0.5)
    rows = segments.segments(cells_of(spark, v), ["value"], scale, colour).collect()
    assert {(x.row, x.col): x.region for x in rows} == want
    order = sorted(set(want.values()))
    assert 1 < len(order) < 60 and all(x.label == order.index(x.region) + 1 for x in rows)


def test_segments_of_flat_and_empty_images(spark):
    flat = spark.range(400).select((F.col("id") / 20).cast("int").alias("row"), (F.col("id") % 20).cast("int").alias("col"), F.lit(2.0).alias("value"))
    assert segments.segments(flat, ["value"], 1.0).select("region", "label").distinct().collect() == [(0, 1)]
    assert segments.segments(flat.where("false"), ["value"], 1.0).count() == 0
