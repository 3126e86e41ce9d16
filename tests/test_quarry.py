"""Removal of blasts against every pair, on crowds, shared places and ties."""

import numpy as np
import pytest

from stratalite.operators import catalog, joining


def _plain(rows, k, radius, ratio, days=6):
    known = [r for r in rows if r[1] is not None and r[2] is not None and r[1] == r[1]]
    gone = set()
    for _, lat, lon, _ in known:
        near = sorted(((lon - o[2]) * (lon - o[2]) + (lat - o[1]) * (lat - o[1]), o[0], o[3] is not None and 9 <= o[3] <= 15) for o in known)[:k]
        d = sum(n[2] for n in near)
        if len(near) == k and near[-1][0] <= radius * radius and d * (24 - days) / ((k - d or 0.00001) * days) > ratio:
            gone |= {n[1] for n in near if n[2]}
    return sorted(r[0] for r in rows if r[0] not in gone)


@pytest.mark.parametrize(("tile", "matrix"), [(8, 2_000_000), (1, 1)])
def test_blasts_by_every_pair_without_pairs_of_rows(spark, monkeypatch, tile, matrix):
    g = np.random.default_rng(8)
    places = [*g.uniform(0, 0.05, (150, 2)), *g.uniform(-1, 1, (150, 2)), *(g.integers(0, 6, (150, 2)) / 50.0 - 0.5), *[(0.7, 0.7)] * 40]
    rows = [(n, float(a), float(b), int(h)) for n, ((a, b), h) in enumerate(zip(places, g.choice([2, 8, 9, 12, 15, 16], len(places)), strict=True))]
    rows += [(900, None, 0.1, 12), (901, float("nan"), 0.1, 12), (902, 0.01, 0.02, None)]
    want = _plain(rows, 10, 0.2, 1.5)
    assert 3 < len(rows) - len(want) < len(rows) - 100
    monkeypatch.setattr(joining, "within", None)
    monkeypatch.setattr(catalog, "TILE", tile)
    monkeypatch.setattr(catalog, "MATRIX", matrix)
    df = spark.createDataFrame(rows, "event long, lat double, lon double, hour int")
    assert sorted(r.event for r in catalog.quarry_blasts(df, (9, 15), 10, 0.2, 1.5, 0.1).collect()) == want


def test_no_events_and_few(spark):
    df = spark.createDataFrame([("a", 0.0, 0.0, 12), ("b", 0.0, 0.0, 12), ("c", 0.1, 0.0, 3)], "event string, lat double, lon double, hour int")
    assert sorted(r.event for r in catalog.quarry_blasts(df, (9, 15)).collect()) == ["a", "b", "c"]
    assert [r.event for r in catalog.quarry_blasts(df, (9, 15), k=2).collect()] == ["c"]
    assert catalog.quarry_blasts(df.where("false"), (9, 15)).count() == 0
