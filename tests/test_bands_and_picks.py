"""Bands between nested hulls, and the last picks of stations."""

from stratalite.operators import catalog, joining, reports


def test_bands_between_hulls(spark):
    square = lambda a, level: [(float(x), float(y), level) for x in (-a, a) for y in (-a, a)]
    p = spark.createDataFrame([*square(10, 2), *square(5, 4), *square(2, 6), (0.0, 0.0, 6), (1.0, 1.0, 8), (None, 1.0, 2)], "x double, y double, intensity int")
    bands = reports.intensity_bands(reports.intensity_hulls(p, [2, 4, 6, 8]))
    rings = {r["level"]: r["rings"] for r in bands.collect()}
    assert {k: len(v) for k, v in rings.items()} == {2.0: 2, 4.0: 2, 6.0: 1} and all(v[0] == v[-1] for r in rings.values() for v in r)
    places = spark.createDataFrame([(1, 0.5, 0.2), (2, 3.0, 0.0), (3, 7.0, -7.0), (4, 11.0, 0.0)], "id int, x double, y double")
    met = joining.points_in_polygons(places, bands.withColumnRenamed("level", "polygon"), 4.0)
    assert {(r["id"], r["polygon"]) for r in met.collect()} == {(1, 6.0), (2, 4.0), (3, 2.0)}
    assert reports.intensity_bands(reports.intensity_hulls(p.where("false"), [2, 4])).count() == 0


def test_last_picks(spark):
    rows = [(1, "A", "P ", 1.0, 0, 1), (1, "A", "P", 2.0, 9, 5), (1, "A", "P", 3.0, None, 2), (1, "A", " S", 6.0, 1, 3), (1, "A", "S", 7.0, 1, 3), (1, "B", "P", 1.0, 0, 1), (1, "C", "PN", 1.0, 0, 1), (1, "C", "S", 4.0, 0, 1), (2, "A", "P", None, 0, 1), (2, "A", "S", 5.0, 0, 1), (None, "A", "P", 5.0, 0, 1)]
    df = spark.createDataFrame(rows, "event int, station string, phase string, time double, weight int, o int")
    assert [tuple(r) for r in catalog.last_picks(df, "o").collect()] == [(1, "A", 3.0, 7.0)]
