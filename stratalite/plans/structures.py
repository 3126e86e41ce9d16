"""Queries on lines, their directions and cells, map sheets, zones, fault planes, ratios and reflectances."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalite.functions import places, radiometry, ratios
from stratalite.operators import structures

from .registry import query
from .views import CELLS, RASTER, cells, raster, table


def _rounded(df, *names, at=6):
    return df.withColumns({n: F.round(n, at) for n in names})


def vertices(spark, sf_dir):
    """Lines: the items of an order, in their order."""
    t = table(spark, sf_dir, "lineitem")
    return t.groupBy(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("seq")).agg(F.min(F.col("l_quantity").cast("double")).alias("x"), F.min(F.round(F.col("l_discount").cast("double") * 100)).alias("y"))


_SEGMENTS = """vertices AS (SELECT l_orderkey AS line, l_linenumber AS seq, min(CAST(l_quantity AS DOUBLE)) AS x, min(round(CAST(l_discount AS DOUBLE) * 100)) AS y FROM lineitem GROUP BY 1, 2),
segments AS (SELECT line, seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM vertices WINDOW w AS (PARTITION BY line ORDER BY seq) QUALIFY lead(seq) OVER w IS NOT NULL)"""
_ANGLES = f"""{_SEGMENTS}, angles AS (SELECT *, CAST(floor(round(CASE WHEN d < 0 THEN d + 180 ELSE d END, 9)) AS INTEGER) AS angle FROM (SELECT *, CASE WHEN x1 = x2 THEN 90.0 ELSE degrees(atan((y2 - y1) / nullif(x2 - x1, 0))) END AS d FROM segments WHERE x1 <> x2 OR y1 <> y2))"""


@query("segment_angles", f"WITH {_ANGLES} SELECT line, seq, angle FROM angles")
def segment_angles(spark, sf_dir):
    return structures.angles(structures.segments(vertices(spark, sf_dir))).select("line", "seq", "angle")


_AZIMUTHS = f"""{_SEGMENTS}, t AS (SELECT line, atan2(x2 - x1, y2 - y1) AS a, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS l FROM segments),
z AS (SELECT line, l, CASE WHEN b > pi() THEN b - pi() ELSE b END AS a FROM (SELECT line, l, CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END AS b FROM t))"""


@query("rose_of_lines", f"""WITH {_AZIMUTHS}, m AS (SELECT sum(a * l) / sum(l) AS a FROM z GROUP BY line HAVING sum(l) > 0), n AS (SELECT CAST(least(floor(round(a / (pi() / 12), 9)), 11) AS INTEGER) AS bin, count(*) AS n FROM m GROUP BY 1)
SELECT bin, round(0.01 * max(n) OVER () * sqrt(100 * n / max(n) OVER ()), 6) AS radius FROM n""")
def rose_of_lines(spark, sf_dir):
    return _rounded(structures.rose(vertices(spark, sf_dir), 12, equal_area=True), "radius")


@query("rose_of_segments", f"""WITH {_AZIMUTHS} SELECT CAST(least(floor(round(a / (pi() / 18), 9)), 17) AS INTEGER) AS bin, round(sum(l), 4) AS radius FROM z WHERE l > 0 GROUP BY 1""")
def rose_of_segments(spark, sf_dir):
    return _rounded(structures.rose(vertices(spark, sf_dir), 18, "segment"), "radius", at=4)


@query("extended_lines", f"""WITH {_SEGMENTS}, e AS (SELECT *, CASE WHEN lag(seq) OVER w IS NULL THEN lead(x) OVER w WHEN lead(seq) OVER w IS NULL THEN lag(x) OVER w END AS bx, CASE WHEN lag(seq) OVER w IS NULL THEN lead(y) OVER w WHEN lead(seq) OVER w IS NULL THEN lag(y) OVER w END AS by_ FROM vertices WINDOW w AS (PARTITION BY line ORDER BY seq))
SELECT line, seq, round(CASE WHEN bx IS NULL THEN x ELSE x + 5 * cos(atan2(y - by_, x - bx)) END, 6) AS x, round(CASE WHEN bx IS NULL THEN y ELSE y + 5 * sin(atan2(y - by_, x - bx)) END, 6) AS y FROM e""")
def extended_lines(spark, sf_dir):
    return _rounded(structures.extended(vertices(spark, sf_dir), 5.0), "x", "y")


_RESAMPLED = f"""{_SEGMENTS}, l AS (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len FROM segments), c AS (SELECT *, sum(len) OVER (PARTITION BY line ORDER BY seq) AS upto, sum(len) OVER (PARTITION BY line) AS total FROM l),
n AS (SELECT *, greatest(1, round_even(total / 7, 0)) AS n FROM c WHERE total > 0 AND len > 0),
k AS (SELECT *, unnest(generate_series(CAST(ceil(round((upto - len) * n / total, 9)) AS BIGINT), CAST(CASE WHEN round(upto * n / total, 9) >= n THEN n ELSE ceil(round(upto * n / total, 9)) - 1 END AS BIGINT))) AS k FROM n),
resampled AS (SELECT line, CAST(k AS INTEGER) AS k, x1 + (k * total / n - (upto - len)) / len * (x2 - x1) AS x, y1 + (k * total / n - (upto - len)) / len * (y2 - y1) AS y FROM k)"""


@query("resampled_lines", f"WITH {_RESAMPLED} SELECT line, k, round(x, 6) AS x, round(y, 6) AS y FROM resampled")
def resampled_lines(spark, sf_dir):
    return _rounded(structures.resampled(vertices(spark, sf_dir), 7.0), "x", "y")


@query("profile_samples", f"""WITH {_RESAMPLED}, {RASTER} SELECT line, k, round(value, 6) AS value FROM resampled LEFT JOIN raster ON "row" = floor(round(y, 7)) AND col = floor(round(x, 7))""")
def profile_samples(spark, sf_dir):
    p = structures.resampled(vertices(spark, sf_dir), 7.0).withColumns({n: F.round(n, 7) for n in ("x", "y")})
    p = p.withColumns({"row": F.floor("y").cast("int"), "col": F.floor("x").cast("int")})
    return _rounded(p.join(raster(spark, sf_dir), ["row", "col"], "left").select("line", "k", "value"), "value")


_TOUCHED = f"""{_ANGLES}, o AS (SELECT line, seq, angle, least(x1, x2) AS xa, greatest(x1, x2) AS xb, CASE WHEN x1 > x2 THEN y2 ELSE y1 END AS ya, CASE WHEN x1 > x2 THEN y1 ELSE y2 END AS yb FROM angles),
oc AS (SELECT *, unnest(generate_series(CAST(floor(xa / 4) AS BIGINT), CAST(floor(xb / 4) AS BIGINT))) AS c FROM o),
oy AS (SELECT *, CASE WHEN xb > xa THEN ya + (greatest(xa, c * 4.0::DOUBLE) - xa) * (yb - ya) / nullif(xb - xa, 0) ELSE ya END AS p, CASE WHEN xb > xa THEN ya + (least(xb, (c + 1) * 4.0::DOUBLE) - xa) * (yb - ya) / nullif(xb - xa, 0) ELSE yb END AS q FROM oc),
touched AS (SELECT line, seq, angle, CAST(c AS INTEGER) AS col, CAST(unnest(generate_series(CAST(floor(least(p, q) / 4) AS BIGINT), CAST(floor(greatest(p, q) / 4) AS BIGINT))) AS INTEGER) AS r FROM oy)"""
_AROUND = f"""{_TOUCHED}, d AS (SELECT DISTINCT r, col, angle FROM touched), b AS (SELECT min(r) AS r0, max(r) AS r1, min(col) AS c0, max(col) AS c1, count(*) AS total FROM d),
s AS (SELECT CAST(r + i AS INTEGER) AS "row", CAST(col + j AS INTEGER) AS col, angle, total FROM d, b, range(-1, 2) t(i), range(-1, 2) u(j) WHERE r + i BETWEEN r0 AND r1 AND col + j BETWEEN c0 AND c1)"""


@query("touched_cells", f"""WITH {_TOUCHED} SELECT r AS "row", col, count(*) AS n FROM touched GROUP BY 1, 2""")
def touched_cells(spark, sf_dir):
    t = structures.touched(structures.angles(structures.segments(vertices(spark, sf_dir))), 4.0)
    return t.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))


@query("direction_diversity", f"""WITH {_AROUND}, p AS (SELECT "row", col, angle, 100 * count(*) / max(total) AS p FROM s GROUP BY 1, 2, 3) SELECT "row", col, round(-sum(p * ln(p)), 6) AS value FROM p GROUP BY 1, 2""")
def direction_diversity(spark, sf_dir):
    return _rounded(structures.direction_diversity(vertices(spark, sf_dir), 4.0), "value")


@query("circular_statistics", f"""WITH {_AROUND}, m AS (SELECT "row", col, count(*) AS n, sum(cos(radians(angle))) AS c1, sum(sin(radians(angle))) AS s1, sum(cos(2 * radians(angle))) AS c2, sum(sin(2 * radians(angle))) AS s2 FROM s GROUP BY 1, 2)
SELECT "row", col, round(1 - sqrt(c1 * c1 + s1 * s1) / n, 6) AS variance, round((1 - atan2(s2 / n, c2 / n)) / (2 * (c1 * c1 + s1 * s1) / n / n), 5) AS dispersion FROM m""")
def circular_statistics(spark, sf_dir):
    return structures.circular_statistics(vertices(spark, sf_dir), 4.0).select("row", "col", F.round("variance", 6).alias("variance"), F.round("dispersion", 5).alias("dispersion"))


@query("blanked_cells", f"""WITH {RASTER}, p AS (SELECT "row", col FROM raster WHERE value > 42000) SELECT "row", col, round(value, 6) AS value FROM raster r WHERE EXISTS (SELECT 1 FROM p WHERE power(p."row" - r."row", 2) + power(p.col - r.col, 2) <= 6.25)""")
def blanked_cells(spark, sf_dir):
    r = raster(spark, sf_dir)
    return _rounded(structures.blanked(r, r.where("value > 42000"), 2.5).select("row", "col", "value"), "value")


@query("line_spacing", f"WITH {_SEGMENTS} SELECT round(avg(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)), 6) AS spacing FROM segments")
def line_spacing(spark, sf_dir):
    return _rounded(structures.spacing(vertices(spark, sf_dir)), "spacing")


@query("best_candidate", """SELECT l_suppkey AS node, arg_min(l_linenumber, (CAST(l_quantity AS DOUBLE), abs(CAST(l_discount AS DOUBLE) - 0.05), l_linenumber)) AS candidate FROM lineitem GROUP BY 1""")
def best_candidate(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_linenumber").alias("candidate"), F.col("l_quantity").cast("double").alias("d"), (F.col("l_discount").cast("double") - 0.05).alias("b"))
    return structures.best_candidate(p.select("node", "d", "b", "candidate"), ["node"], "d", "b").select("node", "candidate")


@query("distance_to_segments", f"""WITH {_SEGMENTS} SELECT line, seq, round(sqrt((25 - (x1 + t * dx)) ** 2 + (5 - (y1 + t * dy)) ** 2), 6) AS distance FROM
(SELECT *, greatest(0, least(1, coalesce(((25 - x1) * dx + (5 - y1) * dy) / nullif(dx * dx + dy * dy, 0), 0))) AS t FROM (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM segments))""")
def distance_to_segments(spark, sf_dir):
    d = places.distance_to_segment(F.lit(25.0), F.lit(5.0), *map(F.col, ("x1", "y1", "x2", "y2")))
    return _rounded(structures.segments(vertices(spark, sf_dir)).select("line", "seq", d.alias("distance")), "distance")


_SHEET = "CAST(22 + c_custkey % 13 AS VARCHAR) || CAST(16 + c_custkey % 17 AS VARCHAR) || substr('ABCD', 1 + c_custkey % 4, CASE WHEN c_custkey % 3 > 0 THEN 1 ELSE 0 END) || substr('ABCD', 1 + c_custkey % 4, CASE WHEN c_custkey % 3 = 2 THEN 1 ELSE 0 END)"


@query("sheet_bounds", f"""WITH s AS (SELECT c_custkey AS id, {_SHEET} AS sheet FROM customer), q AS (SELECT *, substr(sheet, 5, 1) AS a, substr(sheet, 6, 1) AS b, CASE length(sheet) WHEN 4 THEN 1.0 WHEN 5 THEN 0.5 ELSE 0.25 END AS h FROM s),
o AS (SELECT id, h, CAST(-(CAST(substr(sheet, 1, 2) AS DOUBLE) + CASE WHEN a IN ('C', 'D') THEN 0.5 ELSE 0 END + CASE WHEN b IN ('C', 'D') THEN 0.25 ELSE 0 END) AS DOUBLE) AS north, CAST(CAST(substr(sheet, 3, 2) AS DOUBLE) + CASE WHEN a IN ('B', 'D') THEN 0.5 ELSE 0 END + CASE WHEN b IN ('B', 'D') THEN 0.25 ELSE 0 END AS DOUBLE) AS west FROM q)
SELECT id, west, CAST(north - h AS DOUBLE) AS south, CAST(west + CASE WHEN h = 1 THEN 2 ELSE h END AS DOUBLE) AS east, north FROM o""")
def sheet_bounds(spark, sf_dir):
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.expr(_SHEET.replace("VARCHAR", "STRING").replace("c_custkey % 4", "CAST(c_custkey % 4 AS INT)")).alias("sheet"))
    return s.select("id", *[c.alias(n) for n, c in places.sheet_bounds(F.col("sheet")).items()])


@query("southern_zones", """SELECT c_custkey AS id, CAST(CASE WHEN 32590 + c_custkey % 90 BETWEEN 32600 AND 32660 THEN 32690 + c_custkey % 90 ELSE 32590 + c_custkey % 90 END AS BIGINT) AS epsg, CAST(CASE WHEN 32590 + c_custkey % 90 BETWEEN 32600 AND 32660 THEN c_custkey + 10000000 ELSE c_custkey END AS DOUBLE) AS northing FROM customer""")
def southern_zones(spark, sf_dir):
    key = F.col("c_custkey")
    found = places.utm_to_south(32590 + key % 90, key.cast("double"))
    return table(spark, sf_dir, "customer").select(key.alias("id"), found["epsg"].cast("long").alias("epsg"), found["northing"].cast("double").alias("northing"))


@query("reprojected_and_back", """SELECT c_custkey AS id, CAST(round(CAST(c_custkey % 700 AS DOUBLE) / 10 - 35, 6) AS DOUBLE) AS lat, CAST(round(27 + CAST(c_custkey % 61 AS DOUBLE) / 10 - 3, 6) AS DOUBLE) AS lon FROM customer""")
def reprojected_and_back(spark, sf_dir):
    """Places to the projected plane of their zone and back again."""
    key = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(key.alias("id"), ((key % 700).cast("double") / 10 - 35).alias("lat"), (27 + (key % 61).cast("double") / 10 - 3).alias("lon"))
    p = p.select("id", *[c.alias(n) for n, c in places.transverse_mercator(F.col("lat"), F.col("lon"), 27.0).items()])
    back = places.from_transverse_mercator(F.col("easting"), F.col("northing"), 27.0)
    return p.select("id", *[(F.round(c, 6) + 0.0).alias(n) for n, c in back.items()])


_PLANE = "p AS (SELECT l_orderkey AS id, l_linenumber AS k, radians(l_orderkey % 359 + 0.5 + 90) AS s, radians(5.5 + l_linenumber * 11) AS d, radians(CAST(l_suppkey % 359 AS DOUBLE) - 179.5) AS r FROM lineitem)"


@query("auxiliary_planes", f"""WITH {_PLANE}, v AS (SELECT *, -cos(r) * cos(s) - sin(r) * sin(s) * cos(d) AS e, cos(r) * sin(s) - sin(r) * cos(s) * cos(d) AS n, sin(r) * sin(d) AS u FROM p),
t AS (SELECT *, CASE WHEN u < 0 THEN -1 ELSE 1 END AS t FROM v), w AS (SELECT id, k, degrees(atan2(t * e, t * n)) - 90 AS strike, degrees(atan2(sqrt(n * n + e * e), t * u)) AS dip, t * (e * cos(s) * sin(d) - n * sin(s) * sin(d)) / sqrt(n * n + e * e) AS c FROM t)
SELECT id, k, round(CASE WHEN strike < 0 THEN strike + 360 ELSE strike END, 6) AS strike, round(dip, 6) AS dip, round(degrees(acos(greatest(-1, least(1, c)))), 5) AS rake FROM w""")
def auxiliary_planes(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    found = places.auxiliary_plane(F.col("l_orderkey") % 359 + 0.5, 5.5 + F.col("l_linenumber") * 11, (F.col("l_suppkey") % 359).cast("double") - 179.5)
    return t.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), *[F.round(c, 5 if n == "rake" else 6).alias(n) for n, c in found.items()])


@query("bits_and_indices", """SELECT l_orderkey AS id, l_linenumber AS k, (l_orderkey & 4) <> 0 AS third, l_orderkey | 16 AS fifth, CAST(l_orderkey % 100 AS BIGINT) AS "row", CAST(l_orderkey // 100 % 20 AS BIGINT) AS col, CAST(l_orderkey // 2000 AS BIGINT) AS layer, CAST(ceil(round(log2(l_orderkey + 1), 12)) AS INTEGER) AS power,
CAST(l_orderkey // 2000 * 2000 + l_orderkey // 100 % 20 * 100 + l_orderkey % 100 AS BIGINT) AS back FROM lineitem""")
def bits_and_indices(spark, sf_dir):
    n = F.col("l_orderkey")
    place = places.cell_place(n, 100, 20)
    return table(spark, sf_dir, "lineitem").select(
        n.alias("id"), F.col("l_linenumber").alias("k"), places.bit_is_set(n, 2).alias("third"), places.with_bit(n, 4).alias("fifth"), *[c.cast("long").alias(a) for a, c in place.items()],
        places.next_power(n + 1).alias("power"), places.cell_index(*[c.cast("long") for c in place.values()], 100, 20).cast("long").alias("back"),
    )


@query("boxes_in_bounds", """SELECT l_orderkey AS id, l_linenumber AS k, 10.0 < CAST(l_quantity AS DOUBLE) + 5 AND 30.0 > CAST(l_quantity AS DOUBLE) AND 2.0 < round(CAST(l_discount AS DOUBLE) * 100) + 1 AND 8.0 > round(CAST(l_discount AS DOUBLE) * 100) AS inside FROM lineitem""")
def boxes_in_bounds(spark, sf_dir):
    x, y = F.col("l_quantity").cast("double"), F.round(F.col("l_discount").cast("double") * 100)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), places.overlaps(x, y, x + 5, y + 1, (10.0, 2.0, 30.0, 8.0)).alias("inside"))


_BANDS = {f"B{i}": f"price / 10000 * {1 + 0.1 * i} + qty * {0.5 + 0.03 * i} + tax * {i + 1}" for i in range(15)}
_FORMULAS = [f for f, _ in ratios.for_sensor("ASTER")]
_LANDSAT = [f for f, _ in ratios.for_sensor("Landsat 8 and 9 (OLI)") if "," not in f]


def _ratio_sql(formulas):
    bands = ", ".join(f"CAST({e} AS DOUBLE) AS {b}" for b, e in _BANDS.items())
    return f"""WITH {CELLS}, b AS (SELECT scene, "row", col, {bands} FROM cells) SELECT scene, "row", col, {", ".join(f"round(CAST({f} AS DOUBLE), 6) AS r{i}" for i, f in enumerate(formulas, 1))} FROM b"""


def _banded(spark, sf_dir):
    return cells(spark, sf_dir).select("scene", "row", "col", *[F.expr(e).cast("double").alias(b) for b, e in _BANDS.items()])


@query("ratios_aster", _ratio_sql(_FORMULAS))
def ratios_aster(spark, sf_dir):
    out = ratios.with_ratios(_banded(spark, sf_dir), "ASTER").drop(*_BANDS)
    return _rounded(out, *[c for c in out.columns if c.startswith("r") and c != "row"])


@query("ratios_landsat", _ratio_sql(_LANDSAT))
def ratios_landsat(spark, sf_dir):
    out = ratios.with_ratios(_banded(spark, sf_dir), "Landsat 8 and 9 (OLI)").drop(*_BANDS)
    return _rounded(out, *[c for c in out.columns if c.startswith("r") and c != "row"])


@query("wavelength_index", f"""WITH {CELLS} SELECT scene, "row", col, round((qty - tax) / (qty + tax), 6) AS value FROM cells""")
def wavelength_index(spark, sf_dir):
    """A formula over wavelengths, on the bands nearest to them."""
    formula = ratios.by_wavelength("(R860-R650)/(R860+R650)", {"price": 480.0, "tax": 655.0, "qty": 842.0})
    return cells(spark, sf_dir).select("scene", "row", "col", F.round(ratios.ratio(formula), 6).alias("value"))


_LAND = {"ndvi": "tax * 10 - 0.1", "ndwi": "qty / 10 - 0.3", "swir": "price / 50000", "bsi": "tax * 8"}


@query("landslide_colours", f"""WITH {CELLS}, x AS (SELECT scene, "row", col, {", ".join(f"{e} AS {n}" for n, e in _LAND.items())} FROM cells)
SELECT scene, "row", col, round(CAST(CASE WHEN ndwi > 0.15 OR ndvi > 0.25 THEN 0 WHEN swir > 0.8 OR ndvi < 0.15 THEN 1.5 ELSE 3.5 * bsi END AS DOUBLE), 6) AS red, round(CAST(CASE WHEN ndwi > 0.15 THEN 0.2 WHEN ndvi > 0.25 THEN 0.2 * ndvi WHEN swir > 0.8 OR ndvi < 0.15 THEN 0.7 ELSE 0.3 END AS DOUBLE), 6) AS green, round(CAST(CASE WHEN ndwi > 0.15 THEN ndwi WHEN ndvi > 0.25 THEN 0 WHEN swir > 0.8 OR ndvi < 0.15 THEN -1 ELSE 0 END AS DOUBLE), 6) AS blue FROM x""")
def landslide_colours(spark, sf_dir):
    found = ratios.landslide_colours(*[F.expr(e) for e in _LAND.values()])
    return cells(spark, sf_dir).select("scene", "row", "col", *[F.round(c, 6).alias(n) for n, c in found.items()])


_SUN = "1.00014 - 0.01671 * cos(radians(357.529 + 0.98560028 * {d})) - 0.00014 * cos(2 * radians(357.529 + 0.98560028 * {d}))"


@query("aster_at_sensor", f"""WITH d AS (SELECT *, {_SUN.format(d="(dayofyear(l_shipdate) - 0.75)")} AS e FROM lineitem)
SELECT l_orderkey AS id, l_linenumber AS k, round(pi() * ((CAST(l_quantity AS DOUBLE) - 1) * 0.676) * e * e / (1848 * cos(radians(90 - (40.0 + l_linenumber)))), 8) AS reflectance, round(1735.337945 / ln(3040.136402 / ((CAST(l_quantity AS DOUBLE) + 0.5 - 1) * 0.676) + 1), 5) AS kelvin FROM d""")
def aster_at_sensor(spark, sf_dir):
    q, day, sun, gain = F.col("l_quantity").cast("double"), F.dayofyear("l_shipdate"), 40.0 + F.col("l_linenumber"), F.lit(0.676)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), F.round(radiometry.aster(q, 1, gain, sun, day), 8).alias("reflectance"), F.round(radiometry.aster(q + 0.5, 10, gain, sun, day), 5).alias("kelvin"))


@query("calibrated_reflectance", f"""WITH d AS (SELECT *, date_diff('day', DATE '2000-01-01', CAST(l_shipdate AS DATE)) - 0.25 AS days FROM lineitem), e AS (SELECT *, {_SUN.format(d="days")} AS e FROM d)
SELECT l_orderkey AS id, l_linenumber AS k, CAST(days AS DOUBLE) AS days, round(CAST(l_quantity AS DOUBLE) * (e * e * pi() / (1559.04 * cos(radians(90 - (40.0 + l_linenumber)))) * 0.01 / 0.0543), 8) AS reflectance FROM e""")
def calibrated_reflectance(spark, sf_dir):
    days = radiometry.days_since_2000(F.year("l_shipdate"), F.month("l_shipdate"), F.dayofmonth("l_shipdate"), F.lit(6.0))
    value = radiometry.reflectance(F.col("l_quantity").cast("double"), 0.01, 0.0543, 1559.04, 40.0 + F.col("l_linenumber"), days)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), days.cast("double").alias("days"), F.round(value, 8).alias("reflectance"))
