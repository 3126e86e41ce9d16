"""Queries on rasters: gridding, normalisation, filters on cells and windows, mosaics, change in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalite.operators import grid, stencil, temporal

from .registry import query
from .views import CELLS, POINTS, RASTER, cells, points, raster

_GRID = f"""{POINTS},
g AS (SELECT CAST(floor((y - (SELECT min(y) FROM points)) / 1.0) AS INTEGER) AS "row", CAST(floor((x - (SELECT min(x) FROM points)) / 1.0) AS INTEGER) AS col, avg(z) AS value FROM points GROUP BY 1, 2)"""


def _rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names or ("value",)})


@query("grid_mean_normalise", f"""WITH {_GRID}, s AS (SELECT avg(value) AS m, stddev_pop(value) AS d FROM g)
SELECT "row", col, round((value - m) / nullif(d, 0), 6) AS value FROM g, s""")
def grid_mean_normalise(spark, sf_dir):
    return _rounded(grid.normalise(grid.cell_mean(points(spark, sf_dir), 1.0), "mean"))


@query("normalise_interval", f"""WITH {_GRID}, s AS (SELECT min(value) AS a, max(value) - min(value) AS b FROM g)
SELECT "row", col, round((value - a) / nullif(b, 0), 6) AS value FROM g, s""")
def normalise_interval(spark, sf_dir):
    return _rounded(grid.normalise(grid.cell_mean(points(spark, sf_dir), 1.0), "interval"))


@query("normalise_median", f"""WITH {_GRID}, s AS (SELECT median(value) AS a FROM g), t AS (SELECT median(abs(value - a)) AS b FROM g, s)
SELECT "row", col, round((value - a) / nullif(b, 0), 6) AS value FROM g, s, t""")
def normalise_median(spark, sf_dir):
    return _rounded(grid.normalise(grid.cell_mean(points(spark, sf_dir), 1.0), "median"))


_LEVELS = " ".join(f"""LEFT JOIN (SELECT "row" // {2**k} AS r, col // {2**k} AS c, sum(s) / sum(n) AS v FROM fine GROUP BY 1, 2) l{k} ON l{k}.r = lattice."row" // {2**k} AND l{k}.c = lattice.col // {2**k}""" for k in range(4))


@query("quickgrid_multilevel", f"""WITH {POINTS}, p AS (SELECT * FROM points),
fine AS (SELECT CAST(floor((y - (SELECT min(y) FROM p)) / 0.5) AS INTEGER) AS "row", CAST(floor((x - (SELECT min(x) FROM p)) / 0.5) AS INTEGER) AS col, sum(z) AS s, count(*) AS n FROM p GROUP BY 1, 2),
lattice AS (SELECT CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col FROM (SELECT unnest(range(0, (SELECT max("row") + 1 FROM fine))) AS r) a, (SELECT unnest(range(0, (SELECT max(col) + 1 FROM fine))) AS c) b)
SELECT lattice."row", lattice.col, round(coalesce(l0.v, l1.v, l2.v, l3.v), 4) AS value FROM lattice {_LEVELS}""")
def quickgrid_multilevel(spark, sf_dir):
    return _rounded(grid.quickgrid(points(spark, sf_dir), 0.5), places=4)


@query("histcomp_clip", f"""WITH {RASTER}, s AS (SELECT quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM raster)
SELECT "row", col, round(least(greatest(value, a), b), 6) AS value FROM raster, s""")
def histcomp_clip(spark, sf_dir):
    return _rounded(grid.clip_percentiles(raster(spark, sf_dir), 5, 5))


@query("norm2_range", f"""WITH {RASTER} SELECT "row", col, round(least(greatest((value - 30000) / 10000, 0), 1), 6) AS value FROM raster""")
def norm2_range(spark, sf_dir):
    return _rounded(grid.norm2(raster(spark, sf_dir), 30000, 40000))


@query("norm255_cells", f"""WITH {RASTER}, s AS (SELECT min(value) AS a, max(value) - min(value) AS b FROM raster)
SELECT "row", col, CAST(round_even(254 * (value - a) / b + 1, 0) AS INTEGER) AS value FROM raster, s""")
def norm255_cells(spark, sf_dir):
    return grid.norm255(raster(spark, sf_dir))


@query("histeq_cells", f"""WITH {RASTER}, s AS (SELECT min(value) AS a, max(value) AS b FROM raster),
h AS (SELECT least(floor((value - a) * 32768 / (b - a)), 32767) AS bin, count(*) AS n FROM raster, s GROUP BY 1),
k AS (SELECT bin, sum(coalesce(n, 0)) OVER (ORDER BY bin) AS c FROM (SELECT unnest(range(0, 32768)) AS bin) LEFT JOIN h USING (bin)),
c AS (SELECT bin, 32768.0 * CAST(c - (SELECT min(c) FROM k) AS DOUBLE) / CAST((SELECT max(c) - min(c) FROM k) AS DOUBLE) AS c FROM k),
p AS (SELECT "row", col, greatest(least((value - a) * 32768 / (b - a) - 0.5, 32767), 0) AS place FROM raster, s)
SELECT "row", col, round(lo.c + (hi.c - lo.c) * (place - floor(place)), 4) AS value
FROM p JOIN c lo ON lo.bin = floor(place) JOIN c hi ON hi.bin = least(floor(place) + 1, 32767)""")
def histeq_cells(spark, sf_dir):
    return _rounded(grid.equalise(raster(spark, sf_dir)), places=4)


@query("trim_raster", f"""WITH {RASTER}, m AS (SELECT "row", col, CASE WHEN "row" BETWEEN 2 AND 8 AND col BETWEEN 5 AND 40 THEN value END AS value FROM raster),
s AS (SELECT min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM m WHERE value IS NOT NULL)
SELECT CAST("row" - r0 AS INTEGER) AS "row", CAST(col - c0 AS INTEGER) AS col, round(value, 6) AS value FROM m, s WHERE "row" BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1""")
def trim_raster(spark, sf_dir):
    inside = F.col("row").between(2, 8) & F.col("col").between(5, 40)
    return _rounded(grid.trim(raster(spark, sf_dir).withColumn("value", F.when(inside, F.col("value")))))


@query("crop_raster", f"""WITH {RASTER} SELECT "row", col, round(value, 6) AS value FROM raster WHERE "row" BETWEEN 3 AND 6 AND col BETWEEN 10 AND 20""")
def crop_raster(spark, sf_dir):
    return _rounded(grid.crop(raster(spark, sf_dir), (3, 6), (10, 20)))


@query("band_equation", f"""WITH {CELLS} SELECT scene, "row", col, round(price / nullif(qty, 0) + sqrt(tax) * 2, 4) AS value FROM cells""")
def band_equation(spark, sf_dir):
    c = grid.equation(cells(spark, sf_dir), "i0 / i2 + sqrt(i1) * 2", ["price", "tax", "qty"])
    return _rounded(c.select("scene", "row", "col", "value"), places=4)


_FORMULAS = {"chain": ("price / tax / qty", "price / nullif(tax, 0) / nullif(qty, 0)"), "nested": ("(price + sqrt(tax)) / (qty - (qty + 0) + where(i0 > 35000, 1, 0))", "CASE WHEN price > 35000 THEN price + sqrt(tax) END"), "power": ("i2**2 / (i1^2 + 1)", "qty * qty / (tax * tax + 1)")}


@query("band_equations", f"""WITH {CELLS} SELECT scene, "row", col, {", ".join(f"round({sql}, 4) AS {n}" for n, (_, sql) in _FORMULAS.items())} FROM cells""")
def band_equations(spark, sf_dir):
    """Chained, nested and power formulas, with zero divisors."""
    c = cells(spark, sf_dir)
    for name, (text, _) in _FORMULAS.items():
        c = grid.equation(c, text, ["price", "tax", "qty"], name)
    return _rounded(c.select("scene", "row", "col", *_FORMULAS), *_FORMULAS, places=4)


@query("band_mean_std", f"""WITH {CELLS}, b AS (SELECT scene, "row", col, tax, qty, CASE WHEN "row" > 3 THEN price / 10000 END AS p FROM cells),
l AS (SELECT scene, "row", col, unnest([p, tax, qty]) AS v FROM b)
SELECT scene, "row", col, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std FROM l GROUP BY ALL""")
def band_mean_std(spark, sf_dir):
    c = cells(spark, sf_dir).withColumn("p", F.when(F.col("row") > 3, F.col("price") / 10000))
    names = ["p", "tax", "qty"]
    return _rounded(c.select("scene", "row", "col", grid.bands_mean(names).alias("mean"), grid.bands_std(names).alias("std")), "mean", "std", places=9)  # six places would be exact ties


@query("band_ratio_ndvi", f"""WITH {CELLS} SELECT scene, "row", col, round(CASE WHEN abs(price + qty) > 1e-8 THEN (price - qty) / (price + qty) END, 6) AS value FROM cells""")
def band_ratio_ndvi(spark, sf_dir):
    c = cells(spark, sf_dir)
    return _rounded(c.select("scene", "row", "col", grid.ratio(F.col("price") - F.col("qty"), F.col("price") + F.col("qty")).alias("value")))


@query("landslide_rules", f"""WITH {CELLS} SELECT scene, "row", col, CAST(CASE WHEN qty > 4.2 THEN 4 WHEN price > 40000 THEN 3 WHEN tax > 0.045 THEN 2 WHEN tax < 0.03 THEN 1 ELSE 0 END AS INTEGER) AS rule FROM cells""")
def landslide_rules(spark, sf_dir):
    """A decision list in which later rules win."""
    rules = [("tax < 0.03", 1), ("tax > 0.045", 2), ("price > 40000", 3), ("qty > 4.2", 4)]
    return temporal.decide(cells(spark, sf_dir), rules, "rule").select("scene", "row", "col", "rule")


for _how, _sql in {"min": "min(price)", "max": "max(price)", "first": "arg_min(price, scene)", "last": "arg_max(price, scene)", "mean": "avg(price)"}.items():

    @query(f"mosaic_{_how}", f"""WITH {CELLS} SELECT "row", col, round({_sql}, 6) AS value FROM cells GROUP BY 1, 2""")
    def _mosaic(spark, sf_dir, how=_how):
        return _rounded(grid.mosaic(cells(spark, sf_dir), how, value="price").withColumnRenamed("price", "value"))


@query("mosaic_median_shift", f"""WITH {CELLS}, a AS (SELECT "row", col, price AS v FROM cells WHERE scene = 1996 AND col <= 30), b AS (SELECT "row", col, price AS v FROM cells WHERE scene = 1997 AND col >= 20),
f AS (SELECT coalesce(a."row", b."row") AS "row", coalesce(a.col, b.col) AS col, a.v AS av, b.v AS bv FROM a FULL JOIN b ON a."row" = b."row" AND a.col = b.col),
d AS (SELECT median(av) - median(bv) AS d FROM f WHERE av IS NOT NULL AND bv IS NOT NULL)
SELECT "row", col, round(coalesce(bv + d, av), 4) AS value FROM f, d""")
def mosaic_median_shift(spark, sf_dir):
    c = cells(spark, sf_dir).withColumnRenamed("price", "value")
    return _rounded(grid.mosaic_median(c.where("scene = 1996 AND col <= 30"), c.where("scene = 1997 AND col >= 20")), places=4)


@query("layer_stack_common", f"""WITH {CELLS}, a AS (SELECT "row", col, price AS v FROM cells WHERE scene = 1996 AND col <= 30), b AS (SELECT "row", col, price AS v FROM cells WHERE scene = 1997 AND col >= 20)
SELECT coalesce(a."row", b."row") AS "row", coalesce(a.col, b.col) AS col, round(CASE WHEN b.v IS NOT NULL THEN a.v END, 6) AS a, round(CASE WHEN a.v IS NOT NULL THEN b.v END, 6) AS b FROM a FULL JOIN b ON a."row" = b."row" AND a.col = b.col""")
def layer_stack_common(spark, sf_dir):
    c = cells(spark, sf_dir).withColumnRenamed("price", "value")
    return _rounded(grid.stack({"a": c.where("scene = 1996 AND col <= 30"), "b": c.where("scene = 1997 AND col >= 20")}, common=True), "a", "b")


@query("grid_fill_merge", f"""WITH {CELLS}, a AS (SELECT "row", col, price AS v FROM cells WHERE scene = 1996 AND col <= 30), b AS (SELECT "row", col, price AS v FROM cells WHERE scene = 1997)
SELECT coalesce(a."row", b."row") AS "row", coalesce(a.col, b.col) AS col, round(coalesce(a.v, b.v), 6) AS value FROM a FULL JOIN b ON a."row" = b."row" AND a.col = b.col""")
def grid_fill_merge(spark, sf_dir):
    """A second grid fills what the first one lacks."""
    c = cells(spark, sf_dir).withColumnRenamed("price", "value")
    both = grid.stack({"a": c.where("scene = 1996 AND col <= 30"), "b": c.where("scene = 1997")})
    return _rounded(both.select("row", "col", F.coalesce("a", "b").alias("value")))


@query("temporal_stats", f"""WITH {CELLS} SELECT "row", col, round(avg(price), 4) AS mean, round(stddev_pop(price), 4) AS std, count(price) AS n FROM cells GROUP BY 1, 2""")
def temporal_stats(spark, sf_dir):
    return _rounded(temporal.statistics(cells(spark, sf_dir), "price"), "mean", "std", places=4)


@query("temporal_cv", f"""WITH {CELLS}, s AS (SELECT "row", col, stddev_pop(price) / avg(price) AS cv FROM cells GROUP BY 1, 2), q AS (SELECT quantile_cont(cv, 0.01) AS a, quantile_cont(cv, 0.99) AS b FROM s)
SELECT "row", col, round(least(greatest(cv, a), b), 6) AS cv FROM s, q""")
def temporal_cv(spark, sf_dir):
    return _rounded(temporal.coefficient_of_variation(cells(spark, sf_dir), "price"), "cv")


_TCI = f"""{CELLS}, m AS (SELECT scene, "row", col, (max(price) OVER w - price) / nullif(max(price) OVER w - min(price) OVER w, 0) AS tci, (qty - min(qty) OVER w) / nullif(max(qty) OVER w - min(qty) OVER w, 0) AS vci FROM cells WINDOW w AS (PARTITION BY "row", col))"""


@query("condition_indices", f"""WITH {_TCI} SELECT scene, "row", col, round(tci, 6) AS tci, round(vci, 6) AS vci, round(0.5 * vci + 0.5 * tci, 6) AS vhi FROM m""")
def condition_indices(spark, sf_dir):
    return _rounded(temporal.condition_indices(cells(spark, sf_dir), "price", "qty", 0.5), "tci", "vci", "vhi").select("scene", "row", "col", "tci", "vci", "vhi")


@query("scene_difference", f"""WITH {CELLS} SELECT a."row", a.col, round(b.price - a.price, 6) AS value FROM cells a JOIN cells b ON a."row" = b."row" AND a.col = b.col WHERE a.scene = 1995 AND b.scene = 1998""")
def scene_difference(spark, sf_dir):
    c = cells(spark, sf_dir)
    return _rounded(temporal.difference(c.where("scene = 1995"), c.where("scene = 1998"), "price"))


@query("best_pixel_composite", f"""WITH {CELLS}, s AS (SELECT *, 1 / (1 + exp(-0.2 * (qty * 10 - 25))) + exp(-0.5 * power((scene - 1998) / 2.0, 2)) AS score FROM cells)
SELECT "row", col, scene, round(price, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY "row", col ORDER BY round(score, 9) DESC, scene) AS rn FROM s) WHERE rn = 1""")
def best_pixel_composite(spark, sf_dir):
    score = 1 / (1 + F.exp(-0.2 * (F.col("qty") * 10 - 25))) + F.exp(-0.5 * F.pow((F.col("scene") - 1998) / 2.0, F.lit(2)))
    return _rounded(temporal.best_pixel(cells(spark, sf_dir), F.round(score, 9), "scene", ["price"]).withColumnRenamed("price", "value"))


def _derivative(axis: str, other: str, name: str) -> str:
    w = f'(PARTITION BY "{other}" ORDER BY "{axis}")'
    return f"""CASE WHEN lag(value) OVER {w} IS NULL THEN lead(value) OVER {w} - value WHEN lead(value) OVER {w} IS NULL THEN value - lag(value) OVER {w} ELSE (lead(value) OVER {w} - lag(value) OVER {w}) / 2 END AS {name}"""


_DERIVED = f"""{RASTER}, d AS (SELECT "row", col, value, {_derivative("col", "row", "dx")}, {_derivative("row", "col", "dy")} FROM raster)"""


@query("gradient_xy", f"""WITH {_DERIVED} SELECT "row", col, round(dx, 4) AS dx, round(dy, 4) AS dy FROM d""")
def gradient_xy(spark, sf_dir):
    return _rounded(stencil.derivatives(raster(spark, sf_dir)), "dx", "dy", places=4).select("row", "col", "dx", "dy")


@query("gradient_directional", f"""WITH {_DERIVED} SELECT "row", col, round(-dy * sin(radians(30)) - dx * cos(radians(30)), 4) AS value FROM d""")
def gradient_directional(spark, sf_dir):
    return _rounded(stencil.directional(raster(spark, sf_dir), 30), places=4)


@query("horizontal_gradient", f"""WITH {_DERIVED} SELECT "row", col, round(sqrt(dx * dx + dy * dy), 4) AS value FROM d""")
def horizontal_gradient(spark, sf_dir):
    return _rounded(stencil.horizontal_gradient(raster(spark, sf_dir)), places=4)


@query("derivative_ratio", f"""WITH {_DERIVED} SELECT "row", col, round(atan2(-dx * sin(radians(75)) - dy * cos(radians(75)), abs(-dx * sin(radians(165)) - dy * cos(radians(165)))), 5) AS value FROM d""")
def derivative_ratio(spark, sf_dir):
    return _rounded(stencil.derivative_ratio(raster(spark, sf_dir), 75), places=5)


_NEAR = f"""{RASTER}, n AS (SELECT a."row", a.col, a.value AS v, count(*) AS n, sum(b.value) AS s, sum((b.value - m.m) * (b.value - m.m)) AS ss, sum(b.value - m.m) AS sm, any_value(a.value - m.m) AS vm
FROM raster a JOIN raster b ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1, (SELECT min(value) AS m FROM raster) m GROUP BY 1, 2, 3)"""


@query("box_mean3", f"""WITH {_NEAR} SELECT "row", col, round(s / n, 4) AS value FROM n WHERE n = 9""")
def box_mean3(spark, sf_dir):
    return _rounded(stencil.box_mean(raster(spark, sf_dir), 1), places=4)


@query("gain_control_mean", f"""WITH {_NEAR} SELECT "row", col, round(coalesce(vm / nullif(sm / n, 0), vm), 6) AS value FROM n WHERE n = 9""")
def gain_control_mean(spark, sf_dir):
    return _rounded(stencil.gain_control(raster(spark, sf_dir), 1))


@query("gain_control_rms", f"""WITH {_NEAR} SELECT "row", col, round(coalesce(vm / nullif(sqrt(ss / n), 0), vm), 6) AS value FROM n WHERE n = 9""")
def gain_control_rms(spark, sf_dir):
    return _rounded(stencil.gain_control(raster(spark, sf_dir), 1, "rms"))


_SOBEL = f"""{RASTER}, e AS (SELECT a."row", a.col, i, j, (SELECT value FROM raster b WHERE b."row" = least(greatest(a."row" + i, lim.r0), lim.r1) AND b.col = least(greatest(a.col + j, lim.c0), lim.c1)) AS v
FROM raster a, (SELECT unnest([-1, 0, 1]) AS i) si, (SELECT unnest([-1, 0, 1]) AS j) sj, (SELECT min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM raster) lim),
s AS (SELECT "row", col, sum(v * j * (2 - abs(i))) / 8 AS dzdx, sum(-v * i * (2 - abs(j))) / 8 AS dzdy FROM e GROUP BY 1, 2)"""


@query("aspect", f"""WITH {_SOBEL}, a AS (SELECT *, degrees(atan2(dzdy, -dzdx)) AS a FROM s)
SELECT "row", col, round(CASE WHEN dzdx = 0 AND dzdy = 0 THEN -1 WHEN a > 90 THEN 450 - a ELSE 90 - a END, 4) AS value FROM a""")
def aspect(spark, sf_dir):
    return _rounded(stencil.aspect(raster(spark, sf_dir)), places=4)


@query("sun_shade", f"""WITH {_SOBEL}, k AS (SELECT -cos(0.5) * tan(0.8) AS p0, -sin(0.5) * tan(0.8) AS q0), u AS (SELECT p0, q0, p0 / (1 + sqrt(1 + p0 * p0 + q0 * q0)) AS p1, q0 / (1 + sqrt(1 + p0 * p0 + q0 * q0)) AS q1 FROM k),
l AS (SELECT "row", col, (1 + p0 * dzdx / 1000 + q0 * dzdy / 1000) / (sqrt(1 + power(dzdx / 1000, 2) + power(dzdy / 1000, 2)) * sqrt(1 + p0 * p0 + q0 * q0)) AS cosi,
(1 + p1 * dzdx / 1000 + q1 * dzdy / 1000) / (sqrt(1 + power(dzdx / 1000, 2) + power(dzdy / 1000, 2)) * sqrt(1 + p1 * p1 + q1 * q1)) AS coss FROM s, u)
SELECT "row", col, round((0.3 + 0.7 * coss * coss) * cosi / cos(0.4), 6) AS value FROM l""")
def sun_shade(spark, sf_dir):
    return _rounded(stencil.shade(raster(spark, sf_dir), 1000, elevation=0.8, azimuth=0.5, alpha=0.7))


_MASKED = f"""{RASTER}, m AS (SELECT "row", col, CASE WHEN ("row" * 7 + col * 3) % 11 <> 0 THEN value END AS value FROM raster)"""


def _masked(spark, sf_dir):
    return raster(spark, sf_dir).withColumn("value", F.when((F.col("row") * 7 + F.col("col") * 3) % 11 != 0, F.col("value")))


@query("box_median3", f"""WITH {_MASKED} SELECT a."row", a.col, round(median(b.value), 4) AS value FROM m a JOIN m b ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2""")
def box_median3(spark, sf_dir):
    return _rounded(stencil.moving_median(_masked(spark, sf_dir), stencil.offsets(3)), places=4)


@query("disc_mean5", f"""WITH {_MASKED} SELECT a."row", a.col, round(CASE WHEN count(*) = count(b.value) THEN sum(b.value) / 79 END, 4) AS value FROM m a JOIN m b ON power(b."row" - a."row", 2) + power(b.col - a.col, 2) <= 25 AND b."row" - a."row" < 5 AND b.col - a.col < 5 GROUP BY 1, 2""")
def disc_mean5(spark, sf_dir):
    return _rounded(stencil.moving_sum(_masked(spark, sf_dir), stencil.disc_kernel(5)), places=4)


@query("gaussian_smooth5", f"""WITH {RASTER}, w AS (SELECT i, j, exp(-(power(i, 2) + power(j, 2)) / 32.0) AS w FROM (SELECT unnest(range(-2, 2)) AS i) a, (SELECT unnest(range(-2, 2)) AS j) b)
SELECT a."row", a.col, round(sum(b.value * w.w) / (SELECT sum(w) FROM w), 4) AS value FROM raster a, w JOIN raster b ON b."row" = a."row" + w.i AND b.col = a.col + w.j GROUP BY 1, 2""")
def gaussian_smooth5(spark, sf_dir):
    return _rounded(stencil.moving_sum(raster(spark, sf_dir), stencil.gaussian_kernel(5, 5, 4.0)), places=4)


@query("gain_control_median", f"""WITH {RASTER}, l AS (SELECT "row", col, value - (SELECT min(value) FROM raster) AS value FROM raster), n AS (SELECT a."row", a.col, a.value AS v, count(*) AS n, median(b.value) AS m FROM l a JOIN l b ON b."row" BETWEEN a."row" - 1 AND a."row" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2, 3)
SELECT "row", col, round(coalesce(v / nullif(m, 0), v), 6) AS value FROM n WHERE n = 9""")
def gain_control_median(spark, sf_dir):
    return _rounded(stencil.gain_control(raster(spark, sf_dir), 1, "median"))


@query("gradient_gaps", f"""WITH {_MASKED}, n AS (SELECT a."row", a.col, a.value AS v, w.value AS w, e.value AS e FROM m a LEFT JOIN m w ON w."row" = a."row" AND w.col = a.col - 1 LEFT JOIN m e ON e."row" = a."row" AND e.col = a.col + 1), x AS (SELECT min(col) AS c0, max(col) AS c1 FROM raster)
SELECT "row", col, round(CASE WHEN col = c0 THEN e - v WHEN col = c1 THEN v - w ELSE (e - w) / 2 END, 4) AS dx FROM n, x WHERE v IS NOT NULL""")
def gradient_gaps(spark, sf_dir):
    """Derivatives of a raster with missing cells."""
    return _rounded(stencil.derivatives(_masked(spark, sf_dir).where("value IS NOT NULL")), "dx", places=4).select("row", "col", "dx")


@query("decimated_read", f"""WITH {RASTER} SELECT "row", col, round(value, 6) AS value FROM raster WHERE "row" % 2 = 0 AND col % 5 = 0""")
def decimated_read(spark, sf_dir):
    return _rounded(raster(spark, sf_dir).where((F.col("row") % 2 == 0) & (F.col("col") % 5 == 0)))
