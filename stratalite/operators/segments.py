"""Segmentation of images by merging regions that are alike.

Regions and the borders between them are two tables. In a round each region looks for
the neighbour whose merging raises heterogeneity least; pairs that choose each other
merge. All pairs have one order (by rise, then by a hash of their names), so the least
one always merges, and on average a share of all regions does in every round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalite.session import written

from .components import components, numbered


def _rise(bands: Sequence[str], colour: float, compact: float) -> Column:
    """What merging regions a and b adds: the sizes' weighted deviations, and of their outline its smoothness and compactness."""
    f = lambda s, c: F.col(f"{s}.{c}")
    n1, n2 = f("a", "n").cast("double"), f("b", "n").cast("double")
    n = n1 + n2
    total = F.lit(0.0)
    for k in range(len(bands)):
        m1, m2, q1, q2 = f("a", f"m{k}"), f("b", f"m{k}"), f("a", f"q{k}"), f("b", f"q{k}")
        both = q1 + q2 + n1 * n2 / n * (m1 - m2) * (m1 - m2)  # squared deviations from the common mean
        total = total + (F.sqrt(n * both) - F.sqrt(n1 * q1) - F.sqrt(n2 * q2)) / len(bands)
    if colour >= 1:
        return total
    l1, l2 = f("a", "outline").cast("double"), f("b", "outline").cast("double")
    l = l1 + l2 - 2 * F.col("shared")  # noqa: E741
    box = lambda r0, r1, c0, c1: (2 * (r1 - r0 + c1 - c0 + 2)).cast("double")
    b1, b2 = (box(f(s, "r0"), f(s, "r1"), f(s, "c0"), f(s, "c1")) for s in "ab")
    b = box(F.least(f("a", "r0"), f("b", "r0")), F.greatest(f("a", "r1"), f("b", "r1")), F.least(f("a", "c0"), f("b", "c0")), F.greatest(f("a", "c1"), f("b", "c1")))
    smooth = n * l / b - (n1 * l1 / b1 + n2 * l2 / b2)
    dense = F.sqrt(n) * l - (F.sqrt(n1) * l1 + F.sqrt(n2) * l2)
    return colour * total + (1 - colour) * (compact * dense + (1 - compact) * smooth)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _merged(regions: DataFrame, names: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Regions with new names (id, to) added up."""
    r = regions.join(names, "id", "left").withColumn("id", F.coalesce("to", "id"))
    k = range(len(bands))
    sums = r.groupBy("id").agg(
        F.sum("n").alias("n"), F.sum("outline").alias("outline"), F.min("r0").alias("r0"), F.max("r1").alias("r1"), F.min("c0").alias("c0"), F.max("c1").alias("c1"),
        *[F.collect_list(F.struct("n", f"m{i}", f"q{i}")).alias(f"p{i}") for i in k],
    )
    for i in k:  # at most two parts each
        m, q = f"m{i}", f"q{i}"
        sums = sums.withColumn(m, _sum(F.transform(f"p{i}", lambda p: p["n"] * p[m])) / F.col("n"))  # noqa: B023
        sums = sums.withColumn(q, _sum(F.transform(f"p{i}", lambda p: p[q] + p["n"] * (p[m] - F.col(m)) * (p[m] - F.col(m)))))  # noqa: B023
    return sums.drop(*[f"p{i}" for i in k])


def segments(cells: DataFrame, bands: Sequence[str], scale: float, colour: float = 1.0, compact: float = 0.5, rounds: int = 200) -> DataFrame:
    """Cells (row, col, bands; all known) with ``region``, its least cell's name, and ``label``, its number from 1 in their order.

    Neighbours are the eight cells around. Regions merge while some pair raises
    heterogeneity by no more than ``scale``: with ``colour`` 1 the bands' deviations alone
    count, else one less ``colour`` of the outline's ``compact`` and smooth parts. Cells
    with a null band are in no region. Connected cells of equal values are one region from
    the start where only colour counts. No cells give no rows.
    """
    known = written(cells.dropna(subset=list(bands)).withColumn("_id", F.col("row").cast("long") * (1 << 31) + F.col("col")), "segment-cells")
    near = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) > (0, 0)]
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in near])
    beside = known.select("_id", *bands, F.explode(steps).alias("s"), "row", "col").select(F.col("_id").alias("a"), *[F.col(b).alias(f"_{k}") for k, b in enumerate(bands)], (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"), ((F.abs("s.i") + F.abs("s.j")) == 1).cast("int").alias("shared"))
    met = beside.join(known.select("row", "col", F.col("_id").alias("b"), *bands), ["row", "col"])
    same = F.lit(colour >= 1)
    for k, b in enumerate(bands):
        same = same & (F.col(b) == F.col(f"_{k}"))
    met = written(met.withColumn("same", same).select("a", "b", "shared", "same"), "segment-borders")
    owner = written(components(met.where("same").select("a", "b")).select(F.col("node").alias("id"), F.col("component").alias("to")), "segment-owner")

    one = known.select(F.col("_id").alias("id"), F.lit(1).cast("long").alias("n"), F.lit(4).cast("long").alias("outline"), F.col("row").alias("r0"), F.col("row").alias("r1"), F.col("col").alias("c0"), F.col("col").alias("c1"), *[x for k, b in enumerate(bands) for x in (F.col(b).cast("double").alias(f"m{k}"), F.lit(0.0).alias(f"q{k}"))])
    first = one.join(owner, "id", "left").withColumn("id", F.coalesce("to", "id"))  # equal values: sums without deviations
    regions = first.groupBy("id").agg(F.sum("n").alias("n"), F.sum("outline").alias("outline"), F.min("r0").alias("r0"), F.max("r1").alias("r1"), F.min("c0").alias("c0"), F.max("c1").alias("c1"), *[x for k in range(len(bands)) for x in (F.min(f"m{k}").alias(f"m{k}"), F.max(f"q{k}").alias(f"q{k}"))])
    regions = written(regions, "segment-regions")
    edges = _renamed(met.select("a", "b", "shared"), owner)
    of = known.select(F.col("_id").alias("cell")).join(owner, F.col("cell") == F.col("id"), "left").select("cell", F.coalesce("to", "cell").alias("region"))
    of = written(of, "segment-of")
    for _ in range(rounds):
        a, b = regions.select(F.col("id").alias("a_id"), F.struct(*regions.columns).alias("a")), regions.select(F.col("id").alias("b_id"), F.struct(*regions.columns).alias("b"))
        pair = edges.select(F.col("a").alias("a_id"), F.col("b").alias("b_id"), "shared").join(a, "a_id").join(b, "b_id")
        rated = pair.select("a_id", "b_id", _rise(bands, colour, compact).alias("rise")).where(F.col("rise") <= scale)
        rated = written(rated.select("a_id", "b_id", F.struct("rise", F.xxhash64("a_id", "b_id").alias("h"), "a_id", "b_id").alias("order")), "segment-pairs")
        best = rated.select(F.col("a_id").alias("id"), "order").unionByName(rated.select(F.col("b_id").alias("id"), "order")).groupBy("id").agg(F.min("order").alias("best"))
        chosen = best.groupBy("best").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(F.col("best.b_id").alias("id"), F.col("best.a_id").alias("to"))
        chosen = written(chosen, "segment-merges")
        if chosen.isEmpty():
            break
        changed = chosen.select("id").unionByName(chosen.select(F.col("to").alias("id"))).distinct()
        merged = _merged(regions.join(changed, "id", "left_semi"), chosen, bands)
        inner = edges.join(chosen.select(F.col("to").alias("a"), F.col("id").alias("b"), F.lit(True).alias("hit")), ["a", "b"]).select(F.col("a").alias("id"), F.col("shared").alias("gone"))
        merged = merged.join(inner, "id", "left").withColumn("outline", F.col("outline") - 2 * F.coalesce("gone", F.lit(0))).drop("gone")
        regions = written(regions.join(changed, "id", "left_anti").unionByName(merged.select(regions.columns)), "segment-regions")
        edges = _renamed(edges, chosen)
        of = written(of.join(chosen.select(F.col("id").alias("region"), "to"), "region", "left").select("cell", F.coalesce("to", "region").alias("region")), "segment-of")
    labelled = of.join(numbered(of, "region", "label"), "region")
    return known.join(labelled, known["_id"] == labelled["cell"]).drop("_id", "cell")


def _renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Borders (a < b, shared) between regions with new names (id, to), those inside of one left out, a written table."""
    for side in "ab":
        edges = edges.join(names.select(F.col("id").alias(side), F.col("to").alias(f"_{side}")), side, "left").withColumn(side, F.coalesce(f"_{side}", side)).drop(f"_{side}")
    kept = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared")
    return written(kept.groupBy("a", "b").agg(F.sum("shared").alias("shared")), "segment-edges")
