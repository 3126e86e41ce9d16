"""Graphs as DataFrames: connected components, places along chains, numbers in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalite.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long): the least node it is connected with.

    Each node points at a node that is no greater. In a round, each learns the
    least grandparent among its neighbours, hands it to its parent and to itself,
    and jumps to its grandparent; the number of rounds grows with the logarithm of
    the longest chain. Rounds are written tables, sums are formed before shuffles.
    """
    both = written(edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph")
    state = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("up")), "graph-state")
    while True:
        over = state.select(F.col("node").alias("up"), F.col("up").alias("over"))
        known = written(state.join(over, "up").select("node", "up", "over"), "graph-known")
        near = both.join(known.select(F.col("node").alias("b"), "over"), "b").groupBy("a").agg(F.min("over").alias("near")).withColumnRenamed("a", "node")
        told = known.join(near, "node").select("node", "up", F.least("over", "near").alias("best"))
        offers = told.select("node", "best").unionByName(told.select(F.col("up").alias("node"), "best"))
        state = written(offers.groupBy("node").agg(F.min("best").alias("up")), "graph-state")
        changed = state.join(known.select("node", F.col("up").alias("was"), "over"), "node").where("up <> was OR up <> over").limit(1).count()
        if not changed:
            return state.select("node", F.col("up").alias("component"))


def chain_places(links: DataFrame) -> DataFrame:
    """Of chains and rings (node, next: long, null at a chain's end; each node is the next of one node at most): node, chain, place (from 0), ring.

    A chain's name is its least node, and a ring begins with that one. Every node looks
    ever farther ahead, twice as far in each round, until it knows its distance to the end.
    """
    links = written(links.select("node", "next"), "chain")
    named = components(links.where("next IS NOT NULL AND next <> node").select(F.col("node").alias("a"), F.col("next").alias("b")))
    links = written(links.join(named, "node", "left").select("node", "next", F.coalesce("component", "node").alias("chain")), "chain")
    ends = links.where("next IS NULL").select("chain").distinct().withColumn("open", F.lit(True))
    start = links.join(ends, "chain", "left").select("node", "chain", F.col("open").isNull().alias("ring"), F.when(F.col("open").isNull() & (F.col("next") == F.col("chain")), F.lit(None)).otherwise(F.col("next")).alias("next"))
    state = written(start.withColumn("ahead", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long")), "chain-state")
    while state.where("next IS NOT NULL").limit(1).count():
        there = state.select(F.col("node").alias("next"), F.col("next").alias("farther"), F.col("ahead").alias("more"))
        state = written(state.join(there, "next", "left").select("node", "chain", "ring", F.col("farther").alias("next"), (F.col("ahead") + F.coalesce("more", F.lit(0))).alias("ahead")), "chain-state")
    longest = state.groupBy("chain").agg(F.max("ahead").alias("longest"))
    return state.join(longest, "chain").select("node", "chain", (F.col("longest") - F.col("ahead")).alias("place"), "ring")


def numbered(values: DataFrame, column: str, name: str = "number") -> DataFrame:
    """Distinct values of a column with their places in order, from 1: sorted ranges, and one count for each range on the driver."""
    ranges = max(1, values.sparkSession._jsc.sc().defaultParallelism())
    ordered = values.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(ranges, column).sortWithinPartitions(column)
    ordered = written(ordered.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    sizes = sorted((r.part, r.n) for r in ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 1
    for p, n in sizes:
        starts.append((p, total))
        total += n
    first = values.sparkSession.createDataFrame(starts or [(0, 1)], "_part long, _start long")
    return ordered.join(F.broadcast(first), part == F.col("_part")).select(column, (F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(name))


def running_totals(values: DataFrame, column: str, of: str, name: str, falling: bool = False) -> DataFrame:
    """Adds the sum of ``of`` over rows whose ``column`` (distinct, not null) comes no later in order: sums in sorted ranges, and those of whole ranges before."""
    ranges = max(1, values.sparkSession._jsc.sc().defaultParallelism())
    order = F.desc(column) if falling else F.asc(column)
    dealt = written(values.repartitionByRange(ranges, order).withColumn("_part", F.spark_partition_id()), "totals")
    start, starts = 0, []
    for r in sorted(dealt.groupBy("_part").agg(F.sum(of)).collect()):  # a row for each range
        starts.append((r[0], start))
        start += r[1] or 0
    kind = dict(dealt.groupBy().agg(F.sum(of).alias("s")).dtypes)["s"]
    first = values.sparkSession.createDataFrame([(p, s) for p, s in starts] or [(0, 0)], f"_part int, _start {kind}")
    here = F.sum(of).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.withColumn(name, here).join(F.broadcast(first), "_part").withColumn(name, F.col(name) + F.col("_start")).drop("_part", "_start")
