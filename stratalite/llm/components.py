"""Connected components of a graph in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


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
