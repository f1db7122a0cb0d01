"""Connected components of a graph too large for one machine: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One step on edges (u, v), u > v: neighbours move to the smallest node that a node sees."""
    keyed = edges.select(F.col("u").alias("node"), F.col("v").alias("other"))
    if large:
        keyed = keyed.unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("other")))
    least = keyed.groupBy("node").agg(F.min("other").alias("least"), F.count("*").alias("n"))
    least = least.select("node", "n", F.least("node", "least").alias("least"))
    seen = store.lookup(keyed, least, "node", "n", total * (2 if large else 1))
    if large:
        out = seen.where("other > node").select(F.col("other").alias("u"), F.col("least").alias("v"))
    else:
        out = seen.where("other <> least").select(F.col("other").alias("u"), F.col("least").alias("v")).unionByName(
            least.select(F.col("node").alias("u"), F.col("least").alias("v"))
        )
    return store.cut(out.distinct())


def components(links: DataFrame) -> DataFrame:
    """node, component for each node that has a link; component is the smallest node that can be reached.

    links: columns a, b, of one orderable type; loops, repeats and either direction are fine. An empty table gives an
    empty result.
    """
    edges = store.cut(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = None
    while True:
        count, mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if count == 0 or (count, mark) == state:
            break
        state = (count, mark)
        edges = _star(_star(edges, True, count), False, count)
    # Now each node but the smallest of a component has one edge, to the smallest.
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
