"""Connected components by alternating large and small stars; links stay distributed.

A node that a third of all links lead to is no task of its own: such hubs meet their links by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import meet, staged


def _large_star(edges: DataFrame, count: int) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = staged(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("copies")).select("u", F.least("u", "m").alias("m"), "copies"), "links")
    return meet(both.where("v > u"), least, "u", "inner", 2 * count).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame, count: int) -> DataFrame:
    least = staged(edges.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("copies")), "links")
    moved = meet(edges, least, "hi", "inner", count).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def components(links: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """(node, root): for every node of a link, the smallest node of its component.

    Each round writes its links to the shared folder, so a lost executor costs one round at most. The driver sees a
    count and a checksum only. Self links and repeated links are allowed; no links give an empty table.
    """
    edges = staged(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "links")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    before = mark(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = staged(_large_star(edges, before[0]), "links")
        edges = staged(_small_star(edges, before[0]), "links")
        after = mark(edges)
        if after == before:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()
        before = after
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
