"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import cut, drop, small

#: Edges of a node that are not joined in one task.
HEAVY = 1000


def _joined(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges with m of their a. Nodes of many edges, of which there are few, are met by a broadcast and not in one task."""
    heavy = least.where(F.col("n") > HEAVY)
    if not heavy.limit(1).count():
        return edges.join(least.drop("n"), "a")
    marked = edges.join(small(heavy.select("a", F.col("m").alias("hm"))), "a", "left")
    light = marked.where("hm is null").drop("hm").join(least.where(F.col("n") <= HEAVY).drop("n"), "a")
    return marked.where("hm is not null").select("a", "b", F.col("hm").alias("m")).unionByName(light)


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least node near it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    return _joined(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of these; edges have b < a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    ends = _joined(edges, least).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return ends.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a long, b long), in any direction, with loops and repeats allowed -> (node, component).

    The component is its least node; nodes without an edge to another are absent. Each round shuffles the
    edges on their ends, is written to the shared folder, and halves long chains; no row is collected. drop() deletes the result."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        half = cut(_large(now).where("b < a").distinct(), "edges")
        drop(now)
        new = cut(_small(half).where("b < a").distinct(), "edges")
        drop(half)
        sign = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        now = new
        if tuple(sign) == seen:
            stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            out = cut(stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components")
            drop(now)
            return out
        seen = tuple(sign)
    raise RuntimeError("components did not settle")
