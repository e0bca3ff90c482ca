"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import staging


def _least(edges: DataFrame, name: str) -> DataFrame:
    """(a, m): the least b of each a of edges(a, b). It is written before it is joined, so that the join can split the rows of a hub."""
    return staging.stage(edges.groupBy("a").agg(F.min("b").alias("m")), name)


def state(edges: DataFrame) -> tuple[int, int | None]:
    """What edges(a, b), which are distinct, are told from others by: their number, and all bits of their hashes; neither can overflow."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) of every node in links(a, b); component is the least node reachable. An error if the stars still change after most_rounds."""
    pair = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    edges = staging.stage(links.where("a <> b").select(*pair("a", "b")).distinct(), "cc-links")
    before = None
    for done in range(most_rounds + 1):
        now = state(edges)
        if now == before or not now[0]:
            break
        if done == most_rounds:
            raise RuntimeError(f"components still change after {most_rounds} rounds")
        before = now
        # each node's larger neighbours go to its least one
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both, "cc-large")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        stars = staging.stage(large.distinct(), "cc-stars")
        staging.drop(edges, least)
        # each node and its smaller neighbours go to the least of these
        least = _least(stars, "cc-small")
        near = stars.join(least, "a")
        small = near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b")))
        edges = staging.stage(small.distinct(), "cc-edges")
        staging.drop(stars, least)
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
