"""Connected components of a table of links, by alternating stars.

Every round hangs each node's larger neighbours, then its smaller ones, under the least node it knows of; after a number
of rounds logarithmic in the longest path all links point from a node to the least node of its component.  Rounds are
written tables; only a count and a checksum come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.plans.staging import stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links (a, b) with a > b after one star; ``links`` has a > b as well."""
    if large:
        near = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    joined = near.join(least, "a")
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b")))
    return moved.filter("a > b").distinct()


def connected(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b) but the roots themselves; a root is its component's least node."""
    links = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(most_rounds):
        links = stage(_star(_star(links, True), False), "links")
        facts = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if facts == before:
            break
        before = facts
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
