"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round is two aggregations and two joins over the links; what is written per round is never more than the links
themselves. The table is pinned in the shared checkpoint folder after every round, and the rounds end when the links
no longer change, each node then pointing at the smallest node of its component. The number of rounds grows with the
logarithm of the longest path. Nothing but one count and one checksum per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fillwise.llm.common import pinned


def _large_star(links: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them (links: a > b)."""
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    return (links.join(low, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b"))))


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count(F.lit(1)).alias("n"), F.sum((F.xxhash64("a", "b") / 1048576).cast("long")).alias("s")).first()
    return r["n"], r["s"]


def components(links: DataFrame) -> DataFrame:
    """``links`` (two comparable columns a, b; any order, repeats allowed) -> (node, component) for linked nodes."""
    now = pinned(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while True:
        now = pinned(_small_star(_large_star(now).distinct()).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
