"""Connected components of links between 64-bit nodes, by alternating large-star and small-star steps.

Every step keeps the links a node has to the smallest node it knows, so a component becomes a star around its smallest
node after a number of steps that is logarithmic in practice. Each step is two aggregations and joins; its result is a
written table, which survives lost executors and cuts the lineage. The joins are sort-merge joins by a hint: both sides
grow with the input, and the size of a compressed table would understate what a broadcast of it takes. A node with very
many links is a skewed join key whose other side is one row, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.llm.common import written


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node gets a link to the node's smallest neighbour."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours get links to the smallest of them. Links go from larger (a) to smaller (b)."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    neighbours = links.join(least.hint("merge"), "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return neighbours.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """Columns node, root for every node of `links` (a, b) that is not the smallest of its component.

    Links of a node to itself, repeated links and links in both directions are fine; a null end makes no link. No links
    give no rows.
    """
    tidy = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = written(tidy, "links")
    state = _state(links)
    while state[0]:
        links = written(_small_star(_large_star(links)), "links")
        before, state = state, _state(links)
        if state == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
