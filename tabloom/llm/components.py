"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected with, for every node that has a link.

    Alternates two steps until only stars are left: each node hands its larger neighbours to its smallest one, then each
    node hands its smaller neighbours to the smallest of them. Every step is a minimum combined before the shuffle and
    a join whose large keys Spark may split; a round is written to the shared folder and the next starts from there.
    The table of nodes that starts a round also tells whether one is needed, so links that are stars take none.
    Links to itself, repeats and NULLs are left out.
    """
    pairs = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    pairs = stored(pairs, "links")
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nodes = stored(both.groupBy("a").agg(F.min("b").alias("least"), F.max("b").alias("most")), "link-nodes")
        # done when a node that has a smaller neighbour has no other
        if nodes.where("least < a AND least < most").isEmpty():
            return nodes.select(F.col("a").alias("node"), F.least("a", "least").alias("root"))
        ends = nodes.select(F.col("a").alias("b"), F.least("a", "least").alias("least"))
        large = stored(pairs.join(ends, "b").select("a", F.col("least").alias("b")).distinct(), "links-large")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        # the link to the smallest stays, the end of every other goes over to it
        moved = F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b"))
        small = large.join(least, "a").select(moved.alias("a"), F.col("least").alias("b")).distinct()
        pairs = stored(small, "links-small")
