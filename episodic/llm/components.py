"""Connected components of a table of links, as joins and aggregations.

Alternating large-star and small-star steps: every node hands its larger (then its smaller)
neighbours to the smallest node it knows, until all links point to their component's smallest
node.  The number of links never grows, each step is written to the shared folder, and only a
count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodic.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of ``links`` (a, b); component is the smallest id reachable."""
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    seen = None
    while True:
        # large star: the larger neighbours of u go to the least node next to u
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a > b").distinct()
        # small star: u and its smaller neighbours go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("b"))
        others = large.join(least.select("a", F.col("b").alias("m")), "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(others.unionByName(least).distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.max("b")).collect()[0]
        if state == seen:
            break
        seen = state
    leaves = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("id"), "component").distinct())
