"""Connected components of a link table by alternating large and small stars.

Each round hangs every node on the least node it knows. Nothing is gathered: a hub costs rows of a partial minimum and
a join that adaptive execution splits. Links are staged in the shared folder between rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm._frames import staged


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.join(least, "a").where("b > a AND b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    # every link has a > b, so the neighbours of a are all smaller
    least = staged(links.groupBy("a").agg(F.min("b").alias("m")))
    moved = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """links: two columns of one orderable type, undirected, repeats and loops allowed. Returns (node, root) for every
    node with a link that isn't itself a root; a root is the least node of its component."""
    a, b = links.columns
    now = staged(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    while True:
        after = staged(_small_star(_large_star(now)))
        # a fixed point is a set of stars: no root is itself a leaf
        loose = after.join(after.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        if not loose:
            # one leaf may still hang on two roots
            if not after.groupBy("a").count().where("count > 1").limit(1).count():
                return after.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = after
