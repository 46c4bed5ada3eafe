"""Connected components by alternating large and small stars over staged edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import common


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars from least nodes: each upper end once, and no lower end above another."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")), F.struct(F.col("b").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")))))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("m").alias("a"), "b").filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
    linked = down.join(least, F.col("a") == F.col("k")).select(F.col("m").alias("a"), "b").filter("a <> b")
    return linked.unionByName(least.select(F.col("m").alias("a"), F.col("k").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, component): the least node reachable, for every node with an edge except that least one.

    Rounds are logarithmic in the size of the largest component. Each is a
    staged table, so a lost executor costs no more than its own round; the
    tables of earlier rounds are dropped, and no part of the graph reaches the
    driver.
    """

    since = common.mark()
    now = common.staged(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not _settled(now):
        now = common.staged(_small_star(_large_star(now)), "edges")
        common.drop_since(since)
    return now.select(F.col("b").alias("node"), F.col("a").alias("component"))
