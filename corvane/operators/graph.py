"""Connected components over edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.stage import cut, drop_since, mark


def components(edges: DataFrame) -> DataFrame:
    """(a, b) of any ordered type to (node, component): the least node reachable, for every node in an edge.

    Large stars link each node's larger neighbours to the least of its
    neighbourhood, small stars the smaller ones; rounds are logarithmic in a
    component's size, and only a count and a checksum reach the driver.
    """
    since = mark()
    e = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sign = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("k")).select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = down.join(low, F.col("a") == F.col("k")).select(F.col("m").alias("a"), "b").filter("a <> b")
        e = cut(small.unionByName(low.select(F.col("m").alias("a"), F.col("k").alias("b"))).distinct())
        drop_since(since)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == sign or not now[0]:
            break
        sign = now
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def copy_groups(log: DataFrame) -> DataFrame:
    """(id, duplicate_of, dropped) to id, component, members: the least id of the group over kept links, and the group's size. A missing flag counts as dropped.

    Membership stands for the lists of all others, whose lengths would add up to the square of a group's size.
    """
    links = log.filter(~F.coalesce(F.col("dropped"), F.lit(True))).select(F.col("id").alias("a"), F.col("duplicate_of").alias("b"))
    c = components(links)
    sizes = c.groupBy(F.col("component").alias("of")).agg(F.count("*").alias("members"))
    return c.join(sizes, F.col("component") == F.col("of")).select(F.col("node").alias("id"), "component", "members")
