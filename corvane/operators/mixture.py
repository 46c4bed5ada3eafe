"""Mixture weights, seeded schedules and rank shards.

Draws are hashes of (seed, key), not a generator's stream: the same rows come
out whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators.corpus import ARMS


def effective_weights(sources: DataFrame, groups: DataFrame, arm: str) -> DataFrame:
    """(name, grp, weight, arm), (grp, share) to name, weight: the group's share by weight within it; groups without a source drop out."""
    if arm not in ARMS:
        raise ValueError(f"arm {arm!r} not in {ARMS}")
    admitted = sources.filter("weight > 0") if arm == "research" else sources.filter("weight > 0 and arm = 'commercial_safe'")
    rows = admitted.join(groups, "grp").withColumn("w", F.col("share") * F.col("weight") / F.sum("weight").over(W.partitionBy("grp")))
    return rows.select("name", (F.col("w") / F.sum("w").over(W.partitionBy())).alias("weight"))  # a row a source


def schedule(spark: SparkSession, weights: DataFrame, counts: DataFrame, samples: int, seed: int = 0, start: int = 0) -> DataFrame:
    """i, name, wrap, row: draw i picks a source by cumulative weight; the k-th draw of a source takes row k of its hash order, anew each wrap."""
    total = start + samples
    order = W.orderBy("name")  # a row a source
    steps = weights.select("name", F.sum("weight").over(order).alias("upto"), F.coalesce(F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("since"), (F.row_number().over(order) == F.count("*").over(W.partitionBy())).alias("last"))
    draws = spark.range(total).withColumn("u", tx.unit(seed, F.concat(F.lit("draw:"), F.col("id").cast("string"))))
    picked = draws.join(F.broadcast(steps), (F.col("u") >= F.col("since")) & ((F.col("u") < F.col("upto")) | F.col("last")))
    seen = picked.withColumn("k", F.row_number().over(W.partitionBy("name").orderBy("id")) - 1)
    at = seen.join(F.broadcast(counts), "name").withColumns({"wrap": F.floor(F.col("k") / F.col("rows")), "place": F.col("k") % F.col("rows")})
    need = at.select("name", "wrap", "rows").distinct()
    orders = need.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    key = F.concat(F.col("name"), F.lit(":"), F.col("wrap").cast("string"), F.lit(":"), F.col("row").cast("string"))
    orders = orders.withColumn("place", F.row_number().over(W.partitionBy("name", "wrap").orderBy(tx.unit(seed, key), "row")) - 1)
    return at.join(orders.drop("rows"), ["name", "wrap", "place"]).filter(F.col("id") >= start).select((F.col("id") - start).alias("i"), "name", "wrap", "row")


def rank_rows(n: int | None, rows: DataFrame, index: str, world: int, consumed: int = 0) -> DataFrame:
    """Adds rank: row i goes to rank i mod world; the first `consumed` of each rank are done, and only whole rounds count."""
    out = rows if n is None else rows.filter(F.col(index) < n - n % world)
    return out.withColumns({"rank": F.pmod(F.col(index), F.lit(world)).cast("int"), "turn": F.floor(F.col(index) / world)}).filter(F.col("turn") >= consumed)


def padded_ranks(spark: SparkSession, n: int, world: int) -> DataFrame:
    """i, rank: every row once, wrapping from the start until all ranks have equally many."""
    return spark.range(-(-n // world) * world).select((F.col("id") % n).alias("i"), F.pmod("id", F.lit(world)).cast("int").alias("rank"))


def epochs(spark: SparkSession, n: int, total: int, seed: int = 0) -> DataFrame:
    """i, row: hash orders of n rows, one pass after the other, cut to the total."""
    rows = spark.range(-(-total // n)).withColumnRenamed("id", "pass").crossJoin(spark.range(n).withColumnRenamed("id", "row"))
    key = F.concat(F.col("pass").cast("string"), F.lit(":"), F.col("row").cast("string"))
    place = F.row_number().over(W.partitionBy("pass").orderBy(tx.unit(seed, key), "row")) - 1
    return rows.select((F.col("pass") * n + place).alias("i"), "row").filter(F.col("i") < total)
