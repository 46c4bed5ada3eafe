"""Staged tables and running totals over a whole order.

A staged table ends a lineage: it is written as Parquet under the folder that
driver and executors share, so it survives lost executors, and is read back
with its columns and statistics. Running totals are kept over ranges of the
order, of about equal numbers of rows, instead of in one task.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a range, about.
RANGE = 500_000
_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session may go without, and gets a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """End the lineage in a staged table, which lives as long as the driver unless drop_since takes it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/corvane/{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    return len(_written)


def drop_since(since: int) -> None:
    """Drop all tables staged since a mark but the last, when nothing else of them will be read."""
    for spark, path in _written[since:-1]:
        dropped(spark, path)
    del _written[since:-1]


def dropped(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _written:
        dropped(spark, path)


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """df staged with range_, the number of its rows' range in the order; equal keys share a range."""
    n = max(1, -(-df.count() // RANGE))
    return cut(df.repartitionByRange(n, *order).withColumn("range_", F.spark_partition_id()))


def running(df: DataFrame, amount: Column, name: str, *order: Column | str, by: tuple[str, ...] = ()) -> DataFrame:
    """df with `name`, the sum of the amounts before each row in the order, within the groups `by`.

    Totals of ranges come first, of which there are few; then a window in each range.
    """
    rows = ranged(df.withColumn("amount_", amount), *order)
    earlier = W.partitionBy(*by).orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(*by, "range_").agg(F.sum("amount_").alias("sum_")).withColumn("base_", F.coalesce(F.sum("sum_").over(earlier), F.lit(0)))
    sums = sums.select(F.col("range_").alias("of_range_"), "base_", *(F.col(c).alias(f"of_{c}") for c in by))
    same = F.col("range_") == F.col("of_range_")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    inner = W.partitionBy(*by, "range_").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = rows.join(sums, same).withColumn(name, F.col("base_") + F.coalesce(F.sum("amount_").over(inner), F.lit(0)))
    return out.drop("amount_", "range_", "of_range_", "base_", *(f"of_{c}" for c in by))
