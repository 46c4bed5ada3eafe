"""Streaming forms of the batch aggregations, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are left out of closed windows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def once(rows: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each key once within the watermark: a rerun of the same input adds nothing."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def append_new(batch: DataFrame, path: str, keys: list[str]) -> None:
    """For foreachBatch: append the rows whose keys the sink lacks, so a batch that comes again writes nothing."""
    spark = batch.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    seen = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path)
    fresh = batch.dropDuplicates(keys)
    if seen:
        fresh = fresh.join(spark.read.schema(batch.schema).parquet(path).select(*keys), keys, "left_anti")
    fresh.write.mode("append").parquet(path)
