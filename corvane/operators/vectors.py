"""Exact inner-product search in blocks.

The query vectors meet the corpus in blocks of both, keyed by block number;
each task multiplies two blocks and keeps its best k a query, and one window
merges those. Neither side is collected or broadcast whole.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS, QUERY_ROWS = 8192, 512


def _blocks(df: DataFrame, n: int, names: tuple[str, str, str]) -> DataFrame:
    block, ids, matrix = names
    dealt = df.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(block), "id", "vector")
    return dealt.groupBy(block).agg(F.collect_list(F.struct("id", "vector")).alias("rows")).select(block, F.col("rows.id").alias(ids), F.col("rows.vector").alias(matrix))


def _matrix(rows: pa.ListScalar) -> np.ndarray:
    """The vectors of a block, all of one length, as rows."""
    return np.asarray(rows.values.flatten().cast(pa.float64())).reshape(len(rows.values), -1)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row the places of its k best, ties to the smaller id; only what reaches the k-th score is sorted."""
    k = min(k, score.shape[1])
    least = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    for row, t in zip(score, least, strict=True):
        at = np.flatnonzero(row >= t)
        yield at[np.lexsort((ids[at], -row[at]))[:k]]


def _multiply(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(b.schema.get_field_index(c)) for c in ("q_ids", "q_matrix", "c_ids", "c_matrix")]
            for q_ids, q, c_ids, c in zip(*columns, strict=True):
                score = np.round(_matrix(q) @ _matrix(c).T, 6)
                asked, ids = (np.asarray(x.values) for x in (q_ids, c_ids))
                best = list(_best(score, ids, k))
                row = np.repeat(np.arange(len(asked)), [len(x) for x in best])
                at = np.concatenate(best)
                yield pa.RecordBatch.from_arrays([pa.array(asked[row]), pa.array(ids[at]), pa.array(score[row, at])], ["qid", "id", "score"])

    return run


def exact_top_k(queries: DataFrame, corpus: DataFrame, k: int = 10) -> DataFrame:
    """(qid, vector) and (id, vector) to qid, id, score, rank; scores to six places, ties to the smaller id."""
    nq, nc = queries.count(), corpus.count()
    blocks = max(1, -(-nc // BLOCK_ROWS))
    q = _blocks(queries.withColumnRenamed("qid", "id"), max(1, -(-nq // QUERY_ROWS)), ("q_block", "q_ids", "q_matrix"))
    c = _blocks(corpus, blocks, ("c_block", "c_ids", "c_matrix"))
    # a task meets one block of each side
    q = q.withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    parts = q.join(c, "c_block").select("q_ids", "q_matrix", "c_ids", "c_matrix").mapInArrow(_multiply(k), "qid long, id long, score double")
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.col("score").desc(), "id"))
    return parts.withColumn("rank", place.cast("int")).filter(F.col("rank") <= k)


def hashed_words(texts: list[str], dim: int = 64) -> np.ndarray:
    """A deterministic stand-in for an encoder: signed word counts by hash, at unit length."""
    out = np.zeros((len(texts), dim))
    for row, text in zip(out, texts, strict=True):
        for word in (text or "").lower().split():
            h = zlib.crc32(word.encode())
            row[h % dim] += 1 if h >> 16 & 1 else -1
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)


def encoded(df: DataFrame, key: str, encode: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """(key, text) to key, vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(made), pa.list_(pa.float64()))], [key, "vector"])

    return df.select(key, "text").mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, vector array<double>")


class DenseIndex:
    """Vectors in batches under a folder; a batch counts once its own success marker stands, and the index once meta.json does."""

    def __init__(self, spark: SparkSession, path: str, settings: dict):
        self.spark, self.path, self.settings = spark, path, settings

    @classmethod
    def build(cls, corpus: DataFrame, encode: Callable[[list[str]], np.ndarray], path: str, batches: int = 16, settings: dict | None = None) -> list[int]:
        """Encode (id, text) batch by batch and return the batches that were made now: a build that was broken off goes on where it stopped."""
        spark, made = corpus.sparkSession, []
        exists = lambda p: (x := spark._jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(x)
        if exists(f"{path}/meta.json/_SUCCESS"):
            return made
        for k in range(batches):
            if not exists(f"{path}/batch={k}/_SUCCESS"):
                own = corpus.filter(F.pmod(F.xxhash64("id"), F.lit(batches)) == k)
                encoded(own, "id", encode).write.mode("overwrite").parquet(f"{path}/batch={k}")
                made.append(k)
        meta = {"kind": "dense", "batches": batches} | (settings or {})
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta.json")
        return made

    @classmethod
    def load(cls, spark: SparkSession, path: str, **expected) -> DenseIndex:
        settings = json.loads(spark.read.text(f"{path}/meta.json").first()[0])
        if differs := {k: (settings.get(k), v) for k, v in ({"kind": "dense"} | expected).items() if settings.get(k) != v}:
            raise ValueError(f"the index at {path} has other settings: {differs}")
        return cls(spark, path, settings)

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/batch={k}" for k in range(self.settings["batches"])))

    def top_k(self, queries: DataFrame, encode: Callable[[list[str]], np.ndarray], k: int = 10) -> DataFrame:
        """(qid, text) to qid, id, score, rank by inner product."""
        return exact_top_k(encoded(queries, "qid", encode), self.vectors(), k)
