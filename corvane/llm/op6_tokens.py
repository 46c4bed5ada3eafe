"""Token counts as delta-maintained rollups.

Batches of signed changes (insert, delete, revise) are summed to deltas by
source, language and tokenizer version and committed under their batch id. The
deltas are written first; a batch counts once a manifest version names it.
Every version states all that counts and is published under the next number
only if nobody else took it, so of two writers one has to look again: a batch
counts once however often and by however many it is sent, two compactions do
not both count, and a writer that dies leaves nothing behind that counts.
Totals are the sum of all committed deltas; compaction folds them into one.

Defined results. A null text has no tokens and counts as a document. A null
source or language is a key of its own. Repeated rows count as often as they
occur. An empty batch commits and changes nothing. Groups whose documents and
tokens both come to zero are left out. Changes with another op than the three
are refused. Other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common

KEYS = ("source", "lang", "tokenizer")
VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k")
_encoders: dict[str, object] = {}


def _encoder(version: str):
    if version not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{version}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[version] = tiktoken.Encoding(version, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[version]


def _counted(versions: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(batch.num_columns - 1)]
            counts = [pa.array([len(e.encode_to_numpy(t)) if t else 0 for t in texts], pa.int64()) for e in map(_encoder, versions)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts], [*batch.schema.names[:-1], *versions])

    return run


def counted(docs: DataFrame, versions: tuple[str, ...] = VERSIONS) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens: a row for each document and version. Each text is read once."""
    rows = docs.select("doc_id", "source", "lang", "text")
    kinds = dict(rows.dtypes)
    wide = rows.mapInArrow(_counted(versions), f"doc_id {kinds['doc_id']}, source {kinds['source']}, lang {kinds['lang']}, " + ", ".join(f"{v} long" for v in versions))
    cells = F.array(*(F.struct(F.lit(v).alias("tokenizer"), F.col(v).alias("tokens")) for v in versions))
    return wide.select("doc_id", "source", "lang", F.inline(cells))


class Rollups:
    """Committed deltas under a folder that all executors share, on a file system that can refuse to replace a file."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _state(self) -> dict:
        """The last version: its number, the ids that were committed, and the folders to sum."""
        fs, p = self._fs(f"{self.root}/manifest")
        numbers = sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []
        if not numbers:
            return {"version": 0, "batches": [], "folders": []}
        return json.loads(self.spark.read.text(f"{self.root}/manifest/{numbers[-1]}", wholetext=True).first()[0])

    def _publish(self, state: dict) -> bool:
        """Write this version; False if another writer was first."""
        name = f"{state['version']:012d}"
        aside, final = f"{self.root}/aside/{uuid.uuid4().hex}", f"{self.root}/manifest/{name}"
        fs, p = self._fs(aside)
        out = fs.create(p, False)
        out.write(json.dumps(state).encode())
        out.close()
        target = self._fs(final)[1]
        fs.mkdirs(target.getParent())
        jvm = self.spark._jvm
        try:
            if fs.getUri().getScheme() == "file":  # a rename replaces there, a link does not
                here, there = (jvm.java.nio.file.Path.of(x.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0)) for x in (p, target))
                jvm.java.nio.file.Files.createLink(there, here)
                fs.delete(p, False)
            else:
                none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark._jsc.hadoopConfiguration()).rename(p, target, none)
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            fs.delete(p, False)
            return False
        return True

    def committed(self) -> list[str]:
        """The ids of the batches that count."""
        return sorted(self._state()["batches"])

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit (op, source, lang, tokenizer, tokens, old_tokens); False if the batch was committed before.

        insert adds a document and its tokens, delete takes them away, revise
        replaces old_tokens by tokens.
        """
        if batch_id in self._state()["batches"]:
            return False
        folder = self._written(deltas(changes))
        while batch_id not in (now := self._state())["batches"]:
            if self._publish({"version": now["version"] + 1, "batches": [*now["batches"], batch_id], "folders": [*now["folders"], folder]}):
                return True
        self._delete(folder)
        return False

    def _written(self, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/deltas/{folder}")
        return folder

    def _delete(self, folder: str) -> None:
        fs, p = self._fs(f"{self.root}/deltas/{folder}")
        fs.delete(p, True)

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema("source string, lang string, tokenizer string, docs long, tokens long").parquet(*(f"{self.root}/deltas/{f}" for f in folders))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all committed batches."""
        folders = self._state()["folders"]
        if not folders:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, docs long, tokens long")
        return _summed(self._read(folders)).filter("docs <> 0 or tokens <> 0")

    def compact(self) -> bool:
        """Fold the deltas of all committed batches into one; False if another compaction was first. Batches that come meanwhile stay beside it."""
        old = self._state()["folders"]
        if len(old) < 2:
            return False
        fold = self._written(_summed(self._read(old)))
        while set(old) <= set((now := self._state())["folders"]):
            if self._publish({"version": now["version"] + 1, "batches": now["batches"], "folders": [fold, *(f for f in now["folders"] if f not in old)]}):
                for folder in old:
                    self._delete(folder)
                return True
        self._delete(fold)
        return False


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums by key; partial sums are made before the shuffle, so a hot key costs a row a task."""
    op = F.col("op")
    known: Column = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0)
    sign = F.coalesce(known, F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce(op, F.lit("null")))).cast("int"))
    tokens = F.coalesce("tokens", F.lit(0)).cast("long")
    change = F.when(op == "revise", tokens - F.coalesce("old_tokens", F.lit(0)).cast("long")).otherwise(sign * tokens)
    return changes.groupBy(*KEYS).agg(F.sum(sign.cast("long")).alias("docs"), F.sum(change).alias("tokens"))


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after an insert of all documents, a revision, a deletion, and a batch sent twice.

    The revision counts an end token for documents whose id's crc32 is 1
    modulo 7; the deletion takes those away whose crc32 is 0 modulo 11.
    """
    rows = common.staged(counted(common.table(spark, sf_dir, "documents")), "token-counts")
    book = Rollups(spark, common.scratch_path(spark, "rollups"))
    change = rows.withColumn("old_tokens", F.lit(0).cast("long"))
    revised = change.filter(common.held_out(F.col("doc_id"), 7, 1))
    revised = revised.withColumns({"op": F.lit("revise"), "old_tokens": F.col("tokens"), "tokens": F.col("tokens") + 1})
    now = F.col("tokens") + F.when(common.held_out(F.col("doc_id"), 7, 1), 1).otherwise(0)
    gone = change.filter(common.held_out(F.col("doc_id"), 11, 0)).withColumns({"op": F.lit("delete"), "tokens": now})
    book.commit("1", change.withColumn("op", F.lit("insert")))
    book.commit("2", revised)
    book.commit("3", gone)
    book.commit("2", revised)
    return book.totals()


QUERIES, ORACLES = {"op6_tokens": op6_tokens}, {}
