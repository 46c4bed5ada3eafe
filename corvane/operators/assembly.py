"""Hits to passages, located sections, hierarchies, gates and summaries as DataFrame operations, and an append-only log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import answers as grammar
from corvane.functions import text as tx


def source_union(sources: dict[str, DataFrame]) -> DataFrame:
    """The rows of all sources, by name, with `source`; columns that one lacks are null."""
    out = None
    for name, df in sources.items():
        rows = df.withColumn("source", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def looked_up(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, id, rank) hits with their chunks' columns; a hit without a chunk is an error."""
    rows = hits.join(chunks.withColumn("found_", F.lit(True)), "id", "left")
    missing = F.raise_error(F.concat(F.lit("no chunk "), F.col("id"))).cast("string")
    return rows.withColumn("id", F.when(F.col("found_"), F.col("id")).otherwise(missing)).drop("found_")


def passages(hits: DataFrame, most: int = 16) -> DataFrame:
    """(qid, rank, citation_id, sentences) to qid, prompt: the best `most` hits, numbered in their order, their sentences marked. A query has a bounded number of hits."""
    listed = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "citation_id", "sentences"))).alias("ps"))
    marked = lambda s: F.array_join(F.transform(s, lambda t, j: F.concat(F.lit("<|s"), (j + 1).cast("string"), F.lit("|>"), t)), " ")
    one = lambda p, k: F.concat(F.lit("<|passage|><|c"), (k + 1).cast("string"), F.lit("|>"), p["citation_id"], F.lit("\n"), marked(p["sentences"]), F.lit("<|/passage|>\n"))
    return listed.select("qid", F.array_join(F.transform(F.slice("ps", 1, most), one), "").alias("prompt"))


def located(text: Column, sections: Column) -> Column:
    """For each section its first place in the text at or after the last one found, from 0; -1 if there is none or it is empty."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(acc: Column, s: Column) -> Column:
        place = F.when(s == "", 0).otherwise(F.coalesce(F.expr("0") + F.call_function("locate", s, text, acc["at"]), F.lit(0)))
        return F.struct(F.when(place > 0, place).otherwise(acc["at"]).alias("at"), F.concat(acc["found"], F.array((place - 1).cast("int"))).alias("found"))

    return F.aggregate(sections, start, step)["found"]


def spans_inside(spans: Column, start: Column, end: Column) -> Column:
    """The (start, end, ...) spans that lie wholly within [start, end), moved to begin there."""
    inside = F.filter(spans, lambda e: (start <= e["start"]) & (e["end"] <= end))
    return F.transform(inside, lambda e: e.withField("start", e["start"] - start).withField("end", e["end"] - start))


def hierarchies(units: Column) -> Column:
    """For each (number, title) unit the titles open at it: those whose number its own continues, then its own if it has one."""
    kind = "array<struct<number:string,title:string>>"
    start = F.struct(F.array().cast(kind).alias("open"), F.array().cast("array<array<string>>").alias("paths"))

    def step(acc: Column, u: Column) -> Column:
        above = F.filter(acc["open"], lambda h: (h["number"] != u["number"]) & u["number"].startswith(h["number"]))
        own = F.when(u["title"] != "", F.concat(above, F.array(F.struct(u["number"].alias("number"), u["title"].alias("title"))))).otherwise(above)
        return F.struct(own.alias("open"), F.concat(acc["paths"], F.array(F.transform(own, lambda h: h["title"]))).alias("paths"))

    return F.aggregate(units, start, step)["paths"]


def accepted(rows: DataFrame, manifest: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose text has the SHA-256 that the manifest (sha256) lists."""
    listed = manifest.select(F.col("sha256").alias("listed_")).distinct()
    return rows.join(listed, tx.sha256(F.col(text)) == F.col("listed_"), "left_semi")


def scrubbed_only(rows: DataFrame, allowed: bool = False) -> DataFrame:
    """(path, scrubbed) rows; one that is not scrubbed is an error unless allowed."""
    if allowed:
        return rows
    refuse = F.raise_error(F.concat(F.lit("not scrubbed: "), F.col("path"))).cast("string")
    return rows.withColumn("path", F.when(F.col("scrubbed"), F.col("path")).otherwise(refuse))


def ablation_summary(records: DataFrame, context: int) -> DataFrame:
    """(arm, id, refused, new_tokens, prompt_tokens) to arm, records, refused, mean_new_tokens, extrapolated (ids whose prompt is longer than the context)."""
    long = F.sort_array(F.collect_list(F.when(F.col("prompt_tokens") > context, F.col("id"))))
    return records.groupBy("arm").agg(F.count("*").alias("records"), F.count_if("refused").alias("refused"), F.round(F.avg("new_tokens"), 9).alias("mean_new_tokens"), long.alias("extrapolated"))


def without_notice(rendered: Column, notice: str = grammar.NOTICE) -> Column:
    """A rendered answer without the notice at its end."""
    cut = F.when(rendered.endswith(notice), F.substring(rendered, F.lit(1), F.length(rendered) - len(notice))).otherwise(rendered)
    return F.regexp_replace(cut, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def as_list(value: Column) -> Column:
    """A JSON value as an array of strings: null and missing none, a list its items, anything else itself."""
    kind = F.when(value.isNull() | (F.trim(value) == "null"), "none").when(F.trim(value).startswith("["), "list").otherwise("one")
    return F.when(kind == "none", F.array().cast("array<string>")).when(kind == "list", F.from_json(value, "array<string>")).otherwise(F.array(F.regexp_replace(F.trim(value), '^"|"$', "")))


def token_means(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, nll, tokens) to by, records, mean_nll (of each record's nll a token) and ppl (of all tokens together)."""
    return rows.groupBy(*by).agg(F.count("*").alias("records"), F.round(F.avg(F.col("nll") / F.col("tokens")), 9).alias("mean_nll"), F.round(F.exp(F.sum("nll") / F.sum("tokens")), 9).alias("ppl"))


class AppendLog:
    """Rows in committed batches under a folder: attempts, samples or replies that a broken-off run goes on from.

    A batch is written aside and renamed to its id; a batch that is there is
    not written again, so a run that sends all its batches once more adds
    nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def batches(self) -> list[str]:
        fs, p = self._at("batches")
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def append(self, batch: str, rows: DataFrame) -> bool:
        """False if the batch was there."""
        fs, final = self._at(f"batches/{batch}")
        if fs.exists(final):
            return False
        _, aside = self._at(f"aside/{batch}")
        rows.write.mode("overwrite").parquet(aside.toString())
        fs.mkdirs(final.getParent())
        return bool(fs.rename(aside, final))

    def rows(self) -> DataFrame:
        found = self.batches()
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/batches/{b}" for b in found))

    def missing(self, wanted: DataFrame, key: str) -> DataFrame:
        """The wanted rows that no batch holds yet, by key (for a reply cache, a hash of everything that the reply depends on)."""
        return wanted.join(self.rows().select(key).distinct(), key, "left_anti")
