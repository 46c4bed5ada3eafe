"""Record sources and sinks: JSON lines, parts in collection order, evaluation sets, manifests and a version registry."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as tx

DOCUMENT = (
    "id string, source string, jurisdiction string, doc_type string, licence string, commercial_safe boolean, research_only boolean, text string, citation_id string, url string, valid_from string, valid_to string, retrieved_at string, sha256 string, "
    "sections array<struct<label:string,absatz:int,satz_idx:int,randnummer:int,text:string,part:string>>, hierarchy array<string>"
)


def read_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """JSON lines with the document schema; blank lines are skipped, a line that is not JSON fails."""
    return spark.read.schema(DOCUMENT).option("mode", "FAILFAST").json(list(paths))


def read_complete_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines split at \\n only; a torn last line, which is not whole JSON, is dropped."""
    lines = spark.read.text(path, lineSep="\n").filter(F.trim("value") != "")
    whole = lines.filter(F.try_parse_json("value").isNotNull())
    return whole.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_parts(parts: list[DataFrame], order: str) -> DataFrame:
    """Interleaved part files in collection order: line j of part k of n was line k + n * j. order: each part's line number."""
    n = len(parts)
    rows = [p.withColumn("ord", F.lit(k) + F.lit(n) * F.col(order)) for k, p in enumerate(parts)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.orderBy("ord")


def part_paths(names: list[str], source: str) -> list[str]:
    """The files source.part-k-of-n in order; an incomplete set raises."""
    found = {}
    for name in names:
        stem, _, rest = name.rpartition(".part-")
        if stem == source and "-of-" in rest:
            k, n = (int(x.split(".")[0]) for x in rest.split("-of-"))
            found.setdefault(n, {})[k] = name
    if len(found) != 1 or set(next(iter(found.values()))) != set(range(next(iter(found)))):
        raise FileNotFoundError(f"the parts of {source} are not complete: {sorted(names)}")
    parts = next(iter(found.values()))
    return [parts[k] for k in sorted(parts)]


def trec_passages(texts: DataFrame) -> DataFrame:
    """(text) with <DOC> elements to docno, text."""
    docs = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<DOC>(.*?)</DOC>"), F.lit(1))).alias("d"))
    return docs.select(F.trim(F.regexp_extract("d", r"(?s)<DOCNO>(.*?)</DOCNO>", 1)).alias("id"), F.regexp_replace(F.regexp_extract("d", r"(?s)<TEXT>(.*?)</TEXT>", 1), r"^\s+|\s+$", "").alias("text"))


def tsv_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query, iteration, passage, relevance by tabs."""
    return spark.read.schema("query_id string, iter string, passage_id string, relevance int").csv(path, sep="\t").drop("iter")


SQUAD = "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,answers:array<struct<text:string,answer_start:int>>>>>>>>"


def squad_items(spark: SparkSession, path: str) -> DataFrame:
    """Nested question sets to id, question, answers, context."""
    d = spark.read.schema(SQUAD).json(path, multiLine=True).select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p"))
    q = d.select("p.context", F.explode("p.qas").alias("q"))
    return q.select("q.id", "q.question", F.transform("q.answers", lambda a: a["text"]).alias("answers"), "context")


def write_manifest(rows: DataFrame, path: str) -> None:
    """JSON lines, keys sorted; complete or absent by the job's commit."""
    rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value")).write.text(path)


class Registry:
    """Versions of built tables in one JSON file, replaced as a whole.

    A version is added only if the content differs from the latest one of the
    same directory. Content is the hash of the sorted row hashes' sum, one
    number a table, so nothing but that number reaches the driver.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def entries(self) -> list[dict]:
        fs, p = self._fs(self.path)
        return json.loads(self.spark.read.text(self.path, wholetext=True).first()[0]) if fs.exists(p) else []

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    @staticmethod
    def content(rows: DataFrame) -> str:
        h = tx.sha256(F.to_json(F.struct(*sorted(rows.columns))))
        low = F.conv(F.substring(h, 1, 15), 16, 10).cast("decimal(38,0)")
        high = F.conv(F.substring(h, 16, 15), 16, 10).cast("decimal(38,0)")
        a = rows.agg(F.count("*").alias("n"), F.sum(low).alias("a"), F.sum(high).alias("b")).first()
        return f"{a['n']}-{a['a'] or 0}-{a['b'] or 0}"

    def register(self, rows: DataFrame, directory: str, kind: str) -> int:
        """The version that holds these rows, a new one if they differ."""
        found, digest = self.entries(), self.content(rows)
        mine = [e for e in found if e["index_dir"] == directory]
        if mine and mine[-1]["content"] == digest:
            return mine[-1]["version"]
        version = max((e["version"] for e in found), default=0) + 1
        found.append({"version": version, "kind": kind, "index_dir": directory, "content": digest, "built_at": datetime.now(UTC).isoformat(timespec="seconds")})
        fs, p = self._fs(self.path)
        aside = self._fs(f"{self.path}.{uuid.uuid4().hex}")[1]
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(found, indent=1).encode()))
        out.close()
        fs.delete(p, False)
        fs.rename(aside, p)
        return version
