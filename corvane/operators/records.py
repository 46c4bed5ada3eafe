"""Joins and checks over chunk, prompt and result records."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as tx


def looked_up(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunks, by id; the rank column keeps the order."""
    return hits.join(chunks, "chunk_id")


def gold_chunks(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """(item_id, explicit, gold) and (chunk_id, ord, citation_id, labels) to item_id, chunk_id.

    Explicit ids that the index holds win; only an item without any takes the
    chunks whose citation or a sentence label is one of its gold citations.
    """
    held = items.select("item_id", F.explode("explicit").alias("chunk_id")).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    names = chunks.select("chunk_id", F.explode(F.array_distinct(F.concat(F.array("citation_id"), "labels"))).alias("name"))
    cited = items.select("item_id", F.explode("gold").alias("name")).join(names, "name").select("item_id", "chunk_id").distinct()
    return held.select("item_id", "chunk_id").distinct().unionByName(cited.join(held.select("item_id").distinct(), "item_id", "left_anti"))


def inconsistent(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, chunk_id, text) whose chunk the index lacks or reads otherwise."""
    index = chunks.select("chunk_id", F.col("text").alias("held"))
    state = F.when(F.col("held").isNull(), "missing").when(F.col("held") != F.col("text"), "differs")
    return rows.join(index, "chunk_id", "left").select("id", "chunk_id", state.alias("state")).filter("state is not null")


def with_copies(chunks: DataFrame, groups: DataFrame) -> DataFrame:
    """Each chunk with the other members of its document's copy group; none without one."""
    g = groups.select(F.col("id").alias("g_id"), "copies")
    return chunks.join(g, F.col("doc_id") == F.col("g_id"), "left").drop("g_id").withColumn("copies", F.coalesce("copies", F.array().cast("array<string>")))


def is_gold(doc: Column, copies: Column, gold: Column, gold_copies: Column) -> Column:
    """A document is gold, or a linked copy of a gold one, either way round."""
    return F.array_contains(gold, doc) | F.array_contains(gold_copies, doc) | F.arrays_overlap(copies, gold)


def nfc(df: DataFrame, key: str, column: str) -> DataFrame:
    """key, text in NFC and squeezed. Unicode forms have no Spark function; Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "text": [None if t is None else " ".join(unicodedata.normalize("NFC", t).split()) for t in b["t"]]})

    return df.select(F.col(key).alias("k"), F.col(column).alias("t")).mapInPandas(run, f"k {dict(df.dtypes)[key]}, text string").withColumnRenamed("k", key)


def question_forms(question: str) -> set[str]:
    """Every combination of Unicode form, squeezing, and final mark (none, ?, .)."""
    out = set()
    for form in ("NFC", "NFD", None):
        for squeeze in (False, True):
            t = unicodedata.normalize(form, question) if form else question
            t = " ".join(t.split()) if squeeze else t
            bare = t.rstrip("?.").rstrip()
            out |= {t, bare, f"{bare}?", f"{bare}."}
    return out


def question_key(question: str) -> str:
    """SHA-256 of the question in NFC, casefolded, squeezed and without final marks, so that two typings of it share the key."""
    return hashlib.sha256(" ".join(unicodedata.normalize("NFC", question).casefold().split()).rstrip("?. ").encode()).hexdigest()


def keyed(rows: DataFrame, key: str, column: str) -> DataFrame:
    """key, question_key; null for a null text. Case folding and Unicode forms have no Spark function; Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "h": [None if t is None else question_key(t) for t in b["t"]]})

    return rows.select(F.col(key).alias("k"), F.col(column).alias("t")).mapInPandas(run, f"k {dict(rows.dtypes)[key]}, h string").select(F.col("k").alias(key), F.col("h").alias("question_key"))


def contaminated(docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(doc_id, text) and (text) to the doc_ids with a line that is a question.

    A line is one by its key, or by the raw hash of any form of the question.
    Without questions the check would be empty, which is an error.
    """
    if questions.filter("text is not null").isEmpty():
        raise ValueError("no questions: the overlap check would be empty")

    def guard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"h": [h for t in b["text"] if t is not None for h in (question_key(t), *(hashlib.sha256(f.encode()).hexdigest() for f in question_forms(t)))]}, dtype=object)

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, out = [], []
            for i, t in zip(b["doc_id"], b["text"]):
                for h in () if t is None else {h for line in t.split("\n") for h in (question_key(line), hashlib.sha256(line.encode()).hexdigest())}:
                    ids.append(i), out.append(h)
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype=b["doc_id"].dtype), "h": pd.Series(out, dtype=object)})

    found = questions.select("text").mapInPandas(guard, "h string").distinct()
    lines = docs.select("doc_id", "text").mapInPandas(hashes, f"doc_id {dict(docs.dtypes)['doc_id']}, h string")
    return lines.join(found, "h", "left_semi").select("doc_id").distinct()


def valid_pointer_tokens(tokens: Column) -> Column:
    """Whether a token sequence is within the grammar, by folding a state machine over it.

    Tokens: q, cite, c<K>, s<J>, anything else is text. States: 0 text, 1 after
    q, 2 after cite, 3 in a quote without a sentence, 4 in a quote with one, 5
    in a citation, 9 failed.
    """
    is_c, is_s = (lambda t: t.rlike("^c[0-9]+$")), (lambda t: t.rlike("^s[0-9]+$"))

    def step(state, t):
        opened = F.when(t == "q", 1).when(t == "cite", 2).when(is_c(t) | is_s(t), 9).otherwise(0)
        return (
            F.when(state == 9, 9)
            .when(state == 1, F.when(is_c(t), 3).otherwise(9))
            .when(state == 2, F.when(is_c(t), 5).otherwise(9))
            .when(state == 3, F.when(is_s(t), 4).otherwise(9))
            .when((state == 4) | (state == 5), F.when(is_s(t), state).otherwise(opened))
            .otherwise(opened)
        )

    return F.aggregate(tokens, F.lit(0), step).isin(0, 4, 5)


def copy_top(labels: Column, sentences: Column) -> Column:
    """The answer that quotes every sentence of the first passage."""
    return F.concat(F.lit("<|q|><|c1|>"), F.array_join(F.transform(sentences, lambda x, k: F.concat(F.lit("<|s"), (k + 1).cast("string"), F.lit("|>"))), ""))


def fertility(rows: DataFrame) -> DataFrame:
    """(source, tokenizer, tokens, words): tokens over words by source and tokenizer, and pooled over the sources."""
    g = rows.groupingSets([[F.col("source"), F.col("tokenizer")], [F.col("tokenizer")]], "source", "tokenizer")
    return g.agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words"), (F.sum("tokens").cast("double") / F.sum("words")).alias("ratio"))


def pair_problems(pairs: DataFrame) -> DataFrame:
    """(id, label, premise, hypothesis) to id, problems: repeated ids, labels other than 0 and 1, blank sides."""
    from pyspark.sql import Window as W

    n = F.count("*").over(W.partitionBy("id"))
    checks = F.array(F.when(n > 1, "repeated_id"), F.when(~F.coalesce(F.col("label").isin(0, 1), F.lit(False)), "label"), F.when(F.coalesce(F.trim("premise"), F.lit("")) == "", "premise"), F.when(F.coalesce(F.trim("hypothesis"), F.lit("")) == "", "hypothesis"))
    return pairs.select("id", F.filter(checks, lambda x: x.isNotNull()).alias("problems"))


def texts_digest(rows: DataFrame, by: str, order: str, column: str) -> DataFrame:
    """by, digest of the group's texts in order, to tell whether a cache still holds."""
    parts = F.array_sort(F.collect_list(F.struct(order, tx.sha256(F.col(column)).alias("h"))))
    return rows.groupBy(by).agg(parts.alias("p")).select(by, tx.sha256(F.array_join(F.transform("p", lambda x: x["h"]), "\x1f")).alias("digest"))


def read_rating(reply: Column, low: int = 1, high: int = 5) -> Column:
    """A bounded integer rating from a JSON reply; anything else is null."""
    r = F.get_json_object(reply, "$.rating").try_cast("int")
    return F.when(r.between(low, high), r)


def read_verdict(reply: Column) -> Column:
    """correct 1, partial 0.5, incorrect 0; anything else is null."""
    v = F.get_json_object(reply, "$.verdict")
    return F.when(v == "correct", 1.0).when(v == "partial", 0.5).when(v == "incorrect", 0.0)
