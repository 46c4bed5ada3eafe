"""Pointer answers as DataFrame operations: extraction, checks, rendering, verification, summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import answers as grammar
from corvane.operators.filters import asks_for_party

POINTER = r"<\|(?:q|cite)\|><\|c\d+\|>(?:<\|s\d+\|>)*"


def pointers(answer: Column) -> Column:
    """Array of (kind, passage, sentences) in order."""
    number = lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"<\|s(\d+)\|>"), F.lit(1)), lambda j: j.cast("int"))
    one = lambda x: F.struct(F.when(x.startswith("<|q|>"), "quote").otherwise("cite").alias("kind"), F.regexp_extract(x, r"<\|c(\d+)\|>", 1).cast("int").alias("passage"), number(x).alias("sentences"))
    return F.transform(F.regexp_extract_all(answer, F.lit(POINTER), F.lit(0)), one)


def well_formed(answer: Column) -> Column:
    """Whether the answer is within the grammar: no markup beyond pointers, quotes with sentences, unanswerable alone."""
    body = F.regexp_replace(answer, r"<\|endoftext\|>$", "")
    alone = F.trim(body) == grammar.UNANSWERABLE
    rest = F.regexp_replace(body, POINTER, "")
    bare_quote = body.rlike(r"<\|q\|><\|c\d+\|>(?!<\|s\d+\|>)")
    return alone | ~(rest.rlike(r"<\|[^|<>]*\|>") | bare_quote)


def pointer_ok(p: Column, sizes: Column) -> Column:
    """A pointer against the passages' sentence counts: ranges, no repeats, quotes consecutive."""
    n = F.try_element_at(sizes, p["passage"])
    s = p["sentences"]
    run = F.forall(F.transform(s, lambda j, k: j - k), lambda x: x == s[0] - 0)
    inside = F.forall(s, lambda j: (j >= 1) & (j <= n))
    distinct = F.size(F.array_distinct(s)) == F.size(s)
    return F.coalesce((p["passage"] >= 1) & n.isNotNull() & inside & distinct & ((p["kind"] == "cite") | ((F.size(s) > 0) & run)), F.lit(False))


def pointer_text(p: Column) -> Column:
    return F.concat(F.when(p["kind"] == "quote", "<|q|>").otherwise("<|cite|>"), F.lit("<|c"), p["passage"].cast("string"), F.lit("|>"), F.array_join(F.transform(p["sentences"], lambda j: F.concat(F.lit("<|s"), j.cast("string"), F.lit("|>"))), ""))


def source_text(sentences: Column, idx: Column) -> Column:
    return F.array_join(F.transform(idx, lambda j: F.element_at(sentences, j)), " ")


def rendered_quote(sentences: Column, labels: Column, idx: Column) -> Column:
    """The sentences word for word in quotation marks, then their distinct labels in order."""
    names = F.array_distinct(F.transform(idx, lambda j: F.element_at(labels, j)))
    return F.concat(F.lit(grammar.OPEN), source_text(sentences, idx), F.lit(grammar.CLOSE + " ("), F.array_join(names, grammar.SEPARATOR), F.lit(")"))


CLAIM = "struct<index:int,pointers:array<string>,passed:boolean,reason:string,entailment:double>"


def verify(rows: DataFrame, nli: Callable[[str, str], float] = grammar.overlap_entailment, ner: Callable[[str], list] | None = None, threshold: float = grammar.THRESHOLD) -> DataFrame:
    """(id, question, answer, passages) to id, rendered, refused, reason, precision, claims. The models are callables; the defaults are deterministic stand-ins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                ps = [{"sentences": list(p["sentences"]), "labels": list(p["labels"]), "citation_id": p["citation_id"], "source": p["source"], "copies": [], "text": "\n".join([p["citation_id"], *p["sentences"]])} for p in r.passages]
                out.append({"id": r.id} | grammar.verify(bool(r.party), r.answer or "", ps, nli, ner, threshold))
            yield pd.DataFrame(out, columns=["id", "rendered", "refused", "reason", "precision", "claims"])

    asked = rows.select("id", "answer", "passages", F.coalesce(asks_for_party(F.col("question")), F.lit(False)).alias("party"))
    return asked.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, rendered string, refused boolean, reason string, precision double, claims array<{CLAIM}>")


def pooled_precision(claims: DataFrame, by: list[str]) -> DataFrame:
    """by, cited, passed, precision over claims that cite; null where none does."""
    cited = F.col("cited")
    return claims.groupBy(*by).agg(F.count_if(cited).alias("cited_claims"), F.count_if(cited & F.col("passed")).alias("passed_cited_claims"), F.try_divide(F.count_if(cited & F.col("passed")).cast("double"), F.count_if(cited).cast("double")).alias("precision"))


def refusal_scores(records: DataFrame, by: list[str]) -> DataFrame:
    """Refusal precision, recall and F1 with "should refuse" as the positive class; null where nothing should be refused."""
    g = records.groupBy(*by).agg(F.count("*").alias("records"), F.count_if("refused").alias("refused"), F.count_if("should_refuse").alias("should"), F.count_if(F.col("refused") & F.col("should_refuse")).alias("correct"), F.avg((F.col("refused") == F.col("should_refuse")).cast("int")).alias("accuracy"))
    p = F.when(F.col("refused") > 0, F.col("correct") / F.nullif("refused", F.lit(0))).otherwise(F.lit(0.0))
    r = F.col("correct") / F.nullif("should", F.lit(0))
    has = F.col("should") > 0
    f1 = F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(F.lit(0.0))
    return g.select(*by, "records", F.when(has, p).alias("precision"), F.when(has, r).alias("recall"), F.when(has, f1).alias("f1"), F.round("accuracy", 9).alias("accuracy"))


def best_of_n(samples: DataFrame) -> DataFrame:
    """(id, n, score, truncated, refused) to id, n, model_refused: the best score, earliest first, truncated ones at -1; refused when half or more refuse."""
    score = F.when(F.col("truncated"), -1.0).otherwise(F.col("score"))
    g = samples.groupBy("id").agg(F.max(F.struct(score.alias("s"), (-F.col("n")).alias("k")))["k"].alias("k"), (F.count_if("refused") * 2 >= F.count("*")).alias("model_refused"))
    return g.select("id", (-F.col("k")).alias("n"), "model_refused")


def select_pairs(samples: DataFrame) -> DataFrame:
    """(id, n, good, sentence_overlap, passage_overlap): chosen is the good sample of most overlap, first on ties; rejected the first bad one."""
    chosen = F.max(F.when(F.col("good"), F.struct("sentence_overlap", "passage_overlap", (-F.col("n")).alias("k"))))["k"]
    rejected = F.min(F.when(~F.col("good"), F.col("n")))
    return samples.groupBy("id").agg((-chosen).alias("chosen"), rejected.alias("rejected")).filter("chosen is not null and rejected is not null")


def balance(pairs: DataFrame, refuse_share: tuple[int, int]) -> DataFrame:
    """(id, refusal): the side over the share refuse / all is cut, by hash of id, to the number the other side allows, rounded up."""
    from corvane.functions import text as tx

    refuse, answer = refuse_share[0], refuse_share[1] - refuse_share[0]
    if not refuse or not answer:
        return pairs
    place = F.row_number().over(W.partitionBy("refusal").orderBy(tx.unit(0, F.col("id").cast("string")), "id"))
    n = pairs.agg(F.count_if("refusal").alias("r"), F.count_if(~F.col("refusal")).alias("a"))  # one row
    rows = pairs.withColumn("place", place).crossJoin(F.broadcast(n))
    over = F.col("r") * answer > F.col("a") * refuse
    keep_r = F.when(over, F.ceil(F.col("a") * refuse / F.lit(answer))).otherwise(F.col("r"))
    keep_a = F.when(over, F.col("a")).otherwise(F.ceil(F.col("r") * answer / F.lit(refuse)))
    return rows.filter(F.col("place") <= F.when(F.col("refusal"), keep_r).otherwise(keep_a)).select(*pairs.columns)


def selection_outcomes(records: DataFrame) -> DataFrame:
    """(id, arm, chunk_ids, gold, answer) to id, arm, position, selected, any_gold, model_refused by the answer's pointers."""
    cited = F.transform(pointers(F.col("answer")), lambda p: F.try_element_at(F.col("chunk_ids"), p["passage"]))
    r = records.withColumn("cited", cited)
    return r.select("id", "arm", F.array_position("chunk_ids", F.col("gold")).alias("position"), F.coalesce(F.try_element_at("cited", F.lit(1)) == F.col("gold"), F.lit(False)).alias("selected"), F.coalesce(F.array_contains("cited", F.col("gold")), F.lit(False)).alias("any_gold"), F.col("answer").contains(grammar.UNANSWERABLE).alias("model_refused"))
