"""Training and evaluation sets: budgets, distractors, shares, splits and spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as tx


def until_budget(docs: DataFrame, by: str, size: str, budget: int, seed: int) -> DataFrame:
    """by, id, place: rows in hash order up to the first that would pass the budget."""
    order = W.partitionBy(by).orderBy(tx.sha256(F.concat(F.lit(f"{seed}:"), F.col("id"))), "id")
    return docs.withColumns({"place": F.row_number().over(order), "upto": F.sum(size).over(order)}).filter(F.col("upto") <= budget).select(by, "id", "place")


def with_distractors(pool: DataFrame, k: int, seed: int) -> DataFrame:
    """(item_id, gold, id) to item_id, position, prompt: the first k by hash, the gold one put in at a hashed place; items with fewer are left out."""
    item = F.col("item_id").cast("string")
    p = F.row_number().over(W.partitionBy("item_id").orderBy(tx.sha256(F.concat(F.lit(f"{seed}:"), item, F.lit(":"), F.col("id"))), "id"))
    few = pool.withColumn("p", p).filter(F.col("p") <= k).groupBy("item_id", "gold").agg(F.sort_array(F.collect_list(F.struct("p", "id"))).alias("ds")).filter(F.size("ds") == k)
    at = F.floor(tx.unit(seed, F.concat(F.lit("at:"), item)) * (k + 1)).cast("int")
    return few.withColumn("at", at).select("item_id", (F.col("at") + 1).alias("position"), F.array_insert(F.transform("ds", lambda x: x["id"]), F.col("at") + 1, F.col("gold")).alias("prompt"))


def training_rows(rows: DataFrame, longest: int, dev: float, seed: int) -> DataFrame:
    """(id, question_id, n, refusal): rows over the length go; answers with the largest hashes go until refusals make a fifth; a question's rows share a split."""
    kept = rows.filter(F.col("n") <= longest)
    n = kept.agg(F.count("*").alias("all"), F.count_if("refusal").alias("u"))  # one row
    order = W.partitionBy("refusal").orderBy(tx.unit(seed, F.col("id").cast("string")).desc(), F.col("id").desc())
    cut = kept.withColumn("p", F.row_number().over(order)).crossJoin(F.broadcast(n))
    cut = cut.filter(F.col("refusal") | (F.col("p") > F.greatest(F.lit(0), F.col("all") - 5 * F.col("u"))))
    return cut.select("id", "question_id", "refusal", F.when(tx.unit(seed, F.col("question_id")) < dev, "dev").otherwise("train").alias("split"))


def span_sentences(rows: DataFrame, key: str) -> DataFrame:
    """(key, sentences, answer) to key, hit: numbers of the sentences that the answer's first span in the joined context overlaps."""
    at = F.aggregate("sentences", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x) + 1)))
    r = rows.withColumns({"start": F.expr("instr(array_join(sentences, ' '), answer) - 1"), "at": at}).filter("start >= 0")
    spans = F.zip_with("sentences", F.slice("at", F.lit(1), F.size("sentences")), lambda x, a: (a < F.col("start") + F.length("answer")) & (a + F.length(x) > F.col("start")))
    hit = F.filter(F.transform(spans, lambda ok, k: F.when(ok, k + 1)), lambda k: k.isNotNull())
    return r.select(key, hit.alias("hit")).filter(F.size("hit") > 0)
