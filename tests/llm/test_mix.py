"""Pareto order sampling: inclusion frequencies, order, size, repeats."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import op8_mix


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * int(rng.lognormvariate(3, 1.2) + 1)), "abc"[k % 7 % 3]) for k in range(4000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_inclusions_follow_their_odds(corpus):
    """Over seeds, documents of one source and length grade are taken as often as their expected copies say, which differ within a source."""
    seen = {}
    for seed in range(6):
        got = op8_mix.mix(corpus, seed=f"s{seed}").groupBy("source", "expected").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).collect()
        for r in got:
            c, n = seen.get((r["source"], r["expected"]), (0, 0))
            seen[r["source"], r["expected"]] = (c + r["copies"], n + r["n"])
    assert all(len({e for s, e in seen if s == source}) > 3 for source in "abc")
    for (_, expected), (copies, n) in seen.items():
        p = expected % 1
        assert abs(copies / n - expected) <= 4 * (p * (1 - p) / n) ** 0.5 + 12 / n


def test_order_is_by_the_ratio(corpus):
    """The documents with one more copy are those of least (u / (1 - u)) / (p / (1 - p)), not those of least u."""
    from corvane.llm import common

    got = op8_mix.mix(corpus).withColumn("u", common.unit_hash(F.concat(F.lit("mix:"), F.col("doc_id").cast("string")))).toPandas()
    for _, g in got.groupby("source"):
        p = g["expected"] % 1
        g = g[p > 0].assign(q=(g["u"] / (1 - g["u"])) * (1 - p) / p, more=g["copies"] - g["expected"] // 1)
        assert g[g["more"] == 1]["q"].max() < g[g["more"] == 0]["q"].min()
        assert g[g["more"] == 1]["u"].max() > g[g["more"] == 0]["u"].min()


def test_words_are_near_targets(corpus):
    for r in op8_mix.mix(corpus).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect():
        assert abs(r["taken"] - r["target"]) <= r["most"] / 2


def test_rows_without_id_and_repeats(spark):
    rows = [(None, "a b c", "x"), (None, "d e", "x"), (1, "a b", None), (1, "a b c d", None), (2, "", "y"), (3, None, "y"), (4, "z " * 5000, "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"size": F.lit("s"), "q": F.lit(1), "row": F.lit(2), "copies": F.lit(3), "slice": F.lit(4)})
    plan = op8_mix.mix(frame)
    out = op8_mix.repeated(frame)
    assert out.columns == frame.columns
    by = {(r["doc_id"], r["size"]): r["copies"] for r in plan.collect()}
    counts = {(r["doc_id"], r["text"]): r["n"] for r in out.groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect()}
    for d, t, _ in rows:
        assert counts.get((d, t), 0) == by[d, len((t or "").split())]
    assert op8_mix.repeated(frame.limit(0)).count() == 0


def test_a_source_without_words(spark):
    frame = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b c d", "y")], "doc_id long, text string, source string")
    assert sorted((r["doc_id"], r["target"], r["taken"]) for r in op8_mix.mix(frame).collect()) == [(1, 0.0, 0), (2, 0.0, 0), (3, 4.0, 4)]
