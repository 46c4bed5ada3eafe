"""The pipeline's stages on nulls, empty and long texts, ties, repeats, empty tables and clashing columns; plain versions of three stages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import common, op4_packing, op8_mix, op10_quality

LONG = " ".join(f"word{k}" for k in range(20_000))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with every edge case, clashing columns, and labels of both classes."""
    good = [f"plain sentence number {k} about rivers and hills and the people there, told at some length {k * 7}. " * 3 for k in range(40)]
    rows = [(k, t, "en", "ab"[k % 2]) for k, t in enumerate(good)] + [(k, "#### $$$$ 0x0 " * 30 + str(k), "en", "b") for k in range(40, 60)]
    rows += [(100, None, None, None), (101, "", "de", "a"), (102, " \t\n", "de", "a"), (103, LONG, "en", None), (104, LONG, "en", "a"), (None, "a text without an id " * 9, "en", "a"), (0, good[0], "en", "a"), (0, good[0], "en", "a")]
    out = tmp_path_factory.mktemp("edges")
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({c: F.lit(0) for c in ("row", "size", "copies", "piece", "length", "shard", "w", "g_id", "score")}).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(k, int(k < 40), 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def staged(df):
    return common.staged(df, "test")


def test_stages_on_edge_cases(spark, folder):
    docs = staged(common.table(spark, folder, "documents"))
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, staged(stage(spark, docs, folder))
        ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
        assert ids(docs) <= ids(before)
        if name != "packing":
            assert docs.columns == before.columns
        if name == "near-duplicates":
            assert {None, 100, 101, 102} & ids(before) <= ids(docs) and not {103, 104} <= ids(docs)
        if name == "repeated passages":
            assert docs.count() == before.count()
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").isEmpty()


def test_empty_tables(spark, folder):
    docs = staged(common.table(spark, folder, "documents").limit(0))
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, folder))
        assert docs.isEmpty()


def test_quality_stage_is_its_score(spark, folder):
    docs = common.table(spark, folder, "documents").filter("doc_id is not null and doc_id <> 0")
    net = op10_quality.trained(docs, common.table(spark, folder, "labels"))
    want = set()
    for r in docs.collect():
        raw = np.frombuffer((r["text"] or "").encode(), np.uint8)
        if op10_quality.score(net, raw, np.array([0, len(raw)], np.int64))[0] >= 0.5:
            want.add(r["doc_id"])
    got = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, folder).collect()}
    assert got == want and set(range(1, 40)) <= got and not got & set(range(40, 60))


def test_mixing_stage_is_its_plan(spark, folder):
    docs = common.table(spark, folder, "documents").filter("doc_id <> 0")
    plan = {r["doc_id"]: r["copies"] for r in op8_mix.mix(docs).collect()}
    got = {r["doc_id"]: r["n"] for r in corpus_pipeline.mixing(spark, docs, folder).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {k: n for k, n in plan.items() if n}


def test_packing_stage_holds_every_id_once(spark, folder):
    docs = common.table(spark, folder, "documents").filter("doc_id <> 0")
    enc = op4_packing.encoder(op4_packing.vocabulary_path())
    want = {r["doc_id"]: len(enc.encode(r["text"] or "", allowed_special="all")) + 1 for r in docs.collect()}
    got = corpus_pipeline.packing(spark, docs, folder).toPandas()
    assert got.groupby("doc_id")["length"].sum().to_dict() == want
    for _, g in got.sort_values("piece").groupby("doc_id"):
        assert g["start"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]]
