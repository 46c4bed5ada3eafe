"""Nulls, empty and long texts, repeats, empty tables and clashing columns for every operator."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from corvane.llm import op1_urls, op2_minhash, op3_rules, op4_packing, op5_language, op6_tokens, op7_topk, op8_mix, op9_suffix, op10_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, n int, size string, component string"
LONG = " ".join(f"word{k}" for k in range(30_000))


def rows():
    base = [
        (1, "alpha beta gamma delta epsilon zeta " * 10, "en", "a"), (1, "alpha beta gamma delta epsilon zeta " * 10, "en", "a"), (2, None, None, None), (3, "", "de", "a"),
        (4, " \t\n\r ", "de", "b"), (5, LONG, "en", None), (None, "no id here but words enough to count", "en", "a"), (6, "éä \U0001f600  x", "de", "b"), (7, "12345 !!! ???", None, "b"),
        (8, LONG, "en", "a"), (1, "another text under the same id", "fr", "b"),
    ]
    return [(*r, len(r[1] or ""), 0, 0, "x", "y") for r in base]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_minhash(docs, empty):
    got = op2_minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows()) and op2_minhash.near_duplicates(empty).count() == 0
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[2][0]["n_shingles"] == 0 and by[2][0]["component_id"] == 2 and by[2][0]["kept"]
    assert by[8][0]["component_id"] == 5 and not by[8][0]["kept"] and by[5][0]["kept"]
    assert by[None][0]["component_id"] is None and by[None][0]["kept"]
    assert {r["component_id"] for r in by[1]} == {1}


def test_rules(docs, empty):
    got = op3_rules.judge(op3_rules.ledger(docs))
    assert got.count() == len(rows()) and op3_rules.ledger(empty).count() == 0
    null = got.filter("doc_id = 2").first()
    assert null["n_words"] == 0 and null["base_failed"] and not null["kept"]
    assert got.filter("doc_id = 5").first()["kept"]
    cut = {r["rule"]: r for r in op3_rules.ablations(op3_rules.ledger(docs)).collect()}
    assert cut["too_few_words"]["failed"] == got.filter("n_words < 50").count()
    assert op3_rules.ablations(op3_rules.ledger(empty)).first()["failed"] == 0


def test_packing(docs, empty):
    got = op4_packing.best_fit(docs).toPandas()
    assert op4_packing.best_fit(empty).count() == 0
    assert len(got[got["piece"] == 0]) == len(rows())
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        at = 0
        for o, n in zip(g["offset"], g["length"], strict=True):
            assert o == at
            at += n
        assert at <= 2048
    assert got[got["doc_id"] == 2]["length"].tolist() == [1]


def test_language(docs, empty):
    texts = op5_language.labelled_text(docs)
    got = {r["doc_id"]: r for r in op5_language.predict(docs, texts).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[7]["lang_pred"] == "und" and got[2]["score"] == 0
    assert got[5]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    assert op5_language.labelled_text(empty) == {} and op5_language.predict(empty, {}).count() == 0
    assert {r["lang_pred"] for r in op5_language.predict(docs, {}).collect()} == {"und"}


def test_tokens(spark, docs, empty, tmp_path):
    counted = op6_tokens.counted(docs)
    assert counted.count() == 2 * len(rows()) and op6_tokens.counted(empty).count() == 0
    book = op6_tokens.Rollups(spark, str(tmp_path / "book"))
    assert book.totals().count() == 0
    change = counted.withColumns({"op": F.lit("insert"), "old_tokens": F.lit(None).cast("long")})
    assert book.commit("a", change) and not book.commit("a", change) and book.commit("e", change.limit(0))
    total = book.totals().agg(F.sum("docs"), F.sum("tokens")).first()
    assert tuple(total) == (2 * len(rows()), counted.agg(F.sum("tokens")).first()[0])
    book.compact()
    assert tuple(book.totals().agg(F.sum("docs"), F.sum("tokens")).first()) == tuple(total) and not book.commit("a", change)
    assert book.commit("b", change.withColumn("op", F.lit("delete"))) and book.totals().count() == 0
    with pytest.raises(Exception, match="unknown op"):
        book.commit("c", change.withColumn("op", F.lit("upsert")))


def test_topk(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [0.5]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, []), (None, [1.0, 1.0]), (7, [-1.0, -2.0]), (7, [-1.0, -2.0]), (8, [5e6, 0.0]), (20, [0.0, 1.0])]
    e = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "rank": F.lit("r"), "block": F.lit(0)})
    got = [tuple(r) for r in op7_topk.top_k(e, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    # large components count, and rows that share an id are separate candidates and queries
    assert [r[2] for r in got if r[0] == 0] == [8, 20, 20, 1, 6, 7, 7] and [r[3] for r in got if r[0] == 0] == [64 * 64 * 5_000_000, 64 * 64 * 5, 64 * 64 * 2, 32 * 64, 0, -64 * 64 * 5, -64 * 64 * 5]
    assert len([r for r in got if r[0] == 20]) == 14 and len([r for r in got if r[0] == 20 and r[2] == 20]) == 2
    huge = spark.createDataFrame([(0, [3e9, 1.0]), (20, [3.0, 2e9]), (1, [1.0, 2.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    top = {(r["query_id"], r["vec_id"]): r["score"] for r in op7_topk.top_k(huge, F.col("vec_id") % 20 == 0).collect()}
    scaled = {k: [int(64 * x) for x in v] for k, v in {0: (3e9, 1), 20: (3, 2e9), 1: (1, 2), 2: (-1, 0)}.items()}
    assert top == {(a, b): sum(x * y for x, y in zip(scaled[a], scaled[b], strict=True)) for a in (0, 20) for b in scaled if a != b}
    with pytest.raises(Exception, match="larger than a long"):
        op7_topk.top_k(spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert op7_topk.top_k(e.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_mix(docs, empty):
    got = op8_mix.mix(docs)
    assert got.count() == len(rows()) and op8_mix.mix(empty).count() == 0
    assert got.filter("taken > 3 * size or taken < 0").count() == 0
    assert got.filter("doc_id in (2, 3, 4) and taken <> 0").count() == 0
    total = got.agg(F.sum("size")).first()[0]
    assert abs(got.select("source", "target").distinct().agg(F.sum("target")).first()[0] - total) < 1e-6
    again = op8_mix.mix(docs.repartition(3))
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    assert op8_mix.repeated(docs).columns == docs.columns


def test_suffix(docs, empty):
    got = op9_suffix.remove_repeats(docs).toPandas()
    assert len(got) == len(rows()) and op9_suffix.remove_repeats(empty).count() == 0
    n = len(LONG)
    assert got[got["doc_id"] == 8][["n_bytes", "n_removed", "n_spans"]].values.tolist() == [[n, n, 1]]
    assert got[got["doc_id"] == 8]["kept_sha256"].tolist() == [hashlib.sha256(b"").hexdigest()]
    assert got[got["doc_id"] == 2][["n_bytes", "n_removed", "n_spans"]].values.tolist() == [[0, 0, 0]]
    kept = op9_suffix.without_repeats(docs)
    assert kept.count() == len(rows()) and kept.columns == docs.columns and op9_suffix.without_repeats(empty).count() == 0
    assert kept.filter("doc_id = 3").first()["text"] == ""


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 0, 1), (3, None, 0), (None, 1, 0), (8, 2, 0)], "doc_id long, quality int, toxic int")
    net = op10_quality.fit(*op10_quality.sample(docs, labels))
    assert net is None or net.out.shape == (op10_quality.HIDDEN,)
    assert {r["score"] for r in op10_quality.predict(docs, None).collect()} == {0.5}
    made = op10_quality.fit([b"good words here and there " * 9, b"#### $$$$ " * 30] * 4, __import__("numpy").array([1, 0] * 4))
    got = {r["doc_id"]: r["score"] for r in op10_quality.predict(docs, made).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[2] == got[3]
    assert op10_quality.predict(empty, made).count() == 0 and op10_quality.passing(docs, made).columns == docs.columns
    assert op10_quality.sample(empty, labels)[0] == []


def test_urls(spark):
    day = datetime.date
    cap = spark.createDataFrame([(1, "http://a.b.example.com/x/y", day(2024, 1, 1)), (2, None, day(2024, 1, 1)), (3, "nonsense", day(2024, 1, 1)), (4, "http://a.b.example.com/x/y", None), (5, "https://a.b.example.com/ok/z?q", day(2024, 2, 1)), (5, "https://a.b.example.com/ok/z?q", day(2024, 2, 1))], "id long, url string, fetched date").withColumns({"list": F.lit("?"), "pattern": F.lit("?")})
    ent = spark.createDataFrame([("block", 1, "example.com", day(2023, 1, 1), "add"), ("block", 1, "example.com", day(2024, 1, 15), "remove"), ("block", 2, "a.b.example.com", day(2024, 1, 20), "add"), ("allow", 3, "a.b.example.com/ok", day(2024, 1, 20), "add"), ("allow", None, "x", day(2024, 1, 1), "add"), ("block", 2, "z", day(2024, 1, 1), "toggle"), ("block", 2, "a.b.example.com", day(2020, 1, 1), "add"), ("block", 2, "a.b.example.com", day(2020, 1, 1), "remove")], "list string, level int, pattern string, effective date, action string")
    got = sorted(map(tuple, op1_urls.url_filter(cap, ent).select("id", "list", "pattern", "n_matches", "kept").collect()), key=str)
    assert got == [(1, "block", "example.com", 1, False), (2, None, None, 0, True), (3, None, None, 0, True), (4, None, None, 0, True), (5, "allow", "a.b.example.com/ok", 2, True), (5, "allow", "a.b.example.com/ok", 2, True)]
    assert op1_urls.url_filter(cap.limit(0), ent).count() == 0 and op1_urls.url_filter(cap, ent.limit(0)).filter("not kept").count() == 0
