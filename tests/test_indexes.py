"""Stemming, stop words, stored lexical and dense indexes."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from corvane.functions import german
from corvane.operators import lexical, vectors

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("word", "stem"),
    [
        ("kündigungen", "kundig"), ("kündigen", "kundig"), ("mietverhältnisses", "mietverhaltnis"), ("aufeinander", "aufeinand"), ("aufeinanderfolge", "aufeinanderfolg"),
        ("aufeinanderschlügen", "aufeinanderschlug"), ("auferlegten", "auferlegt"), ("kategorien", "kategori"), ("kategorische", "kategor"), ("straße", "strass"), ("häuser", "haus"),
        ("freundlichkeit", "freundlich"), ("1", "1"), ("bauen", "bau"), ("ab", "ab"),
    ],
)
def test_stems(word, stem):
    assert german.stem(word) == stem


def brute_bm25(texts, query, analyze, k1=1.5, b=0.75):
    docs = {k: analyze(t) for k, t in texts.items()}
    mean = sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    out = {}
    for k, d in docs.items():
        tf = Counter(d)
        s = sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] / (tf[w] + k1 * (1 - b + b * len(d) / mean)) for w in analyze(query) if tf[w])
        if s > 0:
            out[k] = round(s, 9)
    return out


def test_german_index_is_brute_force(spark):
    texts = {"a": "Die Kündigungen der Wohnung sind wirksam", "b": "Wer kündigt, muss die Kündigung schreiben", "c": "der die das und", "d": "§ 1 BeurkG Art. 6 lit. f", "e": "", "f": "Wohnungen und Häuser, Haus um Haus"}
    corpus = spark.createDataFrame([(k, i, t) for i, (k, t) in enumerate(texts.items())], "id string, ord int, text string")
    stop = set(german.stopwords(spark))
    analyze = lambda t: [german.stem(w) for w in re.findall(r"\w+", t.lower()) if w not in stop]
    index = lexical.Index.build(corpus, analyzer="german")
    for query in ("Kündigung einer Wohnung", "das Haus das Haus", "§ 1", "und der", "Art. 6"):
        got = {r["id"]: r["score"] for r in index.scores(spark.createDataFrame([(1, query)], "qid int, text string")).collect()}
        assert got == pytest.approx(brute_bm25(texts, query, analyze)), query


def test_stored_lexical_index(spark, tmp_path):
    corpus = spark.createDataFrame([("a", 0, "eins zwei"), ("b", 1, "zwei drei")], "id string, ord int, text string")
    asked = spark.createDataFrame([(1, "zwei drei vier")], "qid int, text string")
    want = sorted(map(tuple, lexical.bm25(asked, corpus).collect()))
    lexical.Index.build(corpus, f"{tmp_path}/i")
    assert sorted(map(tuple, lexical.bm25(asked, lexical.Index.load(spark, f"{tmp_path}/i", analyzer="words", k1=1.5)).collect())) == want
    with pytest.raises(ValueError, match="other settings"):
        lexical.Index.load(spark, f"{tmp_path}/i", analyzer="german")
    with pytest.raises(ValueError, match="no texts"):
        lexical.Index.build(corpus.limit(0))
    with pytest.raises(ValueError, match="unique"):
        lexical.Index.build(corpus.unionByName(corpus))


def test_dense_build_goes_on_where_it_stopped(spark, tmp_path):
    corpus = spark.createDataFrame([(k, f"wort{k} text nummer {k % 3}") for k in range(40)], "id long, text string")
    path, calls = f"{tmp_path}/d", []

    def broken(texts):
        raise RuntimeError("no more quota")

    vectors.encoded(corpus.filter("pmod(xxhash64(id), 4) = 0"), "id", vectors.hashed_words).write.parquet(f"{path}/batch=0")
    with pytest.raises(Exception, match="no more quota"):
        vectors.DenseIndex.build(corpus, broken, path, batches=4)
    with pytest.raises(Exception):
        vectors.DenseIndex.load(spark, path)
    calls = vectors.DenseIndex.build(corpus, vectors.hashed_words, path, batches=4, settings={"encoder": "h"})
    assert calls == [1, 2, 3] and vectors.DenseIndex.build(corpus, vectors.hashed_words, path, batches=4) == []
    with pytest.raises(ValueError, match="other settings"):
        vectors.DenseIndex.load(spark, path, encoder="x")
    index = vectors.DenseIndex.load(spark, path, encoder="h")
    texts = [r["text"] for r in corpus.orderBy("id").collect()]
    m = vectors.hashed_words(texts)
    score = np.round(m @ m[7], 6)
    want = [int(k) for k in np.lexsort((np.arange(40), -score))[:5]]
    got = index.top_k(corpus.filter("id = 7").selectExpr("id AS qid", "text"), vectors.hashed_words, 5).orderBy("rank").collect()
    assert [r["id"] for r in got] == want
