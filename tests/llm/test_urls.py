"""Hosts, ties, long paths and clashing columns."""

import datetime
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import op1_urls, op3_rules

DAY = datetime.date(2024, 1, 1)


def judged(spark, urls, entries, **more):
    cap = spark.createDataFrame([(k, u, DAY) for k, u in enumerate(urls)], "id long, url string, fetched date").withColumns({k: F.lit(v) for k, v in more.items()})
    ent = spark.createDataFrame([(*e, datetime.date(2023, 1, 1), "add") for e in entries], "list string, level int, pattern string, effective date, action string")
    return {r["id"]: r for r in op1_urls.url_filter(cap, ent).collect()}


@pytest.mark.parametrize(
    ("url", "host"),
    [
        ("http://user:pw@evil.com/x", "evil.com"), ("http://u@x@evil.com", "evil.com"), ("https://EVIL.com.:8443/a?b@c", "evil.com"), ("http://evil.com:80", "evil.com"), ("http://[::1]:80/x", "[::1]"),
        ("http://u:p@[2001:db8::A]/", "[2001:db8::a]"), ("ftp://a.b..", "a.b"), ("http:///x", ""), ("nonsense", ""), ("http://?q", ""), ("http://a.b/x@y:z", "a.b"),
    ],
)
def test_hosts(spark, url, host):
    got = judged(spark, [url], [("block", 2, "evil.com")])[0]
    assert got["host"] == host and got["kept"] == (host != "evil.com")


def test_ties_long_paths_and_clashes(spark):
    entries = [("block", 2, "a.com"), ("allow", 2, "a.com"), ("block", 3, "b.com/x"), ("allow", 1, "b.com"), ("block", 1, "com.z"), (None, 1, "q.com"), ("block", 2, None)]
    urls = ["http://a.com/", "http://b.com/" + "x/" * 20_000, "http://b.com/xy", ".".join(["http://a"] + ["a"] * 3000) + ".com.z/p", "http://q.com"]
    got = judged(spark, urls, entries, keys="k", path="p", level=7, pattern="x", list="y", n=1)
    assert [(got[k]["list"], got[k]["pattern"], got[k]["n_matches"], got[k]["kept"]) for k in range(5)] == [("allow", "a.com", 2, True), ("block", "b.com/x", 2, False), ("allow", "b.com", 1, True), ("block", "com.z", 1, False), (None, None, 0, True)]


def test_letters_are_of_category_l():
    text = "aZ-—…½²①é文ʰ\U0001f600\U00010400ªß٣ñ"
    data = np.frombuffer(text.encode(), np.uint8)
    want = []
    for c in text:
        want += [unicodedata.category(c)[0] == "L"] + [False] * (len(c.encode()) - 1)
    assert op3_rules.letters(data).tolist() == want


def test_words_without_letters_fail(spark):
    docs = spark.createDataFrame([(1, "— … \U0001f600 ½ " * 40), (2, "wörter aus buchstaben " * 30)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_alpha_words"] for r in op3_rules.ledger(docs).collect()}
    assert got == {1: 0, 2: 90}


def test_ablations_of_every_policy(spark):
    docs = spark.createDataFrame([(1, "short"), (2, " ".join(f"word{k}" for k in range(80))), (3, " ".join(f"#{k}" for k in range(80)))], "doc_id long, text string")
    book = op3_rules.ledger(docs)
    for policy in op3_rules.POLICIES:
        kept = op3_rules.judge(book, policy).filter("kept").count()
        for r in op3_rules.ablations(book, policy).collect():
            rest = op3_rules.mask(policy) & ~(1 << list(op3_rules.RULES).index(r["rule"]))
            assert r["only_rule"] == book.filter(F.col("failures").bitwiseAND(F.lit(rest)) == 0).count() - kept
