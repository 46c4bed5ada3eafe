"""Counts against the tokenizers library, and commits of several writers."""

import base64
import functools

import pytest
from pyspark.sql import functions as F

from corvane.llm import common, op6_tokens

SF = "/root/testdata/sf0.001"


def plain_counter(version):
    """Tokens by merging the pair of least rank in each piece, one at a time."""
    import public_tokenizers
    import regex

    with open(public_tokenizers.path(f"{version}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}

    @functools.cache
    def merged(piece):
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            rank, k = min((ranks.get(parts[i] + parts[i + 1], len(ranks)), i) for i in range(len(parts) - 1))
            if rank == len(ranks):
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return len(parts)

    return lambda text: sum(merged(m.encode()) for m in regex.findall(public_tokenizers.PATTERN, text))


def library_counter(version):
    import public_tokenizers
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(public_tokenizers.path(f"{version}.json"))
    theirs.encode_special_tokens = True
    return lambda text: len(theirs.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize(("version", "counter"), [("byte_bpe_50k", library_counter), ("byte_bpe_50k", plain_counter), ("byte_bpe_multi_50k", plain_counter)])
def test_counts_are_those_of_other_tokenizers(spark, version, counter):
    count = counter(version)
    long = [(900, "wörter und words " * 20_000, "de", "a"), (901, None, None, None), (902, "", "en", "a"), (903, "a" * 300, "en", "b"), (904, "x<|endoftext|>y", "en", "b")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(long, "doc_id long, text string, lang string, source string"))
    want = {r["doc_id"]: count(r["text"] or "") for r in docs.collect()}
    assert {r["doc_id"]: r["tokens"] for r in op6_tokens.counted(docs, (version,)).collect()} == want


def test_query_totals_are_recounted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = op6_tokens.counted(docs).withColumns({"r": common.held_out(F.col("doc_id"), 7, 1), "d": common.held_out(F.col("doc_id"), 11, 0)}).collect()
    want = {}
    for x in rows:
        if not x["d"]:
            n, t = want.get((x["source"], x["lang"], x["tokenizer"]), (0, 0))
            want[x["source"], x["lang"], x["tokenizer"]] = (n + 1, t + x["tokens"] + x["r"])
    assert {tuple(r)[:3]: tuple(r)[3:] for r in op6_tokens.op6_tokens(spark, SF).collect()} == want


def change(spark, op, tokens, old=None):
    return spark.createDataFrame([(op, "s", "l", "t", tokens, old)], "op string, source string, lang string, tokenizer string, tokens long, old_tokens long")


def test_two_writers_of_one_batch_count_once(spark, tmp_path):
    """Both pass the first look; the second to publish finds the batch there."""
    one, two = (op6_tokens.Rollups(spark, str(tmp_path)) for _ in range(2))
    late = two._written
    two._written = lambda rows: (one.commit("b", change(spark, "insert", 5)), late(rows))[1]
    assert not two.commit("b", change(spark, "insert", 5))
    assert tuple(one.totals().first())[3:] == (1, 5)


def test_a_version_is_published_once(spark, tmp_path):
    book = op6_tokens.Rollups(spark, str(tmp_path))
    state = {"version": 1, "batches": ["x"], "folders": []}
    assert book._publish(state) and not book._publish({**state, "batches": ["y"]}) and book.committed() == ["x"]


def test_compactions_do_not_both_count(spark, tmp_path):
    one, two = (op6_tokens.Rollups(spark, str(tmp_path)) for _ in range(2))
    one.commit("a", change(spark, "insert", 5)), one.commit("b", change(spark, "revise", 7, 5))
    late = two._written
    two._written = lambda rows: (late(rows), one.compact(), one.commit("c", change(spark, "insert", 1)))[0]
    assert not two.compact()
    assert tuple(two.totals().first())[3:] == (2, 8) and one.committed() == ["a", "b", "c"]
    assert not one.commit("a", change(spark, "insert", 5))


def test_a_commit_beside_a_compaction_stays(spark, tmp_path):
    one, two = (op6_tokens.Rollups(spark, str(tmp_path)) for _ in range(2))
    one.commit("a", change(spark, "insert", 5)), one.commit("b", change(spark, "insert", 7))
    late = two._written
    two._written = lambda rows: (late(rows), one.commit("c", change(spark, "delete", 5)))[0]
    assert two.compact() and tuple(one.totals().first())[3:] == (1, 7)
