"""Prompts and targets, metrics of records, replies, names, changed answers, pieces, gates, sections and logs."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import prompts
from corvane.operators import assembly

TEXT = st.text(st.sampled_from("abc .,Ä§1"), min_size=1, max_size=12).map(lambda t: t.replace("\n", " "))


@st.composite
def examples(draw):
    passages = draw(st.lists(st.tuples(TEXT, st.lists(TEXT.filter(lambda t: not t.endswith(" ")), min_size=1, max_size=3).map(tuple)), min_size=1, max_size=3))
    segments, last = [], None
    for _ in range(draw(st.integers(0, 4))):
        k = draw(st.integers(1, len(passages)))
        kind = draw(st.sampled_from(["text", "quote", "cite"] if last != "text" else ["quote", "cite"]))
        last = kind
        segments.append(("text", draw(TEXT)) if kind == "text" else (kind, k, (draw(st.integers(1, len(passages[k - 1][1]))),) if kind == "quote" else ()))
    return {"question": draw(TEXT), "passages": passages, "answer": segments}


@settings(max_examples=150, deadline=None)
@given(examples())
def test_prompt_and_target_round_trip(ex):
    text = "".join(prompts.render(ex))
    assert prompts.parse(text) == ex
    names: dict[str, int] = {}
    special = lambda x: names.setdefault(x, 1000 + len(names))
    got = prompts.encode(ex, special, lambda t: [ord(c) for c in t])
    back = {v: k for k, v in names.items()}
    assert "".join(back.get(t) or chr(t) for t in got["input_ids"]) == text
    n = got["labels"].count(prompts.IGNORED)
    assert got["labels"][n:] == got["input_ids"][n:] and "".join(back.get(t) or chr(t) for t in got["input_ids"][:n]) == prompts.render(ex)[0]


def test_rows_are_refused_with_a_reason():
    ex = {"question": "Was gilt?", "passages": [("BGB §1", ("Eins.", "Zwei."))], "answer": [("quote", 1, (2,))]}
    row = {"id": "1", "source": "s", "kind": "answerable", "text": "".join(prompts.render(ex))}
    assert prompts.row_problem(row) is None
    assert "kind" in prompts.row_problem(row | {"kind": "unanswerable"}) and "no kind" in prompts.row_problem({k: v for k, v in row.items() if k != "kind"})
    assert prompts.row_problem(row | {"text": row["text"].replace("<|s2|>Zwei.", "<|s3|>Zwei.")}) and prompts.row_problem(row | {"text": "x"})
    with pytest.raises(ValueError, match="markup"):
        prompts.render(ex | {"question": "<|x"})
    refusal = ex | {"answer": []}
    assert prompts.parse("".join(prompts.render(refusal))) == refusal


PASSAGES = [{"id": "a:1#1", "sentences": ["Eins zwei.", "Drei vier."], "labels": ["l1", "l2"], "citation_id": "A", "source": "a", "copies": ["b:1"]}, {"id": "c:1#1", "sentences": ["Fünf."], "labels": ["l3"], "citation_id": "C", "source": "c", "copies": []}]


def record(**more):
    return {"raw_answer": "<|q|><|c1|><|s1|>. Und mehr<|cite|><|c2|>.<|endoftext|>", "rendered": "„Eins zwei.“ (l1; Quellen: a, b). Und mehr(C).", "refused": False, "should_refuse": False, "claims": [{"index": 0, "passed": True}, {"index": 1, "passed": False}], "precision": 0.5, "passages": PASSAGES, "gold_ids": ["b:1#4", "c:1#9", "b:1#4"], "gold_answers": ["Eins  zwei..", "zwei"]} | more


def test_metrics_of_a_record():
    got = prompts.record_metrics(record())
    assert got["citation_precision"] == 0.5 and got["citation_recall"] == 0.5 and got["quote_fidelity"] == 1 and got["exact_match"] == 1 and got["char_f1"] == 1
    refused = prompts.record_metrics(record(refused=True, should_refuse=True, precision=None, gold_answers=None))
    assert refused == {"refused": 1.0, "should_refuse": 1.0, "refusal_correct": 1.0, "citation_recall": 0.0}


def test_good_samples():
    verdict = {"refused": False, "claims": [{"passed": True}]}
    assert prompts.good_sample("x<|cite|><|c2|><|endoftext|>", verdict, False, [2]) and not prompts.good_sample("x<|cite|><|c2|>", verdict, False, [2])
    assert not prompts.good_sample("x<|cite|><|c2|><|endoftext|>", verdict, False, [1]) and prompts.good_sample(prompts.REFUSAL_MARKUP, verdict, True, [])
    assert not prompts.good_sample("x<|cite|><|c2|><|endoftext|>", verdict | {"claims": [{"passed": False}]}, False, [2])
    assert prompts.shown(("cite", 9, ()), PASSAGES) == "<|cite|><|c9|>" and prompts.shown(("quote", 2, (1,)), PASSAGES) == "„Fünf.“ (l3)"


def test_replies_names_and_changes():
    assert prompts.first_object('<think>{"a": 1}</think> so: {x} {"b": {"c": 2}} {"d": 3}') == {"b": {"c": 2}} and prompts.first_object("none {") is None
    assert prompts.name_forms("Herr Dr. Max Müller-Lüdenscheid kam, Anna") == ["Herr", "Herr Dr", "Herr Dr. Max", "Dr", "Dr. Max", "Dr. Max Müller-Lüdenscheid", "Max", "Max Müller-Lüdenscheid", "Müller-Lüdenscheid", "Anna"]
    assert prompts.perturbed("Nach § 5 Abs. 2 gelten 10 Tage nicht.") == {"section": "Nach § 6 Abs. 2 gelten 10 Tage nicht.", "number": "Nach § 5 Abs. 2 gelten 11 Tage nicht.", "negation": "Nach § 5 Abs. 2 gelten 10 Tage."}
    assert prompts.perturbed("Keine Frist ist es.")["negation"] == "Eine Frist ist es." and prompts.perturbed("Es ist so.") == {"negation": "Es ist nicht so."}
    assert prompts.parse_limit("all") is None and prompts.parse_limit("3") == 3
    with pytest.raises(ValueError):
        prompts.parse_limit("0")
    report = {"split": "validation", "judge": {"model": "m", "base_url": "u/"}, "prompt_version": "2", "types": {"a": {}}}
    assert prompts.judge_problems(report, "m", "u", "2", ["a"]) == [] and len(prompts.judge_problems(report, "n", "v", "3", ["a", "b"])) == 4


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab. \n"), max_size=80), st.integers(1, 4), st.integers(3, 9))
def test_pieces_are_verbatim_and_bounded(text, words, chars):
    got = prompts.capped_pieces(text, words, chars)
    assert all(text[o : o + len(p)] == p and len(p) <= chars and len(p.split()) <= words and "\n" not in p for o, p in got)
    assert re.sub(r"\s", "", "".join(p for _, p in got)) == re.sub(r"\s", "", text)
    assert [o for o, _ in got] == sorted({o for o, _ in got})


def test_sections_spans_and_hierarchies(spark):
    d = spark.createDataFrame([("abc abc x", ["abc", "", "zz", "bc", "x"], [(0, 2), (4, 7)])], "t string, s array<string>, e array<struct<start:int,end:int>>")
    r = d.select(assembly.located(F.col("t"), F.col("s")).alias("at"), assembly.spans_inside(F.col("e"), F.lit(4), F.lit(9)).alias("in")).first()
    assert r["at"] == [0, -1, -1, 1, 8] and [tuple(x) for x in r["in"]] == [(0, 3)]
    u = spark.createDataFrame([([("010", "A"), ("010010", "B"), ("010020", "C"), ("010020", ""), ("020", "D")],)], "u array<struct<number:string,title:string>>")
    assert u.select(assembly.hierarchies(F.col("u"))).first()[0] == [["A"], ["A", "B"], ["A", "C"], ["A"], ["D"]]


def test_gates_and_lookups(spark):
    rows = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, text string")
    assert [r["id"] for r in assembly.accepted(rows, spark.createDataFrame([("2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881",)], "sha256 string")).collect()] == ["1"]
    hits = spark.createDataFrame([(1, "1", 1), (1, "2", 2)], "qid int, id string, rank int")
    assert assembly.looked_up(hits, rows).count() == 2
    with pytest.raises(Exception, match="no chunk 2"):
        assembly.looked_up(hits, rows.filter("id = '1'")).collect()
    files = spark.createDataFrame([("a", True), ("b", False)], "path string, scrubbed boolean")
    assert assembly.scrubbed_only(files, allowed=True).count() == 2
    with pytest.raises(Exception, match="not scrubbed: b"):
        assembly.scrubbed_only(files).collect()


def test_append_log_goes_on(spark, tmp_path):
    log = assembly.AppendLog(spark, str(tmp_path / "log"), "key string, reply string")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert log.rows().count() == 0 and log.missing(wanted, "key").count() == 3
    one = spark.createDataFrame([("a", "1")], "key string, reply string")
    assert log.append("r1", one) and not log.append("r1", one)
    one.write.parquet(str(tmp_path / "log/aside/r2"))  # a run that broke off
    assert log.append("r2", spark.createDataFrame([("b", "2")], "key string, reply string"))
    assert sorted(r["key"] for r in log.missing(wanted, "key").collect()) == ["c"] and log.batches() == ["r1", "r2"] and log.rows().count() == 2
