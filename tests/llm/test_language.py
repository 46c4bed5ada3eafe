"""Cross parsing against a naive longest-match parser, letters, and whole texts."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import op5_language


def naive(parser, text, labelled):
    """Phrases of a text: the longest symbol strings of the labelled text, or one symbol."""
    fold = lambda b: bytes(parser.symbol[op5_language.fold(np.frombuffer(b, np.uint8))])
    t, source = fold(text), fold(labelled)
    at, count = 0, 0
    while at < len(t):
        n = 1
        while at + n < len(t) and t[at : at + n + 1] in source:
            n += 1
        at, count = at + n, count + 1
    return count


TEXTS = {"xx": b"abcab bcaab acb abba cab" * 3, "yy": b"the cat and the hat and the rat"}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abc tehndrQé\U0001f600½"), max_size=60), max_size=6), st.integers(1, 9))
def test_phrases_are_longest_matches(texts, segment):
    parser = op5_language.Parser(TEXTS)
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    got = parser.phrases(data, offsets, segment)
    assert got.tolist() == [[naive(parser, r, TEXTS[k]) for k in parser.langs] for r in raw]


def test_a_copy_is_one_phrase():
    rng = random.Random(1)
    labelled = "".join(rng.choice("abcdefg ") for _ in range(6000)).encode()
    parser = op5_language.Parser({"aa": labelled, "bb": b"hijk" * 50})
    own = labelled[1000:5000]
    got = parser.phrases(np.frombuffer(own, np.uint8), np.array([0, len(own)], np.int64))
    assert got[0, 0] == 1


@pytest.mark.parametrize(("text", "ok"), [("½ ² ① 12", False), ("", False), ("٣ _ 4", False), ("½ a", True), ("文", True), ("ʰ", True), ("²é", True)])
def test_letters_are_of_category_l(text, ok):
    assert op5_language.lettered(text) == ok


def test_whole_texts_are_learned(spark):
    """Nothing of a sampled document is cut off: its last words are known to the parser."""
    long = " ".join(f"anfang{k}" for k in range(900)) + " schlusswort"
    docs = spark.createDataFrame([(1, long, "de"), (2, "short text here", "en"), (3, None, "en"), (4, "no label", None)], "doc_id long, text string, lang string")
    texts = op5_language.labelled_text(docs)
    assert texts == {"de": long.encode(), "en": b"short text here"}


def test_ties_and_clashes(spark):
    docs = spark.createDataFrame([(1, "same words", "b"), (1, "same words", "a"), (None, "same words", None), (2, "½ 12", "a")], "doc_id long, text string, lang string").selectExpr("*", "'x' as lang_pred", "1.5 as score", "true as held_out")
    got = [(r["lang_pred"], r["score"]) for r in op5_language.predict(docs, {"b": b"same words", "a": b"same words"}).collect()]
    assert got == [("a", 0.0)] * 3 + [("und", 0.0)]
