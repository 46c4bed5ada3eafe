"""Language identification by cross-parsing entropy.

A suffix automaton per language, built from labelled text, parses a document
into longest matches: a phrase is the longest string of the labelled text that
the document goes on with, or one symbol where there is none. Few long phrases
mean that the document resembles the language: with c phrases of n bytes and m
bytes of labelled text the cross entropy is c * log2(m) / n, and the language
with the least wins. Whole texts are parsed, each as one chain. The chains run
in segments side by side: each first from the automaton's root, then again
from the state that the segment before ends in, as far as the two differ.

The labelled text is a bounded sample of rows: per language at most
SAMPLE_DOCS documents in the order of a hash of their id, whole texts, until
they hold TRAIN_BYTES; the one that reaches it is the last and is not cut.
Everything else covers all documents.

Defined results. A null text, or one without a letter (Unicode category L), is
`und` with score 0. Without any labelled text every document is `und`. Rows
that repeat a doc_id are scored separately. An empty table gives an empty
result. Other columns are ignored. Ties go to the language that sorts first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import common

SAMPLE_DOCS, TRAIN_BYTES, SEGMENT = 64, 64_000, 512
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]+")
_OTHER, _SPACE, _FIRST = 0, 1, 2


def lettered(text: str) -> bool:
    """Whether a character is of Unicode category L; the pattern's matches may be other numbers too."""
    return any(c.isalpha() for m in _LETTER.finditer(text) for c in m.group())


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 capitals made small."""
    b = common.LOWER[data]
    after = np.zeros(len(b), bool)
    after[1:] = b[:-1] == 0xC3
    return np.where(after & (b >= 0x80) & (b <= 0x9E) & (b != 0x97), b + 0x20, b).astype(np.uint8)


def alphabet(texts: dict[str, bytes]) -> np.ndarray:
    """Symbols by byte: white space, letters, the non-ASCII bytes of the labelled text; all others are one symbol."""
    out = np.full(256, _OTHER, np.uint8)
    out[common.IS_SPACE] = _SPACE
    seen = sorted({b for t in texts.values() for b in t if b >= 0x80})
    for k, b in enumerate([*range(ord("a"), ord("z") + 1), *seen]):
        out[b] = _FIRST + k
    return out


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the root."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def parser_table(nxt: list[dict[int, int]], size: int) -> np.ndarray:
    """For state * size + symbol: twice the next state * size, plus 1 where the symbol begins a phrase. Nothing is matched at the root, so every symbol begins one there."""
    root = np.zeros(size, np.int64)
    for c, s in nxt[0].items():
        root[c] = s
    t = np.tile((root * size * 2 + 1).astype(np.int32), (len(nxt), 1))
    for s, out in enumerate(nxt[1:], start=1):
        for c, to in out.items():
            t[s, c] = to * size * 2
    return t.ravel()


class Parser:
    """The automata of all languages."""

    def __init__(self, texts: dict[str, bytes]):
        folded = {k: fold(np.frombuffer(v, np.uint8)).tobytes() for k, v in sorted(texts.items()) if v}
        self.langs = list(folded)
        self.symbol = alphabet(folded)
        size = int(self.symbol.max()) + 1
        self.tables = [parser_table(automaton(self.symbol[np.frombuffer(v, np.uint8)].tolist()), size) for v in folded.values()]
        self.weight = np.array([np.log2(len(v) + 1) for v in folded.values()])

    def phrases(self, data: np.ndarray, offsets: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
        """Phrases of each document (row) in each language (column)."""
        n = np.diff(offsets)
        lanes = -(-n // segment)
        doc = np.repeat(np.arange(len(n)), lanes)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = offsets[:-1][doc] + nth * segment
        width = np.minimum(segment, offsets[1:][doc] - start)
        order = np.argsort(-width, kind="stable")
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        start, width, doc = start[order], width[order], doc[order]
        # the segment that a segment goes on from, itself where a document begins
        before = np.where(nth[order] > 0, where[np.maximum(order - 1, 0)], np.arange(len(order)))
        symbols = self.symbol[fold(data)]
        out = np.zeros((len(n), len(self.langs)))
        steps = int(width[0]) if len(width) else 0
        live = [int(np.searchsorted(-width, -k, "left")) for k in range(steps)]
        grid = [symbols[start[:w] + k].astype(np.int32) for k, w in enumerate(live)]
        for j, t in enumerate(self.tables):
            trace = [np.empty(0, np.int32)] * steps
            state = np.zeros(len(doc), np.int32)
            for k, (w, c) in enumerate(zip(live, grid, strict=True)):
                trace[k] = t[state[:w] + c]
                state[:w] = trace[k] >> 1
            used = np.zeros(len(doc), np.int32)
            while True:
                entry = np.where(before != np.arange(len(doc)), state[before], 0)
                todo = np.flatnonzero(entry != used)
                if not len(todo):
                    break
                used[todo] = entry[todo]
                now = entry[todo]
                for k in range(steps):
                    todo, now = todo[: (m := int(np.searchsorted(todo, live[k])))], now[:m]
                    v = t[now + grid[k][todo]]
                    apart = (v >> 1) != (trace[k][todo] >> 1)
                    trace[k][todo] = v
                    last = width[todo] == k + 1
                    state[todo[last]] = v[last] >> 1
                    todo, now = todo[apart], v[apart] >> 1
                    if not len(todo):
                        break
            begun = np.zeros(len(doc), np.int32)
            for w, v in zip(live, trace, strict=True):
                begun[:w] += v & 1
            out[:, j] = np.bincount(doc, weights=begun, minlength=len(n))
        return out


_parsers: dict[int, Parser] = {}


def _predicted(texts: dict[str, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(sorted(texts.items())))
        if key not in _parsers:
            _parsers[key] = Parser(texts)
        parser = _parsers[key]
        for batch in batches:
            for i, j, data, offsets in common.chunks(batch.column(1)):
                names, scores = [UNKNOWN] * (j - i), np.zeros(j - i)
                if parser.langs:
                    h = parser.phrases(data, offsets) * parser.weight
                    best = h.argmin(axis=1)
                    h.sort(axis=1)
                    scores = 1 - h[:, 0] / np.maximum(h[:, 1], 1e-9) if h.shape[1] > 1 else np.ones(j - i)
                    raw = data.tobytes()
                    some = [lettered(raw[a:b].decode("utf-8", "replace")) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                    names = [parser.langs[k] if ok else UNKNOWN for k, ok in zip(best, some, strict=True)]
                    scores = np.where(some, np.clip(scores, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return run


def labelled_text(docs: DataFrame) -> dict[str, bytes]:
    """The bounded sample: bytes of text by language."""
    rows = docs.select("doc_id", "lang", "text").filter("lang is not null and text is not null and doc_id is not null")
    rows = rows.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), F.lit("lang")))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return {}
    # about SAMPLE_DOCS rows a language pass a hash threshold; the few that pass are cut to the number exactly
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2.0 * SAMPLE_DOCS / n))])
    unit = (F.col("h").cast("double") / F.lit(2.0**64)) + 0.5
    some = rows.filter(unit < share[F.col("lang")]).select("lang", "h", "text")
    got: dict[str, list] = {}
    for r in some.collect():
        got.setdefault(r["lang"], []).append((r["h"], r["text"]))
    out = {}
    for lang, found in got.items():
        texts, size = [], 0
        for t in dict.fromkeys(t.encode() for _, t in sorted(found)):
            if len(texts) < SAMPLE_DOCS and size < TRAIN_BYTES:
                texts.append(t)
                size += len(t)
        out[lang] = b"\n".join(texts)
    return out


def predict(docs: DataFrame, texts: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, from the text alone."""
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_predicted(texts), f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = common.held_out(F.col("doc_id"), 4, 2)
    texts = labelled_text(docs.filter(~out))
    return predict(docs, texts).select("doc_id", out.alias("held_out"), "lang_pred", "score")


QUERIES, ORACLES = {"op5_language": op5_language}, {}
