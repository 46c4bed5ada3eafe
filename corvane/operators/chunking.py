"""Documents to retrievable chunks.

Windows depend on a running size within one document, so each document is cut
in one Arrow batch row; documents are independent and the step has no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import sentences as s
from corvane.functions.citations import act_of

CHUNK = "id string, doc_id string, citation_id string, hierarchy array<string>, sentences array<string>, labels array<string>, part string, anchor string"


def _statute(doc_id: str, citation: str, act: str, heading: str, paragraphs: list[str]) -> Iterator[dict]:
    labelled = []
    for k, p in enumerate(paragraphs, start=1):
        base = f"{citation} Abs. {k}" if len(paragraphs) > 1 else citation
        labelled += [(f"{base} {grain}".strip(), text) for grain, text in s.statute_units(p)]
    for n, at in enumerate(range(0, len(labelled), s.MAX_UNITS), start=1):
        own = labelled[at : at + s.MAX_UNITS]
        yield {"id": f"{doc_id}#{n}", "citation_id": citation, "hierarchy": [act, heading], "sentences": [t for _, t in own], "labels": [x for x, _ in own], "part": None, "anchor": ""}


def _decision(doc_id: str, citation: str, paragraphs: list[str], parts: list[str], labels: list[str]) -> Iterator[dict]:
    n, at = 0, 0
    while at < len(paragraphs):
        end = next((k for k in range(at, len(paragraphs)) if parts[k] != parts[at]), len(paragraphs))
        for window in s.windows(paragraphs[at:end]):
            n += 1
            own = [labels[at + k] for k in dict.fromkeys(k for k, _ in window)]
            where = s.anchor(own)
            cite = lambda x: f"{citation} {x}" if s.NUMBERED.match(x) else f"{citation}, {x}"
            yield {"id": f"{doc_id}#{n}", "citation_id": f"{citation} {where}" if where else f"{citation}, {parts[at]}", "hierarchy": [citation, parts[at]], "sentences": [u for _, u in window], "labels": [cite(labels[at + k]) for k, _ in window], "part": parts[at], "anchor": where}
        at = end


def chunks(docs: DataFrame) -> DataFrame:
    """(id, doc_type, citation_id, heading, paragraphs, parts, labels) to chunks: statutes and regulations by unit, decisions by window, other types none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                ps = list(r.paragraphs)
                made = _decision(r.id, r.citation_id, ps, list(r.parts), list(r.labels)) if r.doc_type == "decision" else _statute(r.id, r.citation_id, r.act, r.heading, ps)
                out += [{"doc_id": r.id} | c for c in made]
            yield pd.DataFrame(out, columns=["id", "doc_id", "citation_id", "hierarchy", "sentences", "labels", "part", "anchor"])

    rows = docs.filter(F.col("doc_type").isin("statute", "regulation", "decision")).withColumn("act", act_of(F.col("citation_id")))
    return rows.select("id", "doc_type", "citation_id", "heading", "paragraphs", "parts", "labels", "act").mapInPandas(run, CHUNK)


def chunk_text(citation: Column, hierarchy: Column, sentences: Column) -> Column:
    """What the indexes read: the header, the hierarchy, the sentences."""
    return F.concat_ws("\n", citation, F.array_join(hierarchy, " › "), F.array_join(sentences, "\n"))


def sentence_units(docs: DataFrame) -> DataFrame:
    """id, pos, sentence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "sentences": [s.sentences(t or "") for t in b["text"]]})

    return docs.select("id", "text").mapInPandas(run, "id string, sentences array<string>").select("id", F.posexplode("sentences").alias("pos", "sentence"))


def greedy_windows(rows: DataFrame, most: int) -> DataFrame:
    """(id, sizes) to id, windows: for each unit the number of its window, units laid greedily up to `most`; folded natively."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(1).alias("w"), F.array().cast("array<int>").alias("at"))

    def step(acc, n):
        fits = (acc["used"] == 0) | (acc["used"] + n <= most)
        w = F.when(fits, acc["w"]).otherwise(acc["w"] + 1)
        return F.struct(F.when(fits, acc["used"] + n).otherwise(n).cast("long").alias("used"), w.alias("w"), F.concat(acc["at"], F.array(w)).alias("at"))

    return rows.select("id", F.aggregate("sizes", start, step)["at"].alias("windows"))
