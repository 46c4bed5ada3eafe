"""Entity scrubbing, placeholder numbering and leak checks."""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Entity labels that are scrubbed, and letters a form needs to be replaced beyond its tags.
LABELS, MIN_LETTERS = ("PER", "RR", "AN", "STR"), 3
_LEADING, _TRAILING = "(„\"'»", ",;:)“\"'«"


def pattern_tagger(text: str) -> list[tuple[int, int, str]]:
    """Stand-in for a model: pairs of capitalised words are persons, street-like words with a number streets."""
    found = [(m.start(), m.end(), "PER") for m in re.finditer(r"\b[A-Z][a-zäöü]+ [A-Z][a-zäöü]+\b", text)]
    return found + [(m.start(), m.end(), "STR") for m in re.finditer(r"\b\w+(?:straße|street|rue) \d+\b", text)]


def trimmed(start: int, end: int, text: str) -> tuple[int, int]:
    """The span without quotes and brackets around it; a final period goes with a name, stays with an initial."""
    while start < end and text[start] in _LEADING:
        start += 1
    while end > start and (text[end - 1] in _TRAILING or (text[end - 1] == "." and sum(c.isalpha() for c in text[start : end - 1]) >= MIN_LETTERS)):
        end -= 1
    return start, end


def scrubbed(text: str, tags: list[tuple[int, int, str]], key: bytes) -> tuple[str, list[dict]]:
    """Tagged spans replaced from the right, then whole-word repeats of the forms, longest first; and a log line for each span."""
    spans = sorted({(*trimmed(a, b, text), label) for a, b, label in tags if label in LABELS})
    spans = [(a, b, label) for a, b, label in spans if text[a:b].strip()]
    names: dict[str, str] = {}
    for a, b, label in spans:
        names.setdefault(text[a:b], f"[{label}_{sum(v.startswith(f'[{label}_') for v in names.values()) + 1}]")
    log = [{"placeholder": names[text[a:b]], "entity_hmac": hmac.new(key, text[a:b].encode(), hashlib.sha256).hexdigest(), "start": a, "end": b} for a, b, _ in spans]
    out, edge = text, len(text) + 1
    for a, b, _ in reversed(spans):
        if b <= edge:
            out, edge = out[:a] + names[text[a:b]] + out[b:], a
    for form in sorted(names, key=len, reverse=True):
        if sum(c.isalpha() for c in form) >= MIN_LETTERS:
            out = re.sub(rf"(?<!\w){re.escape(form)}(?!\w)", lambda _, n=names[form]: n, out)
    return out, log


def scrub(docs: DataFrame, key: bytes, tagger: Callable[[str], list] = pattern_tagger) -> DataFrame:
    """(id, text) to id, text, log. The tagger is the model's place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [scrubbed(t or "", tagger(t or ""), key) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "text": [t for t, _ in made], "log": [x for _, x in made]})

    return docs.select("id", "text").mapInPandas(run, "id string, text string, log array<struct<placeholder:string,entity_hmac:string,start:int,end:int>>")


def numbered_placeholders(mentions: DataFrame, label: str) -> DataFrame:
    """(doc_id, k, form) to doc_id, form, placeholder, numbered by first appearance."""
    first = mentions.groupBy("doc_id", "form").agg(F.min("k").alias("first"))
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("first"))
    return first.select("doc_id", "form", F.concat(F.lit(f"[{label}_"), n.cast("string"), F.lit("]")).alias("placeholder"))


def leaks(forms: DataFrame, logged: DataFrame) -> DataFrame:
    """Hashed forms that the log holds, once each."""
    return forms.join(logged.distinct(), "h", "left_semi").distinct()
