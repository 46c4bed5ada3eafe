"""Printed papers to labelled sections."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corvane.sources import html


def paper_sections(papers: DataFrame, key: str, column: str) -> DataFrame:
    """key, pos, label, text: paragraphs with the heading above, `Kopf` before the first."""
    parse = lambda text: html.labelled(html.paragraphs(text))
    return html.exploded(papers, key, column, parse, "struct<label:string,text:string>").select(key, "pos", "item.label", "item.text")
