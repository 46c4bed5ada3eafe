"""The driver's tables, and the columns that the derived corpus adds to them.

Each derived column is one SQL expression that Spark and DuckDB both read, so
a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DOCUMENT = {
    "ord": "doc_id",
    "id": "concat(source, ':', CAST(doc_id AS STRING))",
    "source": "source",
    "lang": "lang",
    "text": "text",
    "n_chars": "n_chars",
    "jurisdiction": "CASE lang WHEN 'de' THEN 'DE' WHEN 'fr' THEN 'CH' WHEN 'es' THEN 'EU' ELSE 'AT' END",
    "doc_type": "CASE doc_id % 5 WHEN 0 THEN 'statute' WHEN 1 THEN 'regulation' WHEN 2 THEN 'decision' WHEN 3 THEN 'parliament' ELSE 'general' END",
    "licence": "CASE doc_id % 7 WHEN 0 THEN 'DE-UrhG-5' WHEN 1 THEN 'CH-URG-5' WHEN 2 THEN 'CC-BY-4.0' WHEN 3 THEN 'ODbL-1.0' WHEN 4 THEN 'ODC-By-1.0' WHEN 5 THEN 'CC-BY-NC-SA-4.0' ELSE 'CC-BY-NC-4.0' END",
    "commercial_safe": "doc_id % 7 < 5 AND doc_id % 31 <> 0",
    "research_only": "doc_id % 7 >= 5 AND doc_id % 29 <> 0",
    "citation_id": "concat('L', CAST(doc_id % 200 AS STRING), ' §', CAST(doc_id % 50 AS STRING))",
    "valid_from": "DATE '2015-01-01' + CAST(doc_id * 37 % 3650 AS INT)",
    "valid_to": "CASE WHEN doc_id % 3 = 0 THEN DATE '2015-01-01' + CAST(doc_id * 37 % 3650 + doc_id * 11 % 900 AS INT) END",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The derived corpus; only the columns asked for are read."""
    return table(spark, sf_dir, "documents").selectExpr(*(f"{DOCUMENT[c]} AS {c}" for c in columns or DOCUMENT))


def docs_cte(*columns: str, name: str = "docs") -> str:
    """The same rows as a common table expression."""
    return f"{name} AS (SELECT {', '.join(f'{DOCUMENT[c]} AS {c}' for c in columns or DOCUMENT)} FROM documents)"


#: Lower-cased words, as DuckDB reads them; Spark's are functions.text.words.
DUCK_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"


def duck_words(column: str) -> str:
    return DUCK_WORDS.format(column)
