"""Queries over deduplication, copy groups and contamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import dedup, graph, records
from corvane.plans._tables import docs_cte, documents, duck_words, table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


_DOCS = ("ord", "id", "source", "text", "commercial_safe", "research_only")


@query(f"""WITH {docs_cte(*_DOCS)}, o AS (SELECT id, source, sha256(text) AS sha, row_number() OVER (ORDER BY NOT commercial_safe, research_only, source, id) AS o FROM docs),
f AS (SELECT *, arg_min(id, o) OVER (PARTITION BY sha, source) AS first_id, arg_min(id, o) OVER (PARTITION BY sha) AS all_id FROM o)
SELECT * FROM (SELECT id, CASE WHEN id <> first_id THEN first_id WHEN id <> all_id THEN all_id END AS duplicate_of, id <> first_id AS dropped FROM f) WHERE duplicate_of IS NOT NULL""")
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.exact_duplicates(documents(spark, sf, *_DOCS))


_SHINGLES = f"""{docs_cte("id", "text")}, w AS (SELECT id, {duck_words("text")} AS w FROM docs),
s AS (SELECT id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w),
c AS (SELECT id, s, min(id) OVER (PARTITION BY md5(array_to_string(s, chr(31)))) AS rep FROM s WHERE len(s) > 0),
g AS (SELECT id, len(s) AS n, unnest(s) AS g FROM c WHERE id = rep),
p AS (SELECT a.id AS a, b.id AS b, count(*) / (a.n + b.n - count(*))::DOUBLE AS jaccard FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n)"""


@query(f"WITH {_SHINGLES} SELECT a, b, jaccard FROM p WHERE jaccard >= 0.8 UNION ALL SELECT rep, id, 1.0 FROM c WHERE id <> rep")
def near_dup_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Similar sets' representatives, and copies with their representative."""
    return dedup.near_pairs(documents(spark, sf, "id", "text"))


@query()
def dedup_survivors(spark: SparkSession, sf: str) -> DataFrame:
    """Dropped and linked documents in visiting order."""
    return dedup.survivors(documents(spark, sf, *_DOCS))


@query(f"""WITH RECURSIVE {_SHINGLES}, e AS (SELECT a, b FROM p WHERE jaccard >= 0.8 UNION SELECT rep, id FROM c WHERE id <> rep), sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk AS (SELECT DISTINCT a AS node, a AS seen FROM sym UNION SELECT walk.node, sym.b FROM walk JOIN sym ON walk.seen = sym.a)
SELECT node AS id, min(seen) AS component, count(*) AS members FROM walk GROUP BY node""")
def copy_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Groups over similar pairs: each member with its group's least id and size."""
    pairs = dedup.near_pairs(documents(spark, sf, "id", "text"))
    return graph.copy_groups(pairs.select(F.col("a").alias("duplicate_of"), F.col("b").alias("id"), F.lit(False).alias("dropped")))


@query()
def lsh_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.lsh_candidates(documents(spark, sf, "id", "text"))


@query(f"""WITH {docs_cte(*_DOCS)}, o AS (SELECT id, source, sha256(text) AS sha, row_number() OVER (ORDER BY NOT commercial_safe, research_only, source, id) AS o FROM docs)
SELECT id, source FROM (SELECT *, arg_min(id, o) OVER (PARTITION BY sha, source) AS first_id FROM o) WHERE id = first_id""")
def dropped_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """What is left for packing once duplicates within a source are gone."""
    docs = documents(spark, sf, *_DOCS)
    gone = dedup.exact_duplicates(docs).filter("dropped").select("id")
    return docs.select("id", "source").join(gone, "id", "left_anti")


#: The key in SQL, which has no full case folding: that of the letters whose folding is longer than, or other than, their small form in these texts' languages.
_KEY = "sha256(rtrim(trim(regexp_replace(replace(replace(lower(nfc_normalize({0})), 'ß', 'ss'), 'ς', 'σ'), '[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+', ' ', 'g')), '?. '))"


@query(f"SELECT item_id, {_KEY.format('text')} AS question_key FROM benchmark")
def question_keys(spark: SparkSession, sf: str) -> DataFrame:
    return records.keyed(table(spark, sf, "benchmark"), "item_id", "text")


@query(f"""WITH k AS (SELECT DISTINCT {_KEY.format('text')} AS k FROM benchmark), s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT d.doc_id FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM s WHERE {_KEY.format('line')} IN (SELECT k FROM k)) AND source <> 'src3'""")
def contamination_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of sources that are not for evaluation only, none of whose lines is a benchmark text by key or by a form's raw hash."""
    docs = table(spark, sf, "documents").filter("source <> 'src3'").select("doc_id", "text")
    return docs.select("doc_id").join(records.contaminated(docs, table(spark, sf, "benchmark")), "doc_id", "left_anti")
