"""Queries over unions, lookups, passages, gates and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import answers as grammar
from corvane.operators import assembly
from corvane.operators.html_sections import paper_sections
from corvane.plans._tables import docs_cte, documents, table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


@query("""SELECT source, count(*) AS n, count(text) AS with_text, count(url) AS with_url FROM (SELECT 'documents' AS source, text, NULL AS url FROM documents UNION ALL SELECT 'pages', NULL, url FROM pages UNION ALL SELECT 'benchmark', text, NULL FROM benchmark) GROUP BY source""")
def source_union(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of different columns as one table, counted."""
    rows = assembly.source_union({"documents": table(spark, sf, "documents").select("text"), "pages": table(spark, sf, "pages").select("url"), "benchmark": table(spark, sf, "benchmark").select("text")})
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count("text").alias("with_text"), F.count("url").alias("with_url"))


#: Hits of each conversation: a document for every turn.
_HITS = "SELECT conv_id AS qid, (conv_id * 7 + turn * 13) % 200 AS ord, turn + 1 AS rank FROM conversations"


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "conversations").selectExpr("conv_id AS qid", "(conv_id * 7 + turn * 13) % 200 AS id", "turn + 1 AS rank")
    return assembly.looked_up(hits, documents(spark, sf, "ord", "citation_id", "text").withColumnRenamed("ord", "id"))


@query(f"WITH {docs_cte('ord', 'citation_id', 'text')}, h AS ({_HITS}) SELECT qid, ord AS id, rank, citation_id, length(text) AS n FROM h JOIN docs USING (ord)")
def hit_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return _hits(spark, sf).select("qid", "id", "rank", "citation_id", F.length("text").alias("n"))


@query(f"""WITH {docs_cte('ord', 'citation_id', 'text')}, h AS ({_HITS}), p AS (SELECT qid, rank, citation_id, string_split(text, chr(10)) AS s, row_number() OVER (PARTITION BY qid ORDER BY rank) AS k FROM h JOIN docs USING (ord)),
m AS (SELECT *, array_to_string(list_transform(s, lambda t, j: '<|s' || j || '|>' || t), ' ') AS body FROM p WHERE k <= 16)
SELECT qid, string_agg('<|passage|><|c' || k || '|>' || citation_id || chr(10) || body || '<|/passage|>' || chr(10), '' ORDER BY k) AS prompt FROM m GROUP BY qid""")
def passage_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """The prompt's passages of each conversation, a line a sentence."""
    return assembly.passages(_hits(spark, sf).withColumn("sentences", F.split("text", "\n")))


@query("""WITH r AS (SELECT event_type AS arm, event_id AS id, event_id % 4 = 0 AS refused, event_id % 301 AS new_tokens, event_id % 5000 AS prompt_tokens FROM events)
SELECT arm, count(*) AS records, count(*) FILTER (refused) AS refused, round(avg(new_tokens), 9) AS mean_new_tokens, COALESCE(list_sort(list(id) FILTER (prompt_tokens > 4096)), []) AS extrapolated FROM r GROUP BY arm""")
def ablation_summary(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "events").selectExpr("event_type AS arm", "event_id AS id", "event_id % 4 = 0 AS refused", "event_id % 301 AS new_tokens", "event_id % 5000 AS prompt_tokens")
    return assembly.ablation_summary(r, 4096)


@query(f"""SELECT conv_id, turn, trim(CASE WHEN turn % 3 = 0 THEN text WHEN turn % 3 = 1 THEN '{grammar.NOTICE} ' || text ELSE text END, ' ' || chr(9) || chr(10) || chr(13)) AS answer FROM conversations""")
def answers_without_notice(spark: SparkSession, sf: str) -> DataFrame:
    """Answers that end in the notice, that hold it earlier, and that have none."""
    notice = F.lit(grammar.NOTICE)
    text = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("\n\n"), notice)).when(F.col("turn") % 3 == 1, F.concat(notice, F.lit(" "), "text")).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", assembly.without_notice(text).alias("answer"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN [] WHEN 1 THEN [event_id::VARCHAR] WHEN 2 THEN [event_type] ELSE [event_type, user_id::VARCHAR] END AS items FROM events""")
def json_lists(spark: SparkSession, sf: str) -> DataFrame:
    """null, a number, a string and a list, all as lists."""
    value = F.when(F.col("event_id") % 4 == 0, F.lit("null")).when(F.col("event_id") % 4 == 1, F.col("event_id").cast("string")).when(F.col("event_id") % 4 == 2, F.to_json(F.struct("event_type")).substr(F.lit(15), F.length("event_type") + 2))
    value = value.otherwise(F.to_json(F.array("event_type", F.col("user_id").cast("string"))))
    return table(spark, sf, "events").select("event_id", assembly.as_list(value).alias("items"))


@query("SELECT source, count(*) AS records, round(avg((1 + doc_id % 700 / 100.0::DOUBLE) * 1.0), 9) AS mean_nll, round(exp(sum((1 + doc_id % 700 / 100.0::DOUBLE) * (n_chars + 1)) / sum(n_chars + 1)), 9) AS ppl FROM documents GROUP BY source")
def token_means(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("source", ((1 + F.col("doc_id") % 700 / F.lit(100.0)) * (F.col("n_chars") + 1)).alias("nll"), (F.col("n_chars") + 1).alias("tokens"))
    return assembly.token_means(rows, ["source"])


@query("SELECT item_id FROM benchmark WHERE sha256(CASE WHEN item_id % 3 = 0 THEN text || '!' ELSE text END) IN (SELECT sha256(text) FROM benchmark)")
def manifest_hash_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Items of which every third was changed after the manifest was written."""
    b = table(spark, sf, "benchmark")
    changed = b.select("item_id", F.when(F.col("item_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"))
    return assembly.accepted(changed, b.select(F.sha2("text", 256).alias("sha256"))).select("item_id")


@query()
def paper_section_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of printed papers, labelled by the heading above and its article."""
    return paper_sections(table(spark, sf, "documents"), "doc_id", "text")
