"""Queries over sentences, chunks, HTML blocks, scrubbing and constructed sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import chunking, construction, scrub
from corvane.plans._tables import docs_cte, documents, table
from corvane.sources import html

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


@query()
def sentence_units(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.sentence_units(documents(spark, sf, "id", "text"))


def _structured(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf, "ord", "id", "doc_type", "citation_id", "text")
    ps = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    d = d.withColumn("paragraphs", ps).withColumn("heading", F.concat(F.lit("§ "), (F.col("ord") % 50).cast("string")))
    part = F.transform("paragraphs", lambda x, k: F.when(k < 2, "Tenor").otherwise("Gründe"))
    label = F.transform("paragraphs", lambda x, k: F.when(k < 2, "Tenor").otherwise(F.concat(F.lit("Rn. "), (k - 1).cast("string"))))
    return d.withColumns({"parts": part, "labels": label})


@query()
def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with the text that the indexes read."""
    c = chunking.chunks(_structured(spark, sf))
    return c.select("id", "doc_id", "citation_id", "anchor", "part", F.size("sentences").alias("n"), tx.sha256(chunking.chunk_text(F.col("citation_id"), F.col("hierarchy"), F.col("sentences"))).alias("text_sha"))


_SQ = "trim(regexp_replace({0}, '[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN {_SQ.format('text')} = '' THEN 0 ELSE ceil(2.28::DOUBLE * len(string_split({_SQ.format('text')}, ' '))) END::INT AS tokens FROM documents")
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.estimated_tokens(F.col("text")).alias("tokens"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS s FROM documents), f AS (SELECT doc_id, s, 1 AS k, s[1] AS used, 1 AS w FROM l
UNION ALL SELECT doc_id, s, k + 1, CASE WHEN used = 0 OR used + s[k + 1] <= 1200 THEN used + s[k + 1] ELSE s[k + 1] END, CASE WHEN used = 0 OR used + s[k + 1] <= 1200 THEN w ELSE w + 1 END FROM f WHERE k < len(s))
SELECT doc_id::VARCHAR AS id, list(w::INT ORDER BY k) AS windows FROM f GROUP BY doc_id""")
def greedy_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Lines laid greedily into windows of 1,200 characters."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.transform(F.split("text", "\n"), lambda x: F.length(x)).alias("sizes"))
    return chunking.greedy_windows(rows, 1200)


@query()
def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return html.exploded(table(spark, sf, "pages"), "page_id", "html", html.blocks)


@query()
def paper_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Printed lines to paragraphs with the heading they stand under."""
    d = html.exploded(table(spark, sf, "documents"), "doc_id", "text", html.paragraphs, "struct<heading:boolean,text:string>")
    under = F.last(F.when(F.col("item.heading"), F.col("item.text")), ignorenulls=True).over(W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn("under", under).filter(~F.col("item.heading")).select("doc_id", "pos", "under", F.col("item.text").alias("text"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) SELECT doc_id, k::INT AS k, line,
last_value(CASE WHEN k % 3 = 1 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM w""")
def heading_carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("k", F.col("p") + 1)
    last = F.last(F.when(F.col("k") % 3 == 1, F.col("line")), ignorenulls=True).over(W.partitionBy("doc_id").orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    return w.select("doc_id", "k", "line", last.alias("heading"))


@query("""WITH r AS (SELECT conv_id, turn, role, CASE WHEN role <> lag(role) OVER w OR lag(role) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), g AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM r)
SELECT conv_id, run::BIGINT AS run, role, count(*) AS n, min(turn) AS first_turn FROM g GROUP BY conv_id, run, role""")
def consecutive_runs(spark: SparkSession, sf: str) -> DataFrame:
    by = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf, "conversations").withColumn("new", F.coalesce((F.col("role") != F.lag("role").over(by)).cast("int"), F.lit(1)))
    return c.withColumn("run", F.sum("new").over(by)).groupBy("conv_id", "run", "role").agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"))


@query()
def entity_scrub(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of a pattern tagger replaced by numbered placeholders, with the log of keyed hashes."""
    out = scrub.scrub(documents(spark, sf, "id", "text"), b"key")
    return out.select("id", tx.sha256(F.col("text")).alias("text_sha"), F.size("log").alias("n_entities"), F.array_join(F.transform("log", lambda x: x["placeholder"]), " ").alias("placeholders"))


@query("""WITH m AS (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+') AS l FROM documents), f AS (SELECT doc_id, unnest(l) AS form, generate_subscripts(l, 1) AS k FROM m), o AS (SELECT doc_id, form, min(k) AS first FROM f GROUP BY ALL)
SELECT doc_id, form, '[PER_' || row_number() OVER (PARTITION BY doc_id ORDER BY first) || ']' AS placeholder FROM o""")
def placeholder_numbering(spark: SparkSession, sf: str) -> DataFrame:
    """One number for each surface form, in order of first appearance."""
    m = table(spark, sf, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+ [A-Z][a-z]+"), F.lit(0))).alias("k", "form"))
    return scrub.numbered_placeholders(m, "PER")


@query("""WITH logged AS (SELECT DISTINCT sha256('k:' || w) AS h FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS w FROM documents WHERE doc_id % 50 = 0)), forms AS (SELECT DISTINCT doc_id, sha256('k:' || w) AS h FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS w FROM documents WHERE doc_id % 50 <> 0))
SELECT doc_id, h FROM forms WHERE h IN (SELECT h FROM logged)""")
def leak_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    """Hashed name forms that a log of other documents holds."""
    d = table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("form"))
    h = tx.sha256(F.concat(F.lit("k:"), F.col("form")))
    hashed = d.distinct().select("doc_id", h.alias("h"))
    return scrub.leaks(hashed.filter("doc_id % 50 <> 0"), hashed.filter("doc_id % 50 = 0").select("h"))


@query(f"""WITH {docs_cte("ord", "id", "source", "n_chars")}, k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('4:' || id), id) AS p FROM docs), r AS (SELECT *, sum(n_chars) OVER (PARTITION BY source ORDER BY p) AS upto FROM k) SELECT source, id, p::INT AS place FROM r WHERE upto <= 15000""")
def context_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in hash order until the first that would pass the budget: it and all after it stay out."""
    return construction.until_budget(documents(spark, sf, "id", "source", "n_chars"), "source", "n_chars", 15_000, 4)


@query(f"""WITH {docs_cte("ord", "id", "source", "citation_id")}, q AS (SELECT item_id FROM benchmark), g AS (SELECT item_id, d.id AS gold, d.source AS gold_source FROM q JOIN docs d ON d.ord = item_id), c AS (SELECT item_id, gold, d.id, row_number() OVER (PARTITION BY item_id ORDER BY sha256('6:' || item_id || ':' || d.id), d.id) AS p FROM g JOIN docs d ON d.source = 'src' || ((item_id + 1) % 20) AND d.source <> gold_source),
k AS (SELECT * FROM c WHERE p <= 4), m AS (SELECT item_id, gold, list(id ORDER BY p) AS ds FROM k GROUP BY ALL HAVING count(*) = 4), a AS (SELECT *, floor(('0x' || substr(sha256('6:at:' || item_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 * 5)::INT AS at_ FROM m)
SELECT item_id, at_ + 1 AS position, ds[1:at_] || [gold] || ds[at_ + 1:4] AS prompt FROM a""")
def distractor_sets(spark: SparkSession, sf: str) -> DataFrame:
    """The gold document at a hashed place among four unrelated ones; items with fewer are left out."""
    d = documents(spark, sf, "ord", "id", "source")
    items = table(spark, sf, "benchmark").select("item_id")
    gold = items.join(d.select(F.col("ord").alias("item_id"), F.col("id").alias("gold"), F.col("source").alias("gold_source")), "item_id")
    pool = gold.withColumn("source", F.concat(F.lit("src"), ((F.col("item_id") + 1) % 20).cast("string"))).join(d.select("id", "source"), "source").filter("source <> gold_source")
    return construction.with_distractors(pool, 4, 6)


@query("""WITH i AS (SELECT conv_id * 10 + turn AS id, 'q' || conv_id AS question_id, length(text) AS n, turn % 5 = 0 AS refusal FROM conversations), k AS (SELECT * FROM i WHERE n <= 400), c AS (SELECT count(*) AS n, count(*) FILTER (refusal) AS u FROM k),
r AS (SELECT k.*, row_number() OVER (PARTITION BY refusal ORDER BY ('0x' || substr(sha256('2:' || id), 1, 16))::UBIGINT::DOUBLE DESC, id DESC) AS p, greatest(0, c.n - 5 * c.u) AS drops FROM k, c)
SELECT id, question_id, refusal, CASE WHEN ('0x' || substr(sha256('2:' || question_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 < 0.1 THEN 'dev' ELSE 'train' END AS split FROM r WHERE refusal OR p > drops""")
def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Over-long rows go, answers are cut by hash to a refusal share of a fifth, and questions split as a whole."""
    rows = table(spark, sf, "conversations").selectExpr("conv_id * 10 + turn AS id", "concat('q', CAST(conv_id AS STRING)) AS question_id", "length(text) AS n", "turn % 5 = 0 AS refusal")
    return construction.training_rows(rows, 400, 0.1, 2)


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), a AS (SELECT doc_id, ls, array_to_string(ls, ' ') AS ctx, substr(array_to_string(ls, ' '), 30, 40) AS answer FROM l WHERE len(ls) >= 2), s AS (SELECT *, strpos(ctx, answer) AS st FROM a WHERE length(answer) > 0),
o AS (SELECT doc_id, st, length(answer) AS n, generate_subscripts(ls, 1) AS j, unnest(ls) AS s FROM s), p AS (SELECT *, COALESCE(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ FROM o)
SELECT doc_id, list(j::INT ORDER BY j) AS hit FROM p WHERE at_ < st - 1 + n AND at_ + length(s) > st - 1 GROUP BY doc_id""")
def answer_span_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences that an answer's first span in the joined context overlaps."""
    d = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("sentences")).filter(F.size("sentences") >= 2)
    return construction.span_sentences(d.withColumn("answer", F.expr("substring(array_join(sentences, ' '), 30, 40)")).filter("answer <> ''"), "doc_id")
