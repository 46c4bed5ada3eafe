"""Queries over chunk, prompt and result records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import corpus, records
from corvane.plans._tables import docs_cte, documents, table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


_CHUNKS = f"""{docs_cte("ord", "id", "citation_id", "text")}, ch AS (SELECT id || '#1' AS chunk_id, id AS doc_id, ord, citation_id, [citation_id || ' Satz 1', citation_id || ' Satz 2'] AS labels, text FROM docs)"""


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf, "ord", "id", "citation_id", "text")
    return d.select(F.concat("id", F.lit("#1")).alias("chunk_id"), F.col("id").alias("doc_id"), "ord", "citation_id", F.array(F.concat("citation_id", F.lit(" Satz 1")), F.concat("citation_id", F.lit(" Satz 2"))).alias("labels"), "text")


_ITEMS = "it AS (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN ['src' || (item_id % 20) || ':' || item_id || '#1', 'none#1'] ELSE ['none#2'] END AS explicit, ['L' || (item_id % 200) || ' §' || (item_id % 50), 'L' || ((item_id + 1) % 200) || ' §' || ((item_id + 1) % 50) || ' Satz 2'] AS gold FROM benchmark)"


@query(f"""WITH {_CHUNKS}, {_ITEMS}, held AS (SELECT DISTINCT item_id, chunk_id FROM (SELECT item_id, unnest(explicit) AS chunk_id FROM it) JOIN ch USING (chunk_id)),
cited AS (SELECT DISTINCT item_id, chunk_id FROM (SELECT item_id, unnest(gold) AS name FROM it) JOIN (SELECT chunk_id, unnest([citation_id] || labels) AS name FROM ch) USING (name))
SELECT * FROM held UNION ALL SELECT * FROM cited WHERE item_id NOT IN (SELECT item_id FROM held)""")
def gold_citation_join(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "benchmark")
    items = b.selectExpr(
        "item_id", "if(item_id % 3 = 0, array(concat('src', CAST(item_id % 20 AS STRING), ':', CAST(item_id AS STRING), '#1'), 'none#1'), array('none#2')) AS explicit",
        "array(concat('L', CAST(item_id % 200 AS STRING), ' §', CAST(item_id % 50 AS STRING)), concat('L', CAST((item_id + 1) % 200 AS STRING), ' §', CAST((item_id + 1) % 50 AS STRING), ' Satz 2')) AS gold",
    )
    return records.gold_chunks(items, _chunks(spark, sf))


@query(f"WITH {_CHUNKS} SELECT ord AS id, CASE WHEN ord % 7 = 0 THEN 'no' || chunk_id ELSE chunk_id END AS chunk_id, CASE WHEN ord % 7 = 0 THEN 'missing' ELSE 'differs' END AS state FROM ch WHERE ord % 7 = 0 OR ord % 11 = 0")
def row_index_consistency(spark: SparkSession, sf: str) -> DataFrame:
    c = _chunks(spark, sf)
    rows = c.selectExpr("ord AS id", "if(ord % 7 = 0, concat('no', chunk_id), chunk_id) AS chunk_id", "if(ord % 11 = 0, concat(text, '!'), text) AS text")
    return records.inconsistent(rows, c)


@query(f"""WITH {_CHUNKS}, g AS (SELECT source || ':' || doc_id AS id, list_sort(list_filter(list(source || ':' || doc_id) OVER (PARTITION BY text), lambda x: x <> source || ':' || doc_id)) AS copies, count(*) OVER (PARTITION BY text) AS n FROM documents)
SELECT chunk_id, CASE WHEN n > 1 THEN copies ELSE [] END AS copies FROM ch JOIN g ON doc_id = g.id""")
def chunk_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Copy groups of equal texts attached to every chunk."""
    d = documents(spark, sf, "id", "text").select("id", tx.sha256(F.col("text")).alias("h"))
    groups = d.groupBy("h").agg(F.sort_array(F.collect_list("id")).alias("m")).filter(F.size("m") > 1)
    per = d.join(groups, "h").select("id", F.filter("m", lambda x: x != F.col("id")).alias("copies"))
    return records.with_copies(_chunks(spark, sf), per).select("chunk_id", "copies")


@query("SELECT conv_id, turn, regexp_replace(trim(regexp_replace(nfc_normalize(text || chr(101) || chr(769)), '[\\s\\x{0B}\\x{85}\\p{Z}]+', ' ', 'g')), '^ | $', '', 'g') AS text FROM conversations")
def nfc_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Unicode canonical form; a decomposed letter is appended to each turn."""
    c = table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("k"), F.concat("text", F.lit("é")).alias("text"))
    out = records.nfc(c.withColumn("k", F.concat_ws(":", "k.conv_id", "k.turn")), "k", "text")
    return out.select(F.split_part("k", F.lit(":"), F.lit(1)).cast("long").alias("conv_id"), F.split_part("k", F.lit(":"), F.lit(2)).cast("long").alias("turn"), "text")


_TOK = "CASE (conv_id + turn) % 7 WHEN 0 THEN 'a q c1 s1 s2 b' WHEN 1 THEN 'q c1' WHEN 2 THEN 'cite c2 cite c3 s1' WHEN 3 THEN 's1' WHEN 4 THEN 'x y' WHEN 5 THEN 'q q c1 s1' ELSE 'cite x' END"


@query("SELECT conv_id, turn, (conv_id + turn) % 7 IN (0, 2, 4) AS valid FROM conversations")
def pointer_automaton(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", records.valid_pointer_tokens(F.split(F.expr(_TOK), " ")).alias("valid"))


@query("SELECT doc_id, '<|q|><|c1|>' || array_to_string(list_transform(range(1, len(string_split(text, chr(10))) + 1), lambda k: '<|s' || k || '|>'), '') AS answer FROM documents")
def copy_top_answers(spark: SparkSession, sf: str) -> DataFrame:
    s = F.split("text", "\n")
    return table(spark, sf, "documents").select("doc_id", records.copy_top(s, s).alias("answer"))


@query("""WITH r AS (SELECT source, t AS tokenizer, CASE t WHEN 'chars' THEN n_chars ELSE n_chars // 3 END AS tokens, n_chars // 6 + 1 AS words FROM documents, (VALUES ('chars'), ('thirds')) v(t))
SELECT source, tokenizer, sum(tokens)::BIGINT AS tokens, sum(words)::BIGINT AS words, sum(tokens)::DOUBLE / sum(words) AS ratio FROM r GROUP BY GROUPING SETS ((source, tokenizer), (tokenizer))""")
def fertility(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens to words by source and tokenizer and pooled, in one pass of grouping sets."""
    d = table(spark, sf, "documents").withColumn("tokenizer", F.explode(F.array(F.lit("chars"), F.lit("thirds"))))
    return records.fertility(d.selectExpr("source", "tokenizer", "if(tokenizer = 'chars', n_chars, n_chars DIV 3) AS tokens", "n_chars DIV 6 + 1 AS words"))


@query("""WITH p AS (SELECT conv_id % 90 AS id, turn % 3 AS label, CASE WHEN turn = 2 THEN '  ' ELSE text END AS premise, role AS hypothesis FROM conversations)
SELECT id, list_filter([CASE WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'repeated_id' END, CASE WHEN label NOT IN (0, 1) THEN 'label' END, CASE WHEN trim(premise) = '' THEN 'premise' END, CASE WHEN trim(hypothesis) = '' THEN 'hypothesis' END], lambda x: x IS NOT NULL) AS problems FROM p""")
def labelled_pair_problems(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "conversations").selectExpr("conv_id % 90 AS id", "turn % 3 AS label", "if(turn = 2, '  ', text) AS premise", "role AS hypothesis")
    return records.pair_problems(p)


@query("SELECT conv_id, sha256(string_agg(sha256(text), chr(31) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def cache_digests(spark: SparkSession, sf: str) -> DataFrame:
    return records.texts_digest(table(spark, sf, "conversations"), "conv_id", "turn", "text")


_REPLY = "CASE event_id % 5 WHEN 0 THEN concat('{\"rating\": ', CAST(event_id % 8 AS STRING), ', \"verdict\": \"correct\"}') WHEN 1 THEN '{\"verdict\": \"partial\"}' WHEN 2 THEN 'no json' WHEN 3 THEN '{\"rating\": \"x\", \"verdict\": \"other\"}' ELSE '{\"rating\": 5, \"verdict\": \"incorrect\"}' END"


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN CASE WHEN event_id % 8 BETWEEN 1 AND 5 THEN event_id % 8 END WHEN 4 THEN 5 END::INT AS rating, CASE event_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 4 THEN 0.0 END::DOUBLE AS verdict FROM events""")
def judge_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Bounded ratings and verdicts; malformed replies are null."""
    r = table(spark, sf, "events").selectExpr("event_id", f"{_REPLY} AS reply")
    return r.select("event_id", records.read_rating(F.col("reply")).alias("rating"), records.read_verdict(F.col("reply")).alias("verdict"))


@query("""SELECT c_custkey AS id, c_nationkey AS run, (c_custkey % 100) / 8.0::DOUBLE AS val_ppl FROM customer WHERE c_custkey % 3 = 0""")
def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics read from text lines; lines of another form are left out."""
    line = "if(c_custkey % 3 = 0, concat('VAL run-', CAST(c_nationkey AS STRING), ' step=10 val_ppl=', CAST(CAST(c_custkey % 100 AS DOUBLE) / 8D AS STRING)), 'warming up')"
    rows = table(spark, sf, "customer").selectExpr("c_custkey AS id", f"{line} AS line").filter(F.col("line").startswith("VAL "))
    return rows.select("id", F.regexp_extract("line", r"run-(\d+)", 1).cast("int").alias("run"), F.regexp_extract("line", r"val_ppl=(\S+)", 1).cast("double").alias("val_ppl"))


@query("""SELECT doc_id, trim(text) = trim(text || '  ') AS same, round(exp((n_chars % 40) / 10.0::DOUBLE), 9) AS ppl, round((n_chars % 40) / 10.0::DOUBLE / ln(2::DOUBLE), 9) AS bits FROM documents""")
def scalar_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Squeezed equality, perplexity and bits of a loss."""
    loss = (F.col("n_chars") % 40).cast("double") / F.lit(10.0)
    return table(spark, sf, "documents").select("doc_id", tx.exact_match(F.col("text"), F.concat("text", F.lit("  "))).alias("same"), F.round(F.exp(loss), 9).alias("ppl"), F.round(loss / F.log(F.lit(2.0)), 9).alias("bits"))


@query("""SELECT source || ':' || doc_id AS id, licence_ AS licence, licence_ NOT LIKE '%-NC-%' AS lic_commercial, licence_ LIKE '%-NC-%' AS lic_research FROM (SELECT *, CASE doc_id % 7 WHEN 0 THEN 'DE-UrhG-5' WHEN 1 THEN 'CH-URG-5' WHEN 2 THEN 'CC-BY-4.0' WHEN 3 THEN 'ODbL-1.0' WHEN 4 THEN 'ODC-By-1.0' WHEN 5 THEN 'CC-BY-NC-SA-4.0' ELSE 'CC-BY-NC-4.0' END AS licence_ FROM documents)""")
def licence_flags(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.licence_flags(documents(spark, sf, "id", "licence"))


@query("""SELECT conv_id, 'Frage: ' || min(text) FILTER (turn = 0) || chr(10) || string_agg('[' || (turn + 1) || '] ' || text, chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id""")
def judge_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """A question with its numbered passages."""
    c = table(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(F.min(F.when(F.col("turn") == 0, F.col("text"))).alias("q"), F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("t")))).alias("ps"))
    lines = F.transform("ps", lambda p: F.concat(F.lit("["), (p["turn"] + 1).cast("string"), F.lit("] "), p["t"]))
    return g.select("conv_id", F.concat(F.lit("Frage: "), F.col("q"), F.lit("\n"), F.array_join(lines, "\n")).alias("prompt"))
