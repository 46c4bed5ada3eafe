"""Queries over the derived corpus: gates, counts, filters, feeds, diffs and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import corpus, filters
from corvane.plans._tables import docs_cte, documents, table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


_BAD = {  # some rows are spoiled on purpose
    "id": "CASE WHEN ord % 41 = 0 THEN concat('other:', CAST(ord AS STRING)) WHEN ord % 43 = 0 THEN 'bare' ELSE id END",
    "source": "source",
    "jurisdiction": "CASE WHEN ord % 47 = 0 THEN 'XX' ELSE jurisdiction END",
    "doc_type": "CASE WHEN ord % 53 = 0 THEN 'memo' ELSE doc_type END",
    "licence": "CASE WHEN ord % 59 = 0 THEN '' ELSE licence END",
    "commercial_safe": "commercial_safe OR ord % 61 = 0",
    "research_only": "research_only OR ord % 61 = 0",
    "valid_from": "CASE WHEN ord % 67 = 0 THEN '2020-13-01' ELSE CAST(valid_from AS STRING) END",
    "valid_to": "CASE WHEN ord % 71 = 0 THEN '2001-01-01' ELSE CAST(valid_to AS STRING) END",
    "retrieved_at": "CASE WHEN ord % 73 = 0 THEN 'yesterday' ELSE '2024-05-01T10:00:00' END",
}


@query(f"""WITH {docs_cte()}, bad AS (SELECT text, ord, {', '.join(f'{e} AS {n}' for n, e in _BAD.items())}, CASE WHEN ord % 79 = 0 THEN 'x' ELSE sha256(text) END AS sha256 FROM docs)
SELECT id, list_filter([
  CASE WHEN NOT contains(id, ':') THEN 'id_shape' END, CASE WHEN contains(id, ':') AND NOT starts_with(id, source || ':') THEN 'id_source' END,
  CASE WHEN jurisdiction NOT IN ('DE', 'AT', 'CH', 'EU') THEN 'jurisdiction' END, CASE WHEN doc_type NOT IN ('statute', 'regulation', 'decision', 'parliament', 'general') THEN 'doc_type' END,
  CASE WHEN licence = '' THEN 'licence_missing' END, CASE WHEN research_only AND commercial_safe THEN 'flag_conflict' END,
  CASE WHEN valid_from IS NOT NULL AND TRY_CAST(valid_from AS DATE) IS NULL THEN 'valid_from' END, CASE WHEN valid_to IS NOT NULL AND TRY_CAST(valid_to AS DATE) IS NULL THEN 'valid_to' END,
  CASE WHEN valid_to < valid_from THEN 'window_order' END, CASE WHEN TRY_CAST(retrieved_at AS TIMESTAMP) IS NULL THEN 'retrieved_at' END, CASE WHEN sha256 <> sha256(text) THEN 'sha256' END], lambda x: x IS NOT NULL) AS problems FROM bad""")
def document_problems(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    bad = docs.selectExpr("text", "ord", *(f"{e} AS {n}" for n, e in _BAD.items())).withColumn("sha256", F.when(F.col("ord") % 79 == 0, "x").otherwise(tx.sha256(F.col("text"))))
    return corpus.document_problems(bad)


@query(f"""WITH {docs_cte("id", "licence", "commercial_safe", "research_only", "ord")}, d AS (SELECT id, CASE WHEN ord % 37 = 0 THEN 'unknown' WHEN ord % 38 = 0 THEN 'GPL' ELSE licence END AS licence, commercial_safe OR ord % 31 = 0 AS commercial_safe, research_only FROM docs)
SELECT * FROM (SELECT id, licence, CASE WHEN licence = 'unknown' THEN 'refused' WHEN licence NOT IN ('DE-UrhG-5', 'CH-URG-5', 'CC-BY-4.0', 'ODbL-1.0', 'ODC-By-1.0', 'CC-BY-NC-SA-4.0', 'CC-BY-NC-4.0') THEN 'unregistered'
  WHEN commercial_safe AND licence LIKE '%-NC-%' THEN 'claims_commercial' WHEN licence LIKE '%-NC-%' AND NOT research_only THEN 'not_marked_research' END AS problem FROM d) WHERE problem IS NOT NULL""")
def licence_gate(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "id", "licence", "commercial_safe", "research_only", "ord")
    spoiled = docs.withColumns({"licence": F.expr("CASE WHEN ord % 37 = 0 THEN 'unknown' WHEN ord % 38 = 0 THEN 'GPL' ELSE licence END"), "commercial_safe": F.expr("commercial_safe OR ord % 31 = 0")})
    return corpus.licence_problems(spoiled)


@query(f"""WITH {docs_cte("id", "source", "licence", "commercial_safe", "research_only")}
SELECT 'commercial_safe' AS arm, source, count(*) AS documents FROM docs WHERE commercial_safe AND NOT research_only GROUP BY source UNION ALL SELECT 'research', source, count(*) FROM docs GROUP BY source""")
def arm_admission(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "id", "source", "licence", "commercial_safe", "research_only")
    per = lambda arm: corpus.admitted(docs, arm).groupBy("source").agg(F.count("*").alias("documents")).withColumn("arm", F.lit(arm))
    return per("commercial_safe").unionByName(per("research"))


@query("SELECT conv_id AS id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("n")).filter("n > 1")


@query("""WITH f AS (SELECT CAST(conv_id AS VARCHAR) AS id, role AS text, min(turn) AS ord FROM conversations GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) - 1 AS k FROM f)
SELECT CASE WHEN k = 0 THEN id ELSE id || '#' || k END AS id, ord, text FROM k""")
def repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.unique_passages(table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("id"), F.col("role").alias("text"), F.col("turn").alias("ord")))


@query(f"WITH {docs_cte('id', 'source', 'jurisdiction', 'doc_type', 'licence', 'text')} SELECT id, source, jurisdiction, doc_type, licence, length(text)::INT AS n_chars, sha256(text) AS sha256 FROM docs")
def manifest_rows(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.manifest(documents(spark, sf, "id", "source", "jurisdiction", "doc_type", "licence", "text"))


@query(f"WITH {docs_cte('jurisdiction', 'licence', 'n_chars')} SELECT jurisdiction, licence, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM docs GROUP BY ALL")
def manifest_counts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.manifest_counts(documents(spark, sf, "jurisdiction", "licence", "n_chars"))


_TOKENS = "CASE WHEN trim(regexp_replace(text, '[\\s\\x{0B}\\x{85}\\p{Z}]+', ' ', 'g')) = '' THEN 0 ELSE ceil(2.28::DOUBLE * len(string_split(trim(regexp_replace(text, '[\\s\\x{0B}\\x{85}\\p{Z}]+', ' ', 'g')), ' '))) END::INT"
_RATIO = f"""{docs_cte("ord", "jurisdiction", "licence", "n_chars", "text")}, s AS (SELECT *, {_TOKENS} AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY jurisdiction ORDER BY ord) - 1 AS rn, count(*) OVER (PARTITION BY jurisdiction) AS n FROM docs) WHERE rn % greatest(1, n // 2000) = 0),
ratio AS (SELECT jurisdiction, sum(tokens)::DOUBLE / sum(n_chars) AS ratio, sum(tokens)::BIGINT AS tokens, sum(n_chars)::BIGINT AS chars FROM s WHERE jurisdiction <> 'EU' GROUP BY jurisdiction)"""


@query(f"WITH {_RATIO} SELECT * FROM ratio")
def stride_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens per character on every k-th document of each jurisdiction."""
    some = corpus.strided(documents(spark, sf, "ord", "jurisdiction", "n_chars", "text"), 2000, by=("jurisdiction",)).filter("jurisdiction <> 'EU'")
    return corpus.tokens_per_char(some, tx.estimated_tokens(F.col("text")))


@query(f"""WITH {_RATIO}, c AS (SELECT jurisdiction, licence, count(*) AS documents, sum(n_chars)::BIGINT AS chars FROM docs GROUP BY ALL)
SELECT c.jurisdiction, licence, documents, c.chars, round_even(c.chars * COALESCE(ratio, (SELECT sum(tokens)::DOUBLE / sum(chars) FROM ratio)), 0)::BIGINT AS est_tokens FROM c LEFT JOIN ratio USING (jurisdiction)""")
def estimated_counts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.estimated_counts(manifest_counts(spark, sf), stride_ratio(spark, sf))


@query(f"""WITH {docs_cte("jurisdiction", "n_chars", "commercial_safe", "research_only")} SELECT jurisdiction, count(*) AS research_docs, sum(n_chars)::BIGINT AS research_chars, count(*) FILTER (commercial_safe AND NOT research_only) AS commercial_docs,
COALESCE(sum(n_chars) FILTER (commercial_safe AND NOT research_only), 0)::BIGINT AS commercial_chars, grouping(jurisdiction)::INT AS is_total FROM docs GROUP BY ROLLUP (jurisdiction)""")
def arm_totals(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.arm_totals(documents(spark, sf, "jurisdiction", "n_chars", "commercial_safe", "research_only"))


@query(f"""WITH {docs_cte("source", "ord", "commercial_safe", "research_only", "licence")} SELECT source, count(*) AS documents, bool_and(commercial_safe) AS commercial_safe, bool_or(research_only) AS research_only,
array_to_string(list_sort(list_distinct(list(licence))), '+') AS licence, min(ord) AS first_ord FROM docs GROUP BY source""")
def source_meta(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.source_meta(documents(spark, sf, "source", "ord", "commercial_safe", "research_only", "licence"))


@query(f"""WITH {docs_cte("id", "jurisdiction", "doc_type", "valid_from", "valid_to")} SELECT id, jurisdiction, doc_type FROM docs WHERE jurisdiction IN ('DE', 'CH') AND doc_type IN ('statute', 'decision')
AND (valid_from IS NULL OR valid_from <= DATE '2021-01-01') AND (valid_to IS NULL OR DATE '2021-01-01' <= valid_to)""")
def jurisdiction_doctype_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "id", "jurisdiction", "doc_type", "valid_from", "valid_to")
    return filters.filter_rows(docs, ["DE", "CH"], "2021-01-01", ["statute", "decision"]).select("id", "jurisdiction", "doc_type")


@query(f"""WITH {docs_cte("id", "valid_from", "valid_to")}, days AS (SELECT DATE '2016-01-01' + (180 * k)::INT AS day FROM range(0, 12) r(k))
SELECT day, count(*) AS valid_docs, min(id) AS first_id FROM days JOIN docs ON (valid_from IS NULL OR valid_from <= day) AND (valid_to IS NULL OR day <= valid_to) GROUP BY day""")
def valid_on_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Validity windows against a dozen fixed days."""
    docs = documents(spark, sf, "id", "valid_from", "valid_to")
    days = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.date_add(F.lit("2016-01-01").cast("date"), k * 180))
    rows = docs.withColumn("day", F.explode(days)).filter(filters.valid_on(F.col("day"), F.col("valid_from"), F.col("valid_to")))
    return rows.groupBy("day").agg(F.count("*").alias("valid_docs"), F.min("id").alias("first_id"))


@query(f"WITH {docs_cte('id', 'doc_type')} SELECT doc_type, count(*) AS n FROM docs WHERE doc_type IN ('statute', 'regulation', 'decision') GROUP BY doc_type")
def indexed_types(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.indexed(documents(spark, sf, "id", "doc_type")).groupBy("doc_type").agg(F.count("*").alias("n"))


@query(f"""WITH {docs_cte("ord", "id", "source", "n_chars")}, k AS (SELECT * FROM docs WHERE n_chars <= 3000), r AS (SELECT *, COALESCE(sum(n_chars) OVER (PARTITION BY source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS words_before FROM k)
SELECT source, id, words_before FROM r WHERE words_before < 20000""")
def length_bounded_take(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "ord", "id", "source", "n_chars")
    return filters.take_words(docs, "ord", F.col("n_chars"), 20_000, 3_000, "source").select("source", "id", "words_before")


@query(f"""WITH {docs_cte()}, d AS (SELECT * FROM docs WHERE doc_type IN ('statute', 'regulation'))
SELECT n.citation_id, n.id, n.source, n.jurisdiction, n.valid_from, n.valid_to, arg_max(o.id, (o.valid_to, -o.ord)) AS previous_id
FROM d n LEFT JOIN d o ON o.source = n.source AND o.citation_id = n.citation_id AND o.valid_to < n.valid_from WHERE n.valid_from >= DATE '2018-01-01' GROUP BY ALL""")
def changelog_previous_version(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.changes_since(documents(spark, sf, "ord", "id", "source", "jurisdiction", "doc_type", "citation_id", "valid_from", "valid_to"), "2018-01-01")


@query(f"""WITH {docs_cte()}, v1 AS (SELECT * FROM docs WHERE ord % 13 <> 0), v2 AS (SELECT * REPLACE (CASE WHEN ord % 17 = 0 THEN text || '!' ELSE text END AS text, CASE WHEN ord % 19 = 0 THEN 'general' ELSE doc_type END AS doc_type) FROM docs WHERE ord % 11 <> 0)
SELECT COALESCE(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.text = b.text AND a.doc_type = b.doc_type THEN 'unchanged' WHEN a.text = b.text THEN 'metadata_only' ELSE 'changed' END AS state FROM v1 a FULL JOIN v2 b ON a.id = b.id""")
def index_resync_diff(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf, "ord", "id", "source", "doc_type", "citation_id", "text")
    v1 = docs.filter("ord % 13 <> 0")
    v2 = docs.filter("ord % 11 <> 0").withColumns({"text": F.expr("CASE WHEN ord % 17 = 0 THEN concat(text, '!') ELSE text END"), "doc_type": F.expr("CASE WHEN ord % 19 = 0 THEN 'general' ELSE doc_type END")})
    fields = ["source", "doc_type", "citation_id"]
    return corpus.index_diff(corpus.record_digest(v1, fields), corpus.record_digest(v2, fields))


@query("""SELECT CAST(a.doc_id AS VARCHAR) AS id, a.quality AS a, 1 - a.toxic AS b FROM labels a""")
def paired_ids(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").withColumn("id", F.col("doc_id").cast("string"))
    return corpus.paired(rows.select("id", F.col("quality").alias("a")), rows.select("id", (1 - F.col("toxic")).alias("b")))


@query("""WITH v AS (SELECT o_custkey AS act, o_orderdate AS day, o_orderkey AS file FROM orders) SELECT act, max(day)::DATE AS day, arg_max(file, (day, file)) AS file FROM v GROUP BY act""")
def latest_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The greatest (date, file) of each act."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("act"), F.col("o_orderdate").alias("day"), F.col("o_orderkey").alias("file"))
    return rows.groupBy("act").agg(F.max("day").cast("date").alias("day"), F.max(F.struct("day", "file"))["file"].alias("file"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def blocklist_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    blocked = table(spark, sf, "customer").filter("c_nationkey < 5").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").join(blocked, "o_custkey", "left_anti").select("o_orderkey")


@query("""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\\s\\x{0B}\\x{85}\\p{Z}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM documents""")
def web_text_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Lines squeezed, blank ones dropped; a text with nothing left is null."""
    lines = F.filter(F.transform(F.split("text", "\n"), tx.squeezed), lambda x: x != "")
    return table(spark, sf, "documents").select("doc_id", F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("text"))


@query("SELECT doc_id FROM documents ORDER BY sha256('7:' || doc_id), doc_id LIMIT 100")
def shuffled_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A seeded order by hash, then a limit: a top-k, not a full sort."""
    ids = table(spark, sf, "documents").select("doc_id")
    return ids.orderBy(tx.sha256(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), "doc_id").limit(100)


@query("""SELECT 'mixed:' || doc_id AS id, CASE lang WHEN 'de' THEN 'DE' WHEN 'fr' THEN 'CH' END AS jurisdiction, CASE WHEN source IN ('src0', 'src1') THEN 'decision' ELSE 'statute' END AS doc_type FROM documents WHERE lang IN ('de', 'fr')""")
def mapped_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Values through a dictionary; rows without an entry go."""
    places = F.create_map(F.lit("de"), F.lit("DE"), F.lit("fr"), F.lit("CH"))
    rows = table(spark, sf, "documents").select("doc_id", "source", places[F.col("lang")].alias("jurisdiction")).filter("jurisdiction is not null")
    return rows.select(F.concat(F.lit("mixed:"), F.col("doc_id").cast("string")).alias("id"), "jurisdiction", F.when(F.col("source").isin("src0", "src1"), "decision").otherwise("statute").alias("doc_type"))


@query("""SELECT doc_id, sha256(text) AS sha, ('0x' || substr(sha256('3:' || doc_id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS unit, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS hex_unit,
sha256(unhex(repeat('5c', 64)) || unhex(sha256(unhex(repeat('36', 64)) || encode(lang)))) AS keyed FROM documents""".replace("repeat('5c', 64)", "'" + "".join(f"{b ^ 0x5C:02x}" for b in b"key".ljust(64, b"\0")) + "'").replace("repeat('36', 64)", "'" + "".join(f"{b ^ 0x36:02x}" for b in b"key".ljust(64, b"\0")) + "'"))
def text_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Text hash, seeded unit numbers, and a keyed hash."""
    k = F.col("doc_id").cast("string")
    return table(spark, sf, "documents").select("doc_id", tx.sha256(F.col("text")).alias("sha"), tx.unit(3, k).alias("unit"), tx.hex_unit(k).alias("hex_unit"), tx.hmac_sha256(b"key", F.col("lang")).alias("keyed"))


@query("""SELECT doc_id, split_part(source || ':' || doc_id, ':', 1) AS source_of, regexp_replace(source || ':' || doc_id || '#' || (doc_id % 7), '#[^#]*$', '') AS doc_of, 'gii:' || 'bgb' || ':' || doc_id AS mapped, source || '.part-' || (doc_id % 4) || '-of-4' AS part,
CASE WHEN regexp_matches(lang, '^[a-z]{2}$') AND lang <> 'es' THEN upper(lang) ELSE 'SR ' || doc_id END AS act_code, TRY_CAST(substr(compact, 1, 4) || '-' || substr(compact, 5, 2) || '-' || substr(compact, 7, 2) AS DATE) AS day
FROM (SELECT *, '20' || lpad((doc_id % 25)::VARCHAR, 2, '0') || lpad((doc_id % 14)::VARCHAR, 2, '0') || lpad((doc_id % 33)::VARCHAR, 2, '0') AS compact FROM documents)""")
def id_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Source and document of an id, an outside id mapped, a part's name, an act code with fallback, compact dates."""
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", F.col("doc_id").cast("string").alias("k"))
    pad = lambda n: F.lpad((F.col("doc_id") % n).cast("string"), 2, "0")
    doc = F.concat("source", F.lit(":"), "k")
    outside = F.concat("k", F.lit("_bgb"))
    mapped = F.regexp_replace(outside, "^([0-9]+[a-z]*)_([a-z0-9]+)$", "gii:$2:$1")
    return d.select(
        "doc_id", tx.source_of(doc).alias("source_of"), tx.doc_of(F.concat(doc, F.lit("#"), (F.col("doc_id") % 7).cast("string"))).alias("doc_of"), mapped.alias("mapped"),
        F.concat("source", F.lit(".part-"), (F.col("doc_id") % 4).cast("string"), F.lit("-of-4")).alias("part"),
        F.when(F.col("lang").rlike("^[a-z]{2}$") & (F.col("lang") != "es"), F.upper("lang")).otherwise(F.concat(F.lit("SR "), "k")).alias("act_code"),
        F.try_to_date(F.concat(F.lit("20"), pad(25), pad(14), pad(33)), "yyyyMMdd").alias("day"),
    )


@query("""SELECT conv_id, turn, regexp_matches(text || ' Who was the plaintiff?', '(?i)\\bwho\\s+(?:is|was|are|were)\\b[^?!,;:]*?\\b(?:plaintiff|defendant|claimant|respondent|appellant|applicant|accused|part(?:y|ies))\\b') AND turn % 2 = 0 AS asks FROM conversations""")
def party_questions(spark: SparkSession, sf: str) -> DataFrame:
    """The party predicate over turns; every second one gets such a question appended."""
    text = F.when(F.col("turn") % 2 == 0, F.concat("text", F.lit(" Who was the plaintiff?"))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", filters.asks_for_party(text).alias("asks"))


@query("""WITH a AS (SELECT conv_id, role, turn, CASE WHEN turn % 3 = 0 THEN text ELSE text || '<|endoftext|>' END AS answer FROM conversations)
SELECT role, count(*) AS n, count(*) FILTER (NOT ends_with(answer, '<|endoftext|>')) AS truncated, count(*) FILTER (NOT ends_with(answer, '<|endoftext|>'))::DOUBLE / count(*) AS rate, list_sort(list(conv_id) FILTER (NOT ends_with(answer, '<|endoftext|>'))) AS ids FROM a GROUP BY role""")
def truncation_rates(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "conversations").withColumn("answer", F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("<|endoftext|>"))))
    cut = filters.truncated(F.col("answer"))
    return a.groupBy("role").agg(F.count("*").alias("n"), F.count_if(cut).alias("truncated"), (F.count_if(cut).cast("double") / F.count("*")).alias("rate"), F.nullif(F.sort_array(F.collect_list(F.when(cut, F.col("conv_id")))), F.array().cast("array<bigint>")).alias("ids"))


@query("""SELECT l_shipmode_ AS act, count(*) AS n, sum(q) AS total FROM (SELECT l_returnflag AS l_shipmode_, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1) GROUP BY ROLLUP (l_shipmode_)""")
def star_schema_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Engine smoke: a star join and a rollup."""
    t = lambda n: table(spark, sf, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation").filter("n_regionkey = 1"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.rollup(F.col("l_returnflag").alias("act")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"))
