"""Queries over citations, pointer answers, claims, pairs and refusals, derived from conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import citations
from corvane.functions import text as tx
from corvane.operators import answers
from corvane.plans._tables import documents, table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


_CITE = "CASE doc_id % 6 WHEN 0 THEN concat('BGB §', CAST(doc_id AS STRING), 'a Abs. 2 Nr. 1') WHEN 1 THEN concat('BGH VIII ZR ', CAST(doc_id AS STRING), '/20 Rn. 14') WHEN 2 THEN concat('BT-Drs. 21/', CAST(doc_id AS STRING), ' S. 3') WHEN 3 THEN concat('ZGB SchlT Art. ', CAST(doc_id AS STRING)) WHEN 4 THEN concat('BGer 4A_', CAST(doc_id AS STRING), '/2020 E. 3.2') ELSE concat('L', CAST(doc_id AS STRING), ' plain') END"


@query(f"""WITH c AS (SELECT doc_id, {_CITE.replace('concat(', 'concat(')} AS cid FROM documents)
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'statute' WHEN 1 THEN 'decision' WHEN 2 THEN 'parliament' WHEN 3 THEN 'statute' WHEN 4 THEN 'decision' END AS kind,
CASE doc_id % 6 WHEN 0 THEN 'BGB' WHEN 3 THEN 'ZGB' END AS code, CASE doc_id % 6 WHEN 0 THEN regexp_extract(cid, '§ ?([0-9]+[a-z]*)', 1) END AS paragraph, CASE doc_id % 6 WHEN 3 THEN regexp_extract(cid, 'Art\\. ([0-9]+[a-z]*)', 1) END AS article,
CASE doc_id % 6 WHEN 1 THEN 'BGH' WHEN 4 THEN 'BGer' END AS court, CASE doc_id % 6 WHEN 1 THEN regexp_extract(cid, '^BGH (.*) Rn', 1) WHEN 4 THEN regexp_extract(cid, '^BGer (.*) E', 1) END AS docket, CASE doc_id % 6 WHEN 2 THEN regexp_extract(cid, '([0-9]+/[0-9]+)', 1) END AS number,
CASE doc_id % 6 WHEN 0 THEN 'BGB' WHEN 3 THEN 'ZGB SchlT' ELSE cid END AS act FROM c""")
def citation_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Citation ids of all kinds parsed to their parts, and the act."""
    rows = table(spark, sf, "documents").selectExpr("doc_id", f"{_CITE} AS cid").withColumn("p", citations.parse(F.col("cid")))
    return rows.select("doc_id", "p.kind", "p.code", "p.paragraph", "p.article", "p.court", "p.docket", "p.number", citations.act_of(F.col("cid")).alias("act"))


_ANSWER = """CASE turn % 6 WHEN 0 THEN concat(text, '<|q|><|c', CAST(conv_id % 5 + 1 AS STRING), '|><|s1|><|s2|>', EOS) WHEN 1 THEN concat(text, '<|cite|><|c', CAST(turn AS STRING), '|>') WHEN 2 THEN '<|unanswerable|>' WHEN 3 THEN concat('A claim. ', '<|q|><|c1|><|s', CAST(conv_id % 4 + 1 AS STRING), '|><|s', CAST(conv_id % 3 + 2 AS STRING), '|>')
WHEN 4 THEN concat('<|q|><|c1|>', text) ELSE concat('<|cite|><|c2|><|s3|><|s3|> and <|junk|>', CAST(turn AS STRING)) END""".replace("EOS", "'<|endoftext|>'")


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").selectExpr("conv_id", "turn", "role", "text", f"{_ANSWER} AS answer")


@query(f"""WITH a AS (SELECT conv_id, turn, {_ANSWER} AS answer FROM conversations), p AS (SELECT *, regexp_extract_all(answer, '<\\|(?:q|cite)\\|><\\|c\\d+\\|>(?:<\\|s\\d+\\|>)*') AS ps, regexp_replace(regexp_replace(answer, '<\\|endoftext\\|>$', ''), '<\\|(?:q|cite)\\|><\\|c\\d+\\|>(?:<\\|s\\d+\\|>)*', '', 'g') AS rest FROM a),
q AS (SELECT *, list_transform(ps, lambda x: {{'quote': starts_with(x, '<|q|>'), 'k': regexp_extract(x, '<\\|c(\\d+)\\|>', 1)::INT, 's': list_transform(regexp_extract_all(x, '<\\|s(\\d+)\\|>', 1), lambda y: y::INT)}}) AS st FROM p)
SELECT conv_id, turn, trim(answer) = '<|unanswerable|>' OR NOT (regexp_matches(rest, '<\\|[^|<>]*\\|>') OR len(list_filter(ps, lambda x: starts_with(x, '<|q|>') AND NOT contains(x, '<|s'))) > 0) AS well_formed, len(ps)::INT AS n_pointers,
len(list_filter(st, lambda x: x.k BETWEEN 1 AND 3 AND len(list_filter(x.s, lambda j: j < 1 OR j > x.k + 2)) = 0 AND len(list_distinct(x.s)) = len(x.s) AND (NOT x.quote OR (len(x.s) > 0 AND x.s[len(x.s)] - x.s[1] = len(x.s) - 1 AND list_sort(x.s) = x.s))))::INT AS n_ok, array_to_string(ps, ' ') AS markup FROM q""")
def pointer_parse_check(spark: SparkSession, sf: str) -> DataFrame:
    """Pointers of each answer, checked against three passages of 3, 4 and 5 sentences."""
    rows = _answers(spark, sf).withColumn("p", answers.pointers(F.col("answer")))
    sizes = F.array(F.lit(3), F.lit(4), F.lit(5))
    ok = F.size(F.filter("p", lambda x: answers.pointer_ok(x, sizes)))
    return rows.select("conv_id", "turn", answers.well_formed(F.col("answer")).alias("well_formed"), F.size("p").alias("n_pointers"), ok.alias("n_ok"), F.array_join(F.transform("p", answers.pointer_text), " ").alias("markup"))


@query("""WITH s AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS s FROM documents), t AS (SELECT doc_id, s, list_transform(range(1, len(s) + 1), lambda k: 'L' || doc_id || ' Satz ' || ((k + 1) // 2)) AS l FROM s WHERE len(s) >= 2)
SELECT doc_id, '„' || s[1] || ' ' || s[2] || '“ (' || l[1] || ')' AS quote, '„' || s[1] || '“ (' || l[1] || ')' AS first FROM t""")
def render_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Quotes of the first two lines and of the first, with their distinct labels."""
    s = table(spark, sf, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: x != "").alias("s")).filter(F.size("s") >= 2)
    s = s.withColumn("l", F.transform("s", lambda x, k: F.concat(F.lit("L"), F.col("doc_id").cast("string"), F.lit(" Satz "), F.floor((k + 2) / 2).cast("string"))))
    return s.select("doc_id", answers.rendered_quote(F.col("s"), F.col("l"), F.array(F.lit(1), F.lit(2))).alias("quote"), answers.rendered_quote(F.col("s"), F.col("l"), F.array(F.lit(1))).alias("first"))


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf, "ord", "id", "citation_id", "source", "text")
    s = d.withColumn("sentences", F.slice(F.filter(F.split("text", "\n"), lambda x: x != ""), 1, 64)).filter(F.size("sentences") > 0)
    return s.select("ord", F.struct("sentences", F.transform("sentences", lambda x, k: F.concat(F.col("citation_id"), F.lit(" Satz "), (k + 1).cast("string"))).alias("labels"), "citation_id", "source").alias("p"))


@query()
def verify_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Each answer against the document of its conversation's number and the next, with stand-in entailment."""
    a = _answers(spark, sf).withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    one, two = (_passages(spark, sf).select(F.col("ord").alias(f"o{k}"), F.col("p").alias(f"p{k}")) for k in (1, 2))
    j = a.join(one, F.col("conv_id") == F.col("o1")).join(two, F.col("conv_id") + 1 == F.col("o2"), "left")
    rows = j.select("id", F.col("text").alias("question"), "answer", F.filter(F.array("p1", "p2"), lambda x: x.isNotNull()).alias("passages"))
    out = answers.verify(rows)
    return out.select("id", "refused", "reason", "precision", F.size("claims").alias("n_claims"), F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha"))


_CLAIMS = "SELECT role, conv_id, turn, turn % 3 > 0 AS cited, (conv_id * 7 + turn) % 5 > 1 AS passed FROM conversations"


@query(f"""WITH c AS ({_CLAIMS}) SELECT role, count(*) FILTER (cited) AS cited_claims, count(*) FILTER (cited AND passed) AS passed_cited_claims, (count(*) FILTER (cited AND passed))::DOUBLE / nullif(count(*) FILTER (cited), 0) AS precision FROM c GROUP BY role""")
def pooled_precision(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").selectExpr("role", "turn % 3 > 0 AS cited", "(conv_id * 7 + turn) % 5 > 1 AS passed")
    return answers.pooled_precision(c, ["role"])


@query("""WITH r AS (SELECT role AS system, conv_id % 2 AS seed, (conv_id + turn) % 4 = 0 AS refused, role <> 'system' AND (conv_id + turn) % 6 = 0 AS should_refuse FROM conversations), g AS (SELECT system, seed, count(*) AS records, count(*) FILTER (refused) AS refused, count(*) FILTER (should_refuse) AS should, count(*) FILTER (refused AND should_refuse) AS correct, avg((refused = should_refuse)::INT) AS accuracy FROM r GROUP BY ALL),
x AS (SELECT *, CASE WHEN refused > 0 THEN correct::DOUBLE / refused ELSE 0 END AS p, correct::DOUBLE / nullif(should, 0) AS rc FROM g)
SELECT system, seed, records, CASE WHEN should > 0 THEN p END AS precision, CASE WHEN should > 0 THEN rc END AS recall, CASE WHEN should > 0 THEN CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END END AS f1, round(accuracy, 9) AS accuracy FROM x""")
def refusal_prf(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "conversations").selectExpr("role AS system", "conv_id % 2 AS seed", "(conv_id + turn) % 4 = 0 AS refused", "role <> 'system' AND (conv_id + turn) % 6 = 0 AS should_refuse")
    return answers.refusal_scores(r, ["system", "seed"])


@query("""WITH s AS (SELECT conv_id AS id, turn AS n, CASE WHEN turn % 5 = 4 THEN -1.0 ELSE (length(text) % 7)::DOUBLE END AS s, turn % 2 = 0 AS refused FROM conversations) SELECT id, arg_max(n, (s, -n)) AS n, count(*) FILTER (refused) * 2 >= count(*) AS model_refused FROM s GROUP BY id""")
def best_of_n(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "conversations").selectExpr("conv_id AS id", "turn AS n", "CAST(length(text) % 7 AS DOUBLE) AS score", "turn % 5 = 4 AS truncated", "turn % 2 = 0 AS refused")
    return answers.best_of_n(s)


_SAMPLES = "SELECT conv_id AS id, turn AS n, length(text) % 3 > 0 AS good, length(text) % 4 AS so, length(text) % 2 AS po FROM conversations"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "conversations").selectExpr("conv_id AS id", "turn AS n", "length(text) % 3 > 0 AS good", "length(text) % 4 AS sentence_overlap", "length(text) % 2 AS passage_overlap")
    return answers.select_pairs(s)


@query(f"WITH s AS ({_SAMPLES}) SELECT id, arg_max(n, (so, po, -n)) FILTER (good) AS chosen, min(n) FILTER (NOT good) AS rejected FROM s GROUP BY id HAVING count(*) FILTER (good) > 0 AND count(*) FILTER (NOT good) > 0")
def preference_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf)


@query(f"""WITH s AS ({_SAMPLES}), p AS (SELECT id, id % 3 = 0 AS refusal FROM s GROUP BY id HAVING count(*) FILTER (good) > 0 AND count(*) FILTER (NOT good) > 0), n AS (SELECT count(*) FILTER (refusal) AS r, count(*) FILTER (NOT refusal) AS a FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY refusal ORDER BY ('0x' || substr(sha256('0:' || id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0, id) AS place FROM p, n)
SELECT id, refusal FROM k WHERE place <= CASE WHEN refusal THEN CASE WHEN r * 3 > a * 1 THEN ceil(a * 1 / 3.0) ELSE r END ELSE CASE WHEN r * 3 > a * 1 THEN a ELSE ceil(r * 3 / 1.0) END END""")
def balance_classes(spark: SparkSession, sf: str) -> DataFrame:
    return answers.balance(_pairs(spark, sf).select("id", (F.col("id") % 3 == 0).alias("refusal")), (1, 4))


@query("""WITH r AS (SELECT conv_id * 100 + turn AS id, role = 'system' OR turn % 3 = 0 AS refusal FROM conversations), n AS (SELECT count(*) FILTER (NOT refusal) AS a, count(*) FILTER (refusal) AS r FROM r), t AS (SELECT a, r, least(r, floor(a * 0.3 / 0.7 + 1e-9)) AS nr FROM n), u AS (SELECT *, least(a, CASE WHEN nr = 0 THEN 0 ELSE floor(nr * 4 + 1e-9) END) AS na FROM t),
k AS (SELECT *, row_number() OVER (PARTITION BY refusal ORDER BY ('0x' || substr(sha256('7:share:' || id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0, id) AS place FROM r, u) SELECT id, refusal FROM k WHERE place <= CASE WHEN refusal THEN nr ELSE na END""")
def share_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Cut the side that is over so that refusals make 20 to 30 per cent, in closed form."""
    r = table(spark, sf, "conversations").selectExpr("conv_id * 100 + turn AS id", "role = 'system' OR turn % 3 = 0 AS refusal")
    n = r.agg(F.count_if(~F.col("refusal")).alias("a"), F.count_if("refusal").alias("r"))
    nr = F.least(F.col("r"), F.floor(F.col("a") * 0.3 / 0.7 + 1e-9))
    rows = r.crossJoin(F.broadcast(n)).withColumn("nr", nr)
    rows = rows.withColumn("na", F.least(F.col("a"), F.when(F.col("nr") == 0, 0).otherwise(F.floor(F.col("nr") * 4 + 1e-9))))
    place = F.row_number().over(W.partitionBy("refusal").orderBy(tx.unit(7, F.concat(F.lit("share:"), F.col("id").cast("string"))), "id"))
    return rows.withColumn("place", place).filter(F.col("place") <= F.when(F.col("refusal"), F.col("nr")).otherwise(F.col("na"))).select("id", "refusal")


@query("""WITH r AS (SELECT conv_id AS id, turn AS rank, turn % 3 = 0 AS useful FROM conversations), h AS (SELECT *, sum(useful::INT) OVER (PARTITION BY id ORDER BY rank) AS hits, row_number() OVER (PARTITION BY id ORDER BY rank) AS place FROM r)
SELECT id, round(COALESCE(avg(CASE WHEN useful THEN hits::DOUBLE / place END), 0), 12) AS ap FROM h GROUP BY id""")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    from corvane.operators.ranking_metrics import average_precision as ap

    return ap(table(spark, sf, "conversations").selectExpr("conv_id AS id", "turn AS rank", "turn % 3 = 0 AS useful")).withColumn("ap", F.round("ap", 12))


@query("""SELECT kind, k::INT AS slot FROM (SELECT kind, row_number() OVER (ORDER BY (j + 0.5) / r, o) AS k FROM (VALUES ('answerable', 7, 0), ('unanswerable', 2, 1), ('partial', 3, 2)) t(kind, r, o), LATERAL (SELECT unnest(range(0, r)) AS j)) WHERE k <= 10""")
def interleaved_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds in proportion to what is missing of each: the (j + 0.5) / r slots in order."""
    rows = spark.createDataFrame([("answerable", 7, 0), ("unanswerable", 2, 1), ("partial", 3, 2)], "kind string, r int, o int")
    slots = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("r") - 1)))
    return slots.withColumn("slot", F.row_number().over(W.orderBy((F.col("j") + 0.5) / F.col("r"), "o"))).filter("slot <= 10").select("kind", "slot")


@query("""WITH a AS (SELECT conv_id AS id, 'k' || (turn % 3) AS arm, ['a', 'b', 'c'] AS chunk_ids, ['a', 'b', 'c'][(conv_id % 3 + 1)] AS gold, CASE turn % 4 WHEN 0 THEN '<|unanswerable|>' WHEN 1 THEN 'x<|q|><|c' || (conv_id % 4 + 1) || '|><|s1|>' WHEN 2 THEN '<|cite|><|c1|> y <|cite|><|c3|>' ELSE 'none' END AS answer FROM conversations),
c AS (SELECT *, list_transform(regexp_extract_all(answer, '<\\|c(\\d+)\\|>', 1), lambda x: chunk_ids[x::INT]) AS cited FROM a)
SELECT id, arm, list_position(chunk_ids, gold)::BIGINT AS position, COALESCE(cited[1] = gold, false) AS selected, list_contains(cited, gold) AS any_gold, contains(answer, '<|unanswerable|>') AS model_refused FROM c""")
def gold_selection(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "conversations").selectExpr("conv_id AS id", "concat('k', CAST(turn % 3 AS STRING)) AS arm", "array('a', 'b', 'c') AS chunk_ids", "element_at(array('a', 'b', 'c'), CAST(conv_id % 3 + 1 AS INT)) AS gold", "CASE turn % 4 WHEN 0 THEN '<|unanswerable|>' WHEN 1 THEN concat('x<|q|><|c', CAST(conv_id % 4 + 1 AS STRING), '|><|s1|>') WHEN 2 THEN '<|cite|><|c1|> y <|cite|><|c3|>' ELSE 'none' END AS answer")
    return answers.selection_outcomes(a)
