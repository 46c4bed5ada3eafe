"""Queries over text metrics, agreement, thresholds, bootstrap, curves and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import stats, text_metrics
from corvane.plans._tables import table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


_SQ = "trim(regexp_replace({0}, '[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"
_SPLIT = "list_filter(string_split(" + _SQ + ", ' '), lambda x: x <> '')"


def _turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn with the one before it."""
    t = table(spark, sf, "conversations")
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return t.withColumn("prev", before).filter("prev is not null")


_PAIRS = "pairs AS (SELECT * FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) WHERE prev IS NOT NULL)"


@query(f"""WITH {_PAIRS}, s AS (SELECT conv_id, turn, {_SQ.format('text')} AS a, {_SQ.format('prev')} AS b FROM pairs),
ga AS (SELECT conv_id, turn, g, count(*) AS x FROM (SELECT conv_id, turn, unnest(CASE WHEN length(a) >= 3 THEN list_transform(range(1, length(a) - 1), lambda i: substr(a, i, 3)) WHEN a <> '' THEN [a] ELSE [] END) AS g FROM s) GROUP BY ALL),
gb AS (SELECT conv_id, turn, g, count(*) AS y FROM (SELECT conv_id, turn, unnest(CASE WHEN length(b) >= 3 THEN list_transform(range(1, length(b) - 1), lambda i: substr(b, i, 3)) WHEN b <> '' THEN [b] ELSE [] END) AS g FROM s) GROUP BY ALL),
m AS (SELECT conv_id, turn, sum(least(x, y))::DOUBLE AS same FROM ga JOIN gb USING (conv_id, turn, g) GROUP BY ALL)
SELECT conv_id, turn, round(CASE WHEN same > 0 THEN 2 * (same / greatest(length(a) - 2, 1)) * (same / greatest(length(b) - 2, 1)) / (same / greatest(length(a) - 2, 1) + same / greatest(length(b) - 2, 1)) ELSE 0 END, 12) AS char_f1 FROM s LEFT JOIN m USING (conv_id, turn)""")
def char_trigram_f1(spark: SparkSession, sf: str) -> DataFrame:
    return text_metrics.char_f1(_turn_pairs(spark, sf), "text", "prev", ["conv_id", "turn"]).withColumn("char_f1", F.round("char_f1", 12))


@query(f"""WITH w AS (SELECT lang, {_SPLIT.format('text')} AS w FROM documents), g AS (SELECT lang, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM w, range(1, 5) r(n) WHERE len(w) >= n)
SELECT lang, n::INT AS n, count(*) AS total, count(DISTINCT g) AS unique, count(DISTINCT g)::DOUBLE / count(*) AS ratio FROM g GROUP BY lang, n""")
def distinct_n(spark: SparkSession, sf: str) -> DataFrame:
    return text_metrics.distinct_n(table(spark, sf, "documents"), ["lang"], "text")


@query("""WITH c AS (SELECT lang, text, count(*) AS c FROM documents GROUP BY ALL) SELECT lang, count(*) FILTER (c > 1) AS clusters, COALESCE(sum(c) FILTER (c > 1), 0)::BIGINT AS members, COALESCE(sum(c) FILTER (c > 1), 0)::DOUBLE / sum(c) AS fraction,
COALESCE(list(c ORDER BY c DESC) FILTER (c > 1), [])[1:5] AS largest FROM c GROUP BY lang""")
def duplicate_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return text_metrics.duplicate_clusters(table(spark, sf, "documents"), ["lang"], "text")


_BLEU = " ".join(f"""h{n} AS (SELECT conv_id, turn, role, g, count(*) AS n FROM (SELECT conv_id, turn, role, unnest(list_transform(range(1, len(h) - {n - 2}), lambda i: array_to_string(h[i:i + {n - 1}], ' '))) AS g FROM t WHERE len(h) >= {n}) GROUP BY ALL),
r{n} AS (SELECT conv_id, turn, g, count(*) AS m FROM (SELECT conv_id, turn, unnest(list_transform(range(1, len(r) - {n - 2}), lambda i: array_to_string(r[i:i + {n - 1}], ' '))) AS g FROM t WHERE len(r) >= {n}) GROUP BY ALL),
p{n} AS (SELECT role, sum(least(n, COALESCE(m, 0)))::DOUBLE / sum(n) AS p FROM h{n} LEFT JOIN r{n} USING (conv_id, turn, g) GROUP BY role),""" for n in (1, 2, 3, 4))


@query(f"""WITH {_PAIRS}, t AS (SELECT conv_id, turn, role, {_SPLIT.format('text')} AS h, {_SPLIT.format("concat(text, ' ', prev)")} AS r FROM pairs), {_BLEU}
l AS (SELECT role, sum(len(h)) AS hl, sum(len(r)) AS rl FROM t GROUP BY role)
SELECT role, round(CASE WHEN hl > rl THEN 1 ELSE exp(1 - rl::DOUBLE / hl) END * CASE WHEN least(COALESCE(p1.p, 0), COALESCE(p2.p, 0), COALESCE(p3.p, 0), COALESCE(p4.p, 0)) = 0 THEN 0 ELSE exp((ln(p1.p) + ln(p2.p) + ln(p3.p) + ln(p4.p)) / 4) END, 9) AS bleu
FROM l LEFT JOIN p1 USING (role) LEFT JOIN p2 USING (role) LEFT JOIN p3 USING (role) LEFT JOIN p4 USING (role)""")
def corpus_bleu(spark: SparkSession, sf: str) -> DataFrame:
    """Turns against themselves with the one before appended."""
    p = _turn_pairs(spark, sf).withColumns({"ref": F.concat("text", F.lit(" "), "prev"), "k": F.concat_ws(":", "conv_id", "turn")})
    return text_metrics.corpus_bleu(p, ["role"], "k", "text", "ref")


@query()
def rouge_l(spark: SparkSession, sf: str) -> DataFrame:
    return text_metrics.rouge_l(_turn_pairs(spark, sf), ["conv_id", "turn"], "text", "prev")


@query()
def self_bleu(spark: SparkSession, sf: str) -> DataFrame:
    return text_metrics.self_bleu(table(spark, sf, "conversations"), "role", "text")


_PRED = "SELECT l.doc_id, d.lang, d.source, l.quality AS label, CASE WHEN contains(d.text, '***') OR contains(d.text, '!!') OR d.n_chars < 200 THEN 0 ELSE 1 END AS pred, (d.n_chars % 97) / 97.0::DOUBLE AS p FROM labels l JOIN documents d USING (doc_id)"


def _pred(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return j.selectExpr("doc_id", "lang", "source", "quality AS label", "CASE WHEN contains(text, '***') OR contains(text, '!!') OR n_chars < 200 THEN 0 ELSE 1 END AS pred", "CAST(n_chars % 97 AS DOUBLE) / 97D AS p")


@query(f"""WITH x AS ({_PRED}), c AS (SELECT lang, count(*)::DOUBLE AS n, (count(*) FILTER (label = 1 AND pred = 1))::DOUBLE AS tp, (count(*) FILTER (label = 0 AND pred = 1))::DOUBLE AS fp, (count(*) FILTER (label = 1 AND pred = 0))::DOUBLE AS fn, (count(*) FILTER (label = 0 AND pred = 0))::DOUBLE AS tn FROM x GROUP BY lang),
k AS (SELECT *, (tp + tn) / n AS seen, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS chance FROM c)
SELECT lang, n::BIGINT AS n, seen AS accuracy, CASE WHEN chance < 1 THEN round((seen - chance) / (1 - chance), 12) END AS kappa, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM k""")
def agreement_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return stats.agreement(_pred(spark, sf), ["lang"])


_SCAN = f"""x AS ({_PRED}), t AS (SELECT DISTINCT p AS threshold FROM x), s AS (SELECT threshold, count(*) FILTER (p >= threshold AND label = 1) AS tp, count(*) FILTER (p >= threshold AND label = 0) AS fp, count(*) FILTER (p < threshold AND label = 1) AS fn FROM t, x GROUP BY threshold),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS recall FROM s), f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r)"""


@query(f"WITH {_SCAN} SELECT threshold, tp, fp, fn, precision, recall, f1 FROM f")
def threshold_scan(spark: SparkSession, sf: str) -> DataFrame:
    return stats.threshold_scan(_pred(spark, sf))


@query(f"WITH {_SCAN} SELECT threshold, tp, fp, fn, precision, recall, f1 FROM f ORDER BY round(f1, 12) DESC, threshold DESC LIMIT 1")
def best_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return stats.best_threshold(_pred(spark, sf))


_METRICS = "SELECT doc_id::VARCHAR AS id, 'quality' AS metric, quality::DOUBLE AS a, (doc_id % 3 > 0)::INT::DOUBLE AS b FROM labels UNION ALL SELECT doc_id::VARCHAR, 'toxic', toxic::DOUBLE, (doc_id % 7 = 0)::INT::DOUBLE FROM labels WHERE doc_id % 2 = 0"


def _metrics(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "labels").withColumn("id", F.col("doc_id").cast("string"))  # noqa: E741
    long = lambda rows, name, e: rows.select("id", F.lit(name).alias("metric"), F.expr(e).cast("double").alias("value"))
    even = l.filter("doc_id % 2 = 0")
    a = long(l, "quality", "quality").unionByName(long(l, "toxic", "toxic"))
    b = long(l, "quality", "CAST(doc_id % 3 > 0 AS INT)").unionByName(long(even, "toxic", "CAST(doc_id % 7 = 0 AS INT)"))
    return stats.paired_items(a, b)


@query(f"{_METRICS}")
def sparse_paired_items(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf)


@query(f"""WITH m AS ({_METRICS}), i AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT id FROM m)), nn AS (SELECT max(n) AS n FROM i),
d AS (SELECT x // n AS s, floor(('0x' || substr(sha256('11:' || x), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 * n)::BIGINT AS k FROM nn, range(0, 1000 * (SELECT n FROM nn)) r(x)),
dr AS (SELECT s, k, count(*) AS times FROM d GROUP BY s, k), per AS (SELECT metric, s, round(sum(times * (a - b)) / sum(times), 9) AS d FROM dr JOIN i USING (k) JOIN m USING (id) GROUP BY metric, s),
pt AS (SELECT metric, count(*) AS n, round(avg(a), 9) AS a, round(avg(b), 9) AS b, round(avg(a - b), 9) AS diff FROM m GROUP BY metric),
rk AS (SELECT metric, d, diff, row_number() OVER (PARTITION BY metric ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY metric) AS c FROM per JOIN pt USING (metric)),
ci AS (SELECT metric, max(d) FILTER (r = greatest(0, floor(0.025::DOUBLE * c)::BIGINT - 1)) AS ci_low, max(d) FILTER (r = least(c - 1, floor(0.975::DOUBLE * c)::BIGINT)) AS ci_high, (count(*) FILTER (CASE WHEN diff > 0 THEN d <= 0 WHEN diff < 0 THEN d >= 0 ELSE true END))::DOUBLE / count(*) AS frac_sign_flipped FROM rk GROUP BY metric)
SELECT *, ci_low > 0 OR ci_high < 0 AS significant FROM pt JOIN ci USING (metric)""")
def paired_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return stats.paired_bootstrap(_metrics(spark, sf), 1000, 11)


def _scalars(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr("concat('u', CAST(user_id % 5 AS STRING)) AS run", "event_id % 3 AS version", "event_type AS tag", "event_id AS step", "value")


_SCALARS = "sc AS (SELECT 'u' || (user_id % 5) AS run, event_id % 3 AS version, event_type AS tag, event_id AS step, value FROM events), la AS (SELECT * FROM sc QUALIFY version = max(version) OVER (PARTITION BY run)), g AS (SELECT run, step // 500 AS w, tag, avg(value) AS mean, max(value) AS most, arg_max(value, step) AS last FROM la GROUP BY ALL)"


@query(f"""WITH {_SCALARS} SELECT run, w, tag, 'mean' AS kind, round(mean, 9) AS value FROM g WHERE tag IN ('view', 'click') UNION ALL SELECT run, w, tag, 'most', round(most, 9) FROM g WHERE tag = 'view' UNION ALL SELECT run, w, tag, 'last', round(last, 9) FROM g WHERE tag IN ('purchase', 'login', 'signup')""")
def step_curves(spark: SparkSession, sf: str) -> DataFrame:
    return stats.step_curves(stats.latest_only(_scalars(spark, sf)), 500, ("view", "click"), ("view",), ("purchase", "login", "signup"))


@query("SELECT 'r' || (o_custkey % 9) AS run, round(sum(o_totalprice * (o_orderkey % 50 + 1)) / sum(o_orderkey % 50 + 1), 9) AS s_per_step, max(o_totalprice) AS peak_gb, count(*) AS legs FROM orders GROUP BY ALL")
def leg_merge(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").selectExpr("concat('r', CAST(o_custkey % 9 AS STRING)) AS run", "o_totalprice AS s", "o_orderkey % 50 + 1 AS n", "o_totalprice AS gb")
    return stats.merged_legs(rows)


_ARMS = "SELECT 'S' || (s_nationkey % 6 + 1) AS arm, s_suppkey % 2 AS seed, m AS metric, CASE WHEN s_nationkey % 6 = 3 AND m = 'b' THEN NULL ELSE round(avg(s_acctbal) / 1000 + length(m), 6) END AS value FROM supplier, (VALUES ('a'), ('b'), ('c')) t(m) GROUP BY s_nationkey % 6, s_suppkey % 2, m"
_MEANS = f"arms AS ({_ARMS}), means AS (SELECT arm, metric, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS sd FROM arms GROUP BY arm, metric HAVING count(value) = 2)"


def _arms(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").withColumn("metric", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))))
    g = s.groupBy((F.col("s_nationkey") % 6).alias("k"), (F.col("s_suppkey") % 2).alias("seed"), "metric").agg(F.avg("s_acctbal").alias("v"))
    value = F.when((F.col("k") == 3) & (F.col("metric") == "b"), F.lit(None)).otherwise(F.round(F.col("v") / 1000 + F.length("metric"), 6))
    return g.select(F.concat(F.lit("S"), (F.col("k") + 1).cast("string")).alias("arm"), "seed", "metric", value.alias("value"))


@query(f"WITH {_MEANS} SELECT * FROM means")
def arm_means(spark: SparkSession, sf: str) -> DataFrame:
    return stats.arm_means(_arms(spark, sf))


@query(f"""WITH {_MEANS}, w AS (SELECT arm, max(mean) FILTER (metric = 'a') AS a, max(mean) FILTER (metric = 'b') AS b, max(mean) FILTER (metric = 'c') AS c FROM means GROUP BY arm), z AS (SELECT w.arm, round(s.a - w.a, 9) AS gain, w.a, w.b, w.c, s.b - w.b > 0.05 OR s.c - w.c > 0.05 AS loses FROM w, (SELECT * FROM w WHERE arm = 'S1') s WHERE w.arm <> 'S1')
SELECT arm, gain, CASE WHEN a IS NULL OR b IS NULL OR c IS NULL THEN 'incomplete' WHEN gain > 0.05 AND NOT loses THEN 'adopt' WHEN gain > 0.05 THEN 'wins but loses recall' ELSE 'does not beat the base' END AS verdict FROM z""")
def arm_selection(spark: SparkSession, sf: str) -> DataFrame:
    return stats.selection_rule(stats.arm_means(_arms(spark, sf)), 0.05, "S1", "a", ("b", "c"))


@query("SELECT l_returnflag AS flag, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 9) AS slope FROM lineitem GROUP BY l_returnflag")
def log_log_slope(spark: SparkSession, sf: str) -> DataFrame:
    return stats.log_slope(table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "flag"), ["flag"], "l_quantity", "l_extendedprice")


@query("""SELECT l_returnflag AS label, round(exp(sum(l_tax * l_quantity) / sum(l_quantity)), 9) AS ppl, round(exp(sum(l_tax * l_quantity) FILTER (l_linenumber > 3) / sum(l_quantity) FILTER (l_linenumber > 3)), 9) AS late_ppl FROM lineitem GROUP BY l_returnflag""")
def perplexity_groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("label"), (F.col("l_tax") * F.col("l_quantity")).alias("ce"), F.col("l_quantity").alias("tokens"), (F.col("l_linenumber") > 3).alias("late"))
    return stats.perplexities(rows, ["label"])


@query("""WITH r AS (SELECT role AS kind, conv_id * 100 + turn AS ord FROM conversations), q(kind, quota) AS (VALUES ('user', 30), ('assistant', 20)) SELECT kind, ord FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ord) AS p FROM r) JOIN q USING (kind) WHERE p <= quota""")
def quota_cap(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(F.col("role").alias("kind"), (F.col("conv_id") * 100 + F.col("turn")).alias("ord"))
    return stats.quota_capped(rows, spark.createDataFrame([("user", 30), ("assistant", 20)], "kind string, quota int"))


@query("""WITH RECURSIVE g AS (SELECT role AS type, conv_id::VARCHAR AS grp, count(*) AS n FROM conversations GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY sha256('sample:' || grp), grp) AS k FROM g),
f AS (SELECT type, 0::BIGINT AS k, 0::BIGINT AS used, '' AS grp, false AS took FROM (SELECT DISTINCT type FROM g) UNION ALL SELECT f.type, o.k, f.used + CASE WHEN f.used + o.n <= 60 THEN o.n ELSE 0 END, o.grp, f.used + o.n <= 60 FROM f JOIN o ON o.type = f.type AND o.k = f.k + 1)
SELECT c.role AS type, c.conv_id::VARCHAR AS grp, c.turn FROM conversations c JOIN f ON f.type = c.role AND f.grp = c.conv_id::VARCHAR AND f.took""")
def whole_group_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select(F.col("role").alias("type"), F.col("conv_id").cast("string").alias("grp"), "turn")
    return stats.whole_group_sample(rows, 60)


@query("SELECT regexp_replace(props, '[0-9]+', 'N', 'g') AS reason, count(*) AS n FROM events GROUP BY ALL")
def rejection_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Reasons with their digits folded."""
    return table(spark, sf, "events").groupBy(F.regexp_replace("props", "[0-9]+", "N").alias("reason")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, metric, round(avg(v), 9) AS mean, count(v) AS n, count(*) - count(v) AS unparsed FROM (SELECT event_type, 'value' AS metric, CASE WHEN event_id % 10 > 0 THEN value END AS v FROM events UNION ALL SELECT event_type, 'k', TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events) GROUP BY ALL""")
def judge_score_means(spark: SparkSession, sf: str) -> DataFrame:
    """Means over the non-null scores of each metric, with the number missing."""
    e = table(spark, sf, "events").select("event_type", F.when(F.col("event_id") % 10 > 0, F.col("value")).alias("value"), F.get_json_object("props", "$.k").try_cast("double").alias("k"))
    long = e.unpivot("event_type", ["value", "k"], "metric", "v")
    return long.groupBy("event_type", "metric").agg(F.round(F.avg("v"), 9).alias("mean"), F.count("v").alias("n"), (F.count("*") - F.count("v")).alias("unparsed"))


@query("""WITH b AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS w, event_type, value FROM events) SELECT w AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM b GROUP BY ALL""")
def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, value, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '30 minutes' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new, event_id FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


@query("""SELECT n.user_id, n.event_id, arg_max(o.event_id, (o.ts, o.event_id)) AS previous_id FROM events n LEFT JOIN (SELECT user_id AS u, event_id, ts FROM events WHERE event_type = 'purchase') o ON o.u = n.user_id AND o.ts < n.ts GROUP BY n.user_id, n.event_id""")
def asof_previous_event(spark: SparkSession, sf: str) -> DataFrame:
    """For each event the user's latest earlier purchase: one window, no range join."""
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    before = W.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(W.unboundedPreceding, -1)
    mine = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    return e.select("user_id", "event_id", F.max(mine).over(before)["event_id"].alias("previous_id"))
