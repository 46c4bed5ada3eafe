"""URL filtering against dated lists; DataFrame functions only.

Dated list entries (add or remove a pattern) become validity intervals, and an
as-of join tests every capture against the entries that were active when it
was fetched. Among the active matches the most specific pattern decides: a
path prefix over a host, a host over a domain, then the longer pattern, and on
equal patterns the allow list.

Defined results. A host is a URL's authority without user info, port and final
dots, in small letters. A null or unparsable url, or a null fetch date, matches no
entry and is kept. Entries with a null field, or an action other than add and
remove, are ignored; on one day the remove of a pattern comes after the add.
Repeated captures are judged separately. Empty tables give empty results, an
empty list keeps all. Other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm import common

#: Levels by specificity.
DOMAIN, HOST, PREFIX = 1, 2, 3


def intervals(entries: DataFrame) -> DataFrame:
    """(list, level, pattern, effective, action) to (list, level, pattern, since, until): since included, until not, null if open."""
    kept = entries.filter(F.col("action").isin("add", "remove")).dropna(subset=["list", "level", "pattern", "effective"])
    day = kept.groupBy("list", "level", "pattern", "effective").agg(F.max("action").alias("action"))  # remove sorts after add
    order = W.partitionBy("list", "level", "pattern").orderBy("effective")
    return day.withColumn("until", F.lead("effective").over(order)).filter("action = 'add'").select("list", "level", "pattern", F.col("effective").alias("since"), "until")


#: The scheme, the authority and the path of a URL.
_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)(/[^?#]*)?"


def host_of(url: Column) -> Column:
    """The authority without user info, port and final dots, in small letters; an IPv6 address keeps its brackets."""
    authority = F.regexp_extract(url, _URL, 1)
    place = F.substring_index(authority, "@", -1)
    bare = F.when(place.startswith("["), F.concat(F.substring_index(place, "]", 1), F.lit("]"))).otherwise(F.substring_index(place, ":", 1))
    return F.lower(F.rtrim(bare, F.lit(".")))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _URL, 2)


def keys(host: Column, path: Column, labels_most: int, steps_most: int) -> Column:
    """All (level, pattern) pairs that an entry of at most so many labels or steps can match a capture by: its domains, its host, its path's prefixes."""
    none = F.array().cast("array<struct<level:int,pattern:string>>")
    labels = F.split(host, r"\.")
    n = F.least(F.size(labels), F.lit(labels_most))
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lit(DOMAIN).alias("level"), F.array_join(F.slice(labels, -i, i), ".").alias("pattern")))
    steps = F.slice(F.filter(F.split(path, "/"), lambda x: x != ""), 1, steps_most) if steps_most else F.array().cast("array<string>")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.struct(F.lit(PREFIX).alias("level"), F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")).alias("pattern")))
    own = F.array(F.struct(F.lit(HOST).alias("level"), host.alias("pattern")))
    return F.when(host == "", none).otherwise(F.concat(F.when(n > 0, domains).otherwise(none), own, F.when(F.size(steps) > 0, prefixes).otherwise(none)))


def url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, url, fetched) to id, host, fetched, list, pattern, n_matches, kept.

    Captures meet entries by equality on (level, pattern), a shuffle join that
    splits hot hosts at run time; equal keys fetched on the same day are joined
    once, and so a host with a third of all captures costs a row for each
    distinct path prefix and day. No key is longer than the list's longest
    entry of its kind, so a long path costs no more than the list asks for.
    """
    spans = intervals(entries).select(F.col("list"), F.col("level").alias("e_level"), F.col("pattern").alias("e_pattern"), "since", "until")
    parts = lambda level, mark: F.coalesce(F.max(F.when(F.col("e_level") == level, F.size(F.split("e_pattern", mark)))), F.lit(0))
    most = spans.agg(parts(DOMAIN, r"\.").alias("labels"), parts(PREFIX, "/").alias("steps")).first()
    rows = captures.select("id", "url", "fetched").withColumns({"host": F.coalesce(host_of(F.col("url")), F.lit("")), "path": F.coalesce(path_of(F.col("url")), F.lit(""))})
    rows = rows.withColumn("keys", keys(F.col("host"), F.col("path"), most["labels"], most["steps"]))
    terms = rows.select("fetched", F.inline("keys")).dropna().distinct()
    active = terms.join(spans, (terms["level"] == spans["e_level"]) & (terms["pattern"] == spans["e_pattern"]) & (spans["since"] <= terms["fetched"]) & (spans["until"].isNull() | (terms["fetched"] < spans["until"])))
    best = F.max(F.struct("level", F.length("pattern").alias("n"), (F.col("list") == "allow").alias("allowed"), "list", "pattern"))
    # one verdict for each distinct (host, path, day), then back to the captures
    places = rows.select("host", "path", "fetched", "keys").distinct()
    matched = places.select("host", "path", F.col("fetched").alias("on"), F.inline("keys"))
    hit = active.select(F.col("level").alias("a_level"), F.col("pattern").alias("a_pattern"), F.col("fetched").alias("a_on"), "list")
    matched = matched.join(hit, (F.col("level") == F.col("a_level")) & (F.col("pattern") == F.col("a_pattern")) & (F.col("on") == F.col("a_on")))
    verdict = matched.groupBy("host", "path", "on").agg(best.alias("best"), F.count("*").alias("n")).select(F.col("host").alias("v_host"), F.col("path").alias("v_path"), F.col("on").alias("v_on"), "best", "n")
    out = rows.join(verdict, (F.col("host") == F.col("v_host")) & (F.col("path") == F.col("v_path")) & (F.col("fetched") == F.col("v_on")), "left")
    return out.select("id", "host", "fetched", F.col("best.list").alias("list"), F.col("best.pattern").alias("pattern"), F.coalesce("n", F.lit(0)).alias("n_matches"), F.coalesce(F.col("best.allowed"), F.lit(True)).alias("kept"))


#: When a page counts as fetched: a day of two years, by its id.
FETCHED = "date_add(DATE'2023-01-01', cast(pmod(page_id * 37, 730) as int))"
_DRAW = "cast(conv(substring(sha2(concat('list:', host), 256), 1, 7), 16, 10) as int)"


def page_lists(pages: DataFrame) -> DataFrame:
    """The dated lists for `pages`: a fixed rule over its hosts, and a listed domain and its path that is allowed again."""
    hosts = pages.select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("host")).filter("host <> ''").distinct().withColumn("h", F.expr(_DRAW))
    day = lambda e: f"date_add(DATE'2023-01-01', cast({e} as int))"
    e = lambda lst, level, pattern, effective, action, when="true": f"if({when}, struct('{lst}' as list, {level} as level, {pattern} as pattern, {effective} as effective, '{action}' as action), null)"
    cells = [
        e("block", HOST, "host", day("h % 500"), "add", "h % 3 = 0"),
        e("block", HOST, "host", day("h % 500 + 50 + h % 97"), "remove", "h % 6 = 0"),
        e("block", HOST, "host", day("h % 500 + 150 + h % 97"), "add", "h % 12 = 0"),
        e("allow", PREFIX, "concat(host, '/en')", day("h % 300"), "add", "h % 5 = 0"),
        e("allow", PREFIX, "concat(host, '/en')", day("h % 300 + 200"), "remove", "h % 10 = 0"),
    ]
    rows = hosts.selectExpr(f"inline(filter(array({', '.join(cells)}), x -> x is not null))")
    fixed = [("block", DOMAIN, "cheap-pills.example.com", "2023-02-01", "add"), ("block", DOMAIN, "cheap-pills.example.com", "2024-06-01", "remove")]
    more = pages.sparkSession.createDataFrame(fixed, "list string, level int, pattern string, effective string, action string").withColumn("effective", F.to_date("effective"))
    return rows.unionByName(more)


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.select(F.col("page_id").alias("id"), "url", F.expr(FETCHED).alias("fetched"))
    return url_filter(captures, page_lists(pages)).withColumnRenamed("id", "page_id")


ORACLE = f"""
WITH cap AS (
  SELECT row_number() OVER () AS r, page_id, DATE '2023-01-01' + ((page_id * 37 % 730) + CASE WHEN page_id * 37 % 730 < 0 THEN 730 ELSE 0 END)::INT AS fetched,
         COALESCE(lower(rtrim(CASE WHEN starts_with(place, '[') THEN regexp_extract(place, '^(\\[[^\\]]*)', 1) || ']' ELSE string_split(place, ':')[1] END, '.')), '') AS host,
         list_filter(string_split(COALESCE(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), ''), '/'), lambda x: x <> '') AS steps
  FROM (SELECT *, string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '@')[-1] AS place FROM pages)),
hosts AS (SELECT DISTINCT host, ('0x' || substr(sha256('list:' || host), 1, 7))::BIGINT AS h FROM cap WHERE host <> ''),
entries AS (
  SELECT 'block' AS list, {HOST} AS level, host AS pattern, DATE '2023-01-01' + (h % 500)::INT AS effective, 'add' AS action FROM hosts WHERE h % 3 = 0
  UNION ALL SELECT 'block', {HOST}, host, DATE '2023-01-01' + (h % 500 + 50 + h % 97)::INT, 'remove' FROM hosts WHERE h % 6 = 0
  UNION ALL SELECT 'block', {HOST}, host, DATE '2023-01-01' + (h % 500 + 150 + h % 97)::INT, 'add' FROM hosts WHERE h % 12 = 0
  UNION ALL SELECT 'allow', {PREFIX}, host || '/en', DATE '2023-01-01' + (h % 300)::INT, 'add' FROM hosts WHERE h % 5 = 0
  UNION ALL SELECT 'allow', {PREFIX}, host || '/en', DATE '2023-01-01' + (h % 300 + 200)::INT, 'remove' FROM hosts WHERE h % 10 = 0
  UNION ALL SELECT 'block', {DOMAIN}, 'cheap-pills.example.com', DATE '2023-02-01', 'add'
  UNION ALL SELECT 'block', {DOMAIN}, 'cheap-pills.example.com', DATE '2024-06-01', 'remove'),
spans AS (
  SELECT * FROM (SELECT *, lead(effective) OVER (PARTITION BY list, level, pattern ORDER BY effective) AS until FROM entries) WHERE action = 'add'),
hit AS (
  SELECT c.r, s.list, s.pattern,
         row_number() OVER (PARTITION BY c.r ORDER BY s.level DESC, length(s.pattern) DESC, s.list = 'allow' DESC) AS place, count(*) OVER (PARTITION BY c.r) AS n
  FROM cap c JOIN spans s ON s.effective <= c.fetched AND (s.until IS NULL OR c.fetched < s.until) AND (
    (s.level = {HOST} AND s.pattern = c.host)
    OR (s.level = {DOMAIN} AND (c.host = s.pattern OR ends_with(c.host, '.' || s.pattern)))
    OR (s.level = {PREFIX} AND starts_with(c.host || '/' || array_to_string(c.steps, '/') || '/', s.pattern || '/'))))
SELECT page_id, host, fetched, list, pattern, COALESCE(n, 0) AS n_matches, COALESCE(list = 'allow', true) AS kept
FROM cap LEFT JOIN (SELECT * FROM hit WHERE place = 1) USING (r)
"""
QUERIES, ORACLES = {"op1_urls": op1_urls}, {"op1_urls": ORACLE}
