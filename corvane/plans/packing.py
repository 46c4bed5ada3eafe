"""Queries over splits, packing, masks, mixtures and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import mixture, packing
from corvane.plans._tables import docs_cte, documents, table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


_COLS = ("ord", "id", "source", "licence", "commercial_safe", "research_only", "n_chars")
_UNIT = "('0x' || substr(sha256({0}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0"
_SPLIT = f"""{docs_cte(*_COLS)}, sp AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY {_UNIT.format("'0:' || id")}, id) <= greatest(ceil(0.05::DOUBLE * count(*) OVER (PARTITION BY source)), 2) THEN 'val' ELSE 'train' END AS split FROM docs)"""
_PLACED = f"""{_SPLIT}, pl AS (SELECT *, n_chars + 1 AS t, COALESCE(sum(n_chars + 1) OVER (PARTITION BY source, split ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sp)"""


def _pieces(n: str, name: str) -> str:
    return f"""{name} AS (SELECT *, greatest(row * {n} - start, 0) AS lo, least((row + 1) * {n} - start, t) AS hi, start + greatest(row * {n} - start, 0) - row * {n} AS pos_at FROM (SELECT *, unnest(range(start // {n}, (start + t - 1) // {n} + 1)) AS row FROM {'ml' if n == 'row_len' else 'pl'}))"""


_ROW = "list(id ORDER BY pos_at) AS documents, sum(hi - lo)::BIGINT AS length, array_to_string(list_sort(list_distinct(list(licence))), '+') AS licence, bool_and(commercial_safe) AS commercial_safe, bool_or(research_only) AS research_only"


def _split(spark: SparkSession, sf: str) -> DataFrame:
    return packing.split_by_document(documents(spark, sf, *_COLS), 0.05, 2)


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.starts(_split(spark, sf), F.col("n_chars") + 1)


@query(f"WITH {_SPLIT} SELECT id, source, split FROM sp")
def doc_split(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf).select("id", "source", "split")


@query(f"WITH {_PLACED}, {_pieces('4096', 'pc')} SELECT source, split, row, {_ROW} FROM pc GROUP BY source, split, row")
def pack_rows_4096(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed_rows(_placed(spark, sf), 4096)


@query(f"WITH {_PLACED}, ml AS (SELECT *, unnest([4096, 8192]) AS row_len FROM pl), {_pieces('row_len', 'pc')} SELECT row_len, source, split, row, {_ROW} FROM pc GROUP BY row_len, source, split, row")
def pack_rows_multi(spark: SparkSession, sf: str) -> DataFrame:
    """One set of prefix sums feeds two row lengths."""
    both = _placed(spark, sf).withColumn("row_len", F.explode(F.array(F.lit(4096), F.lit(8192))))
    return packing.packed_rows(both, F.col("row_len"), ("row_len", "source", "split"))


@query(f"WITH {_PLACED}, {_pieces('4096', 'pc')}, r AS (SELECT source, split, row, sum(hi - lo) AS n FROM pc GROUP BY ALL) SELECT source, split, count(*) AS rows, sum(n)::BIGINT AS tokens FROM r GROUP BY source, split")
def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = packing.packed_rows(_placed(spark, sf), 4096)
    return rows.groupBy("source", "split").agg(F.count("*").alias("rows"), F.sum("length").alias("tokens"))


def _token_rows(spark: SparkSession, sf: str, row_len: int = 512) -> DataFrame:
    """Rows of token ids by the stand-in codec: a code point is its value plus one, the end is 0."""
    docs = documents(spark, sf, "ord", "id", "source", "text", "n_chars").withColumn("split", F.lit("all"))
    placed = packing.starts(docs, F.col("n_chars") + 1)
    codes = F.transform(F.split("text", ""), lambda c: F.ascii(c) + 1)
    return packing.packed_tokens(placed.withColumn("tokens", F.concat(codes, F.array(F.lit(0)))), "tokens", row_len)


_TOKENS = f"""{docs_cte("ord", "id", "source", "text", "n_chars")}, pl AS (SELECT *, n_chars + 1 AS t, COALESCE(sum(n_chars + 1) OVER (PARTITION BY source ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM docs), {_pieces('512', 'pc')},
cut AS (SELECT source, row, pos_at, hi - lo AS n, row_number() OVER (PARTITION BY source, row ORDER BY pos_at) - 1 AS local, list_transform(range(lo, hi), lambda k: CASE WHEN k = t - 1 THEN 0 ELSE unicode(substr(text, k + 1, 1)) + 1 END) AS ids FROM pc),
r0 AS (SELECT source, row, flatten(list(ids ORDER BY pos_at)) AS ids, flatten(list(list_transform(ids, lambda x: local) ORDER BY pos_at)) AS dids, count(*) - 1 AS last FROM cut GROUP BY source, row),
r AS (SELECT source, row, ids || list_transform(range(0, 512 - len(ids)), lambda x: 0) AS input_ids, dids || list_transform(range(0, 512 - len(ids)), lambda x: last) AS doc_ids, len(ids) AS length FROM r0)"""


def _digest(array):
    return F.sha2(F.array_join(F.transform(array, lambda x: x.cast("string")), ",").cast("binary"), 256)


@query(f"WITH {_TOKENS} SELECT source, row, length::INT AS length, sha256(array_to_string(input_ids, ',')) AS ids_sha, sha256(array_to_string(doc_ids, ',')) AS doc_sha FROM r")
def packed_token_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of the packed rows themselves."""
    rows = _token_rows(spark, sf)
    return rows.select("source", "row", "length", _digest("input_ids").alias("ids_sha"), _digest("doc_ids").alias("doc_sha"))


@query(f"WITH {_TOKENS} SELECT source, row, sha256(array_to_string(list_transform(range(1, 513), lambda k: k - 1 - (list_position(doc_ids, doc_ids[k]) - 1)), ',')) AS offsets_sha FROM r")
def row_doc_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return packing.document_offsets(_token_rows(spark, sf)).select("source", "row", _digest("offsets").alias("offsets_sha"))


@query(f"WITH {_TOKENS} SELECT source, row, sha256(array_to_string(list_transform(range(1, 513), lambda k: CASE WHEN k < 512 AND k < length AND doc_ids[k + 1] = doc_ids[k] THEN input_ids[k + 1] ELSE -100 END), ',')) AS labels_sha FROM r")
def boundary_mask(spark: SparkSession, sf: str) -> DataFrame:
    return packing.boundary_labels(_token_rows(spark, sf)).select("source", "row", _digest("labels").alias("labels_sha"))


@query(f"WITH {_TOKENS}, c AS (SELECT *, unnest(range(0, 2)) AS part FROM r) SELECT source, row, part::INT AS part, greatest(0, least(length - part * 256, 256))::INT AS length, sha256(array_to_string(input_ids[part * 256 + 1:part * 256 + 256], ',')) AS ids_sha FROM c")
def sub_rows(spark: SparkSession, sf: str) -> DataFrame:
    cut = packing.cut_rows(_token_rows(spark, sf), 2)
    return cut.select("source", "row", "part", "length", _digest("input_ids").alias("ids_sha"))


@query("""WITH b AS (SELECT conv_id, turn, list_transform(range(0, (turn * 3 + conv_id) % 7 + 1), lambda k: k::INT + 1) AS ids FROM conversations), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS longest FROM b)
SELECT conv_id, turn, ids || list_transform(range(0, longest - len(ids)), lambda k: 0) AS padded, ids || list_transform(range(0, longest - len(ids)), lambda k: -100) AS labels FROM m""")
def right_padded_batches(spark: SparkSession, sf: str) -> DataFrame:
    n = F.pmod(F.col("turn") * 3 + F.col("conv_id"), F.lit(7)).cast("int")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.transform(F.sequence(F.lit(0), n), lambda k: k + 1).alias("ids"))
    return packing.right_padded(rows, "ids", "conv_id").select("conv_id", "turn", "padded", "labels")


_SOURCES = "SELECT n_name AS name, n_regionkey AS grp, (n_nationkey % 4)::DOUBLE AS weight, CASE WHEN n_nationkey % 5 = 0 THEN 'research' ELSE 'commercial_safe' END AS arm FROM nation"
_GROUPS = "SELECT r_regionkey AS grp, (r_regionkey + 1) / 15.0::DOUBLE AS share FROM region WHERE r_regionkey < 4"


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    sources = n.selectExpr("n_name AS name", "n_regionkey AS grp", "CAST(n_nationkey % 4 AS DOUBLE) AS weight", "CASE WHEN n_nationkey % 5 = 0 THEN 'research' ELSE 'commercial_safe' END AS arm")
    groups = table(spark, sf, "region").filter("r_regionkey < 4").selectExpr("r_regionkey AS grp", "CAST(r_regionkey + 1 AS DOUBLE) / 15D AS share")
    return mixture.effective_weights(sources, groups, "commercial_safe")


_W = f"s AS ({_SOURCES}), g AS ({_GROUPS}), w AS (SELECT name, share * weight / sum(weight) OVER (PARTITION BY grp) AS w FROM s JOIN g USING (grp) WHERE weight > 0 AND arm = 'commercial_safe'), ew AS (SELECT name, w / sum(w) OVER () AS weight FROM w)"


@query(f"WITH {_W} SELECT name, round(weight, 12) AS weight FROM ew")
def mixture_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(spark, sf).withColumn("weight", F.round("weight", 12))


@query(f"""WITH {_W}, st AS (SELECT name, round(sum(round(weight, 9)) OVER (ORDER BY name), 9) AS upto, COALESCE(round(sum(round(weight, 9)) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 9), 0) AS since, row_number() OVER (ORDER BY name) = count(*) OVER () AS last FROM ew),
d AS (SELECT i, {_UNIT.format("'5:draw:' || i")} AS u FROM range(0, 3500) r(i)),
p AS (SELECT i, name, row_number() OVER (PARTITION BY name ORDER BY i) - 1 AS k FROM d JOIN st ON u >= since AND (u < upto OR last)),
c AS (SELECT n_name AS name, 20 + n_nationkey AS rows FROM nation), a AS (SELECT i, name, k // rows AS wrap, k % rows AS place, rows FROM p JOIN c USING (name)),
o AS (SELECT name, wrap, row, row_number() OVER (PARTITION BY name, wrap ORDER BY {_UNIT.format("'5:' || name || ':' || wrap || ':' || row")}, row) - 1 AS place FROM (SELECT DISTINCT name, wrap, unnest(range(0, rows)) AS row FROM a))
SELECT i - 500 AS i, name, wrap, row FROM a JOIN o USING (name, wrap, place) WHERE i >= 500""")
def mixture_schedule(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "nation").select(F.col("n_name").alias("name"), (20 + F.col("n_nationkey")).alias("rows"))
    steps = _weights(spark, sf).withColumn("weight", F.round("weight", 9))
    return mixture.schedule(spark, steps, counts, 3000, seed=5, start=500)


@query("SELECT o_orderkey, (o_orderkey % 8)::INT AS rank, o_orderkey // 8 AS turn FROM orders WHERE o_orderkey < (SELECT count(*) - count(*) % 8 FROM orders) AND o_orderkey // 8 >= 100")
def rank_shards(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey")
    return mixture.rank_rows(rows.count(), rows, "o_orderkey", 8, 100).select("o_orderkey", "rank", "turn")


@query("SELECT k % 1003 AS i, (k % 8)::INT AS rank FROM range(0, 1008) r(k)")
def padded_rank_shards(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.padded_ranks(spark, 1003, 8)


@query(f"WITH p AS (SELECT pass, row, row_number() OVER (PARTITION BY pass ORDER BY {_UNIT.format(chr(39) + '3:' + chr(39) + ' || pass || ' + chr(39) + ':' + chr(39) + ' || row')}, row) - 1 AS place FROM range(0, 4) a(pass), range(0, 300) b(row)) SELECT pass * 300 + place AS i, row FROM p WHERE pass * 300 + place < 1000")
def epoch_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.epochs(spark, 300, 1000, 3)


@query(f"""WITH u AS (SELECT k, {_UNIT.format("'9:len:' || k")} AS u FROM range(0, 2000) r(k)), d AS (SELECT k, (1 + floor(u * 300))::BIGINT AS n FROM u), s AS (SELECT k, n, COALESCE(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d)
SELECT k AS doc, n, start // 1024 AS first_row, (start + n - 1) // 1024 AS last_row FROM s""")
def synthetic_packed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Generated document lengths laid end to end in rows of 1,024."""
    docs = spark.range(2000).select(F.col("id").alias("ord"), F.lit("gen").alias("source"), F.lit("all").alias("split"), (1 + F.floor(tx.unit(9, F.concat(F.lit("len:"), F.col("id").cast("string"))) * 300)).alias("n"))
    s = packing.starts(docs, F.col("n"))
    return s.select(F.col("ord").alias("doc"), "n", F.floor(F.col("start") / 1024).alias("first_row"), F.floor((F.col("start") + F.col("n") - 1) / 1024).alias("last_row"))
