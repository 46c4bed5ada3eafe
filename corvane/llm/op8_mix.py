"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

A source's target fixes how many words it gives. Its documents share them by
their own odds: a document's expected copies grow with the binary digits of
its length, up to the largest multiple (`inclusions`). The whole part of the
expected copies is certain; the rest is an inclusion probability p, and one
more copy goes to the first documents in the order of
(u / (1 - u)) / (p / (1 - p)), with u the document's hash in [0, 1). The
sample's size is fixed in words: the order is cut where its words are nearest
to what the certain copies leave of the target.

The cut is found by narrowing: words by slice of the order, then by finer
slice of the one that holds the cut, and only that one's rows are ordered. The
decision on a document is then a comparison with its source's cut, so no task
holds a source and no document is shuffled.

Defined results. A null or wordless text has size 0 and takes 0 words. A null
source is a source of its own, ordered last. Rows that repeat a doc_id are
separate documents, ordered by their size; rows equal in both, and rows
without an id that are equal in text, are taken together or not. An empty
table gives an empty result. Other columns of the input are ignored. Sources
are ranked in one task, which holds a row a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm import common

#: Weights by order of source, repeated in turn; the largest multiple of a document.
WEIGHTS, MOST = (5, 2, 1), 3
#: Slices of the order in which a source's running total is kept, and finer slices of one of them.
SLICES = 4096


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target.

    The targets are the water level that fills each source in proportion to its
    weight up to `most` times its size: sources sorted by the level at which
    they are full, and the first level that no later source reaches.
    """
    n = len(weights)
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1).cast("int"))
    per = per.select("source", "source_size", weight.cast("long").alias("w"), F.row_number().over(by_name).alias("place"))
    full = (F.lit(most) * F.col("source_size")).cast("double")
    by_full = W.orderBy((full / F.col("w")).asc(), F.col("place").asc())
    everything, before = W.partitionBy(), by_full.rowsBetween(W.unboundedPreceding, -1)
    per = per.select(
        "*",
        F.row_number().over(by_full).alias("k"),
        (F.sum("source_size").over(everything) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double").alias("left"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))).cast("double").alias("w_left"),
    ).withColumn("level", F.col("left") / F.col("w_left"))
    fits = F.when(F.col("level") <= full / F.col("w"), F.struct("k", "level"))
    level = F.min(fits).over(everything)["level"]
    return per.select("source", "source_size", F.least(level * F.col("w"), full).alias("target"))


def inclusions(sized: DataFrame, goal: DataFrame, most: int = MOST) -> DataFrame:
    """source, digits, source_size, target, whole (certain copies), p (probability of one more), rest (words left to sample).

    Documents of one source and digit count have equal odds. Their expected
    copies are least(level * digits, most), the level such that the source's
    words come to its target: of the groups by falling digits, the first whose
    level keeps it and all later ones below `most`.
    """
    per = sized.groupBy("source", "digits").agg(F.sum("size").alias("words"))
    per = per.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    falling = W.partitionBy("source").orderBy(F.col("digits").desc())
    earlier, later = falling.rowsBetween(W.unboundedPreceding, -1), falling.rowsBetween(0, W.unboundedFollowing)
    per = per.withColumns({
        "left": F.col("target") - (F.lit(most) * F.coalesce(F.sum("words").over(earlier), F.lit(0))).cast("double"),
        "pull": F.sum(F.col("words") * F.col("digits")).over(later).cast("double"),
    })
    per = per.withColumn("level", F.when(F.col("pull") > 0, F.col("left") / F.nullif("pull", F.lit(0.0))).otherwise(F.lit(0.0)))
    fits = F.when(F.col("level") * F.col("digits") <= most, F.struct((-F.col("digits")).alias("k"), "level"))
    level = F.min(fits).over(W.partitionBy("source"))["level"]
    copies = F.greatest(F.lit(0.0), F.least(F.coalesce(level * F.col("digits"), F.lit(float(most))), F.lit(float(most))))
    per = per.withColumn("expected", copies).withColumn("whole", F.floor("expected"))
    given = F.sum(F.col("whole") * F.col("words")).over(W.partitionBy("source")).cast("double")
    return per.select("source", "digits", "source_size", "target", "whole", (F.col("expected") - F.col("whole")).alias("p"), (F.col("target") - given).alias("rest"))


def _sized(docs: DataFrame, seed: str) -> dict[str, Column]:
    """size, its binary digits, and u, which a row without an id draws by its text."""
    # each word with the white space around it becomes one character: no array of words is built
    marks = F.regexp_replace("text", rf"{common.SPACE}*{common.WORD}{common.SPACE}*", "w")
    size = F.when(F.col("text").rlike(common.WORD), F.length(marks)).otherwise(F.lit(0)).cast("long")
    key = F.coalesce(F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return {"size": size, "u": common.unit_hash(F.concat(F.lit(f"{seed}:"), key))}


def _digits() -> Column:
    return F.length(F.bin("size")).cast("long")


def _placed(rows: DataFrame, odds: DataFrame) -> DataFrame:
    """rows (doc_id, source, size, u) with what their source and digits give them, their ratio q, and its slice and finer slice."""
    rows = rows.withColumn("digits", _digits())
    own = odds.select(F.col("source").alias("o_source"), F.col("digits").alias("o_digits"), "source_size", "target", "whole", "p", "rest")
    rows = rows.join(own, rows["source"].eqNullSafe(own["o_source"]) & (rows["digits"] == own["o_digits"])).drop("o_source", "o_digits", "digits")
    ratio = F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) * (1 - F.col("p")) / F.nullif("p", F.lit(0.0)))
    # the order mapped to [0, 1): uniform where all odds are those of the source as a whole
    share = F.col("rest") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0))
    mean = F.col("q") * F.when((share > 0) & (share < 1), share / F.nullif(1 - share, F.lit(0.0))).otherwise(F.lit(1.0))
    at = F.least(F.floor(mean / (1 + mean) * F.lit(float(SLICES * SLICES))).cast("long"), F.lit(SLICES * SLICES - 1).cast("long"))
    return rows.withColumn("q", ratio).withColumn("at", at).withColumns({"slice": F.floor(F.col("at") / SLICES), "fine": F.pmod(F.col("at"), F.lit(SLICES))}).drop("at", "u")


def _crossing(rows: DataFrame, part: str, seen: Column) -> DataFrame:
    """c_source, c_part, c_seen: of each source the part that the cut falls into, and the words before it. Sources without one take all."""
    sums = rows.groupBy("source", part).agg(F.sum("size").alias("words"), F.max("rest").alias("rest"), F.max(seen).alias("seen"))
    before = F.col("seen") + F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    over = sums.select("source", part, "words", "rest", before.alias("before")).filter((F.col("before") + F.col("words")).cast("double") > F.col("rest"))
    first = over.groupBy("source").agg(F.min(F.struct(part, "before")).alias("x"))
    return first.select(F.col("source").alias("c_source"), F.col(f"x.{part}").alias("c_part"), F.col("x.before").alias("c_seen"))


def _cuts(rows: DataFrame) -> DataFrame:
    """k_source, k_slice, k_fine, last: the place where a source's order is cut, and the key of its last document in it that is taken."""
    open_ = rows.filter(F.col("q").isNotNull() & (F.col("rest") > 0))
    coarse = _crossing(open_, "slice", F.lit(0).cast("long"))
    inner = open_.join(coarse, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("slice") == F.col("c_part"))).drop("c_source", "c_part")
    fine = _crossing(inner, "fine", F.col("c_seen"))
    final = inner.drop("c_seen").join(fine, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("fine") == F.col("c_part")))
    blocks = final.groupBy("source", "slice", "fine", "q", "doc_id", "size").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"), F.max("c_seen").alias("seen"))
    order = W.partitionBy("source").orderBy("q", F.col("doc_id").asc_nulls_first(), "size")
    cum = F.col("seen") + F.coalesce(F.sum("words").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.withColumn("taken", cum.cast("double") + F.col("words") / F.lit(2.0) <= F.col("rest"))
    key = F.when(F.col("taken"), F.struct("q", "doc_id", "size"))
    return blocks.groupBy("source").agg(F.max("slice").alias("k_slice"), F.max("fine").alias("k_fine"), F.max(key).alias("last")).withColumnRenamed("source", "k_source")


def _decided(rows: DataFrame, cuts: DataFrame, most: int) -> DataFrame:
    """rows with copies."""
    rows = rows.join(cuts, F.col("source").eqNullSafe(F.col("k_source")), "left")
    here = F.struct("slice", "fine")
    cut = F.struct(F.col("k_slice").alias("slice"), F.col("k_fine").alias("fine"))
    key = F.struct("q", "doc_id", "size")
    within = F.col("k_slice").isNull() | (here < cut) | ((here == cut) & F.coalesce(key <= F.col("last"), F.lit(False)))
    more = F.coalesce(F.col("q").isNotNull() & (F.col("rest") > 0) & within, F.lit(False))
    copies = F.least(F.col("whole") + F.when(more, 1).otherwise(0), F.lit(most)).cast("long")
    return rows.withColumn("copies", copies)


def _planned(docs: DataFrame, seed: str, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sized rows, the odds and the cuts, all staged; the last two hold a row a source and digit count, and a row a source."""
    made = _sized(docs, seed)
    sized = common.staged(docs.select("doc_id", "source", *(c.alias(k) for k, c in made.items())), "mix-sizes")
    graded = sized.withColumn("digits", _digits())
    odds = common.staged(inclusions(graded, targets(sized, weights, most), most), "mix-odds")
    cuts = common.staged(_cuts(_placed(sized, odds)), "mix-cuts")
    return sized, odds, cuts


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, expected, copies, taken."""
    sized, odds, cuts = _planned(docs, seed, weights, most)
    rows = _decided(_placed(sized, odds), cuts, most)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("p")).alias("expected"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: each row of docs as often as the mix takes it, with its own columns. Words are counted again rather than texts shuffled."""
    _, odds, cuts = _planned(docs, seed, weights, most)
    carried = F.struct(*(F.col(c) for c in docs.columns)).alias("row")
    rows = docs.select("doc_id", "source", *(c.alias(k) for k, c in _sized(docs, seed).items()), carried)
    rows = _decided(_placed(rows, odds), cuts, most).filter("copies > 0")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(sha256('mix:' || COALESCE(doc_id::VARCHAR, sha256(COALESCE(text, '')))), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM documents),
graded AS (SELECT *, length(bin(size))::BIGINT AS digits FROM sized),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM per),
weighed AS (SELECT *, ([5, 2, 1])[((place - 1) % 3 + 1)::BIGINT]::BIGINT AS w FROM named),
ordered AS (
  SELECT *, row_number() OVER f AS k,
         (sum(source_size) OVER () - 3 * COALESCE(sum(source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS remaining,
         (sum(w) OVER () - COALESCE(sum(w) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS w_left
  FROM weighed WINDOW f AS (ORDER BY (3 * source_size)::DOUBLE / w, place)),
level AS (SELECT remaining / w_left AS level FROM ordered WHERE remaining / w_left <= (3 * source_size)::DOUBLE / w ORDER BY k LIMIT 1),
goal AS (SELECT source, source_size, least(level * w, (3 * source_size)::DOUBLE) AS target FROM ordered, level),
grades AS (SELECT source, digits, sum(size)::BIGINT AS words FROM graded GROUP BY ALL),
pulled AS (
  SELECT g.*, t.source_size, t.target,
         t.target - (3 * COALESCE(sum(words) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS remaining,
         (sum(words * digits) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS pull
  FROM grades g JOIN goal t ON g.source IS NOT DISTINCT FROM t.source WINDOW f AS (PARTITION BY g.source ORDER BY digits DESC)),
lifted AS (SELECT *, CASE WHEN pull > 0 THEN remaining / pull ELSE 0.0::DOUBLE END AS lift FROM pulled),
chosen AS (SELECT source, arg_max(lift, digits) AS lift FROM lifted WHERE lift * digits <= 3 GROUP BY source),
expect AS (
  SELECT p.*, greatest(0.0::DOUBLE, least(COALESCE(c.lift * digits, 3.0::DOUBLE), 3.0::DOUBLE)) AS expected
  FROM lifted p LEFT JOIN chosen c ON p.source IS NOT DISTINCT FROM c.source),
odds AS (SELECT *, floor(expected) AS whole, expected - floor(expected) AS p, target - sum(floor(expected)::BIGINT * words) OVER (PARTITION BY source)::DOUBLE AS rest FROM expect),
ratios AS (
  SELECT s.doc_id, s.source, s.size, o.source_size, o.target, o.whole, o.rest, CASE WHEN o.p > 0 THEN (u / (1 - u)) * (1 - o.p) / o.p END AS q
  FROM graded s JOIN odds o ON s.source IS NOT DISTINCT FROM o.source AND s.digits = o.digits),
ranked AS (
  SELECT *, CASE WHEN q IS NULL THEN NULL ELSE sum(size) OVER (PARTITION BY source, q IS NULL ORDER BY q, doc_id NULLS FIRST, size) END AS upto,
         sum(size) OVER (PARTITION BY source, q, doc_id, size) AS block
  FROM ratios)
SELECT doc_id, size, source_size, target,
       (least(whole + CASE WHEN q IS NOT NULL AND rest > 0 AND (upto - block)::DOUBLE + block / 2.0 <= rest THEN 1 ELSE 0 END, 3) * size)::BIGINT AS taken
FROM ranked
"""
QUERIES, ORACLES = {"op8_mix": op8_mix}, {"op8_mix": ORACLE}
