"""Corpus validation, licence gates, counts, change feeds and index diffs."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators.filters import DOC_TYPES, INDEXED_TYPES, JURISDICTIONS, STATUTE_TYPES
from corvane.operators.stage import running

#: Licence id, commercially safe, research only.
LICENCES = (
    ("DE-UrhG-5", True, False),
    ("CH-URG-5", True, False),
    ("CC-BY-4.0", True, False),
    ("ODbL-1.0", True, False),
    ("ODC-By-1.0", True, False),
    ("CC-BY-NC-SA-4.0", False, True),
    ("CC-BY-NC-4.0", False, True),
    ("unknown", False, False),
)
ARMS = ("commercial_safe", "research")


class GateError(ValueError):
    """A gate found rows that it refuses."""


def licence_register(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LICENCES, "lic string, lic_commercial boolean, lic_research boolean")


def document_problems(docs: DataFrame) -> DataFrame:
    """id and its problems, an empty array if there are none. Dates and the timestamp are strings here, as they are read."""
    c = F.col
    bad_date = lambda x: c(x).isNotNull() & (F.try_to_date(c(x), "yyyy-MM-dd").isNull())
    checks = [
        (~F.coalesce(c("id").contains(":"), F.lit(False)), "id_shape"),
        (c("id").contains(":") & ~c("id").startswith(F.concat(c("source"), F.lit(":"))), "id_source"),
        (~F.coalesce(c("jurisdiction").isin(*JURISDICTIONS), F.lit(False)), "jurisdiction"),
        (~F.coalesce(c("doc_type").isin(*DOC_TYPES), F.lit(False)), "doc_type"),
        (F.coalesce(c("licence"), F.lit("")) == "", "licence_missing"),
        (c("research_only") & c("commercial_safe"), "flag_conflict"),
        (bad_date("valid_from"), "valid_from"),
        (bad_date("valid_to"), "valid_to"),
        ((c("valid_from") != "") & (c("valid_to") != "") & (c("valid_to") < c("valid_from")), "window_order"),
        ((c("retrieved_at") != "") & F.try_to_timestamp(c("retrieved_at")).isNull(), "retrieved_at"),
        (~F.coalesce(c("sha256") == tx.sha256(c("text")), F.lit(False)), "sha256"),
    ]
    found = F.array(*(F.when(cond, F.lit(name)) for cond, name in checks))
    return docs.select("id", F.filter(found, lambda x: x.isNotNull()).alias("problems"))


def licence_problems(docs: DataFrame) -> DataFrame:
    """id, licence, problem: unknown or unregistered licences, claims beyond the licence, unmarked research-only rows."""
    reg = F.broadcast(licence_register(docs.sparkSession))  # eight rows
    rows = docs.join(reg, F.col("licence") == F.col("lic"), "left")
    problem = (
        F.when(F.col("licence") == "unknown", "refused")
        .when(F.col("lic").isNull(), "unregistered")
        .when(F.col("commercial_safe") & ~F.col("lic_commercial"), "claims_commercial")
        .when(F.col("lic_research") & ~F.col("research_only"), "not_marked_research")
    )
    return rows.select("id", "licence", problem.alias("problem")).filter("problem is not null")


def refuse(problems: DataFrame, what: str) -> None:
    """Raise if the frame has a row; reads no more than three."""
    some = problems.limit(3).collect()
    if some:
        raise GateError(f"{what}: {[r.asDict() for r in some]}")


def admitted(docs: DataFrame, arm: str) -> DataFrame:
    """Rows that an arm takes: commercially safe ones, or all for research."""
    if arm not in ARMS:
        raise ValueError(f"arm {arm!r} not in {ARMS}")
    return docs if arm == "research" else docs.filter("commercial_safe and not research_only")


def build_corpus(docs: DataFrame, arm: str) -> DataFrame:
    """The gate: one licence problem refuses the whole build."""
    refuse(licence_problems(docs), "licence")
    return admitted(docs, arm)


def licence_flags(df: DataFrame) -> DataFrame:
    """Flags from the register by licence id; unknown ids raise when read."""
    reg = F.broadcast(licence_register(df.sparkSession))
    rows = df.join(reg, F.col("licence") == F.col("lic"), "left")
    known = F.when(F.col("lic").isNull() | (F.col("lic") == "unknown"), F.raise_error(F.concat(F.lit("licence not registered: "), F.coalesce("licence", F.lit("null")))).cast("boolean"))
    return rows.select(*df.columns, F.coalesce(known, F.col("lic_commercial")).alias("lic_commercial"), F.col("lic_research"))


def unique_passages(rows: DataFrame) -> DataFrame:
    """(id, text, ord): exact repeats go; further texts of an id are kept as id#k, k from 1."""
    first = rows.groupBy("id", "text").agg(F.min("ord").alias("ord"))
    k = F.row_number().over(W.partitionBy("id").orderBy("ord")) - 1
    return first.withColumn("k", k).select(F.when(F.col("k") == 0, F.col("id")).otherwise(F.concat("id", F.lit("#"), F.col("k").cast("string"))).alias("id"), "ord", "text")


def manifest(docs: DataFrame) -> DataFrame:
    """All but the text, with its length and hash."""
    return docs.select(*[c for c in docs.columns if c not in ("text", "n_chars")], F.length("text").alias("n_chars"), tx.sha256(F.col("text")).alias("sha256"))


def manifest_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("jurisdiction", "licence").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


def strided(docs: DataFrame, sample: int, order: str = "ord", by: tuple[str, ...] = ()) -> DataFrame:
    """Every k-th row in the order of a unique column, within each group, k = max(1, n // sample) with n the group's rows. Only the order and the groups are numbered."""
    keys = docs.select(F.col(order).alias("at_"), *by)
    sizes = keys.groupBy(*by).agg(F.count("*").alias("size_")).select("size_", *(F.col(c).alias(f"size_{c}") for c in by))
    rows = running(keys, F.lit(1).cast("long"), "row_no", "at_", by=by)
    same = [F.col(c).eqNullSafe(F.col(f"size_{c}")) for c in by]
    rows = rows.join(sizes, functools.reduce(Column.__and__, same)) if by else rows.crossJoin(F.broadcast(sizes))
    picked = rows.filter(F.pmod("row_no", F.greatest(F.lit(1), F.floor(F.col("size_") / sample))) == 0).select("at_")
    return docs.join(picked, docs[order] == picked["at_"], "left_semi")


def tokens_per_char(docs: DataFrame, tokens: Column) -> DataFrame:
    return docs.groupBy("jurisdiction").agg((F.sum(tokens).cast("double") / F.sum("n_chars")).alias("ratio"), F.sum(tokens).alias("tokens"), F.sum("n_chars").alias("chars"))


def estimated_counts(counts: DataFrame, ratios: DataFrame) -> DataFrame:
    """Tokens from characters: the group's ratio, else the pooled one; rounded half to even."""
    pooled = ratios.agg((F.sum("tokens").cast("double") / F.sum("chars")).alias("pooled"))  # one row
    rows = counts.join(ratios.select("jurisdiction", "ratio"), "jurisdiction", "left").crossJoin(F.broadcast(pooled))
    return rows.select("jurisdiction", "licence", "documents", "chars", F.bround(F.col("chars") * F.coalesce("ratio", "pooled"), 0).cast("long").alias("est_tokens"))


def arm_totals(docs: DataFrame) -> DataFrame:
    """The same rows under overlapping conditions, and by jurisdiction with a grand total, in one pass."""
    safe = F.col("commercial_safe") & ~F.col("research_only")
    return docs.rollup("jurisdiction").agg(
        F.count("*").alias("research_docs"), F.sum("n_chars").alias("research_chars"), F.count_if(safe).alias("commercial_docs"),
        F.coalesce(F.sum(F.when(safe, F.col("n_chars"))), F.lit(0)).alias("commercial_chars"), F.grouping("jurisdiction").cast("int").alias("is_total"),
    )


def source_meta(docs: DataFrame) -> DataFrame:
    """Per source: counts, all/any flags, sorted distinct licences joined by +."""
    return docs.groupBy("source").agg(
        F.count("*").alias("documents"), F.bool_and("commercial_safe").alias("commercial_safe"), F.bool_or("research_only").alias("research_only"),
        F.array_join(F.sort_array(F.collect_set("licence")), "+").alias("licence"), F.min("ord").alias("first_ord"),
    )


def changes_since(docs: DataFrame, since: str) -> DataFrame:
    """Statute versions valid from a day on, each with the version before it: of the same source and citation, the latest valid_to before its valid_from.

    An equi-join on (source, citation) and a maximum; the newest first.
    """
    rows = docs.filter(F.col("doc_type").isin(*STATUTE_TYPES) & F.col("valid_from").isNotNull())
    new = rows.filter(F.col("valid_from") >= F.lit(since).cast("date"))
    old = rows.filter("valid_to is not null").select(F.col("source").alias("o_source"), F.col("citation_id").alias("o_citation"), F.col("valid_to").alias("o_to"), F.col("id").alias("o_id"), F.col("ord").alias("o_ord"))
    same = (F.col("source") == F.col("o_source")) & (F.col("citation_id") == F.col("o_citation")) & (F.col("o_to") < F.col("valid_from"))
    best = F.max(F.struct("o_to", (-F.col("o_ord")).alias("k"), "o_id"))["o_id"]
    return new.join(old, same, "left").groupBy("citation_id", "id", "source", "jurisdiction", "valid_from", "valid_to").agg(best.alias("previous_id"))


def record_digest(docs: DataFrame, columns: list[str]) -> DataFrame:
    """id, the text's hash, and the hash of the record's other fields in name order."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(columns)]
    text = tx.sha256(F.col("text"))
    return docs.select("id", text.alias("sha256"), tx.sha256(F.concat_ws("\x1f", text, *fields)).alias("record_sha256"))


def index_diff(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """id, state: added, removed, changed, metadata_only or unchanged."""
    a = indexed.select(F.col("id").alias("a_id"), F.col("sha256").alias("a_sha"), F.col("record_sha256").alias("a_rec"))
    b = current.select(F.col("id").alias("b_id"), F.col("sha256").alias("b_sha"), F.col("record_sha256").alias("b_rec"))
    state = (
        F.when(F.col("a_id").isNull(), "added")
        .when(F.col("b_id").isNull(), "removed")
        .when(F.col("a_rec") == F.col("b_rec"), "unchanged")
        .when(F.col("a_sha") == F.col("b_sha"), "metadata_only")
        .otherwise("changed")
    )
    return a.join(b, F.col("a_id") == F.col("b_id"), "full_outer").select(F.coalesce("a_id", "b_id").alias("id"), state.alias("state"))


def indexed(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("doc_type").isin(*INDEXED_TYPES))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both by id. Repeated ids, or ids of one side only, raise."""
    for side in (a, b):
        refuse(side.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"), "repeated ids")
    refuse(a.select("id").exceptAll(b.select("id")).unionByName(b.select("id").exceptAll(a.select("id"))), "ids of one side only")
    return a.join(b, "id")


def keep_order(docs: DataFrame) -> list[Column]:
    """Visiting order of deduplication: commercially safe first, research-only last, then source and id."""
    return [~F.col("commercial_safe"), F.col("research_only"), F.col("source"), F.col("id")]
